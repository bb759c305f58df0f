"""Credentials embedded in source code and configuration: find them, name them, redact them."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import trigrams
from sparkloom.session import written

#: Characters of a chunk; a chunk ends with a line, so a longer line is a chunk of its own.
CHUNK = 4096
#: Characters after a chunk that a value which begins in it may need to be seen whole.
OVERLAP = 2048

# Names that credentials go by, and the public formats of tokens.
STRONG = r"password|passwd|passphrase|pgpass|kennwort|mot_de_passe|contrase(?:ñ|n)a|db_pass|_pass|svc_pw|_pw|pwd|client_secret|secret|bearer|auth|api_?key|access_key|token|_tok|_sig|credential"
WEAK = r"secret_key|private_key|studio_key|llm_key|_key"
SEP = r"[\"'\\]*[ \t]*\]?[ \t]*(?::=|=>|=|:)[ \t]*"
NAMED = rf"(?:{WEAK}|{STRONG})(?![a-z])(?:_[a-z0-9_]+)?"
TOKEN = r"(?:sk_(?:live|test)_[A-Za-z0-9]{12,}|\bsk-[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{12,}|(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{12,}|\b(?:akia|asia)[A-Za-z0-9]{12,}|\baiza[A-Za-z0-9_-]{30,}|\bnpm_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}|\bhf_[A-Za-z0-9]{30,}|hooks\.slack\.com/services/[A-Za-z0-9/]{20,}|\beyj[A-Za-z0-9_-]{8,}\.eyj[A-Za-z0-9_.-]{8,})"

#: kind -> (pattern with the value as group ``v``, how much the place alone says: see ``is_secret``)
DETECTORS: dict[str, tuple[str, str]] = {
    "private_key": (r"-----BEGIN (?:[A-Z0-9]+ )*(?P<v>PRIVATE KEY-----(?:(?!-----END)[\s\S])*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?)", "sure"),
    "token": (rf"(?P<v>{TOKEN})", "sure"),
    "quoted": (rf"{NAMED}{SEP}\(?\s*[bru]?(?P<q>\\?[\"'])(?P<v>[^\"'\n]*?)(?P=q)", "named"),
    "bare": (rf"{NAMED}{SEP}(?P<v>[^\s\"'()<>\[\]{{}},;]+)[ \t]*\r?$", "named"),
    "single_letter": (r"(?:\bk = |\bk: |\bk=[\"']|[\"']k[\"']\]? ?[:=] |<k>|\benv k=|\bexport k=|^k=)\(?(?:[\"'])?(?P<v>[^\s\"'()<>\[\]{},;]{8,})", "unnamed"),
    "element": (rf"{NAMED}>(?P<v>[^<\n]*)</", "named"),
    "netrc": (r"^[ \t]*password[ \t]+(?P<v>\S+)[ \t]*\r?$", "named"),
    "option": (r"--(?:token|password|passwd|secret|api-key)[ =]+[\"']?(?P<v>[^\s\"']+)", "named"),
    "header": (r"(?:bearer|basic) +(?P<v>[A-Za-z0-9+/=._~%-]{8,})", "unnamed"),
    "url": (r"[a-z0-9+.-]+://[^\s:/@\"'<>]*:(?P<v>[^\s@\"'<>]+)@", "place"),
    "query": (r"[?&](?:sig|signature|token|secret|password|access_token|api_key)=(?P<v>[^\s&\"'#]+)", "named"),
    "curl": (r"curl\b[^\n]*? -u +[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)", "place"),
    "mysql": (r"mysql\b[^\n]*? (?:-p|--password=)[\"']?(?P<v>[^\s\"']+)", "place"),
    "sql": (r"identified +by +[\"'](?P<v>[^\"'\n]+)", "place"),
    "default": (r"(?:getenv|environ\.get)\( *[\"'][^\"'\n]*[\"'] *, *[\"'](?P<v>[^\"'\n]+)", "unnamed"),
    "prose": (r"(?:for token|my key is|my token is|my password is|works with|rotate me:|the key is) +[\"'`]?(?P<v>[^\s,;\"'`]{8,})", "unnamed"),
}
PLACEHOLDER = re.compile(
    r"^(?:null|none|nil|true|false|undefined|test|todo|dummy|secret|password|\W*|x{3,})$|[<>{}]|\*{3}|\$[A-Za-z_(]|^\$|%\(|^(?:env|vault|ref|file|secret|ssm|arn)[:/]|your[_-]|change_?-?(?:me|it)|lookup_secret|placeholder|redacted|^example",
    re.IGNORECASE,
)
HEX = re.compile(r"^[0-9a-f]{32,}$")
PIECES = re.compile(r"[\"']\s*\+?\s*\\?\s*[bru]?[\"']([^\"'\n]*)[\"']")

RULES = {k: (re.compile(p, re.IGNORECASE | re.MULTILINE), how) for k, (p, how) in DETECTORS.items()}
NEEDS = {k: trigrams.required(p) for k, (p, _) in DETECTORS.items()}
VOCABULARY = trigrams.vocabulary(list(NEEDS.values()))


def is_secret(value: str, how: str) -> bool:
    """Whether a value found by a detector is a credential and no placeholder, reference or word.

    ``how``: ``sure`` the format says it all; ``place`` the place holds nothing but passwords;
    ``named`` the name says password or the like; ``unnamed`` the value itself must look random.
    """
    if how == "sure":
        return True
    if PLACEHOLDER.search(value) or len(value) < 6:
        return False
    digit = any(c.isdigit() for c in value)
    upper = any(c.isupper() for c in value)
    lower = any(c.islower() for c in value)
    if how == "unnamed":
        if HEX.match(value):
            return True
        word = re.fullmatch(r"[a-z]+(?:-[a-z]+)+-\d+", value) or re.fullmatch(r"[A-Za-z._]+\d+[!*#%?+]", value)
        if word:
            return True
        if len(value) < 8 or not (digit or (upper and lower)) or not (upper or lower):
            return False
        if re.search(r"[!*#%?+]$", value) or _basic(value):
            return True
        if len(value) < 16 or not (upper and lower) or re.search(r"[.(]\w+$", value):
            return False
        changes = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:], strict=False))
        return digit or changes >= 0.4 * len(value)  # names in camel case change less than chance
    if not (digit or (upper and lower) or re.search(r"[!#%?+]$", value)):
        return False
    if how == "place":
        return not re.match(r"^\d{1,5}/", value)
    return not re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+|[\d.,:-]+|[./~][\w./-]*/[\w./-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", value)


def _basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except ValueError:
        return False


def chunks(text: str, size: int = CHUNK) -> Iterator[tuple[int, int, int]]:
    """``(start, end, line)`` of line-aligned chunks; ``line`` is the number of the first line."""
    start, line, n = 0, 1, len(text)
    while start < n:
        end = text.rfind("\n", start, start + size) + 1 if n - start > size else n
        if end <= start:
            end = text.find("\n", start + size) + 1 or n
        yield start, end, line
        line += text.count("\n", start, end)
        start = end


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, t in enumerate(VOCABULARY):
        a.add_word(t, i)
    a.make_automaton()
    return a


def posting_bits(text: str, automaton: ahocorasick.Automaton) -> int:
    """Which trigrams of the vocabulary a chunk holds, as bits."""
    bits = 0
    for i in {i for _, i in automaton.iter("\n" + text.lower())}:
        bits |= 1 << i
    return bits


def postings(text: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Which trigrams of the vocabulary a chunk holds."""
    return {VOCABULARY[i] for _, i in automaton.iter("\n" + text.lower())}


def candidates(present: set[str]) -> list[str]:
    """Detectors whose required trigrams all occur: the intersection of their postings."""
    return [k for k, cond in NEEDS.items() if trigrams.satisfied(cond, present)]


def verify(text: str, start: int, end: int, kinds: list[str]) -> list[tuple[int, int, str]]:
    """Spans of credential values by the regexes of ``kinds``, for matches that begin in
    ``text[start:end]``; the value itself, named at the end of a chunk, may begin in the next.

    Overlapping spans are merged; the first detector in order names the credential.
    """
    stop = min(len(text), end + OVERLAP)
    spans: list[tuple[int, int, str]] = []
    for kind in kinds:
        rule, how = RULES[kind]
        for m in rule.finditer(text, start, stop):
            a, b = m.span("v")
            if m.start() >= end:
                continue
            pieces = PIECES.match(text, b) if kind in ("quoted", "single_letter") else None
            if not is_secret(m["v"] + (pieces[1] if pieces else ""), how):
                continue
            if kind == "private_key":
                if b == stop and stop < len(text):  # a key longer than the overlap
                    m = rule.search(text, m.start())
                    b = m.end("v")
                a = m.start()
            elif kind in ("quoted", "single_letter", "token"):
                while (piece := PIECES.match(text, b)) and (kind != "token" or "\n" in text[b : piece.start(1)]):
                    b = piece.end(1)
            spans.append((a, b, kind))
    return _merged(spans)


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def find_in(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, str]]:
    """``(line, start, end, kind)`` of all credentials of one text."""
    if not text:
        return []
    spans = []
    for start, end, _ in chunks(text):
        kinds = candidates(postings(text[start : end + OVERLAP] if end < len(text) else text[start:], automaton))
        if kinds:
            spans += verify(text, start, end, kinds)
    out, line, at = [], 1, 0
    for a, b, kind in _merged(spans):  # a value may be seen from two chunks
        line += text.count("\n", at, a)
        at = a
        out.append((line, a, b, kind))
    return out


def redact_text(text: str, found: list[tuple[int, int, int, str]]) -> str:
    """The text with each value replaced by a placeholder; quotes, pieces, lines and key frames stay."""
    out, at = [], 0
    for _, a, b, kind in found:
        value = text[a:b]
        if kind == "private_key":
            head = re.match(r"-----BEGIN [^\n\\]*?-----", value)
            tail = re.search(r"-----END [^\n\\]*?-----$", value)
            i, j = head.end() if head else 0, tail.start() if tail else len(value)
            body = re.sub(r"[A-Za-z0-9+/=]{8,}", "REDACTED", value[i:j])
            value = value[:i] + body + value[j:]
        else:
            value = "".join(p if re.fullmatch(r"[\"'\s+\\]+", p) else "REDACTED" for p in re.split(r"([\"']\s*\+?\s*\\?\s*[\"'])", value) if p)
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]])


FOUND = "source_table string, row_key bigint, line_no bigint, kind string"
REDACTED = "row_key bigint, redacted string, n_found int, kinds array<string>"
#: Bits of one word of a chunk's postings.
WORD = 62
WORDS = -(-len(VOCABULARY) // WORD)
INDEX = "source_table string, row_key bigint, chunk_line bigint, size int, " + ", ".join(f"w{i} bigint" for i in range(WORDS)) + ", chunk string"


def slices(text: str) -> Iterator[tuple[int, int, str]]:
    """``(line, size, slice)`` of each chunk: its first line, its own length, and its text with as much
    of what follows as a value that begins in it may need: whole lines, and a private key to its end."""
    for start, end, line in chunks(text):
        stop = len(text)
        if end + OVERLAP < stop:
            stop = text.find("\n", end + OVERLAP) + 1 or stop
            head = text.rfind("-----BEGIN", start, end)
            if head >= 0 and text.find("-----END", head, stop) < 0:
                tail = text.find("-----END", stop)
                stop = text.find("\n", tail) + 1 or len(text) if tail >= 0 else len(text)
        yield line, end - start, text[start:stop]


def trigram_index(texts: DataFrame) -> DataFrame:
    """The index over all chunks of ``texts`` (``source_table, row_key, text``): one row for each chunk
    with the trigrams it holds, as bits of the words ``w0, w1, ...``, and the chunk itself.

    Only trigrams that some detector requires are kept. Null and empty texts have no chunks, repeated
    rows repeat theirs. Nothing is shuffled.
    """
    mask = (1 << WORD) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            rows = []
            for source, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for line, size, piece in slices(text):
                    bits = posting_bits(piece, automaton)
                    rows.append((source, key, line, size, *[bits >> (WORD * i) & mask for i in range(WORDS)], piece))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * WORDS, pa.string()]
                names = ["source_table", "row_key", "chunk_line", "size", *[f"w{i}" for i in range(WORDS)], "chunk"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.select("source_table", "row_key", "text").where("row_key is not null and text is not null and text <> ''").mapInArrow(run, INDEX)


def _words(literal: frozenset[str]) -> list[tuple[int, int]]:
    """``(word, bits)`` of a literal's trigrams in a chunk's postings."""
    bits = 0
    for t in literal:
        bits |= 1 << VOCABULARY.index(t)
    return [(i, word) for i in range(WORDS) if (word := bits >> (WORD * i) & ((1 << WORD) - 1))]


#: Each detector's groups of literals as words of postings; equal groups of several detectors once.
GROUPS = {tuple(group): [_words(literal) for literal in group] for groups in NEEDS.values() for group in groups}


def intersected(words: list[np.ndarray]) -> dict[str, np.ndarray]:
    """For each detector the chunks that it is run on: of each group of literals that its regex demands
    the postings hold all trigrams of one. A detector that demands nothing is run on all."""
    n = len(words[0]) if words else 0
    held = {}
    for group, literals in GROUPS.items():
        some = np.zeros(n, dtype=bool)
        for literal in literals:
            every = np.ones(n, dtype=bool)
            for i, bits in literal:
                every &= (words[i] & bits) == bits
            some |= every
        held[group] = some
    out = {}
    for kind, groups in NEEDS.items():
        out[kind] = np.ones(n, dtype=bool)
        for group in groups:
            out[kind] &= held[tuple(group)]
    return out


def _candidates(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return intersected([batch.column(f"w{i}").to_numpy(zero_copy_only=False) for i in range(WORDS)])


def verified(index: DataFrame) -> DataFrame:
    """``(source_table, row_key, line_no, kind)``: credentials that begin in the chunks of the index. The
    postings of each detector are intersected, and its regex is run on the chunks that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _candidates(batch)
            some = np.logical_or.reduce(list(hits.values()))
            kept = batch.filter(pa.array(some))
            kinds = np.array(list(hits))
            marks = np.stack([h[some] for h in hits.values()], axis=1)
            rows = []
            for source, key, line, size, piece, mark in zip(*[kept.column(c).to_pylist() for c in ("source_table", "row_key", "chunk_line", "size", "chunk")], marks, strict=True):
                rows += [(source, key, line + piece.count("\n", 0, a), kind) for a, _, kind in verify(piece, 0, size, kinds[mark].tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["source_table", "row_key", "line_no", "kind"])

    return index.mapInArrow(run, FOUND)


def find_secrets(texts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(source_table, row_key, line_no, kind)``: lines of ``texts`` where a credential begins.

    The trigram index over all chunks is written once (or given); the trigrams that each detector's
    regex requires are derived from its syntax tree; their postings are intersected, and the regexes
    are run on the chunks that are left, each only on those it is a candidate for. A text of any
    length is read whole, chunk by chunk; a value that two chunks see may come out twice.
    """
    return verified(written(trigram_index(texts), "secret-index") if index is None else index)


def redact_secrets(texts: DataFrame) -> DataFrame:
    """Every row of ``texts`` with its text redacted, the number and kinds of what was found.

    Null texts stay null, texts without credentials unchanged; row counts are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for batch in batches:
            rows = []
            for key, text in zip(batch["row_key"], batch["text"], strict=True):
                found = find_in(text, automaton)
                rows.append((key, redact_text(text, found) if found else text, len(found), sorted({k for *_, k in found})))
            yield pd.DataFrame(rows, columns=["row_key", "redacted", "n_found", "kinds"])

    return texts.select("row_key", "text").mapInPandas(run, REDACTED)


def chunk_shares(index: DataFrame) -> DataFrame:
    """``(kind, n_chunks, n_candidates)``: of all chunks, those that a detector is run on; the kind ``any``
    counts chunks that some detector is run on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _candidates(batch)
            hits["any"] = np.logical_or.reduce(list(hits.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(hits)), pa.array([batch.num_rows] * len(hits), pa.int64()), pa.array([int(h.sum()) for h in hits.values()], pa.int64())], names=["kind", "n_chunks", "n_candidates"])

    counted = index.select(*[f"w{i}" for i in range(WORDS)]).mapInArrow(run, "kind string, n_chunks bigint, n_candidates bigint")
    return counted.groupBy("kind").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_candidates").alias("n_candidates"))


def posting_lists(index: DataFrame) -> DataFrame:
    """``(trigram, n_chunks)``: how many chunks each required trigram is in."""
    counts = [F.count_if(F.shiftrightunsigned(f"w{i // WORD}", i % WORD).bitwiseAND(F.lit(1)) == 1).alias("n") for i in range(len(VOCABULARY))]
    row = index.agg(F.array(*counts).alias("n"))  # one row of counts
    return row.select(F.posexplode("n").alias("i", "n_chunks")).select(F.get(F.array(*[F.lit(t) for t in VOCABULARY]), F.col("i")).alias("trigram"), "n_chunks")
