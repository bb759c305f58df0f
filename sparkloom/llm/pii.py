"""Personal information inside free text: find it and put typed placeholders in its place.

Information-theoretic sanitisation: corpus co-occurrence estimates how strongly a term reveals a
person. A list of known name parts names the protected entities. Every other term is measured over
the whole corpus: the share of its occurrences that stand in the place of a family name beside a
known given name (or the reverse) is its disclosure, and how many bits more likely a person is beside
it than beside any term its information. Terms over both thresholds are name parts themselves, and
the estimate is repeated with them until it finds no more, so that names joined only to such names are
reached as well. Persons are then found as a given name or initial with a family name. Addresses of
mail, telephone and identity numbers and street addresses are each seen once or twice in a corpus, so
that there is nothing to count: they disclose by their form.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import written

#: Least share of a term's occurrences that stand in a name's place, and least number of them.
DISCLOSURE = 0.3
MIN_SEEN = 2
#: Least information, in bits, that a term gives on a name being beside it.
MIN_BITS = 3.0
#: Name parts that may be sent to all tasks, and their characters; more raise an error instead of
#: growing unseen.
MAX_PARTS = 2_000_000
MAX_CHARS = 64_000_000

# Forms of numbers, words for streets, spelled-out marks of mail addresses.
MAIL_AT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|\s?\(a\)\s?)"
MAIL_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point)\s?[\])}]\s?|\s+(?:dot|punkt|point)\s+)"
EMAIL = re.compile(rf"(?:(?<![\w.+%@/:-])|(?<=mailto:))[\w][\w.+%'-]*{MAIL_AT}(?:[a-z0-9-]+{MAIL_DOT})+[a-z]{{2,}}(?![\w@])", re.IGNORECASE)
PHONE = re.compile(
    r"(?<![\w.+@/=-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,6}){1,5}|\(0?\d{2,4}\)[ .-]?\d{3}[ .-]\d{4}|[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}|0\d(?:[ .-]\d{2}){4}|0\d{4} \d{6}|0\d{2,4}[ /-]\d{5,8}|00\d{2}[ .-]?\d(?:[ .-]?\d{2,6}){2,5})(?![\w@]|[.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.+@/=-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{8}|[A-Z]\d[A-Z] ?\d{2} ?[A-Z]{2} ?\d{2})(?![\w@]|[.-]\d)|(?<=[=])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{8})(?![\w@])"
)
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w’'-]*)"
ADDRESS = re.compile(
    rf"""(?<![\w.,+@/-])(?:
    \d{{1,5}}[a-z]?[ ](?:{_CAP}[ ]){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Court|Close|Boulevard|Place|Square|Terrace|Crescent|Way|St\.|Ave\.|Blvd\.|Rd\.|Ln\.|Dr\.|(?:St|Ave|Rd|Ln|Dr|Ct|Blvd)\b)(?!\w)
    |\d{{1,5}}(?:[ ]?(?:bis|ter|[a-d]))?,?[ ](?:[Rr]ue|[Cc]hemin|[Aa]venue|[Bb]oulevard|[Aa]llée|[Pp]lace|[Ii]mpasse|[Qq]uai|[Rr]oute)[ ](?:(?:de[ ]la|de[ ]l['’]|du|des|de|d['’])[ ]?)?{_CAP}(?:[ -]{_CAP})*
    |(?:Calle|Avenida|Avda\.|Plaza|Camino|Paseo|Ronda|Carrera|C/|C\.)[ ](?:(?:de[ ]las|de[ ]los|de[ ]la|del|de)[ ])?{_CAP}(?:[ ](?:(?:de[ ]las|de[ ]los|de[ ]la|del|de)[ ])?{_CAP})*,?[ ](?:n[º°.][ ]?)?\d{{1,5}}[a-z]?(?!\w)
    |(?:(?:Am|An[ ]der|Im|In[ ]der|Zum|Zur|Auf[ ]dem|Unter[ ]den)[ ]{_CAP}(?:[ ]{_CAP})?|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|weg|gasse|platz|allee|ring|ufer|damm|steig|str\.)|{_CAP}(?:[ -](?:Straße|Strasse|Weg|Allee|Platz)))[ ]\d{{1,5}}[ ]?[a-z]?(?!\w)
    )""",
    re.VERBOSE,
)
WORD = r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"
AFTER = re.compile(rf"(,?)[  ]({WORD})(?![\w@])")
BEFORE = re.compile(rf"(?<![\w@.])({WORD})(,?)[  ]$")
INITIAL = re.compile(r"(?<![\w@.])[A-ZÀ-ÖØ-Þ]\.[  ]?$")
LINKS = "term string, place string, n bigint"
FOUND = "row_key bigint, field_name string, pii_kind string, start int, found_text string"
KINDS = ("email", "id_number", "phone", "address", "person")


def _words_automaton(words) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    if len(a):
        a.make_automaton()
    return a


def _hits(low: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Whole-word occurrences of the automaton's words in a lower-cased text."""
    out = []
    n = len(low)
    for end, w in automaton.iter(low):
        start, stop = end + 1 - len(w), end + 1
        if (start == 0 or not (low[start - 1].isalnum() or low[start - 1] in "_-")) and (stop == n or not (low[stop].isalnum() or low[stop] in "_@-")):
            out.append((start, stop, w))
    return out


def lowered(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _case(word: str) -> int:
    return 0 if word.islower() else 2 if word.isupper() else 1


def neighbours(text: str, low: str, automaton: ahocorasick.Automaton, kinds: dict[str, str]) -> Iterator[tuple[str, str]]:
    """``(term, place)``: terms beside a known part, in the place where its counterpart would be, and
    written in the same case. After a comma only where no given name stands before the family name."""
    for start, stop, w in _hits(low, automaton):
        case = _case(text[start:stop])
        after = AFTER.match(low, stop)
        if after and _case(text[after.start(2) : after.end(2)]) != case:
            after = None
        before = BEFORE.search(low, max(0, start - 60), start)
        if before and _case(text[before.start(1) : before.end(1)]) != case:
            before = None
        if kinds[w] == "given":
            if after and not after[1]:
                yield after[2], "family"
            if before and before[2]:
                yield before[1], "family"
        else:
            if before and not before[2]:
                yield before[1], "given"
            if after and after[1] and not (before and kinds.get(before[1]) == "given") and not INITIAL.search(text, max(0, start - 4), start):
                yield after[2], "given"


STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def _count_partition(parts: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _words_automaton(parts)
        for batch in batches:
            seen: Counter = Counter()
            raw: Counter = Counter()
            for text in batch["text"]:
                low = lowered(text)
                raw.update(low.split())
                if len(automaton):
                    seen.update(neighbours(text, low, automaton, parts))
            for token, n in raw.items():
                term = STRIP.sub("", token)
                if term.isalpha() or re.fullmatch(WORD, term):
                    seen[term, ""] += n
            yield pd.DataFrame([(t, p, n) for (t, p), n in seen.items()], columns=["term", "place", "n"])

    return run


def co_occurrence(texts: DataFrame, parts: dict[str, str]) -> DataFrame:
    """``(term, place, n)`` over all texts: occurrences of a term at all (place empty) and in the
    place of a given or family name beside one of the known ``parts``. Combined before the shuffle."""
    return texts.select("text").where("text is not null").mapInPandas(_count_partition(parts), LINKS).groupBy("term", "place").agg(F.sum("n").alias("n"))


def disclosing(counts: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Terms whose place beside name parts discloses a person: ``(term, part_kind, share, bits)``.

    ``share`` is how often the term stands in that place of all its occurrences, ``bits`` the log of
    that share over the share among all terms. Terms under a threshold are not returned.
    """
    total = F.sum(F.when(F.col("place") == "", F.col("n")))
    per_term = counts.groupBy("term").agg(
        F.coalesce(total, F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("place") == "given", F.col("n"))), F.lit(0)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("place") == "family", F.col("n"))), F.lit(0)).alias("family"),
    )
    base = float(counts.agg((F.sum(F.when(F.col("place") != "", F.col("n"))) / total).alias("base")).first()[0] or 0.0)
    kind = F.when(F.col("given") > F.col("family"), "given").otherwise("family")
    beside = F.greatest("given", "family")
    scored = per_term.where(beside >= MIN_SEEN).withColumn("part_kind", kind).withColumn("share", F.least(F.lit(1.0), beside / F.greatest("n", beside)))
    scored = scored.withColumn("bits", F.log2(F.col("share") / F.lit(max(base, 1e-12))))
    return scored.where((F.col("share") >= DISCLOSURE) & (F.col("bits") >= MIN_BITS) & (F.length("term") >= 3)).select("term", "part_kind", "share", "bits")


def name_parts(texts: DataFrame, lexicon: DataFrame) -> dict[str, str]:
    """Known and disclosed name parts, lower-cased, with their kind.

    The words of the corpus are counted once; each further round counts only what stands beside the
    parts found last, until none is new. What is collected are name parts, not rows: at most
    ``MAX_PARTS``.
    """
    known = lexicon.select(F.lower(F.trim("name_part")).alias("w"), F.lower(F.trim("part_kind")).alias("k")).where("w <> '' and k in ('given', 'family')").groupBy("w").agg(F.min("k").alias("k"))
    parts = {r["w"]: r["k"] for r in known.limit(MAX_PARTS + 1).collect()}
    if not parts:
        return {}
    counts = written(co_occurrence(texts, parts), "pii-counts")
    new = _collected(disclosing(counts, parts), parts)
    while new:
        more = texts.where("text is not null").mapInPandas(_beside(new), LINKS).groupBy("term", "place").agg(F.sum("n").alias("n"))
        parts |= new
        counts = written(counts.unionByName(more).groupBy("term", "place").agg(F.sum("n").alias("n")), "pii-counts")
        new = _collected(disclosing(counts, parts), parts)
    return parts


def _beside(parts: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _words_automaton(parts)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(neighbours(text, lowered(text), automaton, parts))
            yield pd.DataFrame([(t, p, n) for (t, p), n in seen.items()], columns=["term", "place", "n"])

    return run


def _collected(found: DataFrame, parts: dict[str, str]) -> dict[str, str]:
    rows = found.select("term", "part_kind").limit(MAX_PARTS + 1).collect()
    if len(rows) + len(parts) > MAX_PARTS or sum(len(r["term"]) for r in rows) + sum(map(len, parts)) > MAX_CHARS:
        raise ValueError("too many name parts; use a longer lexicon or higher thresholds")
    return {r["term"]: r["part_kind"] for r in rows if r["term"] not in parts}


INITIAL_AFTER = re.compile(r",[  ]?[A-ZÀ-ÖØ-Þ]\.(?!\w)")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def persons(text: str, low: str, automaton: ahocorasick.Automaton, parts: dict[str, str]) -> list[tuple[int, int]]:
    """Spans of full names: given name or initial with family name, or family name, given name."""
    hits = _hits(low, automaton)
    by_start = {s: (s, e, w) for s, e, w in sorted(hits, key=lambda h: h[1])}  # the longest at a place
    ordered = sorted(by_start.values())
    out = []
    used = -1
    for s, e, w in ordered:
        if s < used:
            continue
        kind = parts[w]
        nxt = AFTER.match(low, e)
        hit = by_start.get(nxt.start(2)) if nxt else None
        if kind == "given":
            if hit and not nxt[1] and parts[hit[2]] == "family":
                out.append((s, hit[1]))
                used = hit[1]
            elif nxt and not nxt[1] and not hit and _unknown_family(text, nxt, s, e):
                out.append((s, nxt.end(2)))
                used = nxt.end(2)
        elif kind == "family":
            before = INITIAL.search(text, max(0, s - 4), s)
            if before and before.start() >= used:
                out.append((before.start(), e))
                used = e
            elif hit and nxt[1] and parts[hit[2]] == "given":
                out.append((s, hit[1]))
                used = hit[1]
            elif m := INITIAL_AFTER.match(text, e):
                out.append((s, m.end()))
                used = m.end()
    return out


def _unknown_family(text: str, nxt: re.Match, s: int, e: int) -> bool:
    """Whether a word after a known given name is written as a family name would be: in title case
    like the given name, the last word or before a mark, or all in capitals like it."""
    given, word = text[s:e], text[nxt.start(2) : nxt.end(2)]
    if len(word) < 4:
        return False
    if given.isupper():
        return word.isupper()
    return given[:1].isupper() and word[:1].isupper() and not word.isupper()


class Finder:
    """All kinds of personal information in one text."""

    def __init__(self, parts: dict[str, str]) -> None:
        self.parts = parts
        self.automaton = _words_automaton(parts)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Spans ``(start, end, kind)`` that don't overlap, in order."""
        low = lowered(text)
        spans: list[tuple[int, int, str]] = []
        if "@" in text or " at " in low or "at)" in low or "at]" in low or "(a)" in low:
            for m in EMAIL.finditer(text):
                if not _is_login(text, m):
                    spans.append((*m.span(), "email"))
        if any(c.isdigit() for c in text):
            spans += [(*m.span(), "id_number") for m in ID_NUMBER.finditer(text)]
            spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
            spans += [(*m.span(), "address") for m in ADDRESS.finditer(text)]
        if len(self.automaton):
            spans += [(a, b, "person") for a, b in persons(text, low, self.automaton, self.parts)]
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        out: list[tuple[int, int, str]] = []
        for x in spans:
            if not out or x[0] >= out[-1][1]:
                out.append(x)
        return out


def _is_login(text: str, m: re.Match) -> bool:
    """Whether what looks like an address of mail is the login of a URL or connection string."""
    head = re.split(r"[\s\"'<>(]", text[max(0, m.start() - 200) : m.start()])[-1]
    return "://" in head or "@" not in m[0] and not re.search(r"(?i)dot|\.|punkt|point", m[0].partition("at")[2])


_FINDERS: dict[str, Finder] = {}


def _finder(sent) -> Finder:
    """The finder of a broadcast dictionary, built once in a worker process and not in every task."""
    if sent.number not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[sent.number] = Finder(sent.value)
    return _FINDERS[sent.number]


class Sent:
    """Name parts as a broadcast variable with a number of its own."""

    def __init__(self, context, parts: dict[str, str]) -> None:
        self._broadcast = context.broadcast(parts)
        self.number = uuid.uuid4().hex

    @property
    def value(self) -> dict[str, str]:
        return self._broadcast.value


def find_pii(texts: DataFrame, parts: dict[str, str]) -> DataFrame:
    """``(row_key, field_name, pii_kind, start, found_text)`` of each place in ``texts``
    (``row_key, field_name, text``). Null and empty texts have none; repeated rows repeat. Texts are
    read whole, each by itself; nothing is shuffled. ``parts`` is broadcast, its size being checked
    where it is made."""
    sent = Sent(texts.sparkSession.sparkContext, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(sent)
        for batch in batches:
            rows = [
                (key, field, kind, a, text[a:b])
                for key, field, text in zip(batch["row_key"], batch["field_name"], batch["text"], strict=True)
                for a, b, kind in finder.find(text)
            ]
            yield pd.DataFrame(rows, columns=["row_key", "field_name", "pii_kind", "start", "found_text"])

    return texts.select("row_key", "field_name", "text").where("text is not null and text <> ''").mapInPandas(run, FOUND)


def found_ways(found: DataFrame, parts: dict[str, str], lexicon: DataFrame) -> DataFrame:
    """``(pii_kind, way, n)``: by which way the places were found. Persons: ``listed`` (all parts in the
    lexicon), ``co_occurrence`` (a part disclosed by the corpus), ``beside_known`` (a part that only
    stands beside a known one); the other kinds by their ``form``."""
    listed = {r[0] for r in lexicon.select(F.lower(F.trim("name_part"))).where("name_part is not null").distinct().limit(MAX_PARTS).collect()}
    texts_of = found.sparkSession.sparkContext.broadcast((listed, set(parts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_list, known = texts_of.value
        for batch in batches:
            seen: Counter = Counter()
            for kind, text in zip(batch["pii_kind"], batch["found_text"], strict=True):
                words = [w for w in re.findall(WORD, text.lower()) if len(w) > 1]
                way = "form" if kind != "person" else "listed" if all(w in in_list for w in words) else "co_occurrence" if all(w in known for w in words) else "beside_known"
                seen[kind, way] += 1
            yield pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["pii_kind", "way", "n"])

    return found.select("pii_kind", "found_text").mapInPandas(run, "pii_kind string, way string, n bigint").groupBy("pii_kind", "way").agg(F.sum("n").alias("n"))


def redact_pii(texts: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Every row of ``texts`` with a placeholder such as ``[EMAIL]`` for each place found and all
    else unchanged; null texts stay null."""
    sent = Sent(texts.sparkSession.sparkContext, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(sent)
        for batch in batches:
            rows = []
            for key, field, text in zip(batch["row_key"], batch["field_name"], batch["text"], strict=True):
                if text:
                    at, out, n = 0, [], 0
                    for a, b, kind in finder.find(text):
                        out += [text[at:a], f"[{kind.upper()}]"]
                        at, n = b, n + 1
                    rows.append((key, field, "".join([*out, text[at:]]), n))
                else:
                    rows.append((key, field, text, 0))
            yield pd.DataFrame(rows, columns=["row_key", "field_name", "redacted", "n_found"])

    return texts.select("row_key", "field_name", "text").mapInPandas(run, "row_key bigint, field_name string, redacted string, n_found int")
