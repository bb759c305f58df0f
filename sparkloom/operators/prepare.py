"""Prepare processors: named steps from DataFrame to DataFrame."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.errors import UnsupportedError, ValidationError
from sparkloom.functions import modes
from sparkloom.functions.formula import blank, compile_formula, quoted, truthy
from sparkloom.operators import joins, relational

Step = Callable[[DataFrame, dict[str, Any]], DataFrame]
PROCESSORS: dict[str, Step] = {}


def processor(*names: str):
    """Register a processor under its names."""

    def put(f: Step) -> Step:
        for n in names:
            PROCESSORS[n] = f
        return f

    return put


def col(name: str) -> Column:
    return F.col(quoted(name))


def out(p: dict, default: str | None = None) -> str:
    """Output column of a step: given, or the input column."""
    return p.get("outputColumn") or p.get("output") or default or p["column"]


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def apply_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Run ``{type, params, disabled?}`` steps in order. Encodings of one column by statistics of its
    values, one after the other, are done at once."""
    done = 0
    for k, s in enumerate(steps):
        if s.get("disabled"):
            continue
        if k < done:
            continue
        if (run := _encoders(steps, k)) and len(run) > 1:
            df = modes.encode_many(df, run[0]["column"], run[0].get("target"), [(str(p["encoding"]).upper(), p.get("outputColumn")) for p in run])
            done = k + len(run)
            continue
        name = s.get("type") or s.get("processor_type")
        if s.get("metaType") == "GROUP" or name in ("ProcessorGroup",):
            df = apply_steps(df, s.get("params", {}).get("steps") or s.get("steps") or [])
            continue
        if name not in PROCESSORS:
            raise UnsupportedError(f"processor {name!r}")
        try:
            df = PROCESSORS[name](df, s.get("params") or {})
        except KeyError as e:
            raise ValidationError(f"{name}: missing parameter {e}") from e
    return df


def _encoders(steps: list[dict], start: int) -> list[dict]:
    """Parameters of the encoders by statistics of one column and target from ``start`` on."""
    out: list[dict] = []
    for s in steps[start:]:
        p = s.get("params") or {}
        same = not out or (p.get("column"), p.get("target")) == (out[0].get("column"), out[0].get("target"))
        if s.get("type") != "CategoricalEncoder" or s.get("disabled") or not same or str(p.get("encoding")).upper() not in modes.STATISTICS or p.get("outputColumn") == p.get("column"):
            break
        out.append(p)
    return out


def _keep(df: DataFrame, cond: Column, p: dict, flips: bool = True) -> DataFrame:
    """Keep or drop the rows of a condition, clear the cells, or flag them."""
    cond = F.coalesce(cond, F.lit(False))
    action = str(p.get("action") or ("KEEP_ROW" if p.get("keep", True) else "REMOVE_ROW")).upper()
    if action in ("KEEP_ROW", "KEEP"):
        return df.where(cond)
    if action in ("REMOVE_ROW", "REMOVE"):
        return df.where(~cond)
    target = p.get("columns") or [p["column"]]
    if action == "CLEAR_CELL":
        return df.withColumns({c: F.when(~cond, col(c)) for c in target})
    if action == "DONTCLEAR_CELL":
        return df.withColumns({c: F.when(cond, col(c)) for c in target})
    raise UnsupportedError(f"action {action}")


def _scope(df: DataFrame, p: dict) -> list[str]:
    """Columns a step applies to: one, a list, a pattern or all."""
    if p.get("appliesTo") == "ALL":
        return df.columns
    if p.get("columnsPattern"):
        return [c for c in df.columns if re.search(p["columnsPattern"], c)]
    return list(p.get("columns") or [p["column"]])


def _flag(df: DataFrame, cond: Column, p: dict) -> DataFrame:
    """A flag column: 1 where the condition holds, else null."""
    return put(df, out(p), F.when(F.coalesce(cond, F.lit(False)), 1))


# --- columns -------------------------------------------------------------------------------------


@processor("ColumnRenamer")
def rename(df, p):
    pairs = p["renamings"]
    return df.withColumnsRenamed(pairs if isinstance(pairs, dict) else {r["from"]: r["to"] for r in pairs})


@processor("ColumnCopier")
def copy(df, p):
    return put(df, p["outputColumn"], col(p["inputColumn"]))


@processor("ColumnsSelector")
def select(df, p):
    named = _scope(df, p)
    if p.get("keep", True) and str(p.get("mode", "keep")) != "remove":
        return df.select(*[quoted(c) for c in named])
    return df.drop(*named)


@processor("ColumnReorder")
def reorder(df, p):
    first = p["columns"]
    return df.select(*[quoted(c) for c in first], *[quoted(c) for c in df.columns if c not in first])


@processor("MoveColumns")
def move(df, p):
    moved, rest = p["columns"], [c for c in df.columns if c not in p["columns"]]
    at = {"BEGIN": 0, "END": len(rest)}.get(p.get("position", "BEGIN"))
    if at is None:
        at = rest.index(p["reference"]) + (p["position"] == "AFTER")
    return df.select(*[quoted(c) for c in rest[:at] + moved + rest[at:]])


@processor("ColumnsConcat")
def concat(df, p):
    cs = [col(c).cast("string") for c in p["columns"]]
    if p.get("keepBlanks"):
        cs = [F.coalesce(c, F.lit("")) for c in cs]
    return put(df, p["outputColumn"], F.concat_ws(p.get("separator", ""), *cs))


@processor("FillColumn")
def fill_column(df, p):
    return put(df, p["column"], F.lit(p["value"]))


@processor("Coalesce")
def coalesce(df, p):
    first = p["columns"]
    return put(df, p.get("outputColumn") or first[0], F.coalesce(*[F.when(~blank(col(c)), col(c)) for c in first]))


# --- missing values --------------------------------------------------------------------------------


@processor("FillEmptyWithValue")
def fill_empty(df, p):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(blank(col(c)), F.lit(str(p["value"])).try_cast(kinds[c])).otherwise(col(c)) for c in _scope(df, p)})


@processor("RemoveRowsOnEmpty")
def remove_empty(df, p):
    flags = [blank(col(c)) for c in _scope(df, p)]
    hit = modes.all_of(flags) if p.get("how") == "all" else modes.any_of(flags)
    return df.where(hit if p.get("keep") else ~hit)


def _order(p: dict):
    if not p.get("order"):
        raise ValidationError("this step depends on row order: name order columns")
    return Window.partitionBy(*[col(c) for c in p.get("partition", [])]).orderBy(*relational.order_columns(p["order"]))


@processor("UpDownFill", "FillEmptyWithPreviousNext")
def up_down_fill(df, p):
    w = _order(p)
    direction = str(p.get("direction", "PREVIOUS")).upper()
    prev, nxt = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for c in _scope(df, p):
        v = F.when(~blank(col(c)), col(c))
        if direction in ("PREVIOUS", "DOWN"):
            made[c] = F.last(v, ignorenulls=True).over(prev)
        elif direction in ("NEXT", "UP"):
            made[c] = F.first(v, ignorenulls=True).over(nxt)
        else:
            n = F.row_number().over(w)
            df = df.withColumn("_pos", n)
            at = F.when(v.isNotNull(), F.col("_pos"))
            a, b = F.last(v, ignorenulls=True).over(prev), F.first(v, ignorenulls=True).over(nxt)
            pa, pb = F.last(at, ignorenulls=True).over(prev), F.first(at, ignorenulls=True).over(nxt)
            made[c] = F.when(v.isNotNull(), v.cast("double")).otherwise(F.when(b.isNotNull(), a + (b - a) * (F.col("_pos") - pa) / (pb - pa)).otherwise(a))
    return df.withColumns(made).drop("_pos")


@processor("FillEmptyWithComputedValue")
def fill_computed(df, p):
    c, mode = col(p["column"]), str(p["mode"]).upper()
    stat = {"MEAN": F.avg(c), "AVERAGE": F.avg(c), "MEDIAN": F.median(c), "MODE": F.mode(F.when(~blank(c), c), deterministic=True), "MIN": F.min(c), "MAX": F.max(c)}[mode]
    value = df.agg(stat).first()[0]
    return put(df, out(p), F.when(blank(c), F.lit(value)).otherwise(c))


@processor("ImputeWithML")
def impute(df, p):
    method = str(p.get("method", "mean")).upper()
    if method not in ("MEAN", "MEDIAN", "MODE"):
        raise UnsupportedError(f"imputation {method}")
    return fill_computed(df, {**p, "mode": method})


# --- text --------------------------------------------------------------------------------------------


@processor("StringTransformer")
def string_transform(df, p):
    f = modes.STRING.get(str(p["mode"]).upper())
    if f is None:
        raise UnsupportedError(f"string mode {p['mode']}")
    extra = {k: p[k] for k in ("length", "pad") if k in p}
    return df.withColumns({(out(p) if len(_scope(df, p)) == 1 else c): f(col(c), **extra) for c in _scope(df, p)})


@processor("FindReplace", "MultiColumnFindReplace")
def find_replace(df, p):
    pairs = p.get("mapping") or [{"from": p["find"], "to": p["replace"]}]
    mode = str(p.get("matchMode") or p.get("matching") or "SUBSTRING").upper()

    def change(c: Column) -> Column:
        for m in pairs:
            a, b = m["from"], m["to"]
            if mode in ("FULL_STRING", "COMPLETE", "EQUALS"):
                c = F.when(c == a, F.lit(b)).otherwise(c)
            elif mode in ("PATTERN", "REGEX"):
                c = F.regexp_replace(c, a, b)
            else:
                c = F.replace(c, F.lit(a), F.lit(b))
        return c

    cs = _scope(df, p)
    return df.withColumns({(out(p) if len(cs) == 1 else c): change(col(c)) for c in cs})


@processor("PatternExtract", "RegexpExtractor")
def extract(df, p):
    c, pattern = col(p["column"]), p["pattern"]
    if p.get("all"):
        return put(df, out(p, p["column"] + "_all"), F.regexp_extract_all(c, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0)))
    compiled = re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern))
    groups = compiled.groups
    names = p.get("outputColumns") or [next((n for n, i in compiled.groupindex.items() if i == k), f"{p['column']}_{k}") for k in range(1, max(1, groups) + 1)]
    df = df.withColumns({n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k if groups else 0)) for k, n in enumerate(names, 1)})
    return put(df, p["foundColumn"], c.rlike(pattern)) if p.get("foundColumn") else df


GROK = {"WORD": r"\b\w+\b", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "INT": r"[+-]?\d+", "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "DATA": r".*?", "GREEDYDATA": r".*", "NOTSPACE": r"\S+", "SPACE": r"\s*", "UUID": r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "LOGLEVEL": r"(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)", "USERNAME": r"[\w.-]+", "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"'}


@processor("Grok")
def grok(df, p):
    names: list[str] = []

    def one(m: re.Match) -> str:
        if m[1] not in GROK:
            raise UnsupportedError(f"grok pattern {m[1]}")
        if m[2]:
            names.append(m[2])
            return f"({GROK[m[1]]})"
        return f"(?:{GROK[m[1]]})"

    pattern = re.sub(r"%\{(\w+)(?::(\w+))?\}", one, p["pattern"])
    return extract(df, {"column": p["column"], "pattern": pattern, "outputColumns": names})


@processor("ColumnsSplitter", "SplitColumn")
def split_column(df, p):
    parts = F.split(col(p["column"]), re.escape(p["separator"]), int(p.get("limit") or -1))
    if p.get("dropEmpty"):
        parts = F.filter(parts, lambda x: x != "")
    if p.get("asArray"):
        return put(df, out(p, p["column"] + "_parts"), parts)
    names = p.get("outputColumns") or [f"{p['column']}_{i}" for i in range(int(p.get("limit") or p.get("n") or 2))]
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


@processor("Tokenizer")
def tokenizer(df, p):
    op = str(p.get("operation", "ARRAY")).upper()
    text = F.lower(col(p["column"])) if p.get("normalise") else col(p["column"])
    words = F.filter(F.split(F.trim(text), p.get("pattern") or r"\s+"), lambda w: w != "")
    if p.get("stopWords"):
        words = F.filter(words, lambda w: ~w.isin(p["stopWords"]))
    if p.get("sort"):
        words = F.array_sort(words)
    if op in ("EXPLODE", "FOLD", "ROWS"):
        return df.withColumn(out(p, p["column"] + "_token"), F.explode_outer(words))
    return put(df, out(p, p["column"] + "_tokens"), words)


@processor("Ngrammer")
def ngrams(df, p):
    n = int(p["n"])
    w = F.filter(F.split(F.trim(col(p["column"])), r"\s+"), lambda x: x != "")
    made = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return put(df, out(p, p["column"] + "_ngrams"), made)


@F.pandas_udf(StringType())
def _strip_html(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        x = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", x)
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip()

    return s.map(one)


@processor("HtmlStripper")
def html_strip(df, p):
    return put(df, out(p), _strip_html(col(p["column"])))


def stem(word: str) -> str:
    """A light suffix stemmer for English."""
    for suffix, keep, repl in (("ational", 3, "ate"), ("iveness", 3, "ive"), ("fulness", 3, "ful"), ("ousness", 3, "ous"), ("ization", 3, "ize"), ("ies", 2, "y"), ("sses", 2, "ss"), ("ing", 3, ""), ("edly", 3, ""), ("ed", 3, ""), ("ly", 3, ""), ("ment", 4, ""), ("ness", 3, ""), ("es", 3, "e"), ("s", 3, "")):
        if word.endswith(suffix) and len(word) - len(suffix) >= keep and not word.endswith("ss" if suffix == "s" else "\0"):
            base = word[: len(word) - len(suffix)] + repl
            return base[:-1] if suffix in ("ing", "ed") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return word


@F.pandas_udf(StringType())
def _stem(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(stem(w) for w in x.split()))


@processor("StemText")
def stem_text(df, p):
    return put(df, out(p), _stem(F.lower(col(p["column"]))))


IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "went": "go", "gone": "go", "ran": "run", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "feet": "foot", "better": "good", "best": "good", "did": "do", "done": "do", "said": "say", "made": "make", "took": "take", "saw": "see", "seen": "see"}


@processor("LemmatizeText")
def lemmatize(df, p):
    if str(p.get("language", "en")).lower()[:2] != "en":
        raise UnsupportedError("lemmas exist for English only")
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    words = F.split(F.lower(col(p["column"])), r"\s+")
    return put(df, out(p), F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " "))


@processor("SimplifyText")
def simplify(df, p):
    c = F.regexp_replace(F.lower(modes.strip_accents(col(p["column"]))), r"[^\p{L}\p{N}\s]", " ")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    if p.get("stopWords"):
        c = F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(p["stopWords"])), " ")
    if p.get("sort"):
        c = F.array_join(F.array_sort(F.split(c, " ")), " ")
    return put(df, out(p), _stem(c) if p.get("stem") else c)


MARKERS = {"en": "the and of to is that with for are this", "fr": "le la les des et est une dans pour que", "de": "der die das und ist nicht ein mit für von", "es": "el los las que una por con para está del", "pt": "não uma que com para os do da em são", "it": "il che di una per con non sono gli della", "ru": "и в не на что с по для это как"}


def _one_of(words: list) -> Callable[[Column], Column]:
    """Membership as a function of one argument, as higher-order functions count arguments."""
    return lambda w: w.isin(words)


@processor("LanguageDetector")
def detect_language(df, p):
    words = F.split(F.lower(col(p["column"])), r"[^\p{L}]+")
    score = [F.struct(F.size(F.filter(words, _one_of(m.split()))).alias("n"), F.lit(k).alias("k")) for k, m in sorted(MARKERS.items(), reverse=True)]
    best = F.array_max(F.array(*score))
    return put(df, out(p, p["column"] + "_language"), F.when(best["n"] > 0, best["k"]))


POSITIVE = ["good", "great", "excellent", "happy", "love", "best", "fine", "nice", "perfect", "success", "works", "better", "helpful"]
NEGATIVE = ["bad", "poor", "terrible", "sad", "hate", "worst", "fail", "fails", "failed", "error", "broken", "wrong", "slow", "problem"]


@processor("SentimentAnalyzer")
def sentiment(df, p):
    w = F.split(F.lower(col(p["column"])), r"[^\p{L}]+")
    n = lambda ws: F.size(F.filter(w, lambda x: x.isin(ws)))
    return put(df, out(p, p["column"] + "_sentiment"), F.when(col(p["column"]).isNotNull(), F.coalesce(F.try_divide((n(POSITIVE) - n(NEGATIVE)).cast("double"), (n(POSITIVE) + n(NEGATIVE)).cast("double")), F.lit(0.0))))


def _hash(c: Column, algorithm: str) -> Column:
    a = str(algorithm).upper().replace("-", "")
    table = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda x: F.sha2(x, 256), "SHA512": lambda x: F.sha2(x, 512), "XXHASH64": lambda x: F.xxhash64(x).cast("string")}
    if a not in table:
        raise UnsupportedError(f"hash {algorithm}")
    return table[a](c.cast("string"))


@processor("TextHasher", "HashComputer")
def hasher(df, p):
    return put(df, out(p, p["column"] + "_hash"), _hash(col(p["column"]), p.get("algorithm", "SHA256")))


@processor("ColumnPseudoAnonymizer")
def pseudonymise(df, p):
    salted = F.concat(F.lit(p.get("pepper", "")), F.lit(p.get("salt", "")), col(p["column"]).cast("string"))
    return put(df, out(p), _hash(salted, p.get("method", "SHA256")))


@processor("UnicodeNormalizer")
def unicode_normalise(df, p):
    form = str(p.get("form", "NFC"))

    @F.pandas_udf(StringType())
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return put(df, out(p), norm(col(p["column"])))


@processor("CountMatches")
def count_matches(df, p):
    mode = str(p.get("matchMode", "SUBSTRING")).upper()
    c = col(p["column"])
    n = (c == p["value"]).cast("int") if mode == "FULL_STRING" else F.regexp_count(c, F.lit(p["value"] if mode in ("PATTERN", "REGEX") else re.escape(p["value"])))
    return put(df, out(p, p["column"] + "_matches"), n)


@processor("ExtractNumbers")
def numbers(df, p):
    found = F.regexp_extract_all(col(p["column"]), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    if p.get("first", True):
        return put(df, out(p, p["column"] + "_number"), F.get(found, F.lit(0)).try_cast("double"))
    return put(df, out(p, p["column"] + "_numbers"), F.transform(found, lambda x: x.try_cast("double")))


@processor("SplitIntoChunks")
def text_chunks(df, p):
    size, overlap = int(p.get("size", 1000)), int(p.get("overlap", 0))
    seps = p.get("separators") or ["\n\n", "\n", ". ", " "]

    @F.pandas_udf(ArrayType(StringType()))
    def cut(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out_, at = [], 0
            while at < len(text):
                end = min(len(text), at + size)
                if end < len(text):
                    for sep in seps:
                        k = text.rfind(sep, at + 1, end)
                        if k > at + overlap:
                            end = k + len(sep)
                            break
                out_.append(text[at:end])
                if end == len(text):
                    break
                at = max(end - overlap, at + 1)
            return out_

        return s.map(one)

    index, chunk = p.get("indexColumn", "chunk_index"), out(p, p["column"] + "_chunk")
    return df.select(*[quoted(c) for c in df.columns if c not in (index, chunk)], F.posexplode_outer(cut(col(p["column"]))).alias(index, chunk))


# --- identifiers on the net ------------------------------------------------------------------------------


@processor("URLParser", "SplitURL")
def split_url(df, p):
    c, name = col(p["column"]), p["column"]
    hostport = F.try_parse_url(c, F.lit("AUTHORITY"))
    parts = {
        "scheme": F.try_parse_url(c, F.lit("PROTOCOL")), "host": F.try_parse_url(c, F.lit("HOST")), "port": F.regexp_extract(hostport, r":(\d+)$", 1).try_cast("int"), "path": F.try_parse_url(c, F.lit("PATH")),
        "querystring": F.try_parse_url(c, F.lit("QUERY")), "anchor": F.try_parse_url(c, F.lit("REF")),
    }
    wanted = [x.lower() for x in p.get("extractComponents") or parts]
    return df.withColumns({f"{name}_{k}": v for k, v in parts.items() if k in wanted})


@processor("QuerystringSplitter")
def split_query(df, p):
    pairs = F.str_to_map(F.regexp_replace(col(p["column"]), r"^\?", ""), F.lit("&"), F.lit("="))
    if p.get("keys"):
        return df.withColumns({f"{p['column']}_{k}": F.try_url_decode(F.element_at(pairs, k)) for k in p["keys"]})
    return put(df, out(p, p["column"] + "_params"), pairs)


@processor("IPAddressParser")
def parse_ip(df, p):
    c, name = col(p["column"]), p.get("outputColumn") or p["column"]
    v4 = c.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    v6 = c.rlike(r"^[0-9A-Fa-f:]+$") & c.contains("::") | c.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    private = c.rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    return df.withColumns({f"{name}_version": F.when(v4, 4).when(v6, 6), f"{name}_private": F.when(v4, private)})


@processor("EmailDomainExtractor")
def email_split(df, p):
    c, name = col(p["column"]), p.get("outputColumn") or p["column"]
    valid = c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    return df.withColumns({f"{name}_localpart": F.when(valid, F.split_part(c, F.lit("@"), F.lit(1))), f"{name}_domain": F.when(valid, F.split_part(c, F.lit("@"), F.lit(2)))})


@processor("PhoneFormatter")
def phone(df, p):
    code = {"US": "1", "FR": "33", "DE": "49", "GB": "44", "UK": "44", "ES": "34"}.get(str(p.get("country", "US")).upper())
    if code is None:
        raise UnsupportedError(f"country {p.get('country')}")
    c = col(p["column"])
    digits = F.regexp_replace(c, r"\D", "")
    inter = F.when(c.rlike(r"^\s*\+"), digits).when(c.rlike(r"^\s*00"), F.substring(digits, 3, 30)).otherwise(F.concat(F.lit(code), F.regexp_replace(digits, "^0", "")))
    return put(df, out(p), F.when(F.length(digits).between(7, 15), F.concat(F.lit("+"), inter)))


COUNTRIES = {"france": "FR", "germany": "DE", "deutschland": "DE", "united states": "US", "usa": "US", "united states of america": "US", "united kingdom": "GB", "great britain": "GB", "spain": "ES", "españa": "ES", "italy": "IT", "japan": "JP", "china": "CN", "india": "IN", "brazil": "BR", "canada": "CA", "kenya": "KE", "egypt": "EG", "russia": "RU", "peru": "PE"}


@processor("CountryNormalizer")
def country(df, p):
    table = F.create_map(*[F.lit(x) for kv in {**COUNTRIES, **{v.lower(): v for v in COUNTRIES.values()}}.items() for x in kv])
    return put(df, out(p), F.element_at(table, F.lower(F.trim(col(p["column"])))))


@processor("UserAgentParser")
def user_agent(df, p):
    c, n = F.lower(col(p["column"])), p["column"]
    browser = F.when(c.contains("edg/"), "Edge").when(c.contains("opr/"), "Opera").when(c.contains("chrome/"), "Chrome").when(c.contains("firefox/"), "Firefox").when(c.contains("safari/"), "Safari")
    system = F.when(c.contains("android"), "Android").when(c.rlike("iphone|ipad"), "iOS").when(c.contains("windows"), "Windows").when(c.contains("mac os"), "macOS").when(c.contains("linux"), "Linux")
    kind = F.when(c.rlike("bot|crawl|spider"), "robot").when(c.rlike("mobile|iphone|android"), "mobile").otherwise("desktop")
    return df.withColumns({f"{n}_browser": browser, f"{n}_os": system, f"{n}_type": F.when(c.isNotNull(), kind)})


@processor("VisitorId")
def visitor(df, p):
    return put(df, p.get("outputColumn", "visitor_id"), F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in p["columns"]]), 256))


# --- numbers ---------------------------------------------------------------------------------------------


@processor("NumericalTransformer")
def numeric(df, p):
    f = modes.NUMERIC.get(str(p["mode"]).upper())
    if f is None:
        raise UnsupportedError(f"numeric mode {p['mode']}")
    extra = {"v": p["value"]} if p.get("value") is not None else {}
    extra |= {k: p[k] for k in ("lo", "hi") if k in p}
    return put(df, out(p), f(col(p["column"]), **extra))


@processor("Round", "RoundColumn")
def round_(df, p):
    c, n, mode = col(p["column"]), int(p.get("precision") or p.get("places") or 0), str(p.get("mode", "ROUND")).upper()
    scale = 10.0**n
    table = {"ROUND": lambda: F.round(c, n), "HALF_EVEN": lambda: F.bround(c, n), "FLOOR": lambda: F.floor(c * scale) / scale, "CEIL": lambda: F.ceil(c * scale) / scale, "SIGNIFICANT": lambda: modes.significant(c, n)}
    return put(df, out(p), table[mode]())


@processor("Binner")
def binner(df, p):
    return modes.bins(df, p["column"], str(p["mode"]).upper(), out(p, p["column"] + "_bin"), int(p.get("n") or (p["bins"] if isinstance(p.get("bins"), int) else 4)), p.get("bins") if isinstance(p.get("bins"), list) else None, p.get("labels"), p.get("closed", "left"))


@processor("MeasureNormalize")
def measure(df, p):
    mode = str(p["mode"]).upper()
    if mode in ("L1", "L2"):
        return modes.row_norm(df, p.get("columns") or [p["column"]], mode)
    return modes.normalise(df, p["column"], mode, out(p, p["column"] + "_normalised"))


@processor("NumberClipping", "ClipColumn")
def clip(df, p):
    c, lo, hi = col(p["column"]), p.get("min"), p.get("max")
    if p.get("clear"):
        inside = modes.all_of(([c >= lo] if lo is not None else []) + ([c <= hi] if hi is not None else []))
        return put(df, out(p), F.when(inside, c))
    return put(df, out(p), modes.clipped(c, lo, hi))


@processor("Mean")
def row_mean(df, p):
    cs = [col(c).cast("double") for c in p["columns"]]
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    return put(df, p["outputColumn"], F.coalesce(F.try_divide(total, n.cast("double")), F.lit(p.get("default")).cast("double")))


@processor("Negate")
def negate(df, p):
    return put(df, out(p), ~col(p["column"]).try_cast("boolean"))


@processor("NumericalCombinator")
def combine(df, p):
    made = {}
    cs = p["columns"]
    for i, a in enumerate(cs):
        for b in cs[i + 1 :]:
            made |= {f"{a}_plus_{b}": col(a) + col(b), f"{a}_minus_{b}": col(a) - col(b), f"{a}_times_{b}": col(a) * col(b), f"{a}_div_{b}": F.try_divide(col(a).cast("double"), col(b).cast("double"))}
    return df.withColumns(made)


@processor("NumericalFormatConverter")
def number_format(df, p):
    c = F.regexp_replace(col(p["column"]), r"[\s ]", "")
    c = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if p.get("from", "FR") in ("FR", "DE", "EU") else F.replace(c, F.lit(","), F.lit(""))
    return put(df, out(p), c.try_cast("double"))


@processor("CurrencySplitter")
def currency_split(df, p):
    c = col(p["column"])
    table = F.create_map(*[F.lit(x) for kv in {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "EUR": "EUR", "USD": "USD", "GBP": "GBP", "CHF": "CHF"}.items() for x in kv])
    return df.withColumns({f"{p['column']}_amount": F.replace(F.regexp_extract(c, r"(-?\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double"), f"{p['column']}_currency": F.element_at(table, F.regexp_extract(c, r"(€|\$|£|¥|EUR|USD|GBP|CHF)", 1))})


# --- types and dates ------------------------------------------------------------------------------------------

TYPES = {"bigint": "bigint", "int": "int", "integer": "int", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "text": "string"}


@processor("TypeSetter")
def type_setter(df, p):
    kind = TYPES.get(str(p["type"]).lower())
    if kind is None:
        raise UnsupportedError(f"type {p['type']}")
    return df.withColumns({c: col(c).try_cast(kind) for c in _scope(df, p)})


@processor("DateParser")
def date_parse(df, p):
    c = col(p["column"]).cast("string")
    formats = p.get("formats") or ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    if p.get("timezone"):
        parsed = F.convert_timezone(F.lit(p["timezone"]), F.lit("UTC"), parsed)
    return put(df, out(p), parsed)


@processor("DateFormatter")
def date_format(df, p):
    return put(df, out(p), F.date_format(col(p["column"]), p["format"]))


@processor("DateComponentExtractor")
def date_parts(df, p):
    return df.withColumns({f"{p['column']}_{x.lower()}": modes.DATE_PARTS[x.upper()](col(p["column"])) for x in p["components"]})


@processor("DateDifference")
def date_diff(df, p):
    unit = str(p.get("unit", "DAY")).upper().rstrip("S")
    a, b = col(p["column1"]), col(p["column2"])
    if p.get("excludeWeekends"):
        days = lambda c: F.datediff(c, F.lit("1970-01-05").cast("date"))
        work = lambda c: F.floor(days(c) / 7) * 5 + F.least(F.pmod(days(c), F.lit(7)), F.lit(5))
        return put(df, out(p, "difference"), (work(b) - work(a)).cast("bigint"))
    return put(df, out(p, "difference"), F.timestamp_diff(unit, a, b))


@processor("HolidaysComputer")
def holidays(df, p):
    c, n = F.to_date(col(p["column"])), p.get("outputColumn") or p["column"]
    fixed = {"FR": ["01-01", "05-01", "05-08", "07-14", "08-15", "11-01", "11-11", "12-25"], "US": ["01-01", "06-19", "07-04", "11-11", "12-25"], "DE": ["01-01", "05-01", "10-03", "12-25", "12-26"]}.get(str(p.get("country", "US")).upper(), ["01-01", "12-25"])
    return df.withColumns({f"{n}_is_weekend": F.weekday(c) >= 5, f"{n}_is_holiday": F.date_format(c, "MM-dd").isin(fixed)})


@processor("TimezoneConverter")
def timezone(df, p):
    return put(df, out(p), F.convert_timezone(F.lit(p["fromTimezone"]), F.lit(p["toTimezone"]), col(p["column"]).cast("timestamp_ntz")))


def _between(c: Column, lo, hi) -> Column:
    conds = ([c >= F.lit(lo).cast("timestamp_ntz")] if lo else []) + ([c <= F.lit(hi).cast("timestamp_ntz")] if hi else [])
    return modes.all_of(conds)


@processor("DateRangeClassifier")
def date_class(df, p):
    c = col(p["column"]).cast("timestamp_ntz")
    value = F.lit(None).cast("string")
    for r in reversed(p["ranges"]):
        value = F.when(_between(c, r.get("start"), r.get("end")), r["label"]).otherwise(value)
    return put(df, out(p, p["column"] + "_range"), value)


@processor("TimestampExtractor")
def to_unix(df, p):
    c = col(p["column"]).cast("timestamp")
    return put(df, out(p, p["column"] + "_unix"), F.unix_millis(c) if str(p.get("unit", "s")).lower().startswith("m") else F.unix_seconds(c))


@processor("UnixTimestampParser")
def from_unix(df, p):
    c = col(p["column"]).cast("bigint")
    return put(df, out(p, p["column"] + "_date"), (F.timestamp_millis(c) if str(p.get("unit", "s")).lower().startswith("m") else F.timestamp_seconds(c)).cast("timestamp_ntz"))


# --- filters and flags -----------------------------------------------------------------------------------------


def _values(df: DataFrame, p: dict) -> Column:
    mode = str(p.get("matchingMode") or p.get("matchMode") or "FULL_STRING").upper()
    vs = p.get("values") if p.get("values") is not None else p.get("filterValues") or ([p["value"]] if "value" in p else [])
    norm = str(p.get("normalizationMode", "EXACT")).upper()
    if norm != "EXACT":
        vs = [str(v).lower() for v in vs]
    tests = []
    for c in _scope(df, p):
        x = col(c) if norm == "EXACT" else F.lower(col(c)) if norm == "LOWERCASE" else modes.STRING["NORMALIZE"](col(c))
        tests.append(F.coalesce(modes.MATCH[mode](x, vs), F.lit(False)))
    return modes.all_of(tests) if str(p.get("booleanMode", "OR")).upper() == "AND" else modes.any_of(tests)


def _number_range(p: dict) -> Column:
    c = col(p["column"]).try_cast("double")
    tests = [c.isNotNull()]
    strict = p.get("strict", False)
    if p.get("min") is not None:
        tests.append(c > p["min"] if strict else c >= p["min"])
    if p.get("max") is not None:
        tests.append(c < p["max"] if strict else c <= p["max"])
    return modes.all_of(tests)


def _bad_type(p: dict) -> Column:
    kind = str(p["expectedType"]).lower()
    if kind in MEANINGS:
        return col(p["column"]).isNotNull() & ~MEANINGS[kind](col(p["column"]).cast("string"))
    return col(p["column"]).isNotNull() & col(p["column"]).cast("string").try_cast(TYPES[kind]).isNull()


MEANINGS: dict[str, Callable[[Column], Column]] = {
    "email": lambda c: c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "url": lambda c: c.rlike(r"^[a-z][a-z0-9+.-]*://\S+$"), "ip": lambda c: c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
    "integer": lambda c: c.try_cast("bigint").isNotNull(), "decimal": lambda c: c.try_cast("double").isNotNull(), "boolean": lambda c: c.try_cast("boolean").isNotNull(), "date": lambda c: c.try_cast("timestamp").isNotNull(), "json": lambda c: F.try_parse_json(c).isNotNull(), "country": lambda c: F.lower(c).isin(list(COUNTRIES)),
}

CONDITIONS: dict[str, Callable[[DataFrame, dict], Column]] = {
    "Value": _values, "MultipleValues": _values, "Formula": lambda df, p: truthy(compile_formula(p.get("formula") or p["expression"])), "CustomCondition": lambda df, p: truthy(compile_formula(p["expression"])),
    "NumericRange": lambda df, p: _number_range(p), "DateRange": lambda df, p: _between(col(p["column"]).cast("timestamp_ntz"), p.get("startDate"), p.get("endDate")), "BadType": lambda df, p: _bad_type(p), "NullNumeric": lambda df, p: col(p["column"]).cast("string").try_cast("double").isNull(),
    "Meaning": lambda df, p: col(p["column"]).isNotNull() & ~MEANINGS[str(p["meaning"]).lower()](col(p["column"]).cast("string")),
}
for _name, _cond in CONDITIONS.items():
    PROCESSORS[f"FilterOn{_name}"] = lambda df, p, f=_cond: _keep(df, f(df, p), p)
    PROCESSORS[f"FlagOn{_name}"] = lambda df, p, f=_cond: _flag(df, f(df, p), p)


@processor("FilterOnGeoZone")
def geo_zone(df, p):
    return _keep(df, joins.contains_udf(F.lit(p["zone"]), col(p["geoColumn"])), {**p, "column": p["geoColumn"]})


@processor("InvalidSplit")
def invalid_split(df, p):
    c, ok = col(p["column"]), MEANINGS[str(p["meaning"]).lower()](col(p["column"]).cast("string"))
    return df.withColumns({p.get("outputColumn") or p["column"] + "_invalid": F.when(~ok, c), p["column"]: F.when(ok, c)})


# --- rows ------------------------------------------------------------------------------------------------------


@processor("RemoveDuplicates")
def dedup(df, p):
    return relational.distinct(df, p.get("columns"), keep=p.get("keep", "first"), order=p.get("order"))


@processor("SortRows")
def sort(df, p):
    return df.orderBy(*relational.order_columns(p["columns"]))


@processor("SampleRows")
def sample(df, p):
    return relational.sample(df, p.get("method", "RANDOM_FIXED_NB"), n=int(p["sampleSize"]), key=p.get("key"), order=p.get("order"), column=p.get("column"))


@processor("ShuffleRows")
def shuffle(df, p):
    return df.orderBy(F.xxhash64(*[col(c) for c in p.get("key") or df.columns], F.lit(int(p.get("seed", 7)))))


@processor("GenerateBigData")
def big_data(df, p):
    return df.withColumn(p.get("outputColumn", "copy_no"), F.explode(F.sequence(F.lit(0), F.lit(int(p["factor"]) - 1))))


# --- computed columns -----------------------------------------------------------------------------------------------


@processor("CreateColumnWithGREL", "Formula")
def formula(df, p):
    return put(df, p.get("outputColumn") or p["column"], compile_formula(p["expression"]))


@processor("MultiColumnFormula")
def multi_formula(df, p):
    prefix = p.get("outputPrefix", "")
    return df.withColumns({prefix + c: compile_formula(p["expression"], col(c)) for c in _scope(df, p)})


@processor("UUIDGenerator")
def uuid(df, p):
    if p.get("columns"):
        h = F.sha1(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in p["columns"]]))
        return put(df, p["outputColumn"], F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)))
    return put(df, p["outputColumn"], F.uuid())


@processor("IfThenElse")
def if_then_else(df, p):
    rules = p.get("rules") or [{"condition": p["condition"], "value": p["thenValue"]}]
    value = F.lit(p.get("elseValue"))
    for r in reversed(rules):
        value = F.when(truthy(compile_formula(r["condition"])), F.lit(r["value"])).otherwise(value)
    return put(df, out(p), value)


@processor("SwitchCase")
def switch(df, p):
    c = col(p["column"]).cast("string")
    if str(p.get("normalizationMode", "EXACT")).upper() != "EXACT":
        c = F.lower(c)
    cases = p["cases"] if isinstance(p["cases"], dict) else {x["when"]: x["then"] for x in p["cases"]}
    value = F.lit(p.get("defaultValue"))
    for k, v in reversed(cases.items()):
        value = F.when(c == str(k), F.lit(v)).otherwise(value)
    return put(df, out(p), value)


@processor("TranslateValues", "MeaningTranslate")
def translate(df, p):
    table = p.get("translations") or p.get("mappings")
    table = table if isinstance(table, dict) else {x["from"]: x["to"] for x in table}
    c = col(p["column"])
    hit = F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), v)]), c.cast("string"))
    return put(df, out(p), F.when(c.isNotNull(), F.coalesce(hit, c.cast("string")) if p.get("unmatched") == "KEEP" else hit))


@processor("LongTailGrouper")
def long_tail(df, p):
    c, other = col(p["column"]), F.lit(p.get("replacement", "OTHER"))
    if p.get("keep"):
        return put(df, out(p), F.when(c.isin(p["keep"]), c).otherwise(other))
    counts = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= int(p.get("threshold", 10)))
    kept = df.join(counts, c == F.col("_v"), "left")
    return put(kept, out(p), F.when(c.isNull(), c).when(F.col("_n").isNotNull(), c).otherwise(other)).drop("_v", "_n")


@processor("CategoricalEncoder")
def encoder(df, p):
    return modes.encode(df, p["column"], str(p["encoding"]).upper(), p.get("outputColumn"), p.get("target"), p.get("order"), int(p.get("n", 32)))


# --- geography ---------------------------------------------------------------------------------------------------------


@processor("GeoPointCreator")
def geo_point(df, p):
    lat, lon = col(p["latColumn"]), col(p["lonColumn"])
    return put(df, out(p, "geopoint"), F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))))


@processor("GeoPointExtractor")
def geo_extract(df, p):
    lon, lat = joins.lon_lat(col(p["column"]))
    return df.withColumns({p.get("latColumn", "lat"): lat, p.get("lonColumn", "lon"): lon})


@processor("GeoDistanceCalculator")
def geo_distance(df, p):
    (lo1, la1), (lo2, la2) = joins.lon_lat(col(p["point1Column"])), joins.lon_lat(col(p["point2Column"]))
    return put(df, out(p, "distance"), joins.haversine(la1, lo1, la2, lo2, str(p.get("unit", "KILOMETER")).upper()))


@processor("GeoPolygonMatcher")
def geo_match(df, p):
    return put(df, out(p, "inside"), joins.contains_udf(col(p["polygonColumn"]), col(p["pointColumn"])))


@processor("GeoInfoExtractor")
def geo_info(df, p):
    lon, lat = joins.lon_lat(col(p["column"]))
    return df.withColumns({f"{p['column']}_type": F.upper(F.regexp_extract(col(p["column"]), r"^\s*([A-Za-z]+)", 1)), f"{p['column']}_lon": lon, f"{p['column']}_lat": lat})


@processor("GeoPointBuffer")
def geo_buffer(df, p):
    lon, lat = joins.lon_lat(col(p["column"]))
    d = float(p["distance"]) * joins.UNITS[str(p.get("unit", "KILOMETER")).upper()]
    dy = F.lit(d / 111_320.0)
    dx = dy / F.cos(F.radians(lat))
    corner = lambda sx, sy: F.concat((lon + sx * dx).cast("string"), F.lit(" "), (lat + sy * dy).cast("string"))
    ring = F.concat_ws(", ", corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return put(df, out(p, p["column"] + "_area"), F.when(lat.isNotNull(), F.concat(F.lit("POLYGON(("), ring, F.lit("))"))))


@processor("ChangeCRS")
def change_crs(df, p):
    lon, lat = joins.lon_lat(col(p["column"]))
    way = (str(p.get("from", "EPSG:4326")), str(p.get("to", "EPSG:3857")))
    r = 6378137.0
    if way == ("EPSG:4326", "EPSG:3857"):
        x, y = F.radians(lon) * r, F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r
    elif way == ("EPSG:3857", "EPSG:4326"):
        x, y = F.degrees(lon / r), F.degrees(F.atan(F.exp(lat / r)) * 2 - F.lit(1.5707963267948966))
    else:
        raise UnsupportedError(f"coordinates {way}")
    return put(df, out(p), F.when(lat.isNotNull(), F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))))


@processor("AddressParser")
def address(df, p):
    c, n = col(p["column"]), p["column"]
    return df.withColumns({f"{n}_number": F.nullif(F.regexp_extract(c, r"(\d+[a-z]?)", 1), F.lit("")), f"{n}_street": F.nullif(F.trim(F.regexp_extract(c, r"^\s*\d*[a-z]?,?\s*([^,\d]+)", 1)), F.lit("")), f"{n}_postcode": F.nullif(F.regexp_extract(c, r"\b(\d{5})\b", 1), F.lit("")), f"{n}_city": F.nullif(F.trim(F.regexp_extract(c, r",\s*(?:\d{5}\s+)?([^,]+)$", 1)), F.lit(""))})


def _unsupported(what: str) -> Step:
    def refuse(df, p):
        raise UnsupportedError(what)

    return refuse


PROCESSORS |= {"GeoEncoder": _unsupported("geocoding needs an outside service"), "GeoIPResolver": _unsupported("no address table is bundled"), "ReverseGeocoder": _unsupported("no gazetteer is bundled; use k_nearest with one"), "CurrencyConverter": _unsupported("join a table of rates instead")}


# --- arrays, JSON, shape ------------------------------------------------------------------------------------------------


def _array(df: DataFrame, name: str) -> Column:
    """An array column, or a JSON array in text."""
    return F.from_json(col(name), "array<string>") if dict(df.dtypes)[name] == "string" else col(name)


@processor("ExtractWithJSONPath")
def json_path(df, p):
    return put(df, out(p, p["column"] + "_value"), F.get_json_object(col(p["column"]), p["jsonPath"]))


@processor("JSONExtractor")
def json_keys(df, p):
    return df.withColumns({f"{p['column']}_{k}": F.get_json_object(col(p["column"]), f"$.{k}") for k in p["keys"]})


@processor("JSONFlattener")
def json_flatten(df, p):
    sep, depth = p.get("separator", "_"), int(p.get("depth", 2))
    schema = p.get("schema") or df.select(F.schema_of_json_agg(col(p["column"])) if hasattr(F, "schema_of_json_agg") else F.schema_of_variant_agg(F.try_parse_json(col(p["column"])))).first()[0].replace("OBJECT<", "STRUCT<")
    parsed = df.withColumn("_j", F.from_json(col(p["column"]), schema))
    made: list[Column] = []

    def walk(kind, path: str, name: str, level: int):
        for f in kind.fields:
            here, label = f"{path}.{quoted(f.name)}", f"{name}{sep}{f.name}"
            if f.dataType.typeName() == "struct" and level < depth:
                walk(f.dataType, here, label, level + 1)
            else:
                v = F.col(here)
                made.append((F.to_json(v) if f.dataType.typeName() in ("struct", "array", "map") else v).alias(label))

    walk(parsed.schema["_j"].dataType, "_j", p["column"], 1)
    return parsed.select(*[quoted(c) for c in df.columns], *made)


@processor("XMLExtractor")
def xml(df, p):
    return put(df, out(p, p["column"] + "_value"), F.xpath_string(col(p["column"]), F.lit(p["xpath"])))


@processor("ArraySplitter")
def array_split(df, p):
    n = int(p.get("n", 3))
    arr = _array(df, p["column"]) if not p.get("separator") else F.split(col(p["column"]), re.escape(p["separator"]))
    return df.withColumns({f"{p['column']}_{i}": F.get(arr, F.lit(i)) for i in range(n)})


@processor("ArrayJoiner")
def array_join(df, p):
    return put(df, out(p), F.array_join(_array(df, p["column"]).cast("array<string>"), p.get("separator", ",")))


@processor("ArraySorter")
def array_sort(df, p):
    return put(df, out(p), F.sort_array(_array(df, p["column"]), str(p.get("order", "ASC")).upper() == "ASC"))


@processor("ArrayUnfold", "Unfold")
def unfold(df, p):
    if p.get("dummify"):
        values = p.get("values") or modes.distinct_values(df.select(F.explode(_array(df, p["column"])).alias("v")) if p.get("array") else df.select(col(p["column"]).alias("v")), "v")
        arr = _array(df, p["column"]) if p.get("array") else F.array(col(p["column"]))
        return df.withColumns({f"{p['column']}_{modes.slug(v)}": F.nullif(F.size(F.filter(arr, _one_of([v]))), F.lit(0)) for v in values})
    return df.withColumn(out(p), F.explode_outer(_array(df, p["column"])))


@processor("ArrayFold")
def array_fold(df, p):
    return put(df, p["outputColumn"], F.array(*[col(c) for c in p["columns"]]))


@processor("ArrayElementExtractor")
def array_element(df, p):
    i = int(p["index"])
    return put(df, out(p, f"{p['column']}_{i}"), F.try_element_at(_array(df, p["column"]), F.lit(i + 1 if i >= 0 else i)))


@processor("ArraysConcat")
def arrays_concat(df, p):
    return put(df, p["outputColumn"], F.concat(*[_array(df, c) for c in p["columns"]]))


@processor("ZipArrays")
def zip_arrays(df, p):
    return put(df, p["outputColumn"], F.to_json(F.arrays_zip(*[_array(df, c).alias(c) for c in p["columns"]])))


@processor("ObjectNest")
def nest(df, p):
    return put(df, p["outputColumn"], F.to_json(F.struct(*[col(c).alias(c) for c in p["columns"]])))


@processor("FoldObject")
def fold_object(df, p):
    m = F.from_json(col(p["column"]), "map<string,string>")
    key, value = p.get("keyColumn", "key"), p.get("valueColumn", "value")
    return df.select(*[quoted(c) for c in df.columns if c not in (p["column"], key, value)], F.explode_outer(m).alias(key, value))


@processor("FoldMultipleColumns")
def fold_columns(df, p):
    return relational.fold(df, p["columns"], p.get("varColumnOutput") or p.get("varName") or "variable", p.get("valColumnOutput") or p.get("valueName") or "value")


@processor("FoldColumnsByPattern")
def fold_pattern(df, p):
    hit = {c: (m[1] if m.groups() else c) for c in df.columns if (m := re.fullmatch(p["pattern"], c))}
    folded = relational.fold(df.withColumnsRenamed(hit), list(hit.values()), p.get("varName", "variable"), p.get("valueName", "value"), keep_nulls=False)
    return folded


@processor("SplitFold")
def split_fold(df, p):
    return df.withColumn(out(p), F.explode_outer(F.split(col(p["column"]), re.escape(p["separator"]))))


@processor("SplitUnfold")
def split_unfold(df, p):
    parts = F.split(col(p["column"]), re.escape(p["separator"]))
    values = p.get("values") or modes.distinct_values(df.select(F.explode(parts).alias("v")), "v")
    made = df.withColumns({f"{p.get('prefix', p['column'])}_{modes.slug(v)}": F.when(F.array_contains(parts, v), 1) for v in values})
    return made.drop(p["column"])


@processor("TransposeRowsToColumns")
def transpose(df, p):
    most = int(df.sparkSession.conf.get("spark.sql.transposeMaxValues"))
    if df.limit(most + 1).count() > most:
        raise UnsupportedError(f"transpose of more than {most} rows")
    return df.transpose(F.col(quoted(p["column"])) if p.get("column") else None)


@processor("Pivot")
def pivot(df, p):
    return relational.pivot(df, p["index"], p["column"], [{"column": p["value"], "type": p.get("type", "FIRST"), "outputColumn": p["value"]}], p.get("modalities"))


@processor("TriggeredUnfold")
def triggered_unfold(df, p):
    w = Window.partitionBy(*[col(c) for c in p["partition"]]).orderBy(*relational.order_columns(p["order"]))
    run = F.sum((col(p["column"]) == p["trigger"]).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.withColumn("session_no", run).where("session_no > 0")
    values = p.get("values") or modes.distinct_values(df, p["column"])
    t = F.col(quoted(p["value"]))
    return numbered.groupBy(*[quoted(c) for c in p["partition"]], "session_no").agg(*[F.min(F.when(col(p["column"]) == v, t)).alias(f"{modes.slug(v)}_first") for v in values])


@processor("MemoryJoin")
def memory_join(df, p):
    """Join with another table, given as ``with``; null keys match nothing."""
    return joins.join(df, p["with"], p["keys"], p.get("joinType", "LEFT"))


@processor("MemoryFuzzyJoin")
def memory_fuzzy_join(df, p):
    return joins.fuzzy(df, p["with"], p["leftColumn"], p["rightColumn"], float(p.get("threshold", 2)), p.get("metric", "DAMERAU_LEVENSHTEIN"), p.get("relative", False), normalise=p.get("textNormalization"), how=p.get("joinType", "LEFT"))


@processor("MemoryGeoJoin")
def memory_geo_join(df, p):
    return joins.geo_join(df, p["with"], p["leftColumn"], p["rightColumn"], p.get("operator", "INTERSECTS"))


@processor("NestedProcessor")
def nested(df, p):
    inner = p["processor"]
    return apply_steps(df, [inner if isinstance(inner, dict) else {"type": inner, "params": p.get("params", {})}])


@processor("ProcessorGroup")
def group(df, p):
    return apply_steps(df, p["steps"])


@processor("EnrichWithBuildContext")
def build_context(df, p):
    return df.withColumns({"build_time": F.current_timestamp(), "build_id": F.lit(p.get("build_id", ""))})


@processor("EnrichWithRecordContext")
def record_context(df, p):
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


#: Registered Python functions for PythonUDF steps: name -> (function over pandas Series, type).
PYTHON: dict[str, tuple[Callable, str]] = {}


def register_python(name: str, f: Callable, returns: str) -> None:
    """Make ``f`` (Series in, Series out) usable by PythonUDF steps. Text is never executed."""
    PYTHON[name] = (f, returns)


@processor("PythonUDF")
def python_udf(df, p):
    name = p.get("function") or p["code"]
    if name not in PYTHON:
        raise UnsupportedError(f"no registered function {name!r}")
    f, kind = PYTHON[name]
    return put(df, p["outputColumn"], F.pandas_udf(f, kind)(*[col(c) for c in p["inputColumns"]]))


def catalogue() -> list[str]:
    """Names of all processors."""
    return sorted(PROCESSORS)


def parse_params(p: str | dict) -> dict:
    """Parameters given as an object or as JSON text."""
    return json.loads(p) if isinstance(p, str) else p
