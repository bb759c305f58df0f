"""Vocabularies of modes: text, number, match, date part, binning, normalising and encoding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.errors import UnsupportedError
from sparkloom.functions.formula import blank, quoted
from sparkloom.session import written


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Text without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Text without marks and without what is not ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def _guarded_pad(c: Column, n: int, p: str, left: bool) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, p) if left else F.rpad(c, n, p)).otherwise(c)


def _center(c: Column, n: int, p: str) -> Column:
    half = F.length(c) + F.floor((F.lit(n) - F.length(c)) / 2).cast("int")
    return F.when(F.length(c) < n, F.rpad(F.call_function("lpad", c, half, F.lit(p)), n, p)).otherwise(c)


STRING: dict[str, Callable[..., Column]] = {
    "TO_UPPER": lambda c, **k: F.upper(c), "TO_LOWER": lambda c, **k: F.lower(c),
    "TITLECASE": lambda c, **k: F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([^\p{L}]*\p{L}+[^\p{L}]*)"), F.lit(1)), lambda w: F.concat(F.regexp_extract(w, r"^([^\p{L}]*)", 1), F.upper(F.substring(F.regexp_replace(w, r"^[^\p{L}]*", ""), 1, 1)), F.substr(F.regexp_replace(w, r"^[^\p{L}]*", ""), F.lit(2)))), ""),
    "CAPITALIZE": lambda c, **k: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2)))),
    "SWAPCASE": lambda c, **k: F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""),
    "TRIM": lambda c, **k: F.regexp_replace(c, r"^\s+|\s+$", ""), "TRIM_LEFT": lambda c, **k: F.regexp_replace(c, r"^\s+", ""), "TRIM_RIGHT": lambda c, **k: F.regexp_replace(c, r"\s+$", ""),
    "NORMALIZE_WHITESPACE": lambda c, **k: F.trim(F.regexp_replace(c, r"\s+", " ")), "REMOVE_WHITESPACE": lambda c, **k: F.regexp_replace(c, r"\s+", ""), "COLLAPSE_WHITESPACE": lambda c, **k: F.regexp_replace(c, r"\s+", " "),
    "REMOVE_ACCENTS": lambda c, **k: strip_accents(c), "ASCII_TRANSLITERATE": lambda c, **k: to_ascii(c),
    "REMOVE_NON_ALPHANUMERIC": lambda c, **k: F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), "REMOVE_NON_PRINTABLE": lambda c, **k: F.regexp_replace(c, r"\p{C}", ""), "REMOVE_PUNCTUATION": lambda c, **k: F.regexp_replace(c, r"\p{Punct}", ""),
    "REMOVE_DIGITS": lambda c, **k: F.regexp_replace(c, r"\d", ""), "KEEP_ONLY_DIGITS": lambda c, **k: F.regexp_replace(c, r"\D", ""), "KEEP_ONLY_ALPHA": lambda c, **k: F.regexp_replace(c, r"[^\p{L}]", ""),
    "PAD_LEFT": lambda c, length=10, pad=" ", **k: _guarded_pad(c, length, pad, True), "PAD_RIGHT": lambda c, length=10, pad=" ", **k: _guarded_pad(c, length, pad, False), "PAD_CENTER": lambda c, length=10, pad=" ", **k: _center(c, length, pad),
    "REVERSE": lambda c, **k: F.reverse(c), "QUOTE": lambda c, **k: F.concat(F.lit('"'), c, F.lit('"')), "UNQUOTE": lambda c, **k: F.regexp_replace(c, r'^"|"$', ""),
    "URL_ENCODE": lambda c, **k: F.url_encode(c), "URL_DECODE": lambda c, **k: F.try_url_decode(c), "TRUNCATE": lambda c, length=10, **k: F.substring(c, 1, length),
    "XML_ESCAPE": lambda c, **k: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "XML_UNESCAPE": lambda c, **k: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")),
}
STRING |= {"UPPERCASE": STRING["TO_UPPER"], "LOWERCASE": STRING["TO_LOWER"], "NORMALIZE": lambda c, **k: F.lower(strip_accents(F.trim(c)))}


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    k = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * k) / k)


NUMERIC: dict[str, Callable[..., Column]] = {
    "MULTIPLY": lambda c, v=1, **k: c * v, "DIVIDE": lambda c, v=1, **k: F.try_divide(c.cast("double"), F.lit(float(v))), "ADD": lambda c, v=0, **k: c + v, "SUBTRACT": lambda c, v=0, **k: c - v, "POWER": lambda c, v=2, **k: F.pow(c, F.lit(v)),
    "SQRT": lambda c, **k: F.when(c >= 0, F.sqrt(c)), "LOG": lambda c, **k: F.ln(c), "NATURAL_LOG": lambda c, **k: F.ln(c), "LOG10": lambda c, **k: F.log10(c), "LOG2": lambda c, **k: F.log2(c), "LOG1P": lambda c, **k: F.log1p(c), "EXP": lambda c, **k: F.exp(c), "EXPM1": lambda c, **k: F.expm1(c), "CBRT": lambda c, **k: F.cbrt(c), "SQUARE": lambda c, **k: c * c,
    "ABS": lambda c, **k: F.abs(c), "NEGATE": lambda c, **k: -c, "INVERSE": lambda c, **k: F.try_divide(F.lit(1.0), c.cast("double")), "MODULO": lambda c, v=1, **k: F.pmod(c, F.lit(v)),
    "ROUND": lambda c, v=0, **k: F.round(c, int(v)), "FLOOR": lambda c, **k: F.floor(c), "CEIL": lambda c, **k: F.ceil(c), "TRUNCATE": lambda c, **k: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), "TRUNC": lambda c, **k: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), "ROUND_TO_SIGNIFICANT": lambda c, v=3, **k: significant(c, int(v)),
    "SIN": lambda c, **k: F.sin(c), "COS": lambda c, **k: F.cos(c), "TAN": lambda c, **k: F.tan(c), "ASIN": lambda c, **k: F.when(F.abs(c) <= 1, F.asin(c)), "ACOS": lambda c, **k: F.when(F.abs(c) <= 1, F.acos(c)), "ATAN": lambda c, **k: F.atan(c),
    "DEGREES_TO_RADIANS": lambda c, **k: F.radians(c), "RADIANS_TO_DEGREES": lambda c, **k: F.degrees(c), "CLIP": lambda c, lo=None, hi=None, **k: clipped(c, lo, hi),
}


def clipped(c: Column, lo=None, hi=None) -> Column:
    """Kept within bounds; null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


MATCH: dict[str, Callable[[Column, list], Column]] = {
    "EQUALS": lambda c, v: c.cast("string").isin([str(x) for x in v]), "FULL_STRING": lambda c, v: c.cast("string").isin([str(x) for x in v]), "NOT_EQUALS": lambda c, v: ~F.coalesce(c.cast("string").isin([str(x) for x in v]), F.lit(False)),
    "CONTAINS": lambda c, v: any_of([c.cast("string").contains(str(x)) for x in v]), "SUBSTRING": lambda c, v: any_of([c.cast("string").contains(str(x)) for x in v]), "NOT_CONTAINS": lambda c, v: ~F.coalesce(any_of([c.cast("string").contains(str(x)) for x in v]), F.lit(False)),
    "STARTS_WITH": lambda c, v: any_of([c.cast("string").startswith(str(x)) for x in v]), "ENDS_WITH": lambda c, v: any_of([c.cast("string").endswith(str(x)) for x in v]),
    "REGEX": lambda c, v: any_of([c.cast("string").rlike(str(x)) for x in v]), "PATTERN": lambda c, v: any_of([c.cast("string").rlike(str(x)) for x in v]), "NOT_REGEX": lambda c, v: ~F.coalesce(any_of([c.cast("string").rlike(str(x)) for x in v]), F.lit(False)),
    "IS_EMPTY": lambda c, v: blank(c), "IS_NOT_EMPTY": lambda c, v: ~blank(c), "IS_NULL": lambda c, v: c.isNull(), "IS_NOT_NULL": lambda c, v: c.isNotNull(),
    "IN_LIST": lambda c, v: c.cast("string").isin([str(x) for x in v]), "NOT_IN_LIST": lambda c, v: ~F.coalesce(c.cast("string").isin([str(x) for x in v]), F.lit(False)),
}


def any_of(cs: list[Column]) -> Column:
    """Whether one of the conditions holds."""
    out = F.lit(False)
    for c in cs:
        out = out | c
    return out


def all_of(cs: list[Column]) -> Column:
    """Whether all conditions hold."""
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "DAY_OF_WEEK": lambda c: F.weekday(c) + 1, "DAY_OF_YEAR": F.dayofyear, "WEEK_OF_YEAR": F.weekofyear, "QUARTER": F.quarter, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": lambda c: F.second(c).cast("int"),
    "MILLISECOND": lambda c: F.date_format(c, "SSS").cast("int"), "TIMESTAMP": lambda c: F.unix_millis(c.cast("timestamp")), "ISO_WEEK": F.weekofyear, "ISO_YEAR": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
}


def attach(df: DataFrame, stats: list[Column]) -> DataFrame:
    """``df`` with one-row aggregates of itself attached as columns, without a global window.

    The single row of aggregates is read back on the driver and put in as literals.
    """
    row = df.agg(*stats).first()
    return df.withColumns({k: F.lit(v) for k, v in row.asDict().items()})


def bins(df: DataFrame, column: str, mode: str, out: str, n: int = 4, edges: list[float] | None = None, labels: list[str] | None = None, closed: str = "left") -> DataFrame:
    """Add the zero-based bin (or its label) of a number; outside all bins is null."""
    c = F.col(quoted(column))
    if mode == "EQUAL_FREQUENCY":
        return _equal_frequency(df, column, out, n, labels)
    if mode == "KMEANS":
        edges = _centre_edges(df.select(c.cast("double").alias("v")).where("v is not null"), n)
        code = F.lit(None).cast("int")
        for i in range(len(edges) - 1, -1, -1):
            code = F.when(c <= edges[i], i).otherwise(code)
        code = F.when(c.isNotNull(), F.coalesce(code, F.lit(len(edges))))
    else:
        if mode == "EQUAL_WIDTH":
            lo, hi = df.agg(F.min(c), F.max(c)).first()
            edges = [lo + (hi - lo) * i / n for i in range(n + 1)] if lo is not None else []
        elif mode == "QUANTILE":
            edges = list(df.agg(F.percentile(c, F.array(*[F.lit(i / n) for i in range(n + 1)]))).first()[0] or [])
        elif mode != "CUSTOM_BOUNDARIES":
            raise UnsupportedError(f"binning mode {mode}")
        code = F.lit(None).cast("int")
        last = len(edges or []) - 2
        for i in range(last, -1, -1):
            a, b = edges[i], edges[i + 1]
            inside = (c > a) & (c <= b) | ((c == a) & F.lit(i == 0)) if closed == "right" else (c >= a) & (c < b) | ((c == b) & F.lit(i == last))
            code = F.when(inside, i).otherwise(code)
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in labels]), code.cast("int")) if labels else code.cast("int"))


def _centre_edges(values: DataFrame, n: int) -> list[float]:
    """Borders halfway between the centres of ``n`` clusters of a number, from quantiles as the first
    centres and until none moves."""
    first = values.agg(F.percentile("v", F.array(*[F.lit((i + 0.5) / n) for i in range(n)]))).first()[0]
    centres = sorted(set(first or []))
    for _ in range(100):
        edges = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
        code = F.lit(len(edges))
        for i in range(len(edges) - 1, -1, -1):
            code = F.when(F.col("v") <= edges[i], i).otherwise(code)
        moved = sorted(r["m"] for r in values.groupBy(code.alias("k")).agg(F.avg("v").alias("m")).collect())
        if moved == centres:
            break
        centres = moved
    return [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]


def _equal_frequency(df: DataFrame, column: str, out: str, n: int, labels: list[str] | None) -> DataFrame:
    """Bins of as many rows each as ``ntile`` gives, equal values in any order, without sorting all
    rows in one task: the place of a value is its count before, and its rows are dealt in turn."""
    c = F.col(quoted(column))
    counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    parted = counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id())
    parted = written(parted, "bin-counts")
    sums = parted.groupBy("_p").agg(F.sum("_m").alias("_s"))
    base = sums.withColumn("_base", F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).drop("_s")  # one row per partition
    total = int(sums.agg(F.sum("_s")).first()[0] or 0)
    before = F.sum("_m").over(Window.partitionBy("_p").orderBy("_v")) - F.col("_m") + F.col("_base")
    placed = parted.join(F.broadcast(base), "_p").select("_v", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(c, F.col("_salt")).orderBy(F.lit(1)))
    # equal values: rows are numbered within parts of a value, the parts one after the other
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    salted = written(salted.withColumn("_nth", nth), "bin-rows")
    parts = salted.where(c.isNotNull()).groupBy(c.alias("_pv"), F.col("_salt").alias("_ps")).agg(F.max("_nth").alias("_c"))
    parts = parts.withColumn("_start", F.sum("_c").over(Window.partitionBy("_pv").orderBy("_ps")) - F.col("_c")).drop("_c")
    joined = salted.join(parts, (c == F.col("_pv")) & (F.col("_salt") == F.col("_ps")), "left").join(placed, c == F.col("_v"), "left")
    at = F.col("_before") + F.col("_start") + F.col("_nth") - 1
    small, big = total // n, total % n  # the first ``big`` bins have one row more
    code = F.when(at < big * (small + 1), F.floor(at / (small + 1))).otherwise(big + F.floor((at - big * (small + 1)) / max(small, 1)))
    code = F.when(c.isNotNull(), code.cast("int"))
    return joined.withColumn(out, F.get(F.array(*[F.lit(x) for x in labels]), code) if labels else code).drop("_salt", "_nth", "_pv", "_ps", "_start", "_v", "_before")


def normalise(df: DataFrame, column: str, mode: str, out: str) -> DataFrame:
    """Scale a number by statistics of its column."""
    c = F.col(quoted(column)).cast("double")
    if mode == "MIN_MAX":
        lo, hi = df.agg(F.min(c), F.max(c)).first()
        value = F.try_divide(c - F.lit(lo), F.lit(hi) - F.lit(lo))
    elif mode in ("Z_SCORE", "ZSCORE"):
        m, s = df.agg(F.avg(c), F.stddev_pop(c)).first()
        value = F.try_divide(c - F.lit(m), F.lit(s))
    elif mode == "ROBUST":
        q = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or [None] * 3
        value = F.try_divide(c - F.lit(q[1]), F.lit(q[2]) - F.lit(q[0]))
    elif mode == "MAX_ABS":
        value = F.try_divide(c, F.lit(df.agg(F.max(F.abs(c))).first()[0]))
    else:
        raise UnsupportedError(f"normalisation mode {mode}")
    return df.withColumn(out, value)


def row_norm(df: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """L1 or L2 normalisation of each row over ``columns``."""
    cs = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)) for c in columns]
    size = sum((F.abs(c) for c in cs[1:]), F.abs(cs[0])) if mode == "L1" else F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))
    return df.withColumns({f"{c}_{mode.lower()}": F.try_divide(F.col(quoted(c)).cast("double"), size) for c in columns})


#: Distinct values a data-dependent set of columns may have.
MAX_VALUES = 1000


def distinct_values(df: DataFrame, column: str, limit: int = MAX_VALUES) -> list[Any]:
    """Sorted distinct non-null values, at most ``limit``; more raise an error."""
    rows = df.select(F.col(quoted(column)).alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise UnsupportedError(f"{column} has more than {limit} values")
    return sorted(r["v"] for r in rows)


def slug(value: Any) -> str:
    """A value as part of a column name."""
    return re.sub(r"\W+", "_", str(value)).strip("_") or "empty"


def encode(df: DataFrame, column: str, kind: str, out: str | None = None, target: str | None = None, order: list | None = None, n: int = 32) -> DataFrame:
    """Encode categories as numbers; statistics are joined back by value, null-safe."""
    out = out or f"{column}_{kind.lower()}"
    c = F.col(quoted(column))
    if kind == "ONE_HOT":
        return df.withColumns({f"{column}_{slug(v)}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in distinct_values(df, column)})
    if kind == "HASH":
        return df.withColumn(out, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    if kind in ("LABEL", "ORDINAL", "BINARY"):
        values = order or distinct_values(df, column, 100_000)
        if len(values) <= MAX_VALUES:
            code = F.element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]), c) if values else F.lit(None).cast("int")
            coded = df.withColumn(out, F.when(c.isNotNull(), code))
        else:
            spark = df.sparkSession
            lookup = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"_v {dict(df.dtypes)[column]}, `{out}` int")
            coded = df.join(F.broadcast(lookup), c == F.col("_v"), "left").drop("_v")
        if kind != "BINARY":
            return coded
        bits = max(1, (len(values) - 1).bit_length())
        return coded.withColumns({f"{out}_{b}": F.shiftright(F.col(out), b).bitwiseAND(F.lit(1)) for b in range(bits)}).drop(out)
    if kind not in STATISTICS:
        raise UnsupportedError(f"encoding {kind}")
    return encode_many(df, column, target, [(kind, out)])


#: Encodings that need only the number and the target's total of each value.
STATISTICS = ("COUNT", "FREQUENCY", "TARGET", "LEAVE_ONE_OUT", "WOE")


def encode_many(df: DataFrame, column: str, target: str | None, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """Several ``(encoding, output)`` of one column by one aggregate of its values, joined once, null-safe.

    Values without a partner that the encoding needs get null: one that stands alone has no
    LEAVE_ONE_OUT, one that is all of one class no WOE.
    """
    c = F.col(quoted(column))
    y = F.col(quoted(target)).cast("double") if target else F.lit(None).cast("double")
    stats = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"), F.count(y).alias("_m"))
    n, s, m = (F.lit(None) if x is None else F.lit(x) for x in stats.agg(F.sum("_n"), F.sum("_s"), F.sum("_m")).first()) if {k for k, _ in wanted} & {"FREQUENCY", "WOE"} else (F.lit(None),) * 3
    values = {
        "COUNT": lambda: F.col("_n"), "FREQUENCY": lambda: F.col("_n") / n, "TARGET": lambda: F.try_divide(F.col("_s"), F.col("_m")), "LEAVE_ONE_OUT": lambda: F.try_divide(F.col("_s") - y, F.col("_m") - 1),
        "WOE": lambda: F.ln(F.try_divide(F.try_divide(F.col("_s"), s), F.try_divide(F.col("_m") - F.col("_s"), m - s))),
    }
    joined = df.join(stats, c.eqNullSafe(F.col("_v")), "left")
    return joined.withColumns({out or f"{column}_{kind.lower()}": values[kind]() for kind, out in wanted}).drop("_v", "_n", "_s", "_m")
