"""Joins: equi, theta, anti, as-of, range, nearest, fuzzy and geographic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from sparkloom.errors import UnsupportedError, ValidationError
from sparkloom.functions.formula import quoted

HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "OUTER": "full", "FULL": "full", "LEFT_ANTI": "left_anti", "LEFT_SEMI": "left_semi", "ADVANCED": "inner"}
UNITS = {"METER": 1.0, "KILOMETER": 1000.0, "FOOT": 0.3048, "YARD": 0.9144, "MILE": 1609.344, "NAUTICAL_MILE": 1852.0}
EARTH = 6371008.8


def condition(left: Column, right: Column, kind: str = "EQ", distance: float | None = None, null_safe: bool = False) -> Column:
    """One join condition."""
    table = {
        "EQ": lambda: left.eqNullSafe(right) if null_safe else left == right, "LTE": lambda: left <= right, "LT": lambda: left < right, "GTE": lambda: left >= right, "GT": lambda: left > right,
        "NE": lambda: left != right, "WITHIN_RANGE": lambda: F.abs(left - right) <= F.lit(distance), "CONTAINS": lambda: left.contains(right), "STARTS_WITH": lambda: left.startswith(right),
    }
    if kind not in table:
        raise UnsupportedError(f"join condition {kind}")
    return table[kind]()


def suffixed(left: DataFrame, right: DataFrame, shared_keys: set[str], suffixes: tuple[str, str] = ("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """Both sides with clashing columns other than the shared keys renamed apart."""
    clash = (set(left.columns) & set(right.columns)) - shared_keys
    ren = lambda df, s: df.withColumnsRenamed({c: c + s for c in clash if s})
    return ren(left, suffixes[0]), ren(right, suffixes[1])


def join(left: DataFrame, right: DataFrame, keys: list[dict], how: str = "INNER", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """Join on ``keys``: ``{left, right, matchType, distance?}``.

    Equal keys of one name come out once; other columns of one name get suffixes. Null keys match
    nothing unless ``null_safe``. A range condition gets an equi key of bands, so that it is no
    nested loop.
    """
    how = how.upper()
    if how == "CROSS":
        a, b = suffixed(left, right, set(), suffixes)
        return a.crossJoin(b)
    if how == "RIGHT_ANTI":
        return join(right, left, [{**k, "left": k["right"], "right": k["left"]} for k in keys], "LEFT_ANTI", suffixes, null_safe)
    if how not in HOW:
        raise UnsupportedError(f"join type {how}")
    if not keys:
        raise ValidationError("a join needs keys")
    nearest = [k for k in keys if k.get("matchType", "EQ") in ("K_NEAREST", "K_NEAREST_INFERIOR")]
    if nearest:
        return _nearest(left, right, nearest, [k for k in keys if k not in nearest], how, suffixes)
    same = {k["left"] for k in keys if k["left"] == k["right"] and k.get("matchType", "EQ") == "EQ"}
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in right.columns})
    cond: Column | None = None
    for k in keys:
        kind, d = k.get("matchType", "EQ"), k.get("distance")
        one = condition(left[quoted(k["left"])], r[quoted("_r_" + k["right"])], kind, d, null_safe)
        cond = one if cond is None else cond & one
    if how in ("LEFT_ANTI", "LEFT_SEMI"):
        return left.join(r, cond, HOW[how])
    ranges = [k for k in keys if k.get("matchType") == "WITHIN_RANGE" and k.get("distance")]
    if how == "INNER" and ranges:
        k = ranges[0]
        width = float(k["distance"])
        band = F.floor(left[quoted(k["left"])] / width).cast("bigint")
        near = F.floor(r[quoted("_r_" + k["right"])] / width).cast("bigint")
        l2 = left.withColumn("_band", band)
        r2 = r.withColumn("_near", F.explode(F.array(near - 1, near, near + 1)))
        cond = None
        for k in keys:
            one = condition(l2[quoted(k["left"])], r2[quoted("_r_" + k["right"])], k.get("matchType", "EQ"), k.get("distance"), null_safe)
            cond = one if cond is None else cond & one
        joined = l2.join(r2, (l2["_band"] == r2["_near"]) & cond, "inner").drop("_band", "_near")
    else:
        joined = left.join(r, cond, HOW[how])
    clash = (set(left.columns) & set(right.columns)) - same
    out = []
    for c in left.columns:
        v = F.col(quoted(c))
        if c in same and HOW[how] in ("right", "full"):
            v = F.coalesce(v, F.col(quoted("_r_" + c)))
        out.append(v.alias(c + suffixes[0] if c in clash else c))
    for c in right.columns:
        if c not in same:
            out.append(F.col(quoted("_r_" + c)).alias(c + suffixes[1] if c in clash else c))
    return joined.select(*out)


def _nearest(left: DataFrame, right: DataFrame, nearest: list[dict], equal: list[dict], how: str, suffixes: tuple[str, str]) -> DataFrame:
    """A join whose one nearest key is looked for among the rows that the equi keys match."""
    if len(nearest) > 1 or any(k.get("matchType", "EQ") != "EQ" for k in equal) or how not in ("INNER", "LEFT"):
        raise UnsupportedError("a nearest key goes with equi keys in an inner or left join")
    key = nearest[0]
    names = [f"_l{i}" for i in range(len(left.columns))]
    l = left.toDF(*names).withColumn("_id", F.monotonically_increasing_id())
    at = dict(zip(left.columns, names, strict=True))
    found = k_nearest(l, right, "_id", at[key["left"]], key["right"], [(at[k["left"]], k["right"]) for k in equal], int(key.get("k", 1)), key["matchType"] == "K_NEAREST_INFERIOR", key.get("tie"), keep=names, outer=how == "LEFT")
    clash = set(left.columns) & set(right.columns)
    mine = [F.col(n).alias(c + suffixes[0] if c in clash else c) for c, n in at.items()]
    return found.select(*mine, *[F.col(quoted(c + "_right")).alias(c + suffixes[1] if c in clash else c) for c in right.columns])


def unmatched(left: DataFrame, right: DataFrame, keys: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Rows of either side without a partner."""
    return join(left, right, keys, "LEFT_ANTI"), join(left, right, keys, "RIGHT_ANTI")


#: Rows of an as-of join in one band of time; more rows are spread over more bands.
BAND_ROWS = 2_000_000


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, direction: str = "backward", tie: str | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """Each left row with the nearest right row in time; equal times match.

    Both sides are tagged and put in one sequence per ``by``; the last (or next) right row is carried
    along. No pairs are built. Where there are more than ``band_rows`` rows in all, time is cut into
    bands of equal length and each group into its bands, so that a group that holds most rows is no
    single task; the last right row of the bands before is carried into a band. Right columns come
    out with ``_right``; ``tie`` orders right rows of one time, the greatest counts. Left rows without
    time or partner have nulls.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise UnsupportedError(f"direction {direction}")
    by = by or []
    kind = dict(left.dtypes)[left_on]
    r_kind = dict(right.dtypes)
    struct = lambda df: "struct<" + ",".join(f"{quoted(c)}:{t}" for c, t in df.dtypes) + ">"
    keys = [f"_by{i}" for i in range(len(by))]
    side = lambda df, on: [*[F.col(quoted(c)).alias(k) for c, k in zip(by, keys, strict=True)], F.col(quoted(on)).alias("_t")]
    l = left.select(*side(left, left_on), F.lit(1).alias("_tag"), F.lit(None).cast(r_kind[tie] if tie else "int").alias("_tie"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("_l"), F.lit(None).cast(struct(right)).alias("_r"))
    r = right.select(*side(right, right_on), F.lit(0).alias("_tag"), (F.col(quoted(tie)) if tie else F.lit(None).cast("int")).alias("_tie"), F.lit(None).cast(struct(left)).alias("_l"), F.struct(*[F.col(quoted(c)) for c in right.columns]).alias("_r")).where("_t is not null")
    both = l.unionByName(r)
    number = _number(F.col("_t"), kind)
    lo, hi, n = both.agg(F.min(number), F.max(number), F.count(F.lit(1))).first()
    bands = max(1, -(-n // band_rows))
    width = ((hi - lo) / bands if lo is not None else 0) or 1.0
    both = both.withColumn("_band", F.least(F.floor((number - F.lit(lo or 0.0)) / width), F.lit(bands - 1)) if bands > 1 else F.lit(0).cast("bigint"))
    part = Window.partitionBy(*keys, "_band")
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    back = rows(part.orderBy(F.col("_t").asc_nulls_first(), "_tag", "_tie"))
    fore = rows(part.orderBy(F.col("_t").desc_nulls_first(), "_tag", "_tie"))
    out = both
    if direction != "forward":
        out = out.withColumn("_b", F.last("_r", ignorenulls=True).over(back))
    if direction != "backward":
        out = out.withColumn("_f", F.last("_r", ignorenulls=True).over(fore))
    if bands > 1:
        # at most one row per group and band is carried
        mine = both.where("_tag = 0").groupBy(*keys, "_band").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_last"), F.max_by("_r", F.struct(-number, F.col("_tie"))).alias("_first"))
        spans = both.select(*keys, "_band").distinct().join(mine.withColumnsRenamed({c: f"m{c}" for c in (*keys, "_band")}), _same([*keys, "_band"]), "left").drop(*[f"m{c}" for c in (*keys, "_band")])
        over = Window.partitionBy(*keys)
        spans = spans.select(*keys, "_band", F.last("_last", ignorenulls=True).over(over.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_first", ignorenulls=True).over(over.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
        out = out.join(spans.withColumnsRenamed({c: f"m{c}" for c in (*keys, "_band")}), _same([*keys, "_band"]), "left")
        for c, carried in (("_b", "_before"), ("_f", "_after")):
            if c in out.columns:
                out = out.withColumn(c, F.coalesce(c, carried))
    found = out.where("_tag = 1")
    gap = lambda c: F.abs(number - _number(F.col(c)[right_on], kind))
    match = {"backward": lambda: F.col("_b"), "forward": lambda: F.col("_f"), "nearest": lambda: F.when(F.col("_f").isNull() | (gap("_b") <= gap("_f")), F.col("_b")).otherwise(F.coalesce("_f", "_b"))}[direction]()
    found = found.withColumn("_m", F.when(F.col("_t").isNotNull(), match))
    return found.select(*[F.col(f"_l.{quoted(c)}").alias(c) for c in left.columns], *[F.col(f"_m.{quoted(c)}").alias(c + "_right") for c in right.columns if c not in by])


def _same(columns: list[str]) -> Column:
    """Null-safe equality of columns with those of the other side, which have an ``m`` before."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"m{c}"))
    return cond


def _number(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def k_nearest(left: DataFrame, right: DataFrame, left_id: str, left_on: str, right_on: str, by: list[tuple[str, str]], k: int = 1, inferior: bool = False, tie: str | None = None, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """For each left row the ``k`` right rows of the same group whose value is nearest.

    Values are put in one order per group; only the ``k`` before and the ``k`` after each left row
    are compared, so that no group is paired with itself. ``inferior``: only values not above the
    left one. ``tie`` orders right rows as near as each other. ``keep`` names left columns that come
    out too, ``outer`` keeps left rows without partner.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    kept = keep or []
    tied = F.col(quoted(tie)).cast("string") if tie else F.lit("")
    l_type = "struct<" + ",".join(f"{quoted(c)}:{t}" for c, t in left.dtypes) + ">"
    r_type = "struct<" + ",".join(f"{quoted(c)}:{t}" for c, t in right.dtypes) + ">"
    l = left.select(*[F.col(quoted(a)).alias(n) for n, (a, _) in zip(keys, by, strict=True)], F.col(quoted(left_on)).cast("double").alias("_v"), F.lit(1).alias("_tag"), F.lit(None).cast("string").alias("_tie"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("_l"), F.lit(None).cast(r_type).alias("_r"))
    r = right.select(*[F.col(quoted(b)).alias(n) for n, (_, b) in zip(keys, by, strict=True)], F.col(quoted(right_on)).cast("double").alias("_v"), F.lit(0).alias("_tag"), tied.alias("_tie"), F.lit(None).cast(l_type).alias("_l"), F.struct(*[F.col(quoted(c)) for c in right.columns]).alias("_r")).where("_v is not null")
    both = l.unionByName(r)
    w = Window.partitionBy(*keys)
    nth = F.sum(1 - F.col("_tag"))
    # right rows of one value: the first by tie stand nearest to the left row on either side
    low = nth.over(w.orderBy("_v", "_tag", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0))
    high = nth.over(w.orderBy("_v", "_tag", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("_low", low).withColumn("_high", high)
    place = lambda side, at: F.struct(F.lit(side).alias("_side"), at.alias("_rn"))
    rows = ranked.where("_tag = 0").select(*keys, F.col("_v").alias("_rv"), "_tie", "_r", F.inline(F.array(place(0, F.col("_low")), *([] if inferior else [place(1, F.col("_high"))]))))
    below = F.transform(F.sequence(F.col("_low") - (k - 1), F.col("_low")), lambda i: F.struct(F.lit(0).alias("_side"), i.alias("_rn")))
    above = F.transform(F.sequence(F.col("_high") + 1, F.col("_high") + k), lambda i: F.struct(F.lit(1).alias("_side"), i.alias("_rn")))
    asks = ranked.where("_tag = 1").select(*keys, "_l", "_v", F.inline(below if inferior else F.concat(below, above)))
    asked = asks.withColumnsRenamed({n: f"m{n}" for n in (*keys, "_side", "_rn")})
    near = asked.join(rows, _same([*keys, "_side", "_rn"]) if not by else (_equal([*keys, "_side", "_rn"])), "left" if outer else "inner").withColumn("_gap", F.abs(F.col("_v") - F.col("_rv")))
    best = Window.partitionBy(F.col(f"_l.{quoted(left_id)}")).orderBy(F.col("_gap").asc_nulls_last(), "_tie", "_side", F.col("_rn").desc_nulls_last())
    top = near.withColumn("nearest_rank", F.row_number().over(best)).where((F.col("nearest_rank") <= k) & (F.col("_r").isNotNull() | (F.lit(outer) & (F.col("nearest_rank") == 1))))
    return top.select(F.col(f"_l.{quoted(left_id)}").alias(left_id), *[F.col(f"_l.{quoted(c)}").alias(c) for c in (kept or [left_on])], F.when(F.col("_r").isNotNull(), F.col("nearest_rank")).alias("nearest_rank"), F.col("_gap").alias("gap"), *[F.col(f"_r.{quoted(c)}").alias(c + "_right") for c in right.columns])


def _equal(columns: list[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.col(c) == F.col(f"m{c}"))
    return cond


def damerau(a: str, b: str) -> int:
    """Edits by insertion, deletion, replacement and exchange of neighbours, any of them repeated."""
    last: dict[str, int] = {}
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        hit = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), hit
            cost = x != y
            if not cost:
                hit = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


@F.pandas_udf(IntegerType())
def damerau_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Damerau-Levenshtein distance of two text columns."""
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a text; the whole text where it is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
TEXT_METRICS = ("LEVENSHTEIN", "DAMERAU_LEVENSHTEIN", "HAMMING", "JACCARD", "COSINE")


def _ready(c: Column, steps: list[str]) -> Column:
    """A text made comparable by the named steps."""
    known = {"CASE_INSENSITIVE", "REMOVE_PUNCTUATION", "CLEAR_SALUTATIONS", "CLEAR_STOP_WORDS", "ALPHABETIC_SORT"}
    if set(steps) - known:
        raise UnsupportedError(f"text normalisation {sorted(set(steps) - known)}")
    if "CASE_INSENSITIVE" in steps:
        c = F.lower(c)
    if "REMOVE_PUNCTUATION" in steps:
        c = F.regexp_replace(c, r"\p{Punct}", "")
    if "CLEAR_SALUTATIONS" in steps:
        c = F.regexp_replace(c, r"(?i)\b(?:mr|mrs|ms|dr|prof)\b\.?\s*", "")
    if "CLEAR_STOP_WORDS" in steps:
        c = F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.lower(w).isin(STOP_WORDS)), " ")
    if "ALPHABETIC_SORT" in steps:
        c = F.array_join(F.array_sort(F.split(F.trim(c), r"\s+")), " ")
    return c


def _prefixes(texts: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """The ``_keep`` rarest grams of each text: two texts that are near enough share one of them."""
    ranked = texts.select(name, "_keep", F.explode("_gs").alias("_g")).join(counts, "_g").withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy("_n", "_g")))
    return ranked.where(F.col("_k") <= F.col("_keep")).select(name, "_g")


def fuzzy(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float, metric: str = "LEVENSHTEIN", relative: bool = False, q: int = 2, normalise: list[str] | None = None, how: str = "INNER") -> DataFrame:
    """Pairs of rows whose keys are no farther apart than ``threshold``, with the ``distance``.

    Text metrics: candidates are texts that share one of their rarest grams, as many of them as it
    takes to miss no pair; texts too short for it are compared by length. Candidates are then measured
    exactly. EUCLIDEAN: numbers, joined by bands. GEOSPATIAL: points in WKT, metres, joined by cells.
    EQUALITY: the same text. ``relative``: the threshold is a share of the longer text. ``how`` INNER,
    LEFT, RIGHT or OUTER keeps rows without partner, those with a null key too. Columns get the
    prefixes ``l_`` and ``r_``.
    """
    metric, how = metric.upper(), how.upper()
    if how not in ("INNER", "LEFT", "RIGHT", "OUTER"):
        raise UnsupportedError(f"fuzzy join type {how}")
    if metric not in (*TEXT_METRICS, "EUCLIDEAN", "GEOSPATIAL", "EQUALITY"):
        raise UnsupportedError(f"distance metric {metric}")
    if relative and metric in ("EUCLIDEAN", "GEOSPATIAL"):
        raise UnsupportedError(f"a relative threshold for {metric}")
    l = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns})
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    lk, rk = F.col(quoted("l_" + left_on)), F.col(quoted("r_" + right_on))
    if metric == "EUCLIDEAN":
        l, r = l.withColumn("_a", lk.cast("double")), r.withColumn("_b", rk.cast("double"))
        band = lambda c: F.floor(c / F.lit(float(threshold) or 1.0)).cast("bigint")
        found = l.where("_a is not null").select("_a").distinct().withColumn("_n", band(F.col("_a"))).join(r.where("_b is not null").select("_b").distinct().withColumn("_n", F.explode(F.sequence(band(F.col("_b")) - 1, band(F.col("_b")) + 1))), "_n")
        found = found.withColumn("distance", F.abs(F.col("_a") - F.col("_b"))).where(F.col("distance") <= threshold)
    elif metric == "GEOSPATIAL":
        l, r = l.withColumn("_a", lk), r.withColumn("_b", rk)
        points = lambda df, c: df.select(c).distinct().withColumns(dict(zip(("lon", "lat"), lon_lat(F.col(c)), strict=True))).where("lat is not null and lon is not null")
        found = within_distance(points(l, "_a"), points(r, "_b"), ("lat", "lon"), ("lat", "lon"), float(threshold)).select(F.col("l__a").alias("_a"), F.col("r__b").alias("_b"), "distance")
    else:
        l, r = l.withColumn("_a", _ready(lk.cast("string"), normalise or [])), r.withColumn("_b", _ready(rk.cast("string"), normalise or []))
        ta, tb = l.where("_a is not null").select("_a").distinct(), r.where("_b is not null").select("_b").distinct()
        found = ta.join(tb, F.col("_a") == F.col("_b")).withColumn("distance", F.lit(0)) if metric == "EQUALITY" else _near_texts(ta, tb, threshold, metric, relative, q)
    pairs = l.join(found.select("_a", "_b", "distance"), "_a").join(r, "_b").drop("_a", "_b")
    if how in ("LEFT", "OUTER"):
        pairs = pairs.unionByName(l.join(found.select("_a"), "_a", "left_anti").drop("_a"), allowMissingColumns=True)
    if how in ("RIGHT", "OUTER"):
        pairs = pairs.unionByName(r.join(found.select("_b"), "_b", "left_anti").drop("_b"), allowMissingColumns=True)
    return pairs


def _near_texts(ta: DataFrame, tb: DataFrame, threshold: float, metric: str, relative: bool, q: int) -> DataFrame:
    """``(_a, _b, distance)`` of distinct texts no farther apart than the threshold."""
    size, length = F.size("_gs"), F.length
    sets = metric in ("JACCARD", "COSINE")
    if sets:
        share = 1 - threshold if metric == "JACCARD" else (1 - threshold) ** 2
        loss = size - F.ceil(F.lit(max(share, 0.0)) * size - 1e-9)
    else:
        # edits that the text may have to go through, and grams that one edit can change
        edits = (lambda n: F.floor(F.lit(threshold) * n / (1 - threshold) + 1e-9)) if relative and threshold < 1 else (lambda n: F.lit(int(threshold)))
        loss = lambda name: edits(length(name)) * (q + 1 if metric.startswith("DAMERAU") else q)
    gram = lambda t, name: t.withColumn("_gs", grams(F.col(name), q)).withColumn("_keep", (loss if sets else loss(name)) + 1)
    ga, gb = gram(ta, "_a"), gram(tb, "_b")
    counts = ga.select(F.explode("_gs").alias("_g")).unionByName(gb.select(F.explode("_gs").alias("_g"))).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    cand = _prefixes(ga, counts, "_a").join(_prefixes(gb, counts, "_b"), "_g").select("_a", "_b").distinct()
    if sets:
        common = F.size(F.array_intersect(grams(F.col("_a"), q), grams(F.col("_b"), q)))
        na, nb = F.size(grams(F.col("_a"), q)), F.size(grams(F.col("_b"), q))
        sim = common / (na + nb - common) if metric == "JACCARD" else common / F.sqrt(na * nb)
        return cand.withColumn("distance", 1 - sim).where(F.col("distance") <= threshold + 1e-12)
    limit = F.floor(F.lit(threshold) * F.greatest(length("_a"), length("_b")) + 1e-9) if relative else F.lit(int(threshold))
    short = size < F.col("_keep")
    lengths = F.sequence(F.greatest(F.lit(0), length("_a") - edits(length("_a")).cast("int")), length("_a") + edits(length("_a")).cast("int"))
    few = ga.where(short).select("_a", F.explode(lengths).alias("_n")).join(tb.withColumn("_n", length("_b")), "_n").select("_a", "_b")
    lengths_b = F.sequence(F.greatest(F.lit(0), length("_b") - edits(length("_b")).cast("int")), length("_b") + edits(length("_b")).cast("int"))
    few_b = gb.where(short).select("_b", F.explode(lengths_b).alias("_n")).join(ta.withColumn("_n", length("_a")), "_n").select("_a", "_b")
    cand = cand.unionByName(few).unionByName(few_b).distinct().where(F.abs(length("_a") - length("_b")) <= limit)
    if metric == "HAMMING":
        d = F.when(length("_a") == length("_b"), F.aggregate(F.zip_with(F.split("_a", ""), F.split("_b", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))
    elif metric.startswith("DAMERAU"):
        cand = cand.where(F.levenshtein("_a", "_b") <= 2 * limit)  # an exchange of neighbours is two plain edits
        d = damerau_udf("_a", "_b")
    else:
        d = F.levenshtein("_a", "_b")
    return cand.withColumn("distance", d).where(F.col("distance") <= limit)


def lon_lat(c: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a WKT point; null for anything else."""
    pattern = r"(?i)POINT\s*\(\s*(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)\s*\)"
    return F.regexp_extract(c, pattern, 1).try_cast("double"), F.regexp_extract(c, pattern, 2).try_cast("double")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "METER") -> Column:
    """Distance over the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH / UNITS[unit]) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def _point_cells(points: DataFrame, lat: str, lon: str, step: float, near: int = 0) -> DataFrame:
    """Points with band ``_y`` and cell ``_x``, for each of the ``near`` bands and cells around them.
    A band has as many cells as stay wide enough for ``step`` degrees at its latitude, one at the poles."""
    y = F.floor(F.col(lat) / step).cast("bigint")
    far = F.greatest(F.abs("_y"), F.abs(F.col("_y") + 1)) * step + step  # no partner of a point in the band is nearer a pole
    n_lon = F.when(far >= 89.99, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.cos(F.radians(far)) * (360.0 / step)))).cast("bigint")
    own = F.floor((F.col(lon) + 180.0) * F.col("_n") / 360.0).cast("bigint")
    xs = F.array_distinct(F.array(*[F.pmod(own + i, F.col("_n")) for i in range(-near, near + 1)]))
    bands = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_y", F.explode(F.sequence(y - near, y + near)))
    return bands.withColumn("_n", n_lon).withColumn("_x", F.explode(xs)).drop("_n")


def within_distance(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], distance: float, unit: str = "METER") -> DataFrame:
    """Pairs of points no farther apart than ``distance``, by cells of latitude and longitude.

    Bands of latitude are as high as the distance; each is cut into as many cells as stay as wide as
    the distance spans at its latitude, one at the poles. Each right point is put in at most nine
    cells, its own and the neighbouring ones. Only distinct points are compared, their rows are joined
    to the pairs found. No side is broadcast: file sizes say little of the rows, and all pairs would be
    made in the few tasks of the pairs found. Columns are prefixed ``l_``, ``r_``.
    """
    metres = distance * UNITS[unit]
    step = max(math.degrees(metres / EARTH), 1e-6) * (1 + 1e-9)
    l = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns})
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    columns = [F.col(quoted(c)) for c in (*l.columns, *r.columns)]
    l = l.withColumns({k: F.col(quoted("l_" + c)).cast("double") for k, c in zip(("_la", "_lo"), left_at, strict=True)})
    r = r.withColumns({k: F.col(quoted("r_" + c)).cast("double") for k, c in zip(("_ra", "_ro"), right_at, strict=True)})
    a = _point_cells(l.select("_la", "_lo").distinct(), "_la", "_lo", step)
    b = _point_cells(r.select("_ra", "_ro").distinct(), "_ra", "_ro", step, 1)
    d = haversine(F.col("_la"), F.col("_lo"), F.col("_ra"), F.col("_ro"), unit)
    found = a.join(b.hint("merge"), ["_x", "_y"]).withColumn("distance", d).where(F.col("distance") <= distance).drop("_x", "_y")
    return found.join(l.hint("merge"), ["_la", "_lo"]).join(r.hint("merge"), ["_ra", "_ro"]).select(*columns, "distance")


def beyond_distance(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], distance: float, unit: str = "METER") -> DataFrame:
    """Pairs of points farther apart than ``distance``. Nearly all pairs are, so that this is a product
    with a condition by its nature; columns as in ``within_distance``."""
    l = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns})
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    at = [F.col(quoted(p + c)).cast("double") for p, cs in (("l_", left_at), ("r_", right_at)) for c in cs]
    return l.crossJoin(r).withColumn("distance", haversine(*at, unit)).where(F.col("distance") > distance)


def _boxed(df: DataFrame, column: str, p: str) -> DataFrame:
    """With the bounding box of a WKT shape, JVM-side; rows without a shape are left out."""
    xy = F.transform(F.regexp_extract_all(F.col(quoted(column)), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    df = df.withColumn("_xy", xy).where(F.size("_xy") >= 2)
    every = lambda k: F.filter("_xy", lambda _, i: i % 2 == k)
    return df.withColumns({f"{p}x0": F.array_min(every(0)), f"{p}x1": F.array_max(every(0)), f"{p}y0": F.array_min(every(1)), f"{p}y1": F.array_max(every(1))}).drop("_xy")


def geo_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str) -> DataFrame:
    """Pairs of WKT shapes in a planar relation; columns get the prefixes ``l_`` and ``r_``.

    Only shapes whose bounding boxes meet are compared. A box is put in the at most four cells it
    meets in a grid as coarse as the box is large, and in the cells of all coarser grids; two boxes
    meet in the cell of the coarser of their grids that holds the least corner of what they share.
    DISJOINT is a product by its nature: pairs whose boxes are apart need no more than the boxes, the
    others are compared once for each two distinct shapes.
    """
    l = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns})
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    a, b = "l_" + left_on, "r_" + right_on
    if kind == "DISJOINT":
        return _disjoint(l, r, a, b)
    l, r = _boxed(l, a, "_a"), _boxed(r, b, "_b")
    side = lambda p: F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(1e-6))
    level = lambda p: F.ceil(F.log2(side(p))).cast("int")
    top = max([x for x in (l.agg(F.max(level("_a"))).first()[0], r.agg(F.max(level("_b"))).first()[0]) if x is not None], default=0)
    l, r = l.withColumn("_al", level("_a")), r.withColumn("_bl", level("_b"))
    cell = lambda v, n: F.floor(v / F.pow(F.lit(2.0), n)).cast("bigint")

    def cells(df: DataFrame, p: str, levels: Column) -> DataFrame:
        df = df.withColumn("_n", F.explode(levels))
        df = df.withColumn("_x", F.explode(F.sequence(cell(F.col(f"{p}x0"), F.col("_n")), cell(F.col(f"{p}x1"), F.col("_n")))))
        return df.withColumn("_y", F.explode(F.sequence(cell(F.col(f"{p}y0"), F.col("_n")), cell(F.col(f"{p}y1"), F.col("_n")))))

    own = lambda p: F.array(F.col(f"{p}l"))
    coarser = lambda p, least: F.filter(F.sequence(F.col(f"{p}l"), F.greatest(F.col(f"{p}l"), F.lit(top))), lambda n: n >= F.col(f"{p}l") + least)
    pairs = cells(l, "_a", own("_a")).join(cells(r, "_b", coarser("_b", 0)), ["_n", "_x", "_y"]).unionByName(cells(l, "_a", coarser("_a", 1)).join(cells(r, "_b", own("_b")), ["_n", "_x", "_y"]))
    meet = (F.col("_ax0") <= F.col("_bx1")) & (F.col("_bx0") <= F.col("_ax1")) & (F.col("_ay0") <= F.col("_by1")) & (F.col("_by0") <= F.col("_ay1"))
    corner = (F.col("_x") == cell(F.greatest("_ax0", "_bx0"), F.col("_n"))) & (F.col("_y") == cell(F.greatest("_ay0", "_by0"), F.col("_n")))
    pairs = pairs.where(meet & corner).select(*[quoted(f"l_{c}") for c in left.columns], *[quoted(f"r_{c}") for c in right.columns])
    return pairs.where(geo_relation(kind)(F.col(quoted(a)), F.col(quoted(b))))


#: Pairs of rows that one task of a product makes.
PAIRS = 5_000_000


def _product(l: DataFrame, r: DataFrame, pairs: int) -> DataFrame:
    """All pairs of rows, the longer side spread so that a task makes about ``pairs`` of them."""
    n_l, n_r = l.count(), r.count()
    tasks = max(1, min(4000, max(n_l, n_r), -(-n_l * n_r // pairs)))
    return l.repartition(tasks).crossJoin(r.repartition(1)) if n_l >= n_r else r.repartition(tasks).crossJoin(l.repartition(1))


def _disjoint(l: DataFrame, r: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of shapes without a point in common. A shape without a box, as one that holds no
    coordinates, is compared with all others."""
    columns = [F.col(quoted(c)) for c in (*l.columns, *r.columns)]
    boxed = lambda df, c, p: df.where(F.col(quoted(c)).isNotNull()).withColumn(p, box_udf(F.col(quoted(c)))).select("*", *[F.col(f"{p}.{k}").alias(p + k) for k in ("x0", "y0", "x1", "y1")]).drop(p)
    l, r = boxed(l, a, "_a"), boxed(r, b, "_b")
    apart = F.coalesce((F.col("_ax1") < F.col("_bx0")) | (F.col("_bx1") < F.col("_ax0")) | (F.col("_ay1") < F.col("_by0")) | (F.col("_by1") < F.col("_ay0")), F.lit(False))
    found = _product(l, r, PAIRS).where(apart).select(*columns)
    shapes = lambda df, c, p: df.select(F.col(quoted(c)).alias(f"{p}s"), *[f"{p}{k}" for k in ("x0", "y0", "x1", "y1")]).distinct()
    near = _product(shapes(l, a, "_a"), shapes(r, b, "_b"), PAIRS // 20).where(~apart).select("_as", "_bs")
    near = near.where(geo_relation("DISJOINT")(F.col("_as"), F.col("_bs")))
    return found.unionByName(near.join(l, F.col("_as") == F.col(quoted(a))).join(r, F.col("_bs") == F.col(quoted(b))).select(*columns))


def rings(wkt: str | None) -> list[list[tuple[float, float]]]:
    """Rings of a POLYGON, points of a LINESTRING, or the point of a POINT in WKT; shapes of several
    parts are refused."""
    if not wkt or "(" not in wkt:
        return []
    if wkt.lstrip()[:5].upper() in ("MULTI", "GEOME"):
        raise UnsupportedError("shapes of several parts; explode them first")
    body = wkt[wkt.index("(") :].strip()
    parts = [p for p in body.replace("(", "").split(")") if p.strip(" ,")]
    return [[tuple(map(float, xy.split()[:2])) for xy in p.strip(" ,").split(",")] for p in parts]


def in_polygon(x: float, y: float, shape: list[list[tuple[float, float]]]) -> bool:
    """Whether a point lies in a polygon, holes taken out (ray casting)."""
    inside = False
    for ring in shape:
        j = len(ring) - 1
        for i in range(len(ring)):
            (xi, yi), (xj, yj) = ring[i], ring[j]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                inside = not inside
            j = i
    return inside


@F.pandas_udf(BooleanType())
def contains_udf(area: pd.Series, point: pd.Series) -> pd.Series:
    """Whether a WKT polygon contains a WKT point."""
    out = []
    for a, p in zip(area, point, strict=True):
        at = rings(p)
        out.append(None if not at or a is None else in_polygon(*at[0][0], rings(a)))
    return pd.Series(out, dtype="boolean")


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in ("x0", "y0", "x1", "y1")]))
def box_udf(shape: pd.Series) -> pd.DataFrame:
    """The bounding box of a WKT shape; nulls where it has no coordinates or one that is no number."""
    out = []
    for s in shape:
        xy = [p for ring in rings(s) for p in ring]
        known = xy and all(v == v for p in xy for v in p)
        out.append([*map(min, zip(*xy, strict=True)), *map(max, zip(*xy, strict=True))] if known else [None] * 4)
    return pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"], dtype="float64")


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def segments_meet(a, b, c, d, touch: bool = True) -> bool:
    """Whether two segments have a point in common; without ``touch`` only a proper crossing counts."""
    s1, s2, s3, s4 = _cross(c, d, a), _cross(c, d, b), _cross(a, b, c), _cross(a, b, d)
    if s1 * s2 < 0 and s3 * s4 < 0:
        return True
    if not touch:
        return False
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return s1 == 0 and on(c, d, a) or s2 == 0 and on(c, d, b) or s3 == 0 and on(a, b, c) or s4 == 0 and on(a, b, d)


def relation(a: str | None, b: str | None, kind: str) -> bool | None:
    """Planar relation of two WKT shapes: points, lines and polygons."""
    if a is None or b is None:
        return None
    ra, rb = rings(a), rings(b)
    poly_a, poly_b = a.lstrip().upper().startswith("POLYGON"), b.lstrip().upper().startswith("POLYGON")
    edges = lambda rs: [(r[i], r[i + 1]) for r in rs for i in range(len(r) - 1)] or [(r[0], r[0]) for r in rs]
    proper = any(segments_meet(*s, *t, touch=False) for s in edges(ra) for t in edges(rb))
    touch = any(segments_meet(*s, *t) for s in edges(ra) for t in edges(rb))
    a_in_b = poly_b and any(in_polygon(*p, rb) for r in ra for p in r)
    b_in_a = poly_a and any(in_polygon(*p, ra) for r in rb for p in r)
    if kind in ("INTERSECTS", "DISJOINT"):
        return (touch or a_in_b or b_in_a) == (kind == "INTERSECTS")
    if kind == "CONTAINS" and b.lstrip().upper().startswith("POINT"):
        return b_in_a and not touch  # a point of the border is not inside
    if kind == "CONTAINS":
        return poly_a and not proper and all(in_polygon(*p, ra) or touch and any(segments_meet(p, p, *t) for t in edges(ra)) for r in rb for p in r)
    if kind == "WITHIN":
        return relation(b, a, "CONTAINS")
    if kind == "TOUCHES":
        return touch and not proper and not a_in_b and not b_in_a
    if kind == "OVERLAPS":
        return poly_a == poly_b and proper
    if kind == "CROSSES":
        return poly_a != poly_b and proper
    raise UnsupportedError(f"geographic relation {kind}")


def geo_relation(kind: str):
    """A pandas UDF for one relation."""

    @F.pandas_udf("boolean")
    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([relation(x, y, kind) for x, y in zip(a, b, strict=True)], dtype="boolean")

    return check
