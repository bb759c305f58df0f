"""Structural nodes: grouping, windows, pivot, split, sort, top-n, sampling, stack, statistics."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.errors import UnsupportedError, ValidationError
from sparkloom.functions.formula import compile_formula, quoted, truthy
from sparkloom.functions.modes import MAX_VALUES, distinct_values, slug


def aggregate(kind: str, column: str | None, order: str | None = None, sep: str = ",") -> Column:
    """One aggregate function."""
    kind = {"MEAN": "AVG", "AVERAGE": "AVG", "NUNIQUE": "COUNTD", "STD": "STDDEV", "VARIANCE": "VAR", "LIST": "COLLECT_LIST"}.get(kind.upper(), kind.upper())
    if kind == "SIZE" or column in (None, "*"):
        return F.count(F.lit(1))
    c = F.col(quoted(column))
    if kind.startswith("PERCENTILE_"):
        return F.percentile(c, F.lit(int(kind[11:]) / 100))
    by = F.col(quoted(order)) if order else None
    table = {
        "SUM": lambda: F.sum(c), "AVG": lambda: F.avg(c), "COUNT": lambda: F.count(c), "COUNTD": lambda: F.count_distinct(c), "MIN": lambda: F.min(c), "MAX": lambda: F.max(c),
        "FIRST": lambda: F.min_by(c, by) if order else F.first(c, ignorenulls=True), "LAST": lambda: F.max_by(c, by) if order else F.last(c, ignorenulls=True),
        "STDDEV": lambda: F.stddev_samp(c), "VAR": lambda: F.var_samp(c), "STDDEV_POP": lambda: F.stddev_pop(c), "VAR_POP": lambda: F.var_pop(c), "MEDIAN": lambda: F.median(c), "MODE": lambda: F.mode(c, deterministic=True), "PRODUCT": lambda: F.product(c),
        "CONCAT": lambda: F.array_join(F.sort_array(F.collect_list(c.cast("string"))), sep), "COLLECT_LIST": lambda: F.sort_array(F.collect_list(c)), "COLLECT_SET": lambda: F.sort_array(F.collect_set(c)),
        "APPROX_COUNTD": lambda: F.approx_count_distinct(c), "ANY": lambda: F.any_value(c, ignoreNulls=True),
    }
    if kind not in table:
        raise UnsupportedError(f"aggregate {kind}")
    return table[kind]()


def group(df: DataFrame, keys: list[str], aggregations: list[dict], global_count: bool = False, pre_filter: str | None = None, post_filter: str | None = None, drop_null_keys: bool = False) -> DataFrame:
    """Group by ``keys`` with ``aggregations`` ``{column, type, outputColumn?, order?}``."""
    if pre_filter:
        df = df.where(truthy(compile_formula(pre_filter)))
    if drop_null_keys:
        df = df.dropna(subset=keys)
    cols = [aggregate(a["type"], a.get("column"), a.get("order")).alias(a.get("outputColumn") or f"{a.get('column')}_{a['type'].lower()}") for a in aggregations]
    if global_count:
        cols.append(F.count(F.lit(1)).alias("count"))
    if not cols:
        raise ValidationError("a grouping needs aggregates")
    out = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*cols) if keys else df.agg(*cols)
    return out.where(truthy(compile_formula(post_filter))) if post_filter else out


def order_columns(orders: list[dict | str]) -> list[Column]:
    """Sort orders: ``{column, order, nulls?}``; nulls first ascending, last descending by default."""
    out = []
    for o in orders:
        o = {"column": o} if isinstance(o, str) else o
        c = F.col(quoted(o["column"]))
        desc = str(o.get("order", "ASC")).upper().startswith("D")
        nulls = str(o.get("nulls") or ("LAST" if desc else "FIRST")).upper()
        out.append({(0, "FIRST"): c.asc_nulls_first, (0, "LAST"): c.asc_nulls_last, (1, "FIRST"): c.desc_nulls_first, (1, "LAST"): c.desc_nulls_last}[(int(desc), nulls)]())
    return out


def window_function(kind: str, column: str | None, base: WindowSpec, size: int | None = None, min_periods: int | None = None, method: str = "min", whole: WindowSpec | None = None) -> Column:
    """One analytic function over ``base`` (partition and order)."""
    kind = kind.upper()
    c = F.col(quoted(column)) if column else None
    running = base.rowsBetween(Window.unboundedPreceding, 0)
    every = base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = int(size or 1)
    if kind == "RANK":
        peers = F.count(F.lit(1)).over(base.rangeBetween(0, 0)) if method in ("average", "max") else None
        return {"min": lambda: F.rank().over(base), "dense": lambda: F.dense_rank().over(base), "first": lambda: F.row_number().over(base), "average": lambda: F.rank().over(base) + (peers - 1) / 2, "max": lambda: F.rank().over(base) + peers - 1}[method]()
    simple = {
        "ROW_NUMBER": lambda: F.row_number().over(base), "DENSE_RANK": lambda: F.dense_rank().over(base), "NTILE": lambda: F.ntile(n).over(base), "PERCENT_RANK": lambda: F.percent_rank().over(base), "CUME_DIST": lambda: F.cume_dist().over(base),
        "LAG": lambda: F.lag(c, n).over(base), "LEAD": lambda: F.lead(c, n).over(base), "LAG_DIFF": lambda: c - F.lag(c, n).over(base), "LEAD_DIFF": lambda: F.lead(c, n).over(base) - c, "PCT_CHANGE": lambda: F.try_divide(c.cast("double"), F.lag(c, n).over(base)) - 1,
        "FIRST_VALUE": lambda: F.first_value(c).over(every), "LAST_VALUE": lambda: F.last_value(c).over(every), "NTH_VALUE": lambda: F.nth_value(c, n).over(every),
        "RUNNING_SUM": lambda: F.sum(c).over(running), "RUNNING_AVG": lambda: F.avg(c).over(running), "RUNNING_MIN": lambda: F.min(c).over(running), "RUNNING_MAX": lambda: F.max(c).over(running), "RUNNING_COUNT": lambda: F.count(c).over(running), "RUNNING_PRODUCT": lambda: F.product(c).over(running),
    }
    if kind in simple:
        return simple[kind]()
    if kind.startswith("MOVING_"):
        frame = base.rowsBetween(-(n - 1), 0)
        f = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp}[kind[7:]]
        value = f(c).over(frame)
        return F.when(F.count(c).over(frame) >= min_periods, value) if min_periods else value
    return aggregate(kind, column).over(whole if whole is not None else base)


def window(df: DataFrame, partition: list[str], order: list[dict | str], aggregations: list[dict]) -> DataFrame:
    """Analytic columns ``{type, column?, windowSize?, outputColumn, min_periods?, method?}``.

    Plain aggregates run over the whole partition; running and moving functions bring their frame.
    """
    keys = [F.col(quoted(k)) for k in partition]
    whole = Window.partitionBy(*keys)
    base = whole.orderBy(*order_columns(order)) if order else whole
    return df.withColumns({a.get("outputColumn") or f"{a.get('column') or 'row'}_{a['type'].lower()}": window_function(a["type"], a.get("column"), base, a.get("windowSize"), a.get("min_periods"), a.get("method", "min"), whole) for a in aggregations})


def stack(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs; columns by name, missing ones null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct(df: DataFrame, columns: list[str] | None = None, keep: str | None = None, order: list | None = None, count: bool = False) -> DataFrame:
    """Unique rows on ``columns``: with ``count`` the number of each; ``keep`` first, last or none."""
    cols = columns or df.columns
    if count:
        return df.groupBy(*[F.col(quoted(c)) for c in cols]).agg(F.count(F.lit(1)).alias("count"))
    if keep is None:
        return df.select(*[quoted(c) for c in cols]).distinct() if columns else df.distinct()
    w = Window.partitionBy(*[F.col(quoted(c)) for c in cols])
    if keep == "none":
        return df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    by = order_columns(order or [c for c in df.columns])
    if keep == "last":
        by = order_columns([{**({"column": o} if isinstance(o, str) else o), "order": "ASC" if str(({} if isinstance(o, str) else o).get("order", "ASC")).upper().startswith("D") else "DESC"} for o in (order or df.columns)])
    return df.withColumn("_n", F.row_number().over(w.orderBy(*by))).where("_n = 1").drop("_n")


def top_n(df: DataFrame, n: int, order: list[dict | str], by: list[str] | None = None, last: int = 0, rest: bool = False) -> DataFrame:
    """The first ``n`` (and ``last``) rows per group in an order, or the remaining rows."""
    cols = order_columns(order)
    if not by and not last and not rest:
        return df.orderBy(*cols).limit(n)
    w = Window.partitionBy(*[F.col(quoted(c)) for c in by or []])
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(*cols)))
    if last:
        ranked = ranked.withColumn("_all", F.count(F.lit(1)).over(w))
        kept = (F.col("_n") <= n) | (F.col("_n") > F.col("_all") - last)
    else:
        kept = F.col("_n") <= n
    return ranked.where(~kept if rest else kept).drop("_n", "_all")


def split(df: DataFrame, mode: str, conditions: list[str] | None = None, column: str | None = None, values: list | None = None, weights: list[float] | None = None, key: list[str] | None = None, seed: int = 7) -> list[DataFrame]:
    """Route every row to exactly one output; the last output takes the rest.

    FILTER: formulas in order, rows whose condition is null go on. COLUMN_VALUE: one output per value.
    RANDOM: by a hash of ``key``, the same at every run. PERCENTILE: bands of a number's distribution.
    """
    mode = mode.upper()
    if mode == "FILTER":
        conds = [F.coalesce(truthy(compile_formula(f)), F.lit(False)) for f in conditions or []]
    elif mode == "COLUMN_VALUE":
        conds = [F.col(quoted(column)).eqNullSafe(F.lit(v)) for v in values or []]
    elif mode == "RANDOM":
        u = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in key or df.columns], F.lit(seed)), F.lit(1_000_000))
        total, at, conds = sum(weights), 0.0, []
        for w in weights[:-1]:
            at += w / total
            conds.append(u < int(round(at * 1_000_000)))
    elif mode == "PERCENTILE":
        c = F.col(quoted(column))
        cuts = df.agg(F.percentile(c, F.array(*[F.lit(float(q)) for q in values]))).first()[0] or []
        conds = [c <= F.lit(x) for x in cuts]
    else:
        raise UnsupportedError(f"split mode {mode}")
    out, taken = [], F.lit(False)
    for c in conds:
        c = F.coalesce(c, F.lit(False))
        out.append(df.where(~taken & c))
        taken = taken | c
    return [*out, df.where(~taken)]


def sample(df: DataFrame, method: str, n: int | None = None, fraction: float | None = None, column: str | None = None, key: list[str] | None = None, order: list | None = None, seed: int = 7) -> DataFrame:
    """Sampling, each method the same at every run: chance is a hash of ``key`` (all columns)."""
    method = {"RANDOM": "RANDOM_FIXED_NB", "RANDOM_FIXED": "RANDOM_FIXED_RATIO", "FIRST_ROWS": "HEAD_SEQUENTIAL", "LAST_ROWS": "TAIL_SEQUENTIAL"}.get(method.upper(), method.upper())
    u = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in key or df.columns], F.lit(seed)), F.lit(1 << 40))
    ties = [F.col(quoted(c)) for c in key or df.columns]
    if method in ("RANDOM_FIXED_NB", "RESERVOIR"):
        return df.orderBy(u, *ties).limit(n)
    if method == "RANDOM_FIXED_RATIO":
        return df.where(u < int(fraction * (1 << 40)))
    if method == "HEAD_SEQUENTIAL":
        return df.orderBy(*order_columns(order)).limit(n) if order else df.limit(n)
    if method == "TAIL_SEQUENTIAL":
        flipped = [{**({"column": o} if isinstance(o, str) else o), "order": "ASC" if not isinstance(o, str) and str(o.get("order", "ASC")).upper().startswith("D") else "DESC"} for o in order]
        return df.orderBy(*order_columns(flipped)).limit(n)
    if method in ("STRATIFIED", "CLASS_REBALANCE"):
        c = F.col(quoted(column))
        if method == "STRATIFIED" and fraction is not None:
            # the same share of every stratum: each has its own number of rows to keep
            sizes = df.groupBy(c.alias("_s")).agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("_q"))
            ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy(u, *ties)))
            return ranked.join(sizes, c.eqNullSafe(F.col("_s"))).where(F.col("_n") <= F.col("_q")).drop("_n", "_s", "_q")
        if n is None:
            n = df.groupBy(c).count().agg(F.min("count")).first()[0] or 0
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy(u, *ties))).where(F.col("_n") <= n).drop("_n")
    raise UnsupportedError(f"sampling method {method}")


def pivot(df: DataFrame, rows: list[str], column: str, values: list[dict], modalities: list | None = None, top: int | None = None, min_count: int | None = None, marginals: bool = False, fill: Any = None) -> DataFrame:
    """Rows by modalities of ``column`` with aggregates ``{column, type, outputColumn?}``.

    Modalities: given, the ``top`` most frequent, those with ``min_count`` rows, or all, found first.
    """
    if modalities is None:
        if top or min_count:
            counts = df.where(F.col(quoted(column)).isNotNull()).groupBy(F.col(quoted(column)).alias("v")).count()
            if min_count:
                counts = counts.where(F.col("count") >= min_count)
            counts = counts.orderBy(F.desc("count"), "v")
            found = counts.limit(top or MAX_VALUES + 1).collect()
            if not top and len(found) > MAX_VALUES:
                raise UnsupportedError(f"more than {MAX_VALUES} values of {column} have {min_count} rows")
            modalities = sorted(r["v"] for r in found)
        else:
            modalities = distinct_values(df, column)
    c = F.col(quoted(column))
    cols = []
    for a in values:
        name = a.get("outputColumn") or (a["type"].lower() if a.get("column") in (None, "*") else f"{a['column']}_{a['type'].lower()}")
        for m in modalities:
            hit = c.eqNullSafe(F.lit(m))
            source = F.when(hit, F.col(quoted(a["column"])) if a.get("column") not in (None, "*") else F.lit(1))
            cols.append(_agg_over(a["type"], source).alias(f"{slug(m)}_{name}"))
        if marginals:
            cols.append(aggregate("COUNT" if a["type"].upper() == "SIZE" else a["type"], a.get("column")).alias(f"total_{name}"))
    out = df.groupBy(*[F.col(quoted(r)) for r in rows]).agg(*cols)
    return out.fillna(fill) if fill is not None else out


def _agg_over(kind: str, c: Column) -> Column:
    f = {"SUM": F.sum, "AVG": F.avg, "MEAN": F.avg, "COUNT": F.count, "SIZE": F.count, "MIN": F.min, "MAX": F.max, "COUNTD": F.count_distinct, "FIRST": lambda x: F.first(x, ignorenulls=True), "STDDEV": F.stddev_samp, "MEDIAN": F.median}
    if kind.upper() not in f:
        raise UnsupportedError(f"pivot aggregate {kind}")
    return f[kind.upper()](c)


def fold(df: DataFrame, columns: list[str], var: str = "variable", value: str = "value", keep_nulls: bool = True) -> DataFrame:
    """Columns to rows."""
    ids = [quoted(c) for c in df.columns if c not in columns]
    out = df.unpivot(ids, [quoted(c) for c in columns], var, value)
    return out if keep_nulls else out.where(F.col(quoted(value)).isNotNull())


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max, nulls, distinct values; one pass."""
    parts = []
    for c in columns:
        x = F.col(quoted(c)).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("n_null")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key."""
    return old.join(new.select(*[quoted(k) for k in keys]), keys, "left_anti").unionByName(new, allowMissingColumns=True)
