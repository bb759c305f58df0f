"""References to records that do not exist at the time they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lifetimes(parents: DataFrame, keys: list[str], born: str, died: str) -> DataFrame:
    """Distinct ``(keys, _born, _died)``; lives that end no later than they begin never exist."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    return (
        parents.select(*keys, F.col(born).cast("timestamp_ntz").alias("_born"), F.coalesce(F.col(died).cast("timestamp_ntz"), far).alias("_died"))
        .where(F.col("_born").isNotNull() & (F.col("_died") > F.col("_born")))
        .where(F.reduce(F.array(*[F.col(k).isNotNull() for k in keys]), F.lit(True), lambda a, b: a & b))
        .distinct()
    )


def orphan_keys(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, born: str = "created_at", died: str = "deleted_at") -> DataFrame:
    """Distinct ``(keys, at)`` of ``refs`` for which no parent with these keys is alive at ``at``.

    A parent is alive from ``born`` (inclusive) to ``died`` (exclusive, null: for ever). References
    with a null key refer to nothing and are left out; a reference without a time is an orphan, as
    no parent is known to live then. The references are made distinct before the join, which is a
    left anti-join on the keys with the interval as residual condition; a hot key is split by AQE's
    skew handling, as only the left side has to be split for it.
    """
    some = [F.col(k).isNotNull() for k in keys]
    wanted = refs.select(*keys, F.col(at).cast("timestamp_ntz").alias("_at")).where(F.reduce(F.array(*some), F.lit(True), lambda a, b: a & b)).distinct()
    alive = lifetimes(parents, keys, born, died)
    right = alive.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_born", "_died")
    cond = (F.col("_born") <= F.col("_at")) & (F.col("_died") > F.col("_at"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return wanted.join(right, cond, "left_anti")


def orphan_references(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, born: str = "created_at", died: str = "deleted_at") -> DataFrame:
    """The rows of ``refs`` whose key is an orphan: ``orphan_keys`` joined back, null-safe in time."""
    lost = orphan_keys(refs, parents, keys, at, born, died).select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_at")
    cond = F.col(at).cast("timestamp_ntz").eqNullSafe(F.col("_at"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_o_{k}"))
    return refs.join(lost, cond, "left_semi")


def orphan_counts(refs: DataFrame, orphans: DataFrame, at: str, by: list[str]) -> DataFrame:
    """References and orphans per ``by`` and month of ``at``; months without orphans count 0."""
    month = F.date_format(F.col(at), "yyyy-MM").alias("month")
    all_refs = refs.groupBy(*by, month).agg(F.count(F.lit(1)).alias("n_references"))
    lost = orphans.groupBy(*by, month).agg(F.count(F.lit(1)).alias("n_orphans"))
    joined = all_refs.alias("a").join(lost.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "month"]], "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in [*by, "month"]], "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
