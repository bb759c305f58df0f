"""Rolling totals over trailing calendar periods by prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, arrival: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row that arrived last, by a map-side combined aggregate.

    Rows without a key are all kept. Ties in ``arrival`` go to the largest row in column order, so
    the result does not depend on the partitioning.
    """
    kept = df.select(key, arrival, *[c for c in columns if c not in (key, arrival)])
    row = F.struct(F.col(arrival).alias("_arrival"), *[F.col(c) for c in columns])
    keyed = kept.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(row).alias("_row"))
    keyed = keyed.select(*[F.col(f"_row.{c}").alias(c) for c in columns])
    return keyed.unionByName(kept.where(F.col(key).isNull()).select(*columns))


def daily_totals(df: DataFrame, entity: Column, ts: Column, measures: dict[str, Column], scale: int = 12) -> DataFrame:
    """``(entity, day, n_rows, <measures>)`` with one row per entity and day that has rows.

    Rows without entity or time count for nothing. Fractional measures are summed as decimals of
    ``scale`` places, so that differences of prefix sums are exact.
    """
    picked = df.select(entity.alias("entity"), F.to_date(ts).alias("day"), *[c.alias(m) for m, c in measures.items()])
    kinds = dict(picked.dtypes)
    exact = {m: F.col(m).cast(f"decimal({22 + scale},{scale})") if kinds[m] in ("double", "float") else F.col(m).cast("decimal(34,0)") for m in measures}
    return (
        picked.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(m) for m, c in exact.items()])
    )


def trailing_totals(daily: DataFrame, measures: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of each measure over the trailing ``periods`` for every calendar day.

    ``daily`` has ``entity``, ``day`` (date) and the measures, at most one row per entity and day.
    For each entity the cumulative prefix sums P are taken over its active days. Each prefix holds
    until the next active day, so it is carried forward over the days between; the total of the last
    w days at day d is P(d) - P(d - w). Averages are per calendar day of the period that lies between
    the entity's first day and d. Every entity runs from its first to its last active day. An empty
    input gives an empty result.

    Only the pre-aggregated daily rows are shuffled, once, by entity; an entity that holds a third of
    all input rows is no larger here than any other that spans as many days.
    """
    by_day = Window.partitionBy("entity").orderBy("day")
    prefix = by_day.rowsBetween(Window.unboundedPreceding, 0)
    p = daily.select(
        "entity",
        "day",
        F.min("day").over(prefix).alias("_first"),
        F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day")).alias("_until"),
        *[F.sum(m).over(prefix).alias(f"_p_{m}") for m in measures],
        *[F.col(m).alias(f"_d_{m}") for m in measures],
    )
    filled = p.select(
        "entity",
        F.col("day").alias("_active"),
        F.explode(F.sequence("day", "_until")).alias("day"),
        "_first",
        *[f"_p_{m}" for m in measures],
        *[f"_d_{m}" for m in measures],
    )
    out: list[Column] = [F.col("entity"), F.col("day")]
    for m in measures:
        out.append(F.when(F.col("day") == F.col("_active"), F.col(f"_d_{m}")).otherwise(F.lit(0)).alias(m))
    for w in periods:
        span = F.least(F.lit(w), F.datediff("day", "_first") + 1)
        for m in measures:
            total = F.col(f"_p_{m}") - F.coalesce(F.lag(f"_p_{m}", w).over(by_day), F.lit(0))
            out.append(total.alias(f"{m}_{w}d"))
            out.append((total.cast("double") / span).alias(f"{m}_avg_{w}d"))
    return filled.select(*out)


def quiet_days(trailing: DataFrame, measure: str, period: int) -> DataFrame:
    """``(entity, day)`` whose last ``period`` days hold nothing of ``measure``."""
    return trailing.where(F.col(f"{measure}_{period}d") == 0).select("entity", "day")
