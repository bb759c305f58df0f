"""Metrics, checks, quality rules and drift between two tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import UnsupportedError
from sparkloom.functions.formula import quoted
from sparkloom.session import written


def metric(kind: str, column: str | None = None) -> Column:
    """One metric as an aggregate."""
    c = F.col(quoted(column)) if column else None
    table = {
        "ROW_COUNT": lambda: F.count(F.lit(1)), "COLUMN_MIN": lambda: F.min(c), "COLUMN_MAX": lambda: F.max(c), "COLUMN_AVG": lambda: F.avg(c), "COLUMN_SUM": lambda: F.sum(c), "COLUMN_STDDEV": lambda: F.stddev_samp(c),
        "COLUMN_DISTINCT": lambda: F.count_distinct(c), "COLUMN_MISSING": lambda: F.count_if(c.isNull() | (c.cast("string") == "")),
    }
    if kind not in table:
        raise UnsupportedError(f"metric {kind}")
    return table[kind]()


def metrics(df: DataFrame, wanted: list[dict]) -> DataFrame:
    """``(metric, column_name, value)`` of all wanted metrics in one pass."""
    cols = [F.struct(F.lit(m["type"]).alias("metric"), F.lit(m.get("column")).cast("string").alias("column_name"), metric(m["type"], m.get("column")).cast("double").alias("value")) for m in wanted]
    return df.agg(F.array(*cols).alias("m")).select(F.inline("m"))


def holds(value: Any, condition: str, target: Any = None, high: Any = None) -> bool:
    """Whether a metric's value meets a check."""
    table = {
        "EQUALS": lambda: value == target, "NOT_EQUALS": lambda: value != target, "GREATER_THAN": lambda: value is not None and value > target, "GREATER_OR_EQUAL": lambda: value is not None and value >= target,
        "LESS_THAN": lambda: value is not None and value < target, "LESS_OR_EQUAL": lambda: value is not None and value <= target, "BETWEEN": lambda: value is not None and target <= value <= high, "NOT_EMPTY": lambda: value is not None and value > 0,
    }
    if condition not in table:
        raise UnsupportedError(f"check {condition}")
    return bool(table[condition]())


def run_checks(df: DataFrame, checks: list[dict]) -> list[dict]:
    """Outcome of each check: ``OK``, ``WARNING`` or ``ERROR``; one pass over the data."""
    row = df.agg(*[metric(c["metric"], c.get("column")).alias(f"m{i}") for i, c in enumerate(checks)]).first()
    return [{**c, "value": row[i], "outcome": "OK" if holds(row[i], c["condition"], c.get("target"), c.get("high")) else c.get("severity", "ERROR")} for i, c in enumerate(checks)]


def rule(r: dict) -> Column:
    """Whether a row breaks a rule."""
    c = F.col(quoted(r["column"]))
    kind = r["type"]
    if kind == "not_null":
        return c.isNull()
    if kind == "unique":
        return c.isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy(c)) > 1)
    if kind == "in_range":
        x = c.try_cast("double")
        low = x < r["min"] if r.get("min") is not None else F.lit(False)
        return c.isNotNull() & F.coalesce(low | (x > r["max"] if r.get("max") is not None else F.lit(False)), F.lit(True))
    if kind == "regex_match":
        return c.isNotNull() & ~c.cast("string").rlike(r["pattern"])
    if kind == "in_set":
        return c.isNotNull() & ~c.isin(r["values"])
    raise UnsupportedError(f"rule {kind}")


def failed_rows(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that break a rule, with the names of the rules broken."""
    marks = [F.when(rule(r), F.lit(r.get("name") or f"{r['type']}:{r['column']}")) for r in rules]
    return df.withColumn("failed_rules", F.array_compact(F.array(*marks))).where(F.size("failed_rules") > 0)


def drift(old: DataFrame, new: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Population stability, Kolmogorov-Smirnov distance and chi-square between two samples.

    Buckets are the deciles of ``old``; both sides are counted by bucket, nothing else is moved.
    """
    c = F.col(quoted(column)).cast("double")
    cuts = sorted(set(old.agg(F.percentile(c, F.array(*[F.lit(i / n) for i in range(1, n)]))).first()[0] or []))
    code = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        code = F.when(c <= cuts[i], i).otherwise(code)
    count = lambda df, name: df.where(c.isNotNull()).groupBy(code.alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    both = count(old, "a").join(count(new, "b"), "bucket", "full").fillna(0)
    tot = both.agg(F.sum("a"), F.sum("b")).first()
    p, q = F.greatest(F.col("a") / F.lit(tot[0] or 1), F.lit(1e-6)), F.greatest(F.col("b") / F.lit(tot[1] or 1), F.lit(1e-6))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    gap = F.abs(F.sum(F.col("a") / F.lit(tot[0] or 1)).over(w) - F.sum(F.col("b") / F.lit(tot[1] or 1)).over(w))
    rows = both.select(((q - p) * F.ln(q / p)).alias("psi"), gap.alias("ks"), F.try_divide(F.pow(F.col("b") - p * F.lit(tot[1] or 1), 2), p * F.lit(tot[1] or 1)).alias("chi"))
    return rows.agg(F.sum("psi").alias("psi"), F.max("ks").alias("ks"), F.sum("chi").alias("chi_square"))


def wasserstein(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Area between the two distribution functions: the least work to turn one sample into the other.

    Values are counted first; the running difference is taken in ranges of values, each range adding
    to what the ranges before have left, so that no task sorts all of them.
    """
    c = F.col(quoted(column)).cast("double")
    n, m = (max(1, x.where(c.isNotNull()).count()) for x in (old, new))
    signed = lambda df, s: df.where(c.isNotNull()).groupBy(c.alias("v")).agg((F.count(F.lit(1)) * F.lit(s)).alias("s"))
    both = signed(old, 1.0 / n).unionByName(signed(new, -1.0 / m)).groupBy("v").agg(F.sum("s").alias("s"))
    parted = written(both.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "wasserstein")
    parts = parted.groupBy("p").agg(F.sum("s").alias("t"), F.min("v").alias("lo"))
    over = Window.orderBy("p")  # one row per range
    parts = parts.select("p", (F.sum("t").over(over) - F.col("t")).alias("base"), F.lead("lo").over(over).alias("until"))
    within = Window.partitionBy("p").orderBy("v")
    run = parted.join(F.broadcast(parts), "p").select((F.sum("s").over(within) + F.col("base")).alias("f"), (F.coalesce(F.lead("v").over(within), "until") - F.col("v")).alias("w"))
    return run.agg(F.coalesce(F.sum(F.abs("f") * F.col("w")), F.lit(0.0)).alias("wasserstein"))


def run_scenario(spark, flow, scenario: dict, inputs: dict[str, DataFrame] | None = None) -> list[dict]:
    """Run the steps of a scenario in order: ``build`` (compute datasets and write those with a sink),
    ``check`` (checks of one dataset) and ``sql``. A step that fails ends the run unless it has
    ``proceed``; later steps come out as ``SKIPPED``. Triggers and reporters are kept as they are.
    """
    made: dict[str, DataFrame] = dict(inputs or {})
    out, stopped = [], False
    for step in scenario.get("steps") or []:
        kind = str(step.get("type", "")).lower()
        if stopped:
            out.append({"name": step.get("name"), "type": kind, "outcome": "SKIPPED"})
            continue
        result: dict[str, Any] = {"name": step.get("name"), "type": kind}
        if kind == "build":
            made = flow.run(spark, inputs)
            result |= {"written": flow.store(made), "outcome": "OK"}
        elif kind == "check":
            checks = run_checks(made[step["dataset"]], step["checks"])
            worst = {c["outcome"] for c in checks}
            result |= {"checks": checks, "outcome": "ERROR" if "ERROR" in worst else "WARNING" if "WARNING" in worst else "OK"}
        elif kind == "sql":
            made[step["name"]] = spark.sql(step["code"], **{k: made[k] for k in step.get("tables", [])})
            result["outcome"] = "OK"
        else:
            raise UnsupportedError(f"scenario step {kind!r}")
        stopped = result["outcome"] == "ERROR" and not step.get("proceed")
        out.append(result)
    return out
