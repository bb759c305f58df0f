"""Queries over node types, join kinds, sampling, step operations and flow services, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import quality
from sparkloom.operators import joins, relational
from sparkloom.plans.flow import Flow, register_callable
from sparkloom.plans.steps import compile_steps
from sparkloom.queries.relational import POINTS, place, rounded
from sparkloom.session import checkpoint_folder
from sparkloom.session import table as T
from sparkloom.sources import io
from sparkloom.streaming import windows

QUERIES: dict = {}


def query(name: str, sql: str | None):
    """Register a query."""

    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def one_node(spark: SparkSession, d: str, kind: str, tables: list[str], settings: dict, outputs: int = 1) -> list[DataFrame]:
    """The outputs of a flow of one node over whole tables."""
    outs = [f"out{i}" for i in range(outputs)]
    flow = Flow({"recipes": [{"name": "n", "type": kind, "inputs": tables, "outputs": outs, "settings": settings}]})
    made = flow.run(spark, {t: T(spark, d, t) for t in tables})
    return [made[o] for o in outs]


def node(name: str, kind: str, tables: list[str], settings: dict, columns: list[str], sql: str, digits: int = 4) -> None:
    QUERIES[f"node_{name}"] = (lambda spark, d: rounded(one_node(spark, d, kind, tables, settings)[0].select(*columns), digits), sql)


# --- node types ---
node("sync", "sync", ["nation"], {"columns": ["n_name", "n_nationkey", "note"]}, ["n_name", "n_nationkey", "note"], "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(NULL AS VARCHAR) AS note FROM nation")
node("push_to_editable", "push_to_editable", ["region"], {}, ["r_regionkey", "r_name"], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
node("generate_features", "generate_features", ["orders"], {}, ["o_orderkey", "o_orderdate_year", "o_orderdate_month", "o_orderdate_day_of_week", "o_orderpriority_length"], "SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, isodow(o_orderdate) AS o_orderdate_day_of_week, CAST(length(o_orderpriority) AS BIGINT) AS o_orderpriority_length FROM orders")
node("dynamic_repeat", "dynamic_repeat", ["supplier", "region"], {"steps": [{"type": "FilterOnFormula", "params": {"formula": 'val("s_nationkey") % 5 == ${r_regionkey}'}}, {"type": "FillColumn", "params": {"column": "run", "value": "${r_name}"}}]}, ["s_suppkey", "run"], "SELECT s_suppkey, r_name AS run FROM supplier JOIN region ON s_nationkey % 5 = r_regionkey")
for _kind in ("sql_script", "hive", "impala", "spark_sql_query"):
    node(_kind, _kind, ["customer", "nation"], {"views": ["c_view", "n_view"], "code": "select n_name, count(*) as n, sum(c_acctbal) as total from c_view join n_view on c_nationkey = n_nationkey group by n_name"}, ["n_name", "n", "total"], "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", 2)
register_callable("count_by_segment", lambda df: df.groupBy("c_mktsegment").count())
for _kind in ("python", "pyspark"):
    node(_kind, _kind, ["customer"], {"function": "count_by_segment"}, ["c_mktsegment", "count"], "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
node("fuzzyjoin", "fuzzyjoin", ["customer", "supplier"], {"join_keys": [{"left": "c_acctbal", "right": "s_acctbal"}], "distance_metric": "EUCLIDEAN", "threshold": 0.5, "join_type": "LEFT"}, ["l_c_custkey", "r_s_suppkey", "distance"], "SELECT c_custkey AS l_c_custkey, s_suppkey AS r_s_suppkey, round(abs(c_acctbal - s_acctbal), 4) AS distance FROM customer LEFT JOIN supplier ON abs(c_acctbal - s_acctbal) <= 0.5")


@query("node_list_folder_contents", "SELECT 'nation.parquet' AS name UNION ALL SELECT 'region.parquet'")
def list_folder(spark, d):
    out = NODES_LIST(spark, d)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name")).where("name in ('nation.parquet', 'region.parquet')")


def NODES_LIST(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return io.list_folder(spark, d).select("path")


@query("node_split_value", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS branch FROM orders")
def split_value(spark, d):
    parts = one_node(spark, d, "split", ["orders"], {"split_mode": "COLUMN_VALUE", "column": "o_orderstatus", "values": ["F", "O"]}, 3)
    return relational.stack([p.select("o_orderkey", F.lit(i).alias("branch")) for i, p in enumerate(parts)])


@query("node_split_percentile", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 ELSE 2 END AS branch FROM orders, q")
def split_percentile(spark, d):
    parts = relational.split(T(spark, d, "orders"), "PERCENTILE", column="o_totalprice", values=[0.25, 0.75])
    return relational.stack([p.select("o_orderkey", F.lit(i).alias("branch")) for i, p in enumerate(parts)])


@query("node_split_random", "SELECT count(*) AS n, true AS disjoint, true AS near FROM orders")
def split_random(spark, d):
    a, b = relational.split(T(spark, d, "orders"), "RANDOM", weights=[0.7, 0.3], key=["o_orderkey"])
    both = relational.stack([p.select("o_orderkey", F.lit(i).alias("branch")) for i, p in enumerate((a, b))])
    return both.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("o_orderkey") == F.count(F.lit(1))).alias("disjoint"), (F.abs(F.avg("branch") - 0.3) < 0.05).alias("near"))


# --- sampling: what holds for every sample of the kind ---


def _sampled(name: str, sql: str, check, **kw) -> None:
    QUERIES[f"sample_{name.lower()}"] = (lambda spark, d: check(relational.sample(T(spark, d, "customer"), name, key=["c_custkey"], **kw)), sql)


_SIZE = lambda df: df.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("c_custkey") == F.count(F.lit(1))).alias("once"))
_sampled("RANDOM_FIXED_NB", "SELECT CAST(100 AS BIGINT) AS n, true AS once", _SIZE, n=100)
_sampled("RESERVOIR", "SELECT CAST(70 AS BIGINT) AS n, true AS once", _SIZE, n=70)
_sampled("RANDOM_FIXED_RATIO", "SELECT true AS near", lambda df: df.agg((F.abs(F.count(F.lit(1)) / df.sparkSession.read.parquet(df.inputFiles()[0]).count() - 0.3) < 0.05).alias("near")), fraction=0.3)
_sampled("HEAD_SEQUENTIAL", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30", lambda df: df.select("c_custkey"), n=30, order=["c_acctbal", "c_custkey"])
_sampled("TAIL_SEQUENTIAL", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 30", lambda df: df.select("c_custkey"), n=30, order=["c_acctbal", "c_custkey"])
_sampled("STRATIFIED", "SELECT c_mktsegment, least(count(*), 20) AS n FROM customer GROUP BY 1", lambda df: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), n=20, column="c_mktsegment")
_sampled("CLASS_REBALANCE", "SELECT c_mktsegment, (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) AS n FROM customer GROUP BY 1", lambda df: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), column="c_mktsegment")
QUERIES["sample_stratified_share"] = (lambda spark, d: relational.sample(T(spark, d, "customer"), "STRATIFIED", fraction=0.25, column="c_mktsegment", key=["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "SELECT c_mktsegment, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM customer GROUP BY 1")

# --- join kinds ---


def _theta(kind: str, cond: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        r, n = T(spark, d, "region").select("r_regionkey"), T(spark, d, "nation").select("n_nationkey")
        return joins.join(n, r, [{"left": "n_nationkey", "right": "r_regionkey", "matchType": kind}], "ADVANCED")

    QUERIES[f"join_{kind.lower()}"] = (f, f"SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey {cond} r_regionkey")


for _k, _c in {"LTE": "<=", "LT": "<", "GTE": ">=", "GT": ">", "NE": "<>"}.items():
    _theta(_k, _c)


def _textual(kind: str, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        p = T(spark, d, "part").select("p_partkey", "p_type")
        words = T(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("word")).distinct()
        return joins.join(p, words, [{"left": "p_type", "right": "word", "matchType": kind}], "INNER").select("p_partkey", "word")

    QUERIES[f"join_{kind.lower()}"] = (f, f"WITH w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part) SELECT p_partkey, word FROM part JOIN w ON {sql}(p_type, word)")


_textual("CONTAINS", "contains")
_textual("STARTS_WITH", "starts_with")


@query("join_k_nearest", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), CAST(c_custkey AS VARCHAR)) AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE k <= 2")
def join_k_nearest(spark, d):
    keys = [{"left": "s_nationkey", "right": "c_nationkey"}, {"left": "s_acctbal", "right": "c_acctbal", "matchType": "K_NEAREST", "k": 2, "tie": "c_custkey"}]
    return joins.join(T(spark, d, "supplier"), T(spark, d, "customer"), keys, "INNER").select("s_suppkey", "c_custkey")


@query("join_k_nearest_inferior", "SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN (SELECT s_suppkey AS s, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY s_acctbal - c_acctbal, CAST(c_custkey AS VARCHAR)) AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal <= s_acctbal) ON s = s_suppkey AND k = 1")
def join_k_nearest_inferior(spark, d):
    keys = [{"left": "s_nationkey", "right": "c_nationkey"}, {"left": "s_acctbal", "right": "c_acctbal", "matchType": "K_NEAREST_INFERIOR", "tie": "c_custkey"}]
    return joins.join(T(spark, d, "supplier"), T(spark, d, "customer"), keys, "LEFT").select("s_suppkey", "c_custkey")


@query("asof_banded", "WITH c AS (SELECT event_id AS click_id, ts AS click_ts FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'click') WHERE r = 1) SELECT p.event_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.ts >= c.click_ts")
def asof_banded(spark, d):
    e = T(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "ts")
    c = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return joins.as_of(p, c, "ts", "click_ts", None, "backward", tie="click_id", band_rows=500).select("event_id", F.col("click_id_right").alias("click_id"))


NAMES = "SELECT DISTINCT p_name || ' ' || p_brand AS t FROM part"


def _fuzzy(metric: str, threshold: float, sql: str, **kw) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        names = T(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("t")).distinct()
        out = joins.fuzzy(names, names, "t", "t", threshold, metric, **kw)
        return rounded(out.select(F.col("l_t").alias("a"), F.col("r_t").alias("b"), F.col("distance").cast("double").alias("distance")), 6)

    QUERIES[f"fuzzy_{metric.lower()}{'_relative' if kw.get('relative') else ''}"] = (f, f"WITH n AS ({NAMES}), p AS (SELECT a.t AS a, b.t AS b FROM n a, n b) SELECT a, b, round(CAST({sql[0]} AS DOUBLE), 6) AS distance FROM p WHERE {sql[1]}")


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]))"
_A, _B = _GRAMS.format("a"), _GRAMS.format("b")
_fuzzy("LEVENSHTEIN", 1, ("levenshtein(a, b)", "levenshtein(a, b) <= 1"))
_fuzzy("LEVENSHTEIN", 0.1, ("levenshtein(a, b)", "levenshtein(a, b) <= floor(0.1 * greatest(length(a), length(b)) + 1e-9)"), relative=True)
_fuzzy("DAMERAU_LEVENSHTEIN", 1, ("damerau_levenshtein(a, b)", "damerau_levenshtein(a, b) <= 1"))
_fuzzy("HAMMING", 1, ("CASE WHEN length(a) = length(b) THEN hamming(a, b) END", "CASE WHEN length(a) = length(b) THEN hamming(a, b) <= 1 ELSE false END"))
_fuzzy("EQUALITY", 0, ("0", "a = b"))
_fuzzy("JACCARD", 0.15, (f"1 - len(list_intersect({_A}, {_B})) / (len({_A}) + len({_B}) - len(list_intersect({_A}, {_B})))", "distance <= 0.15 + 1e-12"))
_fuzzy("COSINE", 0.08, (f"1 - len(list_intersect({_A}, {_B})) / sqrt(len({_A}) * len({_B}))", "distance <= 0.08 + 1e-12"))


def _text_points(spark: SparkSession, d: str, name: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = place(k)
    return T(spark, d, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")).alias(name))


_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("fuzzy_geospatial", f"WITH p AS ({POINTS}) SELECT a.id AS a, b.id AS b FROM p a, p b WHERE {_KM} * 1000 <= 30000")
def fuzzy_geospatial(spark, d):
    p = _text_points(spark, d, "at")
    return joins.fuzzy(p, p, "at", "at", 30_000, "GEOSPATIAL").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


for _unit, _metres in joins.UNITS.items():
    QUERIES[f"geo_within_{_unit.lower()}"] = (lambda spark, d, u=_unit, m=_metres: (lambda p: rounded(joins.within_distance(p, p, ("lat", "lon"), ("lat", "lon"), 40_000 / m, u).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), (F.col("distance") * m / 1000).alias("km")), 3))(_text_points(spark, d, "at")), f"WITH p AS ({POINTS}), q AS (SELECT a.id AS a, b.id AS b, {_KM} AS km FROM p a, p b) SELECT a, b, round(km, 3) AS km FROM q WHERE km <= 40")


@query("geo_beyond_distance", f"WITH a AS ({POINTS}), b AS (SELECT n_nationkey AS id, n_nationkey * 3.0 AS lat, n_nationkey * 7.0 AS lon FROM nation) SELECT a.id AS a, CAST(b.id AS BIGINT) AS b FROM a, b WHERE {_KM} > 12000")
def geo_beyond(spark, d):
    n = T(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") * 3.0).alias("lat"), (F.col("n_nationkey") * 7.0).alias("lon"))
    out = joins.beyond_distance(_text_points(spark, d, "at").select("id", "lat", "lon"), n, ("lat", "lon"), ("lat", "lon"), 12_000, "KILOMETER")
    return out.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


# Boxes with whole corners; of a size that differs by row, so that they nest, touch and overlap.
BOX = {"x0": "(k * 37) % 100", "y0": "(k * 61) % 100", "w": "2 + k % 9 * 2"}
BOXES = f"SELECT s_suppkey AS id, {BOX['x0']} AS x0, {BOX['y0']} AS y0, {BOX['x0']} + {BOX['w']} AS x1, {BOX['y0']} + {BOX['w']} AS y1 FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)"
_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_INNER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_WITHIN = "a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    df = T(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k")).selectExpr("id", *[f"{e} as {n}" for n, e in BOX.items()])
    ring = "concat('POLYGON((', x0, ' ', y0, ', ', x0 + w, ' ', y0, ', ', x0 + w, ' ', y0 + w, ', ', x0, ' ', y0 + w, ', ', x0, ' ', y0, '))')"
    return df.selectExpr("id", f"{ring} as shape", "concat('POINT(', x0 + 1, ' ', y0 + 1, ')') as inner", "concat('LINESTRING(', x0 - 1, ' ', y0 + 1, ', ', x0 + w + 1, ' ', y0 + 1, ')') as line")


def _geo(kind: str, sql: str, right: str = "shape", box: str = "*") -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        b = _boxes(spark, d)
        return joins.geo_join(b, b, "shape", right, kind).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))

    QUERIES[f"geo_{kind.lower()}"] = (f, f"WITH s AS ({BOXES}) SELECT a.id AS a, b.id AS b FROM s a, (SELECT {box} FROM s) b WHERE {sql}")


_geo("INTERSECTS", _MEET)
_geo("DISJOINT", f"NOT ({_MEET})")
_geo("CONTAINS", "b.x0 > a.x0 AND b.x0 < a.x1 AND b.y0 > a.y0 AND b.y0 < a.y1", "inner", "id, x0 + 1 AS x0, y0 + 1 AS y0")
_geo("CROSSES", "a.y0 < b.y0 AND b.y0 < a.y1 AND b.x0 < a.x1 AND a.x0 < b.x1 AND (b.x0 < a.x0 OR b.x1 > a.x1)", "line", "id, x0 - 1 AS x0, x1 + 1 AS x1, y0 + 1 AS y0")

# --- aggregates and windows not in other queries ---


@query("aggregates_more", "SELECT o_orderstatus, mode(o_orderpriority) AS mode, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS words, array_to_string(list_sort(list(o_orderpriority)), ',') AS joined, round(list_sum(list_sort(list(o_totalprice))[1:3]), 4) AS least FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def aggregates_more(spark, d):
    specs = [("o_orderpriority", "MODE", "mode"), ("o_totalprice", "PERCENTILE_50", "p50"), ("o_orderpriority", "COLLECT_SET", "w"), ("o_orderpriority", "CONCAT", "joined"), ("o_totalprice", "COLLECT_LIST", "l")]
    g = relational.group(T(spark, d, "orders"), ["o_orderstatus"], [{"column": c, "type": k, "outputColumn": o} for c, k, o in specs])
    return rounded(g.select("o_orderstatus", "mode", "p50", F.array_join("w", "|").alias("words"), "joined", F.aggregate(F.slice("l", 1, 3), F.lit(0.0), lambda a, x: a + x).alias("least")))


@query("windows_more", "SELECT event_id, round(lead(value, 2) OVER w - value, 6) AS lead_diff, count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_count FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def windows_more(spark, d):
    e = T(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    out = relational.window(e, ["user_id"], ["ts", "event_id"], [{"type": "LEAD_DIFF", "column": "value", "windowSize": 2, "outputColumn": "lead_diff"}, {"type": "RUNNING_COUNT", "column": "value", "outputColumn": "running_count"}])
    return rounded(out.select("event_id", "lead_diff", "running_count"), 6)


@query("window_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def window_sliding(spark, d):
    w = windows.windowed(T(spark, d, "events"), "ts", [F.count(F.lit(1)).alias("n")], "12 hours", "6 hours")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# --- step operations ---

CONDS = {"formula": ('val("o_totalprice") > 100000 && val("o_orderstatus") == "F"', "o_totalprice > 100000 AND o_orderstatus = 'F'"), "gte": (100000, "o_totalprice >= 100000"), ">=": (100000, "o_totalprice >= 100000"), "greater_than": (100000, "o_totalprice > 100000"), "<": (100000, "o_totalprice < 100000"), "lt": (90000, "o_totalprice < 90000"), "<=": (80000, "o_totalprice <= 80000"), "lte": (70000, "o_totalprice <= 70000"), "contains": ("URGENT", "contains(o_orderpriority, 'URGENT')"), "substring": ("LOW", "contains(o_orderpriority, 'LOW')"), "regex": ("^[12]-", "regexp_matches(o_orderpriority, '^[12]-')"), "matches": ("HIGH$", "regexp_matches(o_orderpriority, 'HIGH$')"), "isin": (["5-LOW"], "o_orderpriority IN ('5-LOW')"), "!=": ("5-LOW", "o_orderpriority <> '5-LOW'"), "not_equals": ("2-HIGH", "o_orderpriority <> '2-HIGH'"), "equals": ("2-HIGH", "o_orderpriority = '2-HIGH'"), "starts_with": ("3", "starts_with(o_orderpriority, '3')")}


@query("steps_filters", " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE {sql}" for op, (_, sql) in CONDS.items()))
def steps_filters(spark, d):
    numeric = {"gte", ">=", "greater_than", "<", "lt", "<=", "lte"}
    parts = []
    for op, (value, _) in CONDS.items():
        flow = compile_steps({"steps": [{"operation": "filter", "input_dataset": "orders", "output_dataset": "o", "filter_conditions": [{"column": "o_totalprice" if op in numeric else "o_orderpriority", "operator": op, "value": value}]}]})
        parts.append(flow.run(spark, {"orders": T(spark, d, "orders")})["o"].agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("bigint").alias("keys")))
    return relational.stack(parts)


def _steps(name: str, table: str, steps: list[dict], columns: list[str], sql: str, digits: int = 4) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        chained = [{"operation": "read_data", "output_dataset": table}]
        for i, s in enumerate(steps):
            chained.append({"input_dataset": table if i == 0 else f"s{i}", "output_dataset": f"s{i + 1}", **s})
        out = compile_steps({"steps": chained}).run(spark, {t: T(spark, d, t) for t in {table, "nation", "region", "supplier", "customer"}})
        return rounded(out[f"s{len(steps)}"].select(*columns), digits)

    QUERIES[f"steps_{name}"] = (f, sql)


_steps("columns", "part", [{"operation": "select_columns", "columns": ["p_partkey", "p_name", "p_size", "p_type"]}, {"operation": "drop_columns", "columns": ["p_type"]}, {"operation": "rename_columns", "rename_mapping": {"p_name": "name"}}, {"operation": "add_column", "column_transforms": [{"output_column": "twice", "expression": 'val("p_size") * 2'}]}, {"operation": "transform_column", "column_transforms": [{"column": "name", "operation": "upper"}, {"column": "p_size", "operation": "add", "value": 1, "output_column": "next"}]}, {"operation": "cast_type", "column_transforms": [{"column": "p_size", "type": "string"}]}], ["p_partkey", "name", "p_size", "twice", "next"], "SELECT p_partkey, upper(p_name) AS name, CAST(p_size AS VARCHAR) AS p_size, CAST(p_size * 2 AS BIGINT) AS twice, CAST(p_size + 1 AS BIGINT) AS next FROM part")
_steps("missing", "events", [{"operation": "add_column", "column_transforms": [{"output_column": "v", "expression": "if(event_id % 3 == 0, null, value)"}, {"output_column": "w", "expression": "if(event_id % 5 == 0, null, event_type)"}]}, {"operation": "fill_missing", "columns": ["w"], "fill_value": "none"}, {"operation": "drop_missing", "columns": ["v"]}, {"operation": "drop_duplicates", "columns": ["user_id", "w"], "sort_columns": ["event_id"]}], ["event_id", "user_id", "w"], "SELECT min(event_id) AS event_id, user_id, w FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE event_type END AS w FROM events WHERE event_id % 3 <> 0) GROUP BY user_id, w")
_steps("windows", "orders", [{"operation": "window_function", "partition_columns": ["o_custkey"], "sort_columns": ["o_orderkey"], "aggregations": [{"column": "o_totalprice", "function": "RUNNING_SUM", "output_column": "run"}]}, {"operation": "top_n", "n": 2, "sort_columns": [{"column": "run", "order": "desc"}], "group_by_columns": ["o_custkey"]}], ["o_orderkey", "run"], "SELECT o_orderkey, round(run, 4) AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY run DESC) AS k FROM (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)) WHERE k <= 2")
_steps("shapes", "orders", [{"operation": "pivot", "row_columns": ["o_orderpriority"], "pivot_column": "o_orderstatus", "value_column": "o_totalprice", "aggregation": "SUM", "modalities": ["F", "O"]}, {"operation": "unpivot", "columns": ["F_o_totalprice_sum", "O_o_totalprice_sum"], "var_name": "what", "value_name": "total"}], ["o_orderpriority", "what", "total"], "SELECT o_orderpriority, o_orderstatus || '_o_totalprice_sum' AS what, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2", 2)
_steps("dates", "orders", [{"operation": "add_column", "column_transforms": [{"output_column": "t", "expression": 'concat("2024/0", o_orderkey % 9 + 1, "/15")'}]}, {"operation": "parse_date", "column_transforms": [{"column": "t", "format": "yyyy/MM/dd"}]}, {"operation": "split_column", "column_transforms": [{"column": "o_orderpriority", "separator": "-", "output_columns": ["rank", "word"]}]}, {"operation": "add_column", "column_transforms": [{"output_column": "m", "expression": "month(t)"}]}], ["o_orderkey", "m", "rank", "word"], "SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS BIGINT) AS m, split_part(o_orderpriority, '-', 1) AS rank, split_part(o_orderpriority, '-', 2) AS word FROM orders")
_steps("encode_scale", "customer", [{"operation": "encode_categorical", "columns": ["c_mktsegment"], "encoding": "ONE_HOT"}, {"operation": "normalize_scale", "columns": ["c_acctbal"], "mode": "MIN_MAX"}], ["c_custkey", "c_mktsegment_BUILDING", "c_acctbal_normalised"], "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS \"c_mktsegment_BUILDING\", round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 4) AS c_acctbal_normalised FROM customer")
_steps("union_stats", "nation", [{"operation": "union", "input_datasets": ["nation", "nation"]}, {"operation": "statistics", "columns": ["n_nationkey"]}], ["column_name", "n", "mean", "min", "max"], "SELECT 'n_nationkey' AS column_name, count(*) AS n, round(avg(n_nationkey), 4) AS mean, CAST(min(n_nationkey) AS DOUBLE) AS min, CAST(max(n_nationkey) AS DOUBLE) AS max FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)")
_steps("sample_custom", "customer", [{"operation": "sample", "method": "RANDOM_FIXED_NB", "n": 40, "key": ["c_custkey"]}, {"operation": "custom_function", "function": "count_rows"}], ["n"], "SELECT CAST(40 AS BIGINT) AS n")
_steps("geo", "supplier", [{"operation": "add_column", "column_transforms": [{"output_column": "lat", "expression": "s_suppkey % 80"}, {"output_column": "lon", "expression": "s_suppkey % 170"}]}, {"operation": "geo_operation", "columns": ["lat", "lon"], "output_column": "p"}], ["s_suppkey", "p"], "SELECT s_suppkey, 'POINT(' || s_suppkey % 170 || ' ' || s_suppkey % 80 || ')' AS p FROM supplier")
register_callable("count_rows", lambda df: df.agg(F.count(F.lit(1)).alias("n")))

# --- sources and sinks ---


def _round_trip(fmt: str, **options) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        path = os.path.join(checkpoint_folder(spark), f"sink-{uuid.uuid4().hex}")
        p = T(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(', "quoted"; ü')).alias("name"), "p_retailprice", "p_brand")
        io.write(p, {"format": fmt, "path": path, **options})
        back = io.read(spark, {"connection": "Filesystem", "format": fmt, "path": path, "schema": "p_partkey bigint, name string, p_retailprice double, p_brand string", "columns": ["p_partkey", "name", "p_retailprice", "p_brand"]})
        return rounded(back)

    QUERIES[f"io_{fmt}"] = (f, "SELECT p_partkey, p_name || ', \"quoted\"; ü' AS name, round(p_retailprice, 4) AS p_retailprice, p_brand FROM part")


_round_trip("csv")
_round_trip("parquet", partition_by=["p_brand"])
_round_trip("json")
_round_trip("orc")


@query("steps_write", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, upper(r_name) AS r_name FROM region")
def steps_write(spark, d):
    path = os.path.join(checkpoint_folder(spark), f"sink-{uuid.uuid4().hex}")
    doc = {"steps": [{"operation": "read_data", "output_dataset": "region"}, {"operation": "transform_column", "input_dataset": "region", "output_dataset": "up", "column_transforms": [{"column": "r_name", "operation": "upper"}]}, {"operation": "write_data", "input_dataset": "up", "write": {"format": "parquet", "path": path}}]}
    flow = compile_steps(doc)
    flow.store(flow.run(spark, {"region": T(spark, d, "region")}))
    return rounded(spark.read.parquet(path).select("r_regionkey", "r_name"))


# --- quality ---


@query("quality_checks", "SELECT condition, outcome FROM (VALUES ('EQUALS', 'ERROR'), ('NOT_EQUALS', 'OK'), ('GREATER_THAN', 'OK'), ('GREATER_OR_EQUAL', 'OK'), ('LESS_THAN', 'WARNING'), ('LESS_OR_EQUAL', 'WARNING'), ('BETWEEN', 'OK'), ('NOT_EMPTY', 'OK')) t(condition, outcome)")
def quality_checks(spark, d):
    made = quality.run_checks(T(spark, d, "orders"), [{"metric": "ROW_COUNT", "condition": c, "target": 1, "high": 10**12, "severity": "WARNING" if c.startswith("LESS") else "ERROR"} for c in ("EQUALS", "NOT_EQUALS", "GREATER_THAN", "GREATER_OR_EQUAL", "LESS_THAN", "LESS_OR_EQUAL", "BETWEEN", "NOT_EMPTY")])
    return spark.createDataFrame([(c["condition"], c["outcome"]) for c in made], "condition string, outcome string")


@query("quality_rules", "SELECT o_orderkey FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-') OR o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def quality_rules(spark, d):
    return quality.failed_rows(T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), [{"type": "regex_match", "column": "o_orderpriority", "pattern": "^[1-4]-"}, {"type": "unique", "column": "o_custkey"}]).select("o_orderkey")


_DRIFT = """WITH a AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM a),
 k AS (SELECT i AS bucket, (SELECT count(*) FROM a WHERE (SELECT count(*) FROM c WHERE cut < v) = i) AS x, (SELECT count(*) FROM b WHERE (SELECT count(*) FROM c WHERE cut < v) = i) AS y FROM range(10) t(i)),
 s AS (SELECT *, x / sum(x) OVER () AS p, y / sum(y) OVER () AS q, sum(y) OVER () AS m FROM k), g AS (SELECT *, abs(sum(p) OVER w - sum(q) OVER w) AS gap FROM s WINDOW w AS (ORDER BY bucket))
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, round(max(gap), 6) AS ks, round(sum(pow(y - p * m, 2) / (p * m)), 4) AS chi_square FROM g"""


@query("quality_drift", _DRIFT)
def quality_drift(spark, d):
    o = T(spark, d, "orders")
    out = quality.drift(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice")
    return out.select(F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), F.round("chi_square", 4).alias("chi_square"))


@query("quality_wasserstein", "WITH v AS (SELECT o_totalprice AS v, CASE WHEN o_orderstatus = 'F' THEN 1.0 / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') ELSE -1.0 / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') END AS s FROM orders WHERE o_orderstatus IN ('F', 'O')), g AS (SELECT v, sum(s) AS s FROM v GROUP BY v), c AS (SELECT v, sum(s) OVER (ORDER BY v) AS f, lead(v) OVER (ORDER BY v) AS n FROM g) SELECT round(sum(abs(f) * (n - v)), 2) AS wasserstein FROM c")
def quality_wasserstein(spark, d):
    o = T(spark, d, "orders")
    return quality.wasserstein(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice").select(F.round("wasserstein", 2).alias("wasserstein"))


# --- models that have a closed form ---


@query("model_regression", "WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i, regr_r2(p_retailprice, p_size) AS r2 FROM part), e AS (SELECT p_retailprice - (i + s * p_size) AS e FROM part, f) SELECT 'rmse' AS metric, round(sqrt(avg(e * e)), 4) AS value FROM e UNION ALL SELECT 'mae', round(avg(abs(e)), 4) FROM e UNION ALL SELECT 'r2', round(r2, 4) FROM f")
def model_regression(spark, d):
    from sparkloom.functions import ml

    p = T(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("label"))
    m = ml.fit(p, ["p_size"], "linear")
    flow = Flow({"recipes": [{"name": "s", "type": "prediction_scoring", "inputs": ["p"], "outputs": ["scored"], "settings": {"model": m}}, {"name": "e", "type": "standalone_evaluation", "inputs": ["scored"], "outputs": ["figures"], "settings": {"kind": "regression", "label": "label"}}]})
    return rounded(flow_run(flow, spark, p))


def flow_run(flow: Flow, spark: SparkSession, p: DataFrame) -> DataFrame:
    """The figures of a flow that holds a model, which must not be copied with its settings."""
    return flow.run(spark, {"p": p})["figures"]


@query("model_clusters", "SELECT CAST(3 AS BIGINT) AS clusters, true AS apart")
def model_clusters(spark, d):
    from sparkloom.functions import ml

    c = T(spark, d, "supplier").select("s_suppkey", (F.pmod("s_suppkey", F.lit(3)) * 100.0 + F.pmod("s_suppkey", F.lit(7))).alias("x"), F.pmod("s_suppkey", F.lit(3)).alias("truth"))
    scored = ml.score(c, {"model": ml.fit(c, ["x"], "kmeans", k=3, seed=7)})
    return scored.groupBy("truth").agg(F.count_distinct("prediction").alias("n")).agg(F.count(F.lit(1)).alias("clusters"), (F.max("n") == 1).alias("apart"))


# --- services of a flow ---

GRAPH = {"name": "g", "datasets": [{"name": n} for n in ("a", "b", "c", "d", "lone")], "recipes": [{"name": "r1", "type": "prepare", "inputs": ["a"], "outputs": ["b"], "settings": {"steps": [{"type": "ColumnRenamer", "params": {"renamings": {"x": "y"}}}, {"type": "CreateColumnWithGREL", "params": {"column": "z", "expression": 'val("y") + w'}}]}}, {"name": "r2", "type": "sync", "inputs": ["b"], "outputs": ["c"]}, {"name": "r3", "type": "grouping", "inputs": ["b"], "outputs": ["d"], "settings": {"keys": [], "aggregations": [{"column": "z", "type": "SUM", "outputColumn": "s"}]}}]}
SERVICES = {"order": "r1 r2 r3", "roots": "a lone", "leaves": "c d lone", "components": "2", "path": "a b d", "findings": "warning:orphan", "complexity": "4.6", "lineage": "d.s b.z a.w a.x", "removed": "r3", "round_trip": "true", "summary": "g: 5 datasets, 3 nodes, complexity 4.6", "text": "a --[prepare]--> b / b --[sync]--> c / b --[grouping]--> d"}


@query("flow_services", " UNION ALL ".join(f"SELECT '{k}' AS service, '{v}' AS result" for k, v in SERVICES.items()))
def flow_services(spark, d):
    g = Flow(GRAPH)
    less = Flow({**GRAPH, "recipes": GRAPH["recipes"][:2]})
    findings = [f for f in g.validate()]
    got = {
        "order": " ".join(r["name"] for r in g.order()), "roots": " ".join(g.roots()), "leaves": " ".join(g.leaves()), "components": str(len(g.components())), "path": " ".join(g.path("a", "d")), "findings": " ".join(f"{f['level']}:{f['code']}" for f in findings) , "complexity": str(g.complexity()),
        "lineage": " ".join(f"{a}.{b}" for a, b in g.column_lineage("d", "s")), "removed": " ".join(g.diff(less)["removed"]), "round_trip": str(Flow.from_yaml(g.to_yaml()).to_json() == Flow.from_json(g.to_json()).to_json() == g.to_json()).lower(), "summary": g.summary(), "text": g.ascii().replace("\n", " / "),
    }
    return spark.createDataFrame(sorted(got.items()), "service string, result string")
