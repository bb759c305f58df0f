"""Queries over structural nodes, joins, aggregates, windows and front ends, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import quality
from sparkloom.operators import joins, relational
from sparkloom.plans.flow import Flow
from sparkloom.plans.pandas_source import compile_source
from sparkloom.plans.steps import compile_steps
from sparkloom.session import table as T
from sparkloom.streaming import windows

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    """Doubles rounded and whole numbers as bigint, so that sums in any order compare equal."""
    kinds = {"int": lambda c: F.col(c).cast("bigint"), "smallint": lambda c: F.col(c).cast("bigint"), "double": lambda c: F.round(F.col(c), n)}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


# --- flows ---

FLAGSHIP = {
    "name": "pricing",
    "datasets": [{"name": "lineitem"}],
    "recipes": [
        {"name": "prepare", "type": "prepare", "inputs": ["lineitem"], "outputs": ["items"], "settings": {"steps": [
            {"type": "FilterOnFormula", "params": {"formula": 'val("l_quantity") > 0 && val("l_discount") <= 0.08'}},
            {"type": "CreateColumnWithGREL", "params": {"column": "revenue", "expression": 'val("l_extendedprice") * (1 - val("l_discount"))'}},
        ]}},
        {"name": "group", "type": "grouping", "inputs": ["items"], "outputs": ["summary"], "settings": {"keys": ["l_returnflag", "l_linestatus"], "aggregations": [
            {"column": "l_quantity", "type": "SUM", "outputColumn": "sum_qty"}, {"column": "revenue", "type": "SUM", "outputColumn": "revenue"}, {"column": "l_extendedprice", "type": "AVG", "outputColumn": "avg_price"}, {"column": None, "type": "SIZE", "outputColumn": "n"},
        ]}},
        {"name": "sort", "type": "sort", "inputs": ["summary"], "outputs": ["sorted"], "settings": {"sort_columns": ["l_returnflag", "l_linestatus"]}},
    ],
}


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_discount <= 0.08 GROUP BY 1, 2")
def flow_pricing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Flow(FLAGSHIP).run(spark, {"lineitem": T(spark, d, "lineitem")})["sorted"], 2)


STEPS = {"steps": [
    {"operation": "read_data", "output_dataset": "orders"},
    {"operation": "filter", "input_dataset": "orders", "output_dataset": "o1", "filter_conditions": [{"column": "o_totalprice", "operator": ">", "value": 1000}, {"column": "o_orderstatus", "operator": "in", "value": ["F", "O"]}]},
    {"operation": "join", "input_datasets": ["o1", "customer"], "output_dataset": "o2", "join_type": "inner", "join_conditions": [{"left_column": "o_custkey", "right_column": "c_custkey"}]},
    {"operation": "group_aggregate", "input_dataset": "o2", "output_dataset": "o3", "group_by_columns": ["c_mktsegment"], "aggregations": [{"column": "o_totalprice", "function": "sum", "output_column": "total"}, {"column": "o_orderkey", "function": "count", "output_column": "n"}]},
    {"operation": "sort", "input_dataset": "o3", "output_dataset": "o4", "sort_columns": [{"column": "total", "order": "desc"}]},
]}


@query("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def steps_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compile_steps(STEPS).run(spark, {"orders": T(spark, d, "orders"), "customer": T(spark, d, "customer")})["o4"], 2)


SOURCE = '''
import pandas as pd
import numpy as np
items = pd.read_csv("lineitem.csv")
orders = pd.read_parquet("orders.parquet")
items = items.dropna(subset=["l_quantity"])
items["revenue"] = items["l_extendedprice"] * (1 - items["l_discount"])
items["size"] = np.where(items["l_quantity"] >= 25, "large", "small")
big = items[(items["l_returnflag"].isin(["A", "R"])) & (items["revenue"] > 500)]
joined = big.merge(orders, left_on="l_orderkey", right_on="o_orderkey", how="inner")
out = joined.groupby(["size", "o_orderpriority"]).agg(revenue=("revenue", "sum"), n=("l_orderkey", "count"), items=("l_partkey", "nunique"))
out = out.sort_values(["size", "revenue"], ascending=[True, False])
'''


@query("""SELECT CASE WHEN l_quantity >= 25 THEN 'large' ELSE 'small' END AS size, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, count(DISTINCT l_partkey) AS items
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_extendedprice * (1 - l_discount) > 500 GROUP BY 1, 2""")
def source_priorities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compile_source(SOURCE, {"lineitem": T(spark, d, "lineitem"), "orders": T(spark, d, "orders")})["out"], 2)


SOURCE_WINDOWS = '''
import pandas as pd
e = pd.read_parquet("events.parquet")
e = e.sort_values(["user_id", "ts", "event_id"])
e["running"] = e.groupby("user_id")["value"].cumsum()
e["before"] = e.groupby("user_id")["value"].shift(1)
e["mean3"] = e.groupby("user_id")["value"].rolling(3).mean()
e["kind"] = e["event_type"].str.upper().str.strip()
e["place"] = e.groupby("user_id")["value"].rank(method="dense", ascending=False)
out = e[["event_id", "running", "before", "mean3", "kind", "place"]]
'''


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS running, round(lag(value) OVER w, 4) AS "before", round(CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) END, 4) AS mean3,
 upper(trim(event_type)) AS kind, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def source_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compile_source(SOURCE_WINDOWS, {"events": T(spark, d, "events")})["out"])


# --- joins ---

KEY = [{"left": "o_custkey", "right": "c_custkey"}]


def _join_query(how: str, sql: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        c = T(spark, d, "customer").where("c_acctbal > 3000").select("c_custkey", "c_mktsegment")
        o = T(spark, d, "orders").where("o_totalprice > 20000").select("o_orderkey", "o_custkey")
        return joins.join(o, c, KEY, how)

    QUERIES[f"join_{how.lower()}"] = (f, f"WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 20000), c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 3000) {sql}")


for _how, _sql in {"INNER": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "OUTER": "FULL JOIN"}.items():
    _join_query(_how, f"SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM o {_sql} c ON o_custkey = c_custkey")
_join_query("LEFT_ANTI", "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey)")
_join_query("RIGHT_ANTI", "SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE c_custkey = o_custkey)")
_join_query("LEFT_SEMI", "SELECT * FROM o WHERE EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey)")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return joins.join(T(spark, d, "region").select("r_name"), T(spark, d, "nation").select("n_name"), [], "CROSS")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON abs(s_acctbal - p_retailprice) <= 20")
def join_within_range(spark, d):
    return joins.join(T(spark, d, "supplier"), T(spark, d, "part"), [{"left": "s_acctbal", "right": "p_retailprice", "matchType": "WITHIN_RANGE", "distance": 20.0}], "INNER").select("s_suppkey", "p_partkey")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_chain(spark, d):
    flow = Flow({"recipes": [
        {"name": "j", "type": "join", "inputs": ["customer", "nation", "region"], "outputs": ["x"], "settings": {"joins": [{"type": "INNER", "keys": [{"left": "c_nationkey", "right": "n_nationkey"}]}, {"type": "INNER", "keys": [{"left": "n_regionkey", "right": "r_regionkey"}]}]}},
        {"name": "g", "type": "grouping", "inputs": ["x"], "outputs": ["y"], "settings": {"keys": ["n_name", "r_name"], "aggregations": [{"column": None, "type": "SIZE", "outputColumn": "customers"}]}},
    ]})
    return flow.run(spark, {t: T(spark, d, t) for t in ("customer", "nation", "region")})["y"]


AS_OF = "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts AS click_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'click') WHERE rn = 1) "


def _as_of(direction: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        e = T(spark, d, "events")
        p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        c = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
        return joins.as_of(p, c, "ts", "click_ts", ["user_id"], direction, tie="click_id").select("event_id", F.col("click_id_right").alias("click_id"))

    return f


QUERIES["asof_backward"] = (_as_of("backward"), AS_OF + "SELECT p.event_id, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.click_ts")
QUERIES["asof_forward"] = (_as_of("forward"), AS_OF + "SELECT p.event_id, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.click_ts")
QUERIES["asof_nearest"] = (_as_of("nearest"), AS_OF + """, b AS (SELECT p.event_id, p.ts, c.click_id, c.click_ts FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.click_ts), f AS (SELECT p.event_id, c.click_id, c.click_ts FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.click_ts)
 SELECT b.event_id, CASE WHEN f.click_ts IS NULL OR b.ts - b.click_ts <= f.click_ts - b.ts THEN b.click_id ELSE coalesce(f.click_id, b.click_id) END AS click_id FROM b JOIN f USING (event_id)""")


@query("SELECT s_suppkey, c_custkey, round(gap, 4) AS gap, nearest_rank FROM (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), CAST(c_custkey AS VARCHAR)) AS nearest_rank FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE nearest_rank <= 3")
def k_nearest(spark, d):
    out = joins.k_nearest(T(spark, d, "supplier"), T(spark, d, "customer"), "s_suppkey", "s_acctbal", "c_acctbal", [("s_nationkey", "c_nationkey")], 3, tie="c_custkey")
    return rounded(out.select("s_suppkey", F.col("c_custkey_right").alias("c_custkey"), "gap", "nearest_rank"))


POINTS = "SELECT c_custkey AS id, ((c_custkey * 7919) % 18000) / 100.0 - 90.0 AS lat, ((c_custkey * 104729) % 36000) / 100.0 - 180.0 AS lon FROM customer"


def place(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of POINTS. Keys are reduced before they are multiplied, which gives the same
    remainders and does not overflow, however large the keys or narrow their type."""
    at = lambda by, n: (key.cast("bigint") % n * by) % n / 100.0
    return at(7919, 18000) - 90.0, at(104729, 36000) - 180.0


@query(f"""WITH p AS ({POINTS}), q AS (SELECT a.id AS a, b.id AS b, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM p a, p b)
 SELECT a, b, round(km, 3) AS km FROM q WHERE km <= 60.0""")
def geo_within_distance(spark, d):
    k = F.col("c_custkey")
    lat, lon = place(k)
    p = T(spark, d, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))
    out = joins.within_distance(p, p, ("lat", "lon"), ("lat", "lon"), 60.0, "KILOMETER")
    return out.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("distance", 3).alias("km"))


# --- aggregates, windows, shape ---

AGGS = {"SUM": "sum(l_quantity)", "AVG": "avg(l_quantity)", "COUNT": "count(l_quantity)", "COUNTD": "count(DISTINCT l_quantity)", "MIN": "min(l_quantity)", "MAX": "max(l_quantity)", "STDDEV": "stddev_samp(l_quantity)", "VAR": "var_samp(l_quantity)", "MEDIAN": "median(l_quantity)", "PERCENTILE_25": "quantile_cont(l_quantity, 0.25)", "PERCENTILE_75": "quantile_cont(l_quantity, 0.75)", "PERCENTILE_90": "quantile_cont(l_quantity, 0.9)", "PERCENTILE_95": "quantile_cont(l_quantity, 0.95)", "PERCENTILE_99": "quantile_cont(l_quantity, 0.99)"}


@query("SELECT l_returnflag, " + ", ".join(f"{'' if k.startswith('COUNT') else 'round('}{v}{'' if k.startswith('COUNT') else ', 4)'} AS {k.lower()}" for k, v in AGGS.items()) + " FROM lineitem GROUP BY 1")
def aggregates(spark, d):
    return rounded(relational.group(T(spark, d, "lineitem"), ["l_returnflag"], [{"column": "l_quantity", "type": k, "outputColumn": k.lower()} for k in AGGS]))


@query("SELECT p_brand, min_by(p_name, p_partkey) AS first_name, max_by(p_name, p_partkey) AS last_name, array_to_string(list_sort(list(DISTINCT CAST(p_size AS VARCHAR))), ',') AS sizes, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 5")
def aggregates_lists(spark, d):
    g = relational.group(T(spark, d, "part"), ["p_brand"], [{"column": "p_name", "type": "FIRST", "order": "p_partkey", "outputColumn": "first_name"}, {"column": "p_name", "type": "LAST", "order": "p_partkey", "outputColumn": "last_name"}, {"column": "p_size", "type": "COLLECT_SET", "outputColumn": "s"}, {"column": None, "type": "SIZE", "outputColumn": "n"}], post_filter='val("n") > 5')
    return g.select("p_brand", "first_name", "last_name", F.array_join(F.array_sort(F.col("s").cast("array<string>")), ",").alias("sizes"), "n")


WIN = {"ROW_NUMBER": "row_number() OVER w", "RANK": "rank() OVER w2", "DENSE_RANK": "dense_rank() OVER w2", "NTILE": "ntile(4) OVER w", "PERCENT_RANK": "percent_rank() OVER w2", "CUME_DIST": "cume_dist() OVER w2"}


@query("SELECT o_orderkey, " + ", ".join(f"{v if k not in ('PERCENT_RANK', 'CUME_DIST') else f'round({v}, 6)'} AS {k.lower()}" for k, v in WIN.items()) + " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranks(spark, d):
    o = T(spark, d, "orders")
    a = relational.window(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], [{"type": "ROW_NUMBER", "outputColumn": "row_number"}, {"type": "NTILE", "windowSize": 4, "outputColumn": "ntile"}])
    b = relational.window(a, ["o_custkey"], ["o_orderpriority"], [{"type": k, "outputColumn": k.lower()} for k in ("RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST")])
    return rounded(b.select("o_orderkey", *[k.lower() for k in WIN]), 6)


MOVE = ("sum", "avg", "min", "max", "stddev_samp")


@query("SELECT event_id, " + ", ".join(f"round({f}(value) OVER m, 9) AS moving_{f.split('_')[0]}, round({f}(value) OVER r, 9) AS running_{f}" for f in MOVE if f != "stddev_samp") + """, round(stddev_samp(value) OVER m, 9) AS moving_stddev, round(lag(value, 2) OVER w, 9) AS lag, round(lead(value, 1) OVER w, 9) AS lead, round(value - lag(value, 1) OVER w, 9) AS lag_diff,
 round(first_value(value) OVER e, 9) AS first, round(last_value(value) OVER e, 9) AS last, round(nth_value(value, 2) OVER e, 9) AS nth, round(avg(value) OVER (PARTITION BY user_id), 9) AS whole FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), m AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_values(spark, d):
    specs = [{"type": f"MOVING_{f}", "column": "value", "windowSize": 5, "outputColumn": f"moving_{f.lower()}"} for f in ("SUM", "AVG", "MIN", "MAX", "STDDEV")]
    specs += [{"type": f"RUNNING_{f}", "column": "value", "outputColumn": f"running_{f.lower()}"} for f in ("SUM", "AVG", "MIN", "MAX")]
    specs += [{"type": "LAG", "column": "value", "windowSize": 2, "outputColumn": "lag"}, {"type": "LEAD", "column": "value", "windowSize": 1, "outputColumn": "lead"}, {"type": "LAG_DIFF", "column": "value", "windowSize": 1, "outputColumn": "lag_diff"}]
    specs += [{"type": "FIRST_VALUE", "column": "value", "outputColumn": "first"}, {"type": "LAST_VALUE", "column": "value", "outputColumn": "last"}, {"type": "NTH_VALUE", "column": "value", "windowSize": 2, "outputColumn": "nth"}, {"type": "AVG", "column": "value", "outputColumn": "whole"}]
    out = relational.window(T(spark, d, "events"), ["user_id"], ["ts", "event_id"], specs)
    return rounded(out.select("event_id", *[s["outputColumn"] for s in specs]), 9)


@query("SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (WHERE n_regionkey = {i}) AS \"{i}_n\", coalesce(round(sum(c_acctbal) FILTER (WHERE n_regionkey = {i}), 2), 0) AS \"{i}_bal\"" for i in range(5)) + ", count(*) AS total_n, round(sum(c_acctbal), 2) AS total_bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pivot_marginals(spark, d):
    j = joins.join(T(spark, d, "customer"), T(spark, d, "nation"), [{"left": "c_nationkey", "right": "n_nationkey"}], "INNER")
    out = relational.pivot(j, ["c_mktsegment"], "n_regionkey", [{"column": None, "type": "SIZE", "outputColumn": "n"}, {"column": "c_acctbal", "type": "SUM", "outputColumn": "bal"}], modalities=list(range(5)), marginals=True, fill=0)
    return rounded(out, 2)


@query("SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) UNPIVOT (value FOR variable IN (o_orderstatus, o_orderpriority))")
def fold_columns(spark, d):
    return relational.fold(T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE r <= 2 OR r > c - 1")
def topn_first_last(spark, d):
    return relational.top_n(T(spark, d, "orders"), 2, [{"column": "o_totalprice", "order": "DESC"}, "o_orderkey"], ["o_custkey"], last=1).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r > 3")
def topn_rest(spark, d):
    return relational.top_n(T(spark, d, "orders"), 3, [{"column": "o_totalprice", "order": "DESC"}, "o_orderkey"], ["o_custkey"], rest=True).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topn_global(spark, d):
    return relational.top_n(T(spark, d, "orders"), 10, [{"column": "o_totalprice", "order": "DESC"}, "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def distinct_keep_last(spark, d):
    return relational.distinct(T(spark, d, "orders"), ["o_custkey"], "last", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def distinct_count(spark, d):
    return relational.distinct(T(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], count=True)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS branch FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders)")
def split_filter(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice")
    parts = relational.split(o, "FILTER", ['val("o_totalprice") > 150000', 'val("o_orderstatus") == "F"'])
    return relational.stack([p.select("o_orderkey", F.lit(i).alias("branch")) for i, p in enumerate(parts)])


@query("SELECT s_suppkey AS k, s_name AS name, NULL AS c_mktsegment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def stack_missing(spark, d):
    return relational.stack([T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "c_mktsegment")])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def statistics(spark, d):
    return rounded(relational.statistics(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE round(c_acctbal, 2) END AS c_acctbal FROM customer")
def upsert_customers(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    new = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0))
    return relational.upsert(c, new, ["c_custkey"])


# --- quality, time windows, models ---


@query("SELECT 'ROW_COUNT' AS metric, NULL AS column_name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'COLUMN_AVG', 'o_totalprice', round(avg(o_totalprice), 2) FROM orders UNION ALL SELECT 'COLUMN_DISTINCT', 'o_custkey', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders UNION ALL SELECT 'COLUMN_MAX', 'o_totalprice', round(max(o_totalprice), 2) FROM orders")
def quality_metrics(spark, d):
    m = [{"type": "ROW_COUNT"}, {"type": "COLUMN_AVG", "column": "o_totalprice"}, {"type": "COLUMN_DISTINCT", "column": "o_custkey"}, {"type": "COLUMN_MAX", "column": "o_totalprice"}]
    return rounded(quality.metrics(T(spark, d, "orders"), m), 2)


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IS NULL THEN 'lang_given' END, CASE WHEN n_chars < 1 OR n_chars > 20000 THEN 'length' END, CASE WHEN source IS NOT NULL AND source NOT IN ('docs', 'tickets', 'chat') THEN 'source' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents
 WHERE lang IS NULL OR n_chars < 1 OR n_chars > 20000 OR (source IS NOT NULL AND source NOT IN ('docs', 'tickets', 'chat'))""")
def quality_failed_rows(spark, d):
    rules = [{"type": "not_null", "column": "lang", "name": "lang_given"}, {"type": "in_range", "column": "n_chars", "min": 1, "max": 20000, "name": "length"}, {"type": "in_set", "column": "source", "values": ["docs", "tickets", "chat"], "name": "source"}]
    return quality.failed_rows(T(spark, d, "documents").select("doc_id", "lang", "n_chars", "source"), rules).select("doc_id", F.array_join("failed_rules", ",").alias("failed"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    w = windows.windowed(T(spark, d, "events"), "ts", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], "1 hour", keys=["event_type"])
    return rounded(w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total"), 3)


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM b)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def window_session(spark, d):
    w = windows.windowed(T(spark, d, "events"), "ts", [F.count(F.lit(1)).alias("n")], "12 hours", keys=["user_id"], session=True)
    return w.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
