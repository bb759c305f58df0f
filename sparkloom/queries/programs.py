"""Queries over programs in pandas, NumPy and scikit-learn style, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.pandas_source import compile_source
from sparkloom.queries.relational import rounded
from sparkloom.session import table

QUERIES: dict = {}


def program(name: str, code: str, tables: list[str], out: str, sql: str, digits: int = 4, finish=None) -> None:
    """Register a program: its source, the tables it reads, the variable to return, the SQL."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        made = compile_source(code, {t: table(spark, d, t) for t in tables})[out]
        return rounded(finish(made) if finish else made, digits)

    QUERIES[f"source_{name}"] = (f, sql)


program("columns", '''
import pandas as pd
p = pd.read_csv("part.csv")
p = p.rename(columns={"p_name": "name"})
p = p.query("p_size > 5 and p_retailprice < 1500")
p = p.assign(twice=lambda d: d["p_size"] * 2, more=lambda d: d["twice"] + 1)
p["size_text"] = p["p_size"].astype("str")
p["n"] = pd.to_numeric(p["size_text"], errors="coerce")
p["capped"] = p["p_size"].clip(lower=10, upper=40)
p["r"] = p["p_retailprice"].round(1)
p["gap"] = (p["p_size"] - 25).abs()
p["w"] = p["p_size"].where(p["p_size"] > 20, 0)
p["m"] = p["p_size"].mask(p["p_size"] > 20, -1)
p["mapped"] = p["p_brand"].map({"Brand#11": "a", "Brand#12": "b"})
p["swapped"] = p["p_brand"].replace({"Brand#11": "first"})
p["either"] = p["mapped"].combine_first(p["p_brand"])
p["title"] = p["name"].str.title()
p["word"] = p["p_type"].str.split(" ").str.get(0)
p["has"] = p["p_type"].str.contains("STEEL")
p["cut"] = pd.cut(p["p_size"], [0, 10, 30, 60])
out = p[["p_partkey", "name", "twice", "more", "n", "capped", "r", "gap", "w", "m", "mapped", "swapped", "either", "title", "word", "has", "cut"]]
''', ["part"], "out", "SELECT p_partkey, p_name AS name, CAST(p_size * 2 AS BIGINT) AS twice, CAST(p_size * 2 + 1 AS BIGINT) AS more, CAST(p_size AS DOUBLE) AS n, CAST(least(greatest(p_size, 10), 40) AS BIGINT) AS capped, round_even(p_retailprice, 1) AS r, CAST(abs(p_size - 25) AS BIGINT) AS gap, CAST(CASE WHEN p_size > 20 THEN p_size ELSE 0 END AS BIGINT) AS w, CAST(CASE WHEN p_size > 20 THEN -1 ELSE p_size END AS BIGINT) AS m, CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#12' THEN 'b' END AS mapped, CASE p_brand WHEN 'Brand#11' THEN 'first' ELSE p_brand END AS swapped, CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#12' THEN 'b' ELSE p_brand END AS either, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, split_part(p_type, ' ', 1) AS word, contains(p_type, 'STEEL') AS has, CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 WHEN p_size <= 60 THEN 2 END AS BIGINT) AS cut FROM part WHERE p_size > 5 AND p_retailprice < 1500")

program("missing", '''
import pandas as pd
import numpy as np
e = pd.read_parquet("events.parquet")
e = e.sort_values("event_id")
e["v"] = np.where(e["event_id"] % 3 == 0, None, e["value"])
e["line"] = e["v"].interpolate(method="linear")
e["down"] = e["v"].ffill()
e["up"] = e["v"].bfill()
e["filled"] = e["v"].fillna(0)
f = e[["event_id", "v", "line", "down", "up", "filled"]]
g = f.fillna(method="ffill")
f["again"] = f["v"].fillna(-1)
f = f[~f["v"].isna() | (f["event_id"] > 50)]
out = f.drop_duplicates(subset=["event_id"]).drop(columns=["v"])
''', ["events"], "out", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, row_number() OVER (ORDER BY event_id) AS n FROM events), f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS down, first_value(v IGNORE NULLS) OVER a AS up, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pa, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS pb FROM e WINDOW b AS (ORDER BY n ROWS UNBOUNDED PRECEDING), a AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN up IS NOT NULL THEN down + (up - down) * (n - pa) / (pb - pa) ELSE down END, 4) AS line, round(down, 4) AS down, round(up, 4) AS up, round(coalesce(v, 0), 4) AS filled, round(coalesce(v, -1), 4) AS again FROM f WHERE v IS NOT NULL OR event_id > 50")

program("groups", '''
import pandas as pd
import numpy as np
o = pd.read_parquet("orders.parquet")
o = o.sort_values(["o_custkey", "o_orderkey"])
for c in ["o_totalprice"]:
    o[f"{c}_min"] = o.groupby("o_custkey")[c].cummin()
    o[f"{c}_max"] = o.groupby("o_custkey")[c].cummax()
    o[f"{c}_diff"] = o.groupby("o_custkey")[c].diff()

def scaled(df, by=1000):
    df["k"] = df["o_totalprice"] / by
    return df

o = scaled(o, by=100)
if len([1, 2]) == 2:
    o["count"] = o.groupby("o_custkey")["o_orderkey"].transform("count")
else:
    o["count"] = 0
o["mean"] = o.groupby("o_custkey")["k"].transform("mean")
out = o[["o_orderkey", "o_totalprice_min", "o_totalprice_max", "o_totalprice_diff", "k", "count", "mean"]]
''', ["orders"], "out", "SELECT o_orderkey, round(min(o_totalprice) OVER w, 10) AS o_totalprice_min, round(max(o_totalprice) OVER w, 10) AS o_totalprice_max, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 10) AS o_totalprice_diff, round(o_totalprice / 100, 10) AS k, count(*) OVER (PARTITION BY o_custkey) AS count, round(avg(o_totalprice / 100) OVER (PARTITION BY o_custkey), 10) AS mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)", 10)

program("whole_column", '''
import pandas as pd
import numpy as np
s = pd.read_csv("supplier.csv").sort_values("s_suppkey")
s["x"] = s["s_nationkey"] * 1.0
s["prod"] = (s["x"] * 0 + 1).cumprod()
s["cum"] = np.cumsum(s["x"])
s["d"] = np.diff(s["x"])
s["log"] = np.log1p(s["x"])
s["log2"] = np.log2(s["x"] + 1)
s["log10"] = np.log10(s["x"] + 1)
s["ln"] = np.log(s["x"] + 1)
s["e"] = np.exp(s["x"] / 10)
s["em"] = np.expm1(s["x"] / 10)
s["root"] = np.sqrt(s["x"])
s["cube"] = np.cbrt(s["x"] + 1)
s["sq"] = np.square(s["x"])
s["pow"] = np.power(s["x"], 3)
s["abs"] = np.abs(s["x"] - 10)
s["fl"] = np.floor(s["x"] / 3)
s["ce"] = np.ceil(s["x"] / 3)
s["tr"] = np.trunc((s["x"] - 12) / 5)
s["ro"] = np.round(s["x"] / 7, 2)
s["cl"] = np.clip(s["x"], 5, 15)
s["dig"] = np.digitize(s["x"], [5, 10, 20])
s["sel"] = np.select([s["x"] < 5, s["x"] < 15], ["low", "mid"], default="high")
s["fin"] = np.isfinite(s["x"])
s["nan"] = np.isnan(s["x"])
s["num"] = np.nan_to_num(s["x"])
out = s.drop(columns=["s_name", "s_address", "s_nationkey", "s_phone", "s_acctbal", "s_comment"])
''', ["supplier"], "out", "SELECT s_suppkey, x, CAST(1 AS DOUBLE) AS prod, sum(x) OVER (ORDER BY s_suppkey) AS cum, x - lag(x) OVER (ORDER BY s_suppkey) AS d, round(ln(x + 1), 4) AS log, round(log2(x + 1), 4) AS log2, round(log10(x + 1), 4) AS log10, round(ln(x + 1), 4) AS ln, round(exp(x / 10), 4) AS e, round(exp(x / 10) - 1, 4) AS em, round(sqrt(x), 4) AS root, round(cbrt(x + 1), 4) AS cube, x * x AS sq, x * x * x AS pow, abs(x - 10) AS abs, CAST(floor(x / 3) AS BIGINT) AS fl, CAST(ceil(x / 3) AS BIGINT) AS ce, CAST(trunc((x - 12) / 5) AS BIGINT) AS tr, round_even(x / 7, 2) AS ro, least(greatest(x, 5), 15) AS cl, CAST(CASE WHEN x >= 20 THEN 3 WHEN x >= 10 THEN 2 WHEN x >= 5 THEN 1 ELSE 0 END AS BIGINT) AS dig, CASE WHEN x < 5 THEN 'low' WHEN x < 15 THEN 'mid' ELSE 'high' END AS sel, true AS fin, false AS nan, x AS num FROM (SELECT s_suppkey, s_nationkey * 1.0::DOUBLE AS x FROM supplier)", finish=lambda df: df.select(*[c for c in df.columns if c in "s_suppkey x prod cum d log log2 log10 ln e em root cube sq pow abs fl ce tr ro cl dig sel fin nan num".split()]))

_ONE = "SELECT {} FROM orders"
program("totals", '''
import pandas as pd
import numpy as np
o = pd.read_parquet("orders.parquet")
v = o["o_totalprice"]
a = np.percentile(v, 90)
parts = [v.sum(), v.mean(), np.std(v), np.var(v), np.median(v), np.quantile(v, 0.25), np.min(v), np.max(v), np.nanmean(v), np.nansum(v)]
out = np.concatenate([a, v.sum(), v.mean(), np.std(v), np.median(v), np.quantile(v, 0.25), np.min(v), np.max(v), np.nanmean(v), v.quantile(0.75), o["o_custkey"].nunique()])
''', ["orders"], "out", " UNION ALL ".join(_ONE.format(f"round({e}, 2) AS o_totalprice") for e in ("quantile_cont(o_totalprice, 0.9)", "sum(o_totalprice)", "avg(o_totalprice)", "stddev_pop(o_totalprice)", "median(o_totalprice)", "quantile_cont(o_totalprice, 0.25)", "min(o_totalprice)", "max(o_totalprice)", "avg(o_totalprice)", "quantile_cont(o_totalprice, 0.75)")) + " UNION ALL SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders", 2)

program("shapes", '''
import pandas as pd
o = pd.read_parquet("orders.parquet")
t = o.pivot_table(index="o_orderpriority", columns="o_orderstatus", values="o_totalprice", aggfunc="mean", fill_value=0)
out = t.melt(id_vars=["o_orderpriority"], value_vars=["F", "O", "P"], var_name="status", value_name="mean")
''', ["orders"], "out", "SELECT p AS o_orderpriority, s AS status, round(coalesce(m, 0), 2) AS mean FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) LEFT JOIN (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) ON p = o_orderpriority AND s = o_orderstatus", 2)

program("rows", '''
import pandas as pd
c = pd.read_csv("customer.csv")
n = pd.read_csv("nation.csv").rename(columns={"n_nationkey": "c_nationkey"})
big = c.nlargest(30, "c_acctbal")
small = c.nsmallest(20, "c_acctbal")
first = c.sort_values("c_custkey").head(10)
last = c.sort_values("c_custkey").tail(5)
rows = pd.concat([big, small, first, last])
joined = pd.merge(rows, n, on="c_nationkey", how="left")
named = rows.set_index("c_nationkey").join(n.set_index("c_nationkey"), how="inner")
named = named.reset_index()
out = named[["c_custkey", "n_name"]]
''', ["customer", "nation"], "out", "WITH r AS (SELECT c_custkey, c_nationkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) UNION ALL SELECT c_custkey, c_nationkey FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20) UNION ALL SELECT c_custkey, c_nationkey FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10) UNION ALL SELECT c_custkey, c_nationkey FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5)) SELECT c_custkey, n_name FROM r JOIN nation ON c_nationkey = n_nationkey")

program("describe", '''
import pandas as pd
p = pd.read_csv("part.csv")
d = p[["p_size", "p_retailprice"]].describe()
i = p[["p_size", "p_name"]].info()
out = i
''', ["part"], "d", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max, count(*) - count({c}) AS n_null FROM part" for c in ("p_size", "p_retailprice")))

program("counts", '''
import pandas as pd
import numpy as np
p = pd.read_csv("part.csv")
values, counts = np.unique(p["p_brand"], return_counts=True)
d = pd.get_dummies(p[["p_partkey", "p_brand"]], columns=["p_brand"])
w = p["p_type"].str.split(" ")
p["w"] = w
x = p[["p_partkey", "w"]].explode("w")
out = x.groupby("w").agg(n=("p_partkey", "count")).reset_index()
''', ["part"], "out", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")

program("asof", '''
import pandas as pd
e = pd.read_parquet("events.parquet").sort_values("ts")
p = e[e["event_type"] == "purchase"][["event_id", "user_id", "ts"]]
c = e[e["event_type"] == "signup"][["event_id", "user_id", "ts"]].rename(columns={"event_id": "signup_id"})
m = pd.merge_asof(p, c, on="ts", by="user_id", direction="backward")
out = m[["event_id", "signup_id"]]
''', ["events"], "out", "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS signup_id, user_id, ts AS at FROM events WHERE event_type = 'signup') SELECT p.event_id, c.signup_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.at", finish=lambda df: df.select("event_id", F.col("signup_id_right").alias("signup_id")) if "signup_id_right" in df.columns else df)

SKLEARN = '''
import pandas as pd
from sklearn.model_selection import train_test_split, cross_val_score, GridSearchCV
from sklearn.preprocessing import StandardScaler, MinMaxScaler, RobustScaler, MaxAbsScaler, Normalizer, LabelEncoder, OneHotEncoder, OrdinalEncoder
from sklearn.impute import SimpleImputer
from sklearn.linear_model import LinearRegression
from sklearn.pipeline import Pipeline
from sklearn.compose import ColumnTransformer
from sklearn.cluster import KMeans
from sklearn.decomposition import PCA
p = pd.read_csv("part.csv")
'''
program("sk_scalers", SKLEARN + '''
x = p[["p_size", "p_retailprice"]]
a = StandardScaler().fit_transform(x)
b = MinMaxScaler(feature_range=(0, 2))
b.fit(x)
c = RobustScaler().fit_transform(x)
d = Normalizer(norm="l1").fit_transform(MaxAbsScaler().fit_transform(x))
b2 = b.transform(x)
out = pd.concat([a, b2, c, d])
''', ["part"], "out", "WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, min(p_size) AS l1, max(p_size) AS h1, quantile_cont(p_size, 0.25) AS a1, median(p_size) AS b1, quantile_cont(p_size, 0.75) AS c1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2, min(p_retailprice) AS l2, max(p_retailprice) AS h2, quantile_cont(p_retailprice, 0.25) AS a2, median(p_retailprice) AS b2, quantile_cont(p_retailprice, 0.75) AS c2 FROM part) SELECT round((p_size - m1) / s1, 4) AS p_size, round((p_retailprice - m2) / s2, 4) AS p_retailprice FROM part, s UNION ALL SELECT round((p_size - l1) / (h1 - l1) * 2, 4), round((p_retailprice - l2) / (h2 - l2) * 2, 4) FROM part, s UNION ALL SELECT round((p_size - b1) / (c1 - a1), 4), round((p_retailprice - b2) / (c2 - a2), 4) FROM part, s UNION ALL SELECT round((p_size / h1) / (p_size / h1 + p_retailprice / h2), 4), round((p_retailprice / h2) / (p_size / h1 + p_retailprice / h2), 4) FROM part, s")

program("sk_encoders", SKLEARN + '''
o = pd.read_csv("orders.csv")
o["code"] = LabelEncoder().fit_transform(o["o_orderpriority"])
hot = OneHotEncoder(drop="first").fit_transform(o[["o_orderstatus"]])
both = ColumnTransformer([("h", OneHotEncoder(), ["o_orderstatus"]), ("o", OrdinalEncoder(), ["o_orderpriority"])], remainder="passthrough").fit_transform(o[["o_orderkey", "o_orderstatus", "o_orderpriority", "code"]])
out = both
''', ["part", "orders"], "out", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS DOUBLE) AS \"o_orderstatus_{s}\"" for s in "FOP") + ", CAST(o_orderpriority[1] AS DOUBLE) - 1 AS o_orderpriority, CAST(o_orderpriority[1] AS BIGINT) - 1 AS code FROM orders", finish=lambda df: df.withColumns({f"o_orderstatus_{s}": F.col(f"o_orderstatus_{s}").cast("double") for s in "FOP"}))

program("sk_regression", SKLEARN + '''
x, y = p[["p_size"]], p["p_retailprice"]
model = Pipeline([("fill", SimpleImputer(strategy="median")), ("scale", StandardScaler()), ("fit", LinearRegression())])
model.fit(x, y)
p["guess"] = model.predict(x)
out = p[["p_partkey", "guess"]]
''', ["part"], "out", "SELECT p_partkey, round((SELECT regr_intercept(p_retailprice, p_size) FROM part) + (SELECT regr_slope(p_retailprice, p_size) FROM part) * p_size, 3) AS guess FROM part", 3)

program("sk_parts", SKLEARN + '''
x, y = p[["p_size", "p_retailprice"]], p["p_partkey"]
x_train, x_test, y_train, y_test = train_test_split(x, y, test_size=0.2, random_state=4)
groups = KMeans(n_clusters=2, random_state=1).fit_predict(x)
p["group"] = groups
reduced = PCA(n_components=1).fit_transform(x)
scores = cross_val_score(LinearRegression(), x, y, cv=3)
search = GridSearchCV(LinearRegression(), {"fit_intercept": [True]}, cv=2)
search.fit(x, y)
both = pd.concat([x_train, x_test])
out = both
''', ["part"], "out", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part", finish=lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("bigint").alias("size")))
