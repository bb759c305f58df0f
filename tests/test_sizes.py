"""Work and results that hold on larger tables, shown on small ones."""

import math

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sparkloom.operators import joins
from sparkloom.plans.pandas_source import compile_source
from sparkloom.queries import nodes, relational


@pytest.mark.parametrize("unit", ["KILOMETER", "NAUTICAL_MILE", "METER", "YARD", "FOOT", "MILE"])
def test_points_near_the_poles_take_few_cells(spark, unit):
    points = [(i, lat, lon) for i, (lat, lon) in enumerate([(la, lo) for la in (-90.0, -89.9, -60.2, -0.1, 0.2, 45.0, 89.75, 89.99, 90.0) for lo in (-180.0, -179.9, -90.0, -0.2, 0.0, 0.3, 90.0, 179.8, 180.0)])]
    points += [(100, 0.2, 0.3), (101, 0.2, 0.3), (102, None, 1.0), (103, 1.0, None)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * joins.EARTH * math.asin(min(1.0, math.sqrt(h)))

    known = [p for p in points if p[1] is not None and p[2] is not None]
    for limit in (1, 40_000, 3_000_000, 21_000_000):
        got = [(r.l_id, r.r_id) for r in joins.within_distance(df, df, ("lat", "lon"), ("lat", "lon"), limit / joins.UNITS[unit], unit).collect()]
        want = {(a[0], b[0]) for a in known for b in known if metres(a, b) <= limit + 1e-6}
        assert set(got) == want and len(got) == len(want)
    cells = joins._point_cells(df, "lat", "lon", math.degrees(1 / joins.EARTH), 1).groupBy("id").count().collect()
    assert len(cells) == len(known) and max(r["count"] for r in cells) <= 9


def test_points_of_equal_place_come_out_row_by_row(spark):
    df = spark.createDataFrame([(i, 10.0 if i < 6 else 10.4, 179.9 if i % 2 else -179.9) for i in range(8)], "id int, lat double, lon double")
    plan = joins.within_distance(df, df, ("lat", "lon"), ("lat", "lon"), 48.0, "KILOMETER")
    got = sorted((r.l_id, r.r_id) for r in plan.collect())
    assert got == sorted([(a, b) for a in range(6) for b in range(6)] + [(a, b) for a in (6, 7) for b in (6, 7)] + [p for a in range(6) for b in (6, 7) if a % 2 == b % 2 for p in ((a, b), (b, a))])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [_") == 2  # both sides' points are compared once each


def test_rows_near_each_other_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, 10.0 + i, 20.0) for i in range(4)], "id int, lat double, lon double")
    pairs = joins.within_distance(df, df, ("lat", "lon"), ("lat", "lon"), 40.0, "MILE")
    assert sorted((r.l_id, r.r_id) for r in pairs.collect()) == [(i, i) for i in range(4)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["geo_within_nautical_mile", "geo_within_distance", "geo_within_meter", "geo_within_yard", "geo_within_foot", "geo_within_mile"])
def test_points_of_large_keys(spark, tmp_path, name):
    def pairs(kind, shift):
        folder = str(tmp_path / f"{kind}{shift}")
        spark.range(1500).select((F.col("id") + shift).cast(kind).alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
        return sorted((r.a - shift, r.b - shift, r.km) for r in (nodes.QUERIES | relational.QUERIES)[name][0](spark, folder).collect())

    want = pairs("bigint", 0)
    assert len(want) > 1500  # neighbours too
    for kind, shift in (("int", 36_000), ("int", 36_000 * 50_000), ("bigint", 36_000 * 10**10), ("bigint", 36_000 * 10**14)):
        assert pairs(kind, shift) == want


def test_disjoint_shapes_are_told_by_their_boxes(spark, monkeypatch):
    shapes = [f"POLYGON(({x} {x}, {x + w} {x}, {x + w} {x + w}, {x} {x + w}, {x} {x}))" for x, w in ((0, 10), (10, 1), (-5, 2), (12, 0.5))]
    shapes += ["POLYGON((0 0, 9 0, 0 9, 0 0))", "POLYGON((9 9, 9 5, 5 9, 9 9))", "LINESTRING(0 20, 20 0)", "POINT(.5 -3e0)", "POINT(0 0)", "none", "", "POLYGON(", "POINT(nan 1)"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*shapes, *shapes, None])], "id int, s string")
    want = sorted((i, j) for i, a in enumerate(shapes * 2) for j, b in enumerate(shapes * 2) if joins.relation(a, b, "DISJOINT"))
    assert sorted((r.l_id, r.r_id) for r in joins.geo_join(df, df, "s", "s", "DISJOINT").collect()) == want
    far = df.where("id < 4")
    monkeypatch.setattr(joins, "geo_relation", lambda kind: lambda a, b: F.when(a == b, False).otherwise(F.raise_error(F.lit("compared")).cast("boolean")))
    assert joins.geo_join(far.where("id > 1"), far.where("id > 1"), "s", "s", "DISJOINT").count() == 2
    with pytest.raises(PythonException, match="several parts"):
        joins.geo_join(spark.createDataFrame([(1, "MULTIPOINT((1 1),(2 2))")], "id int, s string"), far, "s", "s", "DISJOINT").count()


def test_next_known_values_are_running_frames(spark):
    rows = [(i, [None, float(i), None][i % 3], (i * 7) % 10) for i in range(10)] + [(None, 50.0, 20), (None, None, 21)]
    df = spark.createDataFrame(rows, "`a b` int, v double, p int")
    code = "import pandas as pd\nt = pd.read_csv('t.csv')\nt = t.sort_values(['a b', 'p'], ascending=[False, True])\nt['up'] = t['v'].bfill()\nt['line'] = t['v'].interpolate()\nu = t.bfill()\n"
    made = compile_source(code, {"t": df})
    got = {(r["a b"], r.p): (r.up, r.line) for r in made["t"].collect()}
    asked = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    for k, (a, v, p) in enumerate(asked):
        after = [(j, x[1]) for j, x in enumerate(asked) if j >= k and x[1] is not None]
        before = [(j, x[1]) for j, x in enumerate(asked) if j <= k and x[1] is not None]
        up, line = got[a, p]
        assert up == (after[0][1] if after else None)
        (i, x), (j, y) = (before or [(k, None)])[-1], (after or [(k, None)])[0]
        assert line == v if v is not None else (line is None if not before else line == x if not after else abs(line - (x + (y - x) * (k - i) / (j - i))) < 1e-9)
    assert sorted(r.v is None for r in made["u"].collect()) == [False] * 11 + [True]
    for name in made:
        assert "unboundedfollowing" not in made[name]._jdf.queryExecution().optimizedPlan().toString().lower()
