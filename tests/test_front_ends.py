"""Joins, plugins, scenarios, command line, streams and the entry on small tables."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom import __main__ as cli
from sparkloom.errors import UnsupportedError, ValidationError
from sparkloom.functions import modes, quality
from sparkloom.operators import joins, nested, prepare, relational
from sparkloom.plans.flow import Flow
from sparkloom.plans.pandas_source import compile_source
from sparkloom.plans.plugins import Plugin, Registry
from sparkloom.session import clean, written
from sparkloom.streaming import windows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_libraries_of_the_text_operators():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'p1_found' in q and 'p7_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_fuzzy_metrics_refuse_or_answer(spark):
    df = spark.createDataFrame([("abc", 1.0), ("abd", 1.4), ("zzzzzz", 9.0), (None, None)], "t string, x double")
    with pytest.raises(UnsupportedError):
        joins.fuzzy(df, df, "t", "t", 1, "NONSENSE")
    near = joins.fuzzy(df, df, "x", "x", 0.5, "EUCLIDEAN").select("l_x", "r_x").collect()
    assert sorted(map(tuple, near)) == [(1.0, 1.0), (1.0, 1.4), (1.4, 1.0), (1.4, 1.4), (9.0, 9.0)]
    kept = joins.fuzzy(df, df.where("t = 'abd'"), "t", "t", 1, how="LEFT")
    assert {(r.l_t, r.r_t) for r in kept.collect()} == {("abc", "abd"), ("abd", "abd"), ("zzzzzz", None), (None, None)}
    points = spark.createDataFrame([("POINT(0 0)",), ("POINT(0.001 0)",), ("POINT(5 5)",), ("none",)], "p string")
    assert joins.fuzzy(points, points, "p", "p", 200, "GEOSPATIAL").count() == 5
    assert joins.fuzzy(df.limit(0), df, "t", "t", 1).count() == 0


def test_nearest_keys_of_the_join_node(spark):
    l = spark.createDataFrame([(1, "a", 10.0), (2, "a", None), (3, "b", 1.0), (4, "a", 5.0)], "id int, g string, v double")
    r = spark.createDataFrame([("a", 9.0, 1), ("a", 11.0, 2), ("a", 9.0, 0), ("c", 1.0, 3), (None, 1.0, 4)], "g string, v double, n int")
    keys = [{"left": "g", "right": "g"}, {"left": "v", "right": "v", "matchType": "K_NEAREST", "k": 2, "tie": "n"}]
    got = {(x.id, x.n) for x in joins.join(l, r, keys, "LEFT").collect()}
    assert got == {(1, 0), (1, 1), (2, None), (3, None), (4, 0), (4, 1)}
    low = [{**k, "matchType": "K_NEAREST_INFERIOR", "k": 1} if "matchType" in k else k for k in keys]
    assert {(x.id, x.n) for x in joins.join(l, r, low, "LEFT").collect()} == {(1, 0), (2, None), (3, None), (4, None)}
    with pytest.raises(UnsupportedError):
        joins.join(l, r, keys, "OUTER")


def test_banded_as_of_equals_one_band(spark):
    rows = [(i, i % 2, (i * 37) % 101, i % 5) for i in range(200)] + [(900, 0, None, 1), (901, None, 5, 1)]
    df = spark.createDataFrame(rows, "id int, g int, t int, k int")
    l, r = df.where("k > 1"), df.where("k <= 1").select("g", F.col("t").alias("u"), F.col("id").alias("rid"))
    for direction in ("backward", "forward", "nearest"):
        many, one = ({(x.id, x.rid_right) for x in joins.as_of(l, r, "t", "u", ["g"], direction, "rid", n).collect()} for n in (20, 10**6))
        assert many == one and any(b for _, b in one)
    assert joins.as_of(l.limit(0), r.limit(0), "t", "u").count() == 0


def test_shapes_meet_in_cells_of_any_size(spark):
    def box(x, y, w):
        return f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))"

    boxes = [(i, (i * 37) % 50 - 10, (i * 61) % 50 - 20, [1, 3, 40][i % 3]) for i in range(40)]
    df = spark.createDataFrame([(i, box(x, y, w)) for i, x, y, w in boxes] + [(99, None), (98, "POLYGON(")], "id int, s string")
    want = {(a[0], b[0]) for a in boxes for b in boxes if all(a[k] <= b[k] + b[3] and b[k] <= a[k] + a[3] for k in (1, 2))}
    got = [(r.l_id, r.r_id) for r in joins.geo_join(df, df, "s", "s", "INTERSECTS").collect()]
    assert set(got) == want and len(got) == len(want)


def test_equal_counts_and_clusters(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 2.0, 5.0][i % 4]) for i in range(41)] + [(99, None)], "id int, x double")
    rows = modes.bins(df, "x", "EQUAL_FREQUENCY", "b", 4).collect()
    sizes = {k: sum(r.b == k for r in rows) for k in range(4)}
    assert sizes == {0: 11, 1: 10, 2: 10, 3: 10} and [r.b for r in rows if r.x is None] == [None]
    assert all(a.b <= b.b for a in rows for b in rows if a.x is not None and b.x is not None and a.x < b.x)
    halves = {(r.x, r.b) for r in modes.bins(df, "x", "KMEANS", "b", 2).collect()}
    assert halves == {(1.0, 0), (2.0, 0), (5.0, 1), (None, None)}


def test_stratified_share_and_encoders_at_once(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b") for i in range(50)], "id int, g string")
    assert {r.g: r["count"] for r in relational.sample(df, "STRATIFIED", fraction=0.2, column="g").groupBy("g").count().collect()} == {"a": 8, "b": 2}
    y = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), (None, 1.0)], "c string, y double")
    out = prepare.apply_steps(y, [{"type": "CategoricalEncoder", "params": {"column": "c", "encoding": e, "target": "y", "outputColumn": e}} for e in ("COUNT", "FREQUENCY", "TARGET", "LEAVE_ONE_OUT")])
    assert sorted(map(tuple, out.select("c", "COUNT", "FREQUENCY", "TARGET", "LEAVE_ONE_OUT").collect()), key=repr) == sorted([("a", 2, 0.5, 0.5, 0.0), ("a", 2, 0.5, 0.5, 1.0), ("b", 1, 0.25, 1.0, None), (None, 1, 0.25, 1.0, None)], key=repr)


def test_programs_refuse_what_they_would_drop(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    head = "import pandas as pd\nd = pd.read_csv('t.csv')\n"
    for bad in ("d = d.merge(d, on='n', indicator=True)", "d = d.pivot_table(index='n', columns='s', values='n', margins=True)", "d = d.pipe(print)", "if d:\n    pass", "for x in d:\n    pass", "d = d.sort_values('n', na_position='first')"):
        with pytest.raises(UnsupportedError):
            compile_source(head + bad, {"t": df})
    code = head + "def f(x, k=2):\n    x['m'] = x['n'] * k\n    return x\nfor k in [3, 4]:\n    if k == 4:\n        d = d.pipe(f, k)\n"
    assert [r.m for r in compile_source(code, {"t": df})["d"].orderBy("n").collect()] == [4, 8]


def test_plugins_come_and_go(spark):
    df = spark.createDataFrame([(1,)], "n int")
    r = Registry()
    p = Plugin("p", node_aliases={"copy": "sync"}, processors={"Plus": lambda d, s: d.withColumn("n", F.col("n") + s["by"])}, processor_aliases={"Rename2": "ColumnRenamer"}, methods={"plus": lambda c, base, args, kw: c.columns(base, {"n": F.col("n") + args[0]})})
    r.activate(p)
    with pytest.raises(ValidationError):
        r.activate(p)
    steps = [{"type": "Plus", "params": {"by": 2}}, {"type": "Rename2", "params": {"renamings": {"n": "m"}}}]
    flow = {"recipes": [{"name": "a", "type": "copy", "inputs": ["t"], "outputs": ["u"]}, {"name": "b", "type": "prepare", "inputs": ["u"], "outputs": ["v"], "settings": {"steps": steps}}]}
    assert Flow(flow).run(spark, {"t": df})["v"].first().m == 3
    assert compile_source("import pandas as pd\nd = pd.read_csv('t.csv').plus(5)\n", {"t": df})["d"].first().n == 6
    r.clear()
    with pytest.raises(UnsupportedError):
        prepare.apply_steps(df, steps)
    with pytest.raises(UnsupportedError):
        Flow(flow).run(spark, {"t": df})


def test_scenario_and_command_line(spark, tmp_path, capsys):
    sink = str(tmp_path / "out")
    spec = {"name": "f", "datasets": [{"name": "t"}, {"name": "u", "write": {"format": "parquet", "path": sink}}], "recipes": [{"name": "r", "type": "sync", "inputs": ["t"], "outputs": ["u"]}]}
    df = spark.createDataFrame([(1,), (2,)], "n int")
    checks = [{"metric": "ROW_COUNT", "condition": "EQUALS", "target": 3}]
    scenario = {"triggers": [{"type": "daily"}], "steps": [{"name": "b", "type": "build"}, {"name": "c", "type": "check", "dataset": "u", "checks": checks}, {"name": "d", "type": "build"}]}
    assert [s["outcome"] for s in quality.run_scenario(spark, Flow(spec), scenario, {"t": df})] == ["OK", "ERROR", "SKIPPED"]
    assert spark.read.parquet(sink).count() == 2
    path = tmp_path / "f.json"
    path.write_text(json.dumps(spec))
    assert cli.main(["validate", str(path)]) == 0 and cli.main(["summary", str(path)]) == 0
    assert "f: 2 datasets, 1 nodes" in capsys.readouterr().out
    path.write_text(json.dumps({"recipes": [{"name": "r", "type": "nothing", "inputs": ["t"], "outputs": ["u"]}]}))
    assert cli.main(["validate", str(path)]) == 1


def test_stream_keeps_the_latest_row(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[(1, 5, "a"), (2, 1, "b"), (1, 3, "old")], [(1, 4, "late"), (2, 9, "new"), (3, 1, "c")], [(3, 2, "d")]]):
        spark.createDataFrame(rows, "id int, at int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, at int, v string").parquet(source)
        windows.upsert_stream(stream, out, ["id"], str(tmp_path / "cp"), "at").trigger(availableNow=True).start().awaitTermination()
        assert k < 2 or {(r.id, r.v) for r in windows.current(spark, out).collect()} == {(1, "a"), (2, "new"), (3, "d")}


def test_written_tables_are_removed(spark):
    path = written(spark.range(3), "gone").inputFiles()[0]
    assert clean(spark) >= 1 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_json_of_any_depth_and_quoting():
    deep = "[" * 60_000 + "1" + "]" * 60_000
    v, n = nested.readable(deep), 0
    while isinstance(v, list):
        v, n = v[0], n + 1
    assert n == 60_000 and v == 1
    text = json.dumps({"a": [1, {"b": "x\\\"y"}, None, True, -1.5e3, {}], "c": []})
    assert nested._deep(text) == json.loads(text)
    for bad in ('{"a": }', "[1, 2", "[1 2]", '{"a" 1}', "]", "", '{"a": 1,}', "[1,]"):
        with pytest.raises(ValueError):
            nested._deep(bad)
    for _ in range(12):
        text = json.dumps(text)
    assert nested.readable(text)["a"][0] == 1
