"""Operators for training-data pipelines against brute force and on awkward input."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import drift, hierarchy, nested, references, rolling
from sparkloom.queries import training


def ts(day, hour=0):
    return dt.datetime(2025, 1, 1, hour) + dt.timedelta(days=day)


def trailing(spark, rows):
    df = spark.createDataFrame(rows, "provider string, ts timestamp_ntz, tokens bigint, cost double, entity string")
    daily = rolling.daily_totals(df, F.col("provider"), F.col("ts"), {"tokens": F.col("tokens"), "cost": F.col("cost")})
    return rolling.trailing_totals(daily, ["n_rows", "tokens", "cost"], (7, 30))


def test_rolling_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), ts(rng.randrange(90), rng.randrange(24)), rng.choice([None, rng.randrange(100)]), rng.choice([None, 0.1, 0.25]), "x") for _ in range(60)]
    rows += rows[:5] + [(None, ts(1), 1, 1.0, "x"), ("a", None, 1, 1.0, "x")]
    got = {(r.entity, r.day): r for r in trailing(spark, rows).collect()}
    for p in "ab":
        mine = [(r[1].date(), r[2] or 0, r[3] or 0) for r in rows if r[0] == p and r[1]]
        first, last = min(m[0] for m in mine), max(m[0] for m in mine)
        day = first
        while day <= last:
            for w in (7, 30):
                inside = [m for m in mine if day - dt.timedelta(days=w) < m[0] <= day]
                r = got[p, day]
                assert r[f"n_rows_{w}d"] == len(inside)
                assert r[f"tokens_{w}d"] == sum(m[1] for m in inside)
                assert float(r[f"cost_{w}d"]) == pytest.approx(sum(m[2] for m in inside), abs=1e-9)
                assert r[f"tokens_avg_{w}d"] == pytest.approx(sum(m[1] for m in inside) / min(w, (day - first).days + 1))
            day += dt.timedelta(days=1)
    assert trailing(spark, []).count() == 0


def test_quiet_days_and_latest_rows(spark):
    t = trailing(spark, [("a", ts(0), 1, 1.0, ""), ("a", ts(10), 1, 1.0, "")])
    assert {r.day.day for r in rolling.quiet_days(t, "n_rows", 7).collect()} == {8, 9, 10}
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (None, 1, "x"), (None, 1, "x")], "id int, arrived int, v string")
    assert sorted(r.v for r in rolling.latest_rows(df, "id", "arrived", ["id", "v"]).collect()) == ["new", "x", "x"]


LINKS = "grp string, child string, parent string, weight int, prio string"


def by_node(df):
    return {(r.grp, r.node): (r.root, r.depth, tuple(r.path or ()), r.state, r.n_descendants if r.state == "tree" else None) for r in df.collect()}


def test_hierarchy_paths_cycles_and_spread_groups(spark):
    rng = random.Random(5)
    rows = [("g", "b", "a", 1, ""), ("g", "c", "b", 1, ""), ("g", "d", "b", 1, ""), ("g", "x", "y", 1, ""), ("g", "y", "x", 1, ""), ("g", "z", "x", 1, ""), ("g", "s", "s", 1, ""), ("g", "lone", None, 1, ""), (None, "q", "r", 1, ""), ("g", None, "r", 1, "")]
    rows += [("deep", f"n{i:03d}", f"n{i - 1:03d}", 1, "") for i in range(1, 60)]
    rows += [("tree", f"t{i:03d}", f"t{rng.randrange(i):03d}", 1, "") for i in range(1, 60)] + [("tree", "u1", "u2", 1, ""), ("tree", "u2", "u3", 1, ""), ("tree", "u3", "u1", 1, ""), ("tree", "v", "u1", 1, "")]
    df = spark.createDataFrame(rows + rows[:3], LINKS)
    local = by_node(hierarchy.hierarchy(df, True))
    assert local["g", "c"] == ("a", 2, ("a", "b", "c"), "tree", 0)
    assert local["g", "a"][4] == 3 and local["g", "lone"] == ("lone", 0, ("lone",), "tree", 0)
    assert {n for (g, n), v in local.items() if v[3] == "closed"} == {"x", "y", "s", "u1", "u2", "u3"}
    assert local["g", "z"][3] == local["tree", "v"][3] == "below_closed"
    assert local["deep", "n059"][1] == 59 and local["deep", "n000"][4] == 59
    assert by_node(hierarchy.hierarchy(df, True, bound=20)) == local
    assert by_node(hierarchy.hierarchy(df, False, bound=30)) == local
    pairs = {(r.ancestor, r.descendant): r.distance for r in hierarchy.descendants(hierarchy.hierarchy(df, True)).where("grp = 'g'").collect()}
    assert pairs == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 2, ("b", "c"): 1, ("b", "d"): 1}
    assert hierarchy.hierarchy(spark.createDataFrame([], LINKS)).count() == 0


def brute_reach(links):
    """Least hops between other nodes, hidden ones not counted, from (child, parent)."""
    best = {}
    for start in {n for link in links for n in link if not n.startswith(hierarchy.HIDDEN)}:
        dist, todo = {start: 0}, [start]
        while todo:
            x = todo.pop()
            for child, parent in links:
                d = dist[x] + (not child.startswith(hierarchy.HIDDEN))
                if parent == x and d < dist.get(child, 10**9):
                    dist[child] = d
                    todo.append(child)
        best |= {(start, n): d for n, d in dist.items() if n != start and not n.startswith(hierarchy.HIDDEN)}
    return best


def test_descendants_over_all_links(spark, monkeypatch):
    hub = hierarchy.HIDDEN
    # recipe 1: a, b -> c; recipe 2: c, d -> e. b and d are second inputs
    rows = [("g", hub + "1", "a", 0, "0"), ("g", hub + "1", "b", 0, "1"), ("g", "c", hub + "1", 1, ""), ("g", hub + "2", "c", 0, "0"), ("g", hub + "2", "d", 0, "1"), ("g", "e", hub + "2", 1, "")]
    rng = random.Random(3)
    for g in "xyz":
        hubs = {hub + str(i): (rng.sample(range(14), 2), rng.sample(range(14), 2)) for i in range(9)}
        rows += [(g, h, str(n), 0, str(k)) for h, (ins, _) in hubs.items() for k, n in enumerate(ins)] + [(g, str(n), h, 1, h) for h, (_, outs) in hubs.items() for n in outs]
    df = spark.createDataFrame(rows, LINKS)
    want = {(g, *pair): d for g in "gxyz" for pair, d in brute_reach([(c, p) for g2, c, p, _, _ in rows if g2 == g]).items()}
    assert want["g", "b", "e"] == 2 and want["g", "d", "e"] == 1
    monkeypatch.setattr(hierarchy, "BLOCK", 4)
    for bound in (100, 8):
        pairs = hierarchy.reachable(df, bound).collect()
        assert {(r.grp, r.ancestor, r.descendant): r.distance for r in pairs} == want and len(pairs) == len(want)
        counts = {(r.grp, r.node): r.n_descendants for r in hierarchy.hierarchy(df, bound=bound).collect()}
        assert counts == {(g, n): sum(k[:2] == (g, n) for k in want) for g, n in counts} and counts["g", "b"] == 2
    rows += [("w", "m", hub + "3", 1, ""), ("w", hub + "3", "n", 0, ""), ("w", "n", "m", 1, ""), ("w", "o", "m", 1, ""), ("w", "p", "o", 1, "")]
    df = spark.createDataFrame(rows, LINKS)
    alike = [{(r.grp, r.node): (r.parent, r.state, r.n_descendants) for r in hierarchy.hierarchy(df, bound=bound).collect()} for bound in (100, 4)]
    assert alike[0] == alike[1] and alike[1]["w", "m"] == ("n", "closed", 3) and alike[1]["w", "p"] == ("o", "below_closed", 0)
    assert hierarchy.reachable(df.limit(0)).count() == 0


def test_column_descendants_below_closed_chains(spark, tmp_path):
    at = "flow_id string, final_dataset string, column_name string, origin_dataset string, origin_column string"
    hops = [("f", "A", "x", "b", "x"), ("f", "b", "x", "a", "x"), ("f", " c", "x", "b", "x"), ("f", "d", "x", "c", "x"), ("f", "e", "x", "d", "X"), ("f", "t", "x", None, None), ("f", "u", "x", "t", "x")]
    spark.createDataFrame(hops, at).write.parquet(str(tmp_path / "column_lineage.parquet"))
    spark.createDataFrame([], "flow_id string, recipe_id bigint, inputs array<string>, outputs array<string>, created_at timestamp_ntz").write.parquet(str(tmp_path / "recipes.parquet"))
    pairs = {(r.ancestor[0] + r.descendant[0], r.distance) for r in training.p2_column_descendants_all(spark, str(tmp_path)).collect()}
    assert pairs == {("cd", 1), ("ce", 2), ("de", 1), ("tu", 1), ("ab", 1), ("ba", 1), ("ac", 2), ("bc", 1), ("ad", 3), ("bd", 2), ("ae", 4), ("be", 3)}
    counts = {(r.node_name[0], r.state): r.n_descendants for r in training.p2_hierarchy(spark, str(tmp_path)).collect()}
    assert counts == {("a", "closed"): 4, ("b", "closed"): 4, ("c", "below_closed"): 2, ("d", "below_closed"): 1, ("e", "below_closed"): 0, ("t", "tree"): 1, ("u", "tree"): 0}


def test_closed_nodes_of_many_parents_equal_reachability():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(2, 14)
        links = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(rng.randrange(1, 20))]
        reach = set(links)
        while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
            reach |= more
        assert hierarchy.closed_nodes(links) == {a for a, b in reach if a == b}


def test_spread_closed_nodes_with_many_parents(spark):
    rng = random.Random(2)
    links = [("g", str(rng.randrange(25)), str(rng.randrange(25)), 1, "") for _ in range(45)]
    df = spark.createDataFrame(links, LINKS)
    want = hierarchy.closed_nodes([(c, p) for _, c, p, _, _ in links])
    assert {r.node for r in hierarchy._closed_spread(df, 4).collect()} == want


def test_orphans(spark):
    refs = spark.createDataFrame([("f", "a", ts(1), 1), ("f", "a", ts(5), 2), ("f", "a", ts(9), 3), ("f", "none", ts(1), 4), ("f", None, ts(1), 5), ("f", "a", None, 6), ("f", "twice", ts(3), 7), ("f", "a", ts(1), 1)], "flow string, name string, at timestamp_ntz, id int")
    parents = spark.createDataFrame([("f", "a", ts(1), ts(5), 0), ("f", "a", ts(8), None, 0), ("f", "twice", ts(4), ts(4), 0), ("f", "twice", None, None, 0), ("g", "none", ts(0), None, 0)], "flow string, name string, created_at timestamp_ntz, deleted_at timestamp_ntz, id int")
    lost = references.orphan_references(refs, parents, ["flow", "name"], "at")
    assert sorted(r.id for r in lost.collect()) == [2, 4, 6, 7]
    counts = {(r.flow, r.month): (r.n_references, r.n_orphans) for r in references.orphan_counts(refs, lost, "at", ["flow"]).collect()}
    assert counts["f", "2025-01"] == (7, 3) and counts["f", None] == (1, 1)
    assert references.orphan_keys(refs.limit(0), parents, ["flow", "name"], "at").count() == 0


def test_nested_shapes(spark):
    step = {"type": "A", "params": json.dumps({"steps": [{"type": "B", "params": {}}, {"type": "C", "params": {"steps": {"type": "D"}}}]})}
    bodies = [json.dumps({"recipes": [{"name": "r", "inputs": ["x", None], "steps": [step, None, {"type": "E"}]}]}), json.dumps({"recipes": {"k": {"settings": {"steps": {"type": "Z", "params": {}}}}}}), '{"recipes": [', None, "", "[1, 2]", '"text"']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_key int, body string")
    rows = [r.asDict() for r in nested.flatten(df).collect()]
    steps = sorted((r["row_key"], r["fields"].get("type")) for r in rows if r["tbl"] == "recipes.steps")
    assert steps == [("0/recipes/0/steps/0", "A"), ("0/recipes/0/steps/0/steps/0", "B"), ("0/recipes/0/steps/0/steps/1", "C"), ("0/recipes/0/steps/0/steps/1/steps/0", "D"), ("0/recipes/0/steps/1", None), ("0/recipes/0/steps/2", "E"), ("1/recipes/0/steps/0", "Z")]
    keys = {r["row_key"] for r in rows}
    assert all(r["parent_key"] is None or r["parent_key"] in keys for r in rows)
    assert [r["item_key"] for r in rows if r["tbl"] == "recipes" and r["doc_key"] == "1"] == ["k"]
    assert sorted((r["ordinal"], r["fields"]["value"]) for r in rows if r["tbl"] == "recipes.inputs") == [(0, "x"), (1, None)]
    flat = nested.flatten(df)
    schema = {(r.tbl, r.field): r.col_type for r in nested.merged_schema(flat).collect()}
    assert schema["recipes.steps", "type"] == "string"
    assert nested.relational(flat, "recipes.steps", {"type": "string"}).count() == 7
    assert nested.flatten(df.limit(0)).count() == 0


def log(spark, files):
    rows, n = [], 0
    for seq, lines in enumerate(files, 1):
        for x in lines:
            rows.append(("s", seq, n, x if isinstance(x, str) or x is None else json.dumps(x)))
            n += 1
    return spark.createDataFrame(rows, "series string, file_seq int, row_id bigint, raw string")


def test_drift_changes_and_consistent_table(spark):
    names = ["u1", "u2", "u3"]
    a = [{"user": u, "n": i, "gone": "q"} for i, u in enumerate(names)]
    b = ["﻿" + json.dumps({"who": u, "n": str(i), "added": True}) + "\t" for i, u in enumerate(names)] + ["{broken", "", None]
    c = [{"who": {"id": u}, "n": "x", "added": None} for u in names]
    lines = log(spark, [a, b, c]).cache()
    parsed = drift.parsed_lines(lines)
    got = {(r.file_seq, r.change_kind, r.old_field, r.new_field) for r in drift.changes(lines).collect()}
    assert got == {(2, "renamed", "user", "who"), (2, "type_changed", "n", "n"), (2, "removed", "gone", ""), (2, "added", "", "added"), (3, "type_changed", "who", "who")}
    fields = drift.canonical_fields(parsed, drift.changes(lines))
    assert fields["user"][0] == fields["who"][0]
    table = drift.consistent(parsed, {**fields, "n": ("n", "double")}).collect()
    assert len(table) == 12 and sum(not r.readable for r in table) == 3
    assert [r.failed_casts for r in table if r.file_seq == 3] == [["n"]] * 3
    assert drift.changes(log(spark, [])).count() == 0
