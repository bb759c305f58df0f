"""Flows: datasets and typed nodes as a graph, checked, explained and run as lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import UnsupportedError, ValidationError
from sparkloom.functions import quality
from sparkloom.functions.formula import columns_of, compile_formula, truthy
from sparkloom.operators import joins, prepare, relational
from sparkloom.sources import io

Inputs = list[DataFrame]
NODES: dict[str, Callable[[Inputs, dict[str, Any]], list[DataFrame]]] = {}
CALLABLES: dict[str, Callable[..., DataFrame]] = {}


def node(*names: str):
    """Register a node type: from inputs and settings to outputs."""

    def put(f):
        for n in names:
            NODES[n] = f
        return f

    return put


def register_node(name: str, f: Callable[[Inputs, dict], list[DataFrame]]) -> None:
    """Add a node type of one's own."""
    NODES[name] = f


def register_callable(name: str, f: Callable[..., DataFrame]) -> None:
    """Make a DataFrame function usable by code nodes."""
    CALLABLES[name] = f


def _filtered(df: DataFrame, s: dict, key: str) -> DataFrame:
    return df.where(truthy(compile_formula(s[key]))) if s.get(key) else df


@node("prepare")
def _prepare(ins, s):
    return [prepare.apply_steps(ins[0], s.get("steps") or [])]


@node("sync", "push_to_editable")
def _sync(ins, s):
    return [io.sync(ins[0], s.get("columns"))]


@node("grouping")
def _grouping(ins, s):
    return [relational.group(ins[0], s.get("keys") or [], s.get("aggregations") or [], s.get("globalCount", False), s.get("pre_filter"), s.get("post_filter"), s.get("drop_null_keys", False))]


@node("window")
def _window(ins, s):
    return [relational.window(ins[0], s.get("partition_columns") or [], s.get("order_columns") or [], s.get("window_aggregations") or s.get("aggregations") or [])]


@node("join")
def _join(ins, s):
    suffixes = tuple(s.get("suffixes") or ("_x", "_y"))
    out = _filtered(ins[0], s, "pre_filter")
    for k, right in enumerate(ins[1:]):
        keys = s["joins"][k]["keys"] if s.get("joins") else s.get("join_keys") or []
        how = s["joins"][k].get("type", "LEFT") if s.get("joins") else s.get("join_type", "LEFT")
        out = joins.join(out, right, keys, how, suffixes, s.get("null_safe", False))
    outs = [_filtered(out, s, "post_filter")]
    return [*outs, *joins.unmatched(ins[0], ins[1], s["join_keys"])] if s.get("unmatched_outputs") else outs


@node("fuzzyjoin")
def _fuzzy(ins, s):
    k = s["join_keys"][0]
    if s.get("direction"):
        return [joins.as_of(ins[0], ins[1], k["left"], k["right"], s.get("by"), s["direction"])]
    return [joins.fuzzy(ins[0], ins[1], k["left"], k["right"], float(s.get("threshold", 2.0)), str(s.get("distance_metric", "DAMERAU_LEVENSHTEIN")), s.get("threshold_relative", False), normalise=s.get("text_normalization"), how=s.get("join_type", "INNER"))]


@node("geojoin")
def _geo(ins, s):
    op = str(s.get("spatial_operator", "WITHIN_DISTANCE")).upper()
    if op in ("WITHIN_DISTANCE", "BEYOND_DISTANCE"):
        f = joins.within_distance if op == "WITHIN_DISTANCE" else joins.beyond_distance
        return [f(ins[0], ins[1], tuple(s["left_point"]), tuple(s["right_point"]), float(s["distance_value"]), s.get("distance_unit", "METER"))]
    return [joins.geo_join(ins[0], ins[1], s["left_column"], s["right_column"], op)]


@node("stack")
def _stack(ins, s):
    return [_filtered(relational.stack(ins), s, "post_filter")]


@node("split")
def _split(ins, s):
    return relational.split(ins[0], s.get("split_mode", "FILTER"), s.get("conditions") or ([s["condition"]] if s.get("condition") else None), s.get("column"), s.get("values"), s.get("weights"), s.get("key"))


@node("sort")
def _sort(ins, s):
    return [ins[0].orderBy(*relational.order_columns(s["sort_columns"]))]


@node("distinct")
def _distinct(ins, s):
    return [relational.distinct(ins[0], s.get("columns"), s.get("keep"), s.get("order"), s.get("compute_count", False))]


@node("topn")
def _topn(ins, s):
    order = s.get("sort_columns") or [{"column": s["ranking_column"], "order": "DESC"}]
    outs = [relational.top_n(ins[0], int(s["top_n"]), order, s.get("group_columns"), int(s.get("last_m", 0)))]
    return [*outs, relational.top_n(ins[0], int(s["top_n"]), order, s.get("group_columns"), int(s.get("last_m", 0)), rest=True)] if s.get("remaining_output") else outs


@node("pivot")
def _pivot(ins, s):
    values = s.get("values") or [{"column": s.get("value_column"), "type": s.get("aggregation", "COUNT")}]
    return [relational.pivot(ins[0], s.get("row_columns") or [], s["column_column"], values, s.get("modalities"), s.get("top"), s.get("min_count"), s.get("marginals", False), s.get("fill_value"))]


@node("sampling")
def _sampling(ins, s):
    df = _filtered(ins[0], s, "filter")
    return [relational.sample(df, s["sampling_method"], s.get("sample_size"), s.get("fraction"), s.get("column"), s.get("key"), s.get("order"))] if s.get("sampling_method") else [df]


@node("generate_statistics")
def _statistics(ins, s):
    numeric = [c for c, t in ins[0].dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")]
    return [relational.statistics(ins[0], s.get("columns") or numeric)]


@node("generate_features")
def _features(ins, s):
    df = ins[0]
    for c, t in ins[0].dtypes:
        if t.startswith(("timestamp", "date")):
            df = prepare.apply_steps(df, [{"type": "DateComponentExtractor", "params": {"column": c, "components": ["YEAR", "MONTH", "DAY_OF_WEEK"]}}])
        elif t == "string":
            df = df.withColumn(f"{c}_length", F.length(F.col(f"`{c}`")))
    return [df]


@node("extract_failed_rows")
def _failed(ins, s):
    return [quality.failed_rows(ins[0], s["rules"])]


@node("upsert")
def _upsert(ins, s):
    return [relational.upsert(ins[0], ins[1], s["keys"])]


@node("dynamic_repeat")
def _repeat(ins, s):
    rows = ins[1].limit(1001).collect()
    if len(rows) > 1000:
        raise ValidationError("a repeat takes at most 1000 parameter rows")
    outs = []
    for r in rows:
        steps = json.loads(_filled(json.dumps(s["steps"]), r.asDict()))
        outs.append(prepare.apply_steps(ins[0], steps))
    return [relational.stack(outs)]


def _filled(text: str, values: dict) -> str:
    for k, v in values.items():
        text = text.replace("${" + k + "}", json.dumps(str(v))[1:-1])
    return text


@node("sql_script", "hive", "impala", "spark_sql_query")
def _sql(ins, s):
    spark = ins[0].sparkSession
    for name, df in zip(s["views"], ins, strict=True):
        df.createOrReplaceTempView(name)
    return [spark.sql(s["code"])]


@node("python", "pyspark")
def _python(ins, s):
    name = s.get("function") or s.get("code")
    if name not in CALLABLES:
        raise UnsupportedError(f"no registered function {name!r}; source text is never executed")
    return [CALLABLES[name](*ins)]


@node("prediction_scoring", "clustering_scoring")
def _score(ins, s):
    from sparkloom.functions import ml

    return [ml.score(ins[0], s)]


@node("standalone_evaluation")
def _evaluate(ins, s):
    from sparkloom.functions import ml

    return [ml.evaluate(ins[0], s)]


for _name in ("r", "spark_scala", "sparkr", "shell", "download", "list_access", "ai_assistant_generate"):
    NODES[_name] = lambda ins, s, n=_name: (_ for _ in ()).throw(UnsupportedError(f"node type {n!r} has no meaning here"))


@node("list_folder_contents")
def _list(ins, s):
    return [io.list_folder(SparkSession.getActiveSession(), s["path"])]


def _copied(x: Any) -> Any:
    """A copy of plain parts; objects such as models are shared."""
    if isinstance(x, dict):
        return {k: _copied(v) for k, v in x.items()}
    return [_copied(v) for v in x] if isinstance(x, list) else x


class Flow:
    """A graph of datasets and nodes.

    ``spec``: ``{name, datasets: [{name, read?}], recipes: [{name, type, inputs, outputs, settings}],
    zones?}``. Nodes take settings under ``settings`` or beside their type.
    """

    def __init__(self, spec: dict[str, Any]) -> None:
        self.spec = _copied(spec)
        self.name = spec.get("name") or spec.get("flow_name") or "flow"
        self.datasets = {d["name"]: d for d in self.spec.get("datasets") or []}
        self.recipes = list(self.spec.get("recipes") or [])
        for r in self.recipes:
            for d in [*r.get("inputs", []), *r.get("outputs", [])]:
                self.datasets.setdefault(d, {"name": d})

    # --- graph ---

    def producers(self) -> dict[str, dict]:
        """The node that makes each dataset."""
        return {o: r for r in self.recipes for o in r.get("outputs", [])}

    def order(self) -> list[dict]:
        """Nodes so that each comes after those it needs; an error names a closed chain."""
        made = self.producers()
        state: dict[int, int] = {}
        out: list[dict] = []
        for start in self.recipes:
            stack = [(start, iter(start.get("inputs", [])))]
            if state.get(id(start)):
                continue
            state[id(start)] = 1
            while stack:
                r, rest = stack[-1]
                for d in rest:
                    up = made.get(d)
                    if up is None or state.get(id(up)) == 2:
                        continue
                    if state.get(id(up)) == 1:
                        raise ValidationError(f"the flow runs in a circle through {d!r}")
                    state[id(up)] = 1
                    stack.append((up, iter(up.get("inputs", []))))
                    break
                else:
                    state[id(r)] = 2
                    out.append(r)
                    stack.pop()
        return out

    def roots(self) -> list[str]:
        """Datasets that no node makes."""
        return [d for d in self.datasets if d not in self.producers()]

    def leaves(self) -> list[str]:
        """Datasets that no node reads."""
        used = {i for r in self.recipes for i in r.get("inputs", [])}
        return [d for d in self.datasets if d not in used]

    def components(self) -> list[set[str]]:
        """Datasets that hang together."""
        group = {d: {d} for d in self.datasets}
        for r in self.recipes:
            whole = set().union(*[group[d] for d in [*r.get("inputs", []), *r.get("outputs", [])]]) if r.get("inputs") or r.get("outputs") else set()
            for d in whole:
                group[d] = whole
        return [set(x) for x in {frozenset(g) for g in group.values()}]

    def path(self, a: str, b: str) -> list[str]:
        """Datasets from ``a`` down to ``b``, shortest way; empty if there is none."""
        seen = {a: None}
        queue = [a]
        while queue:
            x = queue.pop(0)
            if x == b:
                way = [b]
                while seen[way[-1]] is not None:
                    way.append(seen[way[-1]])
                return way[::-1]
            for r in self.recipes:
                if x in r.get("inputs", []):
                    for o in r.get("outputs", []):
                        if o not in seen:
                            seen[o] = x
                            queue.append(o)
        return []

    def validate(self) -> list[dict[str, str]]:
        """Findings: ``{level, code, message}``."""
        out = []
        try:
            self.order()
        except ValidationError as e:
            out.append({"level": "error", "code": "cycle", "message": str(e)})
        declared = {d["name"] for d in self.spec.get("datasets") or []}
        made = self.producers()
        for r in self.recipes:
            if r.get("type") not in NODES:
                out.append({"level": "error", "code": "node_type", "message": f"unknown node type {r.get('type')!r}"})
            for i in r.get("inputs", []):
                if declared and i not in declared and i not in made:
                    out.append({"level": "error", "code": "missing_dataset", "message": f"{r.get('name')} reads {i!r}, which nothing makes"})
            if r.get("type") in ("python", "pyspark"):
                out.append({"level": "info", "code": "python", "message": f"{r.get('name')} is code"})
        used = {d for r in self.recipes for d in [*r.get("inputs", []), *r.get("outputs", [])]}
        out += [{"level": "warning", "code": "orphan", "message": f"{d!r} is not used"} for d in self.datasets if d not in used]
        if len([c for c in self.components() if c & used]) > 1:
            out.append({"level": "warning", "code": "disconnected", "message": "the flow falls into parts"})
        return out

    # --- running ---

    def settings(self, r: dict) -> dict:
        return {**{k: v for k, v in r.items() if k not in ("name", "type", "inputs", "outputs", "settings")}, **(r.get("settings") or {})}

    def run(self, spark: SparkSession, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All datasets as lazy DataFrames; nothing is computed but data-dependent schemas."""
        have = dict(inputs or {})
        for d, spec in self.datasets.items():
            if d not in have and spec.get("read"):
                have[d] = io.read(spark, spec["read"])
        for r in self.order():
            if r.get("type") not in NODES:
                raise UnsupportedError(f"node type {r.get('type')!r}")
            missing = [i for i in r.get("inputs", []) if i not in have]
            if missing:
                raise ValidationError(f"{r.get('name')}: no data for {missing}")
            outs = NODES[r["type"]]([have[i] for i in r.get("inputs", [])], self.settings(r))
            for name, df in zip(r.get("outputs", []), outs, strict=False):
                have[name] = df
        return have

    def store(self, made: dict[str, DataFrame]) -> list[str]:
        """Write every dataset that has a ``write`` description; the names of those written."""
        names = [d for d, spec in self.datasets.items() if spec.get("write")]
        for d in names:
            io.write(made[d], self.datasets[d]["write"])
        return names

    # --- lineage, text, comparison ---

    def column_lineage(self, dataset: str, column: str) -> list[tuple[str, str]]:
        """``(dataset, column)`` steps from a column up to where it comes from."""
        made = self.producers()
        out, queue, seen = [], [(dataset, column)], set()
        while queue:
            d, c = queue.pop(0)
            if (d, c) in seen:
                continue
            seen.add((d, c))
            out.append((d, c))
            if d in made:
                r = made[d]
                queue += [(i, x) for i in r.get("inputs", []) for x in self._sources(r, c)]
        return out

    def _sources(self, r: dict, column: str) -> list[str]:
        s = self.settings(r)
        if r["type"] == "prepare":
            wanted = {column}
            for step in reversed(s.get("steps") or []):
                p, name = step.get("params") or {}, step.get("type")
                if name == "ColumnRenamer":
                    pairs = p["renamings"] if isinstance(p["renamings"], dict) else {x["from"]: x["to"] for x in p["renamings"]}
                    back = {v: k for k, v in pairs.items()}
                    wanted = {back.get(c, c) for c in wanted}
                elif (target := p.get("outputColumn")) in wanted and target:
                    reads = columns_of(p["expression"]) if p.get("expression") else set(p.get("columns") or []) | {p[k] for k in ("column", "inputColumn", "column1", "column2") if k in p}
                    wanted = (wanted - {target}) | reads
                elif name in ("CreateColumnWithGREL", "Formula") and p.get("column") in wanted:
                    wanted = (wanted - {p["column"]}) | columns_of(p["expression"])
            return sorted(wanted)
        for a in [*(s.get("aggregations") or []), *(s.get("window_aggregations") or [])]:
            if column == (a.get("outputColumn") or f"{a.get('column')}_{a['type'].lower()}"):
                return [a["column"]] if a.get("column") not in (None, "*") else []
        if r["type"] == "join" and column.endswith(("_x", "_y")):
            return [column[:-2]]
        return [column]

    def to_dict(self) -> dict[str, Any]:
        """Canonical form: sorted datasets and nodes."""
        return {"name": self.name, "datasets": sorted(self.datasets.values(), key=lambda d: d["name"]), "recipes": sorted(self.recipes, key=lambda r: str(r.get("name"))), "zones": self.spec.get("zones") or []}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Flow:
        return cls(json.loads(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=True, allow_unicode=True)

    @classmethod
    def from_yaml(cls, text: str) -> Flow:
        import yaml

        return cls(yaml.safe_load(text))

    def diff(self, other: Flow) -> dict[str, Any]:
        """Nodes added, removed and changed from this flow to another."""
        a = {r.get("name"): r for r in self.recipes}
        b = {r.get("name"): r for r in other.recipes}
        changed = sorted(k for k in a.keys() & b.keys() if json.dumps(a[k], sort_keys=True) != json.dumps(b[k], sort_keys=True))
        out = {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": changed}
        return {**out, "equivalent": not any(out.values()) and self.datasets.keys() == other.datasets.keys()}

    def complexity(self) -> float:
        """Nodes + 0.1 steps + 0.5 depth + 0.2 widest fan-out."""
        depth: dict[str, int] = {}
        for r in self.order():
            d = 1 + max([depth.get(i, 0) for i in r.get("inputs", [])] or [0])
            depth |= dict.fromkeys(r.get("outputs", []), d)
        fan = max([sum(d in r.get("inputs", []) for r in self.recipes) for d in self.datasets] or [0])
        steps = sum(len(self.settings(r).get("steps") or []) for r in self.recipes)
        return round(len(self.recipes) + 0.1 * steps + 0.5 * max(depth.values(), default=0) + 0.2 * fan, 2)

    def mermaid(self) -> str:
        """The graph as Mermaid text."""
        ids = {d: f"d{i}" for i, d in enumerate(self.datasets)}
        lines = ["flowchart LR", *[f'  {ids[d]}[("{d}")]' for d in self.datasets]]
        for k, r in enumerate(self.recipes):
            lines.append(f'  r{k}["{r.get("type")}"]')
            lines += [f"  {ids[i]} --> r{k}" for i in r.get("inputs", [])] + [f"  r{k} --> {ids[o]}" for o in r.get("outputs", [])]
        return "\n".join(lines)

    def ascii(self) -> str:
        """The graph as lines of text."""
        return "\n".join(f"{', '.join(r.get('inputs', []))} --[{r.get('type')}]--> {', '.join(r.get('outputs', []))}" for r in self.order())

    def summary(self) -> str:
        return f"{self.name}: {len(self.datasets)} datasets, {len(self.recipes)} nodes, complexity {self.complexity()}"
