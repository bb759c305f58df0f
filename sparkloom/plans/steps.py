"""Step-JSON: a list of declarative operations, lowered to a flow."""

from __future__ import annotations

from typing import Any

from sparkloom.errors import UnsupportedError
from sparkloom.plans.flow import Flow

FILTERS = {"contains": "SUBSTRING", "substring": "SUBSTRING", "regex": "PATTERN", "matches": "PATTERN", "pattern": "PATTERN", "in": "IN_LIST", "isin": "IN_LIST", "!=": "NOT_EQUALS", "ne": "NOT_EQUALS", "not_equals": "NOT_EQUALS", "==": "EQUALS", "=": "EQUALS", "eq": "EQUALS", "equals": "EQUALS", "is_null": "IS_NULL", "not_null": "IS_NOT_NULL", "starts_with": "STARTS_WITH", "ends_with": "ENDS_WITH"}
BOUNDS = {">": ("min", True), "gt": ("min", True), "greater_than": ("min", True), ">=": ("min", False), "gte": ("min", False), "greater_or_equal": ("min", False), "<": ("max", True), "lt": ("max", True), "less_than": ("max", True), "<=": ("max", False), "lte": ("max", False), "less_or_equal": ("max", False)}


def filter_step(cond: dict) -> dict:
    """One filter condition as a processor; bounds stay strict where they are strict."""
    op, value = str(cond.get("operator", "==")).lower(), cond.get("value")
    if op in ("formula", "expression", "grel"):
        return {"type": "FilterOnFormula", "params": {"formula": value}}
    if op in BOUNDS:
        side, strict = BOUNDS[op]
        return {"type": "FilterOnNumericRange", "params": {"column": cond["column"], side: value, "strict": strict}}
    if op not in FILTERS:
        raise UnsupportedError(f"filter operator {op!r}")
    values = value if isinstance(value, list) else [] if value is None else [value]
    return {"type": "FilterOnValue", "params": {"column": cond["column"], "matchingMode": FILTERS[op], "values": values}}


def _any_of(conds: list[dict]) -> dict:
    parts = []
    for c in conds:
        op, v = str(c.get("operator", "==")).lower(), c.get("value")
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "=": "==", "equals": "==", "ne": "!="}.get(op, op)
        text = "[" + ", ".join(map(_lit, v)) + "]" if isinstance(v, list) else _lit(v)
        parts.append(f'(val("{c["column"]}") {"in" if sign in ("in", "isin") else sign} {text})')
    return {"type": "FilterOnFormula", "params": {"formula": " || ".join(parts)}}


def _lit(v: Any) -> str:
    if v is None:
        return "null"
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)


def _prepare(op: str, s: dict) -> list[dict] | None:
    """Processors of one operation, or None if it is a node of its own."""
    cols = s.get("columns") or []
    t = s.get("column_transforms") or []
    if op == "filter":
        conds = s.get("filter_conditions") or []
        return [_any_of(conds)] if str(s.get("logic", "and")).lower() == "or" else [filter_step(c) for c in conds]
    if op == "select_columns":
        return [{"type": "ColumnsSelector", "params": {"columns": cols}}]
    if op == "drop_columns":
        return [{"type": "ColumnsSelector", "params": {"columns": cols, "keep": False}}]
    if op == "rename_columns":
        return [{"type": "ColumnRenamer", "params": {"renamings": s["rename_mapping"]}}]
    if op == "add_column":
        return [{"type": "CreateColumnWithGREL", "params": {"column": x.get("output_column") or x["column"], "expression": x["expression"]}} for x in t]
    if op == "transform_column":
        return [_transform(x) for x in t]
    if op == "fill_missing":
        fills = s.get("fill_values") or dict.fromkeys(cols, s.get("fill_value"))
        return [{"type": "FillEmptyWithValue", "params": {"column": c, "value": v}} for c, v in fills.items()]
    if op == "drop_missing":
        return [{"type": "RemoveRowsOnEmpty", "params": {"columns": cols} if cols else {"appliesTo": "ALL", "column": ""}}]
    if op == "cast_type":
        return [{"type": "TypeSetter", "params": {"column": x["column"], "type": x.get("type") or x.get("operation")}} for x in t]
    if op == "parse_date":
        return [{"type": "DateParser", "params": {"column": x["column"], **({"formats": [x["format"]]} if x.get("format") else {})}} for x in t]
    if op == "split_column":
        return [{"type": "ColumnsSplitter", "params": {"column": x["column"], "separator": x.get("separator", ","), **({"outputColumns": x["output_columns"]} if x.get("output_columns") else {})}} for x in t]
    if op == "encode_categorical":
        return [{"type": "CategoricalEncoder", "params": {"column": c, "encoding": s.get("encoding", "ONE_HOT")}} for c in cols]
    if op == "normalize_scale":
        return [{"type": "MeasureNormalize", "params": {"column": c, "mode": s.get("mode", "MIN_MAX")}} for c in cols]
    if op == "unpivot":
        return [{"type": "FoldMultipleColumns", "params": {"columns": cols, "varName": s.get("var_name", "variable"), "valueName": s.get("value_name", "value")}}]
    if op == "geo_operation":
        return [{"type": "GeoPointCreator", "params": {"latColumn": cols[0], "lonColumn": cols[1], "outputColumn": s.get("output_column", "geopoint")}}]
    return None


def _transform(x: dict) -> dict:
    op = str(x["operation"]).upper()
    from sparkloom.functions.modes import NUMERIC, STRING

    name = {"UPPER": "TO_UPPER", "LOWER": "TO_LOWER", "STRIP": "TRIM", "TITLE": "TITLECASE"}.get(op, op)
    params = {"column": x["column"], "mode": name, **({"outputColumn": x["output_column"]} if x.get("output_column") else {})}
    if name in STRING:
        return {"type": "StringTransformer", "params": params}
    if name in NUMERIC:
        return {"type": "NumericalTransformer", "params": {**params, "value": x.get("value")}}
    raise UnsupportedError(f"transform {x['operation']!r}")


def _node(op: str, s: dict) -> tuple[str, dict]:
    if op == "drop_duplicates":
        return "distinct", {"columns": s.get("columns") or None, "keep": "first" if s.get("columns") else None, "order": s.get("sort_columns")}
    if op == "group_aggregate":
        return "grouping", {"keys": s.get("group_by_columns") or [], "aggregations": [{"column": a.get("column"), "type": a.get("function") or a["type"], "outputColumn": a.get("output_column")} for a in s["aggregations"]]}
    if op == "window_function":
        return "window", {"partition_columns": s.get("partition_columns") or s.get("group_by_columns") or [], "order_columns": s.get("sort_columns") or [], "window_aggregations": [{"column": a.get("column"), "type": a.get("function") or a["type"], "windowSize": a.get("window_size"), "outputColumn": a.get("output_column")} for a in s["aggregations"]]}
    if op == "join":
        return "join", {"join_type": str(s.get("join_type", "LEFT")).upper(), "join_keys": [{"left": c.get("left_column") or c["left"], "right": c.get("right_column") or c["right"], "matchType": c.get("match_type", "EQ")} for c in s["join_conditions"]]}
    if op == "union":
        return "stack", {}
    if op == "pivot":
        return "pivot", {"row_columns": s.get("row_columns") or s.get("group_by_columns") or [], "column_column": s["pivot_column"], "value_column": s.get("value_column"), "aggregation": s.get("aggregation", "SUM"), "modalities": s.get("modalities")}
    if op == "sort":
        return "sort", {"sort_columns": s["sort_columns"]}
    if op == "top_n":
        return "topn", {"top_n": s.get("n") or s.get("top_n"), "sort_columns": s["sort_columns"], "group_columns": s.get("group_by_columns")}
    if op == "sample":
        return "sampling", {"sampling_method": s.get("method", "RANDOM_FIXED_NB"), "sample_size": s.get("n"), "fraction": s.get("fraction"), "key": s.get("key")}
    if op == "statistics":
        return "generate_statistics", {"columns": s.get("columns")}
    if op == "custom_function":
        return "python", {"function": s.get("function")}
    raise UnsupportedError(f"operation {op!r}")


def compile_steps(doc: dict[str, Any]) -> Flow:
    """``{"steps": [{operation, input_datasets, output_dataset, ...}]}`` as a flow.

    ``read_data`` names an input, ``write_data`` an output; an unknown operation is an error.
    """
    recipes, datasets, sinks = [], [], {}
    for i, s in enumerate(doc.get("steps") or []):
        op = str(s["operation"]).lower()
        ins = s.get("input_datasets") or ([s["input_dataset"]] if s.get("input_dataset") else [])
        outs = s.get("output_datasets") or ([s["output_dataset"]] if s.get("output_dataset") else [])
        if op == "read_data":
            datasets += [{"name": o, **({"read": s["read"]} if s.get("read") else {})} for o in outs]
            continue
        if op == "write_data":
            # written by ``Flow.store`` after the run; without a description it only names an output
            sinks |= {n: s["write"] for n in ins if s.get("write")}
            continue
        steps = _prepare(op, s)
        kind, settings = ("prepare", {"steps": steps}) if steps is not None else _node(op, s)
        recipes.append({"name": f"{op}_{i}", "type": kind, "inputs": ins, "outputs": outs, "settings": settings})
    names = {d["name"] for d in datasets} | {d for r in recipes for d in [*r["inputs"], *r["outputs"]]}
    whole = datasets + [{"name": n} for n in sorted((names | sinks.keys()) - {d["name"] for d in datasets})]
    return Flow({"name": doc.get("name", "steps"), "datasets": [{**d, **({"write": sinks[d["name"]]} if d["name"] in sinks else {})} for d in whole], "recipes": recipes})
