"""Deeply nested semi-structured records to related flat tables with parent links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

ROWS = "doc_key string, tbl string, row_key string, parent_tbl string, parent_key string, ordinal int, item_key string, fields map<string,string>, kinds map<string,string>"
STATS = "name string, kind string, n bigint"
#: Field names that may hold arrays; a schema with more of them is refused instead of collected.
MAX_ARRAY_NAMES = 20_000


_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|(-?[0-9][0-9.eE+-]*|true|false|null|NaN|-?Infinity))', re.DOTALL)


def _deep(text: str):
    """JSON of any depth, for what the recursive parser gives up on; ``ValueError`` like it."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    at, end, need = 0, len(text.rstrip(" \t\r\n")), "v"  # v: value, f: first value or end, k: key, o: first key or end, c: comma or end
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, top = m[1], stack[-1]
        if need in ("k", "o") and m[2]:
            keys[-1] = json.loads(m[2])
            m = _TOKEN.match(text, at)
            if m is None or m[1] != ":":
                raise ValueError(f"no colon at {at}")
            at, need = m.end(), "v"
        elif need in ("v", "f") and (m[2] or m[3] or mark in ("[", "{")):
            value = [] if mark == "[" else {} if mark == "{" else json.loads(m[2] or m[3])
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
            if mark:
                stack.append(value)
                keys.append(None)
            need = {"[": "f", "{": "o"}.get(mark, "c")
        elif mark == "," and need == "c" and len(stack) > 1:
            need = "v" if isinstance(top, list) else "k"
        elif len(stack) > 1 and (mark == "]" and isinstance(top, list) and need in "fc" or mark == "}" and isinstance(top, dict) and need in "oc"):
            stack.pop()
            keys.pop()
            need = "c"
        else:
            raise ValueError(f"unexpected JSON at {at}")
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("incomplete JSON")
    return root[0]


def loads(text: str):
    """JSON text as Python values, however deep it is nested."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def opened(value):
    """The value, or what it holds if it is text that holds a JSON object or array, quoted however
    many times."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = value
        while isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[", '"'):
            try:
                inner = loads(inner)
            except ValueError:
                return value
        if not isinstance(inner, (dict, list)):
            return value
        value = inner
    return value


def readable(body: str | None):
    """The parsed body, or None if it is null or unreadable. Stray marks around it don't matter."""
    if body is None:
        return None
    try:
        return opened(loads(body.strip("\ufeff\u200b \t\r\n")))
    except ValueError:
        return None


def json_kind(v) -> str:
    """JSON type of a parsed value."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    if isinstance(v, str):
        return "string"
    return "object" if isinstance(v, dict) else "array"


def as_text(v) -> str | None:
    """Text of a leaf: strings as they are, others as JSON."""
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _array_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per field name: how often it holds an array; per array name, the fields of its elements."""
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for body in batch["body"]:
            stack = [("", readable(body))]
            while stack:
                name, v = stack.pop()
                v = opened(v)
                if isinstance(v, dict):
                    stack.extend((str(k), x) for k, x in v.items())
                elif isinstance(v, list):
                    seen[name, "[]"] = seen.get((name, "[]"), 0) + 1
                    for x in v:
                        x = opened(x)
                        if isinstance(x, dict):
                            for k in x:
                                seen[name, k] = seen.get((name, k), 0) + 1
                        stack.append((name, x))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["name", "kind", "n"])


def array_fields(docs: DataFrame) -> dict[str, set[str]]:
    """Names of fields that hold arrays anywhere in the corpus, with the fields of their elements.

    ``docs`` has ``body`` (JSON text). Counted over all bodies, combined before the shuffle. The
    result is schema, not data: more than ``MAX_ARRAY_NAMES`` entries raise an error.
    """
    found = docs.select("body").mapInPandas(_array_stats, STATS).groupBy("name", "kind").agg(F.sum("n").alias("n"))
    rows = found.select("name", "kind").limit(MAX_ARRAY_NAMES + 1).collect()
    if len(rows) > MAX_ARRAY_NAMES:
        raise ValueError("the bodies hold no common schema: too many array fields")
    names: dict[str, set[str]] = {}
    for r in rows:
        names.setdefault(r["name"], set()).add(r["kind"])
    return {k: v - {"[]"} for k, v in names.items() if "[]" in v and k != ""}


def _members(v, known: set[str]) -> list[tuple[str | None, object]]:
    """Elements of an array field in any of its shapes: a list, a lone element, or an object keyed
    by element name. An object whose keys are fields of the elements is a lone element."""
    if v is None:
        return []
    if isinstance(v, list):
        return [(None, opened(x)) for x in v]
    if isinstance(v, dict):
        if v and not set(v) <= known and all(isinstance(opened(x), dict) for x in v.values()):
            return [(str(k), opened(x)) for k, x in v.items()]
        return [(None, v)] if v else []
    return [(None, v)]


def flatten_one(doc_key: str, value, arrays: dict[str, set[str]], tables: frozenset[str] | None = None, only: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of one document: the root record, then every element of every array level below it.

    Of ``tables`` only, if given, and with the fields ``only``, if given: what is not asked for is
    walked, but no row or field is made of it."""
    value = opened(value)
    roots = [(None, value)] if isinstance(value, dict) else [(None, opened(x)) for x in value] if isinstance(value, list) else []
    stack = [("root", f"{doc_key}#{i}" if isinstance(value, list) else doc_key, None, None, i, k, x) for i, (k, x) in enumerate(roots)]
    while stack:
        tbl, key, parent_tbl, parent_key, ordinal, item_key, record = stack.pop()
        fields: dict[str, str | None] = {}
        kinds: dict[str, str] = {}
        if isinstance(record, dict):
            work = [("", record)]
            while work:
                prefix, obj = work.pop()
                for k, raw in obj.items():
                    k = str(k)
                    v = opened(raw)
                    name = prefix + k
                    if k in arrays and (v is None or isinstance(v, (list, dict)) or arrays[k]):
                        child = k if tbl == "root" else tbl if tbl.rsplit(".", 1)[-1] == k else f"{tbl}.{k}"
                        for i, (ik, x) in enumerate(_members(v, arrays[k])):
                            stack.append((child, f"{key}/{k}/{i}", tbl, key, i, ik, x))
                    elif isinstance(v, dict):
                        if only is None:
                            kinds[name] = "object"
                        work.append((name + ".", v))
                    elif isinstance(v, list):
                        for i, x in enumerate(v):
                            stack.append((f"{tbl}.{k}", f"{key}/{k}/{i}", tbl, key, i, None, opened(x)))
                    elif only is None or name in only:
                        fields[name] = as_text(v)
                        kinds[name] = json_kind(v)
        else:
            fields["value"], kinds["value"] = as_text(record), json_kind(record)
        if tables is None or tbl in tables:
            yield doc_key, tbl, key, parent_tbl, parent_key, ordinal, item_key, fields, kinds


def flatten(docs: DataFrame, arrays: dict[str, set[str]] | None = None, tables: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Rows of all levels of ``docs`` (``doc_key``, ``body``) as ``(doc_key, tbl, row_key, ...)``.

    The schema is merged over the corpus first; each array level then becomes a table named by the
    chain of array fields, an array nested in its own kind staying in that kind's table. Objects
    between arrays become dotted fields. Each row has a surrogate key, that of its parent and its
    zero-based ordinal in the parent's array; null elements keep their ordinal and have the field
    ``value``. Unreadable and null bodies and null keys give no rows; nothing else is dropped.
    ``tables`` and ``only`` name the tables and fields that are wanted, so that no others are built.
    """
    picked = docs.select(F.col("doc_key").cast("string").alias("doc_key"), "body").where(F.col("doc_key").isNotNull() & F.col("body").isNotNull())
    shape = array_fields(picked) if arrays is None else arrays

    some = None if tables is None else frozenset(tables)
    few = None if only is None else frozenset(only)
    schema = to_arrow_schema(_parse_datatype_string(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            made = [pa.array([list(x.items()) for x in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(made, schema=schema)

        out: list[tuple] = []
        for batch in batches:
            for doc_key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in flatten_one(doc_key, readable(body), shape, some, few):
                    out.append(row)
                    if len(out) >= 5000:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return picked.mapInArrow(run, ROWS)


def merged_schema(rows: DataFrame) -> DataFrame:
    """``(tbl, field, col_type, n)``: the type that holds all values of each field of each table."""
    kinds = rows.select("tbl", F.explode("kinds").alias("field", "kind")).groupBy("tbl", "field").agg(F.collect_set("kind").alias("k"), F.count(F.lit(1)).alias("n"))
    real = F.array_remove(F.array_remove("k", F.lit("null")), F.lit("object"))
    only = lambda *ts: F.size(F.array_except(real, F.array(*[F.lit(t) for t in ts]))) == 0
    kind = F.when(F.size(real) == 0, "string").when(only("boolean"), "boolean").when(only("integer"), "bigint").when(only("integer", "number"), "double").otherwise("string")
    return kinds.where(F.size(F.array_remove("k", F.lit("object"))) > 0).select("tbl", "field", kind.alias("col_type"), "n")


#: Fields that one flat table may have as columns.
MAX_COLUMNS = 2000


def column_names(fields: list[str], taken: set[str]) -> dict[str, str]:
    """A column name for each field: letters, digits and underscores, no two alike in lower case."""
    out: dict[str, str] = {}
    used = {t.lower() for t in taken}
    for f in sorted(fields):
        base = re.sub(r"\W+", "_", f).strip("_") or "field"
        name, n = base, 2
        while name.lower() in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name.lower())
        out[f] = name
    return out


def relational(rows: DataFrame, tbl: str, schema: dict[str, str] | None = None) -> DataFrame:
    """One flat table: keys and ordinal, then a typed column for each field of ``schema``, by default
    the merged schema of all rows of the table. More than ``MAX_COLUMNS`` fields raise an error. A
    value that the merged type can't hold is null."""
    keys = ["doc_key", "row_key", "parent_tbl", "parent_key", "ordinal", "item_key"]
    mine = rows.where(F.col("tbl") == tbl)
    if schema is None:
        found = merged_schema(mine).select("field", "col_type").limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"{tbl} has more than {MAX_COLUMNS} fields")
        schema = {r["field"]: r["col_type"] for r in found}
    names = column_names(list(schema), set(keys))
    return mine.select(*keys, *[F.col("fields")[f].try_cast(schema[f]).alias(n) for f, n in names.items()])
