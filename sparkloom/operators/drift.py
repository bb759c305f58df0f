"""Schemas that drift between files: one consistent table and a report of each change."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.nested import as_text, json_kind, opened
from sparkloom.session import written

PARSED = "series string, file_seq bigint, row_id bigint, readable boolean, vals map<string,string>, kinds map<string,string>, leaves map<string,array<bigint>>"
#: Least share of the smaller value set that two fields must have in common to be one renamed field.
CARRIED = 0.5
#: A rename counts for the consistent table if it occurs this often relative to the old name's commonest.
MIN_RENAMES = 0.02
#: Distinct field names of one kind of record; schema, not data.
MAX_FIELDS = 20_000


def loosely(raw: str | None):
    """The JSON object of a raw line, with anything before its first and after its last brace cut
    off; None for lines that hold none."""
    if raw is None:
        return None
    a, b = raw.find("{"), raw.rfind("}")
    if a < 0 or b <= a:
        return None
    try:
        v = json.loads(raw[a : b + 1])
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def scalars(v) -> Iterator[str]:
    """Texts of all scalar values below ``v``; text that holds JSON counts as what it holds."""
    stack = [v]
    while stack:
        x = opened(stack.pop())
        if isinstance(x, dict):
            stack.extend(x.values())
            if not any(isinstance(y, str) for y in x.values()):
                stack.extend(x)
        elif isinstance(x, list):
            stack.extend(x)
        elif x is not None:
            yield as_text(x)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for series, seq, row_id, raw in zip(batch["series"], batch["file_seq"], batch["row_id"], batch["raw"], strict=True):
            v = loosely(raw)
            if v is None:
                out.append((series, seq, row_id, False, {}, {}, {}))
                continue
            kinds = {k: json_kind(x) for k, x in v.items()}
            out.append(
                (
                    series,
                    seq,
                    row_id,
                    True,
                    {k: as_text(x) for k, x in v.items()},
                    {k: "number" if t == "integer" else t for k, t in kinds.items()},
                    {k: list({_hash(s) for s in scalars(x)}) for k, x in v.items()},
                )
            )
        yield pd.DataFrame(out, columns=["series", "file_seq", "row_id", "readable", "vals", "kinds", "leaves"])


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Raw lines (``series, file_seq, row_id, raw``) as path-value maps with their raw types.

    ``kinds`` has the JSON type of each top-level field, ``leaves`` the hashes of its scalar values.
    Lines without series or file are left out; unreadable and blank ones have ``readable`` false.
    """
    picked = lines.select(F.col("series"), F.col("file_seq").cast("bigint").alias("file_seq"), F.col("row_id").cast("bigint").alias("row_id"), "raw")
    return picked.where(F.col("series").isNotNull() & F.col("file_seq").isNotNull()).mapInPandas(_parse, PARSED)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the lines of each batch by file and field: a combine before the shuffle."""
    for batch in batches:
        held: dict[tuple, list] = {}
        for series, seq, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for k, x in ({None: None} if (v := loosely(raw)) is None else v).items():
                at = held.get((series, seq, k))
                if at is None:
                    at = held[series, seq, k] = [0, 0, 0, 0, 0, set()]
                if x is None:
                    continue
                at[_SLOT[type(x)]] += 1
                if type(x) is str and x.lstrip()[:1] not in ("{", "["):
                    at[5].add(x)
                else:
                    at[5].update(scalars(x))
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.string()))]
        columns += [pa.array([v[i] for v in held.values()], pa.int64()) for i in range(5)]
        columns.append(pa.array([[_hash(s) for s in v[5]] for v in held.values()], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["series", "file_seq", "field", *KINDS, "leaves"])


#: JSON types in the order of the alphabet, which settles ties.
KINDS = ("array", "boolean", "number", "object", "string")
_SLOT = {list: 0, bool: 1, int: 2, float: 2, dict: 3, str: 4}
STATS = "series string, file_seq bigint, field string, " + ", ".join(f"`{k}` bigint" for k in KINDS) + ", leaves array<bigint>"


def file_stats(lines: DataFrame) -> DataFrame:
    """Path-type statistics of raw lines (``series, file_seq, raw``) by file: for each top-level field
    the number of values of each JSON type and hashes of its scalar values.

    Several rows of one field and file add up: they come from different parts of the file. A file of
    which no line can be read has one row with an empty field and no values.
    """
    picked = lines.select("series", F.col("file_seq").cast("bigint").alias("file_seq"), "raw").where(F.col("series").isNotNull() & F.col("file_seq").isNotNull())
    return picked.mapInArrow(_stats_batches, STATS)


def file_steps(stats: DataFrame) -> DataFrame:
    """``(series, file_seq, prev_seq, gone, fresh, typed)``: each file that has one before it in its
    series, with the fields that vanished, that are new and that changed type.

    The type of a field is that of most of its non-null values, ties going to the first in the
    alphabet; a field without values has none and changes nothing.
    """
    counted = stats.groupBy("series", "file_seq", "field").agg(*[F.sum(k).alias(k) for k in KINDS])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i")) for i, k in enumerate(KINDS)]))
    kind = F.when(best["n"] > 0, F.get(F.array(*[F.lit(k) for k in KINDS]), -best["i"]))
    files = counted.groupBy("series", "file_seq").agg(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", kind.alias("kind"))))).alias("now"))
    by = Window.partitionBy("series").orderBy("file_seq")
    steps = files.withColumn("prev_seq", F.lag("file_seq").over(by)).withColumn("before", F.lag("now").over(by)).where(F.col("prev_seq").isNotNull())
    names = lambda c: F.transform(c, lambda x: x["field"])
    was = F.map_from_entries("before")
    typed = F.filter("now", lambda x: x["kind"] != F.element_at(F.col("was"), x["field"]))
    return steps.withColumn("was", was).select(
        "series", "file_seq", "prev_seq", F.array_except(names("before"), names("now")).alias("gone"), F.array_except(names("now"), names("before")).alias("fresh"), names(typed).alias("typed")
    )


def _renamed(steps: DataFrame, stats: DataFrame) -> DataFrame:
    """``(series, file_seq, moved)``: pairs of a vanished and a new field of one step where the new one
    carries on the values of the old: best match of either side, greatest share of common values
    first. Only fields of steps that have both are looked at."""
    key = ["series", "step"]
    both = steps.where((F.size("gone") > 0) & (F.size("fresh") > 0))
    side = lambda seq, name, fields: F.struct(seq.alias("file_seq"), F.lit(name).alias("side"), fields.alias("field"))
    wanted = both.select("series", F.col("file_seq").alias("step"), F.inline(F.array(side(F.col("prev_seq"), "o", F.col("gone")), side(F.col("file_seq"), "n", F.col("fresh")))))
    wanted = wanted.withColumn("field", F.explode("field"))
    values = stats.join(wanted, ["series", "file_seq", "field"]).select(*key, "side", "field", F.explode("leaves").alias("h")).distinct()
    # the fields of one step that hold a value: as few as the step has fields
    held = values.groupBy(*key, "h").agg(F.collect_set(F.when(F.col("side") == "o", F.col("field"))).alias("o"), F.collect_set(F.when(F.col("side") == "n", F.col("field"))).alias("n"))
    none = F.array(F.lit(None).cast("string"))
    counted = held.select(*key, F.explode(F.concat("o", none)).alias("o"), "n").select(*key, "o", F.explode(F.concat("n", none)).alias("n"))
    counted = counted.where("o is not null or n is not null").groupBy(*key, "o", "n").agg(F.count(F.lit(1)).alias("c"))
    of = lambda *by: Window.partitionBy(*key, *by)
    sized = counted.repartition(*key).withColumn("n_old", F.max(F.when(F.col("n").isNull(), F.col("c"))).over(of("o"))).withColumn("n_new", F.max(F.when(F.col("o").isNull(), F.col("c"))).over(of("n")))
    scored = sized.where("o is not null and n is not null").withColumn("share", F.col("c") / F.least("n_old", "n_new")).where(F.col("share") >= CARRIED)
    scored = scored.withColumn("jac", F.col("c") / (F.col("n_old") + F.col("n_new") - F.col("c")))
    rank = [F.desc("share"), F.desc("jac"), F.desc("c")]
    ranked = scored.withColumn("ro", F.row_number().over(of("o").orderBy(*rank, "n"))).withColumn("rn", F.row_number().over(of("n").orderBy(*rank, "o")))
    return ranked.where("ro = 1 and rn = 1").groupBy(*key).agg(F.collect_list(F.struct("o", "n")).alias("moved")).withColumnRenamed("step", "file_seq")


def changes(lines: DataFrame) -> DataFrame:
    """``(series, file_seq, change_kind, old_field, new_field)`` between each file of raw lines
    (``series, file_seq, raw``) and the one before.

    ``added`` (old field empty), ``removed`` (new field empty), ``renamed`` (the new field carries
    on the values of the vanished one) and ``type_changed``. The first file of a series changes
    nothing. Files are those with at least one line in the table. The statistics by file and field
    are written once; all steps then are one window over the files of a series, and values are
    joined only for steps that have both a vanished and a new field.
    """
    stats = written(file_stats(lines), "drift-stats")
    steps = written(file_steps(stats), "drift-steps")
    moved = _renamed(steps, stats)
    joined = steps.join(moved, ["series", "file_seq"], "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<struct<o:string,n:string>>")))
    row = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    empty = F.lit("")
    found = F.concat(
        F.transform(F.array_except("fresh", F.transform("moved", lambda m: m["n"])), lambda x: row("added", empty, x)), F.transform(F.array_except("gone", F.transform("moved", lambda m: m["o"])), lambda x: row("removed", x, empty)),
        F.transform("moved", lambda m: row("renamed", m["o"], m["n"])), F.transform("typed", lambda x: row("type_changed", x, x)),
    )
    return joined.select("series", "file_seq", F.inline(found))


def canonical_fields(parsed: DataFrame, found: DataFrame) -> dict[str, tuple[str, str]]:
    """For one kind of record: field as written -> (name in the consistent table, Spark type).

    Fields joined by renames, in either direction and in any series, are one field under the name
    that most lines use. Its type is that of most values: number double or bigint, boolean, else
    text. Counts come from all lines; what is collected is one row per distinct field name.
    """
    counts = parsed.where("readable").select(F.explode("kinds").alias("field", "kind")).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(8 * MAX_FIELDS + 1).collect()
    renames = found.where("change_kind = 'renamed'").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n"))
    firm = F.col("n") >= F.lit(MIN_RENAMES) * F.max("n").over(Window.partitionBy("old_field"))
    pairs = renames.where(F.col("old_field") != F.col("new_field")).withColumn("firm", firm).where("firm").limit(8 * MAX_FIELDS + 1).collect()
    if max(len(rows), len(pairs)) > 8 * MAX_FIELDS:
        raise ValueError("the lines hold no common schema: too many fields")
    group: dict[str, str] = {}

    def top(x: str) -> str:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for r in pairs:
        group[top(r["old_field"])] = top(r["new_field"])
    use: dict[str, dict[str, int]] = {}
    kind: dict[str, dict[str, int]] = {}
    for r in rows:
        t = top(r["field"])
        use.setdefault(t, {})[r["field"]] = use.setdefault(t, {}).get(r["field"], 0) + r["n"]
        if r["kind"] != "null":
            kind.setdefault(t, {})[r["kind"]] = kind.setdefault(t, {}).get(r["kind"], 0) + r["n"]
    name = {t: max(sorted(u), key=u.get) for t, u in use.items()}
    spark_type = {"number": "double", "boolean": "boolean"}
    kinds = {t: spark_type.get(max(sorted(k), key=k.get), "string") for t, k in kind.items()}
    return {f: (name[t], kinds.get(t, "string")) for t, u in use.items() for f in u}


def consistent(parsed: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One table for all lines of a kind: key columns, a typed column per field, failed casts.

    ``failed_casts`` names the fields whose value is there but can't be read as the column's type;
    ``raw_values`` keeps their text. Unreadable lines have all fields null and stay as rows.
    """
    by_name: dict[str, list[str]] = {}
    kind: dict[str, str] = {}
    for f, (n, t) in fields.items():
        by_name.setdefault(n, []).append(f)
        kind[n] = t
    raw: dict[str, Column] = {n: F.coalesce(*[F.col("vals")[f] for f in sorted(fs)]) for n, fs in by_name.items()}
    bad = {n: c.isNotNull() & c.try_cast(kind[n]).isNull() for n, c in raw.items() if kind[n] != "string"}
    failed = F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    kept = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in bad]), F.array(*[F.when(bad[n], raw[n]) for n in bad])), lambda _, v: v.isNotNull()) if bad else F.create_map().cast("map<string,string>")
    return parsed.select("series", "file_seq", "row_id", "readable", *[c.try_cast(kind[n]).alias(f"f_{n}") for n, c in raw.items()], failed.alias("failed_casts"), kept.alias("raw_values"))
