"""Queries p1-p4 and p6: operators for training-data pipelines over the studio's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift, hierarchy, nested, references, rolling
from sparkloom.session import clean_name, table, written

#: Stands between the parts of a composed key.
SEP = "\u0001"

# --- 1: rolling totals -------------------------------------------------------------------------


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = rolling.latest_rows(table(spark, sf_dir, "llm_calls"), "call_id", "received_at", ["call_id", "ts", "provider", "prompt_tokens", "cost_usd"])
    entity = F.when(clean_name(F.col("provider")) != "", clean_name(F.col("provider")))
    daily = rolling.daily_totals(calls, entity, F.col("ts"), {"prompt_tokens": F.col("prompt_tokens"), "cost_usd": F.col("cost_usd")})
    return rolling.trailing_totals(daily.withColumnRenamed("n_rows", "calls"), ["calls", "prompt_tokens", "cost_usd"], (7, 30))


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trailing(spark, sf_dir)
    out = [F.col("entity").alias("provider"), F.date_format("day", "yyyy-MM-dd").alias("day")]
    for w in (7, 30):
        out += [F.col(f"{m}_{w}d").cast("bigint").alias(f"{m}_{w}d") for m in ("calls", "prompt_tokens")]
        out.append(F.round(F.col(f"cost_usd_{w}d").cast("double"), 12).alias(f"cost_usd_{w}d"))
        out += [F.round(f"{m}_avg_{w}d", 12).alias(f"{m}_avg_{w}d") for m in ("calls", "prompt_tokens", "cost_usd")]
    return t.select(*out)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = rolling.quiet_days(_trailing(spark, sf_dir), "calls", 7)
    return quiet.select(F.col("entity").alias("provider"), F.date_format("day", "yyyy-MM-dd").alias("quiet_day"))


P1_BASE = r"""
WITH d AS (SELECT call_id, max(struct_pack(a := received_at, ts := ts, p := lower(trim(provider)), t := prompt_tokens, c := cost_usd)) AS r FROM llm_calls GROUP BY call_id),
daily AS (SELECT r.p AS provider, CAST(r.ts AS DATE) AS day, count(*) AS calls, coalesce(sum(r.t), 0) AS toks, coalesce(sum(CAST(r.c AS DECIMAL(38,12))), 0) AS cost
          FROM d WHERE r.p <> '' AND r.ts IS NOT NULL GROUP BY 1, 2),
span AS (SELECT provider, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
cal AS (SELECT provider, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, lo FROM span),
dense AS (SELECT cal.provider, cal.day, cal.lo, coalesce(calls, 0) AS calls, coalesce(toks, 0) AS toks, coalesce(cost, 0) AS cost FROM cal LEFT JOIN daily USING (provider, day)),
w AS (SELECT provider, strftime(day, '%Y-%m-%d') AS day, least(7, date_diff('day', lo, day) + 1) AS n7, least(30, date_diff('day', lo, day) + 1) AS n30,
  sum(calls) OVER a AS c7, sum(toks) OVER a AS t7, sum(cost) OVER a AS u7, sum(calls) OVER b AS c30, sum(toks) OVER b AS t30, sum(cost) OVER b AS u30
  FROM dense WINDOW a AS (PARTITION BY provider ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY provider ORDER BY day ROWS 29 PRECEDING))
"""
P1_ROLLING_SQL = (
    P1_BASE
    + """SELECT provider, day, CAST(c7 AS BIGINT) AS calls_7d, CAST(t7 AS BIGINT) AS prompt_tokens_7d, round(CAST(u7 AS DOUBLE), 12) AS cost_usd_7d,
 round(CAST(c7 AS DOUBLE) / n7, 12) AS calls_avg_7d, round(CAST(t7 AS DOUBLE) / n7, 12) AS prompt_tokens_avg_7d, round(CAST(u7 AS DOUBLE) / n7, 12) AS cost_usd_avg_7d,
 CAST(c30 AS BIGINT) AS calls_30d, CAST(t30 AS BIGINT) AS prompt_tokens_30d, round(CAST(u30 AS DOUBLE), 12) AS cost_usd_30d,
 round(CAST(c30 AS DOUBLE) / n30, 12) AS calls_avg_30d, round(CAST(t30 AS DOUBLE) / n30, 12) AS prompt_tokens_avg_30d, round(CAST(u30 AS DOUBLE) / n30, 12) AS cost_usd_avg_30d FROM w"""
)
P1_FOUND_SQL = P1_BASE + "SELECT provider, day AS quiet_day FROM w WHERE c7 = 0"

# --- 2: hierarchies ------------------------------------------------------------------------------


def dataset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links dataset -> recipe -> dataset: a hidden node per recipe keeps them linear in the lists.

    An output's primary parent is the earliest recipe that writes it, a recipe's its first input.
    """
    r = table(spark, sf_dir, "recipes").select("flow_id", "recipe_id", "inputs", "outputs", "created_at")
    ident = F.coalesce(F.col("recipe_id").cast("string"), F.concat(F.lit("x"), F.xxhash64("inputs", "outputs").cast("string")))
    r = r.withColumn("hub", F.concat(F.lit(hierarchy.HIDDEN), ident))
    born = F.coalesce(F.date_format("created_at", "yyyyMMddHHmmss.SSSSSS"), F.lit("~"))
    ins = r.select(F.col("flow_id").alias("grp"), F.col("hub").alias("child"), F.posexplode("inputs").alias("pos", "name")).where("name is not null").select(
        "grp", "child", clean_name(F.col("name")).alias("parent"), F.lit(0).alias("weight"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("prio")
    )
    outs = r.select(F.col("flow_id").alias("grp"), F.explode("outputs").alias("name"), F.col("hub").alias("parent"), F.concat(born, F.lit("/"), F.lpad(ident, 20, "0")).alias("prio")).select(
        "grp", clean_name(F.col("name")).alias("child"), "parent", F.lit(1).alias("weight"), "prio"
    )
    return ins.unionByName(outs)


def column_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "column_lineage")
    node = lambda d, k: F.concat(clean_name(F.col(d)), F.lit("."), clean_name(F.col(k)))
    return c.select(F.col("flow_id").alias("grp"), node("final_dataset", "column_name").alias("child"), node("origin_dataset", "origin_column").alias("parent"), F.lit(1).alias("weight"), F.lit("").alias("prio"))


def _both(spark: SparkSession, sf_dir: str, counts: bool = True) -> DataFrame:
    d = hierarchy.hierarchy(dataset_links(spark, sf_dir), counts=counts).withColumn("node_kind", F.lit("dataset"))
    c = hierarchy.hierarchy(column_links(spark, sf_dir), single_parent=True, counts=counts).withColumn("node_kind", F.lit("column"))
    return d.unionByName(c)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, links: links.withColumn("grp", F.concat(F.lit(kind + SEP), "grp"))
    closed = hierarchy.closed_chains(of("dataset", dataset_links(spark, sf_dir)).unionByName(of("column", column_links(spark, sf_dir))))
    return closed.select(F.substring_index("grp", SEP, -1).alias("flow_id"), F.substring_index("grp", SEP, 1).alias("node_kind"), F.col("node").alias("node_name")).distinct()


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _both(spark, sf_dir)
    return h.select(F.col("grp").alias("flow_id"), "node_kind", F.col("node").alias("node_name"), "root", "depth", F.array_join("path", " > ").alias("path"), "state", "n_descendants")


def hierarchy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``p2_hierarchy`` with a bound so low that flows are spread over partitions, their
    local forests merged and their paths joined, as are groups too large for one task."""
    h = hierarchy.hierarchy(column_links(spark, sf_dir), single_parent=True, bound=SPREAD_BOUND)
    return h.select(F.col("grp").alias("flow_id"), F.lit("column").alias("node_kind"), F.col("node").alias("node_name"), "root", "depth", F.array_join("path", " > ").alias("path"), "state", "n_descendants")


#: Links of a flow above which ``hierarchy_spread`` spreads it; about half the flows have more.
SPREAD_BOUND = 40


def p2_column_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hierarchy.descendants(hierarchy.hierarchy(column_links(spark, sf_dir), single_parent=True, counts=False))
    return d.select(F.col("grp").alias("flow_id"), "ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


def _reachable(links: DataFrame) -> DataFrame:
    return hierarchy.reachable(links).select(F.col("grp").alias("flow_id"), "ancestor", "descendant", "distance")


def p2_column_descendants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the pairs on and below closed chains, which ``p2_column_descendants`` and its SQL leave out."""
    return _reachable(column_links(spark, sf_dir))


def p2_dataset_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reachable(dataset_links(spark, sf_dir))


P2_LINKS = r"""
l AS (SELECT DISTINCT flow_id, lower(trim(i)) AS a, lower(trim(o)) AS b, 'dataset' AS k FROM (SELECT flow_id, unnest(inputs) AS i, outputs FROM recipes), unnest(outputs) AS t(o)
      UNION SELECT DISTINCT flow_id, lower(trim(origin_dataset)) || '.' || lower(trim(origin_column)), lower(trim(final_dataset)) || '.' || lower(trim(column_name)), 'column' FROM column_lineage WHERE origin_dataset IS NOT NULL)
"""
P2_FOUND_SQL = f"""WITH RECURSIVE {P2_LINKS},
reach AS (SELECT flow_id, k, a, b FROM l UNION SELECT r.flow_id, r.k, r.a, l.b FROM reach r JOIN l ON l.flow_id = r.flow_id AND l.k = r.k AND l.a = r.b)
SELECT DISTINCT flow_id, k AS node_kind, a AS node_name FROM reach WHERE a = b"""
P2_DESC_SQL = f"""WITH RECURSIVE {P2_LINKS}, c AS (SELECT flow_id, a, b FROM l WHERE k = 'column'),
nodes AS (SELECT flow_id, a AS n FROM c UNION SELECT flow_id, b FROM c),
t AS (SELECT flow_id, n AS ancestor, n AS descendant, 0 AS distance FROM nodes WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.flow_id = nodes.flow_id AND c.b = nodes.n)
      UNION ALL SELECT t.flow_id, t.ancestor, c.b, t.distance + 1 FROM t JOIN c ON c.flow_id = t.flow_id AND c.a = t.descendant),
tree AS (SELECT flow_id, descendant AS n FROM t),
d AS (SELECT flow_id, n AS ancestor, n AS descendant, 0 AS distance FROM tree
      UNION ALL SELECT d.flow_id, d.ancestor, c.b, d.distance + 1 FROM d JOIN c ON c.flow_id = d.flow_id AND c.a = d.descendant)
SELECT flow_id, ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM d WHERE distance > 0"""
P2_REACH_SQL = f"""WITH RECURSIVE {P2_LINKS}, c AS (SELECT flow_id, a, b FROM l WHERE k = '%s' AND flow_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
reach(flow_id, ancestor, descendant, distance) USING KEY (flow_id, ancestor, descendant) AS (SELECT flow_id, a, b, 1 FROM c
      UNION SELECT DISTINCT r.flow_id, r.ancestor, c.b, r.distance + 1 FROM reach r JOIN c ON c.flow_id = r.flow_id AND c.a = r.descendant
      WHERE NOT EXISTS (SELECT 1 FROM recurring.reach q WHERE q.flow_id = r.flow_id AND q.ancestor = r.ancestor AND q.descendant = c.b))
SELECT flow_id, ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM reach WHERE ancestor <> descendant"""

P2_HIERARCHY_SQL = f"""WITH RECURSIVE {P2_LINKS},
g AS (SELECT flow_id, k, a, b FROM l WHERE flow_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
ins AS (SELECT flow_id, recipe_id, unnest(inputs) AS n, generate_subscripts(inputs, 1) AS pos FROM recipes),
first AS (SELECT flow_id, recipe_id, min(struct_pack(pos := pos, n := lower(trim(n)))).n AS n FROM ins WHERE n IS NOT NULL GROUP BY 1, 2),
outs AS (SELECT flow_id, recipe_id, created_at, lower(trim(o)) AS n FROM recipes, unnest(outputs) AS t(o) WHERE o IS NOT NULL),
maker AS (SELECT flow_id, n, min(struct_pack(born := coalesce(created_at, TIMESTAMP '9999-01-01'), id := recipe_id)).id AS recipe_id FROM outs GROUP BY 1, 2),
nodes AS (SELECT flow_id, 'dataset' AS k, lower(trim(n)) AS n FROM ins WHERE n IS NOT NULL UNION SELECT flow_id, 'dataset', n FROM outs
  UNION SELECT flow_id, 'column', lower(trim(final_dataset)) || '.' || lower(trim(column_name)) FROM column_lineage UNION SELECT flow_id, k, a FROM g WHERE k = 'column'),
up AS (SELECT m.flow_id, 'dataset' AS k, m.n, f.n AS parent FROM maker m JOIN first f USING (flow_id, recipe_id) UNION ALL SELECT flow_id, k, b, min(a) FROM g WHERE k = 'column' GROUP BY 1, 2, 3),
tree AS (SELECT flow_id, k, n, n AS root, 0 AS depth, n AS path FROM nodes WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.flow_id = nodes.flow_id AND up.k = nodes.k AND up.n = nodes.n)
  UNION ALL SELECT t.flow_id, t.k, up.n, t.root, t.depth + 1, t.path || ' > ' || up.n FROM tree t JOIN up ON up.flow_id = t.flow_id AND up.k = t.k AND up.parent = t.n),
reach AS (SELECT flow_id, k, a, b FROM g UNION SELECT r.flow_id, r.k, r.a, g.b FROM reach r JOIN g ON g.flow_id = r.flow_id AND g.k = r.k AND g.a = r.b),
below AS (SELECT flow_id, k, a AS n, count(*) FILTER (WHERE a <> b) AS c, bool_or(a = b) AS closed FROM reach GROUP BY 1, 2, 3)
SELECT n.flow_id, n.k AS node_kind, n.n AS node_name, CASE WHEN coalesce(closed, false) THEN NULL ELSE root END AS root, CAST(CASE WHEN coalesce(closed, false) THEN NULL ELSE depth END AS BIGINT) AS depth, CASE WHEN coalesce(closed, false) THEN NULL ELSE path END AS path,
  CASE WHEN coalesce(closed, false) THEN 'closed' WHEN root IS NOT NULL THEN 'tree' ELSE 'below_closed' END AS state, coalesce(c, 0) AS n_descendants
FROM nodes n LEFT JOIN tree t ON t.flow_id = n.flow_id AND t.k = n.k AND t.n = n.n LEFT JOIN below b ON b.flow_id = n.flow_id AND b.k = n.k AND b.n = n.n WHERE n.flow_id IS NOT NULL AND n.n IS NOT NULL"""

# --- 3: references to what does not exist ----------------------------------------------------------


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All references, and all parents they may name, by flow and kind of record."""
    r = table(spark, sf_dir, "recipes")
    z = table(spark, sf_dir, "flow_zones")
    d = table(spark, sf_dir, "datasets")

    def refs(df, tbl, ident, field, at, to):
        return df.select(F.lit(tbl).alias("ref_table"), F.col(ident).alias("ref_id"), F.lit(field).alias("ref_field"), "flow_id", F.lit(to).alias("to"), F.col(at).alias("at"), F.explode(field).alias("name")).withColumn(
            "name", clean_name(F.col("name"))
        )

    all_refs = (
        refs(r, "recipes", "recipe_id", "inputs", "created_at", "dataset")
        .unionByName(refs(r, "recipes", "recipe_id", "outputs", "created_at", "dataset"))
        .unionByName(refs(z, "flow_zones", "zone_id", "datasets", "updated_at", "dataset"))
        .unionByName(refs(z, "flow_zones", "zone_id", "recipes", "updated_at", "recipe"))
    )
    parents = d.select("flow_id", F.lit("dataset").alias("to"), clean_name(F.col("dataset_name")).alias("name"), "created_at", "deleted_at").unionByName(
        r.select("flow_id", F.lit("recipe").alias("to"), clean_name(F.col("recipe_name")).alias("name"), "created_at", "deleted_at")
    )
    return all_refs.where("name is not null").distinct(), parents


KEYS = ["flow_id", "to", "name"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _references(spark, sf_dir)
    lost = references.orphan_references(refs, parents, KEYS, "at")
    return lost.select("ref_table", "ref_id", "ref_field", F.col("name").alias("ref_name")).distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _references(spark, sf_dir)
    refs = written(refs, "p3-refs")
    lost = references.orphan_references(refs, parents, KEYS, "at")
    return references.orphan_counts(refs, lost, "at", ["ref_table", "ref_field"])


P3_BASE = r"""
WITH refs AS (
  SELECT 'recipes' AS ref_table, recipe_id AS ref_id, 'inputs' AS ref_field, flow_id, 'd' AS k, created_at AS t, unnest(inputs) AS n FROM recipes
  UNION ALL SELECT 'recipes', recipe_id, 'outputs', flow_id, 'd', created_at, unnest(outputs) FROM recipes
  UNION ALL SELECT 'flow_zones', zone_id, 'datasets', flow_id, 'd', updated_at, unnest(datasets) FROM flow_zones
  UNION ALL SELECT 'flow_zones', zone_id, 'recipes', flow_id, 'r', updated_at, unnest(recipes) FROM flow_zones),
r AS (SELECT DISTINCT ref_table, ref_id, ref_field, flow_id, k, t, lower(trim(n)) AS ref_name FROM refs WHERE n IS NOT NULL),
p AS (SELECT flow_id, 'd' AS k, lower(trim(dataset_name)) AS name, created_at, deleted_at FROM datasets UNION ALL SELECT flow_id, 'r', lower(trim(recipe_name)), created_at, deleted_at FROM recipes),
lost AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.flow_id = r.flow_id AND p.k = r.k AND p.name = r.ref_name AND p.created_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t)))
"""
P3_FOUND_SQL = P3_BASE + "SELECT DISTINCT ref_table, ref_id, ref_field, ref_name FROM lost"
P3_COUNTS_SQL = (
    P3_BASE
    + """, a AS (SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_references FROM r GROUP BY 1, 2, 3),
b AS (SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_orphans FROM lost GROUP BY 1, 2, 3)
SELECT a.ref_table, a.ref_field, a.month, a.n_references, coalesce(b.n_orphans, 0) AS n_orphans FROM a LEFT JOIN b USING (ref_table, ref_field, month)"""
)

# --- 4: nested records -----------------------------------------------------------------------------


def export_rows(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, only: list[str] | None = None, once: bool = True) -> DataFrame:
    """Rows of all levels of the exports; ``once``: repeated rows of the table give their rows once."""
    e = table(spark, sf_dir, "flow_exports").select(F.col("export_id").alias("doc_key"), "body")
    return nested.flatten(e.distinct() if once else e, tables=tables, only=only)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(export_rows(spark, sf_dir, ["recipes", "recipes.steps"], ["name"], once=False), "p4-rows")
    steps = rows.where("tbl = 'recipes.steps' and not map_contains_key(kinds, 'value')").select(
        "doc_key", F.substring_index("row_key", "/steps/", 1).alias("recipe_key"), F.regexp_replace(F.regexp_extract("row_key", r"/steps/([0-9].*)$", 1), "/steps/", ".").alias("step_path")
    )
    name = F.coalesce(F.col("fields")["name"], F.col("item_key"), F.lit(""))
    recipes = rows.where("tbl = 'recipes'").select(F.col("row_key").alias("recipe_key"), name.alias("recipe_name")).distinct()
    return steps.distinct().join(recipes, "recipe_key").select(F.col("doc_key").cast("bigint").alias("export_id"), "recipe_name", "step_path").distinct()


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = export_rows(spark, sf_dir)
    return r.select(F.col("doc_key").cast("bigint").alias("export_id"), "tbl", "row_key", "parent_tbl", "parent_key", "ordinal", F.to_json("fields").alias("fields"))


def p4_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.merged_schema(export_rows(spark, sf_dir))


def _flat(tbl: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One flat table with the columns of its merged schema."""
        rows = written(export_rows(spark, sf_dir, [tbl]), "p4-flat")
        return nested.relational(rows, tbl).withColumn("export_id", F.col("doc_key").cast("bigint")).drop("doc_key")

    return f


def p4_zone_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(export_rows(spark, sf_dir, ["zones", "zones.datasets", "zones.recipes"]), "p4-zones")
    zones = rows.where("tbl = 'zones'").select(F.col("row_key").alias("parent_key"), F.coalesce(F.col("fields")["name"], F.col("item_key")).alias("zone_name"))
    members = rows.where("tbl <> 'zones'").select(F.col("doc_key").cast("bigint").alias("export_id"), F.substring_index("tbl", ".", -1).alias("member_kind"), "parent_key", "ordinal", F.col("fields")["value"].alias("member_name"))
    return members.join(zones, "parent_key").select("export_id", "zone_name", "member_kind", "ordinal", "member_name").distinct()


# --- 6: drifting schemas -----------------------------------------------------------------------------


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "log_lines")
    series = F.concat(F.coalesce("studio_node", F.lit("")), F.lit(SEP), F.coalesce("record_kind", F.lit("")))
    return lines.select(series.alias("series"), "file_seq", F.col("line_id").alias("row_id"), "raw")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drift.changes(_log_lines(spark, sf_dir))
    part = F.split("series", SEP)
    return c.select(part[0].alias("studio_node"), part[1].alias("record_kind"), "file_seq", "change_kind", "old_field", "new_field").distinct()


def _p6_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    lines = _log_lines(spark, sf_dir).where(F.col("series").endswith(SEP + kind))
    parsed = written(drift.parsed_lines(lines), "p6-parsed")
    out = drift.consistent(parsed, drift.canonical_fields(parsed, drift.changes(lines)))
    out = out.withColumn("studio_node", F.split("series", SEP)[0]).drop("series")
    return out.select("studio_node", "file_seq", F.col("row_id").alias("line_id"), "readable", *[c for c in out.columns if c.startswith("f_")], F.array_join("failed_casts", ",").alias("failed_casts"), F.to_json("raw_values").alias("raw_values"))


def p6_llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_table(spark, sf_dir, "llm_call")


def p6_processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_table(spark, sf_dir, "processor")


P6_FOUND_SQL = r"""WITH j AS (SELECT coalesce(studio_node, '') AS n, coalesce(record_kind, '') AS k, file_seq, CASE WHEN json_valid(b) THEN b END AS b FROM (SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS b FROM log_lines WHERE file_seq IS NOT NULL)),
f AS (SELECT *, lag(file_seq) OVER (PARTITION BY n, k ORDER BY file_seq) AS prev FROM (SELECT DISTINCT n, k, file_seq FROM j)),
e AS (SELECT n, k, file_seq, x.key AS field, x.value AS v, CASE x.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM j, json_each(j.b) AS x WHERE b IS NOT NULL AND b <> ''),
c AS (SELECT n, k, file_seq, field, kind, count(*) AS c FROM e GROUP BY ALL),
t AS (SELECT n, k, file_seq, field, max(struct_pack(c := CASE WHEN kind IS NULL THEN -1 ELSE c END, a := CASE kind WHEN 'array' THEN 5 WHEN 'boolean' THEN 4 WHEN 'number' THEN 3 WHEN 'object' THEN 2 ELSE 1 END, kind := kind)).kind AS kind FROM c GROUP BY ALL),
b AS (SELECT f.n, f.k, f.file_seq, f.prev, t.field, t.kind FROM f JOIN t ON t.n = f.n AND t.k = f.k AND t.file_seq = f.prev),
a AS (SELECT f.n, f.k, f.file_seq, f.prev, t.field, t.kind FROM f JOIN t ON t.n = f.n AND t.k = f.k AND t.file_seq = f.file_seq WHERE f.prev IS NOT NULL),
gone AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.n = b.n AND a.k = b.k AND a.file_seq = b.file_seq AND a.field = b.field)),
fresh AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.n = b.n AND a.k = b.k AND a.file_seq = b.file_seq AND a.field = b.field)),
s1 AS (SELECT n, k, file_seq, field, v ->> '$' AS s FROM e WHERE kind IN ('string', 'number', 'boolean') UNION ALL SELECT n, k, file_seq, field, x.atom ->> '$' FROM e, json_tree(e.v) AS x WHERE kind IN ('object', 'array') AND x.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
s2 AS (SELECT DISTINCT n, k, file_seq, field, s FROM (SELECT * FROM s1 WHERE NOT (ltrim(s)[1] IN ('{', '[') AND json_valid(s)) UNION ALL SELECT n, k, file_seq, field, x.atom ->> '$' FROM (SELECT * FROM s1 WHERE ltrim(s)[1] IN ('{', '[') AND json_valid(s)) AS y, json_tree(y.s) AS x WHERE x.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))),
o AS (SELECT g.n, g.k, g.file_seq, g.field, s2.s FROM gone g JOIN s2 ON s2.n = g.n AND s2.k = g.k AND s2.file_seq = g.prev AND s2.field = g.field),
w AS (SELECT g.n, g.k, g.file_seq, g.field, s2.s FROM fresh g JOIN s2 ON s2.n = g.n AND s2.k = g.k AND s2.file_seq = g.file_seq AND s2.field = g.field),
p AS (SELECT o.n, o.k, o.file_seq, o.field AS old, w.field AS new, count(*) AS c FROM o JOIN w USING (n, k, file_seq, s) GROUP BY ALL),
q AS (SELECT p.*, c / least(x, y) AS share, c / (x + y - c) AS jac FROM p JOIN (SELECT n, k, file_seq, field AS old, count(*) AS x FROM o GROUP BY ALL) USING (n, k, file_seq, old) JOIN (SELECT n, k, file_seq, field AS new, count(*) AS y FROM w GROUP BY ALL) USING (n, k, file_seq, new)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, k, file_seq, old ORDER BY share DESC, jac DESC, c DESC, new) AS ro, row_number() OVER (PARTITION BY n, k, file_seq, new ORDER BY share DESC, jac DESC, c DESC, old) AS rn FROM q WHERE share >= 0.5) WHERE ro = 1 AND rn = 1)
SELECT n AS studio_node, k AS record_kind, CAST(file_seq AS BIGINT) AS file_seq, 'renamed' AS change_kind, old AS old_field, new AS new_field FROM m
UNION ALL SELECT n, k, file_seq, 'added', '', field FROM fresh WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n = fresh.n AND m.k = fresh.k AND m.file_seq = fresh.file_seq AND m.new = fresh.field)
UNION ALL SELECT n, k, file_seq, 'removed', field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n = gone.n AND m.k = gone.k AND m.file_seq = gone.file_seq AND m.old = gone.field)
UNION ALL SELECT a.n, a.k, a.file_seq, 'type_changed', a.field, a.field FROM a JOIN b ON a.n = b.n AND a.k = b.k AND a.file_seq = b.file_seq AND a.field = b.field WHERE a.kind <> b.kind"""

QUERIES = {
    "p1_found": (p1_found, P1_FOUND_SQL),
    "p1_rolling": (p1_rolling, P1_ROLLING_SQL),
    "p2_found": (p2_found, P2_FOUND_SQL),
    "p2_hierarchy": (p2_hierarchy, P2_HIERARCHY_SQL),
    "hierarchy_spread": (hierarchy_spread, P2_HIERARCHY_SQL + " AND n.k = 'column'"),
    "p2_column_descendants": (p2_column_descendants, P2_DESC_SQL),
    "p2_column_descendants_all": (p2_column_descendants_all, P2_REACH_SQL % "column"),
    "p2_dataset_descendants": (p2_dataset_descendants, P2_REACH_SQL % "dataset"),
    "p3_found": (p3_found, P3_FOUND_SQL),
    "p3_counts": (p3_counts, P3_COUNTS_SQL),
    "p4_found": (p4_found, None),
    "p4_rows": (p4_rows, None),
    "p4_schema": (p4_schema, None),
    "p4_zone_members": (p4_zone_members, None),
    "p4_recipes": (_flat("recipes"), None),
    "p4_steps": (_flat("recipes.steps"), None),
    "p4_zones": (_flat("zones"), None),
    "p6_found": (p6_found, P6_FOUND_SQL),
    "p6_llm_calls": (p6_llm_calls, None),
    "p6_processors": (p6_processors, None),
}
