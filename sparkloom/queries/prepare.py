"""Queries over prepare processors and modes, each a list of steps on one table, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import prepare
from sparkloom.queries.relational import rounded
from sparkloom.session import table

QUERIES: dict = {}


def steps(name: str, source: str, run: list[tuple[str, dict]], columns: list[str], sql: str | None, start=None, digits: int = 6) -> None:
    """Register a query: steps on ``source``, the columns to return, and the SQL."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        df = start(df) if start else df
        out = prepare.apply_steps(df, [{"type": t, "params": p} for t, p in run])
        return rounded(out.select(*columns), digits)

    QUERIES[f"prepare_{name}"] = (f, sql)


# --- text ---
MODES = {"TO_UPPER": "upper(c_name)", "TO_LOWER": "lower(c_name)", "CAPITALIZE": "upper(c_name[1]) || lower(c_name[2:])", "TRIM": "trim(c_name)", "REMOVE_WHITESPACE": "regexp_replace(c_name, '\\s+', '', 'g')", "REMOVE_NON_ALPHANUMERIC": "regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')", "REMOVE_DIGITS": "regexp_replace(c_name, '\\d', '', 'g')", "KEEP_ONLY_DIGITS": "regexp_replace(c_name, '\\D', '', 'g')", "KEEP_ONLY_ALPHA": "regexp_replace(c_name, '[^A-Za-z]', '', 'g')", "PAD_LEFT": "lpad(c_name, 30, '*')", "PAD_RIGHT": "rpad(c_name, 30, '*')", "REVERSE": "reverse(c_name)", "QUOTE": "'\"' || c_name || '\"'", "REMOVE_PUNCTUATION": "regexp_replace(c_name, '[[:punct:]]', '', 'g')"}
steps("string_modes", "customer", [("StringTransformer", {"column": "c_name", "mode": m, "outputColumn": m.lower(), "length": 30, "pad": "*"}) for m in MODES], ["c_custkey", *[m.lower() for m in MODES]], "SELECT c_custkey, " + ", ".join(f"{v} AS {k.lower()}" for k, v in MODES.items()) + " FROM customer")
steps("find_replace", "orders", [("FindReplace", {"column": "o_orderpriority", "find": "-", "replace": ":", "outputColumn": "a"}), ("FindReplace", {"column": "o_orderpriority", "find": "[0-9]+", "replace": "#", "matchMode": "PATTERN", "outputColumn": "b"}), ("FindReplace", {"column": "o_orderstatus", "find": "F", "replace": "final", "matchMode": "FULL_STRING", "outputColumn": "c"})], ["o_orderkey", "a", "b", "c"], "SELECT o_orderkey, replace(o_orderpriority, '-', ':') AS a, regexp_replace(o_orderpriority, '[0-9]+', '#', 'g') AS b, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS c FROM orders")
steps("extract", "customer", [("PatternExtract", {"column": "c_name", "pattern": r"([A-Za-z]+)\D*(\d+)", "outputColumns": ["word", "digits"]}), ("ExtractNumbers", {"column": "c_name", "outputColumn": "number"}), ("CountMatches", {"column": "c_name", "value": "0", "outputColumn": "zeros"})], ["c_custkey", "word", "digits", "number", "zeros"], r"SELECT c_custkey, nullif(regexp_extract(c_name, '([A-Za-z]+)\D*(\d+)', 1), '') AS word, nullif(regexp_extract(c_name, '([A-Za-z]+)\D*(\d+)', 2), '') AS digits, CAST(nullif(regexp_extract(c_name, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS number, CAST(length(c_name) - length(replace(c_name, '0', '')) AS BIGINT) AS zeros FROM customer")
steps("split_column", "orders", [("ColumnsSplitter", {"column": "o_orderpriority", "separator": "-", "outputColumns": ["first_part", "second_part"]})], ["o_orderkey", "first_part", "second_part"], "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first_part, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 2) END AS second_part FROM orders")
steps("tokenize", "part", [("Tokenizer", {"column": "p_name", "operation": "ROWS", "outputColumn": "token"})], ["p_partkey", "token"], r"SELECT p_partkey, unnest(list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda x: x <> '')) AS token FROM part")
steps("html_stem_language", "documents", [("HtmlStripper", {"column": "text", "outputColumn": "plain"}), ("LanguageDetector", {"column": "plain", "outputColumn": "guess"}), ("SentimentAnalyzer", {"column": "plain", "outputColumn": "mood"}), ("StemText", {"column": "doc_kind", "outputColumn": "stem"}), ("LemmatizeText", {"column": "doc_kind", "outputColumn": "lemma"})], ["doc_id", "guess", "mood", "stem", "lemma"], None)
steps("hashes", "customer", [("TextHasher", {"column": "c_name", "algorithm": "MD5", "outputColumn": "md5"}), ("HashComputer", {"column": "c_name", "algorithm": "SHA256", "outputColumn": "sha"}), ("ColumnPseudoAnonymizer", {"column": "c_mktsegment", "salt": "s", "pepper": "p", "outputColumn": "pseudonym"})], ["c_custkey", "md5", "sha", "pseudonym"], "SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha, sha256('ps' || c_mktsegment) AS pseudonym FROM customer")
steps("chunks", "documents", [("SplitIntoChunks", {"column": "text", "size": 400, "overlap": 40, "outputColumn": "chunk"}), ("Formula", {"outputColumn": "n", "expression": 'length(val("chunk"))'})], ["doc_id", "chunk_index", "n"], None)

# --- identifiers ---
URL = lambda df: df.select("c_custkey", F.concat(F.lit("https://h"), F.col("c_custkey"), F.lit(".test:8080/a/b?x="), F.col("c_nationkey"), F.lit("&y=2#top")).alias("url"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@mail.test")).alias("mail"), F.concat(F.lit("10.0."), F.col("c_nationkey"), F.lit(".7")).alias("ip"))
steps("urls", "customer", [("SplitURL", {"column": "url"}), ("QuerystringSplitter", {"column": "url_querystring", "keys": ["x", "y"]}), ("EmailDomainExtractor", {"column": "mail"}), ("IPAddressParser", {"column": "ip"})], ["c_custkey", "url_scheme", "url_host", "url_port", "url_path", "url_anchor", "url_querystring_x", "url_querystring_y", "mail_localpart", "mail_domain", "ip_version", "ip_private"], "SELECT c_custkey, 'https' AS url_scheme, 'h' || c_custkey || '.test' AS url_host, CAST(8080 AS BIGINT) AS url_port, '/a/b' AS url_path, 'top' AS url_anchor, CAST(c_nationkey AS VARCHAR) AS url_querystring_x, '2' AS url_querystring_y, 'user' || c_custkey AS mail_localpart, 'mail.test' AS mail_domain, CAST(4 AS BIGINT) AS ip_version, true AS ip_private FROM customer", URL)

# --- numbers ---
NUM = {"MULTIPLY": ("3", "x * 3"), "ADD": ("3", "x + 3"), "SUBTRACT": ("3", "x - 3"), "DIVIDE": ("4", "x / 4"), "POWER": ("2", "x * x"), "SQRT": (None, "CASE WHEN x >= 0 THEN sqrt(x) END"), "LOG": (None, "CASE WHEN x > 0 THEN ln(x) END"), "LOG10": (None, "CASE WHEN x > 0 THEN log10(x) END"), "ABS": (None, "abs(x)"), "NEGATE": (None, "-x"), "FLOOR": (None, "CAST(floor(x) AS BIGINT)"), "CEIL": (None, "CAST(ceil(x) AS BIGINT)"), "INVERSE": (None, "CASE WHEN x <> 0 THEN 1 / x END"), "SIN": (None, "sin(x)"), "ATAN": (None, "atan(x)"), "DEGREES_TO_RADIANS": (None, "radians(x)")}
steps("numeric_modes", "supplier", [("NumericalTransformer", {"column": "x", "mode": m, "outputColumn": m.lower(), **({"value": int(v)} if v else {})}) for m, (v, _) in NUM.items()], ["s_suppkey", *[m.lower() for m in NUM]], "WITH t AS (SELECT s_suppkey, s_acctbal / 100 AS x FROM supplier) SELECT s_suppkey, " + ", ".join(f"{e if m in ('FLOOR', 'CEIL') else f'round({e}, 8)'} AS {m.lower()}" for m, (_, e) in NUM.items()) + " FROM t", lambda df: df.withColumn("x", F.col("s_acctbal") / 100), 8)
steps("round_clip", "part", [("Round", {"column": "p_retailprice", "precision": 1, "outputColumn": "r1"}), ("Round", {"column": "p_retailprice", "precision": 3, "mode": "SIGNIFICANT", "outputColumn": "r3"}), ("NumberClipping", {"column": "p_size", "min": 5, "max": 40, "outputColumn": "c"}), ("NumberClipping", {"column": "p_size", "min": 5, "max": 40, "clear": True, "outputColumn": "k"})], ["p_partkey", "r1", "r3", "c", "k"], "SELECT p_partkey, round(p_retailprice, 1) AS r1, round(round(p_retailprice * pow(10, 2 - floor(log10(p_retailprice)))) / pow(10, 2 - floor(log10(p_retailprice))), 6) AS r3, CAST(least(greatest(p_size, 5), 40) AS BIGINT) AS c, CAST(CASE WHEN p_size BETWEEN 5 AND 40 THEN p_size END AS BIGINT) AS k FROM part")
steps("bins", "part", [("Binner", {"column": "p_size", "mode": "CUSTOM_BOUNDARIES", "bins": [1, 10, 30, 51], "labels": ["s", "m", "l"], "outputColumn": "label"}), ("Binner", {"column": "p_size", "mode": "EQUAL_WIDTH", "n": 5, "outputColumn": "w"})], ["p_partkey", "label", "w"], "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS label, CAST(least(floor((p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) - min(p_size) FROM part) / 5.0)), 4) AS BIGINT) AS w FROM part")
steps("normalise", "supplier", [("MeasureNormalize", {"column": "s_acctbal", "mode": m, "outputColumn": m.lower()}) for m in ("MIN_MAX", "Z_SCORE", "ROBUST", "MAX_ABS")], ["s_suppkey", "min_max", "z_score", "robust", "max_abs"], "WITH s AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS sd, quantile_cont(s_acctbal, 0.25) AS q1, median(s_acctbal) AS q2, quantile_cont(s_acctbal, 0.75) AS q3, max(abs(s_acctbal)) AS ma FROM supplier) SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS min_max, round((s_acctbal - m) / sd, 6) AS z_score, round((s_acctbal - q2) / (q3 - q1), 6) AS robust, round(s_acctbal / ma, 6) AS max_abs FROM supplier, s")
steps("row_numbers", "lineitem", [("Mean", {"columns": ["l_discount", "l_tax"], "outputColumn": "mean"}), ("NumericalCombinator", {"columns": ["l_discount", "l_tax"]}), ("MultiColumnFormula", {"columns": ["l_quantity"], "expression": "val * 2", "outputPrefix": "twice_"})], ["l_orderkey", "l_linenumber", "mean", "l_discount_plus_l_tax", "l_discount_times_l_tax", "twice_l_quantity"], "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_discount + l_tax) / 2, 6) AS mean, round(l_discount + l_tax, 6) AS l_discount_plus_l_tax, round(l_discount * l_tax, 6) AS l_discount_times_l_tax, l_quantity * 2 AS twice_l_quantity FROM lineitem")
steps("number_formats", "part", [("NumericalFormatConverter", {"column": "eu", "from": "EU", "outputColumn": "n"}), ("CurrencySplitter", {"column": "money"})], ["p_partkey", "n", "money_amount", "money_currency"], "SELECT p_partkey, p_size * 1000 + 0.5 AS n, CAST(p_size AS DOUBLE) AS money_amount, 'EUR' AS money_currency FROM part", lambda df: df.select("p_partkey", F.concat(F.col("p_size"), F.lit(".000,5")).alias("eu"), F.concat(F.lit("€ "), F.col("p_size")).alias("money")))

# --- types and dates ---
PARTS = {"YEAR": "year(o_orderdate)", "MONTH": "month(o_orderdate)", "DAY": "day(o_orderdate)", "DAY_OF_WEEK": "isodow(o_orderdate)", "DAY_OF_YEAR": "dayofyear(o_orderdate)", "WEEK_OF_YEAR": "weekofyear(o_orderdate)", "QUARTER": "quarter(o_orderdate)", "ISO_YEAR": "isoyear(o_orderdate)"}
steps("date_parts", "orders", [("DateComponentExtractor", {"column": "o_orderdate", "components": list(PARTS)})], ["o_orderkey", *[f"o_orderdate_{p.lower()}" for p in PARTS]], "SELECT o_orderkey, " + ", ".join(f"{v} AS o_orderdate_{k.lower()}" for k, v in PARTS.items()) + " FROM orders")
steps("date_formats", "orders", [("DateFormatter", {"column": "o_orderdate", "format": "yyyy/MM/dd", "outputColumn": "text"}), ("DateParser", {"column": "text", "formats": ["yyyy/MM/dd"], "outputColumn": "parsed"}), ("DateFormatter", {"column": "parsed", "format": "dd.MM.yyyy", "outputColumn": "again"}), ("TimestampExtractor", {"column": "o_orderdate", "outputColumn": "unix"}), ("UnixTimestampParser", {"column": "unix", "outputColumn": "back"}), ("DateFormatter", {"column": "back", "format": "yyyy-MM-dd", "outputColumn": "back"})], ["o_orderkey", "text", "again", "unix", "back"], "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS text, strftime(o_orderdate, '%d.%m.%Y') AS again, CAST(epoch(o_orderdate) AS BIGINT) AS unix, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders")
steps("date_difference", "orders", [("DateDifference", {"column1": "o_orderdate", "column2": "until", "unit": "DAY", "outputColumn": "days"}), ("HolidaysComputer", {"column": "o_orderdate", "country": "FR", "outputColumn": "d"}), ("DateRangeClassifier", {"column": "o_orderdate", "ranges": [{"start": "1992-01-01", "end": "1994-12-31 23:59:59", "label": "early"}, {"start": "1995-01-01", "label": "late"}], "outputColumn": "era"}), ("FlagOnDateRange", {"column": "o_orderdate", "startDate": "1996-01-01", "outputColumn": "new"})], ["o_orderkey", "days", "d_is_weekend", "d_is_holiday", "era", "new"], "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS days, isodow(o_orderdate) >= 6 AS d_is_weekend, strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '05-08', '07-14', '08-15', '11-01', '11-11', '12-25') AS d_is_holiday, CASE WHEN o_orderdate BETWEEN '1992-01-01' AND '1994-12-31 23:59:59' THEN 'early' WHEN o_orderdate >= '1995-01-01' THEN 'late' END AS era, CAST(CASE WHEN o_orderdate >= '1996-01-01' THEN 1 END AS BIGINT) AS new FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)", lambda df: df.withColumn("o_orderdate", F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz")).withColumn("until", F.lit("1999-01-01").cast("timestamp_ntz")))
steps("types", "events", [("JSONExtractor", {"column": "props", "keys": ["k"]}), ("TypeSetter", {"column": "props_k", "type": "int"}), ("TypeSetter", {"columns": ["event_type"], "type": "double"})], ["event_id", "props_k", "event_type"], "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, CAST(NULL AS DOUBLE) AS event_type FROM events")

# --- filters and flags ---
steps("filter_value", "orders", [("FilterOnValue", {"column": "o_orderstatus", "matchingMode": "FULL_STRING", "values": ["F", "P"]}), ("FilterOnValue", {"column": "o_orderpriority", "matchingMode": "SUBSTRING", "values": ["URGENT"], "keep": False})], ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND NOT contains(o_orderpriority, 'URGENT')")
steps("filter_range", "part", [("FilterOnNumericRange", {"column": "p_size", "min": 10, "max": 20}), ("FilterOnNumericRange", {"column": "p_retailprice", "min": 1000, "strict": True})], ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 1000")
steps("filter_date_formula", "orders", [("FilterOnDateRange", {"column": "o_orderdate", "startDate": "1994-01-01", "endDate": "1996-12-31"}), ("FilterOnFormula", {"formula": '(val("o_totalprice") / 1000) % 2 >= 1 || !(o_orderstatus in ["F"])'})], ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1994-01-01' AND '1996-12-31' AND ((o_totalprice / 1000) % 2 >= 1 OR o_orderstatus NOT IN ('F'))")
steps("filter_clear", "customer", [("FilterOnNumericRange", {"column": "c_acctbal", "min": 0, "action": "CLEAR_CELL"}), ("FlagOnValue", {"column": "c_mktsegment", "values": ["BUILDING"], "outputColumn": "building"}), ("FlagOnFormula", {"formula": 'isNull(val("c_acctbal"))', "outputColumn": "cleared"}), ("FlagOnNumericRange", {"column": "c_acctbal", "max": 100, "outputColumn": "low"}), ("FlagOnBadType", {"column": "c_name", "expectedType": "bigint", "outputColumn": "bad"})], ["c_custkey", "c_acctbal", "building", "cleared", "low", "bad"], "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN round(c_acctbal, 6) END AS c_acctbal, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END AS BIGINT) AS building, CAST(CASE WHEN c_acctbal >= 0 THEN 1 END AS BIGINT) AS cleared, CAST(CASE WHEN c_acctbal < 0 THEN 1 END AS BIGINT) AS low, CAST(1 AS BIGINT) AS bad FROM customer")

# --- missing values ---
GAPS = lambda df: df.select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
GAP_SQL = "WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) "
ORDER = {"partition": ["user_id"], "order": ["ts", "event_id"]}
steps("fill_constant", "events", [("FillEmptyWithValue", {"column": "v", "value": 0}), ("Coalesce", {"columns": ["event_type", "user_id"], "outputColumn": "first"})], ["event_id", "v", "first"], GAP_SQL + "SELECT event_id, round(coalesce(v, 0), 6) AS v, event_type AS first FROM e", lambda df: GAPS(df).withColumn("user_id", F.col("user_id").cast("string")))
steps("fill_previous", "events", [("UpDownFill", {"column": "v", "direction": "PREVIOUS", **ORDER})], ["event_id", "v"], GAP_SQL + "SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS v FROM e", GAPS)
steps("fill_next", "events", [("UpDownFill", {"column": "v", "direction": "NEXT", **ORDER})], ["event_id", "v"], GAP_SQL + "SELECT event_id, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM e", GAPS)
steps("fill_mean", "events", [("FillEmptyWithComputedValue", {"column": "v", "mode": "MEDIAN"})], ["event_id", "v"], GAP_SQL + "SELECT event_id, round(coalesce(v, (SELECT median(v) FROM e)), 6) AS v FROM e", GAPS)
steps("remove_empty", "events", [("RemoveRowsOnEmpty", {"column": "v"})], ["event_id"], GAP_SQL + "SELECT event_id FROM e WHERE v IS NOT NULL", GAPS)

# --- categories, conditions ---
steps("encode", "customer", [("CategoricalEncoder", {"column": "c_mktsegment", "encoding": e, "outputColumn": e.lower(), "target": "y"}) for e in ("LABEL", "COUNT", "FREQUENCY", "TARGET", "LEAVE_ONE_OUT", "WOE")], ["c_custkey", "label", "count", "frequency", "target", "leave_one_out", "woe"], """WITH c AS (SELECT c_custkey, c_mktsegment AS m, CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END AS y FROM customer), s AS (SELECT m, count(*) AS n, sum(y) AS g, avg(y) AS a, dense_rank() OVER (ORDER BY m) - 1 AS l FROM c GROUP BY m), t AS (SELECT count(*) AS n, sum(y) AS g FROM c)
 SELECT c_custkey, l AS label, s.n AS count, round(s.n / t.n, 6) AS frequency, round(a, 6) AS target, round((s.g - y) / (s.n - 1), 6) AS leave_one_out, round(ln((s.g / t.g) / ((s.n - s.g) / (t.n - t.g))), 6) AS woe FROM c JOIN s USING (m), t""", lambda df: df.select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 4000).cast("double").alias("y")))
steps("one_hot", "orders", [("CategoricalEncoder", {"column": "o_orderstatus", "encoding": "ONE_HOT"})], ["o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"], "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{x}' AS BIGINT) AS \"o_orderstatus_{x}\"" for x in "FOP") + " FROM orders")
steps("long_tail", "part", [("LongTailGrouper", {"column": "p_brand", "threshold": 75, "replacement": "OTHER"})], ["p_partkey", "p_brand"], "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) >= 75 THEN p_brand ELSE 'OTHER' END AS p_brand FROM part")
steps("conditions", "orders", [("IfThenElse", {"column": "o_totalprice", "rules": [{"condition": 'val("o_totalprice") > 200000', "value": "high"}, {"condition": 'val("o_totalprice") > 100000', "value": "mid"}], "elseValue": "low", "outputColumn": "band"}), ("SwitchCase", {"column": "o_orderstatus", "cases": {"F": "final", "O": "open"}, "defaultValue": "?", "outputColumn": "status"}), ("TranslateValues", {"column": "o_orderstatus", "translations": {"F": "f"}, "outputColumn": "mapped"}), ("TranslateValues", {"column": "o_orderstatus", "translations": {"F": "f"}, "unmatched": "KEEP", "outputColumn": "kept"})], ["o_orderkey", "band", "status", "mapped", "kept"], "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE '?' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'f' END AS mapped, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE o_orderstatus END AS kept FROM orders")

# --- columns, arrays, JSON, geography ---
steps("columns", "nation", [("ColumnRenamer", {"renamings": [{"from": "n_name", "to": "name"}]}), ("ColumnCopier", {"inputColumn": "name", "outputColumn": "twin"}), ("ColumnsConcat", {"columns": ["n_nationkey", "name"], "separator": "-", "outputColumn": "key"}), ("FillColumn", {"column": "fixed", "value": "x"}), ("ColumnReorder", {"columns": ["key"]}), ("ColumnsSelector", {"columns": ["n_regionkey"], "keep": False})], ["key", "n_nationkey", "name", "twin", "fixed"], "SELECT n_nationkey || '-' || n_name AS key, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, n_name AS twin, 'x' AS fixed FROM nation")
steps("arrays", "embeddings", [("ArrayElementExtractor", {"column": "embedding", "index": 0, "outputColumn": "e0"}), ("ArrayElementExtractor", {"column": "embedding", "index": -1, "outputColumn": "last"}), ("ArraySorter", {"column": "embedding", "outputColumn": "sorted"}), ("ArrayElementExtractor", {"column": "sorted", "index": 0, "outputColumn": "least"})], ["vec_id", "e0", "last", "least"], "SELECT vec_id, embedding[1] AS e0, embedding[-1] AS last, list_min(embedding) AS least FROM embeddings")
steps("json", "events", [("ExtractWithJSONPath", {"column": "props", "jsonPath": "$.k", "outputColumn": "k"}), ("ObjectNest", {"columns": ["event_type", "user_id"], "outputColumn": "nested"}), ("FoldObject", {"column": "nested"})], ["event_id", "k", "key", "value"], "SELECT event_id, json_extract_string(props, '$.k') AS k, unnest(['event_type', 'user_id']) AS key, unnest([event_type, CAST(user_id AS VARCHAR)]) AS value FROM events")
steps("json_flatten", "events", [("JSONFlattener", {"column": "props", "separator": "_"})], ["event_id", "props_k"], "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
steps("split_fold", "part", [("SplitFold", {"column": "p_type", "separator": " ", "outputColumn": "word"})], ["p_partkey", "word"], "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
steps("unfold", "orders", [("Unfold", {"column": "o_orderstatus", "dummify": True})], ["o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"], "SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{x}' THEN 1 END AS BIGINT) AS \"o_orderstatus_{x}\"" for x in "FOP") + " FROM orders")
steps("triggered_unfold", "events", [("TriggeredUnfold", {"column": "event_type", "trigger": "signup", "value": "event_id", "partition": ["user_id"], "order": ["ts", "event_id"], "values": ["signup", "click", "purchase"]})], ["user_id", "session_no", "signup_first", "click_first", "purchase_first"], "WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM events) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(event_id) FILTER (WHERE event_type = 'signup') AS signup_first, min(event_id) FILTER (WHERE event_type = 'click') AS click_first, min(event_id) FILTER (WHERE event_type = 'purchase') AS purchase_first FROM s WHERE session_no > 0 GROUP BY 1, 2")
PLACES = lambda df: df.select("s_suppkey", ((F.col("s_suppkey") * 7) % 80).cast("double").alias("lat"), ((F.col("s_suppkey") * 13) % 170).cast("double").alias("lon"))
steps("geo", "supplier", [("GeoPointCreator", {"latColumn": "lat", "lonColumn": "lon", "outputColumn": "p"}), ("GeoPointExtractor", {"column": "p", "latColumn": "la", "lonColumn": "lo"}), ("FillColumn", {"column": "q", "value": "POINT(0.0 0.0)"}), ("GeoDistanceCalculator", {"point1Column": "p", "point2Column": "q", "unit": "KILOMETER", "outputColumn": "km"})], ["s_suppkey", "la", "lo", "km"], "WITH t AS (SELECT s_suppkey, CAST((s_suppkey * 7) % 80 AS DOUBLE) AS la, CAST((s_suppkey * 13) % 170 AS DOUBLE) AS lo FROM supplier) SELECT s_suppkey, la, lo, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(la) / 2), 2) + cos(radians(la)) * pow(sin(radians(lo) / 2), 2))), 4) AS km FROM t", PLACES, 4)
steps("geo_zone", "supplier", [("GeoPointCreator", {"latColumn": "lat", "lonColumn": "lon", "outputColumn": "p"}), ("FilterOnGeoZone", {"geoColumn": "p", "zone": "POLYGON((10.5 10.5, 100.5 10.5, 100.5 60.5, 10.5 60.5, 10.5 10.5))"})], ["s_suppkey"], "SELECT s_suppkey FROM supplier WHERE (s_suppkey * 7) % 80 BETWEEN 11 AND 60 AND (s_suppkey * 13) % 170 BETWEEN 11 AND 100", PLACES)
steps("dedup_rows", "orders", [("RemoveDuplicates", {"columns": ["o_custkey"], "order": ["o_orderkey"]})], ["o_orderkey", "o_custkey"], "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")

# --- more text ---
RAGGED = lambda df: df.select("p_partkey", F.concat(F.lit("  \t"), F.col("p_type"), F.lit("  éÀx "), F.col("p_brand"), F.lit(" \t ")).alias("t"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')).alias("q"))
RAGGED_SQL = "WITH r AS (SELECT p_partkey, '  ' || chr(9) || p_type || '  éÀx ' || p_brand || ' ' || chr(9) || ' ' AS t, '\"' || p_name || '\"' AS q FROM part) "
MORE = {"TRIM_LEFT": r"regexp_replace(t, '^\s+', '')", "TRIM_RIGHT": r"regexp_replace(t, '\s+$', '')", "NORMALIZE_WHITESPACE": r"trim(regexp_replace(t, '\s+', ' ', 'g'))", "COLLAPSE_WHITESPACE": r"regexp_replace(t, '\s+', ' ', 'g')", "REMOVE_ACCENTS": "strip_accents(t)", "ASCII_TRANSLITERATE": "strip_accents(t)", "REMOVE_NON_PRINTABLE": "replace(t, chr(9), '')", "SWAPCASE": "list_reduce(list_transform(string_split(t, ''), lambda x: CASE WHEN x = upper(x) THEN lower(x) ELSE upper(x) END), lambda a, b: a || b)", "PAD_CENTER": "CASE WHEN length(t) < 80 THEN rpad(lpad(t, CAST(length(t) + floor((80 - length(t)) / 2.0) AS INTEGER), '*'), 80, '*') ELSE t END"}
steps("string_modes_more", "part", [*[("StringTransformer", {"column": "t", "mode": m, "outputColumn": m.lower(), "length": 80, "pad": "*"}) for m in MORE], ("StringTransformer", {"column": "q", "mode": "UNQUOTE", "outputColumn": "unquote"}), ("StringTransformer", {"column": "q", "mode": "TRUNCATE", "length": 5, "outputColumn": "truncate"})], ["p_partkey", *[m.lower() for m in MORE], "unquote", "truncate"], RAGGED_SQL + "SELECT p_partkey, " + ", ".join(f"{v} AS {k.lower()}" for k, v in MORE.items()) + ", q[2:-2] AS unquote, q[1:5] AS truncate FROM r", RAGGED)
steps("titlecase", "part", [("StringTransformer", {"column": "p_type", "mode": "TITLECASE", "outputColumn": "titled"})], ["p_partkey", "titled"], "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled FROM part")
steps("ngrams", "part", [("Ngrammer", {"column": "p_type", "n": 2, "outputColumn": "grams"}), ("ArrayJoiner", {"column": "grams", "separator": "|", "outputColumn": "joined"})], ["p_partkey", "joined"], "WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS joined FROM w")
steps("simplify", "part", [("SimplifyText", {"column": "p_type", "stopWords": ["tin", "steel"], "sort": True, "outputColumn": "simple"})], ["p_partkey", "simple"], "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(lower(p_type), ' '), lambda w: w NOT IN ('tin', 'steel'))), ' ') AS simple FROM part")
steps("html", "part", [("HtmlStripper", {"column": "h", "outputColumn": "plain"})], ["p_partkey", "plain"], "SELECT p_partkey, p_name || ' & ' || p_brand || ' <' || p_size AS plain FROM part", lambda df: df.select("p_partkey", F.concat(F.lit("<html><script>var a = '<p>';</script><p class='x'>"), F.col("p_name"), F.lit("&nbsp;&amp;</p>\n<b>"), F.col("p_brand"), F.lit("</b> &lt;"), F.col("p_size"), F.lit("<style>p {}</style></html>")).alias("h")))
steps("multi_find_replace", "orders", [("MultiColumnFindReplace", {"columns": ["o_orderstatus", "o_orderpriority"], "mapping": [{"from": "F", "to": "f"}, {"from": "URGENT", "to": "now"}]}), ("UnicodeNormalizer", {"column": "u", "form": "NFC"}), ("StemText", {"column": "words", "outputColumn": "stem"}), ("LemmatizeText", {"column": "words", "outputColumn": "lemma"}), ("SentimentAnalyzer", {"column": "mood", "outputColumn": "mood"})], ["o_orderkey", "o_orderstatus", "o_orderpriority", "u", "stem", "lemma", "mood"], "SELECT o_orderkey, replace(o_orderstatus, 'F', 'f') AS o_orderstatus, replace(replace(o_orderpriority, 'F', 'f'), 'URGENT', 'now') AS o_orderpriority, nfc_normalize('e' || chr(769) || o_orderkey) AS u, 'table run city' AS stem, 'tables running cities' AS lemma, CASE WHEN o_orderstatus = 'F' THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS mood FROM orders", lambda df: df.withColumn("u", F.concat(F.lit("é"), F.col("o_orderkey"))).withColumn("words", F.lit("tables running cities")).withColumn("mood", F.when(F.col("o_orderstatus") == "F", "this is wrong").otherwise("a great success")))

# --- more identifiers ---
steps("countries_phones", "nation", [("CountryNormalizer", {"column": "n_name", "outputColumn": "code"}), ("PhoneFormatter", {"column": "phone", "country": "FR", "outputColumn": "intl"})], ["n_nationkey", "code", "intl"], "SELECT n_nationkey, CASE n_name " + " ".join(f"WHEN '{k.upper()}' THEN '{v}'" for k, v in {"france": "FR", "germany": "DE", "united states": "US", "united kingdom": "GB", "japan": "JP", "china": "CN", "india": "IN", "brazil": "BR", "canada": "CA", "kenya": "KE", "egypt": "EG", "russia": "RU", "peru": "PE"}.items()) + " END AS code, '+331990012' || (n_nationkey + 10) AS intl FROM nation", lambda df: df.withColumn("phone", F.concat(F.lit("01 99 00 12 "), (F.col("n_nationkey") + 10))))
AGENTS = {"Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.0": ("Edge", "Windows", "desktop"), "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Version/17.0 Mobile/15E148 Safari/604.1": ("Safari", "iOS", "mobile"), "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0": ("Firefox", "Linux", "desktop"), "examplebot/2.1 (crawler)": (None, None, "robot"), "Mozilla/5.0 (Linux; Android 14) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36": ("Chrome", "Android", "mobile")}
_AGENT = lambda: F.get(F.array(*[F.lit(a) for a in AGENTS]), F.pmod(F.col("c_custkey"), F.lit(5)).cast("int"))
steps("user_agents", "customer", [("UserAgentParser", {"column": "ua"})], ["c_custkey", "ua_browser", "ua_os", "ua_type"], "SELECT c_custkey, " + ", ".join("CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN " + (f"'{v[k]}'" if v[k] else "NULL") for i, v in enumerate(AGENTS.values())) + f" END AS ua_{n}" for k, n in enumerate(("browser", "os", "type"))) + " FROM customer", lambda df: df.withColumn("ua", _AGENT()))
steps("addresses", "customer", [("AddressParser", {"column": "a"})], ["c_custkey", "a_number", "a_street", "a_postcode", "a_city"], "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a_number, 'rue des Lilas' AS a_street, CAST(10000 + c_nationkey AS VARCHAR) AS a_postcode, 'Nantes' AS a_city FROM customer", lambda df: df.select("c_custkey", F.concat(F.col("c_custkey"), F.lit(" rue des Lilas, "), F.col("c_nationkey") + 10000, F.lit(" Nantes")).alias("a")))
steps("grok", "customer", [("Grok", {"column": "line", "pattern": "%{IP:client} %{WORD:verb} %{NOTSPACE:path} %{INT:status} %{NUMBER:took}"})], ["c_custkey", "client", "verb", "path", "status", "took"], "SELECT c_custkey, '10.1.2.' || c_nationkey AS client, 'GET' AS verb, '/c/' || c_custkey AS path, '200' AS status, '0.5' AS took FROM customer", lambda df: df.select("c_custkey", F.concat(F.lit("10.1.2."), F.col("c_nationkey"), F.lit(" GET /c/"), F.col("c_custkey"), F.lit(" 200 0.5")).alias("line")))
steps("visitor_uuid", "customer", [("VisitorId", {"columns": ["c_name", "c_nationkey"]}), ("UUIDGenerator", {"columns": ["c_custkey"], "outputColumn": "u"})], ["c_custkey", "visitor_id", "u"], "WITH h AS (SELECT c_custkey, sha256(c_name || '|' || c_nationkey) AS visitor_id, sha1(CAST(c_custkey AS VARCHAR)) AS h FROM customer) SELECT c_custkey, visitor_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS u FROM h")

# --- more numbers ---
NUM2 = {"LOG2": (None, "CASE WHEN x > 0 THEN log2(x) END"), "EXP": (None, "exp(x)"), "MODULO": ("7", "x - 7 * floor(x / 7)"), "ROUND": ("1", "round(x, 1)"), "TRUNCATE": (None, "CAST(trunc(x) AS BIGINT)"), "ROUND_TO_SIGNIFICANT": ("3", "CASE WHEN x = 0 THEN 0 ELSE round(x * pow(10, 2 - floor(log10(abs(x))))) / pow(10, 2 - floor(log10(abs(x)))) END"), "COS": (None, "cos(x)"), "TAN": (None, "tan(x)"), "RADIANS_TO_DEGREES": (None, "degrees(x)")}
steps("numeric_modes_more", "supplier", [*[("NumericalTransformer", {"column": "x", "mode": m, "outputColumn": m.lower(), **({"value": int(v)} if v else {})}) for m, (v, _) in NUM2.items()], ("NumericalTransformer", {"column": "z", "mode": "ASIN", "outputColumn": "asin"}), ("NumericalTransformer", {"column": "z", "mode": "ACOS", "outputColumn": "acos"})], ["s_suppkey", *[m.lower() for m in NUM2], "asin", "acos"], "WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_acctbal / 5000 AS z FROM supplier) SELECT s_suppkey, " + ", ".join(f"{e if m == 'TRUNCATE' else f'round({e}, 6)'} AS {m.lower()}" for m, (_, e) in NUM2.items()) + ", round(CASE WHEN abs(z) <= 1 THEN asin(z) END, 6) AS asin, round(CASE WHEN abs(z) <= 1 THEN acos(z) END, 6) AS acos FROM t", lambda df: df.withColumn("x", F.col("s_acctbal") / 1000).withColumn("z", F.col("s_acctbal") / 5000))
steps("bins_quantile", "part", [("Binner", {"column": "p_retailprice", "mode": "QUANTILE", "n": 4, "outputColumn": "q"}), ("Binner", {"column": "p_partkey", "mode": "EQUAL_FREQUENCY", "n": 7, "outputColumn": "f"})], ["p_partkey", "q", "f"], "WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, CAST(CASE WHEN p_retailprice < a THEN 0 WHEN p_retailprice < b THEN 1 WHEN p_retailprice < c THEN 2 ELSE 3 END AS BIGINT) AS q, ntile(7) OVER (ORDER BY p_partkey) - 1 AS f FROM part, e")
steps("bins_equal_counts", "lineitem", [("Binner", {"column": "l_quantity", "mode": "EQUAL_FREQUENCY", "n": 6, "outputColumn": "f"})], ["l_quantity", "f"], "SELECT l_quantity, ntile(6) OVER (ORDER BY l_quantity) - 1 AS f FROM lineitem")
steps("bins_clusters", "part", [("Binner", {"column": "x", "mode": "KMEANS", "n": 3, "outputColumn": "k"})], ["p_partkey", "k"], "SELECT p_partkey, p_partkey % 3 AS k FROM part", lambda df: df.select("p_partkey", (F.pmod(F.col("p_partkey"), F.lit(3)) * 100 + F.pmod(F.col("p_partkey"), F.lit(7))).alias("x")))
steps("row_norms", "lineitem", [("MeasureNormalize", {"columns": ["l_quantity", "l_discount"], "column": "l_quantity", "mode": m}) for m in ("L1", "L2")], ["l_orderkey", "l_linenumber", "l_quantity_l1", "l_discount_l1", "l_quantity_l2", "l_discount_l2"], "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity / (l_quantity + l_discount), 6) AS l_quantity_l1, round(l_discount / (l_quantity + l_discount), 6) AS l_discount_l1, round(l_quantity / sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS l_quantity_l2, round(l_discount / sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS l_discount_l2 FROM lineitem")
steps("negate", "orders", [("Negate", {"column": "flag", "outputColumn": "no"}), ("ImputeWithML", {"column": "x", "method": "mean", "outputColumn": "filled"})], ["o_orderkey", "no", "filled"], "WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS flag, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders) SELECT o_orderkey, NOT flag AS no, round(coalesce(x, (SELECT avg(x) FROM o)), 4) AS filled FROM o", lambda df: df.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("string").alias("flag"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x")), 4)

# --- more dates ---
steps("date_parts_more", "events", [("DateComponentExtractor", {"column": "ts", "components": ["HOUR", "MINUTE", "SECOND", "MILLISECOND", "TIMESTAMP", "ISO_WEEK"]}), ("TimezoneConverter", {"column": "ts", "fromTimezone": "UTC", "toTimezone": "Asia/Tokyo", "outputColumn": "tokyo"}), ("DateFormatter", {"column": "tokyo", "format": "yyyy-MM-dd HH:mm:ss", "outputColumn": "tokyo"})], ["event_id", "ts_hour", "ts_minute", "ts_second", "ts_millisecond", "ts_timestamp", "ts_iso_week", "tokyo"], "SELECT event_id, hour(ts) AS ts_hour, minute(ts) AS ts_minute, second(ts) AS ts_second, CAST((epoch_us(ts) // 1000) % 1000 AS BIGINT) AS ts_millisecond, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_timestamp, weekofyear(ts) AS ts_iso_week, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo FROM events")

# --- more filters: every way of matching as a flag ---
WAYS = {"NOT_EQUALS": ("URGENT", "o_orderpriority <> 'URGENT'"), "NOT_CONTAINS": ("1", "NOT contains(o_orderpriority, '1')"), "STARTS_WITH": ("5", "starts_with(o_orderpriority, '5')"), "ENDS_WITH": ("LOW", "ends_with(o_orderpriority, 'LOW')"), "REGEX": ("^[12]", "regexp_matches(o_orderpriority, '^[12]')"), "NOT_REGEX": ("^[12]", "NOT regexp_matches(o_orderpriority, '^[12]')"), "CONTAINS": ("HIGH", "contains(o_orderpriority, 'HIGH')"), "EQUALS": ("5-LOW", "o_orderpriority = '5-LOW'"), "IN_LIST": (["5-LOW", "2-HIGH"], "o_orderpriority IN ('5-LOW', '2-HIGH')"), "NOT_IN_LIST": (["5-LOW", "2-HIGH"], "o_orderpriority NOT IN ('5-LOW', '2-HIGH')")}
BARE = {"IS_EMPTY": "e IS NULL OR e = ''", "IS_NOT_EMPTY": "e IS NOT NULL AND e <> ''", "IS_NULL": "e IS NULL", "IS_NOT_NULL": "e IS NOT NULL"}
EMPTY = lambda df: df.withColumn("e", F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", "x"))
steps("flag_ways", "orders", [*[("FlagOnValue", {"column": "o_orderpriority", "matchingMode": w, "values": v if isinstance(v, list) else [v], "outputColumn": w.lower()}) for w, (v, _) in WAYS.items()], *[("FlagOnValue", {"column": "e", "matchingMode": w, "values": [], "outputColumn": w.lower()}) for w in BARE]], ["o_orderkey", *[w.lower() for w in (*WAYS, *BARE)]], "WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'x' END AS e FROM orders) SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN {s} THEN 1 END AS BIGINT) AS {w.lower()}" for w, s in {**{w: s for w, (_, s) in WAYS.items()}, **BARE}.items()) + " FROM o", EMPTY)
for _w, (_v, _s) in WAYS.items():
    steps(f"filter_{_w.lower()}", "orders", [("FilterOnValue", {"column": "o_orderpriority", "matchingMode": _w, "values": _v if isinstance(_v, list) else [_v]})], ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_s}")
for _w, _s in BARE.items():
    steps(f"filter_{_w.lower()}", "orders", [("FilterOnValue", {"column": "e", "matchingMode": _w, "values": []})], ["o_orderkey"], f"SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'x' END AS e FROM orders) WHERE {_s}", EMPTY)
MIXED = lambda df: df.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("m"))
MIXED_SQL = "WITH m AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS m FROM orders) "
steps("filter_bad_type", "orders", [("FilterOnBadType", {"column": "m", "expectedType": "bigint"})], ["o_orderkey"], MIXED_SQL + "SELECT o_orderkey FROM m WHERE TRY_CAST(m AS BIGINT) IS NULL", MIXED)
steps("filter_null_numeric", "orders", [("FilterOnNullNumeric", {"column": "m"})], ["o_orderkey"], MIXED_SQL + "SELECT o_orderkey FROM m WHERE TRY_CAST(m AS DOUBLE) IS NULL", MIXED)
steps("filter_meaning", "orders", [("FilterOnMeaning", {"column": "m", "meaning": "integer", "keep": False}), ("InvalidSplit", {"column": "o_orderstatus", "meaning": "integer", "outputColumn": "odd"})], ["o_orderkey", "o_orderstatus", "odd"], MIXED_SQL + "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_orderstatus AS odd FROM m WHERE TRY_CAST(m AS BIGINT) IS NOT NULL", MIXED)
steps("flag_meaning", "orders", [("FlagOnMeaning", {"column": "m", "meaning": "integer", "outputColumn": "odd"})], ["o_orderkey", "odd"], MIXED_SQL + "SELECT o_orderkey, CAST(CASE WHEN TRY_CAST(m AS BIGINT) IS NULL THEN 1 END AS BIGINT) AS odd FROM m", MIXED)
steps("filter_multiple_values", "orders", [("FilterOnMultipleValues", {"columns": ["o_orderstatus", "o_orderpriority"], "values": ["f", "5-low"], "normalizationMode": "LOWERCASE", "booleanMode": "OR"}), ("FilterOnCustomCondition", {"expression": 'length(val("m")) > 2'})], ["o_orderkey"], MIXED_SQL + "SELECT o_orderkey FROM m WHERE (lower(o_orderstatus) IN ('f', '5-low') OR lower(o_orderpriority) IN ('f', '5-low')) AND length(m) > 2", MIXED)

# --- more rows, columns and shapes ---
steps("sort_sample", "orders", [("ShuffleRows", {"key": ["o_orderkey"]}), ("SortRows", {"columns": [{"column": "o_totalprice", "order": "DESC"}, "o_orderkey"]}), ("SampleRows", {"method": "HEAD_SEQUENTIAL", "sampleSize": 25, "order": [{"column": "o_totalprice", "order": "DESC"}, "o_orderkey"]})], ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
steps("big_data", "nation", [("GenerateBigData", {"factor": 3}), ("EnrichWithBuildContext", {"build_id": "b7"})], ["n_nationkey", "copy_no", "build_id"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(c AS BIGINT) AS copy_no, 'b7' AS build_id FROM nation, range(3) t(c)")
steps("record_context", "nation", [("EnrichWithRecordContext", {}), ("PatternExtract", {"column": "file_path", "pattern": r"([^/]+)$", "outputColumns": ["file"]})], ["file", "row_index"], "SELECT 'nation.parquet' AS file, CAST(i AS BIGINT) AS row_index FROM range((SELECT count(*) FROM nation)) t(i)")
steps("fold", "lineitem", [("FoldMultipleColumns", {"columns": ["l_discount", "l_tax"], "varName": "what", "valueName": "rate"})], ["l_orderkey", "l_linenumber", "what", "rate"], "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, what, rate FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (rate FOR what IN (l_discount, l_tax))")
steps("fold_pattern", "part", [("FoldColumnsByPattern", {"pattern": r"p_(name|brand)", "varName": "what", "valueName": "text"})], ["p_partkey", "what", "text"], "SELECT p_partkey, 'name' AS what, p_name AS text FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part", lambda df: df.select("p_partkey", "p_name", "p_brand"))
steps("transpose", "region", [("TransposeRowsToColumns", {"column": "r_name"})], ["key", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "SELECT 'r_regionkey' AS key, " + ", ".join(f"CAST(max(r_regionkey) FILTER (WHERE r_name = '{n}') AS BIGINT) AS \"{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region", lambda df: df.select("r_name", "r_regionkey"))
steps("pivot_step", "orders", [("Pivot", {"index": ["o_custkey"], "column": "o_orderstatus", "value": "o_totalprice", "type": "SUM", "modalities": ["F", "O"]})], ["o_custkey", "F_o_totalprice", "O_o_totalprice"], "SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS \"F_o_totalprice\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS \"O_o_totalprice\" FROM orders GROUP BY 1", None, 2)
steps("split_unfold", "part", [("SplitUnfold", {"column": "p_type", "separator": " ", "prefix": "t"})], ["p_partkey"], "SELECT p_partkey FROM part")
steps("arrays_more", "part", [("Tokenizer", {"column": "p_type", "outputColumn": "a"}), ("ArraySplitter", {"column": "a", "n": 2}), ("ArrayFold", {"columns": ["p_name", "p_brand"], "outputColumn": "b"}), ("ArraysConcat", {"columns": ["a", "b"], "outputColumn": "c"}), ("ArrayJoiner", {"column": "c", "separator": "/", "outputColumn": "joined"}), ("ZipArrays", {"columns": ["b", "d"], "outputColumn": "zipped"})], ["p_partkey", "a_0", "a_1", "joined", "zipped"], "SELECT p_partkey, split_part(p_type, ' ', 1) AS a_0, nullif(split_part(p_type, ' ', 2), '') AS a_1, replace(p_type, ' ', '/') || '/' || p_name || '/' || p_brand AS joined, '[{\"b\":\"' || p_name || '\",\"d\":\"1\"},{\"b\":\"' || p_brand || '\",\"d\":\"2\"}]' AS zipped FROM part", lambda df: df.withColumn("d", F.array(F.lit("1"), F.lit("2"))))
steps("array_unfold", "part", [("Tokenizer", {"column": "p_type", "outputColumn": "word"}), ("ArrayUnfold", {"column": "word"})], ["p_partkey", "word"], "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
steps("xml_nested", "part", [("XMLExtractor", {"column": "x", "xpath": "/a/b/@k", "outputColumn": "k"}), ("NestedProcessor", {"processor": {"type": "StringTransformer", "params": {"column": "p_brand", "mode": "TO_LOWER"}}}), ("ProcessorGroup", {"steps": [{"type": "StringTransformer", "params": {"column": "p_name", "mode": "TO_UPPER"}}]}), ("MoveColumns", {"columns": ["p_name"], "position": "END"}), ("MeaningTranslate", {"column": "p_size", "translations": {"1": "one", "2": "two"}, "outputColumn": "said"})], ["p_partkey", "k", "p_brand", "p_name", "said"], "SELECT p_partkey, CAST(p_size AS VARCHAR) AS k, lower(p_brand) AS p_brand, upper(p_name) AS p_name, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS said FROM part", lambda df: df.withColumn("x", F.concat(F.lit("<a><b k='"), F.col("p_size"), F.lit("'/></a>"))))
prepare.register_python("twice", lambda s: s * 2, "double")
steps("python_formula", "part", [("PythonUDF", {"function": "twice", "inputColumns": ["p_retailprice"], "outputColumn": "double_price"}), ("Formula", {"outputColumn": "f", "expression": 'if(p_size in [1, 2, 3], "few", concat("n", p_size))'}), ("CreateColumnWithGREL", {"column": "g", "expression": "round(abs(sqrt(p_size) - 5) ** 2, 3) + mod(p_size, 4) + max(p_size, 10) + floor(p_retailprice / 100)"}), ("Formula", {"outputColumn": "h", "expression": 'replace(toUppercase(substring(p_name, 0, 4)), "A", "4")'}), ("Formula", {"outputColumn": "i", "expression": 'startsWith(p_brand, "Brand") && !isBlank(p_name) && indexOf(p_name, " ") > 3'})], ["p_partkey", "double_price", "f", "g", "h", "i"], "SELECT p_partkey, round(p_retailprice * 2, 6) AS double_price, CASE WHEN p_size IN (1, 2, 3) THEN 'few' ELSE 'n' || p_size END AS f, round(round(pow(abs(sqrt(p_size) - 5), 2), 3) + p_size % 4 + greatest(p_size, 10) + floor(p_retailprice / 100), 6) AS g, replace(upper(p_name[1:4]), 'A', '4') AS h, starts_with(p_brand, 'Brand') AND p_name <> '' AND strpos(p_name, ' ') - 1 > 3 AS i FROM part")
steps("encode_more", "orders", [("CategoricalEncoder", {"column": "o_orderpriority", "encoding": "ORDINAL", "order": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], "outputColumn": "ordinal"}), ("CategoricalEncoder", {"column": "o_orderpriority", "encoding": "BINARY", "outputColumn": "bin"}), ("CategoricalEncoder", {"column": "o_orderpriority", "encoding": "HASH", "n": 8, "outputColumn": "hash"}), ("FlagOnNumericRange", {"column": "hash", "min": 0, "max": 7, "outputColumn": "hashed"})], ["o_orderkey", "ordinal", "bin_0", "bin_1", "bin_2", "hashed"], "WITH o AS (SELECT o_orderkey, 5 - CAST(o_orderpriority[1] AS BIGINT) AS ordinal, CAST(o_orderpriority[1] AS BIGINT) - 1 AS b FROM orders) SELECT o_orderkey, ordinal, b & 1 AS bin_0, (b >> 1) & 1 AS bin_1, (b >> 2) & 1 AS bin_2, CAST(1 AS BIGINT) AS hashed FROM o")
steps("geo_more", "supplier", [("GeoPointCreator", {"latColumn": "lat", "lonColumn": "lon", "outputColumn": "p"}), ("GeoInfoExtractor", {"column": "p"}), ("GeoPointBuffer", {"column": "p", "distance": 10, "unit": "KILOMETER", "outputColumn": "area"}), ("GeoPolygonMatcher", {"polygonColumn": "area", "pointColumn": "p", "outputColumn": "inside"}), ("ChangeCRS", {"column": "p", "to": "EPSG:3857", "outputColumn": "merc"}), ("ChangeCRS", {"column": "merc", "from": "EPSG:3857", "to": "EPSG:4326", "outputColumn": "again"}), ("GeoPointExtractor", {"column": "again", "latColumn": "la", "lonColumn": "lo"})], ["s_suppkey", "p_type", "p_lon", "inside", "la", "lo"], "SELECT s_suppkey, 'POINT' AS p_type, CAST((s_suppkey * 13) % 170 AS DOUBLE) AS p_lon, true AS inside, CAST((s_suppkey * 7) % 80 AS DOUBLE) AS la, CAST((s_suppkey * 13) % 170 AS DOUBLE) AS lo FROM supplier", PLACES, 4)
steps("fill_interpolate", "events", [("UpDownFill", {"column": "v", "direction": "LINEAR", **ORDER})], ["event_id", "v"], GAP_SQL + ", n AS (SELECT *, row_number() OVER w AS pos FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER f AS z, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pa, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS pz FROM n WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN z IS NOT NULL THEN a + (z - a) * (pos - pa) / (pz - pa) ELSE a END, 6) AS v FROM b", GAPS)
