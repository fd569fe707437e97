"""The profiler's registered queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import engine
from quarrylens.health import health_table
from quarrylens.model import Dataset, Detection
from quarrylens.operators import relations, tables, texts
from quarrylens.operators.images import aspect_column, damage, exact_groups, hamming_pairs, leaks, quality_stats, resolution_stats
from quarrylens.plans.passes import distinct_counts, quartiles
from quarrylens.plans.shared import fresh_path
from quarrylens.sources.sampling import SEED, exact_sample
from quarrylens.sources.scan import detect_format, scan_directory
from quarrylens.sources.tabular import diagonal_union

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _missing_sql(source: str, columns: list[str]) -> str:
    counted = _union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, count(*) AS total_rows FROM src" for c in columns])
    return f"WITH src AS ({source}) {counted}"


DOCS_LABELS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DOCS_LABELS_SQL = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


# ---------------------------------------------------------------- missing values


@query(_missing_sql("SELECT * FROM lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"]))
def missing_values_lineitem(spark, sf_dir):
    return tables.missing_values(table(spark, sf_dir, "lineitem"))


@query(_missing_sql(DOCS_LABELS_SQL, DOCS_LABELS))
def missing_values_docs_labels(spark, sf_dir):
    return tables.missing_values(docs_labels(spark, sf_dir))


@query(f"""WITH m AS ({_missing_sql(f"SELECT *, NULL::DOUBLE AS nothing FROM ({DOCS_LABELS_SQL})", [*DOCS_LABELS, "nothing"])})
SELECT column_name, CASE WHEN missing_pct > 20 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN missing_pct > 50 THEN 'missing_values_high' WHEN missing_pct > 20 THEN 'missing_values_moderate' ELSE 'missing_values_low' END AS code FROM m WHERE missing_pct > 0
UNION ALL SELECT column_name, 'error', 'empty_columns' FROM m WHERE missing_count = total_rows AND total_rows > 0""")
def missing_findings_docs_labels(spark, sf_dir):
    return tables.missing_findings(tables.missing_values(docs_labels(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))))


# ---------------------------------------------------------------- duplicates


def _duplicates_sql(source: str) -> str:
    return f"""WITH src AS ({source}), n AS (SELECT (SELECT count(*) FROM src) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS unique_rows)
SELECT total_rows, unique_rows, total_rows - unique_rows AS duplicate_rows, round(100.0 * (total_rows - unique_rows) / total_rows, 2)::DOUBLE AS duplicate_pct FROM n"""


@query(_duplicates_sql("SELECT text, lang FROM documents"))
def duplicates_documents(spark, sf_dir):
    return tables.row_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@query(_duplicates_sql("SELECT user_id, event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS sometimes FROM events"))
def duplicates_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tables.row_duplicates(events.select("user_id", "event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("sometimes")))


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "one"]


@query("WITH src AS (SELECT *, 1 AS one FROM orders)\n" + _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) AS n_unique, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) = count(*) AS is_id, count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) <= 1 AS is_constant FROM src" for c in ORDERS]))
def id_and_constant_columns_orders(spark, sf_dir):
    return tables.column_uniqueness(table(spark, sf_dir, "orders").withColumn("one", F.lit(1)))


@query(_union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) AS n_unique, count(*) - count({c}) AS missing_count, count(*) AS total_rows FROM lineitem" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"]]))
def unique_counts_wide_lineitem(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return distinct_counts(lineitem, lineitem.columns).select("column_name", "n_unique", "missing_count", "total_rows")


# ---------------------------------------------------------------- column statistics


def _rank_sql(c: str, q: float) -> str:
    return f"(list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q} + 0.5) AS BIGINT) + 1])"


def _numeric_sql(source: str, columns: list[str]) -> str:
    return f"WITH src AS ({source})\n" + _union([
        f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS missing_count, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
round(avg({c}), 4) AS mean, round(median({c}::DOUBLE), 4) AS median, round(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, 4) AS std,
round({_rank_sql(c, 0.25)}::DOUBLE, 4) AS q25, round({_rank_sql(c, 0.75)}::DOUBLE, 4) AS q75, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM src"""
        for c in columns
    ])


@query(_numeric_sql("SELECT * FROM lineitem", LINEITEM))
def numeric_stats_lineitem(spark, sf_dir):
    return tables.numeric_stats(table(spark, sf_dir, "lineitem"), LINEITEM)


@query(_numeric_sql("SELECT *, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS sparse FROM orders", ["o_orderkey", "o_custkey", "o_totalprice", "sparse"]))
def numeric_stats_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("sparse", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")))
    return tables.numeric_stats(orders, ["o_orderkey", "o_custkey", "o_totalprice", "sparse"])


@query(_union([f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS missing_count, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 1) AS mean_length FROM documents" for c in ["text", "lang", "source"]]))
def text_stats_documents(spark, sf_dir):
    return tables.text_stats(table(spark, sf_dir, "documents"))


@query("""SELECT 'good' AS column_name, count(*) FILTER (quality = 1) AS true_count, count(*) FILTER (quality = 0) AS false_count,
round(100.0 * count(*) FILTER (quality = 1) / count(quality), 2)::DOUBLE AS true_pct FROM (""" + DOCS_LABELS_SQL + ")")
def boolean_stats_labels(spark, sf_dir):
    return tables.boolean_stats(docs_labels(spark, sf_dir).select((F.col("quality") == 1).alias("good")))


def _top_sql(source: str, columns: list[str]) -> str:
    counted = _union([f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL" for c in columns])
    return f"""SELECT column_name, rank, value, n, round(100.0 * n / (SELECT count(*) FROM {source}), 2)::DOUBLE AS pct FROM (
SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ({counted})) WHERE rank <= 10"""


@query(_top_sql("events", ["event_type"]))
def top_values_events(spark, sf_dir):
    return tables.top_values(table(spark, sf_dir, "events"), ["event_type"])


@query(_top_sql("part", ["p_brand", "p_type", "p_size"]))
def top_values_all_part(spark, sf_dir):
    return tables.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


FREQUENT = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


@query(_top_sql("(SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey, l_returnflag FROM lineitem)", FREQUENT))
def top_values_many_lineitem(spark, sf_dir):
    """Columns of few, of many and of skewed values, counted from sketches and a recount."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 3 == 0, 7).otherwise(F.col("l_suppkey")).alias("l_suppkey"), "l_returnflag")
    return tables.top_values(rows, FREQUENT)


@query(_union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) AS total_rows, count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / greatest(count(*), 1) > 0.9 AS flagged FROM customer" for c in ["c_name", "c_mktsegment"]]))
def high_cardinality_customer(spark, sf_dir):
    return tables.high_cardinality(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query(_union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) AS total_rows, count(DISTINCT {c}) < 100 AND count(DISTINCT {c}) < 0.05 * count(*) AS is_category FROM part" for c in ["p_name", "p_brand", "p_type"]]))
def categorical_promotion_part(spark, sf_dir):
    found = distinct_counts(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return found.select("column_name", "n_unique", "total_rows", ((F.col("n_unique") < 100) & (F.col("n_unique") < 0.05 * F.col("total_rows"))).alias("is_category"))


@query(f"SELECT 'value' AS column_name, count(value) AS n, {_rank_sql('value', 0.25)} AS q25, median(value) AS median, {_rank_sql('value', 0.75)} AS q75 FROM events")
def quartiles_events(spark, sf_dir):
    rows = [(c, *q) for c, q in quartiles(table(spark, sf_dir, "events"), ["value"]).items()]
    return spark.createDataFrame(rows, "column_name string, n long, q25 double, median double, q75 double")


def _histogram_sql(source: str, c: str) -> str:
    return f"""WITH v AS (SELECT {c}::DOUBLE AS v FROM {source} WHERE {c} IS NOT NULL AND NOT isnan({c}::DOUBLE)),
b AS (SELECT min(v) AS low, max(v) AS high, least(20, count(DISTINCT v)) AS bins FROM v),
w AS (SELECT low, high, bins, (high - low) / bins AS width FROM b),
g AS (SELECT v, low, width, bins, least(floor((v - low) / width), bins - 1)::BIGINT AS guess FROM v, w),
s AS (SELECT CASE WHEN v < low + guess * width THEN guess - 1 WHEN v >= low + (guess + 1) * width AND guess < bins - 1 THEN guess + 1 ELSE guess END AS bin FROM g),
n AS (SELECT bin, count(*) AS n FROM s GROUP BY bin)
SELECT r.bin, coalesce(n.n, 0) AS n, low + r.bin * width AS range_start, CASE WHEN r.bin = bins - 1 THEN high ELSE low + (r.bin + 1) * width END AS range_end
FROM (SELECT unnest(range(20)) AS bin) r JOIN w ON r.bin < bins LEFT JOIN n ON n.bin = r.bin"""


@query(_histogram_sql("events", "value"))
def histogram_events_value(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "events"), "value")


@query(_histogram_sql("lineitem", "l_extendedprice"))
def histogram_lineitem_extendedprice(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_union([f"SELECT '{c}' AS column_name, * FROM ({_histogram_sql('lineitem', c)})" for c in NUMBERS]))
def histograms_all_lineitem(spark, sf_dir):
    return tables.histograms(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(_histogram_sql("(SELECT CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS noisy FROM events)", "noisy"))
def histogram_nan_events(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("noisy")), "noisy")


# ---------------------------------------------------------------- relations


def _corr_sql(source: str, columns: list[str]) -> str:
    where = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return f"WITH src AS (SELECT * FROM ({source}) WHERE {where})\n" + _union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 4) END AS r FROM src" for a, b in pairs])


@query(_corr_sql("SELECT *, 1.0 AS fixed FROM lineitem", [*LINEITEM, "fixed"]))
def correlation_lineitem(spark, sf_dir):
    return relations.correlation(table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit(1.0)), [*LINEITEM, "fixed"])


DERIVED_SQL = "SELECT l_quantity, l_extendedprice, 2 * l_quantity + l_tax AS twice, -l_quantity AS minus, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS sparse FROM lineitem"
DERIVED = ["l_quantity", "l_extendedprice", "twice", "minus", "sparse"]


def _derived(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (2 * q + F.col("l_tax")).alias("twice"), (-q).alias("minus"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("sparse"))


@query(f"SELECT * FROM ({_corr_sql(DERIVED_SQL, DERIVED)}) WHERE abs(r) > 0.8")
def correlation_high_pairs(spark, sf_dir):
    return relations.high_correlations(_derived(spark, sf_dir), DERIVED)


WIDE = [f"w{i}" for i in range(14)]


@query(_corr_sql("SELECT " + ", ".join(f"l_quantity * {i % 5} + l_extendedprice / {1000 + 137 * i} + l_tax * {i * i} AS w{i}" for i in range(14)) + " FROM lineitem", WIDE))
def correlation_wide(spark, sf_dir):
    q, p, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    wide = table(spark, sf_dir, "lineitem").select(*[(q * (i % 5) + p / (1000 + 137 * i) + t * (i * i)).alias(f"w{i}") for i in range(14)])
    return relations.correlation(wide, WIDE)


SIXTY = [f"s{i}" for i in range(60)]


@query("SELECT column_a, column_b, r + 0.0 AS r FROM (" + _corr_sql("SELECT " + ", ".join(f"(l_orderkey * {i + 3} + l_partkey * {i * i + 1}) % {11 + i} + l_linenumber * {i % 4} AS s{i}" for i in range(60)) + " FROM lineitem", SIXTY) + ")")
def correlation_sixty_columns(spark, sf_dir):
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    wide = table(spark, sf_dir, "lineitem").select(*[((o * (i + 3) + p * (i * i + 1)) % (11 + i) + n * (i % 4)).alias(f"s{i}") for i in range(60)])
    return relations.correlation(wide, SIXTY)


def _outlier_sql(source: str, columns: list[str]) -> str:
    return f"WITH src AS ({source})\n" + _union([
        f"""SELECT column_name, n_rows, outlier_count, round(100.0 * outlier_count / n_rows, 2)::DOUBLE AS outlier_pct, round(low, 4) AS lower_bound, round(high, 4) AS upper_bound, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr FROM (
SELECT '{c}' AS column_name, (SELECT count({c}) FROM src) AS n_rows, (SELECT count(*) FROM src WHERE {c} < low OR {c} > high) AS outlier_count, * FROM (
SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT {_rank_sql(c, 0.25)}::DOUBLE AS q1, {_rank_sql(c, 0.75)}::DOUBLE AS q3 FROM src))) WHERE n_rows >= 10 AND q3 > q1"""
        for c in columns
    ])


@query(_outlier_sql("SELECT * FROM events", ["value", "user_id"]))
def outliers_events(spark, sf_dir):
    return relations.outliers(table(spark, sf_dir, "events"), ["value", "user_id"])


@query(_outlier_sql("SELECT *, 5 AS fixed FROM documents", ["n_chars", "fixed"]))
def outliers_documents(spark, sf_dir):
    return relations.outliers(table(spark, sf_dir, "documents").withColumn("fixed", F.lit(5)), ["n_chars", "fixed"])


def _importance_sql(source: str, target: str, features: list[str]) -> str:
    clean = lambda f: f"CASE WHEN isnan(corr({f}, {target})) THEN NULL ELSE corr({f}, {target}) END"
    return f"WITH src AS ({source})\n" + _union([f"SELECT '{f}' AS feature, round({clean(f)}, 4) AS score, round(abs({clean(f)}), 4) AS importance FROM src" for f in features])


@query(_importance_sql("SELECT quality, n_chars, len(string_split(text, ' ')) AS n_words, toxic FROM (" + DOCS_LABELS_SQL + ")", "quality", ["n_chars", "n_words", "toxic"]))
def feature_importance_labels(spark, sf_dir):
    rows = docs_labels(spark, sf_dir).select("quality", "n_chars", F.size(F.split("text", " ", -1)).alias("n_words"), "toxic")
    return relations.feature_importance(rows, "quality", ["n_chars", "n_words", "toxic"])


@query(_importance_sql("SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS target, o_totalprice, o_custkey FROM orders", "target", ["o_totalprice", "o_custkey"]))
def feature_importance_text_target(spark, sf_dir):
    return relations.feature_importance(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"])


@query(_importance_sql("SELECT dense_rank() OVER (ORDER BY c_name) - 1 AS target, c_acctbal, c_nationkey, c_custkey FROM customer", "target", ["c_acctbal", "c_nationkey", "c_custkey"]))
def feature_importance_many_values(spark, sf_dir):
    """A text target of as many values as rows."""
    return relations.feature_importance(table(spark, sf_dir, "customer"), "c_name", ["c_acctbal", "c_nationkey", "c_custkey"])


def _time_sql(source: str, c: str) -> str:
    return f"""WITH d AS (SELECT epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS gap FROM {source} WHERE {c} IS NOT NULL),
m AS (SELECT gap, count(*) AS n FROM d WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 1)
SELECT min({c}) AS start_time, max({c}) AS end_time, count(DISTINCT {c}) AS n_unique, (SELECT gap FROM m) AS main_interval_us FROM {source}"""


@query(_time_sql("events", "ts"))
def time_series_events(spark, sf_dir):
    return relations.time_series(table(spark, sf_dir, "events"), "ts")


@query(_time_sql("lineitem", "l_shipdate"))
def time_series_shipdate(spark, sf_dir):
    return relations.time_series(table(spark, sf_dir, "lineitem"), "l_shipdate")


def _balance_sql(source: str, c: str) -> str:
    return f"""WITH n AS (SELECT {c}::VARCHAR AS label, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)
SELECT label, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS pct, round(max(n) OVER () / min(n) OVER (), 2)::DOUBLE AS imbalance_ratio FROM n"""


@query(_balance_sql("events", "event_type"))
def class_balance_events(spark, sf_dir):
    return tables.class_balance(table(spark, sf_dir, "events"), "event_type")


@query(_balance_sql(f"({DOCS_LABELS_SQL})", "quality"))
def class_balance_labels(spark, sf_dir):
    return tables.class_balance(docs_labels(spark, sf_dir), "quality")


@query(_balance_sql("embeddings", "label"))
def class_balance_embeddings(spark, sf_dir):
    return tables.class_balance(table(spark, sf_dir, "embeddings"), "label")


# ---------------------------------------------------------------- texts


def _text_sql(source: str, columns: list[str]) -> str:
    return _union([
        f"""SELECT '{c}' AS column_name, round(avg(length({c})), 2) AS mean_length, round(avg(len(string_split({c}, ' '))), 1) AS avg_words, max(len(string_split({c}, ' '))) AS max_words,
count(*) FILTER (regexp_matches({c}, '^\\s*$')) AS blank_count, round(100.0 * count(*) FILTER (regexp_matches({c}, '^\\s*$')) / count({c}), 2)::DOUBLE AS blank_pct FROM {source}"""
        for c in columns
    ])


@query(_text_sql("documents", ["text"]))
def text_words_documents(spark, sf_dir):
    return texts.text_analysis(table(spark, sf_dir, "documents"), ["text"])


@query(_text_sql("(SELECT CASE WHEN doc_id % 10 = 0 THEN '  ' || chr(9) WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS gaps FROM documents)", ["gaps"]))
def text_empty_documents(spark, sf_dir):
    i = F.col("doc_id")
    return texts.text_analysis(table(spark, sf_dir, "documents").select(F.when(i % 10 == 0, F.lit("  \t")).when(i % 7 != 0, F.col("text")).alias("gaps")), ["gaps"])


# ---------------------------------------------------------------- image hashes, samples, unions, health


@query("""SELECT a.source AS split_a, b.source AS split_b, count(DISTINCT sha256(a.text)) AS shared FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.source < b.source GROUP BY ALL""")
def cross_split_duplicates(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents").select(F.col("source").alias("split"), F.sha2("text", 256).alias("hash")))


@query("""WITH h AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
p AS (SELECT a.id AS id_a, b.id AS id_b, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END))::INT AS distance FROM h a JOIN h b ON a.id < b.id)
SELECT id_a, id_b, distance FROM p WHERE distance BETWEEN 1 AND 17""")
def near_duplicate_hamming(spark, sf_dir):
    signs = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return hamming_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), signs.alias("hash")), 17)


@query("""SELECT sampled, smallest, beyond FROM (SELECT least(count(*), 100) AS sampled, true AS smallest, count(*) - least(count(*), 100) AS beyond FROM part)""")
def sample_size_part(spark, sf_dir):
    """The sample's largest hash lies below the hashes of all rows left out."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = F.xxhash64(F.lit(SEED), F.col("p_partkey").cast("string"), "p_name")
    drawn = exact_sample(part, 100)
    top = drawn.agg(F.count("*").alias("sampled"), F.max(order).alias("top"))
    rest = part.join(drawn, ["p_partkey", "p_name"], "left_anti").agg(F.count("*").alias("beyond"), F.min(order).alias("next"))
    return top.join(F.broadcast(rest)).select("sampled", (F.coalesce(F.col("next"), F.col("top")) >= F.col("top")).alias("smallest"), "beyond")


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS r_name, NULL::INTEGER AS r_regionkey FROM nation UNION ALL SELECT NULL, NULL, NULL, r_name, r_regionkey FROM region")
def union_diagonal(spark, sf_dir):
    return diagonal_union([table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")])


@query("""WITH m AS (SELECT (SELECT round(100.0 * (count(*) * 2 - count(o_totalprice) - count(CASE WHEN o_custkey % 7 <> 0 THEN 1 END)) / (count(*) * 2), 2) FROM orders) AS missing_pct,
  (SELECT round(100.0 * (count(*) - count(DISTINCT o_custkey)) / count(*), 2) FROM orders) AS duplicate_pct,
  (SELECT max(n) / min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS imbalance_ratio),
p AS (SELECT CASE WHEN missing_pct > 50 THEN 10 WHEN missing_pct > 20 THEN 40 WHEN missing_pct > 5 THEN 70 WHEN missing_pct > 1 THEN 85 WHEN missing_pct > 0 THEN 95 ELSE 100 END::DOUBLE AS completeness,
  CASE WHEN duplicate_pct > 20 THEN 30 WHEN duplicate_pct > 10 THEN 50 WHEN duplicate_pct > 5 THEN 70 WHEN duplicate_pct > 1 THEN 85 WHEN duplicate_pct > 0 THEN 95 ELSE 100 END::DOUBLE AS uniqueness,
  CASE WHEN imbalance_ratio > 20 THEN 20 WHEN imbalance_ratio > 10 THEN 40 WHEN imbalance_ratio > 5 THEN 60 WHEN imbalance_ratio > 3 THEN 75 WHEN imbalance_ratio > 1.5 THEN 90 ELSE 100 END::DOUBLE AS balance,
  100::DOUBLE AS quality FROM m),
s AS (SELECT *, round(0.25 * completeness + 0.2 * uniqueness + 0.2 * balance + 0.2 * quality + 15, 1) AS score FROM p)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    gaps = orders.select("o_totalprice", F.when(F.col("o_custkey") % 7 != 0, F.lit(1)).alias("gap"))
    missing = tables.missing_values(gaps).agg(F.round(100 * F.sum("missing_count") / F.sum("total_rows"), 2).alias("missing_pct"))
    repeated = tables.row_duplicates(orders.select("o_custkey")).select("duplicate_pct")
    sizes = orders.groupBy("o_orderstatus").count().agg((F.max("count") / F.min("count")).alias("imbalance_ratio"))
    metrics = missing.join(F.broadcast(repeated)).join(F.broadcast(sizes)).withColumn("outlier_share", F.lit(0.0))
    return health_table(metrics)


# Plans of the image analyzers, over a table of features made from documents.


def _image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 23 * F.col("n_chars")).alias("size_bytes"),
        (F.col("doc_id") * 37 % 9001).cast("int").alias("width"), (F.col("doc_id") * 53 % 4999).cast("int").alias("height"), F.col("lang").alias("mode"),
        F.when(F.col("doc_id") % 5 == 0, "WEBP").when(F.col("doc_id") % 11 != 0, "PNG").alias("format"), (F.col("doc_id") % 7 != 0).alias("decoded"), F.sha2("text", 256).alias("sha256"),
        F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test").alias("split"), (F.col("doc_id") % 101 / 100).alias("brightness"), (F.col("doc_id") % 37 / 37).alias("contrast"), (F.col("doc_id") % 200).cast("double").alias("blur"),
    )


_FEATURES = """f AS (SELECT 'img/' || doc_id AS path, doc_id % 23 * n_chars AS size_bytes, (doc_id * 37 % 9001)::INTEGER AS width, (doc_id * 53 % 4999)::INTEGER AS height, lang AS mode,
  CASE WHEN doc_id % 5 = 0 THEN 'WEBP' WHEN doc_id % 11 <> 0 THEN 'PNG' END AS format, doc_id % 7 <> 0 AS decoded, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS split,
  (doc_id % 101)::DOUBLE / 100 AS brightness, (doc_id % 37)::DOUBLE / 37 AS contrast, (doc_id % 200)::DOUBLE AS blur FROM documents)"""


@query(f"""WITH {_FEATURES} SELECT count(*) AS images_analyzed, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, round(avg(width), 1) AS mean_width,
round(avg(height), 1) AS mean_height, round(avg(size_bytes), 1) AS mean_size_bytes, count(*) FILTER (width < 32 OR height < 32) AS small, count(*) FILTER (width > 8000 OR height > 8000) AS large,
count(DISTINCT (width, height)) AS unique_resolutions, count(DISTINCT mode) AS modes FROM f WHERE width > 0 AND height > 0""")
def image_resolution_features(spark, sf_dir):
    return resolution_stats(_image_features(spark, sf_dir))


@query(f"""WITH {_FEATURES} SELECT count(*) AS images_analyzed, count(*) FILTER (brightness < 0.15) AS dark, count(*) FILTER (brightness > 0.85) AS bright, count(*) FILTER (blur < 50) AS blurry,
round(avg(brightness), 4) AS brightness_mean, round(stddev_pop(brightness), 4) AS brightness_std, round(avg(contrast), 4) AS contrast_mean, round(stddev_pop(contrast), 4) AS contrast_std,
round(avg(blur), 4) AS blur_mean, round(stddev_pop(blur), 4) AS blur_std FROM f WHERE decoded""")
def image_quality_features(spark, sf_dir):
    return quality_stats(_image_features(spark, sf_dir))


@query(f"""WITH {_FEATURES} SELECT path, CASE WHEN size_bytes = 0 THEN 'zero_size' WHEN format IS NOT NULL AND width > 0 THEN 'truncated' ELSE 'corrupted' END AS issue FROM f
WHERE size_bytes = 0 OR (coalesce(format, '') <> 'WEBP' AND NOT decoded)""")
def image_damage_features(spark, sf_dir):
    rows = _image_features(spark, sf_dir)
    return damage(rows, rows)


@query(f"WITH {_FEATURES} SELECT sha256, count(*) AS n FROM f GROUP BY sha256 HAVING count(*) > 1")
def image_exact_groups(spark, sf_dir):
    return exact_groups(_image_features(spark, sf_dir))


@query(f"""WITH {_FEATURES}, r AS (SELECT width::DOUBLE / height AS ratio FROM f WHERE width > 0 AND height > 0)
SELECT CASE WHEN abs(ratio - 1.0) < 0.05 THEN '1:1' WHEN abs(ratio - 4.0 / 3) < 0.1 THEN '4:3' WHEN abs(ratio - 0.75) < 0.1 THEN '3:4' WHEN abs(ratio - 16.0 / 9) < 0.1 THEN '16:9'
WHEN abs(ratio - 9.0 / 16) < 0.1 THEN '9:16' WHEN abs(ratio - 1.5) < 0.1 THEN '3:2' WHEN abs(ratio - 2.0 / 3) < 0.1 THEN '2:3' ELSE 'other' END AS aspect, count(*) AS n FROM r GROUP BY 1""")
def image_aspect_ratios(spark, sf_dir):
    named = _image_features(spark, sf_dir).where("width > 0 AND height > 0").select(aspect_column(F.col("width"), F.col("height")).alias("aspect"))
    return named.groupBy(F.when(F.col("aspect").contains(":"), F.col("aspect")).otherwise("other").alias("aspect")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FEATURES}, m AS (SELECT
  (SELECT round(100.0 * (count(*) * 2 - count(n_chars) - count(CASE WHEN doc_id % 7 <> 0 THEN 1 END)) / (count(*) * 2), 2) FROM documents) AS missing_pct,
  (SELECT round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 2) FROM documents) AS duplicate_pct,
  (SELECT max(n) / min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS imbalance_ratio,
  (SELECT avg(CASE WHEN outlier_count > 0 THEN 1.0 ELSE 0.0 END) FROM ({_outlier_sql("SELECT * FROM documents", ["n_chars", "doc_id"])})) AS outlier_share,
  (SELECT 100.0 * (count(sha256) - count(DISTINCT sha256)) / count(*) FROM f) AS image_duplicate_pct,
  (SELECT 100.0 * count(*) FILTER (size_bytes = 0 OR (coalesce(format, '') <> 'WEBP' AND NOT decoded)) / count(*) FROM f) AS corrupt_pct,
  (SELECT count(*) FROM (SELECT sha256 FROM f GROUP BY sha256 HAVING count(DISTINCT split) > 1)) AS leaked),
p AS (SELECT CASE WHEN missing_pct > 50 THEN 10 WHEN missing_pct > 20 THEN 40 WHEN missing_pct > 5 THEN 70 WHEN missing_pct > 1 THEN 85 WHEN missing_pct > 0 THEN 95 ELSE 100 END::DOUBLE AS completeness,
  least(CASE WHEN duplicate_pct > 20 THEN 30 WHEN duplicate_pct > 10 THEN 50 WHEN duplicate_pct > 5 THEN 70 WHEN duplicate_pct > 1 THEN 85 WHEN duplicate_pct > 0 THEN 95 ELSE 100 END,
    CASE WHEN image_duplicate_pct > 10 THEN 40 WHEN image_duplicate_pct > 5 THEN 60 WHEN image_duplicate_pct > 1 THEN 80 WHEN image_duplicate_pct > 0 THEN 90 ELSE 100 END)::DOUBLE AS uniqueness,
  CASE WHEN imbalance_ratio > 20 THEN 20 WHEN imbalance_ratio > 10 THEN 40 WHEN imbalance_ratio > 5 THEN 60 WHEN imbalance_ratio > 3 THEN 75 WHEN imbalance_ratio > 1.5 THEN 90 ELSE 100 END::DOUBLE AS balance,
  least(CASE WHEN outlier_share > 0.5 THEN 60 WHEN outlier_share > 0.3 THEN 75 ELSE 100 END, CASE WHEN corrupt_pct > 5 THEN 30 WHEN corrupt_pct > 2 THEN 55 WHEN corrupt_pct > 0.5 THEN 75 WHEN corrupt_pct > 0 THEN 90 ELSE 100 END)::DOUBLE AS quality,
  CASE WHEN leaked > 0 THEN 40 ELSE 100 END::DOUBLE AS consistency FROM m),
s AS (SELECT *, round(0.25 * completeness + 0.2 * uniqueness + 0.2 * balance + 0.2 * quality + 0.15 * consistency, 1) AS score FROM p)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score_every_part(spark, sf_dir):
    docs, images = table(spark, sf_dir, "documents"), _image_features(spark, sf_dir)
    gaps = docs.select("n_chars", F.when(F.col("doc_id") % 7 != 0, F.lit(1)).alias("gap"))
    parts = [
        tables.missing_values(gaps).agg(F.round(100 * F.sum("missing_count") / F.sum("total_rows"), 2).alias("missing_pct")),
        tables.row_duplicates(docs.select("text")).select("duplicate_pct"), docs.groupBy("lang").count().agg((F.max("count") / F.min("count")).alias("imbalance_ratio")),
        relations.outliers(docs, ["n_chars", "doc_id"]).agg(F.avg(F.when(F.col("outlier_count") > 0, 1.0).otherwise(0.0)).alias("outlier_share")),
        exact_groups(images).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")), damage(images, images).agg(F.count("*").alias("issues")), images.agg(F.count("*").alias("images")),
        leaks(images.select("split", F.col("sha256").alias("hash"))).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("leaked")),
    ]
    row = parts[0]
    for part in parts[1:]:  # each of one row
        row = row.join(F.broadcast(part))
    return health_table(row.withColumn("image_duplicate_pct", 100 * F.col("extra") / F.col("images")).withColumn("corrupt_pct", 100 * F.col("issues") / F.col("images")))


@query("""SELECT sampled, members, different FROM (SELECT least(count(*), 100) AS sampled, least(count(*), 100) AS members, least(count(*), 100) AS different FROM part)""")
def sample_members_part(spark, sf_dir):
    """Sampled rows are rows of the table, each once, whatever the partitions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    drawn, again = exact_sample(part, 100), exact_sample(part.repartition(7), 100)
    counts = [drawn.agg(F.count("*").alias("sampled")), drawn.join(part, ["p_partkey", "p_name"], "left_semi").join(again, ["p_partkey", "p_name"], "left_semi").agg(F.count("*").alias("members")), drawn.agg(F.count_distinct("p_partkey").alias("different"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


# Sources: a table is written by many tasks, then scanned, detected and loaded as a user's folder is.


def _written(spark: SparkSession, df: DataFrame, kind: str, **options) -> str:
    """Folder that holds ``df`` in a file a task, in the shared folder."""
    folder = fresh_path(spark, "source")
    df.write.format(kind).options(**options).save(folder)
    return folder


def _loaded(spark: SparkSession, path: str) -> tuple[Detection, Dataset]:
    scan = scan_directory(path)
    found = detect_format(scan).selected
    return found, engine.loaders[found.loader_id](spark, scan, None)


_NOTED = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a "b", c' || chr(10) || s_name WHEN s_suppkey % 3 = 1 THEN s_name END AS note, s_nationkey, s_acctbal FROM supplier"""


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with notes that hold quotes, commas and line breaks, or are null."""
    note = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('a "b", c\n'), "s_name")).when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", note.alias("note"), "s_nationkey", "s_acctbal")


@query(_NOTED)
def load_csv_supplier(spark, sf_dir):
    data = _loaded(spark, _written(spark, _noted(spark, sf_dir), "csv", header="true", escape='"'))[1].data
    return data.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


_LATE = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey < k THEN l_shipdate::DATE::TIMESTAMP ELSE l_shipdate::DATE::TIMESTAMP + INTERVAL (l_linenumber) SECOND END AS late_time,
  CASE WHEN l_orderkey < k THEN 'true' WHEN l_linenumber = 1 THEN 'unknown' ELSE 'false' END AS late_flag,
  (CASE WHEN l_orderkey < k THEN l_quantity ELSE l_quantity + 0.25 END)::DOUBLE AS late_real,
  CASE WHEN l_orderkey < k THEN l_linenumber ELSE l_orderkey * 10000000000 END AS late_long,
  CASE WHEN l_orderkey < k THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'about ' || strftime(l_shipdate, '%Y') END AS late_text
FROM lineitem, (SELECT max(l_orderkey) - 10 AS k FROM lineitem)"""


@query(_LATE)
def load_csv_late_cells(spark, sf_dir):
    """Columns whose last cells are no whole numbers, dates or booleans any more; values and types must hold them all."""
    lineitem = table(spark, sf_dir, "lineitem")
    last = lineitem.agg((F.max("l_orderkey") - 10).alias("k"))
    early, day = F.col("l_orderkey") < F.col("k"), F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = lineitem.join(F.broadcast(last)).orderBy("l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", F.when(early, day).otherwise(F.concat(day, F.lit(" 00:00:0"), F.col("l_linenumber").cast("string"))).alias("late_time"),
        F.when(early, "true").when(F.col("l_linenumber") == 1, "unknown").otherwise("false").alias("late_flag"),
        F.when(early, F.col("l_quantity").cast("int").cast("string")).otherwise((F.col("l_quantity") + 0.25).cast("string")).alias("late_real"),
        F.when(early, F.col("l_linenumber").cast("long")).otherwise(F.col("l_orderkey") * 10_000_000_000).alias("late_long"),
        F.when(early, day).otherwise(F.concat(F.lit("about "), F.date_format("l_shipdate", "yyyy"))).alias("late_text"),
    )
    data = _loaded(spark, _written(spark, rows, "csv", header="true", escape='"'))[1].data
    return data.withColumn("l_orderkey", F.col("l_orderkey").cast("long")).withColumn("l_linenumber", F.col("l_linenumber").cast(lineitem.schema["l_linenumber"].dataType))


@query("SELECT doc_id, text, lang FROM documents")
def load_csv_line_breaks(spark, sf_dir):
    """Texts with line breaks and quotes, written as they are and read again in byte ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    data = _loaded(spark, _written(spark, docs, "csv", **kept))[1].data
    return data.withColumn("doc_id", F.col("doc_id").cast("long"))


@query(_NOTED)
def load_json_supplier(spark, sf_dir):
    data = _loaded(spark, _written(spark, _noted(spark, sf_dir), "json"))[1].data
    return data.withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@query("SELECT * FROM orders")
def load_parquet_orders(spark, sf_dir):
    return _loaded(spark, f"{sf_dir}/orders.parquet")[1].data


_KINDS = {"csv": ("csv", 0.95, "csv"), "json": ("json", 0.5, "json"), "parquet": ("parquet", 0.95, "parquet")}


@query(_union([f"SELECT '{kind}' AS dataset_type, {confidence}::DOUBLE AS confidence, '{loader}' AS loader_id, count(*) AS num_samples FROM supplier" for kind, confidence, loader in _KINDS.values()]))
def detected_formats_supplier(spark, sf_dir):
    rows = []
    for kind in _KINDS:
        found, data = _loaded(spark, _written(spark, _noted(spark, sf_dir), kind, **({"header": "true", "escape": '"'} if kind == "csv" else {})))
        rows.append((found.dataset_type, found.confidence, found.loader_id, data.num_samples))
    return spark.createDataFrame(rows, "dataset_type string, confidence double, loader_id string, num_samples long")


@query("""SELECT 's_suppkey' AS field, 'integer' AS dtype, false AS nullable UNION ALL SELECT 'note', 'text', count(*) > count(CASE WHEN s_suppkey % 3 < 2 THEN 1 END) FROM supplier
UNION ALL SELECT 's_nationkey', 'integer', false UNION ALL SELECT 's_acctbal', 'float', false""")
def loaded_fields_supplier(spark, sf_dir):
    data = _loaded(spark, _written(spark, _noted(spark, sf_dir), "csv", header="true", escape='"'))[1]
    return spark.createDataFrame([(f.name, f.dtype.value, f.nullable) for f in data.fields], "field string, dtype string, nullable boolean")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def examples_orders(spark, sf_dir):
    """The rows that a report shows of a loaded table, in order of its key, with all their columns."""
    return engine.example_rows(_loaded(spark, f"{sf_dir}/orders.parquet")[1], ["o_orderkey"])


@query("SELECT * FROM nation LIMIT 20")
def examples_nation(spark, sf_dir):
    """The first rows of the loaded table, as a report shows them."""
    return spark.createDataFrame(engine.examples(_loaded(spark, f"{sf_dir}/nation.parquet")[1]), "n_nationkey int, n_name string, n_regionkey int")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
