"""Operator 9: mix sources to target weights by weighted fair queueing. DataFrame functions only.

Every document has up to ``epochs`` places in its source's shuffled queue.  A place's
virtual finish time is the source's tokens up to and with it divided by the source's
weight.  All places are range-sorted by finish time and the sequence is cut where the
running total of tokens would pass the budget.  A source that runs out leaves its share
to the others, so targets follow as min(epochs x size, weight x T) with one T.

A queue is not held in one task: documents fall into buckets by the first hex digits of
their shuffle key, bucket totals are added up per source, and only a bucket's rows are
ordered in a window.  The global order is cut the same way, by range partitions.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a
source, ordered last; rows that agree in doc_id, source and text are taken alike; the
shuffle key is md5 of doc_id (null: empty) and text, so reruns agree; an empty table
gives an empty mix.  Weights repeat over the sources in code point order.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.store import save, shuffle_width

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): the narrow table that everything else works on."""
    text_key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words_of(F.col("text")).alias("size"),
        F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), text_key).alias("key"),
    )


def targets(rows: DataFrame, weights: list[float], share: float, epochs: int) -> DataFrame:
    """One row per source: source, rank, weight, source_size, target.

    Water-filling: with sources in the order of epochs x size / weight, T is what the
    budget leaves to the sources that are not used up, divided by their weights.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(epochs))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    by_fill = Window.orderBy("full_at", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("used")) / F.col("open"))
    )
    top = F.coalesce(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything), F.max("full_at").over(everything))
    return filled.withColumn("target", F.least("most", top * F.col("weight"))).select("source", "rank", "weight", "source_size", "target", F.col("budget").alias("budget"))


def prefix_sums(rows: DataFrame, part: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` by ``order`` with ties together, per ``part``; buckets ascend in that order.

    The window sees one bucket at a time; earlier buckets enter as a total from a small table.
    """
    totals = rows.groupBy(*part, bucket).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_{c}") for c in part], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    matched = rows[bucket] == offsets["_bucket"]
    for c in part:
        matched &= rows[c] == offsets[f"_{c}"]
    within = Window.partitionBy(*part, bucket).orderBy(*order)
    return rows.join(offsets, matched).withColumn(out, F.sum(value).over(within) + F.col("_before")).drop("_before", "_bucket", *[f"_{c}" for c in part])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, key, times): what the mix takes of every row."""
    rows = save(sized(docs), "mix-sizes")
    sources = save(targets(rows, list(weights), share, epochs), "mix-sources")
    count = rows.count()
    digits = max(1, ceil(log(max(count, 1) / BUCKET_ROWS + 1, 16)))
    keyed = rows.withColumn("bucket", F.substring("key", 1, digits)).join(F.broadcast(sources) if sources.count() <= 100_000 else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    queued = save(prefix_sums(keyed, ["rank"], "bucket", ["key"], "size", "ahead"), "mix-queues")

    places = queued.where("size > 0").select("rank", "key", "size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "ahead", "source_size", "weight", "budget")
    finish = (F.col("ahead") + F.col("epoch") * F.col("source_size")) / F.col("weight")
    order = ["finish", "rank", "key"]
    sorted_places = save(
        places.select(finish.alias("finish"), "rank", "key", "size", "budget")
        .repartitionByRange(shuffle_width(docs.sparkSession), *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("all", F.lit(0)),
        "mix-order",
    )
    kept = prefix_sums(sorted_places, ["all"], "part", order, "size", "total").where("total <= budget")
    last = kept.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    return queued.withColumn("times", times_taken(last, epochs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "key", "times")


def times_taken(last, epochs: int) -> Column:
    """How many of a document's places are not behind the last one taken."""
    if last is None:
        return F.lit(0)
    end = F.struct(F.lit(last["finish"]), F.lit(last["rank"]), F.lit(last["key"]))
    total = F.lit(0)
    for epoch in range(epochs):
        place = F.struct((F.col("ahead") + F.lit(epoch) * F.col("source_size")) / F.col("weight"), F.col("rank"), F.col("key"))
        total = total + F.when((F.col("size") > 0) & (place <= end), 1).otherwise(0)
    return total


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns as they were, whatever their names."""
    plan = mix(docs, **options).where("times > 0").select("key", "times").groupBy("key").agg(F.max("times").alias("times"))
    key = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = docs.select(F.struct("*").alias("row"), key.alias("key")).join(plan, "key")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most FROM sources),
filled AS (
  SELECT *, most / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT coalesce(max(CASE WHEN (budget - used) / open <= full_at THEN (budget - used) / open END), max(full_at)) AS top FROM filled),
queued AS (
  SELECT r.doc_id, r.source, r.size, r.key, f.rank, f.weight, f.source_size, f.budget, least(f.most, level.top * f.weight) AS target,
         sum(r.size) OVER (PARTITION BY f.rank ORDER BY r.key) AS ahead
  FROM rows r JOIN filled f ON r.source IS NOT DISTINCT FROM f.source CROSS JOIN level),
places AS (
  SELECT doc_id, key, rank, size, budget, epoch, (ahead + epoch * source_size) / weight AS finish
  FROM queued, (VALUES (0), (1)) e(epoch) WHERE size > 0),
kept AS (
  SELECT * FROM (SELECT *, sum(size) OVER (ORDER BY finish, rank, key) AS total FROM places) WHERE total <= budget),
times AS (SELECT rank, key, epoch FROM kept GROUP BY ALL),
counted AS (SELECT rank, key, count(*) AS times FROM times GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(c.times, 0))::BIGINT AS taken
FROM queued q LEFT JOIN counted c ON q.rank = c.rank AND q.key = c.key
"""
