"""Operator 11: importance resampling toward a target distribution.

Features are all runs of one to three consecutive words; a feature's bucket is its CRC-32
modulo ``buckets``.  One pass counts the buckets of the corpus and of the target texts, and
gives each bucket a gain, an array of fixed size.  A second pass sums the gains of every
document.  Weights get Gumbel noise from a hash of the document's id, so that the highest
scores are a draw without replacement.

The drawn share is found by radix selection: counts of 16-bit digits of the composite key
(score, doc_id, row), most significant first, narrow the key range that holds the k-th row,
until its bound is exact.  Only rows up to that bound are range-sorted and ranked; ranks
are the place in a sorted partition plus the rows of the partitions before it.

Defined cases: a null, empty or wordless text has no features, weight 0 and takes no part
in the draw (as any document with fewer than ``min_words`` words); a null doc_id hashes as
an empty one and stands behind all others of its score; rows with equal score and doc_id
(repeated rows) are drawn in the order of their rows; an empty target gives gains that only
know the corpus; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.store import save, shuffle_width
from quarrylens.llm.words import word_blocks

BUCKETS = 10_000
LONGEST = 3  # words of a feature
DIGIT_BITS = 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
KEYS = ("by_score", "by_id", "row")  # ascending in the order of the draw


def feature_buckets(text: bytes | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of each block of a text.

    The checksum of a run goes on from that of the run without its last word.
    """
    tail: list[bytes] = []
    for own in word_blocks(text):
        words = tail + own
        spaced = [b" " + w for w in words]
        found, sums = [], list(map(crc32, words))
        for length in range(1, LONGEST + 1):
            found.append(sums[max(len(tail) + 1 - length, 0) :])
            if length < LONGEST:
                sums = list(map(crc32, spaced[length:], sums))
        tail = words[-(LONGEST - 1) :]
        yield len(own), np.concatenate([np.array(f, np.int64) for f in found]) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; a task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the logarithm of how much likelier the target holds it, with one added to each count, in thousandths rounded down."""
    n, of_corpus, of_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = [(float(t + 1) * of_corpus) / (float(s + 1) * of_target) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio), np.int64, n)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        value = held.value
        for batch in batches:
            rows = [[], [], []]
            for text in batch.column(1):
                n_words = n_features = weight = 0
                for words, found in feature_buckets(text.as_py(), len(value)):
                    n_words, n_features, weight = n_words + words, n_features + len(found), weight + int(value[found].sum())
                for column, x in zip(rows, (n_words, n_features, weight)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(uniform)))


@dataclass
class Bound:
    """The largest key that is taken: values of KEYS in order."""

    at: list[int]

    def holds(self) -> Column:
        """Whether a row's key is not above the bound."""
        test = F.lit(True)
        for name, value in reversed(list(zip(KEYS, self.at))):
            test = (F.col(name) < F.lit(value).cast("long")) | ((F.col(name) == F.lit(value).cast("long")) & test)
        return test


def kth_key(rows: DataFrame, k: int) -> Bound:
    """The exact bound of the k smallest keys among rows with columns KEYS, of 1 <= k <= rows of them.

    Every step counts the values of one digit among the rows that are still open, 65,536
    groups at most, and goes on in the group that holds the k-th; digits in which all open
    rows agree are left out.  It ends early where a group ends with the k-th row.
    """
    open_rows, at = rows, []
    for place, name in enumerate(KEYS):
        low, high = open_rows.agg(F.min(name), F.max(name)).first()
        bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
        unsigned = F.col(name).bitwiseXOR(F.lit(LOWEST).cast("long"))
        prefix = (low - LOWEST) >> bits << bits
        while bits:
            shift = max(bits - DIGIT_BITS, 0)
            mask = (1 << (bits - shift)) - 1
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(mask).cast("long"))
            counted = sorted((r["digit"], r["n"]) for r in open_rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for value, n in counted:
                if k <= n:
                    break
                k -= n
            prefix |= value << shift
            bits = shift
            if k == n:  # all of this group, and nothing behind it
                return Bound([*at, (prefix | ((1 << shift) - 1)) + LOWEST] + [HIGHEST] * (len(KEYS) - place - 1))
            first, last = prefix + LOWEST, (prefix | ((1 << shift) - 1)) + LOWEST
            open_rows = open_rows.where(F.col(name).between(F.lit(first).cast("long"), F.lit(last).cast("long")))
        at.append(prefix + LOWEST)
    return Bound(at)


def ranked(chosen: DataFrame) -> DataFrame:
    """chosen with rank, from 1 in the order of KEYS: sorted by ranges, counted within each and on from those before."""
    spark = chosen.sparkSession
    place = F.monotonically_increasing_id()  # partition << 33, plus the place in it
    sorted_rows = save(chosen.repartitionByRange(shuffle_width(spark), *KEYS).sortWithinPartitions(*KEYS).withColumn("place", place), "importance-order")
    part = F.shiftright("place", 33).cast("int")
    sizes = sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.join(start, part == F.col("part")).withColumn("rank", F.col("start") + within + 1).drop("place", "part", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``percent`` of the documents with enough words are drawn and have a rank."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("row", F.monotonically_increasing_id()).withColumn("by_score", F.bitwise_not("score")).withColumn("by_id", F.coalesce("doc_id", F.lit(HIGHEST)))
    rows = save(scored, "importance-scores")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    enough = F.col("n_words") >= min_words
    k = percent * rows.where(enough).count() // 100
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    taken = enough & kth_key(rows.where(enough), k).holds()
    drawn = ranked(rows.where(taken))
    return drawn.select(*columns, "rank").unionByName(rows.where(~taken).select(*columns, F.lit(None).cast("long").alias("rank")))


#: CRC-32 by bytes: ``t`` is its table, made by rule; a run's state goes on over the bytes of each word and of the space before it.
ORACLE_SQL = r"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, [s::UBIGINT FOR s IN range(8)]),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM range(256) r(n)),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS doc, doc_id::BIGINT AS doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
lists AS (
  SELECT kind, doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
places AS (
  SELECT kind, doc, unnest(words) AS w1, unnest(words[2:] || [NULL]) AS w2, unnest(words[3:] || [NULL, NULL]) AS w3 FROM lists),
features AS (
  SELECT kind, doc, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3]) AS feature FROM places),
counted AS (
  SELECT kind, doc, feature, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY ALL),
hashed AS (
  SELECT feature, xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, [('0x' || hex(encode(feature))[2 * i + 1 : 2 * i + 2])::UBIGINT FOR i IN range(strlen(feature))]),
           lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255)::BIGINT + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), t),
held AS (
  SELECT c.kind, c.doc, h.bucket, sum(c.n)::BIGINT AS n FROM counted c JOIN hashed h USING (feature) GROUP BY ALL),
buckets AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN held ON held.bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets),
weights AS (
  SELECT h.doc, sum(h.n)::BIGINT AS n_features, sum(h.n * g.gain)::BIGINT AS weight FROM held h JOIN gains g USING (bucket) WHERE h.kind = 0 GROUP BY h.doc),
scored AS (
  SELECT l.doc, l.doc_id, len(l.words) AS n_words, coalesce(w.n_features, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
         coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(l.doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM lists l LEFT JOIN weights w ON l.doc = w.doc WHERE l.kind = 0),
ranks AS (
  SELECT doc, row_number() OVER (ORDER BY score DESC, doc_id, doc) AS rank FROM scored WHERE n_words >= 20),
kept AS (
  SELECT * FROM ranks WHERE rank <= floor(5 * (SELECT count(*) FROM ranks) / 100))
SELECT s.doc_id, s.n_features, s.weight, s.score, k.rank::BIGINT AS rank FROM scored s LEFT JOIN kept k ON s.doc = k.doc
"""
