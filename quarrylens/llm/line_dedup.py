"""Operator 7: lines found in many documents, by levelled sorted runs of line hashes.

Documents come in batches.  A batch's line hashes lose those already known as frequent and
are merge-joined with all runs: lines that a run holds become increments of its counts,
and only the anti-joined rest is added as new lines; both make a sorted run of level 0.
When a level holds ``fanout`` runs they are compacted into one run of the next level.
Adding and compacting move lines that reach ``min_docs`` out of the run to the frequent
lines.  Every run holds lines of its own, so a line is new once.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased;
its hash has 128 bits.  Defined cases: a null or empty text is one empty line; keys of
fewer than ``min_chars`` code points are never dropped; a line counts once a document;
each row is a document, repeated rows too; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.store import exists, fresh_path, remove, save

BROADCAST_LINES = 500_000  # frequent lines, 16 bytes each, that may be broadcast
ADDED = ("ld_n_lines", "ld_n_dropped", "ld_kept_sha256")  # columns added; ones of these names in the input are replaced
RUN_SCHEMA = "h1 long, h2 long, n long"
INCREMENTS, OWN, MOVED = 0, 1, 2  # states of a run's rows, each in a folder of its own
BATCH_DOCS, FEWEST_BATCHES, MOST_BATCHES, FANOUT = 50_000_000, 6, 32, 2


def line_keys(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z only; bytes.strip() strips [\\x20\\x09-\\x0D]."""
    return [line.strip() for line in (text or b"").lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Sorted runs of (h1, h2, n) in the shared folder: lines of a run's own, increments of other runs' lines, and frequent lines apart."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.frequent: list[str] = []
        self.deepest = 0

    def _read(self, paths: list[str], *states: int) -> DataFrame:
        folders = [f"{p}/state={s}" for p in paths for s in states if exists(self.spark, f"{p}/state={s}")]
        return self.spark.read.schema(RUN_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], RUN_SCHEMA)

    def _write(self, counted: DataFrame, level: int) -> None:
        """counted (h1, h2, n, own) becomes a run of the level, its frequent lines go to the frequent ones."""
        path = fresh_path(self.spark, "line-run")
        state = F.when(F.col("n") >= self.min_docs, MOVED).when(F.col("own"), OWN).otherwise(INCREMENTS)
        counted.select("h1", "h2", "n", state.alias("state")).sortWithinPartitions("state", "h1", "h2").write.option("compression", "zstd").partitionBy("state").parquet(path)
        self.frequent.append(path)
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(path)
        self.deepest = max(self.deepest, level)

    def frequent_lines(self) -> DataFrame:
        return self._read(self.frequent, MOVED).select("h1", "h2")

    def add(self, batch: DataFrame) -> None:
        """batch (h1, h2, n): hashes and the number of the batch's documents that hold them."""
        held = self._read([p for runs in self.levels for p in runs], OWN).select("h1", "h2", F.lit(True).alias("held"))
        counted = batch.groupBy("h1", "h2").agg(F.sum("n").alias("n")).join(self.frequent_lines(), ["h1", "h2"], "left_anti")
        self._write(counted.join(held, ["h1", "h2"], "left").withColumn("own", F.col("held").isNull()), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        runs = self.levels[level]
        self.levels[level] = []
        both = self._read(runs, OWN).withColumn("own", F.lit(True)).unionByName(self._read(runs, INCREMENTS).withColumn("own", F.lit(False)))
        self._write(both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own")), level + 1)
        for path in runs:
            for state in (OWN, INCREMENTS):
                remove(self.spark, f"{path}/state={state}")

    def finish(self) -> DataFrame:
        """(h1, h2) of every line in at least min_docs documents."""
        runs = [p for runs in self.levels for p in runs]
        rest = self._read(runs, OWN, INCREMENTS).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs)
        return rest.select("h1", "h2").unionByName(self.frequent_lines()).distinct()

    def clear(self) -> None:
        for path in self.frequent:
            remove(self.spark, path)


def batch_hashes(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(batch, h1, h2, n), summed within each Arrow batch; the batch is a hash of the text."""

    def run(arrow):
        for chunk in arrow:
            texts = chunk.column(0).to_pylist()
            digests = [b"".join({key_hash(k) for k in line_keys(t) if long_enough(k, min_chars)}) for t in texts]
            groups = np.array([xxhash.xxh32_intdigest(t or b"") % batches for t in texts])
            for g in range(batches):
                pairs = np.frombuffer(b"".join(d for d, x in zip(digests, groups) if x == g), np.int64).reshape(-1, 2)
                table = pa.table({"h1": pairs[:, 0], "h2": pairs[:, 1]}).group_by(["h1", "h2"]).aggregate([([], "count_all")])
                n = table.num_rows
                for b in pa.table({"batch": pa.array(np.full(n, g, np.int32)), "h1": table["h1"], "h2": table["h2"], "n": pc.cast(table["count_all"], pa.int64())}).to_batches():
                    yield b

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "batch int, h1 long, h2 long, n long")


def batches_for(rows: int) -> int:
    """Batches of about BATCH_DOCS documents, FEWEST to MOST of them: every batch reads all runs."""
    return min(MOST_BATCHES, max(FEWEST_BATCHES, -(-rows // BATCH_DOCS)))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2) of the keys found in at least ``min_docs`` documents, as a saved table."""
    spark = docs.sparkSession
    batches = batches or batches_for(docs.count())
    staged = fresh_path(spark, "line-batches")
    batch_hashes(docs, batches, min_chars).write.option("compression", "zstd").partitionBy("batch").parquet(staged)
    runs = LineRuns(spark, min_docs, fanout)
    staged_rows = spark.read.schema(RUN_SCHEMA + ", batch int").parquet(staged)
    for b in range(batches):
        runs.add(staged_rows.where(F.col("batch") == b).select("h1", "h2", "n"))
    remove(spark, staged)
    found = save(runs.finish(), "frequent-lines")
    runs.clear()
    return found


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None) -> DataFrame:
    """docs with text replaced by its kept lines, and the columns ADDED."""
    docs = docs.drop(*ADDED)
    frequent = frequent_lines(docs, min_docs, min_chars, batches)
    if frequent.count() <= BROADCAST_LINES:
        rows = frequent.toPandas().to_numpy(np.int64).reshape(-1, 2)
        known = docs.sparkSession.sparkContext.broadcast(rows)
        return _filtered(docs, lambda: {r.tobytes() for r in known.value}, min_chars)
    held = _document_lines(docs, min_chars).join(frequent, ["h1", "h2"], "left_semi")
    own = held.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("hot"))
    wrapped = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("doc")).join(own, "doc", "left")
    hot = free_name(docs, "hot")
    return _filtered(wrapped.select("row.*", F.col("hot").alias(hot)), None, min_chars, hot)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, h1, h2): each text's line hashes, the text named by its hash."""

    def run(arrow):
        for chunk in arrow:
            names, found = chunk.column(0).to_pylist(), []
            counts = []
            for t in chunk.column(1).to_pylist():
                own = {key_hash(k) for k in line_keys(t) if long_enough(k, min_chars)}
                counts.append(len(own))
                found.extend(own)
            pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "h1", "h2"])

    narrow = docs.select(F.xxhash64("text").alias("doc"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc long, h1 long, h2 long")


def _filtered(docs: DataFrame, load, min_chars: int, hot_name: str | None = None) -> DataFrame:
    out = [f for f in docs.schema.fields if f.name != hot_name]
    names = [f.name for f in out]
    at = docs.columns.index("text")
    hot_at = docs.columns.index(hot_name) if hot_name else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", ld_n_lines long, ld_n_dropped long, ld_kept_sha256 string"

    def run(arrow):
        known = load() if load else None
        for chunk in arrow:
            texts = pc.cast(chunk.column(at), pa.binary()).to_pylist()
            hots = chunk.column(hot_at).to_pylist() if hot_at is not None else None
            kept, lines, dropped, digests = [], [], [], []
            for k, t in enumerate(texts):
                hot = known if hots is None else {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in hots[k] or ()}
                raw = (t or b"").split(b"\n")
                keys = line_keys(t)
                stay = [r for r, key in zip(raw, keys) if key_hash(key) not in hot or not long_enough(key, min_chars)]
                body = b"\n".join(stay)
                lines.append(len(raw))
                dropped.append(len(raw) - len(stay))
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(None if t is None else body)
            columns = [chunk.column(docs_at) for docs_at in places]
            columns[names.index("text")] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)], names + ["ld_n_lines", "ld_n_dropped", "ld_kept_sha256"])

    places = [docs.columns.index(n) for n in names]
    return docs.mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
frequent AS (SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT row_no) >= 10),
marked AS (SELECT k.*, k.line_key IN (SELECT line_key FROM frequent) AS gone FROM keyed k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no
"""
