"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet to the folder named in ``spark.checkpoint.dir``.
A lost executor then costs a re-read, never a recomputation of what came before.  Tables
that results are still read from stay until the application ends; ``clear`` removes all of
an application's tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DIR = "file:///tmp/checkpoints/quarrylens"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, with its scheme; a default of our own only in local mode."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = DEFAULT_DIR
    files, place = _file_system(spark, folder)
    return files.makeQualified(place).toString().rstrip("/")


_scratch: ContextVar[str] = ContextVar("scratch", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved in this context are deleted at its end, but for lasting ones."""
    name = f"scratch-{uuid.uuid4().hex}"
    before = _scratch.set(name)
    try:
        yield
    finally:
        _scratch.reset(before)
        remove(spark, f"{shared_dir(spark)}/quarrylens/{spark.sparkContext.applicationId}/{name}")


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    place = "" if lasting else _scratch.get()
    return f"{shared_dir(spark)}/quarrylens/{spark.sparkContext.applicationId}/{place and place + '/'}{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name, lasting)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it; what Spark itself uses."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`fresh_path`; it may be gone already."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results not yet written can no longer be read."""
    remove(spark, f"{shared_dir(spark)}/quarrylens/{spark.sparkContext.applicationId}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(rows: DataFrame, total: int, wanted: int, seed: int, key: str) -> DataFrame:
    """The ``wanted`` rows of ``total`` with the smallest hashes of ``key``; rows far above them are left out before anything is sorted."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    if total > 2 * wanted:
        steps = 1 << 30
        rows = rows.where(F.shiftrightunsigned(order, 34) < -(-2 * wanted * steps // total))
    return rows.orderBy(F.shiftrightunsigned(order, 34), order, key).limit(wanted)


BROADCAST_ROWS = 1_000_000  # rows of one long, 8 MB, that may be broadcast


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in ``ids`` (doc_id); null ids stay. Broadcasts ids only if they are few."""
    ids = save(ids, "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti")
