"""The folder that driver and executors share, and tables written there to cut lineage.

It is the one in ``spark.checkpoint.dir``, whatever its scheme; only local mode has a default.
A lost executor then costs a re-read, never what came before.  ``clear`` removes an
application's tables once results are written.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "file:///tmp/checkpoints/quarrylens"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = DEFAULT_DIR
    files, place = file_system(spark, folder)
    return files.makeQualified(place).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrylens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return it as read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_methods(spark: SparkSession):
    """Within it, a stage whose generated code is too long for Java's compiler is evaluated by expression, not interpreted byte by byte: wide tables take a fraction of the time."""
    key, most = "spark.sql.codegen.hugeMethodLimit", 8000  # HotSpot compiles no method above this
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it; what Spark itself uses."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = file_system(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; it may be gone already."""
    files, place = file_system(spark, path)
    files.delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables of this application; results not yet written can no longer be read."""
    remove(spark, f"{shared_dir(spark)}/quarrylens/{spark.sparkContext.applicationId}")
