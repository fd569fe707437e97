"""Loader for folders of images: split/class/image or class/image."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylens.model import AnalysisMode, Dataset, DatasetField, FieldType, LoaderError, Modality, ScanResult
from quarrylens.sources.scan import IMAGE_EXTENSIONS, files_table


def load_images(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    images = files_table(spark, scan).where(F.col("extension").isin(*IMAGE_EXTENSIONS))
    total = images.count()
    if not total:
        raise LoaderError("no images")
    counts = lambda c: {r[0]: r[1] for r in images.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).collect()}
    splits, classes = counts("split"), counts("label")
    capabilities = {"images"} | ({"labels"} if classes else set()) | ({"splits"} if splits else set())
    fields = [DatasetField("image", FieldType.IMAGE)] + ([DatasetField("label", FieldType.CATEGORICAL, sample_values=list(classes)[:5])] if classes else [])
    size = images.agg(F.sum("size_bytes")).first()[0]
    mode = AnalysisMode.SAMPLE if sample_size else AnalysisMode.FULL
    return Dataset(Modality.IMAGE, "image_folder", scan.root, total, size, fields, splits, classes or None, capabilities, mode, sample_size, None, images)
