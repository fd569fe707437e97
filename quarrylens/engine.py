"""One analysis from a path, or from a table, to a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.exprs import ref
from quarrylens.health import health_score
from quarrylens.model import Dataset, DatasetReport, Detection, DetectionReport, Modality, ProgressUpdate, ScanResult
from quarrylens.operators.base import run_analyzers
from quarrylens.sources import tabular
from quarrylens.sources.images import load_images
from quarrylens.sources.sampling import AUTO_BYTES, SEED, auto_size
from quarrylens.sources.scan import detect_format, scan_directory

VERSION = "0.1"
EXAMPLE_ROWS, EXAMPLE_IMAGES = 20, 50

Loader = Callable[[SparkSession, ScanResult, int | None], Dataset]
loaders: dict[str, Loader] = {
    "csv": tabular.load_csv, "json": tabular.load_json, "parquet": tabular.load_parquet, "excel": tabular.load_excel, "image_folder": load_images, "smart_mixed": tabular.load_mixed,
}


def register_loader(loader_id: str, loader: Loader) -> None:
    loaders[loader_id] = loader


def analyze(spark: SparkSession, path: str, sample_size: int | None = None, force_type: str | None = None, progress: Callable[[ProgressUpdate], None] | None = None, auto_sample: bool = False) -> DatasetReport:
    """Scan, detect, load, analyze, score. ``force_type`` names a dataset type or a loader among the hypotheses.

    All rows are read unless ``sample_size`` is given; ``auto_sample`` takes a sample of data over AUTO_BYTES.
    """
    began = time.monotonic()
    tell = progress or (lambda update: None)
    tell(ProgressUpdate("scanning", "scan", 0.05))
    scan = scan_directory(path)
    report = DatasetReport(VERSION, datetime.now(timezone.utc).isoformat(), path, scan)
    tell(ProgressUpdate("scanning", "scan", 0.15, 1.0, f"{len(scan.files)} files"))
    if scan.files:
        tell(ProgressUpdate("detecting", "detect", 0.2))
        report.detection = choose(detect_format(scan), force_type)
        selected = report.detection.selected
        tell(ProgressUpdate("detecting", "detect", 0.25, 1.0, selected.dataset_type if selected else "unknown format"))
        if selected and selected.loader_id in loaders:
            tell(ProgressUpdate("loading", "load", 0.3))
            load = loaders[selected.loader_id]
            report.dataset = load(spark, scan, sample_size)
            if auto_sample and not sample_size and report.dataset.total_size_bytes > AUTO_BYTES:
                report.dataset = load(spark, scan, auto_size(report.dataset.num_samples))
            tell(ProgressUpdate("loading", "load", 0.4, 1.0))
            finish(report, tell)
    report.duration_seconds = round(time.monotonic() - began, 2)
    tell(ProgressUpdate("complete", "done", 1.0, 1.0))
    return report


def profile(df: DataFrame, name: str = "table", sample_size: int | None = None, progress: Callable[[ProgressUpdate], None] | None = None) -> DatasetReport:
    """The same for a table that is already a DataFrame."""
    began = time.monotonic()
    scan = ScanResult(name, [], [], 0, 0, [], [], [])
    report = DatasetReport(VERSION, datetime.now(timezone.utc).isoformat(), name, scan)
    report.detection = DetectionReport([], Detection("table", Modality.TABULAR, 1.0, "given as a table", "none"))
    report.dataset = tabular.describe(df, scan, "table", [], sample_size)
    finish(report, progress or (lambda update: None))
    report.duration_seconds = round(time.monotonic() - began, 2)
    return report


def choose(report: DetectionReport, force_type: str | None) -> DetectionReport:
    if force_type:
        forced = next((d for d in report.hypotheses if force_type in (d.dataset_type, d.loader_id)), None)
        if forced:
            report.selected = forced
    return report


def finish(report: DatasetReport, tell: Callable[[ProgressUpdate], None]) -> None:
    dataset = report.dataset
    tell(ProgressUpdate("analyzing", "analyze", 0.5))
    report.results = run_analyzers(dataset, tell)
    tell(ProgressUpdate("scoring", "score", 0.9))
    report.health = health_score(report.results)
    tell(ProgressUpdate("examples", "examples", 0.95))
    report.examples = examples(dataset)
    if hasattr(dataset, "_image_features"):
        dataset._image_features.unpersist()
        del dataset._image_features


def example_rows(dataset: Dataset, by: list[str] | None = None) -> DataFrame:
    """The first rows of a table, whole and with their types: as they lie, or in order of the columns ``by``."""
    rows = dataset.data.orderBy(*[ref(c) for c in by]) if by else dataset.data
    return rows.limit(EXAMPLE_ROWS)


def examples(dataset: Dataset) -> list[dict[str, Any]]:
    """The first rows of a table, or images picked by a hash of their path."""
    if dataset.images is not None:
        rows = dataset.images.orderBy(F.xxhash64(F.lit(SEED), "path")).limit(EXAMPLE_IMAGES).select("path", "split", "label").collect()
        return [{"path": r["path"], "split": r["split"], "label": r["label"]} for r in rows]
    if dataset.data is None:
        return []
    return [{k: v if v is None or isinstance(v, (int, float, str, bool)) else str(v) for k, v in r.asDict().items()} for r in example_rows(dataset).collect()]

