"""Loaders for tables, and what all of them derive: field types, categories, classes, capabilities."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.exprs import ref, text_of
from quarrylens.functions.types import field_type, is_category
from quarrylens.model import NUMBERS, AnalysisMode, Dataset, DatasetField, FieldType, FileInfo, LoaderError, Modality, ScanResult, UnsupportedFormatError
from quarrylens.plans.passes import distinct_counts, value_counts
from quarrylens.sources.delimited import text_cells, typed_csv
from quarrylens.sources.sampling import exact_sample
from quarrylens.sources.scan import IMAGE_EXTENSIONS, head_of, tables_of

FEW_ROWS = 10_000  # of which examples are taken from all rows
SPLIT_TOKENS = ("validation", "train", "test", "val", "dev")  # fixed values, longer before shorter
CLASS_COLUMNS = ("class", "label", "category", "target")  # fixed values


def split_of(name: str) -> str | None:
    """The split a file name tells by one of its words."""
    tokens = re.split(r"[^a-z]+", name.lower())
    return next((t for t in SPLIT_TOKENS if t in tokens), None)


def describe(df: DataFrame, scan: ScanResult, source_format: str, paths: list[str], sample_size: int | None, splits: dict[str, int] | None = None) -> Dataset:
    """Schema of a loaded table: null counts, distinct counts and samples come from the table that the analyzers will see."""
    total = df.count()
    if sample_size:
        df = exact_sample(df, sample_size)
    types = {f.name: f.dataType for f in df.schema.fields}
    fields, classes = [], None
    capabilities = {"tabular"}
    counts = {r["column_name"]: r for r in distinct_counts(df, df.columns).collect()} if df.columns else {}
    samples = df.agg(*[F.slice(F.array_sort(F.collect_set(text_of(ref(c), types[c]))), 1, 5).alias(f"s{i}") for i, c in enumerate(df.columns)]).first() if df.columns and total <= FEW_ROWS else _few_values(df, types)
    for i, c in enumerate(df.columns):
        kind = field_type(types[c])
        if kind in NUMBERS:
            capabilities.add("numeric")
        if kind == FieldType.TEXT:
            capabilities.add("text")
            if is_category(counts[c]["n_unique"], counts[c]["total_rows"]):
                kind = FieldType.CATEGORICAL
                capabilities.add("labels")
                if classes is None:
                    classes = {r["value"]: r["n"] for r in value_counts(df, [c]).where("value IS NOT NULL").orderBy(F.desc("n"), "value").collect()}  # under 100 values
        fields.append(DatasetField(c, kind, counts[c]["missing_count"] > 0, list(samples[i] or [])))
    if splits:
        capabilities.add("splits")
    sizes = {f.path: f.size_bytes for f in scan.files}
    size = sum(sizes.get(p, 0) for p in paths)
    mode = AnalysisMode.SAMPLE if sample_size else AnalysisMode.FULL
    return Dataset(Modality.TABULAR, source_format, scan.root, total, size, fields, splits or {}, classes, capabilities, mode, min(sample_size, total) if sample_size else None, df)


def _few_values(df: DataFrame, types) -> list[list[str]]:
    """Five of the smallest values by column among the first rows; no pass over a large table for an example."""
    rows = df.limit(1000)
    return list(rows.agg(*[F.slice(F.array_sort(F.collect_set(text_of(ref(c), types[c]))), 1, 5) for c in df.columns]).first())


def largest(tables: list[list[FileInfo]]) -> list[FileInfo]:
    """The files of the table with the most bytes."""
    return max(tables, key=lambda files: (sum(f.size_bytes for f in files), files[0].path))


def paths_of(files: list[FileInfo]) -> list[str]:
    return [f.path for f in files]


def stem_of(files: list[FileInfo]) -> str:
    """A table's name: its file's, or its folder's if it has several."""
    return os.path.splitext(files[0].name)[0] if len(files) == 1 else os.path.basename(os.path.dirname(files[0].path))


def separator(files: list[FileInfo]) -> str:
    return "\t" if files[0].extension == ".tsv" else ","


def load_csv(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    files = scan.with_extensions(".csv", ".tsv")
    if not files:
        raise LoaderError("no CSV or TSV file")
    found = tables_of(files)
    main = largest(found)
    df = typed_csv(spark, paths_of(main), separator(main))
    splits: dict[str, int] = {}
    for own in found:
        stem = stem_of(own)
        name = split_of(stem)
        if name:
            rows = df if own is main else text_cells(spark, paths_of(own), separator(own))
            splits[name] = splits.get(name, 0) + rows.count()
        elif len(found) > 1:  # other files stand beside the splits without a count
            splits.setdefault(stem.lower(), 0)
    out = describe(df, scan, main[0].extension[1:], paths_of(files), sample_size, splits)
    return out


def load_json(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    files = scan.with_extensions(".json", ".jsonl", ".ndjson")
    if not files:
        raise LoaderError("no JSON file")
    main = largest(tables_of(files))
    head = head_of(main[0].path, 1 << 16).lstrip()
    if not head:
        raise LoaderError(f"{main[0].name} is empty")
    if head[0] not in "[{":
        raise LoaderError(f"{main[0].name} holds neither an array nor objects")
    array = head[0] == "["
    df = spark.read.option("multiLine", array).option("mode", "DROPMALFORMED").json(paths_of(main))
    first_seen = {name: k for k, name in reversed(list(enumerate(re.findall(r'"((?:[^"\\]|\\.)*)"\s*:', head))))}
    order = sorted(df.columns, key=lambda c: (first_seen.get(c, len(first_seen)), c))
    return describe(df.select(*[ref(c) for c in order]), scan, "json" if array else "jsonl", paths_of(main), sample_size)


def load_parquet(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    files = scan.with_extensions(".parquet", ".pq")
    if not files:
        raise LoaderError("no Parquet file")
    df = spark.read.option("recursiveFileLookup", True).parquet(*[f.path for f in files])
    splits: dict[str, int] = {}
    for f in files:
        name = next((s for part in os.path.relpath(f.path, scan.root).split(os.sep)[::-1] if (s := split_of(os.path.splitext(part)[0]))), None)
        if name:
            splits[name] = splits.get(name, 0) + 1
    return describe(df, scan, "parquet", [f.path for f in files], sample_size, splits)


def load_excel(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    files = scan.with_extensions(".xlsx", ".xls")
    if not files:
        raise LoaderError("no spreadsheet")
    main = max(files, key=lambda f: (f.size_bytes, f.path))
    if main.extension == ".xls":
        raise UnsupportedFormatError("binary .xls files have no reader here; save as .xlsx")
    from quarrylens.sources.xlsx import XlsxSource

    spark.dataSource.register(XlsxSource)
    return describe(spark.read.format("xlsx").load(main.path), scan, "excel", [main.path], sample_size)


def diagonal_union(tables: list[DataFrame]) -> DataFrame:
    """All columns of all tables, nulls where a table has none; columns of one name must have one type."""
    types: dict[str, str] = {}
    for t in tables:
        for name, kind in t.dtypes:
            if types.setdefault(name, kind) != kind:
                raise LoaderError(f"column {name} is {types[name]} in one table and {kind} in another")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def load_mixed(spark: SparkSession, scan: ScanResult, sample_size: int | None = None) -> Dataset:
    """Tables beside images: a text column of image names becomes an image field."""
    from quarrylens.sources.scan import files_table

    files = scan.with_extensions(".csv", ".tsv")
    found = tables_of(files)
    tables = [typed_csv(spark, paths_of(own), separator(own)) for own in found]
    try:
        df = diagonal_union(tables)
    except LoaderError:
        rest = [own for own in found if "submission" not in stem_of(own).lower()] or found
        df = tables[found.index(largest(rest))]
    images = files_table(spark, scan).where(F.col("extension").isin(*IMAGE_EXTENSIONS))
    out = describe(df, scan, "mixed", [f.path for f in files], sample_size)
    names = images.select("name").distinct()
    for field in out.fields:
        if field.dtype not in (FieldType.TEXT, FieldType.CATEGORICAL):
            continue
        values = out.data.select(ref(field.name).alias("v")).where("v IS NOT NULL").limit(100)
        tried = values.select("v", F.explode(F.array(F.col("v"), F.concat("v", F.lit(".jpg")), F.concat("v", F.lit(".png")))).alias("name"))
        total = values.count()
        hits = tried.join(names, "name", "left_semi").select("v").distinct().count()
        if total and hits / values.distinct().count() >= 0.5:
            field.dtype = FieldType.IMAGE
    chosen = next((f.name for f in out.fields if f.name.lower() in CLASS_COLUMNS), None)
    if chosen:
        out.classes = {r["value"]: r["n"] for r in value_counts(out.data, [chosen]).where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(10_000).collect()}
    out.modality = Modality.MULTIMODAL
    out.images = images
    out.num_samples = images.count()
    out.capabilities |= {"images", "labels"}
    return out
