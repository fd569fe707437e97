"""Scan and format detection: metadata and the first bytes of JSON files only. Local folders are walked, others listed by Spark."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.model import Detection, DetectionReport, DirectoryNode, ExtensionCount, FileInfo, Modality, PathNotFoundError, ScanError, ScanResult
from quarrylens.plans.shared import file_system

#: Extensions, folders that are passed over, names of splits.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff", ".tif")
IGNORED = ("__pycache__", "node_modules", ".git", ".svn", ".DS_Store", "Thumbs.db")
SPLIT_NAMES = ("train", "training", "test", "testing", "val", "validation", "dev")
NO_EXTENSION = "(no extension)"
PART_FILE = re.compile(r"part-\d{5,}-[0-9a-f]{8}-")  # of many tasks that wrote a table
TREE_DEPTH, TREE_FILE_DEPTH, TREE_CHILDREN = 10, 3, 50


def extension_of(name: str) -> str:
    return os.path.splitext(name)[1].lower() or NO_EXTENSION


def in_store(path: str) -> bool:
    """Whether a path is a URI that only Spark's file systems open."""
    return "://" in path and not path.startswith("file:")


def scan_store(spark: SparkSession, root: str) -> ScanResult:
    """The same for a root in any file system that Spark reads.

    Spark lists the folders, many of them in tasks, and nothing of the files is read; totals
    by extension are added up in Spark.  Such stores have no links; hidden files and empty
    folders are not listed.
    """
    files, place = file_system(spark, root)
    if not files.exists(place):
        raise PathNotFoundError(f"no such path: {root}")
    single = files.getFileStatus(place).isFile()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    totals = listed.groupBy(F.when(suffix == "", NO_EXTENSION).otherwise(suffix).alias("extension")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size"))
    extensions = [ExtensionCount(r["extension"], r["n"], r["size"]) for r in totals.orderBy(F.desc("n"), "extension").collect()]
    ignored = lambda path: any(part in IGNORED for part in path[len(top) :].split("/"))
    top = str(place.toString()) if not single else str(place.getParent().toString())
    found = [FileInfo(r["path"], r["path"].rpartition("/")[2], extension_of(r["path"].rpartition("/")[2]), r["size_bytes"], False) for r in listed.orderBy("path").toLocalIterator() if not ignored(r["path"])]
    folders = {f.path.rpartition("/")[0] for f in found} | {top}
    return ScanResult(top, found, extensions, len(folders), sum(f.size_bytes for f in found), [], [], [], [] if single else build_tree(found, top))


def head_of(path: str, n: int) -> str:
    """The first bytes of a file as text."""
    if not in_store(path):
        with open(path, "rb") as source:
            return source.read(n).decode("utf-8", "replace")
    files, place = file_system(SparkSession.active(), path)
    stream = files.open(place)
    try:
        return bytes(stream.readNBytes(n)).decode("utf-8", "replace")
    finally:
        stream.close()


def scan_directory(root: str) -> ScanResult:
    """Files below a folder, or one file. Hidden files are listed apart; links are listed and counted, never followed."""
    if in_store(root):
        return scan_store(SparkSession.active(), root)
    top = Path(unquote(urlparse(root).path) if root.startswith("file:") else root).expanduser()
    if not top.exists():
        raise PathNotFoundError(f"no such path: {root}")
    top = top.resolve()
    if top.is_file():
        one = FileInfo(str(top), top.name, extension_of(top.name), top.stat().st_size, top.is_symlink())
        return ScanResult(str(top.parent), [one], [ExtensionCount(one.extension, 1, one.size_bytes)], 1, one.size_bytes, [], [], [])
    if not top.is_dir():
        raise ScanError(f"neither a folder nor a file: {root}")
    files: list[FileInfo] = []
    hidden, links, empty = [], [], []
    folders = 0
    for folder, below, names in os.walk(top, followlinks=False):
        below[:] = sorted(d for d in below if d not in IGNORED and not d.startswith("."))
        folders += 1
        if not below and not names:
            empty.append(folder)
        for name in sorted(names):
            path = os.path.join(folder, name)
            if name.startswith("."):
                hidden.append(path)
                continue
            if name in IGNORED:
                continue
            linked = os.path.islink(path)
            if linked:
                links.append(path)
            try:
                size = os.stat(path).st_size
            except OSError:
                size = 0
            files.append(FileInfo(path, name, extension_of(name), size, linked))
    totals: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for f in files:
        totals[f.extension][0] += 1
        totals[f.extension][1] += f.size_bytes
    extensions = sorted((ExtensionCount(e, n, size) for e, (n, size) in totals.items()), key=lambda e: (-e.count, e.extension))
    return ScanResult(str(top), files, extensions, folders, sum(f.size_bytes for f in files), empty, hidden, links, build_tree(files, str(top)))


def build_tree(files: list[FileInfo], root: str) -> DirectoryNode:
    """Folders first, then files by name without case; counts cover everything below, listings stop at a depth and length."""
    top = DirectoryNode(os.path.basename(root) or root, root)
    nodes = {"": top}
    for f in files:
        parts = os.path.relpath(f.path, root).split(os.sep)[:-1]
        chain = [top]
        for depth in range(1, min(len(parts), TREE_DEPTH) + 1):
            key = os.sep.join(parts[:depth])
            if key not in nodes:
                nodes[key] = DirectoryNode(parts[depth - 1], os.path.join(root, key))
                chain[-1].children.append(nodes[key])
            chain.append(nodes[key])
        for node in chain:
            node.file_count += 1
            node.total_size += f.size_bytes
        if len(parts) < TREE_FILE_DEPTH and len(chain[-1].files) < TREE_CHILDREN:
            chain[-1].files.append(f)
    for node in nodes.values():
        node.children.sort(key=lambda n: n.name.lower())
        node.files.sort(key=lambda f: f.name.lower())
    return top


def files_table(spark: SparkSession, scan: ScanResult) -> DataFrame:
    """The scan as a table: path, name, extension, size_bytes, split, label."""
    rows = [(f.path, f.name, f.extension, f.size_bytes, *split_and_label(f.path, scan.root)) for f in scan.files]
    return spark.createDataFrame(rows, "path string, name string, extension string, size_bytes long, split string, label string")


def split_and_label(path: str, root: str) -> tuple[str | None, str | None]:
    """split/class/image or class/image; null where a level is missing."""
    parts = os.path.relpath(path, root).split(os.sep)[:-1]
    if parts and parts[0] in SPLIT_NAMES:
        return parts[0], parts[1] if len(parts) > 1 else None
    return None, parts[0] if parts else None


# ---------------------------------------------------------------- detection


def tables_of(files: list[FileInfo]) -> list[list[FileInfo]]:
    """Files by table: part files as Spark writes them are one table a folder and extension, any other file is one of its own."""
    tables: dict[object, list[FileInfo]] = {}
    for f in files:
        part = PART_FILE.match(f.name)
        tables.setdefault((f.path.rpartition(f.name)[0], f.extension) if part else f.path, []).append(f)
    return list(tables.values())


def detect_format(scan: ScanResult) -> DetectionReport:
    """Hypotheses by falling confidence, in the order found among equals; the first is selected."""
    total = len(scan.files)
    if not total:
        return DetectionReport([], None)
    found: list[Detection] = []
    add = lambda kind, modality, confidence, reason, loader: found.append(Detection(kind, modality, round(confidence, 4), reason, loader))
    images = scan.with_extensions(*IMAGE_EXTENSIONS)
    share = len(images) / total
    if share > 0.7:
        folders = classification_confidence(scan, images)
        if folders:
            add("image_classification", Modality.IMAGE, folders, "images sorted into folders by class", "image_folder")
        add("image_folder", Modality.IMAGE, max(0.3, 0.6 * share), f"{share:.0%} of the files are images", "image_folder")
    csv = tables_of(scan.with_extensions(".csv", ".tsv"))
    if csv and images:
        add("mixed_multimodal", Modality.MULTIMODAL, 0.98, "tables and images together", "smart_mixed")
    if csv:
        confidence = 0.8 if len(csv) > 1 else 0.95 if total - len(csv[0]) < 5 else 0.7
        for ext in (".csv", ".tsv"):
            if scan.with_extensions(ext):
                add(ext[1:], Modality.TABULAR, confidence, f"{len(scan.with_extensions(ext))} {ext} files", "csv")
    lines, arrays = scan.with_extensions(".jsonl", ".ndjson"), scan.with_extensions(".json")
    if lines:
        add("jsonl", Modality.TABULAR, 0.85 if len(tables_of(lines)) == 1 else 0.75, f"{len(lines)} files of JSON lines", "json")
    if arrays and share < 0.5:
        add("json", Modality.TABULAR, json_confidence(arrays), f"{len(arrays)} JSON files", "json")
    parquet = scan.with_extensions(".parquet", ".pq")
    if parquet:
        add("parquet", Modality.TABULAR, 0.95, f"{len(parquet)} Parquet files", "parquet")
    sheets = scan.with_extensions(".xlsx", ".xls")
    if sheets:
        add("excel", Modality.TABULAR, 0.9 if len(sheets) == 1 else 0.75, f"{len(sheets)} spreadsheets", "excel")
    found.sort(key=lambda d: -d.confidence)
    return DetectionReport(found, found[0] if found else None)


def classification_confidence(scan: ScanResult, images: list[FileInfo]) -> float:
    relative = [os.path.relpath(f.path, scan.root).split(os.sep)[:-1] for f in images]
    splits: dict[str, set[str]] = defaultdict(set)
    for parts in relative:
        if parts and parts[0].lower() in SPLIT_NAMES:
            splits[parts[0]].update(parts[1:2])
    if splits:
        return 0.95 if any(len(classes) >= 2 for classes in splits.values()) else 0.85
    tops = sorted({os.path.relpath(f.path, scan.root).split(os.sep)[0] for f in scan.files if os.path.dirname(f.path) != scan.root})
    holding = {parts[0] for parts in relative if parts}
    if len(tops) >= 2 and len(images) / len(scan.files) > 0.8 and all(t in holding for t in tops[:10]):
        return 0.85
    return 0.0


def json_confidence(files: list[FileInfo]) -> float:
    for f in files:
        try:
            head = head_of(f.path, 4096).lstrip()
        except OSError:
            continue
        if head.startswith("["):
            return 0.8
        if head.startswith("{"):
            return 0.3 if '"images"' in head and '"annotations"' in head else 0.5
        return 0.4
    return 0.4
