"""Scan, detection, loaders, images and reports on folders made here."""

import json
import os
import struct
import zipfile
import zlib
from math import comb

import numpy as np
import pytest

from quarrylens import queries, reports
from quarrylens.__main__ import main
from quarrylens.engine import analyze
from quarrylens.model import FieldType, PathNotFoundError, UnsupportedFormatError
from quarrylens.operators import images
from quarrylens.operators.images import block_pairs, by_index, chunks_for, hamming_pairs, header, index_pairs, perceptual_hash
from quarrylens.sources.scan import detect_format, head_of, scan_directory, scan_store, tables_of
from quarrylens.streaming.progress import updates


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())
    return path


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    kind = {2: 0, 3: 2}[pixels.ndim] if pixels.ndim == 2 or pixels.shape[2] == 3 else 6
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def sheet(rows) -> dict[str, str]:
    cells = "".join(f"<row r='{i}'>" + "".join(f"<c r='{chr(65 + j)}{i}'" + (f" t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else f"><v>{v}</v></c>") for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return {
        "xl/workbook.xml": f"<workbook xmlns='{main}' xmlns:r='{rel}'><sheets><sheet name='s' sheetId='1' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{main}'><sheetData>{cells}</sheetData></worksheet>",
    }


def test_scan_lists_hidden_links_and_empty_folders(tmp_path):
    put(tmp_path, "a/one.CSV", "x")
    put(tmp_path, "a/_two", "yy")
    put(tmp_path, ".hidden", "z")
    put(tmp_path, "node_modules/three.js", "z")
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "a/_two", tmp_path / "link.txt")
    scan = scan_directory(str(tmp_path))
    assert {f.name for f in scan.files} == {"one.CSV", "_two", "link.txt"} and len(scan.hidden_files) == 1 and len(scan.symlinks) == 1
    assert {e.extension for e in scan.extensions} == {".csv", "(no extension)", ".txt"}
    assert [os.path.basename(d) for d in scan.empty_directories] == ["empty"] and scan.tree.file_count == 3
    with pytest.raises(PathNotFoundError):
        scan_directory(str(tmp_path / "none"))
    assert len(scan_directory(str(tmp_path / "a/one.CSV")).files) == 1


def test_detection_rules(tmp_path):
    assert detect_format(scan_directory(str(tmp_path))).selected is None
    put(tmp_path, "a.csv", "x\n1\n")
    assert (detect_format(scan_directory(str(tmp_path))).selected.loader_id, detect_format(scan_directory(str(tmp_path))).selected.confidence) == ("csv", 0.95)
    put(tmp_path, "b.csv", "x\n1\n")
    assert detect_format(scan_directory(str(tmp_path))).selected.confidence == 0.8
    put(tmp_path, "c.png", png(np.zeros((4, 4))))
    assert detect_format(scan_directory(str(tmp_path))).selected.dataset_type == "mixed_multimodal"


def test_csv_with_a_late_bad_cell(spark, tmp_path):
    lines = ["n,day,flag,name"] + [f"{i},2024-01-{i % 28 + 1:02d},{'True' if i % 2 else 'False'},{'ab'[i % 2]}" for i in range(11_000)] + ["oops,2024-02-01,True,a"]
    put(tmp_path, "train.csv", "\n".join(lines) + "\n")
    report = analyze(spark, str(tmp_path))
    kinds = {f.name: f.dtype for f in report.dataset.fields}
    assert kinds == {"n": FieldType.TEXT, "day": FieldType.DATETIME, "flag": FieldType.BOOLEAN, "name": FieldType.CATEGORICAL}
    assert report.dataset.splits == {"train": 11_001} and not report.dataset.fields[0].nullable and report.dataset.data.where("n = 'oops'").count() == 1 and report.dataset.classes == {"a": 5501, "b": 5500}


def test_csv_counts_every_split_file(spark, tmp_path):
    for name, sep, n in (("train.csv", ",", 40), ("test.csv", ",", 7), ("val_1.tsv", "\t", 3), ("val_2.tsv", "\t", 2), ("Extra.csv", ",", 5)):
        put(tmp_path, name, f"n{sep}t\n" + "".join(f"{i}{sep}v{i}\n" for i in range(n)))
    put(tmp_path, "dev.csv", "")
    data = analyze(spark, str(tmp_path)).dataset
    assert data.splits == {"train": 40, "test": 7, "val": 5, "extra": 0, "dev": 0} and data.num_samples == 40 and "splits" in data.capabilities
    put(tmp_path, "one/Extra.csv", "n\n1\n")
    assert analyze(spark, str(tmp_path / "one")).dataset.splits == {}


def test_csv_with_quoted_line_breaks_and_doubled_quotes(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,note,n\n1,"x\ny",3\n2,"say ""hi"", then go",4\n3,,5\n')
    data = analyze(spark, str(tmp_path)).dataset
    assert [tuple(r) for r in data.data.orderBy("id").collect()] == [(1, "x\ny", 3), (2, 'say "hi", then go', 4), (3, None, 5)] and data.num_samples == 3
    assert [f.dtype for f in data.fields] == [FieldType.INTEGER, FieldType.TEXT, FieldType.INTEGER]
    put(tmp_path, "two/train.csv", 'id,t\n1,"a\nb"\n2,c\n')
    put(tmp_path, "two/test.csv", 'id,t\n1,"a\n\nb"\n')
    assert analyze(spark, str(tmp_path / "two")).dataset.splits == {"train": 2, "test": 1}


def test_csv_integers_widen_for_late_cells(spark, tmp_path):
    lines = ["a,b,c"] + [f"{i},{i},{i}" for i in range(10_500)] + ["1.5,5000000000,x"] * 500
    put(tmp_path, "a.csv", "\n".join(lines) + "\n")
    data = analyze(spark, str(tmp_path)).dataset
    assert [f.dtype for f in data.fields] == [FieldType.FLOAT, FieldType.INTEGER, FieldType.TEXT] and [f.nullable for f in data.fields] == [False, False, False]
    assert data.data.where("a = 1.5 AND b = 5000000000 AND c = 'x'").count() == 500


def test_part_files_of_many_tasks_are_one_table(spark, tmp_path):
    df = spark.range(4000).repartition(6).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('a \"b\", c\n', id) ELSE concat('t', id) END AS note", "CASE WHEN id = 3999 THEN 'late' ELSE string(id % 7) END AS mixed")
    for kind in ("csv", "json"):
        df.write.format(kind).options(**({"header": "true", "escape": '"'} if kind == "csv" else {})).save(str(tmp_path / kind))
        scan = scan_directory(str(tmp_path / kind))
        data = analyze(spark, str(tmp_path / kind)).dataset
        assert len(scan.with_extensions(f".{kind}")) == 6 and data.num_samples == 4000 and data.splits == {}
        assert sorted(tuple(r) for r in data.data.select("id", "note", "mixed").collect()) == sorted(tuple(r) for r in df.collect())
    assert detect_format(scan_directory(str(tmp_path / "csv"))).selected.confidence == 0.95
    put(tmp_path, "csv/other.csv", "n\n1\n")
    assert [len(own) for own in tables_of(scan_directory(str(tmp_path / "csv")).with_extensions(".csv"))] in ([1, 6], [6, 1])
    assert analyze(spark, str(tmp_path / "csv")).dataset.num_samples == 4000


def test_source_queries_write_a_file_a_task(spark):
    folder = queries._written(spark, spark.range(900).repartition(9), "csv", header="true")
    assert len(scan_directory(folder).with_extensions(".csv")) == 9


@pytest.mark.parametrize(("name", "text"), [("a.json", '[{"z": 1, "a": "x"}, {"z": 2, "a": "y"}]'), ("a.json", ' {"z": 1, "a": "x"}\n{"z": 2, "a": "y"}\n'), ("a.jsonl", '{"z": 1, "a": "x"}\nnot json\n{"z": 2, "a": "y"}\n')])
def test_json_keeps_column_order_and_skips_bad_lines(spark, tmp_path, name, text):
    put(tmp_path, name, text)
    data = analyze(spark, str(tmp_path)).dataset
    assert [f.name for f in data.fields] == ["z", "a"] and data.num_samples == 2


def test_parquet_of_several_files_and_splits(spark, tmp_path):
    for split in ("train", "test"):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / split / "k=1"))
    data = analyze(spark, str(tmp_path)).dataset
    assert data.num_samples == 10 and data.splits == {"train": 1, "test": 1} and [f.name for f in data.fields] == ["id"]


def test_excel(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        for name, text in sheet([["n", "t", "x"], [1, "a", 1.5], [2, None, 2], [3, "c", None]]).items():
            book.writestr(name, text)
    data = analyze(spark, str(tmp_path)).dataset
    assert {f.name: f.dtype for f in data.fields} == {"n": FieldType.INTEGER, "t": FieldType.TEXT, "x": FieldType.FLOAT}
    assert sorted(tuple(r) for r in data.data.collect()) == [(1, "a", 1.5), (2, None, 2.0), (3, "c", None)]
    os.remove(tmp_path / "a.xlsx")
    put(tmp_path, "b.xls", b"\xd0\xcf")
    with pytest.raises(UnsupportedFormatError):
        analyze(spark, str(tmp_path))


def test_images_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    same = png(rng.integers(0, 255, (40, 40, 3)))
    for split in ("train", "test"):
        put(tmp_path, f"{split}/cats/same.png", same)
        for k in range(3):
            put(tmp_path, f"{split}/dogs/{k}.png", png(rng.integers(0, 255, (64, 48, 3))))
    put(tmp_path, "train/cats/dark.png", png(np.full((50, 50, 3), 5)))
    put(tmp_path, "train/cats/gray.png", png(rng.integers(0, 255, (20, 60))))
    put(tmp_path, "train/cats/bad.jpg", "this is no image")
    put(tmp_path, "train/cats/cut.png", same[: len(same) // 2])
    put(tmp_path, "train/cats/none.png", b"")
    report = analyze(spark, str(tmp_path))
    assert all(r.status == "success" for r in report.results), [(r.analyzer_id, r.error_message) for r in report.results]
    codes = {f.code for r in report.results for f in r.findings}
    assert {"corrupted_images", "truncated_images", "zero_size_images", "cross_split_duplicates", "exact_duplicates", "very_small_images", "mixed_color_modes"} <= codes
    by_id = {r.analyzer_id: r.metrics for r in report.results}
    assert by_id["corrupted_images"]["total_issues"] == 3 and by_id["image_quality"]["dark"] == 1
    assert report.dataset.splits == {"train": 9, "test": 4} and report.dataset.classes == {"cats": 7, "dogs": 6}


def test_mixed_folder_links_names_to_images(spark, tmp_path):
    for k in range(4):
        put(tmp_path, f"img/{k}.png", png(np.full((40, 40, 3), 60 * k)))
    put(tmp_path, "rows.csv", "file,label,n\n" + "".join(f"{k},{'xy'[k % 2]},{k}\n" for k in range(4)).replace("\n", "\n") )
    put(tmp_path, "names.csv", "file,label,n\n" + "".join(f"{k}.png,{'xy'[k % 2]},{k}\n" for k in range(4)))
    os.remove(tmp_path / "rows.csv")
    data = analyze(spark, str(tmp_path)).dataset
    assert {f.name: f.dtype for f in data.fields}["file"] == FieldType.IMAGE and data.classes == {"x": 2, "y": 2} and data.num_samples == 4


@pytest.mark.parametrize("max_bits", [1, 8, 17])
def test_hamming_index_equals_all_pairs(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    base = [int(b) for b in rng.integers(-(2**63), 2**63, 60)]
    flipped = lambda b, k: b ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False))
    hashes = base + [flipped(b, k) for b in base for k in (0, 1, max_bits, max_bits + 1)]
    differing = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    plain = {(i, j, d) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and 1 <= (d := differing(a, b)) <= max_bits}
    assert {tuple(r) for r in hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long"), max_bits).collect()} == plain and plain


@pytest.mark.parametrize("block", [90, 1 << 15])
def test_hash_blocks_and_index_give_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(images, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(-(2**63), 2**63, 120))
    near = base[:, None] ^ (np.int64(1) << rng.integers(0, 63, (len(base), 12))).cumsum(1)[:, ::4]
    hashes = np.unique(np.append(base, [near.ravel(), [0] * near.size, [-1] * near.size]))
    distance = np.bitwise_count((hashes[:, None] ^ hashes).view(np.uint64))
    plain = {(int(hashes[i]), int(hashes[j]), int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= 8)) if i < j}
    entries = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    for found in (block_pairs(entries, len(hashes), 8), index_pairs(entries, len(hashes), 8)):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(plain) and set(rows) == plain


def test_few_and_no_hashes_have_no_pairs(spark):
    assert [hamming_pairs(spark.createDataFrame(rows, "id long, hash long"), 17).count() for rows in ([], [(1, 5)], [(1, 5), (2, 5)])] == [0, 0, 0]


def test_wide_distances_are_compared_in_blocks():
    """At 17 bits the index would probe over 1,000 values a hash; at 8 bits it is less work for many hashes."""
    assert not any(by_index(n, 17) for n in (10**3, 10**5, 10**6)) and by_index(10**7, 8) and not by_index(10**4, 8)


def test_hamming_chunks_shrink_candidates():
    for n in (10**3, 10**5, 10**7, 10**9):
        chunks = chunks_for(8, n)
        assert sum(bits for _, bits, _ in chunks) <= 64 and sum(radius + 1 for *_, radius in chunks) == 9  # the pigeonholes
    shares = [sum(sum(comb(bits, r) for r in range(radius + 1)) / 2**bits for _, bits, radius in chunks_for(8, n)) for n in (10**3, 10**5, 10**7)]
    assert shares == sorted(shares, reverse=True) and shares[1] < 0.005


def test_headers_and_hashes():
    assert header(png(np.zeros((3, 5)))) == ("PNG", 5, 3, "L") and header(b"GIF89a" + struct.pack("<HH", 7, 9)) == ("GIF", 7, 9, "P") and header(b"junk")[0] is None
    image = np.random.default_rng(2).random((90, 70))
    assert perceptual_hash(image) == perceptual_hash(image * 0.5)


def test_reports_escape_and_command_line(spark, tmp_path, capsys):
    put(tmp_path, "d/a.csv", "name|x,n\n<b>,1\n<b>,2\n")
    report = analyze(spark, str(tmp_path / "d"))
    assert "<b>" not in reports.as_html(report).split("<body>")[1] and json.loads(reports.as_json(report))["health"]["grade"]
    assert main(["analyze", str(tmp_path / "d"), "-r", str(tmp_path / "r.md")], spark) == 0 and (tmp_path / "r.md").read_text().startswith("# ")
    assert main(["analyze", str(tmp_path / "none")], spark) == 1
    *_, last = updates(lambda tell: analyze(spark, str(tmp_path / "d"), progress=tell))
    assert last.dataset.num_samples == 2


def test_stores_are_listed_as_folders_are(spark, tmp_path):
    put(tmp_path, "d/train/a.csv", "n,t\n1,x\n2,y\n")
    put(tmp_path, "d/train/deep/b.CSV", "n,t\n1,x\n")
    put(tmp_path, "d/plain", "z")
    put(tmp_path, "d/e.json", '{"a": 1}\n')
    put(tmp_path, "d/node_modules/c.js", "z")
    ours, walked = scan_store(spark, f"file://{tmp_path}/d"), scan_directory(str(tmp_path / "d"))
    plain = lambda path: path.removeprefix("file:").replace("//", "/")
    assert sorted((plain(f.path), f.name, f.extension, f.size_bytes) for f in ours.files) == sorted((f.path, f.name, f.extension, f.size_bytes) for f in walked.files)
    assert ours.total_size == walked.total_size and ours.tree.file_count == walked.tree.file_count == 4
    assert [(e.extension, e.count) for e in ours.extensions if e.extension != ".js"] == [(e.extension, e.count) for e in walked.extensions]
    one = scan_store(spark, f"file://{tmp_path}/d/train/a.csv")
    assert [f.name for f in one.files] == ["a.csv"] and head_of(f"{tmp_path}/d/e.json", 4) == '{"a"'
    with pytest.raises(PathNotFoundError):
        scan_store(spark, f"file://{tmp_path}/none")


def test_a_root_that_only_spark_reads(spark, tmp_path, monkeypatch):
    put(tmp_path, "train.csv", "n,t\n1,x\n2,y\n")
    monkeypatch.setattr("quarrylens.sources.scan.in_store", lambda path: "://" in path or path.startswith("file:"))
    report = analyze(spark, f"file://{tmp_path}")
    assert report.dataset.num_samples == 2 and report.dataset.splits == {"train": 2} and report.dataset.total_size_bytes == 12
