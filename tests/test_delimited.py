"""Delimited text over byte ranges, and types from all cells."""

import csv
import random

import pytest
from pyspark.sql import types as T

from quarrylens.queries import load_csv_line_breaks
from quarrylens.sources import delimited
from quarrylens.sources.delimited import INSIDE, OUTSIDE, state_after, text_cells, typed_csv

VALUES = ["a", "b c", '5" pipe', 'say "hi"', "x,y", "line\nbreak", "\n\n", "", '"', "tail\r\nend", "long " * 30, 'q"\n"z']


@pytest.fixture
def ranges_of(spark):
    """Sets the size of a range; the session's own size comes back."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def set_to(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 1)

    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


def written(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows([header, *rows])
    return str(path)


def test_states():
    for line, before, after in [
        ('a,"b', OUTSIDE, INSIDE), ('a,"b"', OUTSIDE, OUTSIDE), ('5" pipe', OUTSIDE, OUTSIDE), ('5" pipe,"x', OUTSIDE, INSIDE), ('c",d', INSIDE, OUTSIDE), ("", INSIDE, INSIDE),
        ('""', INSIDE, INSIDE), ('x"",y', INSIDE, INSIDE), ('x","y', INSIDE, INSIDE), ('"a"b"c', OUTSIDE, OUTSIDE), ('"a"b,"c', OUTSIDE, INSIDE), ('"",', OUTSIDE, OUTSIDE), ('"""', OUTSIDE, INSIDE),
    ]:
        assert state_after(line, before, ",") == after, line


@pytest.mark.parametrize("size", [40, 333, 5000, 1 << 27])
def test_records_over_ranges(spark, tmp_path, ranges_of, size):
    pick = random.Random(1)
    rows = [[str(k)] + [pick.choice(VALUES) for _ in range(3)] for k in range(300)]
    path = written(tmp_path / "a.csv", ["id", "a\nhead", "b", "c"], rows)
    ranges_of(size)
    cells = text_cells(spark, path, ",")
    assert cells.columns == ["id", "a\nhead", "b", "c"]
    if size == 40:
        assert delimited.file_lines(spark, path).rdd.getNumPartitions() > 100
    assert sorted((tuple(r) for r in cells.collect()), key=lambda r: int(r[0])) == [tuple(v or None for v in r) for r in rows]


def test_one_value_over_many_ranges_and_a_quote_that_never_closes(spark, tmp_path, ranges_of):
    ranges_of(50)
    value = "\n".join(f"line {k}" for k in range(100))
    path = written(tmp_path / "b.csv", ["id", "v"], [["1", "x"], ["2", value], ["3", "y\nz"], ["4", value]])
    assert sorted(map(tuple, text_cells(spark, path, ",").collect())) == [("1", "x"), ("2", value), ("3", "y\nz"), ("4", value)]
    (tmp_path / "c.csv").write_text('id,v\n1,"open\n2,b\n3,c\n')
    assert text_cells(spark, str(tmp_path / "c.csv"), ",").count() == 3


def test_plain_files_stay_with_the_splittable_reader(spark, tmp_path):
    path = written(tmp_path / "d.csv", ["id", "v"], [["1", "a,b"], ["2", '5" pipe']])
    assert "MapInArrow" not in text_cells(spark, path, ",")._jdf.queryExecution().toString()
    assert sorted(map(tuple, text_cells(spark, path, ",").collect())) == [("1", "a,b"), ("2", '5" pipe')]


@pytest.mark.parametrize("value", ["x", "two\nlines"])
def test_an_empty_text_is_no_missing_one(spark, tmp_path, value):
    (tmp_path / "h.csv").write_text(f'id,v,n,w\n1,"",5,""\n2,,"",\n3,"{value}",,z\n')
    df = typed_csv(spark, str(tmp_path / "h.csv"))
    assert [f.dataType.typeName() for f in df.schema] == ["integer", "string", "integer", "string"]
    assert sorted(map(tuple, df.collect())) == [(1, "", 5, ""), (2, None, None, None), (3, value, None, "z")]


def test_written_texts_come_back(spark, tmp_path, ranges_of):
    pick = random.Random(3)
    rows = [(k, "".join(pick.choice('a", \n\r\t\\\0') for _ in range(pick.randrange(6))) if k % 50 else None, pick.choice(["en", "", None])) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    ranges_of(3000)
    assert sorted(map(tuple, load_csv_line_breaks(spark, str(tmp_path)).collect()), key=lambda r: r[0]) == rows


def test_late_cells_keep_their_values(spark, tmp_path):
    many = 12_000
    late = ["2024-01-01 10:00:00", "2024-13-45", "maybe", "1e-3", "99999999999", "x", "true", "", "123456789012345678901", "007"]
    names = ["time", "date", "flag", "real", "long", "text", "bool", "none", "huge", "int"]
    early = ["2024-01-01", "2024-01-02", "true", "5", "7", "8", "false", "", "1", "5"]
    df = typed_csv(spark, written(tmp_path / "e.csv", names, [early] * many + [late]))
    kinds = {f.name: f.dataType for f in df.schema}
    assert kinds == {
        "time": T.TimestampType(), "date": T.StringType(), "flag": T.StringType(), "real": T.DoubleType(), "long": T.LongType(), "text": T.StringType(), "bool": T.BooleanType(),
        "none": T.StringType(), "huge": T.DoubleType(), "int": T.IntegerType(),
    }
    assert df.count() == many + 1 and df.dropna("all").count() == many + 1
    nulls = df.select(*[df[c].isNull().cast("int").alias(c) for c in names]).groupBy().sum().first()
    assert [n for n, c in zip(nulls, names) if c != "none"] == [0] * 9
    assert df.where("flag = 'maybe'").first()["long"] == 99999999999


def test_narrowest_types_of_little(spark, tmp_path):
    path = written(tmp_path / "f.csv", ["a", "b", "c"], [["", "NaN", " 5 "], ["", "-inf", ""]])
    df = typed_csv(spark, path)
    assert [f.dataType.typeName() for f in df.schema] == ["string", "double", "integer"] and df.where("c = 5").count() == 1
    (tmp_path / "g.csv").write_text("a,b\n")
    assert [f.dataType.typeName() for f in typed_csv(spark, str(tmp_path / "g.csv")).schema] == ["string", "string"]
