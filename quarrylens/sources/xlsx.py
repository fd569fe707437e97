"""A Python data source for the first sheet of .xlsx files: ``spark.read.format("xlsx").load(path)``."""

from __future__ import annotations

import datetime as dt
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Fixed by the format: number formats 14 to 22 and 45 to 47 are dates and times; day 0 is 1899-12-30.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = dt.datetime(1899, 12, 30)


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _sheet_path(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", NS)
    relations = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == sheet.get(RELATION))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", NS) if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]|\\.', "", f.get("formatCode", "")), re.IGNORECASE)}
    return {k for k, x in enumerate(styles.iterfind("m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _value(cell: ET.Element, shared: list[str], dates: set[int]):
    kind, raw = cell.get("t", "n"), cell.findtext("m:v", None, NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iterfind("m:is//m:t", NS))
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind in ("str", "d"):
        return raw
    number = float(raw)
    if int(cell.get("s", 0)) in dates:
        return EPOCH + dt.timedelta(days=number)
    return int(number) if number.is_integer() and "." not in raw and "e" not in raw.lower() else number


def sheet_rows(path: str) -> Iterator[list]:
    """Rows of the first sheet, as long as their last cell."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", NS)]
        dates = _date_styles(book)
        with book.open(_sheet_path(book)) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{{{NS['m']}}}row":
                    continue
                out: list = []
                for k, cell in enumerate(row.iterfind("m:c", NS)):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    out[at] = _value(cell, shared, dates)
                row.clear()
                yield out


def infer(path: str) -> StructType:
    rows = sheet_rows(path)
    header = next(rows, [])
    names, seen = [], {}
    for k, h in enumerate(header):
        name = str(h) if h is not None else f"column_{k + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    kinds: list[set[type]] = [set() for _ in names]
    for row in rows:
        for kind, value in zip(kinds, row):
            if value is not None:
                kind.add(type(value))

    def spark_type(kind: set[type]):
        if kind == {bool}:
            return BooleanType()
        if kind == {int}:
            return LongType()
        if kind and kind <= {int, float}:
            return DoubleType()
        if kind == {dt.datetime}:
            return TimestampType()
        return StringType()

    return StructType([StructField(n, spark_type(k)) for n, k in zip(names, kinds)])


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return infer(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], schema)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds = path, [f.dataType for f in schema.fields]

    def read(self, partition) -> Iterator[tuple]:
        rows = sheet_rows(self.path)
        next(rows, None)
        for row in rows:
            yield tuple(self._fit(v, k) for v, k in zip(row + [None] * (len(self.kinds) - len(row)), self.kinds))

    @staticmethod
    def _fit(value, kind):
        if value is None:
            return None
        if isinstance(kind, DoubleType):
            return float(value)
        if isinstance(kind, StringType):
            return str(value)
        return value
