"""Delimited text: records that may hold line breaks, read in byte ranges; and the narrowest type of every column.

Whether a line begins a record depends on all quotes before it.  A range of a file is
therefore read as a function: the state (outside or inside a quoted value) in which it
ends, for either state in which it may begin.  These functions are one row a range; put
together in order they give every range's true state at its start.  Ranges are then cut
into records side by side.  Only a record that reaches over the end of its range travels:
its parts meet by the range in which it begins.

A quote counts where a value begins, as Spark's reader has it: ``5" pipe`` has none, and
behind a closing quote only a delimiter or the end of the line keeps the value quoted.

Types come from every cell: a cell has a bit for each type that can hold it, and the bits of
a column are those that all its cells share.  A column is read as the first of ``KINDS`` that
is left, so no cell is lost to its type, however late it comes.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.exprs import ref
from quarrylens.plans.shared import save

OUTSIDE, INSIDE = 0, 1
NO_CELL = uuid.uuid4().hex  # what Spark's parser takes for null; no cell holds it, so "" stays an empty text and only nothing at all is null


def csv_options(sep: str) -> dict[str, str]:
    """Doubled quotes and no other escape; by default the parser takes a NUL before a quote for one."""
    return {"sep": sep, "escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "PERMISSIVE", "nullValue": NO_CELL}


def csv_reader(spark: SparkSession, sep: str) -> DataFrameReader:
    """Header line, doubled quotes, every cell as text."""
    return spark.read.option("header", True).options(**csv_options(sep))


# ---------------------------------------------------------------- states


def state_after(line: str, state: int, sep: str) -> int:
    """State at the end of a line that begins in ``state``."""
    at = 0
    while True:
        if state == OUTSIDE and line.startswith('"', at):
            state, at = INSIDE, at + 1
        if state == INSIDE:
            close = line.find('"', at)
            while close >= 0 and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                return INSIDE
            state, at = OUTSIDE, close + 1
        end = line.find(sep, at)
        if end < 0:
            return OUTSIDE
        at = end + len(sep)


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, start): lines in order within each range of a file, with the range's first byte."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


EFFECTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("from_outside", pa.int32()), ("from_inside", pa.int32()), ("opens_outside", pa.bool_()), ("opens_inside", pa.bool_()), ("closes", pa.bool_())])


def range_effects(lines: DataFrame, sep: str) -> DataFrame:
    """A row a range with quotes: the state at its end from either state at its start, whether any line in it then ends inside a value, and whether a value open at its start ends in it.

    Lines without quotes change nothing and stay in the JVM.
    """

    def run(batches):
        effects: dict[tuple[str, int], list] = {}
        for batch in batches:
            for value, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                effect = effects.setdefault((file, start), [OUTSIDE, INSIDE, False, False, False])
                for k in (OUTSIDE, INSIDE):
                    effect[k] = state_after(value, effect[k], sep)
                    effect[k + 2] |= effect[k] == INSIDE
                effect[4] |= effect[INSIDE] == OUTSIDE
        rows = [dict(zip(EFFECTS.names, (*key, *effect))) for key, effect in effects.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=EFFECTS)

    return lines.where(F.col("value").contains('"')).mapInArrow(run, "file string, start long, from_outside int, from_inside int, opens_outside boolean, opens_inside boolean, closes boolean")


@dataclass
class Ranges:
    """What the effects of ranges give in order of their places."""

    changes: dict[str, list[tuple[int, int, int]]]  # by file: from behind the range at a byte on, the state and the range in which the open record begins
    spanning: bool = False  # whether any record has a line break
    closed: bool = True  # whether every file ends outside a value

    def at(self, file: str, start: int) -> tuple[int, int]:
        """State and owner where a range starts."""
        own = self.changes.get(file, [])
        k = bisect_left(own, (start,))
        return own[k - 1][1:] if k else (OUTSIDE, 0)


def ranges_in_order(lines: DataFrame, sep: str) -> Ranges:
    """A row a range with quotes reaches the driver; kept are only ranges behind which the state or the open record is another one."""
    out, file, state, owner = Ranges({}), None, OUTSIDE, 0
    for r in sorted(range_effects(lines, sep).collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            out.closed &= state == OUTSIDE
            file, state, owner = r["file"], OUTSIDE, 0
        before = (state, owner)
        out.spanning |= r["opens_inside"] if state else r["opens_outside"]
        if state == OUTSIDE or r["closes"]:
            owner = r["start"]
        state = r["from_inside"] if state else r["from_outside"]
        owner = owner if state == INSIDE else 0
        if (state, owner) != before:
            out.changes.setdefault(file, []).append((r["start"], state, owner))
    out.closed &= state == OUTSIDE
    return out


PIECES = pa.schema([("record", pa.string()), ("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("first", pa.bool_())])


def record_pieces(lines: DataFrame, ranges: Ranges, sep: str) -> DataFrame:
    """(record, file, owner, start, first): whole records, and parts of those that reach over ranges, which have an owner. ``first`` marks a file's first record."""

    def run(batches):
        out: list[tuple] = []
        here, state, owner, lines_open, fresh = None, OUTSIDE, None, [], True

        def close(whole: bool) -> None:
            nonlocal lines_open, fresh, owner
            if lines_open:
                text = "\n".join(lines_open)
                if not whole and owner is None:
                    owner = here[1]
                if owner is not None or text.strip():  # blank lines are no records
                    out.append((text.removesuffix("\r") if whole else text, here[0], owner, here[1], fresh and here[1] == 0))
                    fresh = False
            lines_open, owner = [], None

        for batch in batches:
            for value, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != here:
                    close(False)
                    here, fresh = (file, start), True
                    state, at = ranges.at(file, start)
                    owner = at if state == INSIDE else None
                lines_open.append(value)
                if state == INSIDE or '"' in value:
                    state = state_after(value, state, sep)
                if state == OUTSIDE:
                    close(True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)
                out.clear()
        close(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)

    return lines.mapInArrow(run, "record string, file string, owner long, start long, first boolean")


def records(lines: DataFrame, ranges: Ranges, sep: str) -> DataFrame:
    """(record) of every record but each file's first. Records over several ranges are put together once and saved."""
    pieces = record_pieces(lines, ranges, sep)
    parts = pieces.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"), F.bool_or("first").alias("first"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "first")
    across = save(joined.where(~F.col("first") & (F.trim("record") != "")).select("record"), "records")
    return pieces.where("owner IS NULL AND NOT first").select("record").unionByName(across)


def text_cells(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """All cells of a file, or of a table's files that each have its header, as text, named by the header."""
    reader = csv_reader(spark, sep)
    lines = file_lines(spark, path)
    if lines.where(F.col("value").contains('"')).isEmpty():
        return reader.csv(path)
    ranges = ranges_in_order(lines, sep)
    if not ranges.spanning or not ranges.closed:  # a quote that is never closed is none
        return reader.csv(path)
    names = reader.option("multiLine", True).csv(path if isinstance(path, str) else path[0]).columns  # reads the first record only
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    cells = records(lines, ranges, sep).select(F.from_csv("record", schema, csv_options(sep)).alias("r"))
    return cells.select(*[F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])


# ---------------------------------------------------------------- types

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WORDS = r"^([+-]?([iI]nf(inity)?)|[nN]a[nN])$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"


def _whole(cell: Column, kind: str) -> Column:
    return cell.rlike(r"^[+-]?\d+$") & cell.try_cast(kind).isNotNull()


#: Narrower types first; a cell that fits one may fit later ones too.
KINDS: list[tuple[T.DataType, "callable"]] = [
    (T.BooleanType(), lambda cell: F.lower(cell).isin("true", "false")),
    (T.IntegerType(), lambda cell: _whole(cell, "int")),
    (T.LongType(), lambda cell: _whole(cell, "bigint")),
    (T.DoubleType(), lambda cell: cell.rlike(NUMBER) | cell.rlike(WORDS)),
    (T.DateType(), lambda cell: cell.rlike(DATE) & cell.try_cast("date").isNotNull()),
    (T.TimestampType(), lambda cell: (cell.rlike(DATE) | cell.rlike(TIME)) & cell.try_cast("timestamp").isNotNull()),
]
ANY = (1 << len(KINDS)) - 1


def fitting(cell: Column) -> Column:
    """A bit for each of KINDS that can hold a cell; an empty one fits all."""
    bits = F.lit(0)
    for k, (_, fits) in enumerate(KINDS):
        bits = bits.bitwiseOR(F.when(fits(cell), F.lit(1 << k)).otherwise(F.lit(0)))
    return F.when(cell.isNull() | (cell == ""), F.lit(ANY)).otherwise(bits)


def narrowest(cells: DataFrame) -> list[T.DataType]:
    """The type of every column from all of its cells, in one aggregate; text if none fits or there is no cell."""
    aggregates = []
    for k, c in enumerate(cells.columns):
        cell = F.trim(ref(c))
        aggregates += [F.bit_and(fitting(cell)).alias(f"fits{k}"), F.max(cell != "").alias(f"there{k}")]
    row = cells.agg(*aggregates).first()
    return [next((kind for bit, (kind, _) in enumerate(KINDS) if row[f"fits{k}"] >> bit & 1), T.StringType()) if row[f"there{k}"] else T.StringType() for k in range(len(cells.columns))]


def typed_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A delimited file, or a table's files, with the narrowest types that hold all cells; empty cells of columns that are not text are null."""
    cells = text_cells(spark, path, sep)
    if not cells.columns:
        return cells
    typed = []
    for c, kind in zip(cells.columns, narrowest(cells)):
        cell = ref(c) if isinstance(kind, T.StringType) else F.trim(ref(c)).try_cast(kind)
        typed.append(cell.alias(c))
    return cells.select(*typed)
