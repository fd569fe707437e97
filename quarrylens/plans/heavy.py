"""Most frequent values by a sketch and a recount.

Every task keeps a bounded number of counters a column (Misra-Gries): when there are more,
all give up the same count, and what was given up is added to the task's error.  Sketches
are added up by value.  A value's true count lies between its counters and its counters plus
all errors, and a value without counters has at most all errors.  So the values whose upper
bound reaches the k-th largest lower bound are all that can be among the k most frequent;
only these are counted again, exactly, in a second scan.  Where no counter was given up the
sketch is exact already, and where the k-th count does not exceed the error the column is
counted value by value.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions.exprs import ref, text_of
from quarrylens.plans.passes import value_counts
from quarrylens.plans.shared import save

COUNTERS = 2_000  # a column and task keeps, some kilobytes to a task's sketch
SKETCH = pa.schema([("position", pa.int32()), ("value", pa.string()), ("n", pa.int64()), ("error", pa.int64())])


class Counters:
    """Misra-Gries counters of one column; up to twice as many between cuts."""

    def __init__(self, most: int):
        self.most, self.error, self.held = most, 0, Counter()

    def add(self, values: list[str], counts: list[int]) -> None:
        self.held.update(dict(zip(values, counts)))
        if len(self.held) > 2 * self.most:
            self.cut()

    def cut(self) -> None:
        """Gives up the count of the first counter that has no place, from all."""
        if len(self.held) > self.most:
            given = sorted(self.held.values(), reverse=True)[self.most]
            self.held = Counter({v: n - given for v, n in self.held.items() if n > given})
            self.error += given


def sketches(df: DataFrame, columns: list[str], counters: int = COUNTERS) -> DataFrame:
    """(position, value, n, error): counters of every task; a row without a value has a task's error in a column. Nulls are left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*[text_of(ref(c), types[c]).alias(f"c{k}") for k, c in enumerate(columns)])

    def run(batches):
        own = [Counters(counters) for _ in columns]
        for batch in batches:
            for column, held in zip(batch.columns, own):
                found = pc.value_counts(column.drop_null())
                held.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        for k, held in enumerate(own):
            held.cut()
            rows = [(k, v, n, 0) for v, n in held.held.items()] + [(k, None, 0, held.error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SKETCH)], schema=SKETCH)

    return texts.mapInArrow(run, "position int, value string, n long, error long")


def most_frequent(df: DataFrame, columns: list[str], k: int, counters: int = COUNTERS) -> DataFrame:
    """(position, column_name, rank, value, n): each column's k most frequent non-null values, ties to smaller values; exact."""
    found = save(sketches(df, columns, counters).groupBy("position", "value").agg(F.sum("n").alias("n"), F.sum("error").alias("error")), "sketch")
    error = {r["position"]: r["error"] for r in found.where("value IS NULL").collect()}  # a row a column
    sketch = found.where("value IS NOT NULL").select("position", "value", "n")
    by_count = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    leading = sketch.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)
    least = {r["position"]: r["least"] for r in leading.groupBy("position").agg(F.min("n").alias("least"), F.max("rank").alias("ranks")).where(F.col("ranks") == k).collect()}

    whole = [c for c in range(len(columns)) if not error.get(c)]
    open_ = [c for c in range(len(columns)) if error.get(c)]
    parts = [sketch.where(F.col("position").isin(whole))] if whole else []
    if open_:
        bound = F.element_at(F.create_map(*[F.lit(x) for c in open_ for x in (c, max(least.get(c, 0) - error[c], 0))]), F.col("position"))
        wanted = sketch.where(F.col("position").isin(open_)).where(F.col("n") >= bound).select("position", "value")
        counted = save(_recounted(df, columns, open_, wanted), "recount")
        sizes = counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") == k).select("position", "n").collect()
        settled = [r["position"] for r in sizes if r["n"] > error[r["position"]]]
        if settled:
            parts.append(counted.where(F.col("position").isin(settled)))
        rest = [c for c in open_ if c not in settled]
        if rest:
            place = F.element_at(F.array(*[F.lit(c) for c in rest]), F.col("position") + 1)
            parts.append(value_counts(df, [columns[c] for c in rest]).where("value IS NOT NULL").select(place.alias("position"), "value", "n"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1)
    return both.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k).select("position", name.alias("column_name"), "rank", "value", "n")


def _recounted(df: DataFrame, columns: list[str], positions: list[int], wanted: DataFrame) -> DataFrame:
    """Exact counts of the wanted (position, value); of these there are ``counters`` a column and task at most, and mostly a few."""
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("position"), text_of(ref(columns[c]), types[columns[c]]).alias("value")) for c in positions])))
    few = F.broadcast(wanted) if wanted.count() <= 100_000 else wanted
    return long.join(few, ["position", "value"], "left_semi").groupBy("position", "value").agg(F.count("*").alias("n"))
