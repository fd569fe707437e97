"""Passes over a table. Each is one scan with partial aggregation, and its result is small.

Exact order statistics never sort the table: approximate quantiles just below and above a
wanted rank bracket it, one scan counts the rows below and inside every bracket, and only
rows inside are grouped and ordered, some 1 in 2,500.  A bracket of over ``BRACKET_ROWS``
rows is narrowed by quantiles of the rows inside it first.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylens.functions.exprs import comparable, ref, text_of
from quarrylens.plans.shared import save

ACCURACY = 10_000  # of approximate quantiles: ranks are off by 1 in as many
MARGIN = 2 / ACCURACY
BRACKET_ROWS = 1_000_000


def unpivot(row: DataFrame, columns: list[str], parts: dict[str, list[str]]) -> DataFrame:
    """A one-row table of per-column aggregates to one row per column, in column order.

    parts: output name -> aggregate names, one per column.
    """
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), *[ref(names[i]).alias(out) for out, names in parts.items()]) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*structs)))


def per_column(df: DataFrame, columns: list[str], aggregates: dict[str, "callable"]) -> DataFrame:
    """position, column_name and one value per aggregate (column -> Column), all columns in one scan."""
    if not columns:
        raise ValueError("no columns")
    names = {out: [f"{out}_{i}" for i in range(len(columns))] for out in aggregates}
    row = df.agg(*[make(c).alias(names[out][i]) for out, make in aggregates.items() for i, c in enumerate(columns)])
    return unpivot(row, columns, names)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column_name, value, n): every distinct value of every column as text, null too."""
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), text_of(ref(c), types[c]).alias("value")) for i, c in enumerate(columns)])))
    return long.groupBy("position", "column_name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column_name, n_unique, missing_count, total_rows); null counts as one value.

    One scan and one grouping for all columns.  Whole numbers, dates and times are grouped by
    64 neighbours, whose presence is a bit each, so that dense columns shuffle one row where
    they have up to 64 values, and none shuffles more rows than values.  Other numbers are
    grouped as they are, and everything else as text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for k, c in enumerate(columns):
        whole, number, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(types[c], T.IntegralType):
            whole = ref(c).cast("long")
        elif isinstance(types[c], T.DateType):
            whole = F.unix_date(ref(c)).cast("long")
        elif isinstance(types[c], T.TimestampType):
            whole = F.unix_micros(ref(c))
        elif isinstance(types[c], (T.FloatType, T.DoubleType)):
            number = ref(c).cast("double")
        else:
            text = F.to_json(comparable(ref(c), types[c])) if isinstance(types[c], T.MapType) else text_of(ref(c), types[c])
        cells.append(F.struct(F.lit(k).alias("position"), F.shiftright(whole, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), whole.bitwiseAND(F.lit(63)).cast("int")).alias("bit"), number.alias("number"), text.alias("text")))
    grouped = df.select(F.inline(F.array(*cells))).groupBy("position", "word", "number", "text").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    missing = F.col("word").isNull() & F.col("number").isNull() & F.col("text").isNull()
    counted = grouped.groupBy("position").agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(1))).alias("n_unique"), F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing_count"), F.sum("n").alias("total_rows"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column_name string")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return names.join(F.broadcast(counted), "position", "left").select("position", "column_name", *map(zero, ("n_unique", "missing_count", "total_rows")))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with ``place``, from 0 in ascending order of the columns: sorted by ranges, each counted on from those before it. Saved once."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = save(rows.repartitionByRange(width, *columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_id", 33).cast("int")  # the id is the partition, then the place in it
    before, starts = 0, []
    for r in sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return sorted_rows.join(start, part == F.col("_part")).withColumn("place", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def nearest_rank(n: int, q: float) -> int:
    """Position, from 0, of the nearest-rank quantile."""
    return floor((n - 1) * q + 0.5)


@dataclass
class Bracket:
    """Closed bounds around the value of a rank; None is open. ``outer`` is a counted bracket that holds the rank, if it was narrowed."""

    column: int
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    rows: int = 0
    outer: "Bracket | None" = None

    def holds(self, x: Column) -> Column:
        test = x.isNotNull()
        if self.low is not None:
            test &= x >= F.lit(self.low)
        return test if self.high is None else test & (x <= F.lit(self.high))


def approximate(df: DataFrame, wanted: list[tuple[Column, list[float]]]) -> list[tuple[int, list[float]]]:
    """(non-null rows, approximate quantiles) of each expression at its fractions, in one scan."""
    clamp = lambda f: min(1.0, max(0.0, f))
    row = df.agg(*[a for i, (x, at) in enumerate(wanted) for a in (F.count(x).alias(f"n{i}"), F.percentile_approx(x, [clamp(f) for f in at], ACCURACY).alias(f"p{i}"))]).first()
    return [(row[2 * i], list(row[2 * i + 1] or [])) for i in range(len(wanted))]


def around(fraction: float) -> list[float]:
    return [fraction - MARGIN, fraction + MARGIN]


def settled(df: DataFrame, xs: list[Column], open_: list[Bracket]) -> list[Bracket]:
    """Brackets that hold their rank and few enough rows, with the rows below and inside them counted; two scans a round, mostly one."""
    done = []
    while open_:
        row = df.agg(*[a for b in open_ for a in (F.count_if(xs[b.column] < F.lit(b.low)) if b.low is not None else F.lit(0).cast("long"), F.count_if(b.holds(xs[b.column])))], F.lit(1)).first()
        wide, missed = [], []
        for k, b in enumerate(open_):
            b.below, b.rows = row[2 * k], row[2 * k + 1]
            inside = b.below <= b.rank < b.below + b.rows
            if b.outer and (not inside or b.rows >= b.outer.rows):  # narrowed past the rank, or no narrower for equal values
                done.append(b.outer)
            elif not inside:
                missed.append(Bracket(b.column, b.rank, None, b.low) if b.rank < b.below else Bracket(b.column, b.rank, b.high, None))
            elif b.rows > BRACKET_ROWS and b.low != b.high:
                wide.append(b)
            else:
                done.append(b)
        inner = approximate(df, [(F.when(b.holds(xs[b.column]), xs[b.column]), around((b.rank - b.below) / max(b.rows - 1, 1))) for b in wide]) if wide else []
        open_ = missed + [Bracket(b.column, b.rank, low, high, outer=b) for b, (_, (low, high)) in zip(wide, inner)]
    return done


def values_at(df: DataFrame, xs: list[Column], brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """{(column, rank): value} for brackets that hold their ranks."""
    brackets = settled(df, xs, brackets)
    out = {(b.column, b.rank): b.low for b in brackets if b.low is not None and b.low == b.high}
    rest = [b for b in brackets if (b.column, b.rank) not in out]
    if not rest:
        return out
    places = [F.when(b.holds(xs[b.column]), F.struct(F.lit(k).alias("bracket"), xs[b.column].alias("value"))) for k, b in enumerate(rest)]
    inside = df.select(F.inline(F.array_compact(F.array(*places)))).groupBy("bracket", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bracket").orderBy("value"))
    hit = F.element_at(F.array(*[F.lit(b.rank - b.below).cast("long") for b in rest]), F.col("bracket") + 1)
    found = inside.withColumn("upto", upto).where((F.col("upto") > hit) & (F.col("upto") - F.col("n") <= hit))
    for r in found.select("bracket", "value").collect():
        out[rest[r["bracket"]].column, rest[r["bracket"]].rank] = r["value"]
    return out


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """{column: {rank: value}}: exact values at positions from 0 among the sorted non-null values, as doubles."""
    columns = [c for c, own in ranks.items() if own]
    if not columns:
        return {}
    xs = [ref(c).cast("double") for c in columns]
    sizes = df.agg(*[F.count(x) for x in xs]).first()
    found = approximate(df, [(x, [f for r in ranks[c] for f in around(r / max(n - 1, 1))]) for c, x, n in zip(columns, xs, sizes)])
    at = values_at(df, xs, [Bracket(i, r, found[i][1][2 * k], found[i][1][2 * k + 1]) for i, c in enumerate(columns) for k, r in enumerate(ranks[c])])
    return {c: {r: at[i, r] for r in ranks[c]} for i, c in enumerate(columns)}


def quartiles(df: DataFrame, columns: list[str], value: "callable" = None) -> dict[str, tuple[int, float | None, float | None, float | None]]:
    """{column: (non-null rows, q25, median, q75)}: quartiles at the nearest rank, the median between the middle two."""
    if not columns:
        return {}
    make = value or (lambda c: ref(c).cast("double"))
    xs = [make(c) for c in columns]
    found = approximate(df, [(x, [f for q in (0.25, 0.5, 0.75) for f in around(q)]) for x in xs])
    ranks = {i: (nearest_rank(n, 0.25), (n - 1) // 2, n // 2, nearest_rank(n, 0.75)) for i, (n, _) in enumerate(found) if n}
    at = values_at(df, xs, [Bracket(i, rank, found[i][1][2 * k], found[i][1][2 * k + 1]) for i, own in ranks.items() for rank, k in {own[0]: 0, own[3]: 2, own[1]: 1, own[2]: 1}.items()])
    out = {}
    for i, c in enumerate(columns):
        if i not in ranks:
            out[c] = (0, None, None, None)
            continue
        low, a, b, high = (at[i, rank] for rank in ranks[i])
        out[c] = (found[i][0], low, (a + b) / 2, high)
    return out
