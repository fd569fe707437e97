"""Correlation, outliers, feature importance and time series."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.exprs import no_nan, pct, pearson, ref
from quarrylens.functions.types import columns_of
from quarrylens.model import NUMBERS, Chart, Dataset, FieldType
from quarrylens.operators.base import Analyzer, graded, info, register, rows_of, warning
from quarrylens.plans.passes import in_order, quartiles
from quarrylens.plans.shared import save, short_methods

TILE = 256  # columns; a tile pair is half a megabyte
TILES_A_SCAN = 64
HEATMAP_COLUMNS = 20
BROADCAST_VALUES = 100_000  # ranks of a text target that may be broadcast
MIN_ROWS = 10
HIGH = 0.8
EXPRESSION_COLUMNS = 12  # more pairs than these give are faster as one Gram matrix
TARGET_NAMES = ("target", "label", "class", "churn", "y")  # fixed values


# ---------------------------------------------------------------- correlation


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_a, column_b, r for all pairs in column order, over rows without a null in any column; r is null for a constant.

    Few columns: every pair is an aggregate of one scan. More: a Gram matrix in tiles.
    """
    columns = columns or columns_of(df.schema, *NUMBERS)
    rows = df.select(*[ref(c).cast("double").alias(c) for c in columns])
    if len(columns) > EXPRESSION_COLUMNS:
        return _gram(rows, columns)
    rows = rows.dropna("any")
    pairs = list(combinations(columns, 2))
    row = rows.agg(*[pearson(ref(a), ref(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(no_nan(F.col(f"r{i}"), row.schema[f"r{i}"].dataType), 4).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*structs)))


def _gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Products of centred columns, a tile of columns against another, added up by cell.

    One scan: every task centres the tiles of one share of the tile pairs on its own means
    and sends each cell once; what means of tasks are apart from those of the table is added
    to the cells.  Wider tables take more scans, not more memory.
    """
    spark = rows.sparkSession
    plain = rows.toDF(*[f"c{k}" for k in range(len(columns))])
    tiles = [(k, min(k + TILE, len(columns))) for k in range(0, len(columns), TILE)]
    pairs = [(a, b) for a in tiles for b in tiles if a <= b]
    parts = None
    for at in range(0, len(pairs), TILES_A_SCAN):
        own = plain.mapInArrow(_tile_products(pairs[at : at + TILES_A_SCAN]), "a int, b int, s double, n long, mean_a double, mean_b double, low double, high double")
        parts = own if parts is None else parts.unionByName(own)
    with short_methods(spark):
        parts = save(parts, "gram-parts")
    whole = parts.where("a = b").groupBy("a").agg((F.sum(F.col("n") * F.col("mean_a")) / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
    centre, constant = [0.0] * len(columns), [True] * len(columns)  # without rows all are constant
    for r in whole.collect():  # a row a column
        centre[r["a"]], constant[r["a"]] = r["mean"], r["low"] == r["high"]
    means = spark.createDataFrame(list(enumerate(map(float, centre))), "k int, mean double")
    of_a, of_b = (F.broadcast(means.select(F.col("k").alias(k), F.col("mean").alias(f"centre_{k}"))) for k in ("a", "b"))
    apart = F.col("n") * (F.col("mean_a") - F.col("centre_a")) * (F.col("mean_b") - F.col("centre_b"))
    cells = save(parts.join(of_a, "a").join(of_b, "b").groupBy("a", "b").agg(F.sum(F.col("s") + apart).alias("s")), "gram")
    size = cells.where("a = b").select(F.col("a").alias("k"), F.sqrt("s").alias("norm"))
    names = rows.sparkSession.createDataFrame([(k, c, constant[k]) for k, c in enumerate(columns)], "k int, name string, constant boolean").join(F.broadcast(size), "k", "left")  # a row a column
    one, other = (F.broadcast(names.select(F.col("k").alias(k), F.col("name").alias(f"column_{k}"), F.col("norm").alias(f"norm_{k}"), F.col("constant").alias(f"constant_{k}"))) for k in ("a", "b"))
    last = len(columns) - 1
    every = rows.sparkSession.range(last).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence((F.col("id") + 1).cast("int"), F.lit(last))).alias("b"))
    every = every.join(cells, ["a", "b"], "left").join(one, "a").join(other, "b")
    r = F.when(~F.col("constant_a") & ~F.col("constant_b"), F.try_divide("s", F.col("norm_a") * F.col("norm_b")))
    return every.select("column_a", "column_b", (F.round(no_nan(r, T.DoubleType()), 4) + F.lit(0.0)).alias("r"))  # no negative zero


def _complete(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows without a null."""
    there = None
    for column in batch.columns:
        if column.null_count:
            own = column.is_valid()
            there = own if there is None else pc.and_(there, own)
    return batch if there is None else batch.filter(there)


def _tile_products(pairs: list[tuple[tuple[int, int], tuple[int, int]]]):
    """Cells of a task: products of columns centred on their means in it, these means, and the bounds of column a."""
    wanted = sorted({tile for pair in pairs for tile in pair})

    def run(batches):
        total = [np.zeros((a[1] - a[0], b[1] - b[0])) for a, b in pairs]
        n, mean = 0, {t: np.zeros(t[1] - t[0]) for t in wanted}
        low, high = ({t: np.full(t[1] - t[0], end) for t in wanted} for end in (np.inf, -np.inf))
        for batch in map(_complete, batches):
            if not batch.num_rows:
                continue
            x, step, share = {}, {}, batch.num_rows / (n + batch.num_rows)
            for t in wanted:
                x[t] = np.stack([batch.column(k).to_numpy() for k in range(*t)])
                low[t], high[t] = np.minimum(low[t], x[t].min(1)), np.maximum(high[t], x[t].max(1))
                own = x[t].mean(1)
                x[t] -= own[:, None]
                step[t] = own - mean[t]
                mean[t] = mean[t] + step[t] * share
            for own, (a, b) in zip(total, pairs):
                own += x[a] @ x[b].T + n * share * np.outer(step[a], step[b])
            n += batch.num_rows
        for own, (a, b) in zip(total, pairs) if n else ():
            i, j = np.meshgrid(np.arange(*a, dtype=np.int32), np.arange(*b, dtype=np.int32), indexing="ij")
            kept = i <= j
            i, j = i[kept], j[kept]
            of_a = i - a[0]
            columns = [i, j, own[kept], np.full(len(i), n), mean[a][of_a], mean[b][j - b[0]], low[a][of_a], high[a][of_a]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "s", "n", "mean_a", "mean_b", "low", "high"])

    return run


def high_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlation(df, columns).where(F.abs("r") > HIGH)


class CorrelationAnalyzer(Analyzer):
    id, name, requires = "correlation", "Correlation", frozenset({"tabular", "numeric"})

    def run(self, dataset: Dataset):
        columns = [c for c in dataset.names(*NUMBERS) if c in dataset.data.columns]
        if len(columns) < 2:
            return self.skipped("fewer than two numeric columns")
        complete = dataset.data.select(*[ref(c) for c in columns]).dropna("any").limit(MIN_ROWS).count()
        if complete < MIN_ROWS:
            return self.skipped(f"fewer than {MIN_ROWS} rows without a null")
        rows = list(rows_of(correlation(dataset.data, columns)))
        high = sorted((r for r in rows if r["r"] is not None and abs(r["r"]) > HIGH), key=lambda r: (-abs(r["r"]), r["column_a"], r["column_b"]))
        found = [warning("high_correlation", "Strong correlation", f"{r['column_a']} and {r['column_b']} correlate with {r['r']}", **r) for r in high[:5]]
        charts = []
        if len(columns) <= HEATMAP_COLUMNS:
            cells = [{"x": a, "y": b, "r": round(r["r"], 3)} for r in rows if r["r"] is not None for a, b in ((r["column_a"], r["column_b"]), (r["column_b"], r["column_a"]))]
            varying = {c["x"] for c in cells}
            charts = [Chart("heatmap", "Correlation", cells + [{"x": c, "y": c, "r": 1.0} for c in columns if c in varying])]
        return self.result({"columns_analyzed": len(columns), "high_correlations": high}, found, charts)


# ---------------------------------------------------------------- outliers


def outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column with ten or more values and a positive interquartile range: count outside q +- 1.5 iqr, its share, bounds."""
    columns = columns or columns_of(df.schema, *NUMBERS)
    parts = {c: q for c, q in quartiles(df, columns).items() if q[0] >= MIN_ROWS and q[3] - q[1] > 0}
    schema = "column_name string, n_rows long, outlier_count long, outlier_pct double, lower_bound double, upper_bound double, q1 double, q3 double, iqr double"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    bounds = {c: (q[1] - 1.5 * (q[3] - q[1]), q[3] + 1.5 * (q[3] - q[1])) for c, q in parts.items()}
    x = lambda c: ref(c).cast("double")
    row = df.agg(*[F.count_if((x(c) < low) | (x(c) > high)).alias(f"n{i}") for i, (c, (low, high)) in enumerate(bounds.items())])
    structs = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(q[0]).cast("long").alias("n_rows"), F.col(f"n{i}").alias("outlier_count"), pct(F.col(f"n{i}"), F.lit(q[0])).alias("outlier_pct"),
            F.round(F.lit(bounds[c][0]), 4).alias("lower_bound"), F.round(F.lit(bounds[c][1]), 4).alias("upper_bound"),
            F.round(F.lit(q[1]), 4).alias("q1"), F.round(F.lit(q[3]), 4).alias("q3"), F.round(F.lit(q[3] - q[1]), 4).alias("iqr"),
        )
        for i, (c, q) in enumerate(parts.items())
    ]
    return row.select(F.inline(F.array(*structs)))


class Outliers(Analyzer):
    id, name, requires = "outliers", "Outliers", frozenset({"tabular", "numeric"})

    def run(self, dataset: Dataset):
        columns = [c for c in dataset.names(*NUMBERS) if c in dataset.data.columns]
        if not columns:
            return self.skipped("no numeric columns")
        rows = sorted(rows_of(outliers(dataset.data, columns)), key=lambda r: (-r["outlier_count"], r["column_name"]))
        rows = [r for r in rows if r["outlier_count"]]
        found = []
        for r in rows:
            step = graded(r["outlier_pct"], [(5, warning, "high_outlier_rate"), (1, info, "moderate_outliers")])
            if step:
                found.append(step[0](step[1], f"Outliers in {r['column_name']}", f"{r['outlier_count']} values ({r['outlier_pct']} %) lie outside the bounds", column=r["column_name"]))
        metrics = {"total_outliers": sum(r["outlier_count"] for r in rows), "columns_analyzed": len(columns), "columns_with_outliers": len(rows), "columns": rows}
        return self.result(metrics, found, [Chart("bar", "Outliers by column", [{"column": r["column_name"], "count": r["outlier_count"]} for r in rows[:15]])] if rows else [])


# ---------------------------------------------------------------- feature importance


def feature_importance(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """feature, score, importance: Pearson with the target over rows where both are there; text targets by alphabetical rank."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    features = features or [c for c in columns_of(df.schema, *NUMBERS) if c != target]
    encoded, y = encode(df, target, kinds[target].simpleString())
    row = encoded.agg(*[pearson(F.when(y.isNotNull(), ref(c).cast("double")), F.when(ref(c).isNotNull(), y)).alias(f"r{i}") for i, c in enumerate(features)])
    structs = [F.struct(F.lit(c).alias("feature"), F.round(F.when(~F.isnan(f"r{i}"), F.col(f"r{i}")), 4).alias("score"), F.round(F.abs(F.when(~F.isnan(f"r{i}"), F.col(f"r{i}"))), 4).alias("importance")) for i, c in enumerate(features)]
    return row.select(F.inline(F.array(*structs)))


def encode(df: DataFrame, target: str, kind: str) -> tuple[DataFrame, Column]:
    """The table and a numeric column for its target. A text target is joined with the ranks of its values, which come from sorted ranges."""
    if kind in ("string",) or kind.startswith(("char", "varchar")):
        names = df.select(ref(target).alias("_value")).where("_value IS NOT NULL").distinct()
        ranks = in_order(names, "_value").select("_value", F.col("place").alias("_rank"))
        few = ranks.count() <= BROADCAST_VALUES
        return df.join(F.broadcast(ranks) if few else ranks, ref(target) == F.col("_value"), "left"), F.col("_rank").cast("double")
    return df, ref(target).cast("int" if kind == "boolean" else "double").cast("double")


def find_target(dataset: Dataset) -> str | None:
    """A column with a telling name, else the last boolean or text column with at most 20 values."""
    columns = [f for f in dataset.fields if f.name in dataset.data.columns]
    named = next((f.name for f in columns if f.name.lower() in TARGET_NAMES), None)
    if named:
        return named
    candidates = [f.name for f in columns if f.dtype in (FieldType.BOOLEAN, FieldType.TEXT, FieldType.CATEGORICAL)]
    for c in reversed(candidates):
        if dataset.data.select(ref(c)).distinct().limit(21).count() <= 20:
            return c
    return None


class FeatureImportance(Analyzer):
    id, name, requires = "feature_importance", "Feature importance", frozenset({"tabular", "numeric"})

    def run(self, dataset: Dataset):
        target = find_target(dataset)
        features = [c for c in dataset.names(*NUMBERS) if c in dataset.data.columns and c != target]
        if not target or not features:
            return self.skipped("no target or no numeric features")
        rows = sorted((r for r in rows_of(feature_importance(dataset.data, target, features)) if r["importance"] is not None), key=lambda r: (-r["importance"], r["feature"]))[:5]
        if not rows:
            return self.skipped("no feature varies with the target")
        number = target in dataset.names(*NUMBERS)
        metrics = {"Target Column": target, "Target Type": "Regression" if number else "Classification"}
        metrics |= {f"#{i} Feature": f"{r['feature']} ({r['importance']:.4f})" for i, r in enumerate(rows, 1)}
        best = rows[0]
        if best["importance"] > 0.8:
            found = [warning("potential_target_leakage", "The target may leak", f"{best['feature']} correlates with {target} by {best['score']}", **best)]
        elif best["importance"] < 0.05:
            found = [info("low_predictive_power", "Weak features", f"No numeric feature correlates with {target} by 0.05", **best)]
        else:
            found = [info("strong_predictors_found", "Telling features", f"{best['feature']} tells most about {target}", **best)]
        return self.result(metrics, found, [Chart("bar", f"Correlation with {target}", rows)])


# ---------------------------------------------------------------- time series


def intervals(df: DataFrame, column: str) -> DataFrame:
    """interval_us, n: differences between neighbouring times in order, repeated times give zeros.

    Distinct times are sorted by ranges; a task goes through its range once, keeps the last
    time and counts differences, and its first and last time join it with its neighbours.
    """
    counted = df.select(_micros(df, column).alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("n"))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = save(counted.repartitionByRange(width, "t").sortWithinPartitions("t").mapInArrow(_steps, "interval_us long, n long, first long, last long"), "intervals")
    ends = sorted((r["first"], r["last"]) for r in found.where("first IS NOT NULL").select("first", "last").collect())  # a row a range
    across = df.sparkSession.createDataFrame([(b[0] - a[1], 1) for a, b in zip(ends, ends[1:])], "interval_us long, n long")
    return found.where("first IS NULL").select("interval_us", "n").unionByName(across).groupBy("interval_us").agg(F.sum("n").alias("n"))


def _steps(batches):
    """Differences within a sorted range with their counts, then one row with its ends."""
    none = lambda n: pa.nulls(n, pa.int64())
    first = last = None
    for batch in batches:
        t, n = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(t):
            continue
        steps = np.diff(t) if last is None else np.diff(t, prepend=last)
        first, last = t[0] if first is None else first, t[-1]
        values, counts = np.unique(steps, return_counts=True)
        repeated = int((n - 1).sum())
        if repeated:
            values, counts = np.append(values, 0), np.append(counts, repeated)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts), none(len(values)), none(len(values))], ["interval_us", "n", "first", "last"])
    if first is not None:
        yield pa.RecordBatch.from_arrays([none(1), none(1), pa.array([first]), pa.array([last])], ["interval_us", "n", "first", "last"])


def _micros(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    value = ref(column)
    if kind in ("date", "timestamp_ntz", "timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    if kind.startswith("time"):
        return F.unix_micros(F.concat(F.lit("1970-01-01 "), value.cast("string")).cast("timestamp"))
    return (F.extract(F.lit("DAY"), value) * 86_400_000_000 + F.extract(F.lit("HOUR"), value) * 3_600_000_000 + F.extract(F.lit("MINUTE"), value) * 60_000_000 + F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")


def time_series(df: DataFrame, column: str) -> DataFrame:
    """start_time, end_time, n_unique, main_interval_us (most frequent, ties to the shorter) of a time column."""
    span = df.agg(F.min(ref(column)).alias("start_time"), F.max(ref(column)).alias("end_time"), F.count_distinct(ref(column)).alias("n_unique"))
    main = intervals(df, column).agg(F.max_by("interval_us", F.struct("n", -F.col("interval_us"))).alias("main_interval_us"))
    return span.join(F.broadcast(main))


def interval_text(micros: int | None) -> str:
    if micros is None:
        return "none"
    seconds = micros / 1_000_000
    for size, unit in ((86_400, "d"), (3_600, "h"), (60, "min")):
        if seconds >= size and seconds % size == 0:
            return f"{seconds / size:g} {unit}"
    return f"{seconds:g} s"


class TimeSeries(Analyzer):
    id, name = "time_series", "Time series"

    def run(self, dataset: Dataset):
        columns = [c for c in dataset.names(FieldType.DATETIME) if c in dataset.data.columns]
        if not columns:
            return self.skipped("no time columns")
        metrics = {}
        for c in columns:
            r = next(rows_of(time_series(dataset.data, c)))
            if r["n_unique"]:
                metrics |= {f"{c} - Start": str(r["start_time"]), f"{c} - End": str(r["end_time"]), f"{c} - Unique Timestamps": str(r["n_unique"]), f"{c} - Main Interval": interval_text(r["main_interval_us"])}
        return self.result(metrics)


for _analyzer in (CorrelationAnalyzer(), Outliers(), FeatureImportance(), TimeSeries()):
    register(_analyzer)
