"""Missing values, duplicates, class balance, column statistics and histograms."""

from __future__ import annotations

from math import isfinite, isinf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.exprs import comparable, no_nan, pct, ref
from quarrylens.functions.types import columns_of
from quarrylens.model import NUMBERS, Chart, Dataset, FieldType
from quarrylens.operators.base import Analyzer, error, graded, info, register, rows_of, warning
from quarrylens.plans.heavy import most_frequent
from quarrylens.plans.passes import distinct_counts, per_column, quartiles
from quarrylens.plans.shared import save, short_methods

TOP_VALUES = 10
MAX_BINS = 20


# ---------------------------------------------------------------- missing values


def missing_values(df: DataFrame) -> DataFrame:
    """column_name, missing_count, missing_pct, total_rows; one scan for all columns."""
    found = per_column(df, df.columns, {"missing_count": lambda c: F.count_if(ref(c).isNull()), "total_rows": lambda c: F.count("*")})
    return found.select("column_name", "missing_count", pct(F.col("missing_count"), F.col("total_rows")).alias("missing_pct"), "total_rows")


def missing_findings(found: DataFrame) -> DataFrame:
    """column_name, severity, code of columns with missing values."""
    share = F.col("missing_pct")
    level = F.when(share > 50, F.lit("missing_values_high")).when(share > 20, "missing_values_moderate").when(share > 0, "missing_values_low")
    severity = F.when(share > 20, "warning").otherwise("info")
    graded_rows = found.select("column_name", severity.alias("severity"), level.alias("code")).where("code IS NOT NULL")
    empty = found.where("missing_count = total_rows AND total_rows > 0").select("column_name", F.lit("error").alias("severity"), F.lit("empty_columns").alias("code"))
    return graded_rows.unionByName(empty)


class MissingValues(Analyzer):
    id, name = "missing_values", "Missing values"

    def run(self, dataset: Dataset):
        rows = sorted(rows_of(missing_values(dataset.data)), key=lambda r: (-r["missing_pct"], r["column_name"]))
        cells, missing = sum(r["total_rows"] for r in rows), sum(r["missing_count"] for r in rows)
        found = []
        for r in rows:
            step = graded(r["missing_pct"], [(50, warning, "missing_values_high"), (20, warning, "missing_values_moderate"), (0, info, "missing_values_low")])
            if step:
                make, code = step
                found.append(make(code, f"Missing values in {r['column_name']}", f"{r['missing_pct']} % of {r['column_name']} is missing", column=r["column_name"], count=r["missing_count"]))
        empty = [r["column_name"] for r in rows if r["total_rows"] and r["missing_count"] == r["total_rows"]]
        if empty:
            found.append(error("empty_columns", "Empty columns", f"{len(empty)} columns hold nothing but nulls", columns=empty))
        metrics = {
            "total_missing": missing, "total_cells": cells, "overall_missing_pct": round(100 * missing / cells, 2) if cells else 0.0,
            "columns_with_missing": sum(r["missing_count"] > 0 for r in rows), "columns": rows,
        }
        bars = [{"column": r["column_name"], "pct": r["missing_pct"]} for r in rows if r["missing_pct"] > 0][:20]
        return self.result(metrics, found, [Chart("bar", "Missing values by column", bars)] if bars else [])


# ---------------------------------------------------------------- duplicates


def row_duplicates(df: DataFrame) -> DataFrame:
    """total_rows, unique_rows, duplicate_rows, duplicate_pct of whole rows, nulls equal.

    Rows are grouped by their columns, partially within each partition, so a row repeated very often is one row a task after that.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    grouped = df.groupBy(*[comparable(ref(c), types[c]).alias(f"c{i}") for i, c in enumerate(df.columns)]).agg(F.count("*").alias("_n"))
    counted = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows"))
    extra = F.col("total_rows") - F.col("unique_rows")
    return counted.select("total_rows", "unique_rows", extra.alias("duplicate_rows"), pct(extra, F.col("total_rows")).alias("duplicate_pct"))


def column_uniqueness(df: DataFrame) -> DataFrame:
    """column_name, n_unique (null counts), missing_count, is_id, is_constant."""
    found = distinct_counts(df, df.columns)
    whole = (F.col("n_unique") == F.col("total_rows")) & (F.col("missing_count") == 0)
    return found.select("column_name", "n_unique", "missing_count", whole.alias("is_id"), (F.col("n_unique") <= 1).alias("is_constant"))


class Duplicates(Analyzer):
    id, name = "duplicates", "Duplicates"

    def run(self, dataset: Dataset):
        whole = next(rows_of(row_duplicates(dataset.data)))
        columns = list(rows_of(column_uniqueness(dataset.data)))
        ids, constant = [c["column_name"] for c in columns if c["is_id"]], [c["column_name"] for c in columns if c["is_constant"]]
        found = []
        step = graded(whole["duplicate_pct"] if whole["duplicate_pct"] else float(whole["duplicate_rows"] > 0) * 1e-9, [(10, warning, "high_duplicate_rate"), (1, warning, "moderate_duplicate_rate"), (0, info, "low_duplicate_rate")])
        if step:
            found.append(step[0](step[1], "Repeated rows", f"{whole['duplicate_rows']} rows ({whole['duplicate_pct']} %) repeat another", count=whole["duplicate_rows"]))
        if ids:
            found.append(info("potential_id_columns", "Possible identifiers", f"Every value is different in: {', '.join(ids)}", columns=ids))
        if constant:
            found.append(warning("constant_columns", "Constant columns", f"One value at most in: {', '.join(constant)}", columns=constant))
        chart = Chart("pie", "Unique and repeated rows", [{"kind": "unique", "rows": whole["unique_rows"]}, {"kind": "repeated", "rows": whole["duplicate_rows"]}])
        return self.result(whole | {"potential_id_columns": ids, "constant_columns": constant}, found, [chart])


# ---------------------------------------------------------------- class balance


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, pct, imbalance_ratio over the non-null labels of a column."""
    counted = df.where(ref(label).isNotNull()).groupBy(ref(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    extremes = counted.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("total"))
    return counted.join(F.broadcast(extremes)).select("label", "n", pct(F.col("n"), F.col("total")).alias("pct"), F.round(F.col("most") / F.col("least"), 2).alias("imbalance_ratio"))


class ClassBalance(Analyzer):
    id, name, requires = "class_balance", "Class balance", frozenset({"labels"})

    def run(self, dataset: Dataset):
        classes = sorted((dataset.classes or {}).items(), key=lambda c: (-c[1], c[0]))
        if not classes:
            return self.skipped("no classes")
        total = sum(n for _, n in classes)
        least = classes[-1][1]
        ratio = classes[0][1] / least if least else float("inf")
        step = graded(ratio, [(10, warning, "severe_class_imbalance"), (3, warning, "moderate_class_imbalance"), (1.5, info, "slight_class_imbalance")])
        found = [step[0](step[1], "Unequal classes", f"The largest class has {ratio:.2f} times the rows of the smallest", ratio=ratio)] if step else []
        small = [c for c, n in classes if n < 0.01 * total]
        if small:
            found.append(warning("very_small_classes", "Very small classes", f"{len(small)} classes have under 1 % of the rows", classes=small))
        shares = [{"label": c, "count": n, "pct": round(100 * n / total, 2) if total else 0.0} for c, n in classes]
        metrics = {"num_classes": len(classes), "total_samples": total, "imbalance_ratio": round(ratio, 2), "largest_class": classes[0][0], "smallest_class": classes[-1][0], "distribution": shares}
        return self.result(metrics, found, [Chart("bar", "Rows by class", shares)])


# ---------------------------------------------------------------- column statistics


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: rows, missing, min, max, mean, median, std, q25, q75, zeros, negatives.

    Two passes: the moments of all columns in one scan, then order statistics.
    NaN is a value, not missing: min and max pass it over, mean and std do not.
    """
    columns = columns or columns_of(df.schema, *NUMBERS)
    types = {f.name: f.dataType for f in df.schema.fields}
    x = lambda c: ref(c).cast("double")
    moments = per_column(
        df, columns,
        {
            "total": lambda c: F.count("*"), "present": lambda c: F.count(ref(c)),
            "min_value": lambda c: F.min(no_nan(x(c), types[c])), "max_value": lambda c: F.max(no_nan(x(c), types[c])),
            "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)),
            "zeros": lambda c: F.count_if(x(c) == 0), "negatives": lambda c: F.count_if(x(c) < 0),
        },
    )
    parts = quartiles(df, columns)
    order = df.sparkSession.createDataFrame([(c, q[1], q[2], q[3]) for c, q in parts.items()], "column_name string, q25 double, median double, q75 double")
    std = F.when(F.col("present") == 1, F.lit(0.0)).otherwise(F.col("std"))
    return moments.join(F.broadcast(order), "column_name").select(
        "column_name", F.col("total").alias("total_rows"), (F.col("total") - F.col("present")).alias("missing_count"), "min_value", "max_value",
        F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round(std, 4).alias("std"), F.round("q25", 4).alias("q25"), F.round("q75", 4).alias("q75"), "zeros", "negatives",
    )


def text_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: rows, missing, shortest, longest and mean length in characters."""
    columns = columns or columns_of(df.schema, FieldType.TEXT)
    n = lambda c: F.char_length(ref(c))
    found = per_column(df, columns, {"total_rows": lambda c: F.count("*"), "missing_count": lambda c: F.count_if(ref(c).isNull()), "min_length": lambda c: F.min(n(c)), "max_length": lambda c: F.max(n(c)), "mean_length": lambda c: F.avg(n(c))})
    return found.select("column_name", "total_rows", "missing_count", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), F.round("mean_length", 1).alias("mean_length"))


def boolean_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per boolean column: true_count, false_count, true_pct of the non-null rows."""
    columns = columns or columns_of(df.schema, FieldType.BOOLEAN)
    found = per_column(df, columns, {"true_count": lambda c: F.count_if(ref(c)), "false_count": lambda c: F.count_if(~ref(c))})
    return found.select("column_name", "true_count", "false_count", pct(F.col("true_count"), F.col("true_count") + F.col("false_count")).alias("true_pct"))


def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """column_name, rank, value, n, pct of all rows: each column's k most frequent non-null values, ties to smaller values."""
    total = df.agg(F.count("*").alias("total_rows"))
    return most_frequent(df, columns, k).join(F.broadcast(total)).select("column_name", "rank", "value", "n", pct(F.col("n"), F.col("total_rows")).alias("pct"))


def histograms(df: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> DataFrame:
    """column_name, bin, n, range_start, range_end of every column: equal widths over [min, max], the last bin closed, empty bins kept; NaN is left out.

    As many bins as distinct values, ``max_bins`` at most; a column without values or with
    infinite ones has no bins.  Two scans whatever the columns: bounds with up to
    ``max_bins`` values of each task, and counts by (column, bin), both in arrays.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    xs = df.select(*[no_nan(ref(c).cast("double"), types[c]).alias(f"c{k}") for k, c in enumerate(columns)])
    bounds = {}
    if columns:
        with short_methods(spark):
            found = save(xs.mapInArrow(_bounds(max_bins), "k int, low double, high double, vals array<double>"), "bounds")
        different = found.select("k", F.explode("vals").alias("x")).groupBy("k").agg(F.count_distinct("x").alias("n"))
        whole = found.groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(different, "k")
        bounds = {r["k"]: (r["low"], r["high"], min(r["n"], max_bins)) for r in whole.collect()}  # a row a column
    there = [k for k in sorted(bounds) if isfinite(bounds[k][0]) and isfinite(bounds[k][1])]

    edges, places = [], []
    for k in there:
        low, high, bins = bounds[k]
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = high / bins - low / bins if isinf(high - low) else (high - low) / bins
        places.append((k, low, width, bins))
        edges += [(k, columns[k], b, low + b * width, high if b == bins - 1 else low + (b + 1) * width) for b in range(bins)]
    every = spark.createDataFrame(edges, "position int, column_name string, bin long, range_start double, range_end double")
    if not there:
        return every.select("column_name", "bin", F.lit(0).cast("long").alias("n"), "range_start", "range_end")
    with short_methods(spark):
        parts = save(xs.select(*[f"c{k}" for k in there]).mapInArrow(_bin_counts(places), "position int, bin long, n long"), "bins")
    counted = parts.groupBy("position", "bin").agg(F.sum("n").alias("n"))
    return every.join(F.broadcast(counted), ["position", "bin"], "left").select("column_name", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "range_start", "range_end")


def _values(column: pa.Array) -> np.ndarray:
    """Neither null nor NaN, and no negative zero."""
    x = column.drop_null().to_numpy()
    return x[~np.isnan(x)] + 0.0


def _bounds(most: int):
    """By column of a task: smallest and largest value, and its different values, ``most`` of them if there are as many."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for k, column in enumerate(batch.columns):
                x = _values(column)
                if not len(x):
                    continue
                own = found.setdefault(k, [np.inf, -np.inf, x[:0]])
                own[0], own[1] = min(own[0], x.min()), max(own[1], x.max())
                if len(own[2]) < most:
                    own[2] = np.union1d(own[2], pc.unique(pa.array(x)).to_numpy())[:most]
        if found:
            low, high, values = ([own[i] for own in found.values()] for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(values, pa.list_(pa.float64()))], ["k", "low", "high", "vals"])

    return run


def _bin_counts(places: list[tuple[int, float, float, int]]):
    """Values of a task by column and bin; places: (position, low, width, bins) in order of the columns."""

    def run(batches):
        total = [np.zeros(bins, np.int64) for *_, bins in places]
        for batch in batches:
            for own, column, (_, low, width, bins) in zip(total, batch.columns, places):
                x = _values(column)
                with np.errstate(over="ignore"):
                    guess = np.minimum(np.floor((x - low) / width), bins - 1)
                    settled = guess - (x < low + guess * width) + ((x >= low + (guess + 1) * width) & (guess < bins - 1))
                own += np.bincount(settled.astype(np.int64), minlength=bins)
        for own, (k, *_) in zip(total, places):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(np.arange(len(own))), pa.array(own)], ["position", "bin", "n"])

    return run


def histogram(df: DataFrame, column: str, max_bins: int = MAX_BINS) -> DataFrame:
    """bin, n, range_start, range_end of one column."""
    return histograms(df, [column], max_bins).select("bin", "n", "range_start", "range_end")


def high_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_unique, total_rows, flagged: over 50 values and over 90 % of the rows different."""
    found = distinct_counts(df, columns)
    over = (F.col("n_unique") > 50) & (F.col("n_unique") / F.greatest(F.col("total_rows"), F.lit(1)) > 0.9)
    return found.select("column_name", "n_unique", "total_rows", over.alias("flagged"))


class ColumnStats(Analyzer):
    id, name = "column_stats", "Column statistics"

    def run(self, dataset: Dataset):
        df = dataset.data
        present = [f for f in dataset.fields if f.name in df.columns]
        numbers = [f.name for f in present if f.dtype in NUMBERS]
        texts = [f.name for f in present if f.dtype in (FieldType.TEXT, FieldType.CATEGORICAL)]
        booleans = [f.name for f in present if f.dtype == FieldType.BOOLEAN]
        columns: dict[str, dict] = {f.name: {"dtype": f.dtype.value} for f in present}
        for r in rows_of(distinct_counts(df, [f.name for f in present])) if present else ():
            total = r["total_rows"]
            columns[r["column_name"]] |= {
                "total": total, "missing": r["missing_count"], "missing_pct": round(100 * r["missing_count"] / total, 2) if total else 0.0,
                "unique": r["n_unique"], "unique_pct": round(100 * r["n_unique"] / total, 2) if total else 0.0,
            }
        for make, names in ((numeric_stats, numbers), (boolean_stats, booleans), (text_stats, [f.name for f in present if f.dtype == FieldType.TEXT])):
            for r in rows_of(make(df, names)) if names else ():
                columns[r.pop("column_name")] |= {k: v for k, v in r.items() if k not in ("total_rows", "missing_count")}
        for r in rows_of(top_values(df, texts)) if texts else ():
            columns[r["column_name"]].setdefault("top_values", []).append({"value": r["value"], "count": r["n"], "pct": r["pct"]})
        found = []
        for c in texts:
            stats = columns[c]
            if stats.get("unique", 0) > 50 and stats["unique"] / max(stats["total"], 1) > 0.9:
                found.append(info("high_cardinality", f"Many different values in {c}", f"{stats['unique']} of {stats['total']} values differ", column=c))
        bars: dict[str, list[dict]] = {}
        for r in rows_of(histograms(df, numbers).orderBy("column_name", "bin")) if numbers else ():
            bars.setdefault(r["column_name"], []).append({"bin": f"{r['range_start']:.2f}", "count": r["n"], "range_start": r["range_start"], "range_end": r["range_end"]})
        charts = [Chart("histogram", c, bars[c]) for c in numbers if c in bars]
        kinds = {"num_columns": len(present), "numeric_columns": len(numbers), "categorical_columns": sum(f.dtype == FieldType.CATEGORICAL for f in present), "text_columns": sum(f.dtype == FieldType.TEXT for f in present)}
        return self.result(kinds | {"columns": columns}, found, charts)


for _analyzer in (MissingValues(), Duplicates(), ClassBalance(), ColumnStats()):
    register(_analyzer)

