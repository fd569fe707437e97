"""Semantics of the tabular analyzers, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.engine import example_rows, profile
from quarrylens.functions.exprs import blank
from quarrylens.operators import relations, tables, texts
from quarrylens.plans import passes
from quarrylens.plans.passes import distinct_counts, order_statistics, quartiles


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_missing_values_counts_nulls_but_not_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (None, 2.0, None)], "a int, b double, c string")
    found = {r["column_name"]: (r["missing_count"], r["missing_pct"], r["total_rows"]) for r in rows(tables.missing_values(df))}
    assert found == {"a": (1, 50.0, 2), "b": (0, 0.0, 2), "c": (2, 100.0, 2)}


def test_missing_values_of_an_empty_table(spark):
    assert rows(tables.missing_values(spark.createDataFrame([], "a int"))) == [{"column_name": "a", "missing_count": 0, "missing_pct": 0.0, "total_rows": 0}]


@pytest.mark.parametrize(("missing", "code"), [(0, None), (1, "missing_values_low"), (20, "missing_values_low"), (21, "missing_values_moderate"), (50, "missing_values_moderate"), (51, "missing_values_high")])
def test_missing_thresholds_are_strict(spark, missing, code):
    df = spark.range(100).select(F.when(F.col("id") >= missing, F.col("id")).alias("a"))
    assert [r["code"] for r in rows(tables.missing_findings(tables.missing_values(df)))] == ([code] if code else [])


def test_row_duplicates_with_nulls_maps_and_repeats(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (None, None), (None, None), (2, {})], "a int, m map<string,int>")
    assert rows(tables.row_duplicates(df)) == [{"total_rows": 5, "unique_rows": 3, "duplicate_rows": 2, "duplicate_pct": 40.0}]


def test_distinct_counts_agree_between_forms(spark):
    data = [(i % 3 if i % 4 else None, str(i % 5), i) for i in range(40)]
    narrow = spark.createDataFrame(data, "a int, b string, c int")
    wide = narrow.select("*", *[F.col("a").alias(f"a{k}") for k in range(9)])
    a = {r["column_name"]: r["n_unique"] for r in rows(distinct_counts(narrow, narrow.columns))}
    b = {r["column_name"]: r["n_unique"] for r in rows(distinct_counts(wide, wide.columns))}
    assert a == {"a": 4, "b": 5, "c": 40} and {k: b[k] for k in a} == a and b["a3"] == 4


def test_order_statistics_against_sorting(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 500, 3001):
        values = [rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        ranks = sorted({0, n - 1, n // 2, n // 3})
        want = sorted(values)
        assert order_statistics(df, {"v": ranks}) == {"v": {k: want[k] for k in ranks}}


@pytest.mark.parametrize(("accuracy", "rows"), [(10_000, 100), (20, 10), (20, 1_000_000)])
def test_brackets_are_narrowed_and_mended(spark, monkeypatch, accuracy, rows):
    monkeypatch.setattr(passes, "ACCURACY", accuracy)
    monkeypatch.setattr(passes, "BRACKET_ROWS", rows)
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), float("nan")]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values, key=lambda v: (v != v, 0 if v != v else v))
    ranks = [0, 17, 1000, 1999, 2000, 2500, 3999]
    got = order_statistics(df, {"v": ranks})["v"]
    assert all(got[k] == want[k] or (got[k] != got[k] and want[k] != want[k]) for k in ranks)


def test_quartiles_nearest_and_median_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert quartiles(df, ["v"]) == {"v": (4, 2.0, 2.5, 3.0)}
    assert quartiles(df.limit(0), ["v"]) == {"v": (0, None, None, None)}


def test_numeric_stats_of_one_row_and_nan(spark):
    one = rows(tables.numeric_stats(spark.createDataFrame([(5.0,)], "v double")))[0]
    assert (one["std"], one["median"], one["q25"]) == (0.0, 5.0, 5.0)
    nan = rows(tables.numeric_stats(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")))[0]
    assert (nan["min_value"], nan["max_value"], nan["missing_count"]) == (1.0, 1.0, 1) and math.isnan(nan["mean"])


def test_histogram_counts_every_value_once(spark):
    rng = random.Random(2)
    values = [rng.uniform(-3, 9) for _ in range(400)] + [9.0, -3.0]
    found = sorted(rows(tables.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v")), key=lambda r: r["bin"])
    assert sum(r["n"] for r in found) == len(values) and len(found) == 20
    for r in found[:-1]:
        assert r["n"] == sum(r["range_start"] <= v < r["range_end"] for v in values)
    assert rows(tables.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v")) == [{"bin": 0, "n": 2, "range_start": 3.5, "range_end": 4.5}]
    assert rows(tables.histogram(spark.createDataFrame([(None,)], "v double"), "v")) == []


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert [(r["rank"], r["value"], r["n"], r["pct"]) for r in sorted(rows(tables.top_values(df, ["v"])), key=lambda r: r["rank"])] == [(1, "c", 2, 40.0), (2, "a", 1, 20.0), (3, "b", 1, 20.0)]


def test_correlation_forms_agree_and_constants_are_null(spark):
    rng = random.Random(3)
    data = [tuple(rng.gauss(0, 1) for _ in range(13)) + (1.0,) for _ in range(60)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(14)))
    wide = {(r["column_a"], r["column_b"]): r["r"] for r in rows(relations.correlation(df))}
    narrow = {(r["column_a"], r["column_b"]): r["r"] for r in rows(relations.correlation(df, ["c0", "c5", "c12", "c13"]))}
    assert all(wide[k] == pytest.approx(v) if v is not None else wide[k] is None for k, v in narrow.items())
    assert narrow[("c0", "c13")] is None


def test_outliers_need_ten_rows_and_a_spread(spark):
    nine = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "a double, b double")
    assert rows(relations.outliers(nine)) == []
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)] + [(1000.0, 1.0)], "a double, b double")
    assert [(r["column_name"], r["outlier_count"]) for r in rows(relations.outliers(df))] == [("a", 1)]


def test_feature_importance_of_a_text_target(spark):
    df = spark.createDataFrame([("a", 0.0, None), ("b", 1.0, 1.0), ("c", 2.0, 2.0), (None, 9.0, 5.0)], "t string, x double, y double")
    assert {r["feature"]: r["score"] for r in rows(relations.feature_importance(df, "t"))} == {"x": 1.0, "y": 1.0}


def test_words_and_blanks(spark):
    df = spark.createDataFrame([("a  b ",), ("",), (" \t ",), ("x",), (None,)], "v string")
    r = rows(texts.text_analysis(df))[0]
    assert (r["max_words"], r["blank_count"], r["blank_pct"]) == (4, 2, 50.0)
    assert [x[0] for x in spark.createDataFrame([("\u2003",), ("\u2003a",)], "v string").select(blank(F.col("v"))).collect()] == [True, False]


def test_time_series_intervals(spark):
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(hours=h) for h in (0, 1, 2, 2, 4, 5)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t timestamp")
    gaps = {r["interval_us"]: r["n"] for r in rows(relations.intervals(df, "t"))}
    assert gaps == {3_600_000_000: 3, 0: 1, 7_200_000_000: 1}
    assert rows(relations.time_series(df, "t"))[0]["main_interval_us"] == 3_600_000_000
    many = spark.range(1000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("t"))
    assert {r["interval_us"]: r["n"] for r in rows(relations.intervals(many, "t"))} == {60_000_000: 999}
    assert rows(relations.time_series(df.limit(0), "t"))[0]["main_interval_us"] is None


def employees(spark):
    rng = random.Random(4)
    names, teams = ["Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"], ["a", "b", "c", "d", "e"]
    people = [(i, rng.choice(names), None if rng.random() < 0.02 else rng.randint(22, 65), rng.gauss(75_000, 20_000), rng.choice(teams), rng.random() < 0.8, rng.gauss(50, 15)) for i in range(1, 501)]
    return spark.createDataFrame(people + people[:10], "id int, name string, age int, salary double, department string, is_active boolean, score double")


def test_profile_of_a_small_staff_table(spark):
    report = profile(employees(spark))
    results = {r.analyzer_id: r for r in report.results}
    assert all(r.status in ("success", "skipped") for r in report.results), [r.error_message for r in report.results]
    assert results["duplicates"].metrics["duplicate_rows"] == 10 and results["duplicates"].metrics["duplicate_pct"] == 1.96
    assert "moderate_duplicate_rate" in {f.code for f in results["duplicates"].findings}
    assert results["duplicates"].metrics["potential_id_columns"] == []
    assert set(report.dataset.classes) == {"Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"}
    assert results["feature_importance"].metrics["Target Column"] == "is_active"
    assert 24.5 <= report.health.score <= 100 and len(report.examples) == 20


def test_profile_of_an_empty_table(spark):
    report = profile(spark.createDataFrame([], "a int, b string"))
    assert all(r.status in ("success", "skipped") for r in report.results), [r.error_message for r in report.results]


def test_example_rows_are_whole_and_in_order(spark):
    df = spark.range(300).repartition(5).select((F.lit(299) - F.col("id")).alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    data = profile(df).dataset
    shown = example_rows(data, ["key"])
    assert shown.schema == df.schema
    assert [tuple(r) for r in shown.collect()] == [(k, dt.date(2024, 1, 1) + dt.timedelta(days=299 - k)) for k in range(20)]
    assert example_rows(data).count() == 20


def test_wide_correlation_is_one_scan_and_keeps_its_digits(spark):
    """Values far from zero in partitions whose means are far apart, a constant and a null."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    base = spark.range(3000, numPartitions=5).selectExpr("id", *[f"1e9 + id % {7 + k} + CASE WHEN id > 1500 THEN {k} * 1e3 ELSE 0 END AS x{k}" for k in range(13)], "CASE WHEN id <> 5 THEN id * 1.0D END AS gap", "2.0D AS same")
    names = base.columns
    found = {(r["column_a"], r["column_b"]): r["r"] for r in relations.correlation(base.mapInArrow(counted, base.schema), names).collect()}
    assert runs.value == 3000
    x = base.dropna().toPandas()[names].to_numpy() - np.array([1e9 if c[0] == "x" else 0 for c in names])
    with np.errstate(all="ignore"):
        plain = np.corrcoef(x.T)
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            assert found[a, names[j]] is None if "same" in (a, names[j]) else abs(found[a, names[j]] - plain[i, j]) < 1e-4


def test_histograms_are_two_scans_and_find_late_values(spark):
    """A value that only the last partition has, few and many values, nulls, NaN, infinity, a constant and the widest range."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    base = spark.range(2000, numPartitions=4).selectExpr(
        "id % 7 + CASE WHEN id = 1999 THEN 93 ELSE 0 END AS late", "id * 0.1D AS many", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN double('NaN') ELSE double(id % 2) END AS gaps",
        "CASE WHEN id = 9 THEN double('Infinity') ELSE 1.0D END AS endless", "2.5D AS same", "CASE WHEN id = 0 THEN -1e308D WHEN id = 1 THEN 1e308D ELSE 0.0D END AS wide", "CAST(NULL AS DOUBLE) AS none",
    )
    found: dict[str, list] = {}
    for r in tables.histograms(base.mapInArrow(counted, base.schema), base.columns).orderBy("column_name", "bin").collect():
        found.setdefault(r["column_name"], []).append(r["n"])
    assert runs.value == 4000
    assert set(found) == {"late", "many", "gaps", "same", "wide"}
    assert found["late"] == [1999, 0, 0, 0, 0, 0, 0, 1] and found["gaps"] == [333, 333] and found["same"] == [2000] and found["wide"] == [1, 1998, 1]
    assert found["many"] == [100] * 20
