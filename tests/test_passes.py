"""Shared passes against plain versions: heavy hitters, histograms, distinct counts, intervals, correlation, ranks, samples."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import relations, tables
from quarrylens.plans import heavy
from quarrylens.plans.heavy import most_frequent
from quarrylens.plans.passes import distinct_counts, in_order
from quarrylens.sources.sampling import SEED, exact_sample


def plain_top(rows, columns, k):
    out = []
    for c, name in enumerate(columns):
        counts = Counter(str(r[c]) for r in rows if r[c] is not None)
        out += [(c, name, rank, v, n) for rank, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("counters", [4, 30, 2_000])
def test_most_frequent_is_exact_whatever_the_counters(spark, counters, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"v{min(int(rng.zipf(1.3)), 5000)}" if k % 9 else None, f"u{k}", k % 3) for k in range(6000)]
    df = spark.createDataFrame(rows, "a string, b string, c int").repartition(5)
    recounts = []
    monkeypatch.setattr(heavy, "value_counts", lambda d, columns, f=heavy.value_counts: recounts.append(columns) or f(d, columns))
    assert sorted(map(tuple, most_frequent(df, ["a", "b", "c"], 5, counters).collect())) == plain_top(rows, ["a", "b", "c"], 5)
    if counters == 30:
        assert recounts == [["b"]]  # the skewed column is settled by its recount, the one of different values is not
    if counters == 2_000:
        assert recounts == []  # no task had to give up a counter


def test_most_frequent_of_nothing(spark):
    assert most_frequent(spark.createDataFrame([], "a string, b int"), ["a", "b"], 3).count() == 0
    assert most_frequent(spark.createDataFrame([(None, None)], "a string, b int"), ["a", "b"], 3).count() == 0


def test_sketch_errors_bound_true_counts():
    rng = np.random.default_rng(3)
    values = [f"v{x}" for x in rng.integers(0, 400, 3000)] + ["hot"] * 500
    held = heavy.Counters(20)
    for at in range(0, len(values), 97):
        chunk = Counter(values[at : at + 97])
        held.add(list(chunk), list(chunk.values()))
    held.cut()
    true = Counter(values)
    assert len(held.held) <= 20 and all(n <= true[v] <= n + held.error for v, n in held.held.items()) and all(true[v] <= held.error for v in true if v not in held.held)


def test_all_histograms_in_three_scans(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal()), int(rng.integers(0, 7)), None, 5, float("nan") if k % 2 else 1.0, float("inf") if k == 3 else 0.5) for k in range(500)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d int, e double, f double")
    found = tables.histograms(df, df.columns).orderBy("column_name", "bin").collect()
    by_column = {c: [r for r in found if r["column_name"] == c] for c in df.columns}
    counts, edges = np.histogram([r[0] for r in rows], 20)
    assert [r["n"] for r in by_column["a"]] == counts.tolist() and np.allclose([r["range_start"] for r in by_column["a"]], edges[:-1])
    assert len(by_column["b"]) == 7 and sum(r["n"] for r in by_column["b"]) == 500 and by_column["c"] == [] and by_column["f"] == []
    assert [(r["n"], r["range_start"], r["range_end"]) for r in by_column["d"]] == [(500, 4.5, 5.5)] and [r["n"] for r in by_column["e"]] == [250]


def test_distinct_counts_of_all_kinds(spark):
    start = datetime(2024, 1, 1)
    rows = [(k % 200 - 100, k * 10**12, None if k % 5 else True, k / 7, f"t{k % 11}", start.date() + timedelta(days=k % 90), start + timedelta(seconds=k % 77), b"x" * (k % 3), {"a": k % 2}) for k in range(300)]
    df = spark.createDataFrame(rows, "i int, l long, b boolean, d double, s string, day date, t timestamp, raw binary, m map<string,int>")
    want = {"i": 200, "l": 300, "b": 2, "d": 300, "s": 11, "day": 90, "t": 77, "raw": 3, "m": 2}
    found = {r["column_name"]: r for r in distinct_counts(df, df.columns).collect()}
    assert {c: r["n_unique"] for c, r in found.items()} == want and found["b"]["missing_count"] == 240 and {r["total_rows"] for r in found.values()} == {300}
    assert [tuple(r)[2:] for r in distinct_counts(df.limit(0), ["i"]).collect()] == [(0, 0, 0)]
    edge = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,), (-1,), (63,), (64,)], "v long")
    assert distinct_counts(edge, ["v"]).first()["n_unique"] == 6


def test_intervals_equal_plain_differences(spark):
    rng = np.random.default_rng(2)
    seconds = np.sort(rng.integers(0, 5000, 3000))
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(seconds=int(s)),) for s in rng.permutation(seconds)] + [(None,)], "t timestamp").repartition(6)
    plain = Counter((np.diff(seconds) * 1_000_000).tolist())
    assert {r["interval_us"]: r["n"] for r in relations.intervals(df, "t").collect()} == plain
    assert relations.intervals(df.limit(0), "t").count() == 0 and relations.intervals(df.where("t IS NOT NULL").limit(1), "t").count() == 0


@pytest.mark.parametrize("tile", [7, 256])
def test_correlation_of_many_columns(spark, monkeypatch, tile):
    monkeypatch.setattr(relations, "TILE", tile)
    monkeypatch.setattr(relations, "TILES_A_SCAN", 9)
    rng = np.random.default_rng(4)
    width = 60 if tile == 7 else 200
    x = rng.normal(size=(120, width)) @ rng.normal(size=(width, width)) + 1e6
    x[:, 5] = 3.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) + (0.0,) * (width - 1)], ", ".join(f"c{k} double" for k in range(width))).repartition(3)
    found = {(r["column_a"], r["column_b"]): r["r"] for r in relations.correlation(df).collect()}
    with np.errstate(invalid="ignore"):
        plain = np.corrcoef(x.T)
    assert len(found) == width * (width - 1) // 2
    for (a, b), r in found.items():
        i, j = int(a[1:]), int(b[1:])
        assert (r is None) == (5 in (i, j)) and (r is None or abs(r - plain[i, j]) <= 6e-5), (a, b)
    assert {r["r"] for r in relations.correlation(df.limit(0)).collect()} == {None}


def test_text_target_ranks_and_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("string").alias("name"), F.col("id").cast("double").alias("x")).repartition(7)
    assert {r["name"]: r["place"] for r in in_order(df.select("name"), "name").collect()} == {v: k for k, v in enumerate(sorted(str(x) for x in range(5000)))}
    encoded, y = relations.encode(df, "name", "string")
    assert [r[0] for r in encoded.orderBy("name").select(y).limit(3).collect()] == [0.0, 1.0, 2.0]


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("g"))
    hashed = F.xxhash64(F.lit(SEED), F.col("id").cast("string"), F.col("g").cast("string"))
    plain = sorted(r["id"] for r in df.orderBy(hashed).limit(50).collect())
    assert sorted(r["id"] for r in exact_sample(df, 50).collect()) == plain
    equal = spark.range(20_000).select(F.lit(1).alias("v"))
    assert exact_sample(equal, 50).count() == 50 and exact_sample(df, 30_000).count() == 20_000
