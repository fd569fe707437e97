"""Health score: five weighted parts from the analyzers' metrics. Every comparison is strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.model import AnalyzerResult, HealthPart, HealthScore, Severity

#: Weights, (limit, score) steps from the worst down, grade limits.
WEIGHTS = {"Completeness": 0.25, "Uniqueness": 0.20, "Balance": 0.20, "Quality": 0.20, "Consistency": 0.15}
MISSING_STEPS = [(50, 10), (20, 40), (5, 70), (1, 85), (0, 95)]
ROW_STEPS = [(20, 30), (10, 50), (5, 70), (1, 85), (0, 95)]
IMAGE_STEPS = [(10, 40), (5, 60), (1, 80), (0, 90)]
BALANCE_STEPS = [(20, 20), (10, 40), (5, 60), (3, 75), (1.5, 90)]
CORRUPT_STEPS = [(5, 30), (2, 55), (0.5, 75), (0, 90)]
OUTLIER_STEPS = [(0.5, 60), (0.3, 75)]
LEAK_SCORE = 40
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def stepped(value: float | None, steps: list[tuple[float, float]]) -> float:
    return 100.0 if value is None else float(next((score for limit, score in steps if value > limit), 100))


def stepped_column(value: Column, steps: list[tuple[float, float]]) -> Column:
    out = F.lit(100.0)
    for limit, score in reversed(steps):
        out = F.when(value > limit, F.lit(float(score))).otherwise(out)
    return out


def grade_of(score: float) -> str:
    return next((grade for limit, grade in GRADES if score >= limit), "F")


def health_score(results: list[AnalyzerResult]) -> HealthScore:
    ok = {r.analyzer_id: r for r in results if r.status == "success"}
    metric = lambda analyzer, key: ok[analyzer].metrics.get(key) if analyzer in ok else None
    codes = {f.code for r in ok.values() for f in r.findings}
    missing = metric("missing_values", "overall_missing_pct")
    rows = stepped(metric("duplicates", "duplicate_pct"), ROW_STEPS)
    images = 100.0
    if "image_duplicates" in ok:
        m = ok["image_duplicates"].metrics
        images = stepped(100 * (m["exact_duplicates"] + m["near_duplicates"]) / max(m["images_analyzed"], 1), IMAGE_STEPS)
    corrupt = 100.0
    if "corrupted_images" in ok:
        m = ok["corrupted_images"].metrics
        corrupt = stepped(100 * m["total_issues"] / max(m["total_checked"], 1), CORRUPT_STEPS)
    outliers = 100.0
    if metric("outliers", "columns_analyzed"):
        outliers = stepped(metric("outliers", "columns_with_outliers") / metric("outliers", "columns_analyzed"), OUTLIER_STEPS)
    scores = {
        "Completeness": (stepped(missing, MISSING_STEPS), f"{missing or 0} % missing"),
        "Uniqueness": (min(rows, images), "repeated rows and images"),
        "Balance": (stepped(metric("class_balance", "imbalance_ratio"), BALANCE_STEPS), "largest to smallest class"),
        "Quality": (min(corrupt, outliers), "damaged images and outliers"),
        "Consistency": (float(LEAK_SCORE) if "cross_split_duplicates" in codes else 100.0, "the same image in two splits"),
    }
    parts = [HealthPart(name, score, WEIGHTS[name], why) for name, (score, why) in scores.items()]
    total = round(sum(p.score * p.weight for p in parts), 1)
    findings = [f.severity for r in results for f in r.findings]
    return HealthScore(total, grade_of(total), parts, findings.count(Severity.ERROR), findings.count(Severity.WARNING), findings.count(Severity.INFO))


def health_table(metrics: DataFrame) -> DataFrame:
    """The score as SQL over one row: missing_pct, duplicate_pct, imbalance_ratio, outlier_share, and for images image_duplicate_pct, corrupt_pct, leaked."""
    has = lambda c: c in metrics.columns
    uniqueness, quality = stepped_column(F.col("duplicate_pct"), ROW_STEPS), stepped_column(F.coalesce("outlier_share", F.lit(0.0)), OUTLIER_STEPS)
    if has("image_duplicate_pct"):
        uniqueness = F.least(uniqueness, stepped_column(F.col("image_duplicate_pct"), IMAGE_STEPS))
    if has("corrupt_pct"):
        quality = F.least(quality, stepped_column(F.col("corrupt_pct"), CORRUPT_STEPS))
    parts = {"completeness": stepped_column(F.col("missing_pct"), MISSING_STEPS), "uniqueness": uniqueness, "balance": stepped_column(F.coalesce("imbalance_ratio", F.lit(1.0)), BALANCE_STEPS), "quality": quality}
    if has("leaked"):
        parts["consistency"] = F.when(F.col("leaked") > 0, F.lit(float(LEAK_SCORE))).otherwise(100.0)
    scored = metrics.select("*", *[v.alias(k) for k, v in parts.items()])
    consistency = F.col("consistency") if has("leaked") else F.lit(100)
    total = F.round(0.25 * F.col("completeness") + 0.2 * F.col("uniqueness") + 0.2 * F.col("balance") + 0.2 * F.col("quality") + 0.15 * consistency, 1)
    grade = F.lit("F")
    for limit, name in reversed(GRADES):
        grade = F.when(F.col("score") >= limit, name).otherwise(grade)
    return scored.withColumn("score", total).withColumn("grade", grade).select(*parts, "score", "grade")
