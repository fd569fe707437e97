"""The training-data pipeline: five stages over ``documents``, each one of the operators in quarrylens.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import line_dedup, mixing, near_dedup, packing, quality
from quarrylens.llm.entries import tokenizer_path
from quarrylens.llm.store import remove, save, scratch

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this input, scores at least its threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*DOCUMENT_COLUMNS), model, at_least=quality.THRESHOLD).select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents leave every document; n_chars follows the text."""
    kept = line_dedup.drop_frequent_lines(docs.select(*DOCUMENT_COLUMNS), min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar five-word shingles stays, the one with the smallest doc_id."""
    return near_dedup.deduplicated(docs.select(*DOCUMENT_COLUMNS), words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    return mixing.mixed(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in packed sequences of 2,048."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None  # a trained model and a tokenizer have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. A stage's own tables go once its result is written, and so does the result before it.

    Null, empty and very long texts, repeated rows, null ids and clashing names are as the
    stages' docstrings say; no documents give no rows, as do no documents that pass.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = save(stage(spark, docs, sf_dir), name.split()[0], lasting=True)
        for path in before:
            remove(spark, path)
        before = list({path.rpartition("/")[0] for path in docs.inputFiles()})
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
