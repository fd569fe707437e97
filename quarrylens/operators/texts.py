"""Free text: words, blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.exprs import blank, pct, ref, words
from quarrylens.functions.types import columns_of
from quarrylens.model import Dataset, FieldType
from quarrylens.operators.base import Analyzer, info, register, rows_of, warning
from quarrylens.plans.passes import per_column

FREE_TEXT = 15  # mean characters above which a text column is prose


def text_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: mean length, mean and most words, share of blank values; all in one scan."""
    columns = columns or columns_of(df.schema, FieldType.TEXT)
    found = per_column(
        df, columns,
        {
            "present": lambda c: F.count(ref(c)), "mean_length": lambda c: F.avg(F.char_length(ref(c))),
            "avg_words": lambda c: F.avg(words(ref(c))), "max_words": lambda c: F.max(words(ref(c))), "blanks": lambda c: F.count_if(blank(ref(c))),
        },
    )
    return found.select("column_name", F.round("mean_length", 2).alias("mean_length"), F.round("avg_words", 1).alias("avg_words"), F.col("max_words").cast("long").alias("max_words"), F.col("blanks").alias("blank_count"), pct(F.col("blanks"), F.col("present")).alias("blank_pct"))


class TextAnalysis(Analyzer):
    id, name = "text_analysis", "Text"

    def run(self, dataset: Dataset):
        columns = [c for c in dataset.names(FieldType.TEXT) if c in dataset.data.columns]
        rows = [r for r in rows_of(text_analysis(dataset.data, columns)) if (r["mean_length"] or 0) > FREE_TEXT] if columns else []
        if not rows:
            return self.skipped("no free text columns")
        metrics, found = {}, []
        for r in rows:
            c = r["column_name"]
            metrics |= {f"{c} - Avg Words": f"{r['avg_words']:.1f}", f"{c} - Max Words": str(r["max_words"])}
            if r["blank_pct"] > 0:
                metrics[f"{c} - Empty/Whitespace"] = f"{r['blank_pct']:.1f}%"
            if r["blank_pct"] > 5:
                found.append(warning("empty_text_fields", f"Blank texts in {c}", f"{r['blank_pct']} % of {c} is blank", column=c))
            if r["avg_words"] > 256:
                found.append(info("long_text_sequences", f"Long texts in {c}", f"{c} has {r['avg_words']:.0f} words on average", column=c))
        return self.result(metrics, found)


register(TextAnalysis())
