"""Samples of an exact size that come out the same every time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.exprs import ref, text_of

SEED = 42
LOWEST = -(1 << 63)  # of hashes
AUTO_BYTES = 1_000_000_000  # above this a CSV is sampled if the caller asks for automatic sampling
AUTO_SHARE, AUTO_CAP = 0.25, 10_000


def exact_sample(df: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hashes.

    Only rows below a threshold that leaves about twice as many are sorted; if it leaves
    fewer than n, as many equal rows can make it, the threshold rises until it does not.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    hashed = F.xxhash64(F.lit(SEED), *[text_of(ref(c), types[c]) for c in df.columns])
    total = df.count()
    share = 2 * n + 100
    while share < total:
        below = df.where(hashed < F.lit(LOWEST + (share << 64) // total).cast("long"))
        if below.count() >= n:
            return below.orderBy(hashed).limit(n)
        share *= 4
    return df.orderBy(hashed).limit(n)


def auto_size(rows: int) -> int:
    return max(1, min(int(AUTO_SHARE * rows), AUTO_CAP))
