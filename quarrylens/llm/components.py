"""Connected components by alternating large-star and small-star steps.

Every step is a join plus an aggregate over the edge table, so a hub with very many
edges never gathers in one task: its minimum comes from a partial aggregate, and the
join's hot key is left to adaptive skew splitting.  Each round is written to the shared
folder, and the loop ends when a round leaves the edges as they were.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.store import save

MAX_ROUNDS = 60


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots; the root is the smallest node of a tree.

    Has the same components as the links u-v and fewer rows than nodes.
    """
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            break
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            higher = parent[parent]
            if np.array_equal(higher, parent):
                break
            parent = higher
    below = parent != np.arange(len(nodes))
    return nodes[below], nodes[parent[below]]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node long, root long), root the smallest node reachable.

    Nodes without a link to another node do not appear.  Null ends, loops and repeated
    edges are ignored; an empty table gives an empty result.
    """
    stars = save(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        stars = save(small, "stars")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
