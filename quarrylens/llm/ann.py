"""Operator 2: approximate nearest neighbours with balanced posting lists.

The index: centroids by balanced k-means on a bounded sample, kept small enough for an
in-memory graph of near centroids; every row is written to the posting list of its
nearest centroid and, if it lies near a boundary, to those of further centroids that are
not shadowed by one already chosen.  A query walks the graph and reads the lists whose
centroid is within a ratio of the nearest one's distance.  The ratio is fitted on the
sample so that ``TARGET_RECALL`` of true neighbours lie in lists that would be read.
Where these lists hold fewer than k rows besides the query's own, the next nearest ones
are read as well until they hold k; rows count in their nearest list only, so copies of
a row in several lists are not taken for several rows.

Largest inner products become smallest distances by one more component,
sqrt(M^2 - |x|^2), with M the largest norm over all rows.

Lists are split into blocks, blocks are laid into shards, and each task matches one
shard with one share of the queries that read it, so neither a large list nor many
queries on one list gather in a task.  A shard is copied once a share: only those that
more than ``QUERY_SHARE`` queries read have several.  Scores are inner products of the
original vectors in double precision, each from its two rows alone.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows with a null vec_id or with a length other than the most frequent
one (of equally frequent ones the larger); rows that share a vec_id count once, with the
smallest of their vectors; a query with fewer than k candidates has them all; no queries
or no candidates give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.cover_tree import usable
from quarrylens.llm.store import hashed_sample, save

SAMPLE_ROWS = 20_000  # rows that centroids, graph and ratio are fitted on
LIST_ROWS = 256  # rows a list aims at, up to MAX_LISTS lists
MAX_LISTS = 1024
COPIES = 3
BOUNDARY = 0.15  # a further list takes a row if its centroid is at most this share farther
GRAPH_DEGREE = 16
BEAM = 8
TARGET_RECALL = 0.97
CALIBRATION_QUERIES = 256
BLOCK_ROWS = 8192
SHARD_ROWS = 16_384
QUERY_SHARE = 65_536  # queries matched with a shard in one task
QUERY_CHUNK = 512
TIE = 1e-9
SEED = 23


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means whose lists pay for being larger than average, so sizes stay near each other."""
    rng = np.random.default_rng(SEED)
    centroids = points[rng.choice(len(points), lists, replace=False)].copy()
    price = np.zeros(lists)
    for _ in range(rounds):
        apart = squared(points, centroids)
        scale = apart.min(axis=1).mean() + 1e-12
        owner = (apart + price).argmin(axis=1)
        sizes = np.bincount(owner, minlength=lists)
        price += 0.1 * scale * (sizes * lists / len(points) - 1)
        price = np.maximum(price - price.min(), 0)
        total = np.zeros_like(centroids)
        np.add.at(total, owner, points)
        centroids = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def centroid_graph(centroids: np.ndarray) -> np.ndarray:
    """[lists, lists] adjacency: nearest neighbours both ways, and a ring so that every list is reached."""
    n = len(centroids)
    near = np.argsort(squared(centroids, centroids), axis=1, kind="stable")[:, 1 : GRAPH_DEGREE + 1]
    linked = np.zeros((n, n), np.float32)
    linked[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    linked[np.arange(n), (np.arange(n) + 1) % n] = 1
    linked = np.maximum(linked, linked.T)
    np.fill_diagonal(linked, 0)
    return linked


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    top_norm: float
    ratio: float = 0.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top_norm**2 - (vectors * vectors).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def lift_queries(self, queries: np.ndarray) -> np.ndarray:
        scaled = queries * (self.top_norm / np.sqrt((queries * queries).sum(axis=1)))[:, None]
        return np.column_stack([scaled, np.zeros(len(queries))])

    def walk(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """[points, lists] distances found by the graph walk, inf where it did not come.

        A centroid is opened while it is within the ratio of the nearest found so far, or among the BEAM nearest.
        """
        n, lists = len(points), len(self.centroids)
        apart = np.full((n, lists), np.inf)
        opened = np.zeros((n, lists), bool)
        entry = np.unique(np.linspace(0, lists - 1, min(lists, 8)).astype(int))
        apart[:, entry] = np.sqrt(squared(points, self.centroids[entry]))
        while True:
            bound = apart.min(axis=1) * (1 + ratio)
            if lists > BEAM:
                bound = np.maximum(bound, np.partition(apart, BEAM - 1, axis=1)[:, BEAM - 1])
            front = (apart <= bound[:, None]) & ~opened & np.isfinite(apart)
            if not front.any():
                return apart
            opened |= front
            fresh = (front.astype(np.float32) @ self.graph > 0) & np.isinf(apart)
            i, j = np.nonzero(fresh)
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                apart[a, b] = np.sqrt(((points[a] - self.centroids[b]) ** 2).sum(axis=1))

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists each vector is written to, the nearest one always."""
        points = self.lift(vectors)
        apart = self.walk(points, BOUNDARY)
        order = np.argsort(apart, axis=1, kind="stable")[:, : 4 * COPIES]
        between = np.sqrt(squared(self.centroids, self.centroids))
        rows, lists = [], []
        taken = np.full((len(points), COPIES), -1)
        count = np.zeros(len(points), np.int64)
        every = np.arange(len(points))
        nearest = apart[every, order[:, 0]]
        for k in range(order.shape[1]):
            c = order[:, k]
            d = apart[every, c]
            good = np.isfinite(d) & (d <= nearest * (1 + BOUNDARY)) & (count < COPIES)
            for t in range(COPIES):  # shadowed: nearer to a list already taken than to the row
                held = taken[:, t]
                good &= (held < 0) | (between[np.maximum(held, 0), c] > d)
            if k == 0:
                good[:] = True
            taken[good, np.minimum(count[good], COPIES - 1)] = c[good]
            count += good
            rows.append(every[good])
            lists.append(c[good])
        return np.concatenate(rows), np.concatenate(lists)

    def lists_for(self, queries: np.ndarray, homes: np.ndarray, k: int) -> np.ndarray:
        """[queries, lists] of those to be read; homes: rows by nearest list, so that k others are there if they exist."""
        points = self.lift_queries(queries)
        apart = self.walk(points, self.ratio)
        wanted = apart <= apart.min(axis=1, keepdims=True) * (1 + self.ratio)
        few = np.flatnonzero(wanted @ homes < k + 1)
        if len(few):
            order = np.argsort(np.where(wanted[few], -1, squared(points[few], self.centroids)), axis=1, kind="stable")
            held = np.cumsum(homes[order], axis=1) - homes[order]
            row, place = np.nonzero(held < k + 1)
            wanted[few[row], order[row, place]] = True
        return wanted


def fit(sample: np.ndarray, rows: int, top_norm: float, k: int) -> Index:
    lists = int(np.clip(min(rows // LIST_ROWS, len(sample) // 8), 1, MAX_LISTS))
    index = Index(np.empty((0, 0)), np.empty((0, 0)), top_norm)
    index.centroids = balanced_centroids(index.lift(sample), lists)
    index.graph = centroid_graph(index.centroids)
    queries = sample[:CALIBRATION_QUERIES]
    exact = queries @ sample.T
    exact[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, max(len(sample) - 1, 1))
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    row, owner = index.lists_of(sample)
    member = np.zeros((len(sample), lists), bool)
    member[row, owner] = True
    apart = np.sqrt(squared(index.lift_queries(queries), index.centroids))
    needed = np.stack([np.where(member[b], a[None, :], np.inf).min(axis=1) / max(a.min(), 1e-12) for a, b in zip(apart, best)])
    index.ratio = float(np.quantile(needed, TARGET_RECALL)) - 1
    return index


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def best_of_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) of each query's k best in a block sorted by id, ties to smaller ids."""
    out = []
    for s in range(0, len(queries), QUERY_CHUNK):
        q, me = queries[s : s + QUERY_CHUNK], own[s : s + QUERY_CHUNK]
        rough = q @ vectors.T
        rough[me[:, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        top = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        edge = np.take_along_axis(rough, top, 1).min(axis=1)
        edge = np.where(np.isfinite(edge), edge - TIE * (1 + np.abs(edge)), edge)
        tied = (rough >= edge[:, None]).sum(axis=1) > n
        row = np.repeat(np.flatnonzero(~tied), n)
        col = top[~tied].ravel()
        extra = [(r, np.flatnonzero(rough[r] >= edge[r])) for r in np.flatnonzero(tied)]
        for r, c in extra:
            c = c[np.isfinite(rough[r, c])]
            score = exact_scores(q[r][None, :], vectors[c])
            keep = np.lexsort((ids[c], -score))[:n]
            row, col = np.concatenate([row, np.full(len(keep), r)]), np.concatenate([col, c[keep]])
        finite = np.isfinite(rough[row, col])
        row, col = row[finite], col[finite]
        score = np.concatenate([exact_scores(q[row[t : t + 65536]], vectors[col[t : t + 65536]]) for t in range(0, len(row), 65536)] or [np.empty(0)])
        out.append((row + s, ids[col], score))
    return tuple(np.concatenate(x) for x in zip(*out))


def as_matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score), the k nearest found for each query row."""
    spark = vectors.sparkSession
    able = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = able.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = save(able.where(F.size("embedding") == lengths[0]["dim"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-rows")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    total, top = rows.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    sample = hashed_sample(rows, total, SAMPLE_ROWS, SEED, "vec_id").select("embedding").toArrow()
    index = fit(as_matrix(sample.column(0)), total, top * (1 + 1e-12), k)
    shared = spark.sparkContext.broadcast(index)

    def post(batches):
        for batch in batches:
            points = as_matrix(batch.column(1))
            for s in range(0, len(points), 2048):
                row, owner = shared.value.lists_of(points[s : s + 2048])
                taken = batch.slice(s, 2048).take(pa.array(row))
                home = np.arange(len(row)) < len(points[s : s + 2048])  # lists_of names the nearest lists first
                yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(home), *taken.columns], ["list", "home", "vec_id", "embedding"])

    posted = save(rows.mapInArrow(post, "list int, home boolean, vec_id long, embedding array<double>"), "ann-postings")
    postings = posted.drop("home")
    counted = posted.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("home")).collect()  # MAX_LISTS rows at most
    sizes = {r["list"]: r["n"] for r in counted}
    homes = np.zeros(len(index.centroids), np.int64)
    for r in counted:
        homes[r["list"]] = r["home"]
    blocks, shard, filled = {}, 0, 0
    for name in sorted(sizes):
        parts = -(-sizes[name] // BLOCK_ROWS)
        blocks[name] = []
        for _ in range(parts):
            if filled and filled + sizes[name] // parts > SHARD_ROWS:
                shard, filled = shard + 1, 0
            blocks[name].append(shard)
            filled += sizes[name] // parts
    layout = spark.sparkContext.broadcast(blocks)

    def lay(batches):
        for batch in batches:
            names, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            place = np.array([layout.value[a][h % len(layout.value[a])] for a, h in zip(names.tolist(), mixed.tolist())], np.int32)
            times = np.array([shares.value.get(p, 1) for p in place.tolist()], np.int64)
            row = np.repeat(np.arange(len(place)), times)
            share = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
            copied = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(place[row]), pa.array(share), *copied.columns], ["shard", "share", "list", "vec_id", "embedding"])

    def ask(batches):
        for batch in batches:
            points, ids = as_matrix(batch.column(1)), batch.column(0).to_numpy()
            for s in range(0, len(points), QUERY_CHUNK):
                wanted = shared.value.lists_for(points[s : s + QUERY_CHUNK], homes, k)
                out: list[tuple[int, int, list[int]]] = []
                for r, lists in enumerate(wanted):
                    by_shard: dict[int, list[int]] = {}
                    for name in np.flatnonzero(lists).tolist():
                        for shard in set(layout.value.get(name, ())):
                            by_shard.setdefault(shard, []).append(name)
                    out += [(s + r, shard, names) for shard, names in by_shard.items()]
                taken = batch.take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int32())), *taken.columns], ["shard", "lists", "query_id", "embedding"])

    def match(key, asked, posted):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not posted.num_rows:
            return empty
        posted = posted.sort_by([("list", "ascending"), ("vec_id", "ascending")])
        names, ids, vectors = posted.column("list").to_numpy(), posted.column("vec_id").to_numpy(), as_matrix(posted.column("embedding"))
        who, points = asked.column("query_id").to_numpy(), as_matrix(asked.column("embedding"))
        lists = asked.column("lists").combine_chunks()
        asker = np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        found = []
        for name in np.unique(names):
            a, b = np.searchsorted(names, [name, name + 1])
            asking = asker[flat == name]
            if len(asking):
                row, hit, score = best_of_block(points[asking], who[asking], vectors[a:b], ids[a:b], k)
                found.append((who[asking[row]], hit, score))
        if not found:
            return empty
        q, v, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]
        q, v, s = q[fresh], v[fresh], s[fresh]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        return pa.table({"query_id": q[best], "vec_id": v[best], "score": s[best]})

    asked = save(rows.where(is_query).mapInArrow(ask, "shard int, lists array<int>, query_id long, embedding array<double>"), "ann-asked")
    busy = save(asked.groupBy("shard").count().where(F.col("count") > QUERY_SHARE).select("shard", F.ceil(F.col("count") / QUERY_SHARE).cast("int").alias("shares")), "ann-busy")
    shares = spark.sparkContext.broadcast({r["shard"]: r["shares"] for r in busy.collect()})  # one shard for 65,536 asked at most
    posted = postings.mapInArrow(lay, "shard int, share int, list int, vec_id long, embedding array<double>")
    share = F.pmod(F.xxhash64("query_id"), F.coalesce("shares", F.lit(1))).cast("int")
    asked = asked.join(F.broadcast(busy), "shard", "left").select("shard", share.alias("share"), "lists", "query_id", "embedding")
    found = asked.groupBy("shard", "share").cogroup(posted.groupBy("shard", "share")).applyInArrow(match, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
