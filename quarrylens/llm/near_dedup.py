"""Near-duplicate documents by shingle similarity, on operator 10's generalised pigeonhole search.

Texts are sets of word shingles.  A set has a SimHash of 768 bits (twelve mixes of each
shingle's hash).  The bits are grouped into partitions, correlated bits together, and every
fingerprint gets thresholds of its own by dynamic programming on estimated candidates, as
in ``simhash``.  Fingerprints and probes are dealt out by (partition, value).

1. Search.  Rows that meet under a key are compared on 256 bits: far enough apart for
   unrelated texts (nine deviations), loose enough (three deviations) for texts of the
   similarity asked.  This gives loose components.
2. Verify.  Inside a loose component the exact Jaccard similarity of shingle sets decides:
   first against the component's smallest row, then all pairs with a row that is not
   similar to that one, in blocks.  A group of copies is therefore compared once a row.

A fingerprint's thresholds sum to a budget; with m partitions all pairs within budget + m - 1
bits meet for certain.  The budget is the smallest with which, at the similarity asked, ``MISS``
of the pairs at most do not meet (binomially); the more similar, the fewer.  The number of
partitions, so their width, is the one with the least work for the number of rows.

Hot values: a value that BUCKET_ROWS rows or more share has a leader; rows near it are
linked to it and need no comparison with each other, only the others probe all its shares.

Defined cases: null or blank texts have no shingles and are all near-identical; a text of
fewer words than a shingle is one shingle; a null doc_id takes no part; repeated rows come
again; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import connected_components, forest
from quarrylens.llm.simhash import BITS, Plan, ball_masks, bit_correlation, blocks_of, gather_bits, group_bits, runs_of, salt_of, shingle_hashes, value_tables
from quarrylens.llm.store import BROADCAST_ROWS, save, shuffle_width, without_ids

WORDS64 = 12  # 64-bit words of a fingerprint
COMPARED = 4  # of them carried to a bucket
MISS = 0.03  # pairs of the similarity asked that the search may leave out
SIGMAS = 3.0
TABLE_BITS = 8
RADIUS = 2
BUCKET_ROWS = 65_536
BLOCK_ROWS, BLOCK_SHINGLES = 8_192, 2_000_000
PAIRS = 1 << 18
ROW_COST = 100.0  # of dealing one row, in comparisons
ROW_TEXT = "near_duplicate_text_hash"
NAMES = [f"w{k}" for k in range(WORDS64)]


# ---------------------------------------------------------------- fingerprints


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """WORDS64 words; a bit is 1 if set in over half of the hashes' mixes. Sums of 255 rows fit a byte."""
    counts = np.zeros(WORDS64 * BITS, np.int64)
    for s in range(0, len(hashes), 255):
        counts += np.unpackbits(mixes(hashes[s : s + 255]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def mixes(hashes: np.ndarray) -> np.ndarray:
    """[n, WORDS64]: steps of the SplitMix64 sequence from each hash."""
    z = hashes[:, None] + np.arange(1, WORDS64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, key, n, shingles, w0, ...): the set of each whole text as sorted 32-bit hashes, and its fingerprint."""

    def run(batches):
        for batch in batches:
            keys, sizes, sets, prints = [], [], [], []
            for text in batch.column(2):
                values = np.unique(shingle_hashes(text.as_py(), words) >> np.uint64(32))
                packed = values.astype("<u4").tobytes()
                keys.append(xxhash.xxh64_intdigest(packed))
                sizes.append(len(values))
                sets.append(packed)
                prints.append(wide_simhash(values))
            fps = np.array(prints, np.uint64).reshape(-1, WORDS64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(fps[:, k])) for k in range(WORDS64)], ["doc_id", "text_hash", "key", "n", "shingles", *NAMES])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, key long, n long, shingles binary, " + ", ".join(f"{w} long" for w in NAMES))


# ---------------------------------------------------------------- planning


def differing(similarity: float) -> float:
    """Share of bits in which sets of this Jaccard similarity and equal sizes differ: their angle by pi."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def within(width: int, radius: int, p: float) -> float:
    return sum(comb(width, r) * p**r * (1 - p) ** (width - r) for r in range(radius + 1))


def compared_limit(similarity: float) -> int:
    p = differing(similarity)
    return int(COMPARED * BITS * (p + SIGMAS * sqrt(p * (1 - p) / (COMPARED * BITS))))


@lru_cache
def choose_layout(rows: int, similarity: float) -> tuple[int, int]:
    """(partitions a word, budget): the least work a fingerprint among those that leave out MISS at the most."""
    p, found = differing(similarity), []
    for per_word in (2, 3, 4, 5, 6, 8):
        width, parts = BITS // per_word, per_word * WORDS64
        for low in range(-1, RADIUS):
            # k partitions have the threshold low + 1, the others low
            wide, narrow = 1 - within(width, low + 1, p), 1 - within(width, low, p) if low >= 0 else 1.0
            k = next((k for k in range(parts + 1) if k * log(wide) + (parts - k) * log(narrow) <= log(MISS)), None)
            if k is not None:
                ball = [0, 1, 1 + width, 1 + width + comb(width, 2)]
                probes = k * ball[low + 2] + (parts - k) * ball[low + 1]
                further = probes - (k if low < 0 else parts)  # a row's own values are dealt anyway
                found.append((ROW_COST * (parts + further) + rows * probes / 2.0**width, per_word, parts * low + k))
                break
    _, per_word, budget = min(found)
    return per_word, budget


def plan_for(distinct: DataFrame, rows: int, similarity: float) -> Plan:
    """Correlations within each word and value counts of blocks of TABLE_BITS bits, over all distinct fingerprints."""
    per_word, budget = choose_layout(rows, similarity)
    prints = distinct.select(*NAMES)
    groups = [[w * BITS + b for b in g] for w, c in enumerate(bit_correlation(prints, WORDS64, rows)) for g in group_bits(c, per_word)]
    tables = value_tables(prints, [b for g in groups for b in blocks_of(g, TABLE_BITS)])
    return Plan(groups, tables, rows, budget, RADIUS, TABLE_BITS, probe_cost=ROW_COST)


# ---------------------------------------------------------------- search


def near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, limit: int, similarity: float) -> np.ndarray:
    """Rows of COMPARED words within the limit whose sizes allow the similarity."""
    bits = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)
    return (bits <= limit) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)


def unpacked(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, n and the first words of the fingerprints of a batch (key, n, w0, ...)."""
    key, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "n"))
    return key, n, np.column_stack([batch.column(f"w{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(words)]).view(np.uint64)


def bucket_key(part: int, values: np.ndarray) -> np.ndarray:
    return values * 1024 + part


def hot_leaders(distinct: DataFrame, plan) -> DataFrame:
    """(bucket, leader): the row with the smallest key of each value with BUCKET_ROWS rows or more, by estimate."""

    def hot(batches):
        p = plan.value
        for batch in batches:
            _, _, fps = unpacked(batch, WORDS64)
            for k, group in enumerate(p.groups):
                at = np.flatnonzero(p.estimates(fps, k)[0] > BUCKET_ROWS)
                if len(at):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_key(k, gather_bits(fps[at], group))), *rows.columns[: 2 + COMPARED]], ["bucket", "key", "n", *NAMES[:COMPARED]])

    carried = ["key", "n", *NAMES[:COMPARED]]
    rows = distinct.select("key", "n", *NAMES).mapInArrow(hot, "bucket long, " + ", ".join(f"{c} long" for c in carried))
    return rows.groupBy("bucket").agg(F.min(F.struct(*carried)).alias("leader")).select("bucket", "leader.*")


def loose_edges(distinct: DataFrame, rows: int, similarity: float) -> DataFrame:
    """(u, v): a forest over keys of the pairs that the search finds near."""
    spark = distinct.sparkSession
    plan = spark.sparkContext.broadcast(plan_for(distinct, rows, similarity))
    limit = compared_limit(similarity)
    leaders = save(hot_leaders(distinct, plan), "leaders")
    found = leaders.toArrow() if leaders.count() <= BROADCAST_ROWS // 8 else None  # 64 bytes each; one row for 65,536 at the least
    if found is None:
        raise RuntimeError("more hot values than may be broadcast; raise BUCKET_ROWS")
    order = np.argsort(found["bucket"].to_numpy())
    known = spark.sparkContext.broadcast((found["bucket"].to_numpy()[order], found["key"].to_numpy()[order], found["n"].to_numpy()[order], np.column_stack([found[w].to_numpy()[order] for w in NAMES[:COMPARED]]).astype(np.int64).view(np.uint64)))
    carried = ["key", "n", *NAMES[:COMPARED]]

    def led(bucket, n, fps):
        """Places of each row's leader, and whether the row is near it."""
        buckets, _, sizes, prints = known.value
        if not len(buckets):
            return np.zeros(len(bucket), np.int64), np.zeros(len(bucket), bool)
        at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
        return at, (buckets[at] == bucket) & near(fps[:, :COMPARED], prints[at], n, sizes[at], limit, similarity)

    def settle(batches):
        p, (buckets, keys, _, _) = plan.value, known.value
        if not len(buckets):
            return
        for batch in batches:
            key, n, fps = unpacked(batch, WORDS64)
            for k, group in enumerate(p.groups):
                at, close = led(bucket_key(k, gather_bits(fps, group)), n, fps)
                close &= keys[at] != key
                if close.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[close]), pa.array(keys[at[close]])], ["u", "v"])

    def deal(batches):
        p, masks = plan.value, {}

        def dealt(part, values, salt, asks, rows):
            key, n, fps = rows
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket_key(part, values)), pa.array(salt.astype(np.int32)), pa.array(asks.astype(np.int8)), pa.array(key), pa.array(n), *(pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(COMPARED))],
                ["bucket", "salt", "asks", *carried],
            )

        def shares(fps, part):
            return np.maximum(1, np.ceil(p.estimates(fps, part)[0] / BUCKET_ROWS)).astype(np.int64)

        def asked(part, values, rows, there):
            again = np.repeat(np.arange(len(values)), there)
            salt = np.arange(len(again)) - np.repeat(np.cumsum(there) - there, there)
            return dealt(part, values[again], salt, np.full(len(again), 2), [x[again] for x in rows])

        for batch in batches:
            whole = unpacked(batch, WORDS64)
            for s in range(0, len(whole[0]), 4096):
                own = [x[s : s + 4096] for x in whole]
                limits = p.thresholds(own[2])
                for k, group in enumerate(p.groups):
                    values, there = gather_bits(own[2], group), shares(own[2], k)
                    probing = limits[k] >= 0
                    hot = there > 1
                    yield dealt(k, values, salt_of(own[0].view(np.uint64), there), probing & ~hot, own)
                    if hot.any():
                        open_ = hot & probing & ~led(bucket_key(k, values), own[1], own[2])[1]
                        yield asked(k, values[open_], [x[open_] for x in own], there[open_])
                    for t in range(1, RADIUS + 1):
                        asking = limits[k] == t
                        if asking.any():
                            if (k, t) not in masks:
                                masks[k, t] = [(m, spread(int(m), group)) for m in ball_masks(len(group), t) if m]
                            rows = [x[asking] for x in own]
                            for mask, wide in masks[k, t]:
                                yield asked(k, values[asking] ^ mask, rows, shares(rows[2] ^ wide, k))

    def spread(mask, group):
        out = np.zeros(WORDS64, np.uint64)
        for j, b in enumerate(group):
            if mask >> j & 1:
                out[b // BITS] |= np.uint64(1) << np.uint64(b % BITS)
        return out

    def verify(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bucket, salt, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "asks"))
            key, n, fps = unpacked(batch, COMPARED)
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]
            group = np.cumsum(new) - 1
            data = np.flatnonzero(asks < 2)
            first = np.searchsorted(group[data], np.arange(group[-1] + 1))
            last = np.searchsorted(group[data], np.arange(group[-1] + 1), "right")
            some = last > first
            lead = np.where(some, data[np.minimum(first, len(data) - 1)], 0) if len(data) else np.zeros(len(first), np.int64)
            close = some[group] & near(fps, fps[lead[group]], n, n[lead[group]], limit, similarity)
            u, v = [key[close]], [key[lead[group[close]]]]
            apart = data[~close[data]]  # rows near their leader need not meet each other
            far_first = np.searchsorted(group[apart], np.arange(group[-1] + 1))
            far_last = np.searchsorted(group[apart], np.arange(group[-1] + 1), "right")
            for q, pool, lo, hi in ((np.flatnonzero((asks > 0) & ~close), data, first, last), (np.flatnonzero((asks > 0) & close), apart, far_first, far_last)):
                width = (hi - lo)[group[q]]
                q, width = q[width > 0], width[width > 0]
                for done, upto in runs_of(width, PAIRS):
                    w = width[done:upto]
                    left = np.repeat(q[done:upto], w)
                    right = pool[np.repeat(lo[group[q[done:upto]]], w) + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)]
                    ok = near(fps[left], fps[right], n[left], n[right], limit, similarity)
                    u.append(key[left[ok]])
                    v.append(key[right[ok]])
            kept = data[first[group[-1]] : last[group[-1]]]
            held = batch.take(pa.array(kept)) if len(kept) else None
            nodes, roots = forest(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])

    deals = distinct.select("key", "n", *NAMES).mapInArrow(deal, "bucket long, salt int, asks byte, " + ", ".join(f"{c} long" for c in carried))
    met = deals.repartition(shuffle_width(spark), "bucket", "salt").sortWithinPartitions("bucket", "salt", "asks").mapInArrow(verify, "u long, v long")
    return met.unionByName(distinct.select("key", "n", *NAMES).mapInArrow(settle, "u long, v long"))


# ---------------------------------------------------------------- verify


def shared_with(one: np.ndarray, many: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with sets laid end to end, none of them empty."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    return np.add.reduceat((one[at] == many).astype(np.int64), starts)


def jaccard_at_least(one: bytes, others: list[bytes], similarity: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of a set with each of the others reaches the bound; two empty sets have 1."""
    sizes = np.array([len(o) // 4 for o in others], np.int64)
    a = np.frombuffer(one, "<u4")
    shared = np.zeros(len(others), np.int64)
    full = np.flatnonzero(sizes)
    if len(a) and len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        shared[full] = shared_with(a, np.frombuffer(b"".join(others[k] for k in full), "<u4"), starts)
    return shared >= similarity * (len(a) + sizes - shared) - 1e-9


def links_among(left: list[tuple], right: list[tuple], inside: bool, similarity: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, key) forest of left x right, and of left x left if ``inside``; rows are (key, n, words, shingles, linked to the leader)."""
    rows = left + right
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    fps = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    parent = np.arange(len(rows))
    led = np.flatnonzero([r[4] for r in rows])
    if len(led):
        parent[led] = led[0]  # one component already
    for i in range(len(left)):
        start = i + 1 if inside else len(left)
        at = start + np.flatnonzero(near(fps[i][None], fps[start:], n[i], n[start:], limit, similarity))
        while True:
            at = at[parent[at] != parent[i]]
            if not len(at):
                break
            now, at = at[:256], at[256:]
            for j in now[jaccard_at_least(rows[i][3], [rows[j][3] for j in now], similarity)]:
                a, b = sorted((parent[i], parent[j]))
                parent[parent == b] = a
    below = np.flatnonzero(parent != np.arange(len(rows)))
    return keys[below], keys[parent[below]]


def strict_edges(sets: DataFrame, loose: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of exact similarity inside loose components. sets (key, n, shingles, w...), loose (node, root)."""
    spark = sets.sparkSession
    limit = compared_limit(similarity)
    carried = ["key", "n", "shingles", *NAMES[:COMPARED]]
    members = F.broadcast(loose) if loose.count() <= BROADCAST_ROWS // 2 else loose
    held = save(sets.select(*carried).join(members, sets["key"] == members["node"]).select("root", *carried).dropDuplicates(["key"]), "loose-members")
    heads = held.where("key = root").select("root", F.col("shingles").alias("head"))
    schema = "root long, linked boolean, " + ", ".join(f"{c} {'binary' if c == 'shingles' else 'long'}" for c in carried)

    def judge(batches):
        for batch in batches:
            linked = [bool(jaccard_at_least(h, [s], similarity)[0]) for h, s in zip(batch.column("head").to_pylist(), batch.column("shingles").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(linked, pa.bool_()), *(batch.column(c) for c in carried)], ["root", "linked", *carried])

    judged = save(held.join(heads, "root").select("root", "head", *carried).mapInArrow(judge, schema), "judged")
    of = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    sizes = judged.groupBy("root").agg(of(F.col("linked"), 1).alias("u"), of(~F.col("linked"), 1).alias("r"), of(F.col("linked"), F.col("n")).alias("un"), of(~F.col("linked"), F.col("n")).alias("rn"))
    blocks = lambda rows, shingles: F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    open_ = sizes.where("r >= 1 AND r + u > 2").select("root", blocks("u", "un").alias("ub"), blocks("r", "rn").alias("rb"))
    own = F.when(F.col("linked"), F.pmod(F.xxhash64("key"), "ub")).otherwise(F.pmod(F.xxhash64("key"), "rb")).cast("int")
    # Block i of the rest meets every block of the linked, and the later blocks of the rest; inside itself it meets with linked block 0.
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("ub") - 1), lambda j: pair(F.col("own"), F.col("rb") + j, 0)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("rb") - 1), lambda j: j != F.col("own")), lambda j: F.struct(F.least(j, F.col("own")).cast("int").alias("i"), F.greatest(j, F.col("own")).cast("int").alias("j"), F.when(j > F.col("own"), 0).otherwise(1).alias("side"))),
    )
    linked = F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda i: pair(i, F.col("rb") + F.col("own"), 1))
    dealt = judged.join(open_, "root").withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("linked"), linked).otherwise(rest)))

    def compare(table: pa.Table) -> pa.Table:
        rows = {0: [], 1: []}
        columns = [table[c].to_pylist() for c in ("side", "key", "n", "shingles", "linked", *NAMES[:COMPARED])]
        for side, key, n, shingles, linked_, *words in zip(*columns):
            rows[side].append((key, n, words, shingles, linked_))
        inside = table["j"][0].as_py() == table["rb"][0].as_py()
        u, v = links_among(rows[0], rows[1], inside, similarity, limit)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    further = dealt.select("root", "pair.i", "pair.j", "pair.side", "rb", "linked", *carried).groupBy("root", "i", "j").applyInArrow(compare, "u long, v long")
    return judged.where("linked AND key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")).unionByName(further)


# ---------------------------------------------------------------- results


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents linked by sets of word shingles with at least this Jaccard similarity."""
    return near_duplicate_rows(docs, words, similarity).select("doc_id", "component_id")


def near_duplicate_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, root, component_id): as ``near_duplicates``, with the XXH64 of the row's text and one key of its component."""
    sets = save(shingle_sets(docs.where("doc_id IS NOT NULL"), words), "shingles")
    distinct = save(sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), *(F.max(w).alias(w) for w in NAMES)), "shingles-distinct")
    loose = save(connected_components(loose_edges(distinct, distinct.count(), similarity)), "loose")
    # The node of every link, and each component's root itself.
    loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    roots = connected_components(strict_edges(sets, loose, similarity))
    named = distinct.join(roots, distinct["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.select("doc_id", "text_hash", "key").join(named.join(smallest, "root").select("key", "root", "component_id"), "key").select("doc_id", "text_hash", "root", "component_id")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those near-identical to one with a smaller doc_id; columns as they were.

    A row whose doc_id is null stays.  Of rows that share a doc_id and are linked one stays,
    the one with the smallest hash of its text; rows that share a doc_id and are not linked
    are judged each by its own text.
    """
    found = save(near_duplicate_rows(docs, words, similarity), "near-duplicates")
    total, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    others = found.where("doc_id <> component_id")
    if total == ids:
        return without_ids(docs, others.select("doc_id"))
    first = found.where("doc_id = component_id").select("doc_id", "root", "text_hash").distinct()
    least = first.groupBy("doc_id", "root").agg(F.min("text_hash").alias("least"))
    further = first.join(least, ["doc_id", "root"]).where("text_hash <> least")
    dropped = save(others.select("doc_id", "text_hash").union(further.select("doc_id", "text_hash")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_ROWS // 2:
        dropped = F.broadcast(dropped)
    marked = docs.withColumn(ROW_TEXT, F.xxhash64(F.col("text").cast("binary")))
    kept = marked.join(dropped, (marked["doc_id"].cast("long") == dropped["doc_id"]) & (marked[ROW_TEXT] == dropped["text_hash"]), "left_anti")
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", ROW_TEXT]).unionByName(kept.where("doc_id IS NULL")).drop(ROW_TEXT)
