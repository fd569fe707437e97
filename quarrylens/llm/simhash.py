"""Operator 10: SimHash near-duplicates by generalised pigeonhole search.

Fingerprints of 64 bits that differ in at most ``max_bits`` bits are linked.  The bits
are grouped into m partitions, correlated bits together.  A fingerprint gets its own
thresholds t_1..t_m with sum(t_i) = max_bits - m + 1 (t_i = -1: partition not probed);
by the general pigeonhole principle, anything within max_bits is within t_i in some
partition i.  Dynamic programming picks the thresholds with the fewest estimated
candidates; the ball of values around the fingerprint's own is probed and candidates
are verified on all 64 bits.

``hamming_components`` deals probes and fingerprints out by (partition, value), which is
near-linear for few bits.  ``near_dedup`` searches for similar shingle sets, which differ in
more bits, with wider fingerprints and the same planning.

Defined cases: null or blank text has fingerprint 0 and is linked like any other; equal
fingerprints are always linked; a null doc_id takes no part in the smallest id; repeated
rows stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import connected_components, forest
from quarrylens.llm.store import save, shuffle_width

BITS = 64
SEED = 42
TABLE_BITS = 16  # widest group of bits with a table of counts: 65,536 rows at most
BUCKET_ROWS = 4096  # fingerprints of a bucket that one task compares at once
PAIR_CHUNK = 1 << 19
TEXT_STEP = 65536


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; empty for a text without words.

    bytes.lower() changes A-Z only and bytes.split() splits at [\\x20\\x09-\\x0D]+.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    del tokens
    out = np.empty(len(ends) - words + 1, np.uint64)
    for s in range(0, len(out), TEXT_STEP):  # the pieces of a very long text are not held all at once
        last = ends[s + words - 1 : s + words - 1 + TEXT_STEP].tolist()
        first = [0 if s == 0 else int(ends[s - 1]), *ends[s : s + len(last) - 1].tolist()]
        out[s : s + len(last)] = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a : b - 1] for a, b in zip(first, last)], repeat(SEED)), np.uint64, len(last))
    return out


def simhash(hashes: np.ndarray) -> int:
    """Bit j is 1 if set in over half of the hashes; 0 for no hashes. As a signed long."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of whole texts, one row per document; a shingle counts as often as it comes."""

    def run(batches):
        for batch in batches:
            fps = [simhash(shingle_hashes(text.as_py(), words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- planning


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each is seeded and then filled with the bits most correlated with it."""
    strength = np.abs(np.nan_to_num(correlation))
    free = np.ones(len(strength), bool)
    groups = []
    for k in range(parts):
        width = int(free.sum()) // (parts - k)
        drawn = np.where(free, strength[:, free].sum(axis=1), -1)
        group: list[int] = []
        for _ in range(width):
            best = int(drawn.argmax())
            drawn = np.where(free, (0 if not group else drawn) + strength[best], -1)
            group.append(best)
            free[best] = False
            drawn[best] = -1
        groups.append(sorted(group))
    return groups


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed to an integer; wide fingerprints are rows of 64-bit words."""
    words = fps.reshape(len(fps), -1)
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((words[:, b // BITS] >> np.uint64(b % BITS)) & np.uint64(1)).astype(np.int64) << k
    return out


def ball_masks(width: int, radius: int) -> np.ndarray:
    """Every mask of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def ball_counts(histogram: np.ndarray, width: int, radius: int) -> np.ndarray:
    """[t, value]: rows at distance exactly t from the value, for t up to radius."""
    shells = np.zeros((radius + 1, 1 << width))
    shells[0] = histogram
    index = np.arange(1 << width)
    for b in range(width):
        shells[1:] += shells[:-1, index ^ (1 << b)]
    return shells


class Plan:
    """Partitions, their tables of counts, and thresholds by dynamic programming.

    Thresholds sum to ``budget`` and are ``radius`` at most.  A partition of over
    ``table_bits`` bits holds several tables, multiplied as if independent.  A probe
    costs as much as ``probe_cost`` candidates, that of the own value ``own_cost``.
    """

    def __init__(self, groups: list[list[int]], histograms: dict[tuple[int, ...], np.ndarray], rows: int, budget: int, radius: int, table_bits: int = TABLE_BITS, probe_cost: float = 1.0, own_cost: float = 1.0):
        self.groups, self.rows, self.budget, self.radius = groups, rows, budget, radius
        self.probe_cost, self.own_cost = probe_cost, own_cost
        self.tables = [[(block, ball_counts(histograms[tuple(block)], len(block), radius)) for block in blocks_of(g, table_bits)] for g in groups]

    def estimates(self, fps: np.ndarray, part: int) -> np.ndarray:
        """[t, i]: rows expected within t of fingerprint i in the partition."""
        exact = None
        for block, shells in self.tables[part]:
            share = shells[:, gather_bits(fps, block)] / max(self.rows, 1)
            if exact is None:
                exact = share
            else:
                exact = np.stack([sum(exact[s] * share[t - s] for s in range(t + 1)) for t in range(len(share))])
        return np.cumsum(exact, axis=0) * self.rows

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """[part, i]: the cheapest thresholds that sum to the budget, for each fingerprint."""
        parts, low = len(self.groups), -len(self.groups)
        span = max(self.budget, 0) + self.radius - low + 1  # sums from low up; one over the budget can come down again
        best = np.full((span, len(fps)), np.inf)
        best[-low] = 0.0
        choice = np.zeros((parts, span, len(fps)), np.int8)
        for p in range(parts):
            cost = np.vstack([np.zeros((1, len(fps))), self.estimates(fps, p)])
            probes = [0.0, self.own_cost] + [self.probe_cost * comb(len(self.groups[p]), r) for r in range(1, self.radius + 1)]
            cost += np.cumsum(probes)[:, None]
            new = np.full_like(best, np.inf)
            for t in range(-1, self.radius + 1):
                low_s, high_s = max(0, -t), min(span, span - t)  # sums so far to which t can be added
                if low_s < high_s:
                    total, now = best[low_s:high_s] + cost[t + 1], slice(low_s + t, high_s + t)
                    better = total < new[now]
                    np.copyto(new[now], total, where=better)
                    choice[p, now][better] = t
            best = new
        out = np.zeros((parts, len(fps)), np.int8)
        at = np.full(len(fps), self.budget - low)
        for p in reversed(range(parts)):
            out[p] = choice[p, at, np.arange(len(fps))]
            at = at - out[p]
        return out


def blocks_of(group: list[int], table_bits: int) -> list[list[int]]:
    n = -(-len(group) // table_bits)
    return [group[len(group) * k // n : len(group) * (k + 1) // n] for k in range(n)]


def choose_parts(rows: int, max_bits: int) -> int:
    """Partitions with the least work if values were uniform: probes plus candidates a fingerprint."""
    def cost(parts: int) -> float:
        budget, total = max_bits - parts + 1, 0.0
        for p in range(parts):
            width, t = BITS // parts, budget // parts + (p < budget % parts)
            ball = sum(comb(width, r) for r in range(t + 1))
            total += 4 * (ball + 1) + rows * ball / 2.0**width
        return total

    return min(range(2, max(2, min(8, max_bits + 1)) + 1), key=cost)


def bit_correlation(prints: DataFrame, words: int, rows: int) -> np.ndarray:
    """[word, bit, bit]: correlation of the bits of each 64-bit word, over all rows of (word0, word1, ...)."""

    def count(batches):
        total = np.zeros((words, BITS, BITS))
        for batch in batches:
            for w in range(words):
                values = batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
                total[w] += bits.T @ bits
        cells = total.reshape(words * BITS, BITS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], ["row", *(f"c{k}" for k in range(BITS))])

    names = [f"c{k}" for k in range(BITS)]
    sums = prints.mapInArrow(count, "row int, " + ", ".join(f"{c} long" for c in names)).groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    both = np.zeros((words * BITS, BITS))
    for r in sums.collect():  # 64 rows a word
        both[r["row"]] = r[1:]
    both = both.reshape(words, BITS, BITS) / max(rows, 1)
    out = []
    for word in both:
        p = word.diagonal()
        sd = np.sqrt(p * (1 - p))
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append((word - np.outer(p, p)) / np.outer(sd, sd))
    return np.array(out)


def value_tables(prints: DataFrame, blocks: list[list[int]]) -> dict[tuple[int, ...], np.ndarray]:
    """Rows for each value of each block of bits, over all rows of (word0, word1, ...); as many counts as values at most."""

    def count(batches):
        tables = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            fps = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns])
            for table, b in zip(tables, blocks):
                table += np.bincount(gather_bits(fps, b), minlength=len(table))
        for k, table in enumerate(tables):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["block", "value", "n"])

    counts = prints.mapInArrow(count, "block int, value long, n long").groupBy("block", "value").agg(F.sum("n").alias("n")).toArrow()
    of, value, n = (counts[c].to_numpy() for c in ("block", "value", "n"))
    histograms = {}
    for k, b in enumerate(blocks):
        table = np.zeros(1 << len(b))
        table[value[of == k]] = n[of == k]
        histograms[tuple(b)] = table
    return histograms


def plan_for(distinct: DataFrame, rows: int, max_bits: int) -> Plan:
    """Statistics over all distinct fingerprints: 64 x 64 bit counts, then a table of at most 65,536 counts per block."""
    groups = group_bits(bit_correlation(distinct.select("fp"), 1, rows)[0], choose_parts(rows, max_bits))
    budget = max_bits - len(groups) + 1
    tables = value_tables(distinct.select("fp"), [b for g in groups for b in blocks_of(g, TABLE_BITS)])
    return Plan(groups, tables, rows, budget, min(max_bits, max(budget + len(groups) - 1, 0)))


# ---------------------------------------------------------------- search by (partition, value)


def runs_of(width: np.ndarray, most: int):
    """(start, end) of runs whose widths sum to ``most`` at the most, or of single items wider than that."""
    totals = np.cumsum(width)
    start = 0
    while start < len(width):
        end = max(start + 1, int(np.searchsorted(totals, (totals[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def salt_of(fps: np.ndarray, salts: np.ndarray) -> np.ndarray:
    mixed = (fps ^ (fps >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % salts.astype(np.uint64)).astype(np.int64)


def hamming_edges(distinct: DataFrame, rows: int, max_bits: int) -> DataFrame:
    """(u, v): a forest with the same components as the links between distinct fingerprints.

    A bucket with many fingerprints is split by salt; probes go to each of its salts.
    A task holds one bucket's share and streams the probes past it.
    """
    spark = distinct.sparkSession
    plan = spark.sparkContext.broadcast(plan_for(distinct, rows, max_bits))

    def deal(batches):
        p = plan.value
        masks = {}
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(fps), 16384):
                own = fps[start : start + 16384]
                limits = p.thresholds(own)
                for k, group in enumerate(p.groups):
                    values = gather_bits(own, group)
                    salts = np.maximum(1, np.ceil(p.estimates(own, k)[0] / BUCKET_ROWS)).astype(np.int64)
                    yield dealt(k, values, salt_of(own, salts), 0, own)
                    for t in range(p.radius + 1):
                        asking = own[limits[k] == t]
                        if not len(asking):
                            continue
                        if (k, t) not in masks:
                            masks[k, t] = ball_masks(len(group), t)
                        for mask in masks[k, t]:
                            probed = values[limits[k] == t] ^ mask
                            shifted = asking ^ spread(mask, group)
                            there = np.maximum(1, np.ceil(p.estimates(shifted, k)[0] / BUCKET_ROWS)).astype(np.int64)
                            again = np.repeat(np.arange(len(asking)), there)
                            salt = np.arange(len(again)) - np.repeat(np.cumsum(there) - there, there)
                            yield dealt(k, probed[again], salt, 1, asking[again])

    def spread(mask: int, group: list[int]) -> np.uint64:
        return np.uint64(sum(1 << b for j, b in enumerate(group) if mask >> j & 1))

    def dealt(part, values, salt, asks, fps):
        n = len(fps)
        key = values * (1 << 3) + part  # up to 2^35
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(salt.astype(np.int32)), pa.array(np.full(n, asks, np.int8)), pa.array(fps.view(np.int64))],
            ["bucket", "salt", "asks", "fp"],
        )

    def verify(batches):
        held_key, held = (None, None), np.empty(0, np.uint64)
        for batch in batches:
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            salt = batch.column(1).to_numpy(zero_copy_only=False)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            fps = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(fps):
                continue
            if (bucket[0], salt[0]) == held_key and len(held):
                n = len(held)
                bucket, salt = np.concatenate([np.full(n, bucket[0]), bucket]), np.concatenate([np.full(n, salt[0]), salt])
                asks, fps = np.concatenate([np.zeros(n, bool), asks]), np.concatenate([held, fps])
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]
            group = np.cumsum(new) - 1
            data = np.flatnonzero(~asks)
            first = np.searchsorted(group[data], np.arange(group[-1] + 1))
            last = np.searchsorted(group[data], np.arange(group[-1] + 1), "right")
            q = np.flatnonzero(asks)
            width = (last - first)[group[q]]
            q, width = q[width > 0], width[width > 0]
            u, v = [], []
            for done, upto in runs_of(width, PAIR_CHUNK):
                w = width[done:upto]
                left = np.repeat(q[done:upto], w)
                right = data[np.repeat(first[group[q[done:upto]]], w) + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)]
                a, b = fps[left], fps[right]
                near = (a != b) & (np.bitwise_count(a ^ b) <= max_bits)
                if near.any():
                    nodes, roots = forest(a[near].view(np.int64), b[near].view(np.int64))
                    u.append(nodes)
                    v.append(roots)
            held_key = (bucket[-1], salt[-1])
            held = fps[data[first[group[-1]] : last[group[-1]]]]
            if u:
                nodes, roots = forest(np.concatenate(u), np.concatenate(v))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])

    width = shuffle_width(spark)
    probes = distinct.select("fp").mapInArrow(deal, "bucket long, salt int, asks byte, fp long")
    return probes.repartition(width, "bucket", "salt").sortWithinPartitions("bucket", "salt", "asks").mapInArrow(verify, "u long, v long")


def hamming_components(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of fingerprints."""
    prints = save(fingerprints(docs, words), "simhash")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = hamming_edges(distinct, distinct.count(), max_bits)
    roots = connected_components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
