"""Line dedup, SimHash, mixing, packing and the classifier against brute force, and their defined cases."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import line_dedup, mixing, near_dedup, packing, quality, simhash
from quarrylens.llm.components import connected_components, forest
from quarrylens.llm.entries import tokenizer_path

TABLES = "/root/testdata"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4), (4, "One two THREE four\nfive", "en", None, 9), (4, "One two THREE four\nfive", "en", None, 9),
    (None, "no id here at all", "en", "a", 3), (5, "x " * 60_000 + "end", "en", "a", 1), (6, "Äé ß\x0bq\x1cw", "de", "c", 1), (7, "<|endoftext|> it's 3́ \U0001f600 don't İ", "en", "b", 1),
]


def docs_of(spark, rows=ODD, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "key", "hot", "row", "bucket", "size", "part", "qc_score", "ld_n_lines", "_doc", "times", "n") if clash else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def small(spark, name="documents", sf="sf0.001"):
    path = f"{TABLES}/{sf}/{name}.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return spark.read.parquet(path)


def lower_ascii(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# ---------------------------------------------------------------- components


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(1000, i) for i in range(200, 260)] + [(i, i + 1) for i in range(300, 340)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert found == {x: root(x) for x in parent if root(x) != x}
    u, v = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(u.tolist(), v.tolist())) == found
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_print(text, words):
    tokens = WORD.findall(lower_ascii(text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits):
    labels = {p: p for p in set(prints)}
    changed = True
    while changed:
        changed = False
        for a in labels:
            low = min(labels[b] for b in labels if bin(a ^ b).count("1") <= max_bits)
            if low < labels[a]:
                labels[a], changed = low, True
    return labels


def check_simhash(df, words, max_bits):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    prints = [brute_print(t, words) for _, t in rows]
    labels = brute_components(prints, max_bits)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[labels[p]].append(i)
    want = Counter((i, p, min(least[labels[p]], default=None)) for (i, _), p in zip(rows, prints))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.hamming_components(df, words, max_bits).collect())
    assert got == want


def test_simhash_defined_cases(spark):
    check_simhash(docs_of(spark), 3, 3)
    assert simhash.hamming_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("max_bits", [1, 3, 6])
def test_simhash_links_by_brute_force(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(12)]
    rows = []
    for k in range(90):
        words = list(base[k % 12])
        for _ in range(k % 4):
            words[int(rng.integers(60))] = str(rng.choice(vocabulary))
        rows.append((k, " ".join(words), "en", "s", 1))
    check_simhash(docs_of(spark, rows, False), 3, max_bits)


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    fps = [int(x) for x in np.unique([(5 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)])]
    edges = simhash.hamming_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps), 3).collect()
    assert len({x for e in edges for x in e}) == len(fps)
    assert len({r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}) == 1


def test_fingerprints_of_the_test_table(spark):
    df = small(spark)
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df, 3).collect()}
    assert all(got[r["doc_id"]] == brute_print(r["text"], 3) for r in df.limit(40).collect())


def jaccard(a, b, words=5):
    x, y = ({tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} for t in (WORD.findall(lower_ascii(s or "")) for s in (a, b)))
    return len(x & y) / len(x | y)


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [list(map(str, rng.integers(0, 10_000, 150))) for _ in range(15)]
    rows = []
    for k in range(60):
        words = list(base[k % 15])
        for _ in range((0, 1, 2, 60)[k // 15]):
            words[int(rng.integers(150))] = "changed"
        rows.append((k, " ".join(words), "en", "s", 1))
    texts = {r[0]: r[1] for r in rows}
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    for a in texts:
        for b in texts:
            if jaccard(texts[a], texts[b]) >= 0.85:
                assert found[a] == found[b]
            if a % 15 != b % 15:
                assert found[a] != found[b]


def test_near_duplicates_with_a_passage_that_recurs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(10):
        words = list(map(str, rng.integers(0, 10_000, 104)))
        rows += [(k, " ".join(words), "en", "s", 1), (k + 10, " ".join(words + [f"again{k}", "and", f"over{k}"] * 50), "en", "s", 1)]
    assert all(jaccard(a[1], b[1]) >= 0.9 for a, b in zip(rows[::2], rows[1::2]))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert found == {k: k % 10 for k in range(20)}


def near_texts(rng, bases, copies, length, edits):
    """Texts with up to ``edits`` words changed, ``copies`` of each base."""
    texts = []
    for _ in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 5_000, length)]
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, length, int(rng.integers(0, edits + 1))):
                words[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    return texts


def near_components(texts, similarity=0.8):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (x.split() for x in texts)]
    root, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, links


@pytest.mark.parametrize(("bases", "copies", "length", "edits"), [(40, 8, 120, 6), (60, 4, 50, 1), (25, 6, 400, 18)])
def test_near_duplicates_equal_exact_similarity(spark, bases, copies, length, edits):
    texts = near_texts(np.random.default_rng(length), bases, copies, length, edits)
    want, links = near_components(texts)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)], False)).collect()}
    lost = sum(found[k] != r for k, r in enumerate(want))
    assert links > bases and lost <= 0.02 * len(texts) and all(want[k] == want[found[k]] for k in found)  # no link too many, few too few


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 12)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    texts = near_texts(rng, 1, 150, 90, 3) + near_texts(rng, 20, 2, 90, 2) + near_texts(rng, 2, 40, 90, 14)
    want, links = near_components(texts)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)], False)).collect()}
    assert links > 2000 and sum(found[k] != r for k, r in enumerate(want)) <= 3 and all(want[k] == want[found[k]] for k in found)


def test_blocks_of_a_component_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    texts = near_texts(np.random.default_rng(4), 3, 30, 60, 5)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = near_dedup.shingle_sets(rows, 5).cache()
    keys = {r["key"]: r["doc_id"] for r in sets.orderBy(F.desc("doc_id")).collect()}
    least = min(keys)
    monkeypatch.setattr(near_dedup, "compared_limit", lambda similarity: 256)
    loose = spark.createDataFrame([(k, least) for k in keys], "node long, root long")
    edges = near_dedup.strict_edges(sets, loose, 0.8)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want, _ = near_components(texts)
    groups = {}
    for key, doc in keys.items():
        groups.setdefault(roots.get(key, key), set()).add(want[doc])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = ODD + [(20, "same text " * 30, "en", "a", 1), (21, "same  text " * 30, "en", "b", 2), (21, "same  text " * 30, "en", "b", 2)]
    kept = [r["doc_id"] for r in near_dedup.deduplicated(docs_of(spark, rows)).collect()]
    assert Counter(kept)[20] == 1 and 21 not in kept and Counter(kept)[4] == 1 and None in kept
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept
    assert near_dedup.deduplicated(docs_of(spark, [])).count() == 0


def test_deduplicated_judges_rows_of_one_id_by_their_texts(spark):
    a, b, c, d = (" ".join(f"{name}{k}" for k in range(60)) for name in "abcd")
    rows = [(i, t, "en", "s", 1) for i, t in ((3, a), (5, a), (5, b), (5, b), (9, b), (7, c), (7, c + " more"), (8, c), (11, d), (11, None))]
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.deduplicated(docs_of(spark, rows)).collect())
    assert sum(n for (_, t), n in kept.items() if t in (c, c + " more")) == 1 and {i for i, t in kept if t in (c, c + " more")} == {7}
    assert {k: n for k, n in kept.items() if k[0] != 7} == {(3, a): 1, (5, b): 1, (11, d): 1, (11, None): 1}


# ---------------------------------------------------------------- lines


def brute_lines(texts, min_docs, min_chars):
    strip = " \t\n\x0b\x0c\r"
    keys = [[lower_ascii(line.strip(strip)) for line in (t or "").split("\n")] for t in texts]
    counts = Counter(k for own in keys for k in set(own) if len(k) >= min_chars)
    out = []
    for t, own in zip(texts, keys):
        kept = [line for line, k in zip((t or "").split("\n"), own) if len(k) < min_chars or counts[k] < min_docs]
        out.append((len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("min_docs", "min_chars", "few"), [(2, 1, True), (3, 0, True), (2, 4, False), (10, 1, False)])
def test_lines_by_brute_force(spark, monkeypatch, min_docs, min_chars, few):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    rng = np.random.default_rng(7)
    pool = ["", " ", "Home", "home ", "About us", "é", "ÉTÉ", "\x0bterms", "Terms\x0c", *[f"line {i}" for i in range(30)]]
    rows = ODD + [(100 + k, "\n".join(rng.choice(pool, int(rng.integers(1, 9)))), "en", "s", 1) for k in range(80)]
    out = line_dedup.drop_frequent_lines(docs_of(spark, rows), min_docs, min_chars).collect()
    want = brute_lines([r[1] for r in rows], min_docs, min_chars)
    assert Counter((r["doc_id"], r["ld_n_lines"], r["ld_n_dropped"], r["ld_kept_sha256"]) for r in out) == Counter((row[0], *w) for row, w in zip(rows, want))
    assert all(r["text"] is None or hashlib.sha256(r["text"].encode()).hexdigest() == r["ld_kept_sha256"] for r in out) and all(r["hot"] == "clash" for r in out)


def test_line_runs_compact_and_count_across_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=5, fanout=2)
    counts = Counter()
    rng = np.random.default_rng(8)
    for _ in range(7):
        batch = [(int(h), 0, 1) for h in rng.integers(0, 30, 25)]
        counts.update(h for h, _, _ in batch)
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long, n long"))
    assert len(runs.levels) > 1 and all(len(r) < 2 for r in runs.levels)
    assert {r["h1"] for r in runs.finish().collect()} == {h for h, n in counts.items() if n >= 5}


def test_the_registered_path_makes_two_levels(spark, monkeypatch):
    made = []

    class Watched(line_dedup.LineRuns):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def add(self, batch):
            super().add(batch)
            own = [line_dedup.LineRuns._read(self, [p], line_dedup.OWN).select("h1", "h2") for runs in self.levels for p in runs]
            every = own[0]
            for part in own[1:]:
                every = every.unionByName(part)
            assert every.count() == every.distinct().count()  # a line is new once

    monkeypatch.setattr(line_dedup, "LineRuns", Watched)
    rng = np.random.default_rng(11)
    rows = [(k, "\n".join([f"own {k}", *(f"line {x}" for x in rng.integers(0, 60, 5))]), "en", "s", 1) for k in range(120)]
    out = line_dedup.drop_frequent_lines(docs_of(spark, rows, False), 10, 1)
    want = brute_lines([r[1] for r in rows], 10, 1)
    assert Counter((r["doc_id"], r["ld_n_lines"], r["ld_n_dropped"], r["ld_kept_sha256"]) for r in out.collect()) == Counter((row[0], *w) for row, w in zip(rows, want))
    assert made[0].deepest >= 2


def test_no_lines_in_an_empty_table(spark):
    assert line_dedup.drop_frequent_lines(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- mixing


def sql_mix(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(mixing.ORACLE_SQL).fetchall())


def ours_mix(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df).collect())


def test_mix_matches_sql_and_targets(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = ODD[:6] + [(100 + k, "w " * int(rng.integers(1, 60)), "en", ("big", "b", "c", "d", None)[min(4, int(rng.exponential(0.9)))], 1) for k in range(300)]
    want = sql_mix(rows)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    found = ours_mix(docs_of(spark, rows))
    assert found == want == ours_mix(docs_of(spark, rows))
    taken, target = Counter(), {}
    for (_, size, source_size, goal, got), n in found.items():
        assert got in (0, size, 2 * size)
        taken[source_size, goal] += got * n
        target[source_size, goal] = goal
    assert all(abs(taken[k] - v) <= 130 for k, v in target.items())
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert 1.5 * total - 130 <= sum(taken.values()) <= 1.5 * total


def test_mixed_repeats_documents(spark):
    df = small(spark).withColumn("times", F.lit("clash")).withColumn("key", F.lit("clash"))
    times = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in times.items() if v})


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.mix(docs_of(spark, [(1, "", "en", "a", 0)])).first()["taken"] == 0


# ---------------------------------------------------------------- packing


def brute_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]


def check_pack(df, capacity):
    rows = [(r["doc_id"], brute_ids(r["text"])) for r in df.select("doc_id", "text").collect()]
    want = Counter()
    for i, ids in rows:
        for piece, at in enumerate(range(0, len(ids), capacity)):
            body = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[i, piece, at, len(body) // 4, zlib.crc32(body)] += 1
    out = packing.pack(df, tokenizer_path(), capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in out) / capacity


def test_pack_defined_cases(spark):
    check_pack(docs_of(spark), 64)
    assert packing.pack(docs_of(spark, []), tokenizer_path()).count() == 0


def test_ids_of_texts_without_blanks_in_pieces(monkeypatch):
    import random

    ids, pick = packing.word_ids(tokenizer_path()), random.Random(4)
    letters = ["abcXYZé\u00df", "0123456789abcdef", "日本語テキスト山川", "กขฃคฅ", "ابتثج", "ab'st.!?<|>1가\u0301😀"]
    monkeypatch.setattr(packing, "LONG_CHUNK", 8)
    monkeypatch.setattr(packing, "BLOCK_CHARS", 40)
    for k in range(1200):
        parts = [*letters[k % len(letters)], "'s", "<|endoftext|>"] + [" ", "\n", "\t", "  "] * (k % 2)
        text = "".join(pick.choices(parts, k=pick.randint(0, 90)))
        assert b"".join(ids.in_parts(text)) == np.array(ids.encode(text.replace("\n", " ")), "<u4").tobytes(), text


def test_long_texts_without_blanks_in_constant_memory():
    import subprocess
    import sys

    code = """
import random, resource, sys
from quarrylens.llm import packing
ids, pick = packing.word_ids(sys.argv[1]), random.Random(1)
text = "".join(pick.choices([chr(c) for c in range(0x4E00, 0x5A00)], k=3_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(p) for p in ids.in_parts(text)) // 4
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code, tokenizer_path()], capture_output=True, text=True, timeout=300, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    n, grown = map(int, done.stdout.split())
    assert n > 3_000_000 and grown < 100


def test_quality_learns_from_long_texts_in_bounded_time_and_memory():
    rng, began = np.random.default_rng(0), time.time()
    long = rng.integers(97, 123, 8 << 20, dtype=np.uint8).tobytes()
    chunks = quality.learned_chunks(long, 5, quality.LEARN_CHUNKS)
    places = [long.find(c) for c in chunks]
    part = len(long) / quality.LEARN_CHUNKS
    assert len(chunks) == quality.LEARN_CHUNKS and all(k * part - quality.CHUNK <= at <= (k + 1) * part for k, at in enumerate(places))  # one from every part
    short = b"a" * 5000
    assert quality.learned_chunks(short, 1, quality.LEARN_CHUNKS) == [short[slice(*b)] for b in quality.chunk_bounds(5000)]
    rows = [chunks] + [quality.learned_chunks(rng.integers(97, 123, 400_000, dtype=np.uint8).tobytes(), k, quality.LEARN_CHUNKS) for k in range(12)]
    assert sum(len(c) for own in rows for c in own) <= len(rows) * quality.LEARN_CHUNKS * quality.CHUNK
    quality.fit(rows, np.array([k % 2 for k in range(13)], float), learn_bytes=8 << 20)
    assert time.time() - began < 120


def test_pack_of_the_test_table_is_tight(spark):
    used, least = check_pack(small(spark), 2048)
    assert used <= least * 1.02 + 1


def test_pack_lengths_uses_every_length_and_fills_exactly():
    rng = np.random.default_rng(10)
    for trial in range(30):
        capacity = int(rng.integers(8, 120))
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 6, capacity) * (rng.random(capacity) < 0.5)
        left = counts.copy()
        patterns = packing.pack_lengths(counts)
        for lengths, times in patterns:
            assert sum(lengths) <= capacity and times > 0
            for x in lengths:
                left[x] -= times
        assert not left.any()
        total = int((counts * np.arange(capacity + 1)).sum())
        assert sum(t for _, t in patterns) <= 1.25 * total / capacity + 2


# ---------------------------------------------------------------- classifier


def test_classifier_learns_and_holds_out(spark):
    docs, labels = small(spark, sf="sf0.01"), small(spark, "labels", "sf0.01")
    seen = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in seen if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in seen)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in seen)


def test_classifier_defined_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs_of(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    repeated = quality.classify(docs_of(spark).unionByName(docs_of(spark)).unionByName(docs_of(spark)), labels)  # learns from one row a doc_id
    assert {(r["doc_id"], r["score"]) for r in repeated.collect()} == {(r["doc_id"], r["score"]) for r in out}
    constant = quality.classify(docs_of(spark), labels.where("quality = 1")).select("score").distinct().collect()
    assert len(constant) == 1
    assert quality.classify(docs_of(spark, []), labels.limit(0)).count() == 0


def test_chunks_cover_and_pooling_ignores_neighbours():
    for size in (0, 1, 767, 1024, 1025, 5000, 99_999):
        bounds = quality.chunk_bounds(size)
        assert bounds[0][0] == 0 and bounds[-1][1] == size and all(b[0] < a[1] for a, b in zip(bounds, bounds[1:]))
    net = quality.Network(3)
    texts = [b"", b"a", b"hello world" * 300, b"x" * 5000, bytes(range(256)) * 9]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-6)


def slow_score(net, text):
    """The network by its definition: a loop over chunks and windows."""
    vectors = []
    for a, b in quality.chunk_bounds(len(text)):
        padded = np.frombuffer(text[:] + bytes(2 * quality.WIDTH), np.uint8)
        responses = []
        for at in range(a, max(b, a + 1), quality.STRIDE):
            at -= at % quality.STRIDE
            window = net.embed[padded[at : at + quality.WIDTH]].ravel()
            responses.append(window @ net.filters)
        vectors.append(np.maximum(np.max(responses, axis=0) + net.bias, 0))
    both = np.concatenate([np.mean(vectors, axis=0), np.max(vectors, axis=0)])
    return 1 / (1 + np.exp(-(both @ net.out + net.offset[0])))


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = quality.Network(4)
    texts = [b"", b"a", b"abcdefgh" * 3, *(bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (1000, 1024, 1025, 2000, 5000, 120_000))]
    assert np.allclose(net.scores(texts), [slow_score(net, t) for t in texts], atol=1e-5)


def test_gradients_are_the_numerical_ones():
    rng = np.random.default_rng(6)
    net = quality.Network(2)
    for name in ("embed", "filters", "bias", "out", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks = [[bytes(rng.integers(40, 90, n, dtype=np.uint8)) for n in sizes] for sizes in ([300], [64, 500], [9])]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        out = []
        for own in chunks:
            hidden = []
            for c in own:
                data = np.frombuffer(c + bytes(quality.CHUNK + quality.WIDTH - len(c)), np.uint8)
                hidden.append(np.maximum((net.windows(data) @ net.filters)[: max(1, -(-len(c) // quality.STRIDE))].max(axis=0) + net.bias, 0))
            out.append(np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)]) @ net.out + net.offset[0])
        p = 1 / (1 + np.exp(-np.array(out)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for values, found in zip(net.parameters(), quality.gradients(net, chunks, labels)):
        flat, own = values.reshape(-1), np.asarray(found).reshape(-1)
        for at in rng.choice(len(flat), min(len(flat), 40), replace=False):
            before = flat[at]
            flat[at] = before + 1e-6
            up = loss()
            flat[at] = before - 1e-6
            down = loss()
            flat[at] = before
            assert abs((up - down) / 2e-6 - own[at]) < 2e-4


def test_memory_of_a_long_text_is_a_few_chunks():
    import tracemalloc

    net, text = quality.Network(1), b"some words of a long text " * 300_000
    tracemalloc.start()
    net.scores([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(text)


def test_triples_are_indexed_by_their_sums():
    rng = np.random.default_rng(9)
    counts = np.zeros(61, np.int64)
    counts[rng.integers(1, 61, 25)] = rng.integers(1, 3)
    index = packing.SumIndex(counts)
    for length in [*rng.permutation(np.flatnonzero(counts))]:
        there = np.flatnonzero(index.available)
        want = np.zeros(61, np.int64)
        for a in there:
            for b in there:
                for c in there:
                    if a + b + c <= 60:
                        want[a + b + c] += 1
        assert np.array_equal(index.triples, want)
        index.take([int(length)], int(index.counts[length]))
    assert not index.triples.any() and not index.pairs.any()


def test_a_plain_word_is_held_once_and_encoded_once():
    from quarrylens.llm.packing import WordIds

    asked = []
    ids = WordIds(lambda s: asked.append(s) or [len(s), 7])
    once = lambda n: n.to_bytes(4, "little") + (7).to_bytes(4, "little")
    assert [ids[w] for w in ("word", "Word", "word,", ",")] == [once(4), once(4), once(4) + once(1), once(1)]
    assert asked == ["word", ","] and set(ids) == {"word", "Word", "word,", ","}
    room = ids.room
    assert ids["other"] == once(5) and room - ids.room == 4 * 5 + 8 + 200
