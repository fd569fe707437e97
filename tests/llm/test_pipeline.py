"""The pipeline as a whole against a plain version of every stage, on documents with all defined cases."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, brute_ids, docs_of, small

from quarrylens.llm import mixing, quality

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out = [""]
    for c in (text or "").translate(LOWER):
        if c in WHITE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain_lines(rows):
    """Lines whose key ten documents hold go from all."""
    keys = lambda text: [line.strip(WHITE).translate(LOWER) for line in (text or "").split("\n")]
    held = Counter(k for r in rows for k in set(keys(r[1])) if k)
    out = []
    for r in rows:
        kept = "\n".join(line for line, key in zip((r[1] or "").split("\n"), keys(r[1])) if held[key] < 10)
        out.append((r[0], kept, r[2], r[3], len(kept)) if r[1] is not None else (r[0], None, r[2], r[3], None))  # null stays null
    return out


def plain_near(rows):
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles the smallest doc_id stays."""
    sets = {}
    for r in rows:
        w = words_of(r[1])
        sets[r[0], r[1]] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
    ids = [k for k in sets if k[0] is not None]
    parent = {k[0]: k[0] for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((root(a[0]), root(b[0])))
                parent[q] = p
    first = {}  # repeated rows are copies of one another too
    for r in rows:
        first.setdefault((r[0], r[1]), r)
    return [r for r in rows if r[0] is None] + [r for k, r in first.items() if k[0] is not None and root(k[0]) == k[0]]


def plain_mix(rows, spark):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows])
    assert len(frame) == len(rows)
    times = {}
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall():
        times.setdefault(doc_id, Counter())[size] = taken // size if size else 0
    return [r for r in rows for _ in range(times[r[0]][len(words_of(r[1]))])]


def as_rows(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.DOCUMENT_COLUMNS).collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("pipeline")
    base = small(spark).select(*corpus_pipeline.DOCUMENT_COLUMNS)
    prose = [" ".join(f"{a}{b}" for b in "abcdefgh" for a in ("wo", "ri", "ta", "me", "su")) + f" tail {k}" for k in range(3)]
    more = [(9001 + k, t, "en", "web", len(t)) for k, t in enumerate(prose)] + [(9101 + k, f"Shared line here\n{prose[0]} own {k}\nand a part of number {k} " * 2, None, None, 1) for k in range(12)]
    docs = base.unionByName(docs_of(spark, ODD, clash=False).where("doc_id IS NULL OR doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 8000)).unionByName(docs_of(spark, more, clash=False))
    docs.withColumn("qc_score", F.lit("clash")).withColumn("n_words", F.lit(1)).repartition(3).write.parquet(f"{place}/documents.parquet")
    small(spark, "labels").write.parquet(f"{place}/labels.parquet")
    return str(place)


def test_every_stage_and_the_whole_run_equal_the_plain_version(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), steps=120)
    monkeypatch.setattr(quality, "train", lambda *tables: model)  # learning has tests of its own
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.DOCUMENT_COLUMNS).collect()]
    kept = [r for r in rows if model.scores([(r[1] or "").encode()])[0] >= quality.THRESHOLD]
    plain = [kept, plain_lines(kept)]
    plain.append(plain_near(plain[-1]))
    plain.append(plain_mix(plain[-1], spark))
    assert 0 < len(plain[2]) < len(plain[1]) and plain[1] != [tuple(r) for r in kept]
    seen = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], plain):
        seen = spark.createDataFrame(stage(spark, seen, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert as_rows(seen) == Counter(expected), name
    want, places = Counter(), defaultdict(list)
    for r in plain[-1]:
        ids = brute_ids(r[1])
        for piece, at in enumerate(range(0, len(ids), 2048)):
            body = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[r[0], piece, at, len(body) // 4, zlib.crc32(body)] += 1
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_run_over_no_documents(spark, tmp_path):
    docs_of(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
