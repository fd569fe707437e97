"""Importance resampling, token alignment and license scan against plain versions that share no code with them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quarrylens.llm import importance, licenses, token_align
from quarrylens.llm.entries import op11_importance_resampling, op12_token_alignment, op13_license_scan, tokenizer_path
from quarrylens.llm.license_templates import TEMPLATES
from quarrylens.llm.words import word_blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, k1 int, place string, n int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def table(spark, texts, start=1):
    """Rows with columns of clashing names beside the texts."""
    return spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in enumerate(texts, start)], SCHEMA)


def test_word_blocks_meet_no_border():
    text = "ABc-ÄÖ 12x日本 " * 50
    for size in (1, 7, 64, 1 << 20):
        assert [w.decode() for b in word_blocks(text.encode(), size) for w in b] == words_of(text)


# ---------------------------------------------------------------- 11


def plain_resampling(docs, target, percent, min_words, buckets):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    n, m = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * n) / ((s[b] + 1) * m)))
    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_plain_version(spark):
    pick = random.Random(3)
    vocabulary = ["Alpha", "beta", "gämma", "日本", "x1", "the", "of"]
    texts = [" ".join(pick.choices(vocabulary, k=pick.randint(0, 60))) for _ in range(300)] + [None, "", "--- ...", texts_end := "one two"]
    assert texts_end
    target = ["alpha beta the the of", "gämma x1 of beta", None]
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, texts[0], "", 0, "", 0)], SCHEMA))
    plain = plain_resampling([(k, t) for k, t in enumerate(texts, 1)] + [(None, texts[0])], target, 35, 5, 500)
    assert drawn(importance.resample(docs, table(spark, target), percent=35, min_words=5, buckets=500)) == plain


def test_resampling_of_repeated_rows_ranks_each(spark):
    docs = table(spark, ["a b c"] * 3).selectExpr("cast(7 as long) doc_id", "text").repartition(2)
    out = importance.resample(docs, table(spark, ["a"]), percent=67, min_words=1).collect()
    assert sorted(r["rank"] or 0 for r in out) == [0, 1, 2]


def test_resampling_of_nothing(spark):
    assert importance.resample(table(spark, []), table(spark, []), percent=50).count() == 0
    assert [r["rank"] for r in importance.resample(table(spark, ["short"]), table(spark, [])).collect()] == [None]


@pytest.mark.parametrize("ties", [False, True])
def test_kth_key_is_exact(spark, ties):
    pick = random.Random(5)
    keys = [(pick.randint(-3, 3) if ties else pick.randint(-(1 << 62), 1 << 62), pick.choice([-5, 0, 9, importance.HIGHEST]), k) for k in range(400)]
    rows = spark.createDataFrame(keys, "by_score long, by_id long, row long").cache()
    for k in (1, 2, 57, 399, 400):
        assert sorted(map(tuple, rows.where(importance.kth_key(rows, k).holds()).collect())) == sorted(keys)[:k]


def test_feature_runs_meet_no_border(monkeypatch):
    text = ("Some words, of ONE text " * 40).encode()
    whole = sorted(b for _, found in importance.feature_buckets(text) for b in found.tolist())
    monkeypatch.setattr(importance, "word_blocks", lambda t: word_blocks(t, 9))
    assert sorted(b for _, found in importance.feature_buckets(text) for b in found.tolist()) == whole


def test_registered_resampling_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = op11_importance_resampling(spark, SF)
    assert [kind for _, kind in out.dtypes] == ["bigint"] * 5
    assert drawn(out) == plain_resampling(docs, target, 5, 20, 10_000)


# ---------------------------------------------------------------- 12


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def gpt_bytes():
    """Byte-level alphabet from the tokenizer library itself: each byte's character is what a byte token decodes from."""
    from tokenizers.pre_tokenizers import ByteLevel

    assert len(ByteLevel.alphabet()) == 256
    order = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, extra = {chr(b): b for b in order}, 0
    for b in range(256):
        if b not in order:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def test_byte_alphabet():
    assert token_align.byte_alphabet() == gpt_bytes()


def plain_alignment(docs, both):
    """Whole texts at once, byte by byte."""
    a, b = both
    alphabet, rows, pair_docs = gpt_bytes(), {}, Counter()
    for key, text in docs:
        links, groups, na, nb = [], [], 0, 0
        if text:
            ta = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                tb.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
            raw = (" " + text).encode()
            if b"".join(x for _, x in ta) == raw == b"".join(x for _, x in tb):
                na, nb = len(ta), len(tb)
                ends = []
                for side in (ta, tb):
                    at, own = 0, []
                    for i, x in side:
                        own.append((at, at + len(x), i))
                        at += len(x)
                    ends.append(own)
                j = 0
                for s, e, i in ends[0]:
                    while ends[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < nb and ends[1][k][0] < e:
                        links.append((i, ends[1][k][2]))
                        k += 1
                cuts = {e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]}
                group = [[], []]
                open_b = iter(ends[1])
                for s, e, i in ends[0]:
                    group[0].append(i)
                    if e in cuts:
                        for bs, be, bi in open_b:
                            group[1].append(bi)
                            if be == e:
                                break
                        groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                        group = [[], []]
        rows[key] = (na, nb, groups, links)
        pair_docs.update(set(links))
    most = defaultdict(int)
    for (x, _), n in pair_docs.items():
        most[x] = max(most[x], n)
    return {
        key: (na, nb, len(groups), len(links), sum(pair_docs[p] == most[p[0]] for p in links), sum(pair_docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "")
        for key, (na, nb, groups, links) in rows.items()
    }


def aligned(out):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out.collect()}


ODD = [None, "", " ", "\n", "  \n x", "a▁b", "it's <|endoftext|> <s>", "\x00 z", "日本語 テキスト", "a\xa0b c\x1cd \x85 e", "trailing  ", "tab\tand\r\nline", "𝔘😀 ☃", "ab " * 40, "x" * 3000, "foo foo foo", "foo foo foo"]


@pytest.mark.parametrize("limits", [{}, {"frequent_segments": 3}, {"frequent_segments": 0}, {"frequent_bytes": 400}])
def test_alignment_equals_plain_version(spark, both, limits):
    pick = random.Random(11)
    words = ["Foo", "bar,", "naïve", "'s", "12345", "under_score", "\n", "unseenish", "日本", "  "]
    texts = ODD + [" ".join(pick.choices(words, k=pick.randint(1, 30))) for _ in range(60)]
    out = token_align.align(table(spark, texts).repartition(3), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), **limits)
    assert aligned(out) == plain_alignment(list(enumerate(texts, 1)), both)


def test_alignment_of_nothing(spark):
    assert token_align.align(table(spark, []), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).count() == 0
    only_null = token_align.align(table(spark, [None, ""]), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert aligned(only_null) == {1: (0,) * 6 + ("",), 2: (0,) * 6 + ("",)}


def test_alignment_composes_in_one_pass_that_shuffles_no_text(spark, both, monkeypatch):
    plans, save = {}, token_align.save

    def noted(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(df, name, *more)

    monkeypatch.setattr(token_align, "save", noted)
    texts = [f"the same words, word{k % 7} and seldom{k}" for k in range(64)]
    out = token_align.align(table(spark, texts).repartition(16), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), frequent_segments=4)
    assert aligned(out) == plain_alignment(list(enumerate(texts, 1)), both)
    composing = plans["align-documents"]
    assert composing.count("MapInArrow") == 1 and "Join" not in composing and "Exchange" not in composing


def test_long_segments_are_aligned_a_few_at_a_time(monkeypatch):
    t = token_align.tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    sizes, tokens = [], t.tokens
    monkeypatch.setattr(t, "tokens", lambda names: (sizes.append(sum(map(len, names))), tokens(names))[1], raising=False)
    nothing = token_align.Table(pa.Table.from_batches([], schema=token_align.ALIGNED))
    documents = [token_align.Composing() for _ in range(100)]
    token_align.compose(documents, ((k, [f" {k}-" + "ab,cd" * 4000]) for k in range(100)), nothing, t)
    assert all(d.ok and d.sums[0] > 4000 for d in documents)
    assert sum(sizes) > 2_000_000 and max(sizes) < 1_000_000


def test_segments_tokenise_as_the_whole(both):
    t = token_align.tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert t.breaks == " \n\t"
    cut, pick = token_align.Segmenter(t.breaks), random.Random(2)
    parts = ["foo", "'s", "23", ".", "\n", "\t", " ", "  ", "\xa0", "\x1c", "é", "日本", "<s>", "\x00", "\r", "᠎", "﻿", "\x85", "​"]
    for _ in range(2000):
        text = "".join(pick.choices(parts, k=pick.randint(1, 12)))
        segments = [s for block in cut.blocks(text, 3) for s in block]
        assert "".join(segments) == " " + text
        assert [i for ids in t.encode_a(segments) for i in ids] == both[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in t.encode_b(segments) for i in ids] == both[1].encode(text)


def test_crossing_entries_forbid_a_break():
    assert token_align.safe_breaks([b"a", b"a\n"], [b" b"]) == " \t"
    assert token_align.safe_breaks([b"a"], [b"b ", b" \t"]) == "\n"


def test_registered_alignment_equals_plain_version(spark, both):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert aligned(op12_token_alignment(spark, SF)) == plain_alignment(docs, both)


# ---------------------------------------------------------------- 13


def plain_base(text):
    words, found = words_of(text), []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def scanned(out):
    return {r["doc_id"]: r for r in out.collect()}


def test_license_base_places_and_planted_texts(spark):
    mit, bsd, isc = TEMPLATES[0][1], TEMPLATES[2][1], TEMPLATES[3][1]
    filler = "wholly unrelated prose about rivers and boats " * 30
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 17) + " extra words here"
    texts = [
        mit, filler + bsd + filler, filler + edited + filler, filler, None, "", "MIT License MIT license; cc-by", "GNU General\nPublic License GNU general public license",
        " ".join(mit.split()[:30]), " ".join(reversed(mit.split())), isc + " " + mit, mit, filler * 40 + "Licensed under CC BY-NC 4.0.",
    ]
    out = scanned(licenses.scan(table(spark, texts).repartition(2)))
    for k, text in enumerate(texts, 1):
        r = out[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[1]["labels"] == "mit" and out[1]["score"] == 1.0 and out[12]["labels"] == "mit"
    assert out[2]["labels"] == "bsd" and out[2]["score"] == 1.0
    assert out[3]["labels"] == "mit" and 0.8 < out[3]["score"] < 1
    assert all(out[k]["labels"] == "" and out[k]["score"] == 0 for k in (4, 5, 6, 10))
    assert out[7]["labels"] == "cc-by,mit" and out[7]["score"] == licenses.NAMED
    assert out[9]["labels"] == "" and 0 < out[9]["score"] < licenses.LABEL_SHARE
    assert out[11]["labels"] == "isc,mit"
    assert out[13]["labels"] == "cc-by,cc-by-nc" and out[13]["score"] == 1.0


def test_license_shuffle_join_gives_the_same(spark, monkeypatch):
    texts = [TEMPLATES[0][1], "x " + TEMPLATES[4][1], "nothing", TEMPLATES[0][1]]
    one = licenses.scan(table(spark, texts)).orderBy("doc_id").collect()
    monkeypatch.setattr(licenses, "BROADCAST_SPANS", 0)
    assert licenses.scan(table(spark, texts)).orderBy("doc_id").collect() == one


def test_license_blocks_meet_no_border(monkeypatch):
    text = ("A b, GNU General Public License. " * 20 + TEMPLATES[0][1] + " mit License apache license").encode()
    known = licenses.templates_of(TEMPLATES)
    phrases = [(p.encode(), label) for p, label in licenses.PHRASES]
    n = len(words_of(text.decode()))
    spans = [{"template": 0, "first": 118, "last": 210}, {"template": 0, "first": 120, "last": n + 5}]
    whole, hashes = licenses.judged(text, spans, known, phrases), [h for _, f in licenses.hashed_blocks(text) for h in f.tolist()]
    assert len(hashes) == n - licenses.GRAM + 1
    for size in (1, 10, 100):
        monkeypatch.setattr(licenses, "word_blocks", lambda t, size=size: word_blocks(t, size))
        assert licenses.judged(text, spans, known, phrases) == whole
        found = list(licenses.hashed_blocks(text))
        assert [h for _, f in found for h in f.tolist()] == hashes and [s for s, _ in found] == [sum(len(f) for _, f in found[:k]) for k in range(len(found))]


def test_license_scan_of_nothing_and_of_the_registered_table(spark):
    assert licenses.scan(table(spark, [])).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = scanned(op13_license_scan(spark, SF))
    assert {k: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for k, r in out.items()} == {k: plain_base(t) for k, t in docs.items()}
