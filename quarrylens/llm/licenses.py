"""Operator 13: license scan by diagonal voting.

Every run of ``GRAM`` words of every document is hashed and joined with the positions at
which the template texts hold the same run.  A hit votes for a diagonal, document position
minus template position, on which a passage copied from the template lies.  Votes are
added up by (text, template, diagonal, block of 64 template positions) as a bit set, so
repeated hits count once and the partial aggregate is one number.  Diagonals a few words
apart, as inserted or left-out words make them, are merged into one candidate span.

Candidates are verified on the words themselves: the words of the span are aligned with
those of the template, and a span whose words agree is evidence for the template's label,
weighed by the share of the template that it holds.  Beside that stand the base places,
where a license's name stands word by word.

Score: the largest share of a template found in a verified span, at least ``NAMED`` if
there is a base place; 0 without either.  A label needs ``LABEL_SHARE`` of its template.

Defined cases: a null or empty text has no words and no labels; repeated rows and exact
copies get the same result each, the votes of equal texts being counted once; a text with
fewer words than a run has base places only; texts of any length are read in blocks;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.license_templates import PHRASES, TEMPLATES
from quarrylens.llm.store import save
from quarrylens.llm.words import word_blocks

GRAM = 5
SLACK = 6  # words that neighbouring diagonals may lie apart
LEAST_VOTED = 0.4  # share of a template's words under a candidate's hits
AGREEMENT = 0.8  # share of a verified span's words that are the template's, in order
LABEL_SHARE = 0.5  # share of a template that its label needs
NAMED = 0.5  # score of a license that is only named
WORD_BITS = 64  # template positions in a bit set
BROADCAST_SPANS = 500_000  # candidate spans, 28 bytes each, that may be broadcast
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Template:
    label: str
    words: list[bytes]


def templates_of(texts: list[tuple[str, str]]) -> list[Template]:
    return [Template(label, [w for block in word_blocks(text.encode()) for w in block]) for label, text in texts]


def rolling_hashes(words: list[bytes], gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` words, by its first word."""
    own = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = max(len(own) - gram + 1, 0)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            total = total * _STEP + own[k : k + n]
    return total.view(np.int64)


def hashed_blocks(text: bytes | None, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the first run, hashes of the runs) of each block of a text."""
    tail: list[bytes] = []
    at = 0
    for own in word_blocks(text):
        words = tail + own
        found = rolling_hashes(words, gram)
        if len(found):
            yield at, found
        at += len(found)
        tail = words[len(found) :]


def text_key() -> list[Column]:
    """128 bits of a text, as two numbers: equal texts vote once."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(GRAM), F.col("text")).alias("k2")]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, template, at): as many rows as the templates have words."""
    rows = [(int(h), k, at) for k, t in enumerate(templates) for at, h in enumerate(rolling_hashes(t.words).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def document_grams(docs: DataFrame) -> DataFrame:
    """(k1, k2, place, gram) of all runs of words of all documents."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            held, size = [], 0
            for row, text in enumerate(batch.column(2)):
                for start, found in hashed_blocks(text.as_py()):
                    held.append((row, start, found))
                    size += len(found)
                    if size > 1 << 18:
                        yield _gram_batch(k1, k2, held)
                        held, size = [], 0
            if held:
                yield _gram_batch(k1, k2, held)

    texts = docs.select(*text_key(), F.col("text").cast("binary").alias("text"))
    blocks = texts.mapInArrow(run, "k1 long, k2 long, start long, grams array<long>")
    return blocks.select("k1", "k2", "start", F.posexplode("grams").alias("step", "gram")).select("k1", "k2", (F.col("start") + F.col("step")).alias("place"), "gram")


def _gram_batch(k1: np.ndarray, k2: np.ndarray, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    rows = np.array([r for r, _, _ in held])
    ends = np.concatenate([[0], np.cumsum([len(f) for _, _, f in held])]).astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f for _, _, f in held])))
    return pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array([s for _, s, _ in held], pa.int64()), grams], ["k1", "k2", "start", "grams"])


def candidate_spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(k1, k2, template, first, last): places in a text, from 0, that one run of neighbouring diagonals covers."""
    hits = document_grams(docs).join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    block = F.floor(F.col("at") / WORD_BITS)
    votes = (
        hits.groupBy("k1", "k2", "template", (F.col("place") - F.col("at")).alias("diagonal"), block.alias("block"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, at % {WORD_BITS})")).alias("voted"), F.min("at").alias("low"), F.max("at").alias("high"))
    )
    by_diagonal = Window.partitionBy("k1", "k2", "template").orderBy("diagonal", "block")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SLACK, F.lit(True))
    runs = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by_diagonal))
    spans = (
        runs.groupBy("k1", "k2", "template", "span", "block")  # diagonals of a run share positions of the template
        .agg(F.bit_or("voted").alias("voted"), F.min(F.col("diagonal") + F.col("low")).alias("first"), F.max(F.col("diagonal") + F.col("high")).alias("last"))
        .groupBy("k1", "k2", "template", "span")
        .agg(F.sum(F.bit_count("voted")).alias("votes"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"))
    )
    runs_of = F.element_at(F.array(*[F.lit(max(len(t.words) - GRAM + 1, 1)) for t in templates]), F.col("template") + 1)
    return spans.where(F.col("votes") >= LEAST_VOTED * LABEL_SHARE * runs_of).select("k1", "k2", "template", "first", "last")


def verified_share(words: list[bytes], template: list[bytes]) -> float:
    """Share of the template that the span's words hold in order; 0 if fewer than ``AGREEMENT`` of them agree."""
    blocks = [b for b in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0
    matched = sum(b.size for b in blocks)
    across = max(blocks[-1].a + blocks[-1].size - blocks[0].a, blocks[-1].b + blocks[-1].size - blocks[0].b)
    return matched / len(template) if matched >= AGREEMENT * across else 0.0


def phrase_places(blocks: Iterator[list[bytes]], phrases: list[tuple[bytes, str]]) -> Iterator[tuple[str, int]]:
    """(label, place of the first word) of every place of every phrase; a phrase may reach over blocks."""
    longest = max(p.count(b" ") + 1 for p, _ in phrases)
    tail: list[bytes] = []
    at = 0
    for own in blocks:
        words = tail + own
        line = b" " + b" ".join(words) + b" "
        for phrase, label in phrases:
            sought, size = b" " + phrase + b" ", phrase.count(b" ") + 1
            found, place, counted = -1, 0, 0
            while (found := line.find(sought, found + 1)) >= 0:
                place, counted = place + line.count(b" ", counted, found), found
                if place + size > len(tail):  # else found with the block before
                    yield label, at - len(tail) + place
        at += len(own)
        tail = words[len(words) - longest + 1 :] if len(words) >= longest else words


def span_words(text: bytes | None, spans: list[tuple[int, int]], margin: int = SLACK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of a span, its words with ``margin`` words around it), holding one block and the spans that reach over its end."""
    order = sorted(range(len(spans)), key=lambda k: spans[k])
    open_: list[tuple[int, list[bytes]]] = []
    at = started = 0
    for own in word_blocks(text):
        end = at + len(own)
        while started < len(order) and spans[order[started]][0] - margin < end:
            open_.append((order[started], []))
            started += 1
        for k, words in open_:
            words += own[max(spans[k][0] - margin - at, 0) : max(spans[k][1] + margin + 1 - at, 0)]
        yield from ((k, words) for k, words in open_ if spans[k][1] + margin < end)
        open_ = [(k, words) for k, words in open_ if spans[k][1] + margin >= end]
        at = end
    yield from open_


def judged(text: bytes | None, spans: list[dict], templates: list[Template], phrases: list[tuple[bytes, str]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text and its candidate spans."""
    n_words = 0

    def counted():
        nonlocal n_words
        for block in word_blocks(text):
            n_words += len(block)
            yield block

    places = list(phrase_places(counted(), phrases))
    base = {label for label, _ in places}
    at = [place for _, place in places]
    labels, score = set(base), NAMED if base else 0.0
    for k, words in span_words(text, [(s["first"], s["last"]) for s in spans]):
        template = templates[spans[k]["template"]]
        share = verified_share(words, template.words)
        score = max(score, share)
        if share >= LABEL_SHARE:
            labels.add(template.label)
    return n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    known, sought = templates_of(templates), [(p.encode(), label) for p, label in phrases]
    spans = save(candidate_spans(docs, known), "license-spans")
    by_text = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    if spans.count() <= BROADCAST_SPANS:
        by_text = F.broadcast(by_text)

    def run(batches):
        for batch in batches:
            rows = [judged(text.as_py(), spans.as_py() or [], known, sought) for text, spans in zip(batch.column(1), batch.column(2))]
            columns = zip(*rows) if rows else [[]] * (len(RESULT) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(RESULT)[1:]))], schema=RESULT)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("bytes"), *text_key())
    return texts.join(by_text, ["k1", "k2"], "left").select("doc_id", "bytes", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
