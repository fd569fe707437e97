"""Operator 12: align the tokens of two tokenizers by segment deduplication.

A is a byte-level BPE, B a piece model that puts a space before a text; both see a space
and the text.  Texts are cut into segments before runs of white space, at characters for
which a look through both vocabularies shows that no entry reaches over the cut: the
tokens of a text are then those of its segments in a row (``safe_breaks``).

1. Distinct segments are counted, by tasks first and then by segment.
2. The most frequent segments, as many as a fixed budget of bytes holds, are tokenised and
   aligned once and go to every worker: groups between the byte offsets where tokens of
   both end, and links, the pairs of A and B tokens whose bytes overlap.
3. Documents are composed, some at once: their other segments, few each, are tokenised and
   aligned together there and then, which costs less than a further pass over the texts to
   name them and a join to bring their alignments back.  Each document counts its distinct
   pairs; pairs are added up by tasks and then over all documents.
4. Sums over links come from the segments' sums for the frequent ones, which a document
   keeps by number and count, and for others from a join of the documents' own pairs.

Defined cases: a text that is null, empty, or whose joined A or B bytes are not a space and
the text (one that holds U+2581) has no tokens: zeros, an empty digest, and no part in the
counts; strings of special tokens are plain text; repeated rows are documents of their own;
a text without white space is one segment, however long; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.store import save, shuffle_width

BREAKS = " \n\t"  # characters that segments may start with, if the vocabularies allow
SPACE = "▁"
BLOCK_CHARS = 1 << 18
#: Fixed value: how a byte-level BPE of this kind cuts a text before it merges.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FREQUENT_SEGMENTS, FREQUENT_BYTES = 300_000, 40 << 20  # what every worker holds: segments, and bytes of them
TOGETHER = 60_000  # segments, or 16 characters each, of documents whose new ones are aligned at once
BATCH_ROWS = 2_000  # documents composed before they are sent on
HELD_ENTRIES = 200_000  # of a task's counts of pairs before it sends them on
HELD_SEGMENTS = 600_000  # the same of segments
BROADCAST_PAIRS = 1_000_000  # pairs, 24 bytes each, that may be broadcast
STEPS_AN_OCTAVE = 8  # of the histogram that finds the frequent segments


PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u024f]*")  # characters that every engine sorts alike


# ---------------------------------------------------------------- tokenizers and segments


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and the characters at which texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(alphabet.__getitem__, entry))
        self.b_bytes = [piece_bytes(self.b.id_to_piece(k)) if not self.b.is_control(k) else b"" for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, entries))) for entries in (self.a_bytes, self.b_bytes))
        self.decimal = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.ranked = ranks_of(a_path, self.a_bytes)
        self.alone = self.b.piece_to_id(SPACE)
        self.breaks = safe_breaks(self.a_bytes, self.b_bytes)

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        """A's ids; common characters by rank where the vocabulary's order is that of its merges, which gives the same ids in less time."""
        if not self.ranked:
            return [found.ids for found in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        plain, encode = PLAIN.fullmatch, self.ranked.encode_ordinary
        return [encode(s) if plain(s) else self.a.encode(s, add_special_tokens=False).ids for s in segments]

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids. B adds a space: it stands for a segment's own first one, else it is taken off again."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [[self.alone] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]

    def tokens(self, segments: list[str]) -> tuple[np.ndarray, Tokens]:
        """Whether both give each segment's bytes back, and the tokens of those where they do."""
        raw, whole, sides = [s.encode() for s in segments], np.ones(len(segments), bool), []
        raw_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        for entries, size, ids in ((self.a_bytes, self.a_size, self.encode_a(segments)), (self.b_bytes, self.b_size, self.encode_b(segments))):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            upto = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(n)]
            # All at once, and one by one only if some do not.
            if (upto != raw_ends).any() or b"".join(map(entries.__getitem__, flat.tolist())) != b"".join(raw):
                whole &= np.fromiter((b"".join(map(entries.__getitem__, x)) == r for x, r in zip(ids, raw)), bool, len(raw))
            sides += [flat, n]
        a, n_a, b, n_b = sides
        if not whole.all():
            a, n_a, b, n_b = a[np.repeat(whole, n_a)], n_a[whole], b[np.repeat(whole, n_b)], n_b[whole]
        return whole, Tokens(a, n_a, b, n_b)


@dataclass
class Tokens:
    """Ids of segments in a row, and how many each has, by A and by B."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


def ranks_of(a_path: str, a_bytes: list[bytes]):
    """An encoder by rank for a byte-level BPE whose merges come in the order of its ids, else None."""
    with open(a_path, encoding="utf-8") as source:
        found = json.load(source)
    model, cut = found["model"], found["pre_tokenizer"] or {}
    plain = not found["normalizer"] and not model.get("ignore_merges") and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if not plain or ids != list(range(256, 256 + len(ids))) or len({e for e in a_bytes if e}) != 256 + len(ids):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks={e: k for k, e in enumerate(a_bytes) if e}, special_tokens={})


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: U+2581 is a space, <0xHH> a byte."""
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()


def safe_breaks(a_bytes: list[bytes], b_bytes: list[bytes], wanted: str = BREAKS) -> str:
    """Of ``wanted``, the characters that no entry of either vocabulary holds behind anything but white space.

    A cut before such a character, behind something else, is one that no merge can reach
    over.  Characters other than the space must not follow a space in an entry of B either,
    as B puts one before each segment.  Broken characters count as something else.
    """
    of_a, of_b = ([e.decode("utf-8", "surrogateescape") for e in entries] for entries in (a_bytes, b_bytes))
    found = ""
    for c in wanted:
        behind_text = re.compile(rf"\S{re.escape(c)}")
        if not any(map(behind_text.search, of_a + of_b)) and (c == " " or not any(f" {c}" in e for e in of_b)):
            found += c
    return found


class Segmenter:
    """Cuts texts before white space that starts with one of ``breaks`` and follows something else."""

    def __init__(self, breaks: str):
        first = re.escape(breaks)
        self.segment = re.compile(rf"\s*\S+(?:[^\S{first}]\s*\S*)*|\s+") if breaks else re.compile(r"(?s).+")
        self.odd_space = re.compile(rf"[^\S{first}]") if breaks else self.segment
        self.plain_segment = re.compile(r"\s*\S+|\s+")  # the same where there is no other white space
        self.cut = re.compile(rf"\S(?=[{first}])") if breaks else re.compile(r"(?!)")

    def blocks(self, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
        """Segments of a space and the text, a list a block."""
        text, at = " " + text, 0
        segment = self.segment if self.odd_space.search(text) else self.plain_segment
        while at < len(text):
            cut = self.cut.search(text, at + block_chars) if at + block_chars < len(text) else None
            end = cut.end() if cut else len(text)
            yield segment.findall(text, at, end)
            at = end


# ---------------------------------------------------------------- alignment of segments


@dataclass
class Alignments:
    """Of segments in a row: the text of the groups, numbers, and all links, A id << 32 | B id, with where each segment's end."""

    groups: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    ends: np.ndarray

    def links_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of these segments in a row, and how many each has."""
        n = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
        upto = np.cumsum(n)
        return self.links[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.ends[at] - upto, n)], n


def alignments(t: Tokenizers, tokens: Tokens) -> Alignments:
    """Aligns segments whose A and B tokens have the same bytes; all of them in one go as if they were one text."""
    a, n_a, b, n_b = tokens.a, tokens.n_a, tokens.b, tokens.n_b
    if not len(n_a):
        return Alignments([], n_a, n_b, n_a, n_a, n_a)
    a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    segment_ends = a_ends[np.cumsum(n_a) - 1]
    n_groups = np.diff(np.searchsorted(both, segment_ends, "right"), prepend=0)

    # Tokens by group, A's before B's, and what stands behind each.
    side = np.concatenate([2 * np.searchsorted(both, a_ends), 2 * np.searchsorted(both, b_ends) + 1])
    order = np.argsort(side, kind="stable")
    side, behind = side[order], np.full(len(order), 2)
    behind[:-1][side[:-1] == side[1:]] = 0
    behind[:-1][(side[:-1] % 2 == 0) & (side[1:] == side[:-1] + 1)] = 1
    behind[np.cumsum(n_a + n_b) - 1] = 3
    text = "".join(chain.from_iterable(zip(map(t.decimal.__getitem__, np.concatenate([a, b])[order].tolist()), map(",|;\n".__getitem__, behind.tolist()))))

    # A token's links: from the B token that holds its first byte to the one that holds its last.
    first, last = np.searchsorted(b_ends, a_ends - t.a_size[a], "right"), np.searchsorted(b_ends, a_ends)
    each = last - first + 1
    upto = np.cumsum(each)
    links = np.repeat(a, each) << 32 | b[np.arange(upto[-1]) + np.repeat(first - upto + each, each)]
    return Alignments(text.split("\n")[:-1], n_a, n_b, n_groups, links, upto[np.cumsum(n_a) - 1])


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Once a Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


ALIGNED = pa.schema(
    [("segment", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))]
)
ALIGNED_SQL = "segment string, n long, size long, ok boolean, n_a long, n_b long, n_groups long, groups string, links array<long>"


def aligned_segments(counted: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """counted (segment, n) with alignment; ok is false, and the alignment empty, where a tokenizer does not give the segment's bytes back."""

    def run(batches):
        t = tokenizers(a_path, b_path)
        for batch in batches:
            segments = batch.column(0).to_pylist()
            ok, tokens = t.tokens(segments)
            good, found = np.flatnonzero(ok), alignments(t, tokens)
            n_links, groups = np.zeros(len(ok), np.int64), [""] * len(ok)
            n_links[good] = np.diff(found.ends, prepend=0)
            for k, text in zip(good.tolist(), found.groups):
                groups[k] = text
            numbers = []
            for own in (found.n_a, found.n_b, found.n_groups):
                column = np.zeros(len(ok), np.int64)
                column[good] = own
                numbers.append(pa.array(column))
            size = np.array([len(s) + len(g) for s, g in zip(segments, groups)]) + 8 * n_links
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pa.array(found.links))
            columns = [batch.column(0), batch.column(1), pa.array(size), pa.array(ok), *numbers, pa.array(groups, pa.string()), links]
            yield pa.RecordBatch.from_arrays(columns, schema=ALIGNED)

    return counted.mapInArrow(run, ALIGNED_SQL)


def counted_segments(texts: DataFrame, breaks: str) -> DataFrame:
    """(segment, n): distinct segments with the number of documents that hold them."""
    schema = pa.schema([("segment", pa.string()), ("n", pa.int64())])

    def run(batches):
        cut, held = Segmenter(breaks), Counter()
        for batch in batches:
            for text in batch.column(0):
                own: set[str] = set()
                for block in cut.blocks(text.as_py()):
                    own.update(block)
                held.update(own)
                if len(held) > HELD_SEGMENTS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def step_of_count():
    """Rounded-down logarithm of a segment's count."""
    return F.floor(F.log2("n") * STEPS_AN_OCTAVE)


def frequent_from(segments: DataFrame, most_rows: int, most_bytes: int) -> int:
    """Smallest step of a count such that all segments (n, size) from it on fit the limits."""
    rows = sorted(((r["step"], r["rows"], r["size"]) for r in segments.groupBy(step_of_count().alias("step")).agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()), reverse=True)
    least = rows[0][0] + 1 if rows else 0
    for value, n, size in rows:
        most_rows, most_bytes = most_rows - n, most_bytes - size
        if most_rows < 0 or most_bytes < 0:
            break
        least = value
    return least


# ---------------------------------------------------------------- documents


class Table:
    """Aligned segments by text, with their links as places in one array."""

    def __init__(self, rows: pa.Table):
        self.place = {s: k for k, s in enumerate(rows["segment"].to_pylist())}
        self.groups = rows["groups"].to_pylist() or [""]
        self.ok = rows["ok"].to_numpy()
        self.sums = np.stack([rows[c].to_numpy() for c in ("n_a", "n_b", "n_groups")], 1) if len(self.place) else np.zeros((0, 3), np.int64)
        links = rows["links"].combine_chunks()
        self.n_links = np.diff(links.offsets.to_numpy()) if len(links) else np.zeros(0, np.int64)
        self.start = np.cumsum(self.n_links) - self.n_links
        self.pairs, link = np.unique(links.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        self.link = link.astype(np.int32)

    def places_of(self, block: list[str]) -> np.ndarray:
        """Places of segments, -1 for those that are not here."""
        return np.fromiter(map(self.place.get, block, repeat(-1)), np.int64, len(block))

    def links_of(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that these segments link."""
        n = self.n_links[places]
        ends = np.cumsum(n)
        return self.link[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[places] - ends + n, n)]


_tables: dict[str, Table] = {}


def table_of(token: str, held) -> Table:
    """The table of a broadcast, built once a worker."""
    if token not in _tables:
        _tables.clear()
        _tables[token] = Table(held.value)
    return _tables[token]


class Composing:
    """What a document's segments have come to so far."""

    def __init__(self):
        self.ok, self.begun, self.digest = True, False, hashlib.sha256()
        self.sums = np.zeros(4, np.int64)  # n_a, n_b, n_groups, n_links
        self.used: list[tuple[np.ndarray, np.ndarray]] = []  # places in the table and how often
        self.others: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, block: list[str], at: np.ndarray, table: Table, new: dict[str, int], found: Alignments) -> None:
        """A block's alignments in order; ``new`` has the places in ``found`` of segments outside the table, -1 where a tokenizer fails."""
        texts = list(map(table.groups.__getitem__, at.tolist()))  # -1 takes the last one, which is put right below
        outside = np.flatnonzero(at < 0).tolist()
        if outside:
            own = np.array([new[block[k]] for k in outside])
            if own.min() < 0:
                self.ok = False
                return
            for k, place in zip(outside, own.tolist()):
                texts[k] = found.groups[place]
            distinct, n = np.unique(own, return_counts=True)
            links, n_links = found.links_of(distinct)
            self.sums += [int(n @ x) for x in (found.n_a[distinct], found.n_b[distinct], found.n_groups[distinct], n_links)]
            self.others.append(links)
            self.times.append(np.repeat(n, n_links))
            at = at[at >= 0]
        if not table.ok[at].all():
            self.ok = False
            return
        self.sums[:3] += table.sums[at].sum(0)
        self.sums[3] += table.n_links[at].sum()
        self.used.append(np.unique(at, return_counts=True))
        self.digest.update(((";" if self.begun else "") + ";".join(texts)).encode())
        self.begun = True

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table and how often the document has each."""
        return added([x for x, _ in self.used], [n for _, n in self.used]) if self.ok else (NONE, NONE)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the document's other segments, and how often it links them."""
        return added(self.others, self.times) if self.ok else (NONE, NONE)


def added(values: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, with their times added up."""
    if not values:
        return NONE, NONE
    if len(values) == 1 and not (np.diff(values[0]) <= 0).any():
        return values[0], times[0]
    out, inverse = np.unique(np.concatenate(values), return_inverse=True)
    return out, np.bincount(inverse, np.concatenate(times), len(out)).astype(np.int64)


NONE = np.zeros(0, np.int64)


def compose(documents: list[Composing], blocks: Iterator[tuple[int, list[str]]], table: Table, t: Tokenizers) -> None:
    """Adds (document, block) to the documents, some blocks at once: what they have outside the table is aligned together."""
    waiting, size = [], 0

    def flush() -> None:
        names = list({block[i] for k, block, places in waiting if documents[k].ok for i in np.flatnonzero(places < 0).tolist()})
        ok, tokens = t.tokens(names)
        new = dict(zip(names, np.where(ok, np.cumsum(ok) - 1, -1).tolist()))
        found = alignments(t, tokens)
        for k, block, places in waiting:
            if documents[k].ok:
                documents[k].add(block, places, table, new, found)
        waiting.clear()

    for k, block in blocks:
        waiting.append((k, block, table.places_of(block)))
        size += max(len(block), sum(map(len, block)) // 16)
        if size >= TOGETHER:
            flush()
            size = 0
    flush()


COMPOSED = pa.schema([
    ("rid", pa.int64()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("pair", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()),
])
COMPOSED_SQL = "rid long, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, counts array<int>, pairs array<long>, times array<long>, pair long, n long, kind int"
DOCUMENT, PAIR = 0, 1


def _pair_batch(pairs, counts) -> pa.RecordBatch:
    n = len(counts)
    empty = [pa.nulls(n, f.type) for f in list(COMPOSED)[:11]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()), pa.array(np.full(n, PAIR, np.int32))], schema=COMPOSED)


def composed_documents(rows: DataFrame, held, token: str, a_path: str, b_path: str) -> DataFrame:
    """rows (rid, text) -> a row a document, and rows of kind PAIR with a task's counts of the documents that hold each pair."""

    def run(batches):
        t = tokenizers(a_path, b_path)
        table, cut = table_of(token, held), Segmenter(t.breaks)
        counts, others = np.zeros(len(table.pairs), np.int64), Counter()
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            documents = [Composing() for _ in range(batch.num_rows)]
            compose(documents, ((k, block) for k, text in enumerate(batch.column(1)) for block in cut.blocks(text.as_py())), table, t)
            out = []
            for c in documents:
                (places, n), (pairs, times) = c.places(), c.pairs()
                out.append((c.ok, *(c.sums.tolist() if c.ok else [0] * 4), c.digest.hexdigest() if c.ok else "", places.astype(np.int32), n.astype(np.int32), pairs, times))
                inside = np.unique(table.links_of(places))
                counts[inside] += 1
                if len(pairs):
                    at_pair = np.searchsorted(table.pairs, pairs)
                    there = at_pair < len(table.pairs)
                    there[there] = table.pairs[at_pair[there]] == pairs[there]
                    counts[np.setdiff1d(at_pair[there], inside, assume_unique=True)] += 1
                    others.update(pairs[~there].tolist())
                    if len(others) > HELD_ENTRIES:
                        yield _pair_batch(list(others), list(others.values()))
                        others = Counter()
            columns = list(zip(*out)) if out else [[]] * 10
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(COMPOSED)[1:11])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, DOCUMENT, np.int32))], schema=COMPOSED
            )
        there = np.flatnonzero(counts)
        yield _pair_batch(table.pairs[there], counts[there])
        yield _pair_batch(list(others), list(others.values()))

    return rows.mapInArrow(run, COMPOSED_SQL)


def summed_documents(documents: DataFrame, sums) -> DataFrame:
    """(rid, n_best, count_sum) over a document's segments in the table, from their numbers."""

    def run(batches):
        own = sums.value
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy()
            places, counts = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(own[places] * counts[:, None].astype(np.int64), 0)])
            ends = np.cumsum(n)
            out = upto[ends] - upto[ends - n]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], ["rid", "n_best", "count_sum"])

    return documents.select("rid", "places", "counts").mapInArrow(run, "rid long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, frequent_segments: int = FREQUENT_SEGMENTS, frequent_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    breaks = tokenizers(a_path, b_path).breaks
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid")), "align-texts")
    texts = rows.where("text IS NOT NULL")

    if texts.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a file or two
        texts = texts.repartition(shuffle_width(spark))

    counted = save(counted_segments(texts, breaks).where("n > 1"), "align-counts")
    fitting = step_of_count() >= frequent_from(counted.withColumn("size", F.length("segment")), frequent_segments, frequent_bytes)
    aligned = save(aligned_segments(counted.where(fitting), a_path, b_path), "align-segments")
    frequent = step_of_count() >= frequent_from(aligned, frequent_segments, frequent_bytes)  # the alignments fit as well
    # At most ``frequent_segments`` rows; ordered, so that the sums asked for below come in the same order.
    order = [("n", "descending"), ("segment", "ascending")]
    first = aligned.where(frequent).select("segment", "n", "ok", "n_a", "n_b", "n_groups", "groups", "links").toArrow().sort_by(order)
    held, token = spark.sparkContext.broadcast(first), uuid.uuid4().hex

    both = save(composed_documents(texts.select("rid", "text"), held, token, a_path, b_path), "align-documents", ["kind"])
    documents = both.where(F.col("kind") == DOCUMENT).drop("pair", "n", "kind")

    pairs = save(both.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "align-pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # a row an entry of A's vocabulary at most
    ranked = pairs.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if pairs.count() <= BROADCAST_PAIRS:
        ranked = F.broadcast(ranked)
    summed = aligned.where(frequent).select("segment", F.explode("links").alias("pair")).join(ranked, "pair").groupBy("segment").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    own = aligned.where(frequent).select("segment", "n").join(summed, "segment", "left").na.fill(0).toArrow().sort_by(order)
    sums = spark.sparkContext.broadcast(np.stack([own["n_best"].to_numpy(), own["count_sum"].to_numpy()], 1))

    linked = documents.select("rid", F.inline(F.arrays_zip("pairs", "times"))).join(ranked, F.col("pairs") == F.col("pair"))
    more = linked.groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    totals = summed_documents(documents, sums).unionByName(more).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0).cast("long").alias(c)
    return (
        rows.select("doc_id", "rid").join(documents.drop("places", "counts", "pairs", "times").join(totals, "rid"), "rid", "left")
        .select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    )
