"""Operator 3: pack token sequences by exact-complement hashing, then best fit.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the plan
is made on the histogram of lengths: patterns of lengths with how often each is used.
Index of sums: which lengths are available (singles), how many available pairs give each
sum (pairs), and a single plus a pair (triples).  From the longest length down, a gap is
filled exactly by a single, pair or triple as often as the counts allow; what is left is
packed by best fit.  Pieces then take places by their rank within their length; ranks are
added up over partitions, so a very common length is not gathered anywhere.

Defined cases: a null or blank text is one end-of-text id; a document longer than the
capacity is cut into full pieces and a rest; rows with null or repeated doc_id are
documents like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from struct import pack as pack_numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.store import save
from quarrylens.llm.token_align import byte_alphabet

CAPACITY = 2048
END_ID = 0
TOKENIZER_FILE = "word_bpe_49k.json"
HELD_BYTES, HELD_CHUNK = 128 << 20, 256  # of chunks and ids that a worker holds, and the longest chunk that it holds
ENTRY_BYTES = 200  # of objects and table places an entry
LONG_CHUNK = 4096  # characters without a blank above which a chunk is encoded in pieces
BLOCK_CHARS = 1 << 20  # characters of a text whose words are held at once
BLANKS = " \n\t"
BLANK = re.compile(f"[{BLANKS}]")
SPECIAL = 15  # characters of the longest special token that a text may spell
#: Latin letters that neither NFC nor lower-casing can join to what follows, then ASCII punctuation but the apostrophe.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit numbers."""
    return pack_numbers(f"<{len(ids)}I", *ids)


class Cuts:
    """Where a chunk without blanks may be cut so that its ids are those of the pieces in a row.

    Between kinds of characters the tokenizer cuts itself.  Inside a run of letters a cut is
    one that no vocabulary entry reaches over; the letter behind it then goes with the
    piece, which must not end a word there, and its own ids are taken off again.
    """

    def __init__(self, vocabulary: Iterable[str], encode: Callable[[str], list[int]]):
        self.encode = encode
        self.meet = np.zeros((256, 256), bool)  # bytes that stand behind one another in some entry
        alphabet = byte_alphabet()
        for entry in vocabulary:
            raw = [alphabet[c] for c in entry.removesuffix("</w>") if c in alphabet]
            self.meet[raw[:-1], raw[1:]] = True

    def kind(self, before: str, behind: str) -> str | None:
        """"between" kinds of characters, "inside" a run of letters, or None if a cut is not known to be safe."""
        if unicodedata.normalize("NFC", before + behind) != before + behind or "\u1100" <= behind <= "\u11ff" or "\ua960" <= behind <= "\ua97f" or "\ud7b0" <= behind <= "\ud7ff":
            return None
        a, b = unicodedata.category(before)[0], unicodedata.category(behind)[0]
        if a == "M" or b == "M":
            return None
        if a == "N" or b == "N" or (a == "L") != (b == "L"):
            return None if before == "'" else "between"  # 's and the like
        if a != "L" or before.lower() != before or behind.lower() != behind:
            return None
        return None if self.meet[before.encode()[-1], behind.encode()[0]] else "inside"

    def pieces(self, chunk: str) -> Iterator[list[int]]:
        """Ids of the chunk, a piece of some LONG_CHUNK characters at a time, as far as cuts are found."""
        at = 0
        while at < len(chunk):
            cut = at + LONG_CHUNK
            how = None
            while cut < len(chunk):
                if "<|" not in chunk[max(cut - SPECIAL, 0) : cut + 1]:
                    how = self.kind(chunk[cut - 1], chunk[cut])
                    if how:
                        break
                cut += 1
            if how == "inside":
                ids = self.encode(chunk[at : cut + 1])
                yield ids[: len(ids) - len(self.encode(chunk[cut]))]
            else:
                yield self.encode(chunk[at:cut])
            at = cut


class WordIds(dict):
    """Ids of a chunk without blanks, as little-endian unsigned 32-bit bytes, from the tokenizer once a chunk.

    The tokenizer separates at white space and between letters and punctuation, so a
    chunk's ids do not depend on its neighbours, and a plain word's parts are encoded apart.
    """

    def __init__(self, encode: Callable[[str], list[int]], cuts: Cuts | None = None):
        self.encode = encode
        self.cuts = cuts
        self.room = HELD_BYTES

    def _fits(self, chunk: str, ids: bytes) -> bool:
        size = 4 * len(chunk) + len(ids) + ENTRY_BYTES
        if len(chunk) > HELD_CHUNK or size > self.room:
            return False
        self.room -= size
        return True

    def _part(self, part: str) -> bytes:
        """A part is held as the chunk that it would be, so a plain word in lower case has one entry."""
        ids = self.get(part)
        if ids is None:
            ids = little_endian(self.encode(part))
            if self._fits(part, ids):
                self[part] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if self.cuts and len(chunk) > LONG_CHUNK:
            return b"".join(map(little_endian, self.cuts.pieces(chunk)))
        plain = PLAIN_WORD.fullmatch(chunk)
        if plain and "<|" not in chunk:
            ids = self._part(plain[1].lower()) + (self._part(plain[2]) if plain[2] else b"")
            if chunk in self:
                return ids
        else:
            ids = little_endian(self.encode(chunk))
        if self._fits(chunk, ids):
            self[chunk] = ids
        return ids

    def document(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))

    def in_parts(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text in parts; of a long one some blocks up to a blank, and what has no blank in pieces."""
        text, at = text or "", 0
        while len(text) - at > BLOCK_CHARS:
            blank = BLANK.search(text, at + BLOCK_CHARS)
            end = blank.start() if blank else len(text)
            if self.cuts and end - at > BLOCK_CHARS + LONG_CHUNK:  # a run without blanks begins in this block
                first = max(text.rfind(c, at, at + BLOCK_CHARS) for c in BLANKS)
                if first >= at:
                    yield self.document(text[at:first])
                    at = first + 1
                for ids in self.cuts.pieces(text[at:end]):
                    yield little_endian(ids)
            else:
                yield self.document(text[at:end])
            at = end
        yield self.document(text[at:])


_held: dict[str, WordIds] = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """One table a Python worker and tokenizer file."""
    if tokenizer_path not in _held:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        encode = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
        _held[tokenizer_path] = WordIds(encode, Cuts(tokenizer.get_vocab(with_added_tokens=False), encode))
    return _held[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a document's ids with END_ID behind them, cut only if too long."""
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        ids_of = word_ids(tokenizer_path)
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), [[] for _ in range(5)]
            for name, text in zip(names, batch.column(1)):
                open_, piece = bytearray(), 0
                for data in chain(ids_of.in_parts(text.as_py()), (end,)):
                    open_ += data
                    while len(open_) > 4 * capacity or data is end:
                        body = open_[: 4 * capacity]
                        for column, value in zip(rows, (name, piece, piece * capacity, len(body) // 4, zlib.crc32(body))):
                            column.append(value)
                        del open_[: 4 * capacity]
                        piece += 1
                        if not open_:
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Available lengths with counts, and for every sum the number of available pairs and triples, in any order, that give it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.capacity = len(counts) - 1
        self.available = self.counts > 0
        ones = self.available.astype(np.int64)
        self.pairs = np.convolve(ones, ones)[: self.capacity + 1]
        self.triples = np.convolve(self.pairs, ones)[: self.capacity + 1]

    def take(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.counts[length] -= times
        for length in set(lengths):
            if not self.counts[length]:
                self.available[length] = False
                others = np.flatnonzero(self.available[: self.capacity + 1 - length])
                self.pairs[others + length] -= 2
                if 2 * length <= self.capacity:
                    self.pairs[2 * length] -= 1
                # Triples that held the length once, twice and three times.
                self.triples[length:] -= 3 * self.pairs[: self.capacity + 1 - length]
                if 2 * length <= self.capacity:
                    self.triples[2 * length :] -= 3 * self.available[: self.capacity + 1 - 2 * length]
                if 3 * length <= self.capacity:
                    self.triples[3 * length] -= 1

    def uses(self, lengths: list[int]) -> int:
        """How often these lengths are all there."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def pair(self, total: int, beside: list[int]) -> list[int] | None:
        if total < 2 or not self.pairs[total]:
            return None
        high = np.arange(total - 1, (total - 1) // 2, -1)
        for x in high[self.available[high] & self.available[total - high]]:
            found = [int(x), int(total - x)]
            if self.uses(beside + found):
                return found
        return None

    def complement(self, gap: int, beside: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly."""
        if self.available[gap] and self.uses(beside + [gap]):
            return [gap]
        found = self.pair(gap, beside)
        if found or not self.triples[gap]:
            return found
        high = np.flatnonzero(self.available[: max(gap - 1, 0)])[::-1]
        for z in high[self.pairs[gap - high] > 0]:
            if self.uses(beside + [int(z)]):
                found = self.pair(int(gap - z), beside + [int(z)])
                if found:
                    return [int(z), *found]
        return None


def pack_lengths(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """counts[length], length up to the capacity -> patterns (lengths, uses); every length is used up."""
    index, patterns = SumIndex(counts), []
    capacity = index.capacity

    def use(lengths: list[int]) -> None:
        times = index.uses(lengths)
        index.take(lengths, times)
        patterns.append((lengths, times))

    rest: list[tuple[int, int]] = []
    while True:
        there = np.flatnonzero(index.available)
        if not len(there):
            break
        longest = int(there[-1])
        if longest == capacity:
            use([longest])
            continue
        found = index.complement(capacity - longest, [longest])
        if found:
            use([longest, *found])
            continue
        lengths, gap = [longest], capacity - longest
        while gap > 0:  # best fit: the longest length that still fits, or what completes the sequence
            exact = index.complement(gap, lengths)
            if exact:
                lengths += exact
                break
            fitting = np.flatnonzero(index.available[: gap + 1])[::-1]
            best = next((int(x) for x in fitting if index.uses(lengths + [int(x)])), None)
            if best is None:
                break
            lengths.append(best)
            gap -= best
        use(lengths)
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Per run of equal-length places: length, first rank, first sequence, offset; sorted by length and rank."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            next_rank[length] = rank + times
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = save(pieces(docs, tokenizer_path, capacity).withColumn("part", F.spark_partition_id()), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(pack_lengths(counts)))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.row_number().over(within) - 1 + F.col("before"))

    def place(batches):
        t = table.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(t["key"], (length << 48) + rank, "right") - 1
            columns = batch.columns[:5] + [pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
