"""Best-fit packing of tokenised documents into sequences of fixed capacity, by the sum-of-squares rule.

A document becomes its token ids and an end id; only one that is longer than a sequence is cut, into pieces of the whole
capacity and a last one. Pieces are dealt evenly into buckets of a bounded number, and a task packs one bucket: every
piece, longest first, goes to the gap (or to a new sequence) after which the squared counts of open sequences per residual
gap sum up to the least; ties go to the smallest gap that is open, then to a new sequence. The few sequences of all buckets
that are still open are dissolved and their pieces packed again in fewer buckets, until one bucket holds them all or
they hardly get fewer. Nothing is dropped: what the last round leaves open stays as it is.

Null text is empty, so its document is the end id alone. Null or repeated ids and repeated rows are documents of their own.
An empty table gives no row. A text of any length is tokenised in parts cut at spaces, so memory does not grow with it,
unless it has no space. Strings of special tokens get the ids that the tokenizer gives them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from tokenizers import Tokenizer

from manyfold.llm.common import fresh
from manyfold.sources.settled import settle

CAPACITY = 4096
END = 1
#: Pieces that a task packs.
BUCKET = 1 << 16
#: Known words per Python worker; the cache is emptied when it is full.
CACHE = 1_000_000
#: Letters below this code point are lower-cased one by one and have no other composed form, but for the dotted capital I.
LETTERS, DOTTED = 0x180, "\u0130"
#: Characters tokenised at a time, and pieces in an output batch.
PART_CHARS, BATCH = 1 << 20, 1 << 10
STOPS = ".,;:!?"


class Words:
    """Ids of words between spaces or line ends, as bytes. White space parts tokens, so the ids of a text are those of its words in order."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        # How the tokenizer writes the bytes of letters; a word of plain letters is one piece of text to its model.
        self.letters = {ord(c): self.written(c) for c in map(chr, range(LETTERS)) if c.isalpha() and c.lower() == c}

    def written(self, letter: str) -> str:
        return "".join(text for text, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter))

    def encode(self, words: list[str], plain: bool) -> list[bytes]:
        """Ids of every word; plain ones are lower-case words of plain letters."""
        if not plain:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        tokenize, letters, ids, ends = self.tokenizer.model.tokenize, self.letters, array("I"), [0]
        for word in words:
            ids.extend([t.id for t in tokenize(word if word.isascii() else word.translate(letters))])
            ends.append(len(ids))
        whole, size = ids.tobytes(), ids.itemsize
        return [whole[size * a : size * b] for a, b in zip(ends, ends[1:])]

    def learn(self, words: list[str]) -> None:
        """A word of plain letters with stops after it has the ids of its lower-case letters, then those of the stops."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            self.bare.clear()
            new = set(words)
        bare, parts, plain, rest = self.bare, [], set(), {""}
        for word in new:
            stem = word.rstrip(STOPS)
            if stem.isalpha() and (stem.isascii() or max(stem) < chr(LETTERS) and DOTTED not in stem):
                low, stops = stem.lower(), word[len(stem) :]
                plain.add(low)
            else:
                low, stops = word, ""
                rest.add(word)
            if stops:
                rest.add(stops)
            parts.append((word, low, stops))
        for some, kind in ((plain, True), (rest, False)):
            lacking = list(some.difference(bare))
            if lacking:
                bare.update(zip(lacking, self.encode(lacking, kind)))
        self.known.update([(word, bare[low] + bare[stops] if stops else bare[low]) for word, low, stops in parts])

    def ids(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        try:
            found = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            found = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(found, "<u4")


@lru_cache(maxsize=2)
def tokens(path: str) -> Words:
    return Words(path)


def text_parts(text: str) -> Iterator[str]:
    """Parts of about PART_CHARS, cut at spaces."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def pieces_of(text: str | None, words: Words, capacity: int, end: int) -> Iterator[np.ndarray]:
    left = np.empty(0, "<u4")
    for part in text_parts(text or ""):
        left = np.concatenate([left, words.ids(part)])
        while len(left) > capacity:
            yield left[:capacity]
            left = left[capacity:]
    left = np.append(left, np.uint32(end)).astype("<u4")
    for at in range(0, len(left), capacity):
        yield left[at : at + capacity]


def token_pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers) of every piece of every row."""
    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens(path)
        for batch in batches:
            out: list[tuple] = []
            for key, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = 0
                for number, ids in enumerate(pieces_of(text_.as_py(), words, capacity, end)):
                    out.append((key, number, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    if len(out) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return thin.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and the offset of every piece, and the gap that every sequence is left with."""
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)
    gaps: list[int] = []
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    never = np.iinfo(np.int64).max
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        # Taking a gap g away lowers the sum by 2 n(g) - 1, and leaving g - size raises it by 2 n(g - size) + 1.
        change = 1 - 2 * counts[size:capacity]
        change[1:] += 2 * counts[1 : capacity - size] + 1
        change[counts[size:capacity] == 0] = never
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * counts[capacity - size] + 1:
            gap = size + best
            number = holders[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, len(gaps)
            gaps.append(capacity)
        bins[at], offsets[at] = number, capacity - gap
        gaps[number] = rest = gap - size
        if rest:
            holders[rest].append(number)
            counts[rest] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, size: str = "length", capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """The rows with sequence_id and offset, their place in a sequence that holds sizes of ``capacity`` at most.

    Sizes are from 1 to the capacity. Columns travel with the rows, so thick ones are better joined afterwards.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("the pieces already have a column sequence_id or offset")
    open_ = fresh(pieces, "open")
    extra = [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField(open_, BooleanType())]
    schema = StructType([*pieces.schema.fields, *extra])
    place = pieces.columns.index(size)

    def packer(round_: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [b for b in batches if b.num_rows]
            if not whole:
                return
            sizes = np.concatenate([b.column(place).to_numpy() for b in whole]).astype(np.int64)
            if sizes.min() < 1 or sizes.max() > capacity:
                raise ValueError(f"a size is not within 1 to {capacity}")
            bins, offsets, gaps = sum_of_squares(sizes, capacity)
            first = (round_ << 56) | (TaskContext.get().partitionId() << 28)
            at = 0
            for b in whole:
                own = slice(at, at + b.num_rows)
                at += b.num_rows
                added = [pa.array(bins[own] + first), pa.array(offsets[own]), pa.array(gaps[bins[own]] > 0)]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], schema.names)

        return rows

    left, done, before, round_ = settle(pieces, "pieces"), [], None, 0
    while True:
        rows = left.count()
        buckets = max(1, -(-rows // bucket))
        last = buckets == 1 or (before is not None and rows > 0.5 * before)
        packed = settle(left.repartition(buckets).mapInArrow(packer(round_), schema), "packed")
        if last:
            done.append(packed)
            break
        done.append(packed.filter(~F.col(open_)))
        left, before, round_ = packed.filter(open_).select(*pieces.columns), rows, round_ + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.drop(open_)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, n_pieces and ids: whole sequences of packed pieces that still have their ids."""
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_pieces"),
    )
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return parts.select("sequence_id", "n_tokens", "n_pieces", ids.alias("ids"))
