"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it. So items are partitioned by size, and for
each size class the document is searched in overlapping segments only a few times as long as the items: an item lies
whole in one segment, and there its similarity is at least a quarter. Signatures are one-permutation MinHashes: a
shingle's hash names its bin, and each bin keeps its least hash. An item and a segment that agree in one bin are a
candidate pair; candidates are verified by exact containment of the item's five-word shingles in the document.

Document signatures are evaluated lazily: only bins whose least hash could be an item's (a bit set of fixed size holds
the items' hashes) can produce a candidate, so only those segments are looked at, and only candidates are shuffled.

Words are runs of letters, marks and digits, in lower case. Null and empty texts hold nothing. An item of fewer than
five words is one shingle, all of it, and is looked up among the runs of so many words. Items of equal text are searched
once, under the least item_id, and every item_id of a text that is found is named; items without an item_id take no part.
Rows are named by doc_id and text, so repeated or null ids do not mix texts. Without documents or items nothing is found.
Other columns play no part in the search and pass through the decontaminated table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from manyfold.llm.common import bit_set, hot_keys, in_bit_set, lookup, null_safe, spread_join, with_digest
from manyfold.llm.textgrams import Words, as_bytes, pieces
from manyfold.sources.settled import settle

SHINGLE = 5
BINS = np.uint64(256)
BITS = 25
OVERLAP = 1 << 16

ITEM_SCHEMA = "item_id long, size_class int, keys array<long>, shingles array<string>"
HIT_SCHEMA = "doc_id long, text_digest long, candidates array<struct<size_class:int,key:long>>, shingles array<string>"


def normal(texts: pa.Array) -> list[bytes]:
    return as_bytes(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), r"[^\pL\pM\pN]+", " "))


def shingles_of(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every run of ``size`` words within a text, and the hash of the run."""
    n = len(words.start)
    first = np.arange(max(0, n - size + 1))
    first = first[words.text[first] == words.text[first + size - 1]]
    return first, words.run_hashes(first, first + size - 1)


def shingle_text(words: Words, first: int, size: int = SHINGLE) -> str:
    return words.joined[words.start[first] : words.end[first + size - 1]].decode()


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), normal(batch.column(1))):
            words = Words([text])
            first, hashes = shingles_of(words)
            if len(first):
                hashes, where = np.unique(hashes, return_index=True)
                # Sorted, so the first of each bin is its least.
                keys = hashes[np.unique(hashes % BINS, return_index=True)[1]]
                texts = [shingle_text(words, k) for k in first[where]]
                out.append((item, int(len(hashes)).bit_length() - 1, keys.view(np.int64).tolist(), texts))
            elif size := len(words.start):
                # The class of a short item is its number of words, below zero.
                out.append((item, -size, shingles_of(words, size)[1].view(np.int64).tolist(), [shingle_text(words, 0, size)]))
        columns = list(zip(*out)) or [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = ["item_id", "size_class", "keys", "shingles"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def segment_candidates(hashes: np.ndarray, marked: np.ndarray, size_class: int) -> list[tuple[int, int]]:
    """Keys that are the least of their bin in some segment of one text.

    Items of the class have fewer than 2 * 2**size_class shingles. Segments are twice that, and start every half, so
    each run of so many shingles lies whole in one of them.
    """
    step = 2 << size_class
    found = set()
    for block in np.unique(np.concatenate([marked // step, np.maximum(marked // step - 1, 0)])):
        part = np.unique(hashes[block * step : (block + 2) * step])
        least = part[np.unique(part % BINS, return_index=True)[1]]
        here = hashes[marked[(marked >= block * step) & (marked < (block + 2) * step)]]
        found.update(np.intersect1d(least, here).view(np.int64).tolist())
    return [(size_class, key) for key in found]


def document_rows(key_bits, shingle_bits, classes: list[int]):
    """One row for each text with a candidate: its candidate keys and its shingles that an item may have."""
    short = [-c for c in classes if c < 0]
    classes = [c for c in classes if c >= 0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, some = key_bits.value, shingle_bits.value
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            found: dict[int, tuple[set, set]] = {}
            for numbers, group, _ in pieces(normal(batch.column(2)), OVERLAP):
                words = Words(group)
                first, hashes = shingles_of(words)
                known, keyed = in_bit_set(some, hashes), in_bit_set(keys, hashes)
                owner = words.text[first]
                bounds = np.searchsorted(owner, np.arange(len(group) + 1))
                for k in np.unique(owner[keyed]):
                    own = slice(bounds[k], bounds[k + 1])
                    marked = np.flatnonzero(keyed[own])
                    pairs, texts = found.setdefault(int(numbers[k]), (set(), set()))
                    for size_class in classes:
                        pairs.update(segment_candidates(hashes[own], marked, size_class))
                    texts.update(shingle_text(words, x) for x in first[own][known[own]])
                for size in short:
                    first, hashes = shingles_of(words, size)
                    for at in np.flatnonzero(in_bit_set(keys, hashes)).tolist():
                        pairs, texts = found.setdefault(int(numbers[words.text[first[at]]]), (set(), set()))
                        pairs.add((-size, int(hashes[at].view(np.int64))))
                        texts.add(shingle_text(words, first[at], size))
            hit = [k for k in found if found[k][0]]
            pairs = [[{"size_class": c, "key": x} for c, x in found[k][0]] for k in hit]
            pair_type = pa.list_(pa.struct([("size_class", pa.int32()), ("key", pa.int64())]))
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), digests.take(at), pa.array(pairs, pair_type), pa.array([list(found[k][1]) for k in hit], pa.list_(pa.string()))],
                ["doc_id", "text_digest", "candidates", "shingles"],
            )

    return rows


def item_ids(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the items that take part."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_digest, item_id and containment of every pair at or above the threshold, all items of equal text named.

    Containment is the share of the item's distinct five-word shingles that the document holds.
    """
    named = item_ids(benchmark).distinct()
    first = settle(named.groupBy("text").agg(F.min("item_id").alias("first_item"), F.count(F.lit(1)).alias("n_")), "first-items")
    others = lookup(named, first, ["text"], ["first_item"], "n_", "item_id").filter(F.col("first_item") != F.col("item_id"))
    others = settle(others.select(F.col("first_item").alias("item_id"), F.col("item_id").alias("other_item")), "equal-items")
    found = settle(leaks_of_texts(docs, benchmark, threshold), "leaks")
    hot = hot_keys(found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_")), ["item_id"], "n_")
    more = spread_join(found, others, ["item_id"], "text_digest", hot)
    return found.unionByName(more.select("doc_id", "text_digest", F.col("other_item").alias("item_id"), "containment"))


def leaks_of_texts(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``find_leaks`` with the least item_id of each item's text alone."""
    spark = docs.sparkSession
    items = item_ids(benchmark).groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    items = settle(items.mapInArrow(item_rows, ITEM_SCHEMA), "items")
    keys = settle(items.select("item_id", "size_class", F.explode("keys").alias("key")), "keys")
    shingle_hashes = items.select(F.explode("shingles").alias("shingle")).mapInArrow(text_hashes, "hash long")
    key_bits = spark.sparkContext.broadcast(bit_set(keys, "key", BITS))
    shingle_bits = spark.sparkContext.broadcast(bit_set(shingle_hashes, "hash", BITS))
    # A class is the number of bits of a count: never more than a few dozen.
    classes = sorted(r[0] for r in keys.select("size_class").distinct().collect())

    keyed, digest = with_digest(docs, "text")
    texts = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(digest).alias("text_digest"), "text")
    hits = settle(texts.mapInArrow(document_rows(key_bits, shingle_bits, classes), HIT_SCHEMA), "hits")
    name = ["doc_id", "text_digest"]
    wanted = settle(hits.select(*name, F.explode("candidates").alias("c")).select(*name, "c.size_class", "c.key"), "wanted")
    by = ["size_class", "key"]
    hot = hot_keys(wanted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_")), by, "n_")
    pairs = spread_join(wanted, keys, by, "text_digest", hot).select(*name, "item_id").distinct()
    pairs = settle(pairs, "pairs")
    sized = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_")).join(items, "item_id")
    sized = sized.select("item_id", "n_", F.col("shingles").alias("item_shingles"))
    both = lookup(pairs, sized, ["item_id"], ["item_shingles"], "n_", "text_digest")
    own = hits.select(F.col("doc_id").alias("d"), F.col("text_digest").alias("t"), "shingles").dropDuplicates(["d", "t"])
    both = both.join(own, null_safe(both, own, [("doc_id", "d"), ("text_digest", "t")]))
    share = F.size(F.array_intersect("item_shingles", "shingles")) / F.size("item_shingles")
    return both.select(*name, "item_id", share.alias("containment")).filter(F.col("containment") >= threshold)


def text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash that each shingle has inside a document."""
    for batch in batches:
        words = Words(as_bytes(batch.column(0)))
        _, hashes = shingles_of(words)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item. Repeated rows stay repeated."""
    columns = docs.columns
    keyed, digest = with_digest(docs, "text")
    leaks = leaks_of_texts(docs, benchmark, threshold).select(F.col("doc_id").alias("leak_doc"), F.col("text_digest").alias("leak_digest"))
    leaks = leaks.distinct()
    agree = null_safe(keyed, leaks, [("doc_id", "leak_doc"), (digest, "leak_digest")])
    return keyed.join(leaks, agree, "left_anti").select(*columns)
