"""Substring dedup by digests of lines and paragraphs, and of all runs of words between them, with original offsets.

Units are lines (between line feeds) and paragraphs (lines between blank ones) of at least ``min_line_words`` words; shorter
ones, such as headings and greetings, come again by chance. Words are normalised to lower case (A-Z), and white space does
not count, so a paragraph is the same however it is broken into lines. Units are grouped by digest globally: the least
doc_id that has a unit keeps it, at its first place, and all other occurrences go.

A repeated passage need not begin or end with a line. So shared text is followed word by word, inside lines and across their
ends: any ``min_words`` consecutive words are a unit as well, kept by the least doc_id that has them, and in the same text
repeated by those from ``min_words`` words after the first. Every word that a repeated unit covers goes, hence a passage
that another document has goes from its first to its last word wherever it stands. Each removed word has a copy left: the same
word of the keeper, or of the keeper of a unit that covers it there.

Runs are one per word. So that only those of repeated passages are compared, a run is named by the least hash of
the half as long runs in it, which is the same wherever it stands, and texts share the names first, about one in
``min_words`` / 4 words; the name of a line or paragraph is its digest. A unit that two texts have has a name that two texts
have, so none is lost.

Hashes have 64 bits. Null and empty texts have no units. Rows with the same doc_id count as one document, and take nothing
from each other. A null doc_id ranks last. An empty table gives an empty one. Extra columns pass through, under ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from manyfold.llm.common import bit_set, hot_keys, in_bit_set, lookup, null_safe, with_digest
from manyfold.llm.textgrams import INVERSE, Words, as_bytes, mixed, pieces, powers
from manyfold.sources.settled import settle

MIN_WORDS = 30
MIN_LINE_WORDS = 10
BITS = 25
LAST = (1 << 63) - 1
# Not the base of the hashes of words, so that runs of one word do not hash like them.
FACTOR = 0xD6E8FEB86659FD93
FACTOR_INVERSE = pow(FACTOR, -1, 1 << 64)

NAMES = "doc_id long, names array<long>"
UNITS = (
    "doc_id long, text_digest long, lines array<struct<line:long,place:int,words:int,again:boolean,hot:boolean>>, "
    "runs array<struct<run:long,place:int,words:int,again:boolean,hot:boolean>>"
)
SPANS = "doc_id long, text_digest long, bounds array<int>, words int"


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every text, in order, its words: hashes, first and last character, and line."""
    parts, current = [], 0
    for numbers, group, starts in pieces(texts, 0):
        words = Words(group)
        each = np.arange(len(words.start))
        hashes = words.run_hashes(each, each, lower=True) if len(each) else np.empty(0, np.uint64)
        # Characters before a byte, within the piece; and those of a text before its part in the piece.
        before = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
        ahead = np.array([len(texts[k][:at].decode()) if at else 0 for k, at in zip(numbers.tolist(), starts.tolist())])
        shift = (ahead - before[words.offsets[:-1]])[words.text]
        begin, end = before[words.start] + shift, before[words.end] + shift
        feeds = np.concatenate([[0], np.cumsum(words.bytes == 10)])
        above = np.array([texts[k].count(b"\n", 0, at) for k, at in zip(numbers.tolist(), starts.tolist())])
        line = feeds[words.start] + (above - feeds[words.offsets[:-1]])[words.text]
        bounds = np.searchsorted(words.text, np.arange(len(group) + 1))
        for k, a, b in zip(numbers.tolist(), bounds[:-1], bounds[1:]):
            if k != current:
                yield tuple(np.concatenate(x) for x in zip(*parts))
                parts, current = [], k
            parts.append((hashes[a:b], begin[a:b], end[a:b], line[a:b]))
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of which a difference is the hash of a run of words, times the power for its place; and the inverse powers."""
    n = len(hashes)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(FACTOR, n)[:-1])]), powers(FACTOR_INVERSE, n)


def runs_of(sums: np.ndarray, inverse: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words, and their names: the least hash of the half as long runs in each."""
    n = len(sums) - 1
    if n < min_words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    half = (min_words + 1) // 2
    long, least = (mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1]) for k in (min_words, half))
    wide, size = min_words - half + 1, 1
    while size < wide:
        step = min(size, wide - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return long, least


def lines_of(sums: np.ndarray, inverse: np.ndarray, line: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, first words and lengths of the lines and paragraphs of at least so many words, in order of their first words.

    ``line`` is the line of every word; where two words stand more than a line apart, a blank one lies between.
    """
    n = len(line)
    lines, heads = (np.flatnonzero(np.diff(line, prepend=-2) >= gap) for gap in (1, 2))
    ends, last = np.append(lines[1:], n), np.append(heads[1:], n)
    several = ends[np.searchsorted(lines, heads)] < last
    first, after = np.concatenate([lines, heads[several]]), np.concatenate([ends, last[several]])
    order = np.argsort(first, kind="stable")
    first, after = first[order], after[order]
    enough = after - first >= least
    first, after = first[enough], after[enough]
    # The length is part of a digest, which so is none of a run's hashes.
    digests = mixed(mixed((sums[after] - sums[first]) * inverse[first]) ^ (after - first).astype(np.uint64))
    return digests, first, after - first


def units_of(hashes: np.ndarray, line: np.ndarray, min_words: int, min_line_words: int) -> list[tuple[np.ndarray, ...]]:
    """Hash, name, first word, length and whether the same stands before, without overlap: of all lines and of all runs of a text."""
    if not len(hashes):
        return []
    sums, inverse = prefix_sums(hashes)
    digests, first, words = lines_of(sums, inverse, line, min_line_words)
    runs, names = runs_of(sums, inverse, min_words)
    out = []
    for unit, name, place, size in ((digests, digests, first, words), (runs, names, np.arange(len(runs)), np.full(len(runs), min_words))):
        _, once, same = np.unique(unit, return_index=True, return_inverse=True)
        out.append((unit, name, place, size, place - place[once][same] >= size))
    return out


def name_rows(min_words: int, min_line_words: int):
    """The different names of the units of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (units_of(h, line, min_words, min_line_words) for h, _, _, line in words_of(as_bytes(batch.column(1))))
            lists = [np.unique(np.concatenate([u[1] for u in units])).view(np.int64) if units else [] for units in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "names"])

    return rows


def structs(found: list[tuple[np.ndarray, ...]], unit: str) -> pa.ListArray:
    """Lists of structs of a name for the unit, place, words, again and hot, one list for each tuple of arrays."""
    kind = [(unit, pa.int64()), ("place", pa.int32()), ("words", pa.int32()), ("again", pa.bool_()), ("hot", pa.bool_())]
    columns = [pa.concat_arrays([pa.array(x).cast(t) for x in xs] or [pa.array([], t)]) for xs, (_, t) in zip(list(zip(*found)) or [()] * 5, kind)]
    ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(pa.struct(kind))))


def unit_rows(shared, hot: np.ndarray, min_words: int, min_line_words: int):
    """Of every text the units that others may have too, and those that it has had before; ``hot`` are names in many texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, found = [], ([], [])
            for k, (hashes, _, _, line) in enumerate(words_of(as_bytes(batch.column(2)))):
                some = []
                for unit, names, place, words, again in units_of(hashes, line, min_words, min_line_words):
                    at = np.flatnonzero(again | in_bit_set(shared.value, names) & in_bit_set(shared.value, names >> np.uint64(32)))
                    some.append((unit.view(np.int64)[at], place[at], words[at], again[at], np.isin(names[at].view(np.int64), hot)))
                if sum(len(x[0]) for x in some):
                    hit.append(k)
                    for lists, x in zip(found, some):
                        lists.append(x)
            take = pa.array(hit, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), structs(found[0], "line"), structs(found[1], "run")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_digest", "lines", "runs"])

    return rows


def span_rows(min_words: int):
    """The words that repeated units cover: first and next after last of each span, one after another, and their number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, words = [], []
            for runs, lines in zip(batch.column(2), batch.column(3)):
                place, after = runs.values.to_numpy(), lines.values.field("words").to_numpy()
                first = lines.values.field("place").to_numpy()
                place, after = np.concatenate([place, first]), np.concatenate([place + min_words, first + after])
                order = np.argsort(place)
                place, after = place[order], np.maximum.accumulate(after[order])
                # A span goes on while the next unit begins no later than after its last word.
                breaks = np.flatnonzero(place[1:] > after[:-1]) + 1
                first, last = place[np.append(0, breaks)], after[np.append(breaks, len(place)) - 1]
                bounds.append(np.stack([first, last], 1).ravel())
                words.append(int((last - first).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bounds, pa.list_(pa.int32())), pa.array(words, pa.int32())],
                ["doc_id", "text_digest", "bounds", "words"],
            )

    return rows


def repeated(each: DataFrame, unit: str, some_hot: bool) -> DataFrame:
    """The rows whose unit an earlier document has, or the same text before. Rows of hot units are counted before they meet."""
    columns = ["doc_id", "text_digest", "place", "words", "again", "keeper"]
    known = each.filter(~F.col("hot")).select(*columns[:-1], F.min("doc_id").over(W.partitionBy(unit)).alias("keeper"))
    many = each.filter("hot")
    if some_hot and not many.isEmpty():
        keepers = settle(many.groupBy(unit).agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_")), "keepers")
        known = known.union(lookup(many, keepers, [unit], ["keeper"], "n_", "text_digest").select(columns))
    return known.filter(F.col("again") | (F.col("keeper") != F.col("doc_id")))


@F.pandas_udf(ArrayType(IntegerType()))
def characters(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """First and next after last characters of spans of words, from a text and the bounds of the spans."""
    for texts, bounds in batches:
        out = [None] * len(texts)
        hit = [k for k, x in enumerate(bounds) if x is not None]
        for k, (_, begin, end, _) in zip(hit, words_of([texts[k].encode() for k in hit])):
            first, last = np.asarray(bounds[k]).reshape(-1, 2).T
            out[k] = np.stack([begin[first], end[last - 1]], 1).ravel()
        yield pd.Series(out, dtype=object)


def find_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """doc_id, text_digest, the bounds of the spans of words to remove, and their number, of the texts with any."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    keyed, digest = with_digest(docs, text)
    thin = keyed.select(rank, F.col(digest).alias("text_digest"), F.col(text).alias("text"))
    each = thin.select("doc_id", "text").mapInArrow(name_rows(min_words, min_line_words), NAMES).select(F.explode("names").alias("name"))
    names = settle(each.groupBy("name").agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > 1), "names")
    hot = np.array([r["name"] for r in hot_keys(names, ["name"], "n_").collect()], np.int64)
    probes = names.select(F.explode(F.array("name", F.shiftright("name", 32))).alias("probe"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(probes, "probe", BITS))
    maybe = settle(thin.mapInArrow(unit_rows(shared, hot, min_words, min_line_words), UNITS), "units")
    key = ["doc_id", "text_digest"]
    lines, runs = (maybe.select(*key, F.explode(c).alias("u")).select(*key, "u.*") for c in ("lines", "runs"))
    lines = repeated(lines, "line", len(hot) > 0).select(*key, F.struct("place", "words").alias("line"), F.lit(None).cast("int").alias("run"))
    runs = repeated(runs, "run", len(hot) > 0).select(*key, F.lit(None).alias("line"), F.col("place").alias("run"))
    both = lines.union(runs).groupBy(*key).agg(F.collect_list("run").alias("runs"), F.collect_list("line").alias("lines"))
    return both.mapInArrow(span_rows(min_words), SPANS)


def drop_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Every document under one column ``row``, its text without repeats, the removed spans, and words removed."""
    keyed, digest = with_digest(docs, text)
    spans = find_repeats(docs, text, min_words, min_line_words).select(F.col("doc_id").alias("id_"), F.col("text_digest").alias("digest_"), "bounds", "words")
    packed = keyed.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.col(digest).alias("digest"))
    both = packed.join(spans, null_safe(packed, spans, [("key", "id_"), ("digest", "digest_")]), "left")
    own = F.when(F.col("bounds").isNotNull(), F.col("text"))
    both = both.select("row", "text", "words", characters(own, "bounds").alias("at"))
    pairs = lambda ends: F.transform(
        F.sequence(F.lit(0), F.size(ends) - 2, F.lit(2)), lambda k: F.struct(F.get(ends, k).alias("from"), F.get(ends, k + 1).alias("to"))
    )
    kept = pairs(F.concat(F.array(F.lit(0)), "at", F.array(F.lit((1 << 31) - 1))))
    left = F.transform(kept, lambda s: F.substring(F.col("text"), s["from"] + 1, s["to"] - s["from"]))
    none = F.array().cast("array<struct<from:int,to:int>>")
    return both.select(
        "row",
        F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(left, "")).alias("text"),
        F.when(F.col("at").isNull(), none).otherwise(pairs(F.col("at"))).alias("removed"),
        F.coalesce("words", F.lit(0)).alias("words_removed"),
    )
