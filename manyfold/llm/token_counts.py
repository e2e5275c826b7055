"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary is that of a public sentence piece file: its pieces with its scores. An Aho-Corasick automaton lists
all pieces in a text; dynamic programming over end positions carries the best score and the number of pieces of that
path, and nothing of the path itself. The rules are those of the tokenizer: spaces become a mark and one is put in
front; paths ending at one place are tried from the earliest start on, and a later one wins only if its score is
strictly higher; a character that is no piece by itself costs ten below the least score and counts a byte piece for
each of its bytes. Scores in the file are whole numbers, so sums are exact and ties are real.

No piece has the mark after another character, none has a line feed, and none goes on after a letter with anything but
letters (all looked up in the vocabulary), so a text falls apart there without any change of result; parts that come
again are looked up.

Null and empty texts have no tokens. Every row is counted, repeated ones too. An empty table gives no row, and other columns
play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from manyfold.llm.pieces import CACHE, SPACE_MARK, Lattice, groups, vocabulary

PENALTY = 10.0
LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
#: Parts of a text between which no piece reaches: before spaces, and between a letter and what is none.
FINE = re.compile(rf" *[^{LETTERS} \n]*[{LETTERS}]+| *[^{LETTERS} \n]+| +")
COARSE = re.compile(r" *[^ \n]+| +")
#: Longer parts are done one character after another instead of many parts side by side.
LONG = 256


def best_counts(path: str, parts: list[str]) -> np.ndarray:
    """Pieces on the best path of every part, in which spaces are spaces."""
    parts = [p.replace(" ", SPACE_MARK) for p in parts]
    _, scores = vocabulary(path)
    lattice = Lattice(path, parts)
    characters = "\n".join(parts) + "\n"
    unknown_score = scores.min() - PENALTY
    score = np.full(lattice.size, -np.inf)
    count = np.zeros(lattice.size, np.int64)
    score[lattice.base] = 0.0

    cost = np.array([len(characters[e - 1].encode()) for e in lattice.unknown], np.int64)
    start = np.concatenate([lattice.start, lattice.unknown - 1])
    end = np.concatenate([lattice.end, lattice.unknown])
    length = np.concatenate([lattice.length, np.zeros(len(cost), np.int64)])
    gain = np.concatenate([scores[lattice.piece], np.full(len(cost), unknown_score)])
    pieces = np.concatenate([np.ones(len(lattice.piece), np.int64), cost])
    depth = np.concatenate([lattice.depth, lattice.unknown_depth])

    if len(parts) == 1:
        at = np.lexsort((-length, depth))
        for s, e, g, n in zip(start[at].tolist(), end[at].tolist(), gain[at].tolist(), pieces[at].tolist()):
            if score[s] + g > score[e]:
                score[e], count[e] = score[s] + g, count[s] + n
        return count[lattice.last]
    # By depth, and within a depth the earliest start first. Matches of one depth and length have different ends.
    order = np.lexsort((-length, depth))
    start, end, gain, pieces = start[order], end[order], gain[order], pieces[order]
    key = depth[order] * 1024 + (1023 - length[order])
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        s, e = start[a:b], end[a:b]
        reached = score[s] + gain[a:b]
        better = reached > score[e]
        e, s = e[better], s[better]
        score[e] = reached[better]
        count[e] = count[s] + pieces[a:b][better]
    return count[lattice.last]


@lru_cache(maxsize=4)
def part_pattern(path: str) -> re.Pattern:
    """How a text may be cut without any change of result, by a look at all pieces of the vocabulary."""
    pieces, _ = vocabulary(path)
    if any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
        raise ValueError("a piece has a line feed, or a space mark after another character")
    inside = re.compile(f"[{LETTERS}][^{LETTERS}{SPACE_MARK}]")
    return COARSE if any(inside.search(p) for p in pieces) else FINE


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        pattern = part_pattern(vocabulary_path)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for first, last in groups(texts):
                some = [" " + t if t else "" for t in texts[first:last]]
                parts = list(map(pattern.findall, some))
                new = list(set().union(*parts).difference(known))
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(set().union(*parts))
                short = [p for p in new if len(p) <= LONG]
                for at in range(0, len(short), 20_000):
                    slice_ = short[at : at + 20_000]
                    known.update(zip(slice_, best_counts(vocabulary_path, slice_).tolist()))
                long = {p: int(best_counts(vocabulary_path, [p])[0]) for p in new if len(p) > LONG}
                known.update(long)
                counts.extend(sum(map(known.__getitem__, p)) + t.count("\n") for t, p in zip(some, parts))
                for p in long:  # few come again, and they are large
                    del known[p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(rows, "doc_id long, n_tokens long")
