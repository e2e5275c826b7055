"""Matches of a piece vocabulary in words, found by an Aho-Corasick automaton, laid out for work on many words at once."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece

SPACE_MARK = "▁"
SEPARATOR = "\n"
#: Cached words per Python worker; the cache is emptied when it is full.
CACHE = 500_000
#: Texts are worked on in groups of about so many characters, so memory does not grow with a batch.
GROUP_CHARS = 1 << 20


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces that can match text, without special and byte pieces, and their scores in the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids], np.float64)


@lru_cache(maxsize=4)
def automaton(path: str) -> tuple[ahocorasick.Automaton, np.ndarray]:
    pieces, _ = vocabulary(path)
    found = ahocorasick.Automaton()
    for number, piece in enumerate(pieces):
        found.add_word(piece, number)
    found.make_automaton()
    return found, np.array([len(p) for p in pieces], np.int64)


class Lattice:
    """All matches in some words. Position ``k`` of word ``w`` is ``base[w] + k``; a match leads from start to end."""

    def __init__(self, path: str, words: list[str]):
        finder, lengths = automaton(path)
        joined = SEPARATOR.join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.last = self.base + sizes
        self.size = int(self.last[-1]) + 1 if words else 0
        flat = np.fromiter(chain.from_iterable(finder.iter(joined)), np.int64).reshape(-1, 2)
        # A match that ends with character e of the joined text ends at position e + 1.
        self.end, self.piece = flat[:, 0] + 1, flat[:, 1]
        self.length = lengths[self.piece]
        self.start = self.end - self.length
        word = np.searchsorted(self.base, self.end, "right") - 1
        self.depth = self.end - self.base[word]
        alone = np.zeros(self.size + 1, bool)
        alone[self.end[self.length == 1]] = True
        inner = np.ones(self.size + 1, bool)
        inner[self.base] = False
        inner[self.size :] = False
        #: Ends of characters that are no piece by themselves.
        self.unknown = np.flatnonzero(inner & ~alone)
        self.unknown_depth = self.unknown - self.base[np.searchsorted(self.base, self.unknown, "right") - 1]


def groups(texts: list, size: int = GROUP_CHARS):
    """Ranges of texts of about ``size`` characters in all."""
    first, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
