"""Words of many texts at once, as positions in one array of bytes, and hashes of runs of words.

A hash is a polynomial of the bytes modulo 2**64, read off prefix sums, so any run of words costs one subtraction.
Work is done in pieces of about a quarter of a megabyte: memory does not grow with a batch or a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of a hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: first and last byte, the text they belong to, and hashes of runs."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts)
        self.bytes = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        blank = np.concatenate([[True], SPACE[self.bytes], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self._sums: np.ndarray | None = None

    def run_hashes(self, first: np.ndarray, last: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the bytes from the start of word ``first`` to the end of word ``last``."""
        if self._sums is None:
            b = self.bytes.astype(np.uint64)
            if lower:
                b += np.where((self.bytes >= 65) & (self.bytes <= 90), np.uint64(32), np.uint64(0))
            self._inverse = powers(INVERSE, len(b))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * powers(BASE, len(b))[:-1])])
        s, e = self.start[first], self.end[last]
        return mixed((self._sums[e] - self._sums[s]) * self._inverse[s])


def pieces(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Texts in groups of about PIECE bytes: the number of each, the text, and where in the whole it starts.

    A longer text is cut at white space; each cut repeats the last ``overlap`` bytes, up to a space, of the one before.
    """
    numbers, group, starts, size = [], [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > PIECE + overlap:
                cut = at + PIECE + overlap
                while cut < end and not SPACE[text[cut]]:
                    cut += 1
                end = cut
            numbers.append(k)
            group.append(text[at:end])
            starts.append(at)
            size += end - at + 1
            if size >= PIECE:
                yield np.array(numbers), group, np.array(starts)
                numbers, group, starts, size = [], [], [], 0
            if end == len(text):
                break
            back = end - overlap
            while overlap and back > at + 1 and not SPACE[text[back - 1]]:
                back -= 1
            at = back if back > at + 1 else end
    if group:
        yield np.array(numbers), group, np.array(starts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, empty for a null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
