"""Words of texts and hashes of word windows, vectorised over a block of texts.

A word is a run of characters other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``), taken unchanged. Hashes are 64 bits wide, depend on the
words alone and are the same in every process, so they may be shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
# Texts are hashed in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK))


_BYTE = stream(1, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Block:
    """Consecutive texts: their bytes, word spans, word hashes and words per text."""

    def __init__(self, texts: list[str | None], first: int):
        self.first = first
        parts = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        self.data = b"\n".join(parts) + b"\n"
        self.bytes = np.frombuffer(self.data, np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        # The block starts after white space and ends with it, so edges alternate.
        self.starts, self.ends = edge[0::2], edge[1::2]
        limits = np.cumsum([len(part) + 1 for part in parts])
        self.word_ends = np.searchsorted(self.starts, limits)
        self.word_starts = np.concatenate([[0], self.word_ends[:-1]])
        self.text_starts = limits - [len(part) + 1 for part in parts]
        self.size = len(texts)

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        inside = np.arange(total) - np.repeat(before, lengths)
        at = inside + np.repeat(self.starts, lengths)
        weights = stream(2, int(lengths.max())) | np.uint64(1)
        terms = _BYTE[self.bytes[at]] * weights[inside]
        return mix(np.add.reduceat(terms, before) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.size), self.word_ends - self.word_starts)


def blocks(texts: list[str | None]) -> Iterator[Block]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= BLOCK_BYTES:
            yield Block(texts[start : i + 1], start)
            start, size = i + 1, 0
    if start < len(texts):
        yield Block(texts[start:], start)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each place on; borders of texts are not looked at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(stream(40 + seed, 1)[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)))])
    return mix((sums[width:] - sums[:n]) * powers(inverse, n))
