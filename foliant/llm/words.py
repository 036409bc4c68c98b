"""Words of many texts at once, as offsets and 64-bit hashes, from the UTF-8 bytes by numpy.

Batches are cut into chunks of about CHUNK bytes, so that memory follows the chunk (or the longest single text: about
30 bytes for each of its bytes; a text of 50 MB takes 1.5 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_STEP, _SPREAD, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _byte_values() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(1 << 40, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def fold_ascii() -> np.ndarray:
    table = np.arange(256)
    table[65:91] += 32
    return table.astype(np.uint8)


FOLD = fold_ascii()
VALUES = _byte_values()[FOLD]
#: words `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Some whole texts: rows ``first..last`` of a batch, their bytes, words (starts, ends) and word offsets by row."""

    def __init__(self, texts: list[bytes], first: int, kind: np.ndarray, latin: bool = False):
        self.first, self.texts = first, texts
        joined = b"\n" + b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if latin:
            # upper-case letters U+00C0 to U+00DE are C3 80 to C3 9E; the lower-case ones stand 32 further on
            b = self.bytes.copy()
            at = np.flatnonzero(b == 0xC3) + 1
            at = at[(b[at] >= 0x80) & (b[at] <= 0x9E) & (b[at] != 0x97)]
            b[at] += 32
            self.bytes = b
        self.row_start = np.concatenate(([1], 1 + np.cumsum(lens + 1)))
        m = kind[self.bytes]
        edges = np.flatnonzero(m[1:] != m[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.offset = np.searchsorted(self.start, self.row_start)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.offset))

    def hashes(self) -> np.ndarray:
        return self.parts(())[0][1]

    def parts(self, prefixes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words, hashes) of the whole words, then for each length of the longer words' prefixes of so many bytes.

        A word's hash is a sum over its bytes of values that are scattered by byte and place together. It is no
        polynomial: those have, modulo 2**64, pairs of words that collide for every base.
        """
        n = len(self.bytes)
        at = np.zeros(n, np.int64)
        at[self.start] = self.start
        v = (np.arange(n) - np.maximum.accumulate(at)).view(np.uint64)
        v *= _STEP
        v += VALUES[self.bytes]
        v *= _SPREAD
        v ^= v >> np.uint64(32)
        v *= _LAST
        v ^= v >> np.uint64(29)
        c = np.cumsum(v, out=v)
        before = c[self.start - 1]
        out = [(np.arange(len(self.start)), mix(c[self.end - 1] - before))]
        for k in prefixes:
            of = np.flatnonzero(self.end - self.start > k)
            out.append((of, mix(c[self.start[of] + (k - 1)] - before[of] + np.uint64(k))))
        return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def column_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], kind: np.ndarray, latin: bool = False, most: int = CHUNK) -> Iterator[Chunk]:
    """latin: accented Latin letters are lower-cased too. most: bytes of a chunk of several texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield Chunk(texts[first:i], first, kind, latin)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield Chunk(texts[first:], first, kind, latin)


def word_hash(word: bytes) -> int:
    """The hash that Chunk.hashes gives a single word."""
    return int(Chunk([word], 0, np.ones(256, bool) & (np.arange(256) != 10)).hashes()[0])


class Remembered:
    """A table of bounded size in two generations: when the young one is full it becomes the old one; hits keep living."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
