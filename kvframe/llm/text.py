"""Whole texts as numpy arrays: byte blocks, word bounds and polynomial hashes of any span.

A block is a run of rows of one Arrow stream with some megabytes of text, so what a task holds does not depend
on the number of rows in a batch; a text longer than that is a block of its own. Null texts read as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
#: Odd multipliers; the second is for an independent hash.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


class Block:
    """buf: the texts, each followed by one newline; row r is buf[start[r] : start[r] + size[r]]."""

    def __init__(self, texts: list[bytes], columns: dict[str, list]):
        self.texts, self.columns = texts, columns
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size + 1)])
        self.joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.joined, np.uint8)

    def __len__(self) -> int:
        return len(self.texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row the index of its first word (one more at the end)."""
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([np.zeros(1, np.int64), edge])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.start)


    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, each different word hashed once. No polynomial, so no pattern of letters makes words meet."""
        return np.fromiter(map(_Hashes().__getitem__, self.joined.split()), np.uint64)

    def word_numbers(self) -> np.ndarray:
        """Equal words have equal numbers, others others; in order of their first place."""
        return np.fromiter(map(_Numbers().__getitem__, self.joined.split()), np.int64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word, 42)
        return found


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, text: str = "text") -> Iterator[Block]:
    """The rows of an Arrow stream in order, cut into blocks; the other columns come along as lists."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        others = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != text}
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) < limit):
                held += len(texts[end]) + 1
                end += 1
            yield Block(texts[at:end], {n: v[at:end] for n, v in others.items()})
            at = end
        release()


def release() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, or of its inverse."""
    held = _powers.get((base, inverse))
    if held is None or len(held) <= n:
        steps = np.full(max(n, BLOCK_BYTES) + 1, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        steps[0] = 1
        held = np.cumprod(steps)
        if len(held) <= 8 << 20:  # a table for one huge text is not kept
            _powers[base, inverse] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class SpanHash:
    """Hash of any span of a sequence, in constant time after one pass; equal spans, equal values wherever they lie.

    A filter: a polynomial modulo 2**64 is the same for some long patterns that differ, so what a result rests on is
    compared in its bytes or by digests of them.
    """

    def __init__(self, values: np.ndarray, which: int = 0):
        n, self.base = len(values), BASES[which]
        part = values.astype(np.uint64)
        part += np.uint64(1)
        part *= powers(self.base, n)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part, out=self.sums[1:])
        self.inverse = powers(self.base, n, True)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, width: int, count: int) -> np.ndarray:
        """Of the spans of `width` at 0 .. count - 1."""
        return mix((self.sums[width : width + count] - self.sums[:count]) * self.inverse[:count] + np.uint64(width))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + counts[i] - 1 for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of spans of bytes, as rows of two numbers."""
    blake = hashlib.blake2b
    out = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, np.uint64).reshape(-1, 2)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places some span covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
