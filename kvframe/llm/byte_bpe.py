"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaves of a piece's tree are its byte positions; a leaf holds the rank of the pair that starts there, joined
with the position, so the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair,
its right half and the live neighbour on the left) and the nodes above them. Pieces of like length are worked on in
step, one merge of each at a time. What a task holds is a block of texts and a cache of bounded size.

Null texts read as empty; empty texts have no tokens. Extra columns are ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import bounded_batches

#: Pieces whose tokens a worker remembers; others are encoded again in each block where they occur.
CACHE_PIECES = 150_000
#: Tree nodes worked on at once.
TREE_NODES = 1 << 20
_FAR = np.int64(1) << np.int64(62)
_held: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks of a tiktoken file and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.find = regex.compile(pattern).findall
        count = max(self.ranks.values()) + 1
        self.bits = int(count).bit_length()
        tokens = [b""] * count
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_size = np.fromiter(map(len, tokens), np.int64, count)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.bits | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], _FAR)
        self.pair_rank = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _FAR)
        self.cache: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, _FAR for none; a token of -1 makes no pair."""
        key = left << self.bits | right
        at = np.searchsorted(self.pair_key, key)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], _FAR)

    def merge(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Tokens of pieces of at most `size` bytes each, a power of two."""
        n, shift = len(pieces), np.int64(size.bit_length() - 1)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        row = np.arange(n)
        token = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
        inside = np.arange(size) < lens[:, None]
        token[:, :size][inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        after[row, lens - 1] = size
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        before[:, 0] = size
        tree = np.full((n, 2 * size), _FAR, np.int64)
        first = self.pair(token[:, :size].ravel(), token[:, 1:].ravel()).reshape(n, size)
        tree[:, size:] = np.where(first < _FAR, first << shift | np.arange(size), _FAR)
        level = size
        while level > 1:
            half = level >> 1
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        live = np.flatnonzero(tree[:, 1] < _FAR)
        while len(live):
            top = tree[live, 1]
            at = top & (size - 1)
            gone = after[live, at]
            right, left = after[live, gone], before[live, at]
            merged = top >> shift
            token[live, at] = merged
            token[live, gone] = -1
            after[live, at] = right
            has = right < size
            before[live[has], right[has]] = at[has]
            own, prior = self.pair(merged, token[live, right]), self.pair(token[live, left], merged)
            tree[live, size + at] = np.where(own < _FAR, own << shift | at, _FAR)
            tree[live, size + gone] = _FAR
            has = left < size
            tree[live[has], size + left[has]] = np.where(prior < _FAR, prior << shift | left, _FAR)[has]
            nodes = [size + at, size + gone, size + np.where(has, left, at)]
            while nodes[0][0] > 1:
                for k, node in enumerate(nodes):
                    nodes[k] = node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] < _FAR]
        kept = token[:, :size] >= 0
        return np.split(token[:, :size][kept].astype(np.uint32), np.cumsum(kept.sum(1))[:-1])

    def pieces(self, strings: list[str]) -> list[np.ndarray]:
        """Tokens of each piece."""
        out: list = [self.cache.get(s) for s in strings]
        todo: dict[int, list[tuple[int, bytes]]] = {}
        for i, known in enumerate(out):
            if known is not None:
                out[i] = np.frombuffer(known, np.uint32)
            else:
                raw = strings[i].encode()
                rank = self.ranks.get(raw)
                if rank is not None:
                    out[i] = np.array([rank], np.uint32)
                else:
                    todo.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((i, raw))
        for size, some in todo.items():
            step = max(1, TREE_NODES // (2 * size))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                for (i, _), tokens in zip(part, self.merge([raw for _, raw in part], size), strict=True):
                    out[i] = tokens
        for s, tokens in zip(strings, out, strict=True):
            if len(self.cache) >= CACHE_PIECES:
                break
            if len(s) < 32:
                self.cache.setdefault(s, tokens.tobytes())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        index: dict[str, int] = {}
        add = index.setdefault
        which = [np.array([add(p, len(index)) for p in self.find(t)], np.int64) for t in texts]
        tokens = self.pieces(list(index))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        start = np.cumsum(size) - size
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        return [flat[text.ranges(start[w], size[w])] for w in which]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[text.ranges(self.token_start[ids], self.token_size[ids])].tobytes()


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (the text got back from the ids) for every row of `docs`.

    With `digest`, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 stand in place of ids and decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for block in text.blocks(batches):
            ids = own.encode([t.decode() for t in block.texts])
            decoded = map(own.decode, ids)
            out = [pa.array(block.columns["doc_id"], pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
            if digest:
                names = ["ids_sha256", "decoded_sha256"]
                out += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            else:
                names = ["ids", "decoded"]
                ends = np.cumsum([0] + [len(x) for x in ids])
                flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(list(decoded), pa.binary()).cast(pa.string())]
            yield pa.record_batch(out, names=["doc_id", "n_tokens", *names])

    bounded_batches(docs.sparkSession)
    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {more}")
