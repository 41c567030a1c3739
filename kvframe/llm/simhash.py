"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have five segments around a ring. If two differ in at most four bits, then from some segment on every
chain of l segments differs in at most floor(4 l / 5) bits: none in the first, at most one in the first two, and so
on. Two fingerprints therefore share, for some start, the first segment and one half of the second (or, for longer
keys where there are more fingerprints, half of the halves of more segments); these keys make the candidates, the
chain budgets prune them, and the full Hamming distance decides.

Copies share a fingerprint and are one class; only classes are compared. A key held by more than CHUNK classes is
cut into chunks by hash, and each pair of chunks is a group of its own, so no group grows without bound and no link
is lost. A group answers with a spanning forest of its links, not with its pairs. Null and empty texts have
fingerprint zero and are linked like any other; a null doc_id is never the smallest unless there is no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, text
from .components import connected_components
from .exchange import NO_ID, keyed
from .shared import Scratch, small_enough

SHINGLE, SEED, BITS = 4, 42, 4
CHUNK = 1024
#: Segments from the lowest bit: width each, 64 together.
SEGMENTS = (13, 13, 13, 13, 12)
_OFFSETS = np.cumsum((0, *SEGMENTS))[:-1].tolist()


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)  # one shingle: its bits are over half
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    ends = starts[size - 1 :] + lens[size - 1 :]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))  # noqa: B905
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key_id, key_text (see exchange.keyed), fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            prints = np.array([fingerprint(t.lower().split(), size) for t in block.texts], np.uint64)
            keys = [pa.array(block.columns[n], pa.int64()) for n in ("doc_id", "key_id", "key_text")]
            yield pa.record_batch([*keys, pa.array(prints.view(np.int64))], names=["doc_id", "key_id", "key_text", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, key_id long, key_text long, fp long")


def ring_keys(chain: int = 2, fp: str = "fp"):
    """The keys of a fingerprint by chains of so many segments: for each start its segment, with half of the halves of the others.

    A chain that keeps its budget has no differing bit in its first segment and at most chain - 1 in the others, so of
    their 2 (chain - 1) halves as many as half have none. Keys have 18 to 20 bits for chains of two, 7 more for each
    segment more: as many as let a key be shared by few.
    """
    keys = []
    part = lambda start, bits: F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))
    for i, (at, width) in enumerate(zip(_OFFSETS, SEGMENTS, strict=True)):
        halves = []
        for n in range(1, chain):
            k = (i + n) % len(SEGMENTS)
            low = SEGMENTS[k] // 2
            halves += [(_OFFSETS[k], low), (_OFFSETS[k] + low, SEGMENTS[k] - low)]
        for number, chosen in enumerate(combinations(halves, chain - 1)):
            key = part(at, width)
            for start, bits in chosen:
                key = F.shiftleft(key, 7) + part(start, bits)
            keys.append(F.shiftleft(key, 10) + F.lit(number << 3 | i))
    return F.array(*keys)


def chain_for(classes: int) -> int:
    """The shortest chain whose keys are shared by few of so many fingerprints."""
    return next((n for n, most in ((2, 1 << 20), (3, 1 << 27), (4, 1 << 34)) if classes <= most), 5)


def _budgets(start: int, bits: int) -> list[tuple[int, int]]:
    """For chains of one, two ... segments from `start`: a mask of the chain and the bits that may differ in it."""
    out, mask = [], 0
    for n in range(len(SEGMENTS)):
        k = (start + n) % len(SEGMENTS)
        mask |= ((1 << SEGMENTS[k]) - 1) << _OFFSETS[k]
        out.append((mask, bits * (n + 1) // len(SEGMENTS)))
    return out


_CHAINS = [_budgets(i, BITS) for i in range(len(SEGMENTS))]


def forest(prints: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one group's fingerprints (unsigned), as index pairs."""
    n, chain = len(prints), _CHAINS[start]
    edges = []
    if n <= 12:
        values, label = prints.tolist(), list(range(n))
        for i in range(n):
            for j in range(i):
                x = values[i] ^ values[j]
                if label[i] != label[j] and all((x & mask).bit_count() <= most for mask, most in chain):
                    edges.append((j, i))
                    old, new = label[i], label[j]
                    label = [new if k == old else k for k in label]
        return edges
    left = np.ones(n, bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            diff = prints[rest] ^ prints[at]
            for mask, most in chain:
                near = np.bitwise_count(diff & np.uint64(mask)) <= most
                rest, diff = rest[near], diff[near]
            left[rest] = False
            front += rest.tolist()
            edges += [(seed, int(k)) for k in rest]
    return edges


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for key, prints in zip(batch.column("key").to_pylist(), batch.column("prints").to_pylist(), strict=True):
            values = np.array(prints, np.int64)
            for i, j in forest(values.view(np.uint64), key & 7):
                a.append(prints[i])
                b.append(prints[j])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame, scratch: Scratch, chunk: int = CHUNK, chain: int | None = None) -> DataFrame:
    """a, b: links that connect whatever fingerprints (distinct, column fp) are linked by distance."""
    rows = prints.select("fp", F.explode(ring_keys(chain or chain_for(prints.count()))).alias("key"))
    hot = scratch.keep(rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).alias("chunks")), "hot")
    rows = rows.join(small_enough(hot, scratch.bytes("hot")), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    rows = rows.select("fp", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    groups = rows.groupBy("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).agg(F.collect_list("fp").alias("prints"))
    return groups.where(F.size("prints") > 1).select("key", "prints").mapInArrow(_link, "a long, b long").distinct()


def grouped(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, key_id, key_text, fp, root (a fingerprint that stands for the component), component_id of every row of `docs`."""
    rows = scratch.keep(fingerprints(docs, size), "prints")
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = connected_components(links(classes, scratch, chunk), scratch)
    rooted = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(rooted.join(heads, "root").select("fp", "root", "component_id"), "named")
    return rows.join(small_enough(named, scratch.bytes("named")), "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) for every row of `docs`."""
    return grouped(docs, Scratch(docs.sparkSession, "simhash"), size, chunk).select("doc_id", "fp", "component_id")


def proposals(scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """Pairs of nodes (node, fp) by fingerprint: the least node of each with the others, and the least nodes of linked ones."""

    def run(nodes: DataFrame) -> DataFrame:
        heads = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads-fp")
        size = scratch.bytes("heads-fp")
        alike = nodes.join(small_enough(heads, size), "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        near = scratch.keep(links(heads.select("fp"), scratch), "near")
        for side in "ab":
            near = near.join(small_enough(heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), size), side)
        near = near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
        return alike.unionByName(near).distinct()

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component of texts of 5-word Jaccard similarity 0.8 or more: that of the smallest doc_id.

    Pigeonring filtering of the texts' fingerprints (of five-word shingles) proposes links, which the similarity itself
    verifies. Two texts of similarity 0.8 may differ in any number of fingerprint bits, so jaccard then finds the links
    that are left, exactly. The columns stay. A null doc_id counts as the largest; among rows of equal doc_id the
    least hash of the text decides.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    own = lambda t: fingerprint(t.lower().split(), jaccard.SHINGLE)
    rows = jaccard.grouped(docs, scratch, fingerprint=own, proposed=proposals(scratch)).groupBy("root", "key_id", "key_text").agg(F.count("*").alias("n"))
    heads = rows.groupBy("root").agg(F.min(F.struct("key_id", "key_text", "n")).alias("h"))
    heads = scratch.keep(heads.select(F.col("h.key_id").alias("__id"), F.col("h.key_text").alias("__text"), F.col("h.n").alias("__n")), "heads")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text"))
    kept = docs.join(small_enough(heads, scratch.bytes("heads")), same)
    if heads.where("__n > 1").isEmpty():
        return kept.select(docs.columns)
    again = kept.where("__n > 1").dropDuplicates(["__id", "__text"])  # the same row more than once
    return kept.where("__n = 1").select(docs.columns).unionByName(again.select(docs.columns))
