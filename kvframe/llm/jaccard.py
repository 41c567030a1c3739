"""Near-duplicates by the exact Jaccard similarity of word shingles: every pair at the threshold or above is linked.

A text is the set of its SHINGLE-word shingles (one shingle of all words if it has fewer). Sets are ordered by one
global order, rarest first. Two sets of similarity 0.8 or more share a member of their prefixes of n - ceil(0.8 n) + 1
members, so the prefixes' members are the keys under which candidates meet; the sizes and the places of the key in
both sets rule out what cannot reach the threshold, as do the bits in which the sets' parities differ (their number
is at most that of the members that only one has), and the whole sets decide. No step is approximate; the order is
from a sample, but any order is as good for the result.

Equal sets are one class; only classes are compared. Links that another method proposes (simhash.keep_one's) are
verified first, and then for each key one member of each component with the least of all, which settles most clusters
of many alike. Last, the classes that share a key meet in a group, in which those that are not in one component yet
are compared; a group answers with a spanning forest of its links, so these pairs never are rows, and only members
that may have a link in the group, by sizes and marks, send their sets. A key held by more than CHUNK classes, or by
sets of more than MEMBERS members, is cut into chunks, and each pair of chunks is a group of its own. Null and empty
texts are one class.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .components import connected_components
from .exchange import keyed
from .shared import Scratch, small_enough

SHINGLE = 5
CHUNK = 1024
#: Members of a chunk's sets together, about; 8 bytes each.
MEMBERS = 1 << 18
#: Members are dealt to places, four or more for each up to the limit; a set's mark says at which their number is odd.
MARK_BITS = (256, 1 << 18)
#: Shingles in at least two of about SAMPLE_ROWS texts count as common, COMMON of them at most.
SAMPLE_ROWS, COMMON = 20_000, 1 << 20


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    block = text.Block([t.lower() for t in texts], {})
    _, _, first = block.words()
    spans = text.SpanHash(block.word_hashes())
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        width = min(size, b - a)
        at = np.arange(a, b - width + 1) if width else np.zeros(0, np.int64)
        out.append(np.unique(spans.of(at, at + width)))
    return out


def node(own: np.ndarray) -> int:
    """A set's class, a signed long."""
    value = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return value - (1 << 64) if value >> 63 else value


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest members of a set, of which any set of similarity 0.8 or more has one among its own rarest."""
    if not len(own):
        return own
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, weight))][: len(own) - (4 * len(own) + 4) // 5 + 1]


def mark(own: np.ndarray) -> bytes:
    """A set's parities; those of half as many places are the exclusive or of its halves."""
    bits = min(MARK_BITS[1], max(MARK_BITS[0], 1 << (4 * len(own)).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many places two marks differ, which is no more than the members that only one set has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of common shingles and how many texts of the sample have each."""
    share = int(min(1.0, SAMPLE_ROWS / max(1, rows.count())) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            hashes = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(block.texts)])
            yield pa.record_batch([pa.array(hashes.view(np.int64))], names=["key"])

    drawn = rows.where(F.pmod(F.xxhash64("key_id", "key_text"), F.lit(1 << 20)) < share)
    found = drawn.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    table = found.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    hashes, counts = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prints(docs: DataFrame, fingerprint: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, key_id, key_text (see exchange.keyed), node, n (the set's size), mark, fp (of the text, if asked for), keys (its prefix in order) of every row."""
    rows = keyed(docs)
    held = docs.sparkSession.sparkContext.broadcast(_common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            sets = shingle_sets(block.texts)
            columns = [pa.array(block.columns[c], pa.int64()) for c in ("doc_id", "key_id", "key_text")]
            columns += [pa.array([node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([mark(x) for x in sets], pa.binary())]
            fp = np.array([fingerprint(t) if fingerprint else 0 for t in block.texts], np.uint64)
            keys = pa.array([prefix(x, *held.value).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([*columns, pa.array(fp.view(np.int64)), keys], names=["doc_id", "key_id", "key_text", "node", "n", "mark", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id long, key_id long, key_text long, node long, n long, mark binary, fp long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            sets = shingle_sets(block.texts)
            yield pa.record_batch([pa.array([node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "own"])

    return docs.select("text").mapInArrow(run, "node long, own binary")


def _reach(n: np.ndarray, left: np.ndarray, other_n: int, other_left: int) -> np.ndarray:
    """Which sets (size, members from the key on) may reach similarity 0.8 with another one that has the key."""
    return (5 * np.minimum(n, other_n) >= 4 * np.maximum(n, other_n)) & (9 * np.minimum(left, other_left) >= 4 * (n + other_n))


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each group's least node, one of each other component."""
    for batch in batches:
        members = batch.column("members")
        offsets, flat = members.offsets.to_numpy(), members.values
        nodes, n, pos, roots = (flat.field(k).to_numpy() for k in range(4))
        left, a, b = n - pos, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            order = lo + np.argsort(nodes[lo:hi])
            own, size, rest, root = nodes[order], n[order], left[order], roots[order]
            near = 1 + np.flatnonzero((root[1:] != root[0]) & _reach(size[1:], rest[1:], size[0], rest[0]))
            near = near[np.unique(root[near], return_index=True)[1]]
            a.append(np.repeat(own[0], len(near)))
            b.append(own[near])
        yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group that have a candidate of another component in it. A group's name is the digest of these members."""
    for batch in batches:
        members = batch.column("members")
        offsets, flat = members.offsets.to_numpy(), members.values
        nodes, n, pos, roots = (flat.field(k).to_numpy() for k in range(4))
        left, names, found, heads = n - pos, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            order = lo + np.argsort(nodes[lo:hi])
            own, size, rest, root = nodes[order], n[order], left[order], roots[order]
            has = np.zeros(len(own), bool)
            for i in range(len(own) - 1):
                near = (root[i + 1 :] != root[i]) & _reach(size[i + 1 :], rest[i + 1 :], size[i], rest[i])
                has[i] |= near.any()
                has[i + 1 :] |= near
            if has.any():
                found.append(own[has])
                heads.append(root[has])
                names.append(np.full(int(has.sum()), node(own[has]), np.int64))
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in (names, found, heads)], names=["name", "node", "root"])


def forest(sets: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """Links of similarity 0.8 or more, as index pairs, that connect whatever such links connect; sets of one root are connected already."""
    size = np.array([len(x) for x in sets], np.int64)
    members = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    left, held, edges = np.ones(len(sets), bool), np.zeros(len(members), bool), []
    for seed in range(len(sets)):
        front = np.flatnonzero(left & (roots == roots[seed])).tolist() if left[seed] else []
        left[front] = False
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return edges
            own = members[starts[at] : starts[at] + size[at]]
            held[own] = True
            both = np.add.reduceat(held[members], starts, dtype=np.int64)[rest]
            held[own] = False
            near = rest[5 * both >= 4 * (size[at] + size[rest] - both)]
            if len(near):
                edges += [(at, k) for k in near.tolist()]
                more = np.flatnonzero(left & np.isin(roots, roots[near])).tolist()
                left[more] = False
                front += more
    return edges


def _link(group: pa.Table) -> pa.Table:
    nodes = group.column("node").to_numpy()
    edges = forest([np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()], group.column("root").to_numpy())
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    return pa.table({"a": nodes[a], "b": nodes[b]})


def _near(group: pa.Table) -> pa.Table:
    """The members of a group that have one of another component whose mark leaves similarity 0.8 open, under the digest of these members."""
    table = group.sort_by("node")
    own, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
    marks = [np.frombuffer(x, np.uint64) for x in table.column("mark").to_pylist()]
    width, has = np.array([len(x) for x in marks]), np.zeros(len(own), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width >= w)
        folded = np.stack([np.bitwise_xor.reduce(marks[k].reshape(-1, w), axis=0) for k in at.tolist()])
        for i in np.flatnonzero(width[at] == w).tolist():
            differ = np.bitwise_count(folded ^ folded[i]).sum(1, dtype=np.int64)
            near = (root[at] != root[at[i]]) & (9 * differ <= n[at] + n[at[i]])
            has[at[near]] = True
            has[at[i]] |= near.any()
    name = node(own[has])
    return pa.table({"name": np.full(int(has.sum()), name, np.int64), "node": own[has], "root": root[has]})


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose marks don't rule out similarity 0.8: at most a ninth of both sizes may be in one set only."""
    for batch in batches:
        marks = (batch.column(c).to_pylist() for c in ("mark_a", "mark_b"))
        differ = np.array([apart(x, y) for x, y in zip(*marks, strict=True)], np.int64)
        keep = 9 * differ <= batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("own_a", "own_b")]
        keep = pa.array([similar(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _both(pairs: DataFrame, rows: DataFrame, stored: int) -> DataFrame:
    """`pairs` with the columns of `rows` (node ...) of either side."""
    for side in "ab":
        pairs = pairs.join(small_enough(rows.select(*(F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in rows.columns)), stored), side)
    return pairs


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs a, b of similarity 0.8 or more; `rows` has the marks. Only the sets of pairs that the marks leave are built."""

    def of(table: DataFrame, pairs: DataFrame, kind: str) -> tuple[DataFrame, int]:
        wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes-{kind}")
        found = table.join(small_enough(wanted, scratch.bytes(f"{name}-nodes-{kind}")), "node", "left_semi").dropDuplicates(["node"])
        return scratch.keep(found, f"{name}-{kind}"), scratch.bytes(f"{name}-{kind}")

    pairs = scratch.keep(pairs, f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    pairs = scratch.keep(_both(pairs, *of(rows.select("node", "n", "mark"), pairs, "marks")).mapInArrow(_close, "a long, b long"), f"{name}-close")
    links = scratch.keep(_both(pairs, *of(_sets(docs), pairs, "sets")).mapInArrow(_verify, "a long, b long"), name)
    scratch.drop(f"{name}-sets")
    return links


def _members(held: DataFrame) -> DataFrame:
    """The groups of `held` (key, lo, hi, node, n, pos, root)."""
    groups = held.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("node", "n", "pos", "root")).alias("members"))
    return groups.where(F.size("members") > 1).select("members")


def _joined(held: DataFrame, docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links that connect whatever pairs of `held` (key, lo, hi, node, n, pos, root) of similarity 0.8 or more do.

    Pairs never are rows: a group sends its members once, first with their marks (`rows` has them) and, as far as these
    leave any pair, with their sets, and answers with a forest of its links. Groups of the same members are one.
    """

    def of(table: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
        wanted = scratch.keep(groups.select("node").distinct(), f"{kind}-nodes")
        found = table.join(small_enough(wanted, scratch.bytes(f"{kind}-nodes")), "node", "left_semi").dropDuplicates(["node"])
        found = scratch.keep(found, kind)
        return groups.join(small_enough(found, scratch.bytes(kind)), "node").groupBy("name")

    groups = _members(held).mapInArrow(_alike, "name long, node long, root long")
    groups = scratch.keep(groups.dropDuplicates(["name", "node"]), "alike")
    groups = of(rows.select("node", "n", "mark"), groups, "alike-marks").applyInArrow(_near, "name long, node long, root long")
    groups = scratch.keep(groups.dropDuplicates(["name", "node"]), "near-alike")
    links = scratch.keep(of(_sets(docs), groups, "alike-sets").applyInArrow(_link, "a long, b long").distinct(), "joined")
    for name in ("alike", "alike-marks", "near-alike", "alike-sets"):
        scratch.drop(name)
    return links


def grouped(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK, fingerprint: Callable[[bytes], int] | None = None, proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, key_id, key_text, root (a class that stands for the component) of every row of `docs`.

    `proposed` gives pairs of nodes that are likely alike, from a table of node, fp; they change how much is left to compare, not the result.
    """
    spark = docs.sparkSession
    rows = scratch.keep(prints(docs, fingerprint), "prints")
    classes = rows.dropDuplicates(["node"])
    keys = scratch.keep(classes.select("node", "n", F.posexplode("keys").alias("pos", "key")), "keys")
    nodes = scratch.keep(classes.select("node", "fp"), "nodes")
    rows = scratch.keep(rows.drop("keys", "fp"), "rows")
    scratch.drop("prints")
    links, turn = [], 0

    def rooted(table: DataFrame) -> DataFrame:
        """`table` with the root of its nodes by the links so far."""
        nonlocal turn
        if not links:
            return table.withColumn("root", F.col("node"))
        turn += 1
        parts = connected_components(functools.reduce(DataFrame.unionByName, links), Scratch(spark, "jaccard"))
        parts = scratch.keep(parts, f"parts{turn}")
        return table.join(small_enough(parts, scratch.bytes(f"parts{turn}")), "node", "left").withColumn("root", F.coalesce("root", "node"))

    if proposed:
        links.append(_verified(proposed(nodes), docs, rows, scratch, "proposed"))
    shared = keys.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("members")).where("count > 1")
    shared = shared.select("key", F.ceil(F.greatest(F.col("count") / chunk, F.col("members") / MEMBERS)).alias("chunks"))
    shared = scratch.keep(shared, "shared")
    held = keys.join(small_enough(shared, scratch.bytes("shared")), "key")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks"))
    held = held.select("key", "node", "n", F.col("pos").cast("long").alias("pos"), mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    held = held.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "n", "pos")
    held = scratch.keep(held, "groups")
    scratch.drop("keys")
    links.append(_verified(_members(rooted(held)).mapInArrow(_least, "a long, b long").distinct(), docs, rows, scratch, "first"))
    links.append(_joined(rooted(held), docs, rows, scratch))
    scratch.drop("groups")
    return rooted(rows.select("doc_id", "key_id", "key_text", "node")).select("doc_id", "key_id", "key_text", "root")
