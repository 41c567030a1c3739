"""Packed exchange: records of many rows travel as one binary value for each (block of texts, hash bucket).

A record is a 64-bit hash with further fixed-width fields. Bucket = the hash's top bits, so the records of equal
hash meet in one bucket; a bucket's size is bounded by choosing the number of buckets from the input's size. A
reducer answers each block with the records it has picked, and the block's directory (row keys) turns those into
spans of documents. A block's id is partition number and counter, the same when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import small_enough

#: Bytes of Parquet input for each bucket; a word or byte record takes about 10 bytes.
BUCKET_INPUT_BYTES = 4 << 20
PACKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
PICKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SPANS = pa.schema([("key_id", pa.int64()), ("key_text", pa.int64()), ("spans", pa.binary())])
NO_ID = (1 << 63) - 1
#: log2 of a number of buckets at which a block's records for each are still some tens.
MANY = 13
#: Keys for rows that go straight to their block's answer.
HOMES = 1 << 20
#: What a row for a block holds: its directory, the other places of its records, picked answers.
ROWS, OTHERS, PICKS = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key (key_id, key_text): rows of equal id and text share a key, and a null id sorts last."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_text"),
        "text",
    )


def bucket_bits(input_bytes: int, least: int = 6) -> int:
    """log2 of the number of buckets: of BUCKET_INPUT_BYTES each up to MANY buckets, beyond that of up to 16 times as many, so that what a block sends to a bucket is worth a row."""
    small, large = (int(np.ceil(np.log2(max(1, input_bytes / size)))) for size in (BUCKET_INPUT_BYTES, 16 * BUCKET_INPUT_BYTES))
    return min(28, max(least, min(small, max(MANY, large))))


def pack(fields: list[np.ndarray]) -> bytes:
    """Unsigned values, each field in as many bytes as its largest value takes."""
    n, widths, parts = len(fields[0]), [], []
    for x in fields:
        x = np.ascontiguousarray(x).astype(np.uint64, copy=False)
        width = (int(x.max()).bit_length() + 7) // 8 if n else 0
        widths.append(width)
        parts.append(x.view(np.uint8).reshape(n, 8)[:, :width].tobytes())
    return np.array([n, *widths], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes, count: int) -> list[np.ndarray]:
    head = np.frombuffer(data, np.int64, count + 1)
    n, at, out = int(head[0]), 8 * (count + 1), []
    for width in map(int, head[1:]):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        out.append(wide.view(np.uint64).reshape(n))
        at += n * width
    return out


def directory(block: text.Block, first: np.ndarray) -> bytes:
    """The keys of a block's rows and the place in the block where each begins."""
    keys = [np.array(block.columns[n], np.int64).view(np.uint64) for n in ("key_id", "key_text")]
    return pack([*keys, first[: len(block)]])


def parcel(name: int, fields: list[np.ndarray], listed: bytes, bits: int) -> pa.RecordBatch:
    """A block's records by bucket. Records that agree in all but the place (the last field) are sent once, with a field before the place that says so; the block keeps the other places.

    The rows that only the block's own answer needs (its directory, the other places) go by a mix of the block's
    name, so they spread over all tasks. However often a hash occurs, a block sends it once.
    """
    order = np.lexsort(fields[-2::-1]) if len(fields) > 2 else np.argsort(fields[0], kind="stable")
    *fields, place = [x[order] for x in fields]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in fields], axis=0)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(order)))
    others = np.stack([np.repeat(place[begin], size), place], 1)[~fresh]
    others = others[np.argsort(others[:, 0], kind="stable")]
    bucket = (fields[0][begin] >> np.uint64(64 - bits)).astype(np.int64)
    sent = [fields[0][begin] & np.uint64((1 << (64 - bits)) - 1), *(x[begin] for x in fields[1:]), size > 1, place[begin]]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    home = -1 - int(text.mix(np.array([name], np.uint64))[0] % np.uint64(HOMES))
    keys, values = [home] * 2, [bytes([ROWS]) + listed, bytes([OTHERS]) + pack([others[:, 0], others[:, 1]])]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        keys.append(int(bucket[a]))
        values.append(pack([x[a:b] for x in sent]))
    return pa.record_batch([pa.array(keys, pa.int32()), pa.array([name] * len(keys), pa.int64()), pa.array(values, pa.binary())], schema=PACKED)


def sender(records: Callable[[text.Block], tuple[list[np.ndarray], np.ndarray] | None], bits: int, limit: int = text.BLOCK_BYTES) -> Callable:
    """mapInArrow function. `records` gives a block's hashes, further fields, last the place of each record, and where rows begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for block in text.blocks(batches, limit):
            got = records(block)
            if got is None or not len(got[0][0]):
                continue
            yield parcel((part << 32) | count, got[0], directory(block, got[1]), bits)
            count += 1

    return run


def receiver(count: int, pick: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """applyInArrow function for a bucket: `pick(fields)` flags records and gives each one's answer, which goes back to its block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, values = table.column("block").to_pylist(), table.column("data").to_pylist()
        if key[0].as_py() < 0:
            return pa.table([pa.array(names, pa.int64()), pa.array([x[0] for x in values], pa.int32()), pa.array([x[1:] for x in values], pa.binary())], schema=PICKED)
        parts = [unpack(x, count) for x in values]
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        flags, answers = pick([np.concatenate(x) for x in zip(*parts, strict=True)])
        out_name, out_data = [], []
        for name, a, b in zip(names, cut[:-1], cut[1:], strict=True):
            if flags[a:b].any():
                out_name.append(name)
                out_data.append(pack([answers[a:b][flags[a:b]]]))
        del parts, flags, answers
        text.release()
        return pa.table([pa.array(out_name, pa.int64()), pa.array([PICKS] * len(out_name), pa.int32()), pa.array(out_data, pa.binary())], schema=PICKED)

    return run


def gatherer(finish: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shift: int = 0) -> Callable:
    """applyInArrow function for a block: `finish(answers, first)` makes spans of its answers, which are kept by row.

    An answer is a place, shifted left, with whatever its low bits say; it holds for the other places of its record
    too. `finish` gives the row of each span, ascending, and the spans as rows of an int32 matrix.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        text.release()
        kind, values = table.column("kind").to_pylist(), table.column("data").to_pylist()
        of = lambda k: [x for x, own in zip(values, kind, strict=True) if own == k]
        picked = [unpack(x, 1)[0] for x in of(PICKS)]
        if not picked:
            return SPANS.empty_table()
        ids, texts, first = (x.view(np.int64) for x in unpack(of(ROWS)[0], 3))
        head, other = (x.view(np.int64) for x in unpack(of(OTHERS)[0], 2))
        answers = np.concatenate(picked).view(np.int64)
        place = answers >> shift
        low = np.searchsorted(head, place)
        many = np.searchsorted(head, place, "right") - low
        more = other[text.ranges(low, many)] << shift | np.repeat(answers & ((1 << shift) - 1), many)
        owner, spans = finish(np.sort(np.concatenate([answers, more])), first)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        out = [(int(ids[owner[a]]), int(texts[owner[a]]), spans[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SPANS.types, strict=True)], schema=SPANS)

    return run


def owners(place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row of each place of a block; of rows that begin at one place, which have no places, the last."""
    return np.searchsorted(first, place, "right") - 1


def covering(width: int) -> Callable:
    """`finish` for answers that are places: start, end of the runs that places p .. p + width - 1 cover."""

    def finish(place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = owners(place, first)
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + width)
        begin = np.flatnonzero(fresh)
        last = np.concatenate([begin[1:], [len(row)]]) - 1
        owner = row[begin]
        return owner, np.stack([place[begin] - first[owner], place[last] + width - first[owner]], 1).astype(np.int32)

    return finish


def exchange(rows: DataFrame, send: Callable, count: int, pick: Callable, finish: Callable, shift: int = 0) -> DataFrame:
    """key_id, key_text, spans: what `pick` has picked of the records of `rows`, one row for each key.

    `send` is a mapInArrow function that makes parcels, and `count` the number of a record's fields as sent: with the one that says whether it stands for several.
    """
    packed = rows.mapInArrow(send, "bucket int, block long, data binary")
    picked = packed.groupBy("bucket").applyInArrow(receiver(count, pick), "block long, kind int, data binary")
    spans = picked.groupBy("block").applyInArrow(gatherer(finish, shift), "key_id long, key_text long, spans binary")
    return merged(spans)


def merged(spans: DataFrame) -> DataFrame:
    """One row for each key; of rows of one key (in several blocks, or from several steps) what any of them has."""
    joined = F.aggregate(F.collect_set("spans"), F.lit(b""), lambda a, x: F.concat(a, x))
    return spans.groupBy("key_id", "key_text").agg(joined.alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, stored: int) -> DataFrame:
    """`docs` (keyed) with the spans of each row, null where it has none."""
    return docs.join(small_enough(spans, stored), ["key_id", "key_text"], "left")


def span_list(data: bytes | None, columns: int = 2) -> np.ndarray:
    """One row's spans, start and end each, or whatever the columns are."""
    return np.frombuffer(data or b"", np.int32).reshape(-1, columns).astype(np.int64)


def classes(hashes: np.ndarray, more: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (hash, *more) side by side, and which of the ordered begin a class."""
    order = np.lexsort((*more, hashes)) if more else np.argsort(hashes)
    fresh = np.ones(len(order), bool)
    if len(order):
        h = hashes[order]
        fresh[1:] = h[1:] != h[:-1]
        for x in more:
            x = x[order]
            fresh[1:] |= x[1:] != x[:-1]
    return order, fresh
