"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 25 words; their hashes are the index. Every rolling
window of 25 words of every document probes it. A repeated 50-word window holds a whole reference block, so each
repeat gets a hit; hits are extended to the 50-word windows around them, which must agree with a window of a
document of smaller id in a 128-bit BLAKE2b digest of their own words, joined by single spaces (the index's hashes
only find candidates); runs of such windows are the maximal exact repeats that are removed. Very long texts are a
block of their own; nothing is cut.

Null and empty texts have no words. Rows without doc_id are judged against all others and never count as earlier;
rows of equal doc_id are not earlier than one another. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import text
from .shared import Scratch, input_bytes, small_enough

WINDOW = 50
BLOCK = WINDOW // 2


def _word_hashes(block: text.Block, width: int):
    starts, ends, first = block.words()
    if len(starts) < width:
        return None
    words = block.word_hashes()
    row = np.repeat(np.arange(len(block)), np.diff(first))
    index = np.arange(len(words))
    return words, first, row, index - first[row], first[row + 1] - index


def anchors(size: int):
    """Records of the first exchange: rolling windows of `size` words, and whether one is a reference block."""

    def records(block: text.Block):
        got = _word_hashes(block, size)
        if got is None:
            return None
        words, first, _, place, left = got
        count = len(words) - size + 1
        fits = np.flatnonzero(left[:count] >= size)
        hashes = text.SpanHash(words).rolling(size, count)[fits]
        return [hashes, place[fits] % size == 0, fits], first

    return records


def pick_hits(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records whose hash occurs twice or more, at least once as a reference block."""
    order, fresh = ex.classes(fields[0])
    begin = np.flatnonzero(fresh)
    records = np.diff(np.append(begin, len(order)))
    anchored, many = (np.add.reduceat(fields[k][order].astype(np.int64), begin) > 0 for k in (1, 2))
    flags = np.zeros(len(order), bool)
    flags[order] = np.repeat(((records > 1) | many) & anchored, records)
    return flags, fields[-1]


def extensions(window: int, size: int):
    """Records of the second exchange: the windows of `window` words that hold a hit of `size` words."""

    def records(block: text.Block):
        got = _word_hashes(block, window)
        if got is None:
            return None
        words, first, row, _, left = got
        near = np.zeros(len(words) + 1, np.int64)
        for r, spans in enumerate(block.columns["spans"]):
            for a, b in ex.span_list(spans):  # the hits' first words a .. b - 1
                near[first[r] + max(0, a - (window - size))] += 1
                near[first[r] + b] -= 1
        count = len(words) - window + 1
        at = np.flatnonzero((np.cumsum(near)[:count] > 0) & (left[:count] >= window))
        if not len(at):
            return None
        ids = np.array(block.columns["key_id"], np.int64).view(np.uint64)
        parts = block.joined.split()
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)])
        exact = text.digests(b" ".join(parts), begin[at], begin[at + window] - 1)
        return [exact[:, 0], exact[:, 1], ids[row[at]], at], first

    return records


def pick_later(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records whose window a smaller doc_id has too."""
    ids = fields[2].view(np.int64)
    order, fresh = ex.classes(fields[0], [fields[1]])
    begin = np.flatnonzero(fresh)
    least = np.minimum.reduceat(ids[order], begin)
    flags = np.zeros(len(order), bool)
    flags[order] = ids[order] > np.repeat(least, np.diff(np.append(begin, len(order))))
    return flags, fields[-1]


def remove_spans(digest: bool = False):
    """mapInArrow function that leaves out the words of each row's spans. (bytes.split() parts at the same bytes as Block.words().)

    Its last columns are text and kept_text, or only the kept text's SHA-256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            starts, ends, first = block.words()
            counts, gone, kept = np.diff(first), [], []
            for r, spans in enumerate(block.columns["spans"]):
                a, lost = int(first[r]), ex.span_list(spans)
                cover = text.covered(int(counts[r]), lost[:, 0], lost[:, 1])
                gone.append(int(cover.sum()))
                pieces = [x for i, j in zip(*text.runs(~cover), strict=True) for x in block.buf[starts[a + i] : ends[a + j - 1]].tobytes().split()]
                joined = b" ".join(pieces)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined)
            out = [pa.array(block.columns["doc_id"], pa.int64()), pa.array(counts), pa.array(gone, pa.int64())]
            out += [pa.array(kept, pa.string())] if digest else [pa.array(x, pa.binary()).cast(pa.string()) for x in (block.texts, kept)]
            yield pa.record_batch(out, names=["doc_id", "n_words", "n_removed", *(["kept_sha256"] if digest else ["text", "kept_text"])])

    return run


def _found(docs: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The spans of words to remove, by row key, and their stored size."""
    size = window // 2
    rows, scratch = ex.keyed(docs), Scratch(docs.sparkSession, "substring")
    bits = ex.bucket_bits(input_bytes(docs), 8)
    hits = scratch.keep(ex.exchange(rows, ex.sender(anchors(size), bits), 4, pick_hits, ex.covering(1)), "hits")
    wide = ex.with_spans(rows, hits, scratch.bytes("hits"))
    found = scratch.keep(ex.exchange(wide, ex.sender(extensions(window, size), max(6, bits - 2)), 5, pick_later, ex.covering(window)), "found")
    return found, scratch.bytes("found")


def substring_dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, text, kept_text (the kept words joined by one space) for every row of `docs`.

    With `digest`, kept_sha256 (lowercase hex) stands in place of the texts.
    """
    full = ex.with_spans(ex.keyed(docs), *_found(docs, window))
    return full.mapInArrow(remove_spans(digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256 string' if digest else 'text string, kept_text string'}")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the repeated words: a text that loses words is its kept words joined by one space, others are unchanged."""
    found, stored = _found(docs, window)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, data in zip(texts, spans, strict=True):
            words, lost = t.encode().split() if data is not None else [], ex.span_list(data)
            cover = text.covered(len(words), lost[:, 0], lost[:, 1])
            out.append(b" ".join(w for w, gone in zip(words, cover.tolist(), strict=True) if not gone).decode())
        return pd.Series(out, dtype=object)

    spans = found.select(F.col("key_id").alias("__id"), F.col("key_text").alias("__text"), F.col("spans").alias("__spans"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.NO_ID)) == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text"))
    wide = docs.join(small_enough(spans, stored), same, "left")
    return wide.withColumn("text", F.when(F.col("__spans").isNotNull(), kept("text", "__spans")).otherwise(F.col("text"))).select(docs.columns)


#: The digest form over `documents` in DuckDB, window by window.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(i)),
m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM (SELECT s.doc_id, s.i FROM s JOIN m ON s.h = m.h WHERE m.least < s.doc_id) x),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
