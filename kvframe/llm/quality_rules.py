"""Quality rules by suffix-array repetition.

The suffixes of a text's words are sorted by prefix doubling (ranks of 1, 2, 4 ... words; suffixes that are already
unique stay where they are), neighbours' longest common prefixes come from the kept ranks, and every interval of
the LCP array of at least LEAST words is a repeated substring. The union of the spans of the maximal ones is the
covered part. A text is rejected if the covered fraction or the longest repeat is over its limit.

Words are numbered by their bytes, so nothing rests on hashes; the windows of the base rule are the same suffixes with
a common prefix of three words. A text of any length is read whole, in memory of some 100 bytes for each word.
Null and empty texts have no words and fail the base rule. Extra columns are ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import bounded_batches

#: Words a repeated substring has at least; covered fraction and words of the longest repeat that a kept text has at most.
LEAST, MOST_COVERED, MOST_REPEAT = 8, 0.4, 200
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def suffix_ranks(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the concatenation of groups' symbols, where suffixes end with their group; the ranks by 1, 2, 4 ... symbols.

    `group` is ascending. Suffixes are ordered by group first. Rank arrays have one more place, for past the end.
    """
    n = len(symbols)
    last = np.searchsorted(group, group, "right")  # where each suffix's group ends
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.lexsort((rank, group))
    levels, step = [], 0
    while True:
        if step == 0:
            key_a, key_b = group[order], rank[order]
        else:
            ahead = np.arange(n) + step
            second = np.where(ahead < last, rank[np.minimum(ahead, n - 1)], 0)
            tied = np.flatnonzero(_tied(rank[order]))
            part = order[tied]
            order = order.copy()
            order[tied] = part[np.lexsort((second[part], rank[part]))]
            key_a, key_b = rank[order], second[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        levels.append(rank)
        step = 2 * step or 1
        if fresh.all() or step >= n:
            return order, levels


def _tied(sorted_ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_ranks) + 1, bool)
    same[1:-1] = sorted_ranks[1:] == sorted_ranks[:-1]
    return same[1:] | same[:-1]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in order with the one before it (0 for the first)."""
    n = len(order)
    a, b = order[1:].copy(), order[:-1].copy()
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return lcp


def longest_repeats(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and somewhere else in its group.

    That is the larger of the LCPs with the two neighbours: the LCP interval of that length holds the suffix, and the
    spans of all intervals' substrings have the same union as these (tests/llm holds it against the intervals).
    """
    order, levels = suffix_ranks(symbols, group)
    lcp = common_prefixes(order, levels)
    best = np.zeros(len(order), np.int64)
    best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return best


def spans_covered(best: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which positions a repeat of `least` or more covers; of longer repeats the first `most` positions count."""
    at = np.flatnonzero(best >= least)
    return text.covered(len(best), at, at + (best[at] if most is None else np.minimum(best[at], most)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def measure(block: text.Block, least: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of each row."""
    starts, ends, first = block.words()
    rows, n_words = len(block), np.diff(first)
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((block.buf & 0xC0) != 0x80)])
    word_chars = _sums(chars[ends] - chars[starts], first)
    symbols = _sums(_SYMBOL[block.buf], block.start)
    dup_lines = np.zeros(rows, np.int64)
    for r, raw in enumerate(block.texts):
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip()]
            dup_lines[r] = len(lines) - len(set(lines))
    n = len(starts)
    group = np.repeat(np.arange(rows), n_words)
    if not n:
        none = np.zeros(rows, np.int64)
        return [n_words, word_chars, symbols, dup_lines, none, none, none]
    best = longest_repeats(block.word_numbers(), group)
    triple, cover = spans_covered(best, 3, 3), spans_covered(best, least)
    best[best < least] = 0
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, group, best)
    return [n_words, word_chars, symbols, dup_lines, _sums(triple, first), _sums(cover, first), longest]


def quality_rules(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT) -> DataFrame:
    """doc_id with base counts, base_failed, kept, covered_words and longest_repeat (words) for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            n_words, word_chars, symbols, dup_lines, repeat_words, cover, longest = measure(block, least)
            failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
            kept = ~failed & (cover <= most_covered * n_words) & (longest <= most_repeat)
            values = [n_words, word_chars, symbols, dup_lines, repeat_words, failed, kept, cover, longest]
            names = [x.split()[0] for x in OUT.split(", ")]
            yield pa.record_batch([pa.array(block.columns["doc_id"], pa.int64()), *map(pa.array, values)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


#: The contract's columns over `documents` in DuckDB: a word is covered by repeats of LEAST words or more if a window of
#: LEAST words that holds it occurs again, and a repeat is over MOST_REPEAT words if a window of one more does.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i+k-1], ' ')) AS h FROM d, (VALUES (3), ({LEAST}), ({MOST_REPEAT + 1})) ks(k), unnest(range(1, len(w) - k + 2)) t(i)),
r AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM g) x WHERE c > 1),
cov AS (SELECT doc_id, k, count(DISTINCT j) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS j FROM r) x GROUP BY 1, 2),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS cover, m.n IS NOT NULL AS long_repeat
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN cov c ON c.doc_id = d.doc_id AND c.k = 3
  LEFT JOIN cov l ON l.doc_id = d.doc_id AND l.k = {LEAST} LEFT JOIN cov m ON m.doc_id = d.doc_id AND m.k = {MOST_REPEAT + 1}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND cover <= {MOST_COVERED}::DOUBLE * n_words AND NOT long_repeat AS kept FROM f
"""
