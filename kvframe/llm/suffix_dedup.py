"""Suffix-array dedup: distributed prefix doubling over a sparse set of suffixes.

A string of LENGTH bytes repeats if its start's rank by LENGTH bytes is not its own. Ranking all positions of a corpus
would take many times the input on disk, so three steps leave ever fewer to the next.

1. Anchors. Every start p has one anchor, the suffix inside p's LENGTH bytes whose first LENGTH / 4 bytes have the
   least hash, so equal strings have their anchors at the same place in them. Starts of one anchor form a stretch. If
   no other anchor has its hash, no string of the stretch repeats; if the text of the whole stretch occurs again
   (by its 128-bit digest), all do. Of each such text one stretch goes on if others of the same anchor do.
2. Doubling. In the stretches that go on, the suffixes on a grid of some bytes, aligned to the anchor, are ranked: first
   by the bytes up to the next grid point, then by the pairs of ranks at offsets of 1, 2, 4 ... grid steps. In each
   round Spark deals the pairs out by range, each range is sorted, and the place of a pair in this order is the new
   rank, so ranks order the suffixes by their first bytes. Suffixes of a rank of their own drop out; the rounds end
   past the threshold. Then a pair of the last ranks stands for the bytes that all starts between two grid points share
   (nothing repeats if these do not) and another for all bytes of their strings (all repeat if these do).
3. Starts. What is left is near the ends of repeats; these starts are compared one by one, by 128-bit digests.

Null and empty texts have no bytes. Repeated rows repeat each other's strings. Extra columns are ignored. A very long
text is read whole, as a block of its own; memory goes with the longest text, some 50 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import text
from .shared import Scratch, input_bytes, small_enough

LENGTH = 400
#: Bytes of text in a block; a byte takes some 100 while its anchor is found.
BLOCK_BYTES = 1 << 19
#: Low bits of a sort key that hold a place, so that the leftmost of equal hashes is least.
PLACE_BITS = 24
SEGMENT = 1 << 22
_FLAGS = 10  # a stretch has fewer starts than 2**9, and one bit says whether it is open
#: Pairs for each range of a round; at most, where a block has few pairs for so many ranges; sampled pairs for each range, from which the bounds come; ranges at most.
RANGE_PAIRS, MOST_PAIRS, SAMPLE, MOST_RANGES = 1 << 15, 1 << 22, 16, 1 << 17


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchor_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every `width` consecutive hashes the place of the least, leftmost of equal ones."""
    out = np.empty(len(hashes) - width + 1, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(out), SEGMENT):
        part = hashes[at : at + SEGMENT + width - 1]
        least = sliding_least(part & ~low | np.arange(len(part), dtype=np.uint64), width)[:SEGMENT]
        out[at : at + len(least)] = (least & low).astype(np.int64) + at
    return out


def _anchors(block: text.Block, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash of the length // 4 bytes at each place of a block, and the anchor of each start (those of strings across rows mean nothing)."""
    if len(block.buf) < length:
        return None
    gram = length // 4
    hashes = text.SpanHash(block.buf).rolling(gram, len(block.buf) - gram + 1)
    return hashes, anchor_places(hashes, length - gram + 1)


# -- step 1: anchors ---------------------------------------------------------------------------------------------------


def stretches(length: int):
    """Records: hash of the anchor's bytes, digest of the stretch's text (two numbers), its starts less one, its place."""

    def records(block: text.Block):
        found = _anchors(block, length)
        if found is None:
            return None
        hashes, anchor = found
        ends = block.start + np.append(block.size, 0)
        row = np.repeat(np.arange(len(block)), block.size + 1)[: len(anchor)]
        fits = np.arange(len(anchor)) + length <= ends[row]
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh & fits)
        if not len(first):
            return None
        stop = np.append(np.flatnonzero(fresh), len(anchor))  # a stretch ends where the next begins or the text is too short
        last = np.minimum(stop[np.searchsorted(stop, first, "right")] - 1, ends[row[first]] - length)
        exact = text.digests(block.joined, first, last + length)
        return [hashes[anchor[first]], exact[:, 0], exact[:, 1], last - first, first], block.start

    return records


def pick_stretches(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Fields: hash, digest, starts less one, whether it stands for several, place.) Stretches whose anchor occurs again; the answer's low bits: starts less one, whether its text occurs again, whether it goes on."""
    hashes, one, two, starts, several, place = fields
    order, fresh = ex.classes(hashes, [one, two])
    own = hashes[order]
    head = np.ones(len(order), bool)
    head[1:] = own[1:] != own[:-1]
    group, alike = np.cumsum(head) - 1, np.cumsum(fresh) - 1
    weight = 1.0 + several[order]
    repeated = np.bincount(group, weight)[group] > 1
    past = np.bincount(alike, weight)[alike] > 1
    open_ = repeated & ~past
    onward = open_ | fresh & (np.bincount(group, open_)[group] > 0)
    flags, answers = np.zeros(len(order), bool), np.zeros(len(order), np.uint64)
    flags[order] = repeated
    answers[order] = place[order] << np.uint64(_FLAGS + 1) | starts[order] << np.uint64(2) | past.astype(np.uint64) << np.uint64(1) | onward.astype(np.uint64)
    return flags, answers


def stretch_spans(answers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first start, last start, whether they go on: runs of starts whose strings repeat, and the stretches that go on."""
    place = answers >> (_FLAGS + 1)
    last = place + (answers >> 2 & (1 << (_FLAGS - 1)) - 1)
    row, past, onward = ex.owners(place, first), (answers & 2) > 0, (answers & 1) > 0
    fresh = np.ones(int(past.sum()), bool)
    fresh[1:] = (row[past][1:] != row[past][:-1]) | (place[past][1:] > last[past][:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(fresh))[: len(begin)] - 1
    owner = np.concatenate([row[past][begin], row[onward]])
    spans = np.stack([np.concatenate([place[past][begin], place[onward]]), np.concatenate([last[past][end], last[onward]]), np.repeat([0, 1], [len(begin), int(onward.sum())])], 1)
    spans[:, :2] -= first[owner][:, None]
    order = np.argsort(owner, kind="stable")
    return owner[order], spans[order].astype(np.int32)


def divided(length: int, onward: bool):
    """mapInArrow function on stretches by key: the starts of those that go on, or the spans (start, end) of those that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("spans").to_pylist():
                spans = ex.span_list(data, 3)
                spans = spans[spans[:, 2] == onward][:, :2]
                out.append((spans + np.array([0, 0 if onward else length])).astype(np.int32).tobytes())
            kept = pa.array([bool(x) for x in out], pa.bool_())
            yield pa.record_batch([batch.column("key_id"), batch.column("key_text"), pa.array(out, pa.binary())], names=["key_id", "key_text", "spans"]).filter(kept)

    return run


# -- step 2: doubling --------------------------------------------------------------------------------------------------


class Ladder:
    """The grid and the rounds of a length: strings of `grid` bytes first, `top` bytes last, then `core` and `cover`."""

    def __init__(self, length: int):
        self.length = length
        self.grid = 1
        while 2 * self.grid <= length // 12:
            self.grid *= 2
        self.core = (length - self.grid + 1) // self.grid * self.grid
        self.cover = self.grid + -(-length // self.grid) * self.grid
        self.top = self.grid
        while 2 * self.top <= self.core:
            self.top *= 2
        self.gap = 1 << (2 * length).bit_length()  # between the regions of a block, so that no offset leads from one into the next

    def offsets(self, width: int) -> list[int]:
        """Where strings of `top` bytes begin that together make up `width` bytes."""
        return [*range(0, width - self.top, self.top), width - self.top]


def unique_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows in order, whether each occurs more than once, and for each given row its place among them."""
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    return [c[order[begin]] for c in columns], np.diff(np.append(begin, len(order))) > 1, where


def _state(name: int, places: np.ndarray, columns: list[np.ndarray]) -> dict:
    """A block's row in a round: its suffixes' places with the number of each one's pair, and the pairs in order."""
    distinct, several, where = unique_rows(columns)
    return {"block": name, "state": ex.pack([places, where]), "records": ex.pack([*distinct, several]), "n": len(several)}


_STATE = "block long, state binary, records binary, n long"
_STATE_SCHEMA = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("records", pa.binary()), ("n", pa.int64())])


def grid_words(body: np.ndarray, at: np.ndarray, grid: int) -> list[np.ndarray]:
    """The `grid` bytes at each place as big-endian numbers, which order like the bytes."""
    wide = np.zeros((len(at), -(-grid // 8) * 8), np.uint8)
    wide[:, :grid] = body[at[:, None] + np.arange(grid)]
    return list(wide.view(">u8").astype(np.uint64).T)


def regions(ladder: Ladder):
    """mapInArrow function: the parts of texts that go on, a row for each block; places have a gap after each region."""
    names = ["block", "state", "records", "n", "rows", "parts", "open", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, grid = TaskContext.get().partitionId(), 0, ladder.grid
        for block in text.blocks(batches, BLOCK_BYTES):
            _, anchor = _anchors(block, ladder.length)
            parts, open_, body, grids, at = [], [], [], [], 0
            for r, raw in enumerate(block.texts):
                spans = ex.span_list(block.columns["spans"][r])
                spans = spans[np.argsort(spans[:, 0])]
                low, high = np.maximum(0, spans[:, 0] - grid), np.minimum(len(raw), spans[:, 1] + ladder.length + grid)
                fresh = np.ones(len(spans), bool)
                fresh[1:] = low[1:] > np.maximum.accumulate(high)[:-1]
                which = np.cumsum(fresh) - 1
                begin = low[fresh]
                end = np.maximum.reduceat(high, np.flatnonzero(fresh))
                shift = at + np.concatenate([[0], np.cumsum(end - begin + ladder.gap)[:-1]]) - begin
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    body += [raw[b:e], bytes(ladder.gap)]
                parts.append(np.stack([np.full(len(begin), r), begin, begin + shift], 1))
                phase = (anchor[spans[:, 0] + block.start[r]] - block.start[r] - low) % grid
                open_.append(np.stack([spans[:, 0] + shift[which], spans[:, 1] + shift[which], low + phase + shift[which]], 1))
                steps = np.maximum(0, (high - grid - low - phase) // grid + 1)
                grids.append(text.ranges(np.zeros(len(spans), np.int64), steps) * grid + np.repeat(low + phase + shift[which], steps))
                at += int((end - begin).sum()) + ladder.gap * len(begin)
            whole = np.frombuffer(b"".join(body), np.uint8)
            places = np.unique(np.concatenate(grids))
            name = (part << 32) | count
            count += 1
            row = _state(name, places, grid_words(whole, places, grid))
            keys = [np.array(block.columns[n], np.int64).view(np.uint64) for n in ("key_id", "key_text")]
            row |= {"rows": ex.pack([*keys, block.size]), "parts": ex.pack(list(np.concatenate(parts).T)), "open": ex.pack(list(np.concatenate(open_).T)), "body": whole.tobytes()}
            yield pa.record_batch([pa.array([row[n]], pa.int64() if n in ("block", "n") else pa.binary()) for n in names], names=names)

    return run


_REGIONS = _STATE + ", rows binary, parts binary, open binary, body binary"


def _as_bytes(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers as strings of bytes of the same order."""
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def range_bounds(table: DataFrame, columns: int, lead: int) -> np.ndarray:
    """Bounds of the first `lead` numbers between ranges of about RANGE_PAIRS pairs, from a sample of SAMPLE pairs for each range. Any bounds give the same classes."""
    pairs, blocks = (int(x or 0) for x in table.agg(F.sum("n"), F.count("*")).first())
    fits = max(64, pairs // max(1, 4 * blocks))  # so many ranges get some pairs of a block
    count = max(1, min(MOST_RANGES, max(min(-(-pairs // RANGE_PAIRS), fits), -(-pairs // MOST_PAIRS))))
    least = min((1 << 64) - 1, SAMPLE * count * (1 << 64) // max(1, pairs))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, f"S{8 * lead}")]
            for data in batch.column("records").to_pylist():
                rows = ex.unpack(data, columns + 1)[:lead]
                mixed = rows[0]
                for c in rows[1:]:
                    mixed = text.mix(mixed) + c
                found.append(_as_bytes([c[text.mix(mixed) <= np.uint64(least)] for c in rows]))
            yield pa.record_batch([pa.array([x.ljust(8 * lead, b"\0") for x in np.concatenate(found).tolist()], pa.binary())], names=["pair"])

    if count == 1:
        return np.zeros(0, f"S{8 * lead}")
    drawn = np.sort(np.array(table.select("records").mapInArrow(sample, "pair binary").toArrow().column("pair").to_pylist(), f"S{8 * lead}"))
    return np.unique(drawn[np.arange(1, count) * len(drawn) // count]) if len(drawn) else drawn


def deal(bounds: np.ndarray, columns: int, lead: int):
    """mapInArrow function: each block's pairs, in order, to the ranges they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("block").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows = ex.unpack(data, columns + 1)
                cut = np.concatenate([[0], np.searchsorted(_as_bytes(rows[:lead]), bounds), [len(rows[0])]])
                held = np.flatnonzero(np.diff(cut)).tolist()
                values = [ex.pack([x[cut[k] : cut[k + 1]] for x in rows]) for k in held]
                yield pa.record_batch([pa.array(held, pa.int32()), pa.array([name] * len(held), pa.int64()), pa.array(values, pa.binary())], schema=ex.PACKED)
            text.release()

    return run


def new_ranks(bucket: int, rows: list[np.ndarray], several: np.ndarray) -> np.ndarray:
    """The rank of each pair of a range: its place in their order, 0 if it occurs once."""
    _, often, where = unique_rows(rows)
    often |= np.bincount(where, several, len(often)) > 0
    ranks = (np.uint64(bucket) << np.uint64(32)) + np.arange(1, len(often) + 1, dtype=np.uint64)
    return np.where(often, ranks, np.uint64(0))[where]


#: What becomes of the starts between two grid points: none repeats, all do, to be compared, all do and one of them stands for it.
NONE, ALL, OPEN, BOTH = 0, 1, 2, 3


def verdicts(core: int):
    """The same for the last round's rows, of which the first `core` numbers are the core's, the others, if not 0, the cover's, and the last says which starts wait for the verdict.

    Of equal covers one row for each set of starts stands for all: another stretch's grid may pass where a row's own starts do not go on.
    """

    def judge(bucket: int, rows: list[np.ndarray], several: np.ndarray) -> np.ndarray:
        waits = rows[-1] > 0
        _, often, group = unique_rows(rows[:core])
        distinct, alike_often, alike = unique_rows(rows[:-1])
        repeated = (often | (np.bincount(group, several, len(often)) > 0))[group]
        known = np.all([c > 0 for c in distinct[core:]], axis=0)
        past = (known & (alike_often | (np.bincount(alike, several, len(known)) > 0)))[alike]
        left = repeated & ~past
        stands = np.zeros(len(alike), bool)
        stands[np.unique(unique_rows(rows)[2], return_index=True)[1]] = True
        stands &= past & waits & (np.bincount(group, left & waits, len(often)) > 0)[group]
        return (past * ALL + left * OPEN + stands * (BOTH - ALL)).astype(np.uint64)

    return judge


def rank_range(columns: int, rank: Callable):
    """applyInArrow function for a range: sorts its pairs and answers each block with their ranks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [ex.unpack(x, columns + 1) for x in table.column("data").to_pylist()]
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        *rows, several = [np.concatenate(x) for x in zip(*parts, strict=True)]
        given = rank(key[0].as_py(), rows, several)
        values = [ex.pack([given[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        del parts, rows, given
        text.release()
        return pa.table([pa.array([key[0].as_py()] * len(values), pa.int32()), table.column("block"), pa.array(values, pa.binary())], schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))

    return run


def answered(state: pa.Table, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of a block whose suffix shares its rank, ascending, and the ranks."""
    places, where = (x.astype(np.int64) for x in ex.unpack(state.column("state")[0].as_py(), 2))
    order = np.argsort(back.column("bucket").to_numpy())
    data = back.column("data").to_pylist()
    ranks = np.concatenate([np.zeros(0, np.uint64), *(ex.unpack(data[k], 1)[0] for k in order)])[where]
    return places[ranks > 0], ranks[ranks > 0]


def ranks_at(places: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ranks of the suffixes at other places, 0 where there is none."""
    k = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return np.where(places[k] == at, ranks[k], np.uint64(0)) if len(places) else np.zeros(len(at), np.uint64)


def pairs_of(places: np.ndarray, ranks: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places whose suffixes have a shared rank at all offsets, and these ranks."""
    found = [ranks_at(places, ranks, places + k) for k in offsets]
    whole = np.all([x > 0 for x in found], axis=0) if len(places) else np.zeros(0, bool)
    return places[whole], [x[whole] for x in found]


def next_round(offset: int):
    """cogroup function of a block's state and ranks: the next round's state, pairs at `offset`."""

    def run(key: tuple, state: pa.Table, back: pa.Table) -> pa.Table:
        text.release()
        if not state.num_rows or not back.num_rows:
            return _STATE_SCHEMA.empty_table()
        places, columns = pairs_of(*answered(state, back), [0, offset])
        rows = [_state(key[0].as_py(), places, columns)] if len(places) else []
        return pa.Table.from_pylist(rows, _STATE_SCHEMA)

    return run


def open_starts(data: bytes, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of a block's stretches, and for each the stretch's first grid point that is not before it."""
    open_ = np.stack([x.astype(np.int64) for x in ex.unpack(data, 3)], 1)
    many = open_[:, 1] - open_[:, 0] + 1
    starts = text.ranges(open_[:, 0], many)
    return starts, starts + (np.repeat(open_[:, 2], many) - starts) % grid


def waiting(places: np.ndarray, starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each place, ascending, which starts look there: bit k for the one k bytes before it."""
    found = np.zeros(len(places), np.uint64)
    k = np.searchsorted(places, after)
    held = np.flatnonzero(k < len(places))
    held = held[places[k[held]] == after[held]]
    np.bitwise_or.at(found, k[held], np.uint64(1) << (after - starts)[held].astype(np.uint64))
    return found


def cells(ladder: Ladder):
    """cogroup function of a block's starts (joined to its state) and ranks: the last round, at each grid point with a shared core the core's ranks, those of the cover that begins a step before it, and which starts wait there."""
    core, cover = ladder.offsets(ladder.core), [k - ladder.grid for k in ladder.offsets(ladder.cover)]

    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        text.release()
        state = table.filter(pc.is_valid(table.column("state")))
        if not state.num_rows or not back.num_rows:
            return _STATE_SCHEMA.empty_table()
        places, ranks = answered(state, back)
        at, columns = pairs_of(places, ranks, core)
        wide = [ranks_at(places, ranks, at + k) for k in cover]
        whole = np.all([x > 0 for x in wide], axis=0)
        columns += [np.where(whole, x, np.uint64(0)) for x in wide]
        columns.append(waiting(at, *open_starts(table.column("open").drop_null()[0].as_py(), ladder.grid)))
        return pa.Table.from_pylist([_state(key[0].as_py(), at, columns)] if len(at) else [], _STATE_SCHEMA)

    return run


_LEFT = pa.schema([("block", pa.int64()), ("key_id", pa.int64()), ("key_text", pa.int64()), ("spans", pa.binary()), ("listed", pa.binary()), ("records", pa.binary())])


def _text_places(at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row's text of places in a block's regions."""
    k = np.searchsorted(parts[:, 2], at, "right") - 1
    return parts[k, 0], at - parts[k, 2] + parts[k, 1]


def resolve(ladder: Ladder):
    """cogroup function of a block's regions with the last ranks (joined to their state): spans of strings that repeat, and records of the starts that are left."""

    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        text.release()
        held = [r for r in table.to_pylist() if r["body"] is not None]
        last = table.filter(pc.is_null(table.column("body")))
        if not held or not last.num_rows or not back.num_rows:
            return _LEFT.empty_table()
        own, length = held[0], ladder.length
        cell, verdict = answered(last, back)
        parts = np.stack([x.astype(np.int64) for x in ex.unpack(own["parts"], 3)], 1)
        starts, after = open_starts(own["open"], ladder.grid)
        said = ranks_at(cell, verdict, after)
        done, left = np.unique(starts[(said == ALL) | (said == BOTH)]), np.unique(starts[(said == OPEN) | (said == BOTH)])
        ids, texts, size = (x.view(np.int64) for x in ex.unpack(own["rows"], 3))
        out = []
        if len(done):
            row, place = _text_places(done, parts)
            base = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
            owner, spans = ex.covering(length)(base[row] + place, base)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.append({"block": None, "key_id": int(ids[owner[a]]), "key_text": int(texts[owner[a]]), "spans": spans[a:b].tobytes(), "listed": None, "records": None})
        if len(left):
            row, place = _text_places(left, parts)
            base = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
            exact = text.digests(own["body"], left, left + length)
            listed = ex.pack([ids.view(np.uint64), texts.view(np.uint64), base[:-1]])
            out.append({"block": key[0].as_py(), "key_id": None, "key_text": None, "spans": None, "listed": listed, "records": ex.pack([exact[:, 0], exact[:, 1], base[row] + place])})
        return pa.Table.from_pylist(out, _LEFT)

    return run


def ranked(table: DataFrame, columns: int, lead: int = 0, rank: Callable = new_ranks) -> DataFrame:
    """bucket, block, data: what `rank` says of a round's pairs (block, records, n), dealt out by their first `lead` numbers, or all."""
    lead = lead or columns
    dealt = table.select("block", "records").mapInArrow(deal(range_bounds(table, columns, lead), columns, lead), "bucket int, block long, data binary")
    return dealt.groupBy("bucket").applyInArrow(rank_range(columns, rank), "bucket int, block long, data binary")


def doubled(first: DataFrame, ladder: Ladder, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The last state (cores and covers) of the regions' suffixes, and the verdicts on its rows."""
    held, columns, width, name = first, -(-ladder.grid // 8), ladder.grid, ""
    while True:
        back = ranked(held, columns)
        step: Callable = next_round(width) if width < ladder.top else cells(ladder)
        own = held.select("block", "state")
        if width == ladder.top:
            own = first.select("block", "open").unionByName(own, allowMissingColumns=True)
        new = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(step, _STATE)
        new = scratch.keep(new, f"round{width}")
        if name:
            scratch.drop(name)
        held, columns, name = new, 2, f"round{width}"
        if width == ladder.top:
            core = len(ladder.offsets(ladder.core))
            return held, ranked(held, core + len(ladder.offsets(ladder.cover)) + 1, core, verdicts(core))
        width *= 2


# -- step 3: starts ----------------------------------------------------------------------------------------------------


def _send_starts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed, data in zip(*(batch.column(c).to_pylist() for c in ("block", "listed", "records")), strict=True):
                yield ex.parcel(name, ex.unpack(data, 3), listed, bits)

    return run


def pick_repeated(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records that occur again; the last fields are whether one stands for several, and the place."""
    order, fresh = ex.classes(fields[0], fields[1:-2])
    alike = np.cumsum(fresh) - 1
    flags = np.zeros(len(order), bool)
    flags[order] = np.bincount(alike, 1.0 + fields[-2][order])[alike] > 1
    return flags, fields[-1]


def remove_spans(digest: bool):
    """mapInArrow function that leaves out the bytes of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches):
            gone, count, kept = [], [], []
            for r, raw in enumerate(block.texts):
                found = ex.span_list(block.columns["spans"][r])
                if not len(found):
                    begin = np.zeros(0, np.int64)
                    cover, rest = begin, raw
                else:
                    cover = text.covered(len(raw), found[:, 0], found[:, 1])
                    begin = text.runs(cover)[0]
                    rest = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                gone.append(int(cover.sum()))
                count.append(len(begin))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            out = [pa.array(block.columns["doc_id"], pa.int64()), pa.array(block.size), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.record_batch(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of `docs`; `length` is a multiple of 4 from 24 to 680.

    With `digest`, kept_sha256 (lowercase hex) stands in place of kept.
    """
    rows, scratch, ladder = ex.keyed(docs), Scratch(docs.sparkSession, "suffix"), Ladder(length)
    bits = ex.bucket_bits(input_bytes(docs), 7)
    held = scratch.keep(ex.exchange(rows, ex.sender(stretches(length), bits - 1, BLOCK_BYTES), 6, pick_stretches, stretch_spans, _FLAGS + 1), "stretches")
    kinds = "key_id long, key_text long, spans binary"
    onward = scratch.keep(held.mapInArrow(divided(length, True), kinds), "onward")
    found = rows.join(small_enough(onward, scratch.bytes("onward")), ["key_id", "key_text"])
    first = scratch.keep(found.mapInArrow(regions(ladder), _REGIONS), "regions")
    last, back = doubled(first, ladder, scratch)
    own = first.select("block", "rows", "parts", "open", "body").unionByName(last.select("block", "state"), allowMissingColumns=True)
    left = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(resolve(ladder), "block long, key_id long, key_text long, spans binary, listed binary, records binary")
    left = scratch.keep(left, "left")
    starts = left.where("records IS NOT NULL").select("block", "listed", "records")
    compared = ex.exchange(starts, _send_starts(max(6, bits - 2)), 4, pick_repeated, ex.covering(length))
    settled = left.where("spans IS NOT NULL").select("key_id", "key_text", "spans").unionByName(held.mapInArrow(divided(length, False), kinds))
    spans = scratch.keep(ex.merged(compared.unionByName(settled)), "found")
    full = ex.with_spans(rows, spans, scratch.bytes("found"))
    return full.mapInArrow(remove_spans(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")


#: The digest form over `documents` in DuckDB, string by string, as hexadecimal digits; texts are cut into overlapping pieces first.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j * 512 AS base, substr(h, 1024 * j + 1, 2 * 911) AS p FROM d, unnest(range(0, length(h) // 1024 + 1)) t(j)),
s AS (SELECT doc_id, base + i AS i, md5(substr(p, 2 * i + 1, 800)) AS g FROM c, unnest(range(0, least(512, length(p) // 2 - 399))) t(i)),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s WHERE g IN (SELECT g FROM m)),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d) x),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS rest FROM d JOIN ends ON ends.doc_id = d.doc_id GROUP BY d.doc_id),
n AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
