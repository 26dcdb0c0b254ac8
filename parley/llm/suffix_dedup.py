"""Removal of long repeated substrings by suffix sorting.

Every window of WIDTH bytes has an anchor: of the K-byte strings in it the one of the least hash, the leftmost of equal
ones. Equal windows have equal anchors in equal places, so windows need comparing only where they share an anchor. Two round
trips between the corpus's units do that:

1. anchors: which of them stand in more than one document;
2. the windows of those, a run of neighbouring windows of one anchor being sent as one short text. Tasks sort the windows
   (suffixes of those texts, up to WIDTH bytes) by mergesort: prefix polynomial hashes and binary search find the common extension of two
   suffixes, so a comparison costs a logarithm of its length. Windows that the hashes call equal are compared byte by byte.

An anchor in many units (of a passage that very many documents share) is sent under keys that also hold the bytes to its
left or to its right, whichever side its windows reach further, so its windows part into many tasks; equal runs of one unit are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import new_folder
from parley.llm.exchange import ask, get, get_arrays, packed, put_arrays, store_units, told, unpacked
from parley.operators.components import materialize

WIDTH, K = 50, 20
SPAN = WIDTH - K + 1
HALF = SPAN // 2
#: An anchor in more units than this is sent under finer keys.
WIDE = 16
_CHUNK, _WINDOWS, _PAD, _UNIT = 1 << 18, 1 << 18, 128, 4 << 20
_PLACE = np.uint64((1 << 20) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 4096


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[3]
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int, step: int = 1) -> np.ndarray:
    out, factor, value = np.empty(n, np.uint64), pow(base, step, 1 << 64), 1
    for i in range(n):
        out[i] = value
        value = value * factor & (1 << 64) - 1
    return out


_LOW, _LOW_INVERSE = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


class Prefixes:
    """Prefix polynomial hashes modulo 2**64 of a byte array: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        blocks = len(data) // _STEP + 1
        terms = np.multiply.outer(_powers(_BASE, blocks, _STEP), _LOW).ravel()[: len(data)]
        terms *= data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.data, self.high = data, _powers(_INVERSE, blocks + 1, _STEP)

    def unit_of(self, at: np.ndarray) -> np.ndarray:
        return self.high[at // _STEP] * _LOW_INVERSE[at % _STEP]

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.unit_of(at)


def common(text: Prefixes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of suffixes at x and y, up to limit, by binary search on hashes."""
    sx, sy, ux, uy = text.sums[x], text.sums[y], text.unit_of(x), text.unit_of(y)
    low, high = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    for _ in range(limit.bit_length()):
        mid = (low + high + 1) >> 1
        same = (text.sums[x + mid] - sx) * ux == (text.sums[y + mid] - sy) * uy
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        high = np.maximum(low, high)
    return low


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray | int, most: int) -> np.ndarray:
    """Whether the substrings at x and y, of one length up to `most`, agree byte by byte."""
    out = np.ones(len(x), bool)
    step = np.arange(most)
    for i in range(0, len(x), 1 << 15):
        s = slice(i, i + (1 << 15))
        differ = data[x[s, None] + step] != data[y[s, None] + step]
        if not np.isscalar(length):
            differ &= step < length[s, None]
        out[s] = ~differ.any(axis=1)
    return out


def suffix_sort(text: Prefixes, at: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes `at` by their first `limit` bytes within groups of the given sizes: a bottom-up mergesort of all
    groups at once. Each run is merged with its neighbour by binary search, each comparison by `common`. Stable."""
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size, rank = np.repeat(sizes, sizes), np.arange(len(at)) - base
    order, run = np.arange(len(at)), 1
    active = np.flatnonzero(size > run)
    while len(active):
        q, b = rank[active], base[active]
        own_run = q // run
        partner = (own_run ^ 1) * run
        low, high = np.zeros(len(active), np.int64), np.clip(size[active] - partner, 0, run)
        me, odd = at[order[active]], own_run & 1 == 1
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            x, y = at[order[b[open_] + partner[open_] + mid]], me[open_]
            far = common(text, x, y, limit)
            cx, cy = text.data[x + np.minimum(far, limit - 1)], text.data[y + np.minimum(far, limit - 1)]
            before = np.where(far >= limit, odd[open_], cx < cy)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        moved = order.copy()
        moved[b + (own_run & ~1) * run + (q - own_run * run) + low] = order[active]
        order, run = moved, run * 2
        active = active[size[active] > run]
    return order


def window_classes(text: Prefixes, at: np.ndarray, sizes: np.ndarray, limit: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes in sorted order within their groups, and where a class of equal ones begins there.
    Equality is verified on the bytes; groups where a hash collided are ordered by their bytes instead."""
    order = suffix_sort(text, at, sizes, limit)
    group = np.repeat(np.arange(len(sizes)), sizes)
    first = np.ones(len(at), bool)
    near = np.flatnonzero(group[1:] == group[:-1])
    x, y = at[order[near]], at[order[near + 1]]
    equal = text.hashes(x, limit) == text.hashes(y, limit)
    first[near[equal] + 1] = False
    wrong = near[equal][~same_bytes(text.data, x[equal], y[equal], limit, limit)]
    starts = np.cumsum(sizes) - sizes
    for g in np.unique(group[wrong]).tolist():
        s = slice(int(starts[g]), int(starts[g] + sizes[g]))
        words = {int(i): text.data[at[i] : at[i] + limit].tobytes() for i in order[s]}
        order[s] = sorted(words, key=lambda i, w=words: (w[i], i))
        first[s] = [n == 0 or words[int(order[s][n])] != words[int(order[s][n - 1])] for n in range(int(sizes[g]))]
    return order, first


@dataclass
class Anchors:
    """Runs of neighbouring windows of one anchor: first window, windows, place and hash of the anchor."""

    lo: np.ndarray
    n: np.ndarray
    at: np.ndarray
    hash: np.ndarray


def anchors_of(data: np.ndarray, allowed: np.ndarray) -> Anchors:
    """The anchors of the windows that begin where `allowed`. data is padded by _PAD bytes. Chunk by chunk: a run may be cut where a chunk ends, which changes no window's anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    total = len(allowed)
    for c in range(0, total, _CHUNK):
        m = min(_CHUNK, total - c)
        need = m + SPAN - 1
        words = np.ascontiguousarray(np.ndarray((min(need + K, len(data) - c - 8),), "<u8", data, c, (1,)))
        words = np.pad(words, (0, need + K - len(words)))
        h = (words[:need] ^ (words[:need] >> np.uint64(29))) * _M[0]
        h += (words[8 : need + 8] ^ (words[8 : need + 8] >> np.uint64(32))) * _M[1]
        h ^= h >> np.uint64(30)
        h += words[K - 8 : need + K - 8] * _M[2]
        h = _stir(h)
        least, width = (h & ~_PLACE) | np.arange(need, dtype=np.uint64), 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:m], least[SPAN - width : SPAN - width + m]) & _PLACE
        ok = allowed[c : c + m]
        change = np.empty(m, bool)
        change[0] = True
        np.not_equal(least[1:], least[:-1], out=change[1:])
        change[1:] |= ~ok[:-1]
        begin = np.flatnonzero(change & ok)
        stop = np.flatnonzero(np.append(change[1:] | ~ok[1:], True) & ok)
        place = least[begin].astype(np.int64)
        found.append((begin + c, stop - begin + 1, place + c, _stir(h[place] + _M[2])))  # least hashes are small: spread them over all buckets
    if not found:
        empty = np.zeros(0, np.int64)
        return Anchors(empty, empty, empty, np.zeros(0, np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Unit:
    """A unit open for work: rows in ascending order of doc_id, their texts as one padded byte array."""

    def __init__(self, folder: str, unit: int):
        self.table = pa.ipc.open_stream(pa.BufferReader(get(folder, f"unit-{unit}"))).read_all()
        texts = [x or b"" for x in self.table.column("text").cast(pa.large_binary()).to_pylist()]
        self.length = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(self.length)
        self.begins = self.ends - self.length
        self.size = int(self.length.sum())
        self.data = np.frombuffer(b"".join(texts) + bytes(_PAD), np.uint8)
        ids = self.table.column("doc_id")
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)

    def anchors(self) -> Anchors:
        allowed = np.ones(self.size, bool)
        for begin, end, known in zip(self.begins.tolist(), self.ends.tolist(), self.known.tolist(), strict=True):
            allowed[max(begin, end - WIDTH + 1) if known else begin : end] = False
        return anchors_of(self.data, allowed)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right")]


def keep_sorted(table: pa.Table) -> bytes:
    table = table.sort_by([("doc_id", "ascending")])
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _distinct(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _anchor_keys(unit: Unit) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """Anchors, their order by hash and where each distinct hash begins in it."""
    found = unit.anchors()
    order = np.argsort(found.hash, kind="stable")
    return found, order, _distinct(found.hash[order])


def _merge_equal(text: Prefixes, ident: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): classes of equal ident and bytes, numbered in the order of ident; `order` sorts by ident, stable. Bytes are verified: what differs from the first of its ident stays alone."""
    order = np.argsort(ident, kind="stable")
    new = np.zeros(len(order), bool)
    starts = _distinct(ident[order])
    new[starts] = True
    leader = order[np.repeat(starts, np.diff(np.append(starts, len(order))))]
    check = np.flatnonzero(~new)
    new[check] = ~same_bytes(text.data, at[order[check]], at[leader[check]], length[order[check]], WIDTH + SPAN)
    return order, np.cumsum(new) - 1


def shared_runs(unit: Unit, codes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """What a unit sends in the second round. codes: of its distinct anchor hashes, 0 unless shared and 2 if in many units. Returns the
    runs (lo, n, item, later), and of each item the key and lo, n, anchor, doc; items are ascending by key."""
    found, order, starts = _anchor_keys(unit)
    code = np.zeros(len(order), np.uint32)
    code[order] = np.repeat(codes, np.diff(np.append(starts, len(order))))
    pick = code > 0
    lo, n, at, key, wide = found.lo[pick], found.n[pick], found.at[pick], found.hash[pick], code[pick] == 2
    # the windows of a wide anchor that reach HALF bytes to its left, and the others, which reach as far to its right
    left = np.clip(at - HALF - lo + 1, 0, n)
    words = np.ndarray((len(unit.data) - 8,), "<u8", unit.data, 0, (1,))
    parts = [(lo[~wide], n[~wide], at[~wide], key[~wide])]
    for side, (begin, count) in enumerate(((lo, left), (lo + left, n - left))):
        s = wide & (count > 0)
        a, b = (at[s] - HALF, at[s] - 8) if side == 0 else (at[s] + K, at[s] + K + SPAN - 1 - HALF - 8 + 1)
        parts.append((begin[s], count[s], at[s], _stir(key[s] + _stir(words[a] * _M[0] + np.uint64(side + 1)) + words[b] * _M[1])))
    lo, n, at, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_place = np.argsort(lo, kind="stable")
    lo, n, at, key = lo[by_place], n[by_place], at[by_place], key[by_place]
    text = Prefixes(unit.data)
    ident = _stir(key + text.hashes(lo, n + WIDTH - 1) * _M[0] + ((at - lo) * 64 + n).astype(np.uint64) * _M[1])
    order, cls = _merge_equal(text, ident, lo, n + WIDTH - 1)
    first = order[_distinct(cls)]
    by_key = np.argsort(key[first], kind="stable")
    number = np.empty(len(first), np.int64)
    number[by_key] = np.arange(len(first))
    item = np.empty(len(lo), np.int64)
    item[order] = number[cls]
    first = first[by_key]
    doc = unit.doc_of(lo)
    later = doc > doc[first][item]  # all its windows stand in an earlier row of this unit
    return {"lo": lo, "n": n, "item": item, "later": later}, key[first], {"lo": lo[first], "n": n[first], "at": at[first], "doc": doc[first]}


def repeated_windows(key: np.ndarray, doc: np.ndarray, n: np.ndarray, anchor: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each run (its text of n + WIDTH - 1 bytes in `data`, one after the other, padded by _PAD) a mask of those of
    its windows that a run of the same key and a smaller doc holds, too. anchor: place of the anchor in the run's text."""
    out = np.zeros(len(key), np.uint32)
    length = n + WIDTH - 1
    begin = np.cumsum(length) - length
    order = np.argsort(key, kind="stable")
    starts = _distinct(key[order])
    sizes = np.diff(np.append(starts, len(order)))
    pick = order[np.repeat(sizes > 1, sizes)]
    if not len(pick):
        return out
    text = Prefixes(data)
    ident = _stir(key[pick] + text.hashes(begin[pick], length[pick]) * _M[0] + (anchor[pick] * 64 + n[pick]).astype(np.uint64) * _M[1])
    by_ident, cls = _merge_equal(text, ident, begin[pick], length[pick])
    member = pick[by_ident]
    first = _distinct(cls)
    least = np.minimum.reduceat(doc[member], first)
    lead = member[first]
    mask = np.zeros(len(lead), np.uint32)
    # windows of the distinct runs, by key and place of the anchor in the window
    by_key = np.argsort(key[lead], kind="stable")
    key_starts = _distinct(key[lead][by_key])
    key_sizes = np.diff(np.append(key_starts, len(by_key)))
    key_of = np.empty(len(lead), np.int64)
    key_of[by_key] = np.repeat(np.arange(len(key_sizes)), key_sizes)
    many = by_key[np.repeat(key_sizes > 1, key_sizes)]
    ends = np.cumsum(n[lead[many]])
    group_end = np.append(np.flatnonzero(key_of[many][1:] != key_of[many][:-1]) + 1, len(many)) if len(many) else np.zeros(0, np.int64)
    at = 0
    while at < len(many):
        stop = int(group_end[min(len(group_end) - 1, np.searchsorted(ends[group_end - 1], (ends[at - 1] if at else 0) + _WINDOWS, "left"))])
        stop = max(stop, int(group_end[np.searchsorted(group_end, at, "right")]))
        own = many[at:stop]
        at = stop
        total = int(n[lead[own]].sum())
        # a key of very many runs is taken by the place of the anchor in the window
        for place in range(SPAN) if total > 2 * _WINDOWS else (None,):
            if place is None:
                count = n[lead[own]]
                run = np.repeat(own, count)
                j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            else:
                j = anchor[lead[own]] - place
                fits = (j >= 0) & (j < n[lead[own]])
                run, j = own[fits], j[fits]
            group = key_of[run] * 64 + anchor[lead[run]] - j
            order = np.argsort(group, kind="stable")
            heads = _distinct(group[order])
            sizes = np.diff(np.append(heads, len(order)))
            order = order[np.repeat(sizes > 1, sizes)]
            sizes = sizes[sizes > 1]
            if not len(order):
                continue
            run, j = run[order], j[order]
            ranked, new = window_classes(text, begin[lead[run]] + j, sizes)
            window_least = np.minimum.reduceat(least[run[ranked]], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = ranked[least[run[ranked]] > window_least]
            np.bitwise_or.at(mask, run[hit], np.uint32(1) << j[hit].astype(np.uint32))
    full = ((np.uint64(1) << n[member].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    out[member] = np.where(doc[member] > least[cls], full, mask[cls])
    return out


def _covered(unit: Unit, runs: dict[str, np.ndarray], masks: np.ndarray) -> np.ndarray:
    mask = np.where(runs["later"], np.uint32((1 << SPAN) - 1), masks[runs["item"]])
    hit = mask > 0
    lo, n, mask = runs["lo"][hit], runs["n"][hit], mask[hit]
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = (np.repeat(lo, n) + j)[np.repeat(mask, n) >> j.astype(np.uint32) & np.uint32(1) == 1]
    step = np.zeros(unit.size + 1, np.int32)
    step[start] += 1
    step[start + WIDTH] -= 1
    return np.cumsum(step)[:-1] > 0


def _find(docs: DataFrame, use, schema: str) -> DataFrame:
    """use(unit, covered bytes) -> batches, for each unit of `docs`."""
    spark = docs.sparkSession
    folder = new_folder(spark, "suffixes")
    units = store_units(docs, folder, keep_sorted, _UNIT)

    def anchors(unit: int) -> tuple[np.ndarray, list]:
        own = Unit(folder, unit)
        found, order, starts = _anchor_keys(own)
        last = starts + np.diff(np.append(starts, len(order))) - 1
        several = own.doc_of(found.lo[order[starts]]) != own.doc_of(found.lo[order[last]])
        return found.hash[order[starts]], [several]

    def shared(keys: np.ndarray, _: np.ndarray, values: list[list[bytes]]) -> np.ndarray:
        several = np.concatenate([unpacked(v[0], "?") for v in values])
        order = np.argsort(keys, kind="stable")
        starts = _distinct(keys[order])
        count = np.diff(np.append(starts, len(order)))
        code = ((count > 1) | np.logical_or.reduceat(several[order], starts)).astype(np.uint32) + (count > WIDE)
        out = np.empty(len(keys), np.uint32)
        out[order] = np.repeat(code, count)
        return out

    def noted(unit: int, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        runs, key, items = shared_runs(Unit(folder, unit), codes)
        put_arrays(folder, f"runs-{unit}", **runs)
        put_arrays(folder, f"items-{unit}", key=key, **items)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64())})

    def windows(unit: int) -> tuple[np.ndarray, list]:
        items = get_arrays(folder, f"items-{unit}")
        data = Unit(folder, unit).data.tobytes()
        spans = list(zip(items["lo"].tolist(), (items["lo"] + items["n"] + WIDTH - 1).tolist(), strict=True))
        texts = lambda a, b: packed(np.frombuffer(b"".join(data[x:y] for x, y in spans[a:b]), np.uint8))
        return items["key"], [items["doc"], items["n"].astype(np.uint8), (items["at"] - items["lo"]).astype(np.uint8), texts]

    def compared(keys: np.ndarray, _: np.ndarray, values: list[list[bytes]]) -> np.ndarray:
        doc, n, anchor = (np.concatenate([unpacked(v[i], kind) for v in values]) for i, kind in enumerate(("<i8", "u1", "u1")))
        data = np.concatenate([*(unpacked(v[3], "u1") for v in values), np.zeros(_PAD, np.uint8)])
        return repeated_windows(keys, doc, n.astype(np.int64), anchor.astype(np.int64), data)

    def finished(unit: int, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = Unit(folder, unit)
        yield from use(own, _covered(own, get_arrays(folder, f"runs-{unit}"), masks))

    ready = materialize(told(units, ask(units, anchors, shared), noted, "unit long"))
    return told(ready, ask(ready, windows, compared), finished, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for each row of `docs` (doc_id integer, text).

    A byte goes if a WIDTH-byte string over it also starts in a row of smaller doc_id, judged on the input. Null text is
    empty; rows without doc_id lose nothing and cost no other row a byte; rows of one doc_id don't count against each other; other columns are ignored; an empty table gives none.
    """

    def use(unit: Unit, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for i, (begin, end) in enumerate(zip(unit.begins.tolist(), unit.ends.tolist(), strict=True)):
            gone = covered[begin:end]
            n = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] > gone[:-1]).sum()) if n else 0
            rows.append((int(unit.ids[i]) if unit.known[i] else None, end - begin, n, spans, (unit.data[begin:end][~gone] if n else unit.data[begin:end]).tobytes()))
            held += end - begin
            if held >= 1 << 20 or i + 1 == len(unit.ids):
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                rows, held = [], 0

    return _find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), use, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs`, its columns and rows, with repeated passages cut out of `text`; a character goes if any of its bytes does. Nulls as for `repeats`; a null text stays null."""

    def use(unit: Unit, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, nulls = [], unit.table.column("text").is_null().to_pylist()
        for null, begin, end in zip(nulls, unit.begins.tolist(), unit.ends.tolist(), strict=True):
            own, gone = unit.data[begin:end], covered[begin:end]
            if gone.any():
                head = np.flatnonzero(own & 0xC0 != 0x80)  # first bytes of characters
                sizes = np.diff(np.append(head, len(own)))
                own = own[~np.repeat(np.logical_or.reduceat(gone, head), sizes)]
            texts.append(None if null else own.tobytes().decode())
        at = unit.table.schema.get_field_index("text")
        for batch in unit.table.set_column(at, unit.table.schema.field(at), pa.array(texts, unit.table.schema.field(at).type)).combine_chunks().to_batches(1000):
            yield batch

    return _find(docs, use, docs.schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
