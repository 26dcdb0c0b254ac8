"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and components.

Search. Two fingerprints of at most three differing bits agree in one of four 16-bit blocks, so each distinct
fingerprint goes to four groups, one a block. A group that is still large is split the same way on the bits it leaves
open (four blocks of the remaining 48, then of the remaining 36): again one block must agree, so no link is lost and no
group of many fingerprints meets in one task unless they agree in 37 bits, of which there are 2**27 at most. Tasks sort their groups by the Gray rank
of the fingerprint and build a hierarchy over that order: a node holds the bits that all its members share (mask and
pattern) less those its parent holds. A search adds up differing bits from the root down and leaves a whole subtree as
soon as the sum passes the limit. Only a spanning forest of a task's links goes on, so a dense group of m fingerprints yields m-1 links, not m*m.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import minhash
from parley.llm.common import partitions
from parley.operators.components import connected_components, materialize

BITS, LIMIT, FAN, LARGE, FRONTIER, AT_ONCE = 64, 3, 8, 4096, 1 << 20, 1 << 17
_ONE = np.uint64(1)


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of each row's whole text; null and empty text have fingerprint 0. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over the codes of several groups, each group's codes in Gray order. groups: ascending ids."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.codes, self.order = codes[order], order
        group = groups[order]
        ones, zeros = self.codes, ~self.codes
        self.levels = []  # from the leaves: (shared ones, shared zeros, first child, number of children), then group by group one root
        first, count = np.arange(len(codes)), np.ones(len(codes), np.int64)
        self.levels.append((ones, zeros, first, count))
        while True:
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(group)))
            if len(sizes) == 0 or sizes.max() == 1:
                break
            within = np.arange(len(group)) - np.repeat(starts, sizes)
            first = np.flatnonzero(within % FAN == 0)
            count = np.diff(np.append(first, len(group)))
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            group = group[first]
            self.levels.append((ones, zeros, first, count))
        self.root_of = np.searchsorted(group, groups[order])  # root of each code's own group
        # a child's new bits: what it shares beyond its parent
        self.fresh = []
        for level, (own, none, _, _) in enumerate(self.levels):
            mask = own | none
            if level + 1 < len(self.levels):
                up, un, _, n = self.levels[level + 1]
                mask = mask & ~np.repeat(up | un, n)
            self.fresh.append(mask)

    def links(self, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links among the codes: positions in the given order, and their roots' positions."""
        n = len(self.codes)
        parent = np.arange(n)
        top = len(self.levels) - 1
        stack = [(top, np.arange(i, min(n, i + (1 << 14))), self.root_of[i : i + (1 << 14)], np.zeros(min(n, i + (1 << 14)) - i, np.uint8)) for i in range(0, n, 1 << 14)]
        while stack:
            level, query, node, far = stack.pop()
            far = far + np.bitwise_count((self.codes[query] ^ self.levels[level][0][node]) & self.fresh[level][node])
            near = far <= limit
            query, node, far = query[near], node[near], far[near]
            if level == 0:
                self._unite(parent, query[node > query], node[node > query])
                continue
            first, count = self.levels[level][2][node], self.levels[level][3][node]
            total = np.cumsum(count)
            cuts = np.searchsorted(total, np.arange(FRONTIER, (total[-1] if len(total) else 0) + FRONTIER, FRONTIER), "left")
            lo = 0
            for hi in np.minimum(cuts + 1, len(count)).tolist():
                if hi > lo:
                    c = count[lo:hi]
                    child = np.repeat(first[lo:hi] - np.cumsum(c) + c, c) + np.arange(c.sum())
                    stack.append((level - 1, np.repeat(query[lo:hi], c), child, np.repeat(far[lo:hi], c)))
                    lo = hi
        moved = np.flatnonzero(parent != np.arange(n))
        return self.order[moved], self.order[parent[moved]]

    @staticmethod
    def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Hook roots to smaller roots until both ends of every pair have one root."""
        while len(a):
            x, y = parent[a], parent[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    size = -(-len(free) // parts)
    return [free[i : i + size] for i in range(0, len(free), size)]


def _grouped(codes: DataFrame, large: int) -> DataFrame:
    """fp and key: the groups in which each distinct fingerprint is searched. Splits groups of over `large` rows, at most twice."""

    def keyed(df: DataFrame, free: list[int], tag: str) -> DataFrame:
        masks = [(reduce(lambda m, bit: m | 1 << bit, block, 0), i) for i, block in enumerate(_blocks(free, LIMIT + 1))]
        keys = [F.concat(tag, F.lit(f"/{i}:"), F.hex(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))) for m, i in masks]
        return df.select("fp", F.posexplode(F.array(*keys)).alias("block", "key"))

    level = keyed(codes, list(range(BITS)), F.lit(""))
    out, free = [], {(): list(range(BITS))}
    for depth in range(3):
        level = level.withColumn("path", F.col("block").cast("string") if depth == 0 else F.concat_ws(".", "path", "block"))
        if depth == 2:
            out.append(level.select("fp", "key"))
            break
        hot = level.groupBy("key").count().where(F.col("count") > large).select("key")
        hot = materialize(hot)
        if hot.isEmpty():
            out.append(level.select("fp", "key"))
            break
        out.append(level.join(hot, "key", "left_anti").select("fp", "key"))
        rest = level.join(hot, "key")
        nexts, spans = [], {}
        for path, bits in free.items():
            for i, block in enumerate(_blocks(bits, LIMIT + 1)):
                own = [b for b in bits if b not in block]
                spans[(*path, i)] = own
                nexts.append(keyed(rest.where(F.col("path") == ".".join(map(str, (*path, i)))), own, F.col("key")).withColumn("path", F.lit(".".join(map(str, (*path, i))))))
        free = spans
        level = reduce(DataFrame.unionByName, nexts)
    return reduce(DataFrame.unionByName, out)


def near_links(codes: DataFrame, large: int = LARGE) -> DataFrame:
    """a, b: links that connect exactly the distinct fingerprints `fp` joined by chains of at most LIMIT differing bits a step."""

    def linked(fps: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        groups = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        a, b = GrayIndex(fps, groups).links()
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups of about AT_ONCE rows together are in memory at a time."""
        fps, keys = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(keys) >= AT_ONCE and len(ends):
                yield linked(fps[: ends[-1]], keys[: ends[-1]])
                fps, keys = fps[ends[-1] :], keys[ends[-1] :]
        if len(keys):
            yield linked(fps, keys)

    grouped = _grouped(codes, large).withColumn("key", F.xxhash64("key"))
    return grouped.repartition(4 * partitions(codes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) for each row of `docs`. Equal fingerprints, the zero one
    of empty texts among them, always link. Rows with a null doc_id get the least known doc_id of their group, or null; an empty table gives none."""
    fps = materialize(fingerprints(docs))
    by_code = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_code = materialize(by_code)
    roots = connected_components(near_links(by_code.select("fp"))).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = by_code.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that lead their group: those whose doc_id is the least of it. Groups join rows of near
    fingerprints and rows of alike shingle sets, as near copies often differ in more than LIMIT bits. doc_id must be unique; rows without one stay."""
    known = docs.where("doc_id is not null")
    fps = materialize(fingerprints(known))
    by_code = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    leads = materialize(fps.join(by_code, "fp").select("doc_id", "least"))
    one, two = (by_code.select(F.col("fp").alias(k), F.col("least").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    near = near_links(by_code.select("fp")).join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # rows of one fingerprint stand as the first of them, so that a group of copies is no node with as many edges
    to = lambda c: leads.select(F.col("doc_id").alias(c), F.col("least").alias(f"{c}_least"))
    alike = minhash.links(known).join(to("a"), "a").select(F.col("a_least").alias("a"), "b").distinct().join(to("b"), "b").select("a", F.col("b_least").alias("b")).where("a <> b")
    joined = connected_components(near.unionByName(alike)).where("component < node").select(F.col("node").alias("doc_id"))
    later = leads.where("least < doc_id").select("doc_id").unionByName(joined)
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
