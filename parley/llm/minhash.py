"""Links between texts whose sets of five-word shingles are alike, found by MinHash bands and checked exactly.

Texts of equal shingle sets share one sketch. A sketch has BANDS keys, each of ROWS minima; texts of similarity s share
a key with probability 1 - (1 - s^ROWS)^BANDS: at the least similarity of 0.8, 26 in a million are missed. A byte of each of the BANDS * ROWS minima goes along, and pairs that agree in
fewer than AGREE of them go no further: at 0.8 less than one in a million agrees in so few, at 0.4 three in a thousand in as many. Every other pair that
shares a key is checked on its whole texts, but for pairs that checked links join already.

A first round checks each text against the one of its key that shares most keys with others, which in a group of near copies is mostly their original. In a second round the texts of a key
that are still in different groups meet in blocks of CELL, once with their codes to find those that have a likely partner at all, then these with their texts. No pair leaves a task but
the links of a spanning forest, so a key that m copies share costs about m checks, and one of m texts that aren't alike no more than m rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices
from parley.operators.components import materialize

WIDTH, LEAST, BANDS, ROWS, AGREE, CELL = 5, 0.8, 20, 4, 45, 1024
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Ascending hashes of the text's shingles, each once; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(min(WIDTH, len(words)))), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in found], np.uint64))


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """Band keys, and a byte of each minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], (least >> np.uint64(24)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the shingle set, band keys, code: a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for big in batches for piece in slices(big, 4 << 20)):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            made = [sketch(s) for s in sets]
            keys = np.array([k for k, _ in made], np.uint64).view(np.int64).reshape(len(sets), BANDS)
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests, pa.array(list(keys), pa.list_(pa.int64())), pa.array([c for _, c in made], pa.binary())], names=["doc_id", "digest", "keys", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, keys array<long>, code binary")


def _likely(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose codes agree in AGREE bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    kind = pairs.schema["a"].dataType.simpleString()
    one, two = (firsts.select(F.col("id").alias(k), F.col("code").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def _checked(pairs: DataFrame, docs: DataFrame, least: float, block: int = 256) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are alike; b, the lead, may stand in many. Its partners are dealt to blocks, and its text goes once to each of them, ahead of theirs, so no task gets more than `block` partners of
    a lead in one piece and a lead's shingles are made once a block. Where rows repeat a doc_id, any of their texts counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets = None, []
        for batch in batches:
            good = []
            for b, number, text, leads in zip(*(batch.column(c) for c in ("b", "number", "text", "leads")), strict=True):
                if here != (b, number):
                    here, sets = (b, number), []
                own = shingles(text.as_py())
                if leads.as_py():
                    sets.append(own)
                good.append(not leads.as_py() and any(similarity(own, lead) >= least for lead in sets))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("number"))
    members = dealt.select("b", "number", "a", F.col("a").alias("doc_id"), F.lit(False).alias("leads"))
    leads = blocks.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("number"), F.col("b").alias("a"), F.col("b").alias("doc_id"), F.lit(True).alias("leads"))
    met = members.unionByName(leads).join(docs.select("doc_id", "text"), "doc_id").repartition("b", "number").sortWithinPartitions("b", "number", F.desc("leads"))
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def _in_cells(rows: DataFrame) -> DataFrame:
    """`rows` (key, id, group and others) of the keys that hold several groups, with `cell` and `block`, sorted by cell: rows of a key are dealt to blocks, and each two blocks, and each block by itself, are a cell."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / CELL).alias("blocks"), F.count_distinct("group").alias("groups")).where("groups > 1").select("key", "blocks")
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    celled = each.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).withColumn("across", F.col("block") != F.col("other")).drop("blocks", "other")
    return celled.repartition("cell").sortWithinPartitions("cell")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for start, stop in itertools.pairwise(cuts):
            if held and stop > start and held[-1].column("cell")[0].as_py() != cell[start]:
                yield pa.Table.from_batches(held)
                held = []
            if stop > start:
                held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _likely_in(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a row and of its likely partners of other groups behind it in the cell. A pair that shares several keys counts in the cell of its first band alone: bands are equal where their bytes in the codes are."""
    codes = np.frombuffer(b"".join(cell.column("code").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    group, block = cell.column("group").to_numpy(), cell.column("block").to_numpy()
    across, band = bool(cell.column("across")[0].as_py()), cell.column("band")[0].as_py()
    for i in range(len(codes) - 1):
        rest = np.flatnonzero((group[i + 1 :] != group[i]) & ((block[i + 1 :] != block[i]) | (not across))) + i + 1
        same = codes[rest] == codes[i]
        near = same.sum(axis=1) >= AGREE
        found = rest[near][same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(found):
            yield i, found


def _active(placed: DataFrame, kind: str) -> DataFrame:
    """key, band, id of the rows that have a likely partner in another group of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            hit = np.zeros(cell.num_rows, bool)
            for i, found in _likely_in(cell):
                hit[i] = hit[found] = True
            if hit.any():
                yield from cell.select(["key", "band", "id"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return _in_cells(placed).mapInArrow(run, f"key long, band int, id {kind}").distinct()


def _met(rows: DataFrame, kind: str, least: float) -> DataFrame:
    """a, b: links that join groups, from rows (key, band, id, group, code, text) whose likely pairs are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            ids, group, texts = (cell.column(c).to_pylist() for c in ("id", "group", "text"))
            sets: dict[int, np.ndarray] = {}
            root = {g: g for g in group}

            def find(g: int, root: dict[int, int] = root) -> int:
                while root[g] != g:
                    root[g] = root[root[g]]
                    g = root[g]
                return g

            links = []
            for i, found in _likely_in(cell):
                for j in found.tolist():
                    if find(group[i]) == find(group[j]):
                        continue
                    for p in (i, j):
                        if p not in sets:
                            sets[p] = shingles(texts[p])
                    if similarity(sets[i], sets[j]) >= least:
                        root[find(group[i])] = find(group[j])
                        links.append((ids[i], ids[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, cell.schema.field("id").type) for x in zip(*links, strict=True)], names=["a", "b"])

    return _in_cells(rows).mapInArrow(run, f"a {kind}, b {kind}")


def links(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: doc_ids of rows (doc_id, text) that links of at least that similarity connect. doc_id must be unique and not null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(_sketches(docs))
    firsts = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("code").alias("code")))
    equal = rows.join(firsts.select("digest", "id"), "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    keyed = firsts.select("id", F.posexplode("keys").alias("band", "key"))
    shared = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    known = shared.join(shared.groupBy("id").agg(F.sum("n").alias("met")), "id")
    leads = known.groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("lead"))
    starred = shared.join(leads, "key").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    found = materialize(_checked(materialize(_likely(starred, firsts)), docs, least))
    groups = materialize(found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))  # texts of one lead, which are joined for certain
    placed = shared.where("n > 2").join(groups, shared.id == groups.node, "left").select("key", "band", "id", F.coalesce("component", "id").alias("group"))
    active = materialize(_active(placed.join(firsts.select("id", "code"), "id"), kind))
    linked = equal.unionByName(found)
    if active.isEmpty():
        return linked
    of_id = active.groupBy("id").agg(F.collect_list(F.struct("key", "band")).alias("at"))
    whole = of_id.join(firsts.select("id", "code"), "id").join(groups, F.col("id") == F.col("node"), "left").join(docs.select(F.col("doc_id").alias("_d"), "text"), F.col("id") == F.col("_d"))
    again = whole.select(F.inline("at"), "id", F.coalesce("component", "id").alias("group"), "code", "text")
    return linked.unionByName(_met(again, kind, least))
