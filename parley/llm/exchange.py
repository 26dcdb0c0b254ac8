"""Units of a corpus, and keyed questions from all units to all others and back.

A unit is a slice of a few MB of rows, kept as one file in the folder that all executors share. Jobs over units
move only their numbers; a task opens the files it needs. `ask` is one round trip: each unit puts its distinct 64-bit
keys, with values, to tasks that hold all units' entries of the same keys, and gets one answer a key back. A key
counts once a unit however often it stands there, so a key in a third of all rows costs its task one entry a
unit and no more. Units are pre-aggregated before the shuffle and sent as packed arrays, not a row a key.

File names follow from the partition and the place in it, and files are renamed into place whole, so repeated and
speculative tasks leave the same files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import partitions, slices
from parley.operators.components import materialize

UNIT_BYTES = 8 << 20
#: A bucket holds the entries of so many whole units, or fewer: what a task keeps in memory at a time.
UNITS_A_BUCKET = 16


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else pafs.FileSystem.from_uri("file://" + re.sub(r"^file:", "", folder))


def put(folder: str, name: str, data: bytes) -> None:
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    files, path = opened(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        return f.read()


def packed(values: np.ndarray) -> bytes:
    """Compressed with the first bytes of all rows together, then the second ones, and so on: high bytes of small numbers then take no room."""
    rows = np.ascontiguousarray(values)
    planes = rows.view(np.uint8).reshape(len(rows), -1).T if len(rows) else rows
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str, width: int = 1) -> np.ndarray:
    """An array that was packed, of rows of `width` elements."""
    size = np.dtype(kind).itemsize * width
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    rows = np.ascontiguousarray(planes.T).view(kind)
    return rows.reshape(-1) if width == 1 else rows


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as the steps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def bundle(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of one or two dimensions by name, each packed."""
    parts = [(name, a.dtype.str, a.shape[1] if a.ndim > 1 else 1, packed(a)) for name, a in arrays.items()]
    head = json.dumps([(name, kind, width, len(data)) for name, kind, width, data in parts]).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *(data for *_, data in parts)])


def unbundle(data: bytes) -> dict[str, np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for name, kind, width, size in json.loads(data[4:at]):
        out[name], at = unpacked(data[at : at + size], kind, width), at + size
    return out


def put_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    put(folder, name, bundle(arrays))


def get_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    return unbundle(get(folder, name))


def store_units(docs: DataFrame, folder: str, keep: Callable[[pa.Table], bytes], size: int = UNIT_BYTES) -> DataFrame:
    """Write `docs` (with a string column `text`) as units of `size` bytes of text; a longer text is a unit by itself. keep: the bytes to store for a slice
    of rows. Returns a materialized table of the units' numbers, `unit`. An empty table has no units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal made, waiting, held
            unit = (part << 24) + made
            put(folder, f"unit-{unit}", keep(pa.Table.from_batches(waiting)))
            made, waiting, held = made + 1, [], 0
            return pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64())})

        for batch in batches:
            for piece in slices(batch, size):
                waiting.append(piece)
                held += piece.column("text").nbytes
                if held >= 0.7 * size:
                    yield close()
        if waiting:
            yield close()

    return materialize(docs.mapInArrow(run, "unit long"))


def ask(
    units: DataFrame,
    question: Callable[[int], tuple[np.ndarray, list[bytes | np.ndarray]]],
    answer: Callable[[np.ndarray, np.ndarray, list[list[bytes]]], np.ndarray],
) -> DataFrame:
    """unit, bucket, answers: one round trip over `units` (a column `unit`).

    question(unit): ascending uint64 keys and what goes with them: arrays of one row a key, or functions from a range of keys to
    bytes. answer(keys, owner, values): the keys of all entries that met in a task, the index of the block each came
    in (blocks in the order of units), and the blocks' values, packed; returns an array of one row an entry. `answers` are the packed rows for a
    unit's keys in one bucket; buckets are prefixes of keys, so answers in the order of buckets are in the order of keys.
    """
    n = partitions(units.sparkSession)
    bits = max(2, (max(4 * n, units.count() // UNITS_A_BUCKET) - 1).bit_length())
    bounds = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("unit").to_pylist():
                keys, values = question(unit)
                cuts = [0, *np.searchsorted(keys, bounds, "left").tolist(), len(keys)]
                buckets = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
                blobs = [[packed(v[cuts[b] : cuts[b + 1]]) if isinstance(v, np.ndarray) else v(cuts[b], cuts[b + 1]) for v in values] for b in buckets]
                columns = [pa.array([unit] * len(buckets), pa.int64()), pa.array(buckets, pa.int64()), pa.array([_packed_keys(keys[cuts[b] : cuts[b + 1]]) for b in buckets], pa.binary()), pa.array(blobs, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "bucket", "keys", "vals"])

    def answered(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(pieces)
        keys = [_unpacked_keys(k) for k in rows.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        out = answer(np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes), rows.column("vals").to_pylist())
        ends = np.cumsum(sizes)
        return pa.RecordBatch.from_arrays(
            [rows.column("unit").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array([packed(out[e - s : e]) for s, e in zip(sizes, ends, strict=True)], pa.binary())],
            names=["unit", "bucket", "answers"],
        )

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket in memory at a time: rows come sorted by bucket."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("bucket")[0].as_py() != bucket[start]:
                    yield answered(held)
                    held = []
                if stop > start:
                    held.append(batch.slice(start, stop - start))
        if held:
            yield answered(held)

    sent = units.mapInArrow(send, "unit long, bucket long, keys binary, vals array<binary>")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(reply, "unit long, bucket long, answers binary")


def told(units: DataFrame, answers: DataFrame, use: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], schema: str, kind: str = "<u4", width: int = 1) -> DataFrame:
    """use(unit, answers in the order of its keys) for every unit, those that asked nothing included. kind, width: of a row of answers."""
    none = units.select("unit", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("answers"))
    dealt = answers.unionByName(none).repartition(partitions(units.sparkSession), "unit")
    gathered = dealt.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("bucket", "answers"))).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, got in zip(batch.column("unit").to_pylist(), batch.column("got").to_pylist(), strict=True):
                blocks = [unpacked(x["answers"], kind, width) for x in got if x["answers"] is not None]
                yield from use(unit, np.concatenate(blocks) if blocks else np.zeros(0 if width == 1 else (0, width), kind))

    return gathered.mapInArrow(run, schema)
