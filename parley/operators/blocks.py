"""Rows of a recording against all others of it, in blocks, for operators that compare vectors.

A recording's rows are dealt by hash to blocks of about `block` rows. Every asking row is sent to every block of its recording, the rows of a block come first there, and the asking ones stream past them; so a
task holds one block and a few asking rows, however long the recording is, and what it emits is what `run` finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "recording"
BLOCK, TOGETHER = 4096, 256
#: id, vector, number and group of rows, as arrays.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _rows(batches: list[pa.RecordBatch]) -> Rows:
    table = pa.Table.from_batches(batches)
    vectors = table.column("v").combine_chunks()
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of unequal length: {sizes[0]} and {sizes[-1]}")
    return table.column("id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), table.column("x").to_numpy(), table.column("part").to_numpy()


def against_blocks(asking: DataFrame, rows: DataFrame, run: Callable[[Rows, Rows], dict[str, np.ndarray]], out: str, key: str = KEY, block: int = BLOCK) -> DataFrame:
    """recording and the columns `out` (DDL) that run(asking, rows) gives for some asking rows and one block. Both tables: recording, id (long), v (doubles), x (double), part (long); ids are unique in a recording, vectors of equal length."""
    blocks = rows.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    sized = lambda df: df.join(blocks, F.col(key).eqNullSafe(F.col("_k"))).select(key, "blocks", "id", "v", "x", "part")
    held = sized(rows).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("asks", F.lit(0))
    asked = sized(asking).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.lit(1))
    both = held.unionByName(asked).drop("blocks").repartition(key, "block").sortWithinPartitions(key, "block", "asks", "id")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, gathered, block_rows = None, [], None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in (key, "block", "asks")), strict=True))
            start = 0
            for (own, number, asks), run_of in groupby(places):
                part = batch.slice(start, length := len(list(run_of)))
                start += length
                if here != (own, number):
                    here, gathered, block_rows = (own, number), [], None
                if not asks:
                    gathered.append(part)
                    continue
                if block_rows is None:
                    block_rows, gathered = (_rows(gathered) if gathered else None), []
                for at in range(0, length, TOGETHER) if block_rows else ():
                    found = run(_rows([part.slice(at, TOGETHER)]), block_rows)
                    n = len(next(iter(found.values())))
                    if n:
                        whose = pa.array([own] * n, batch.schema.field(key).type)
                        yield pa.RecordBatch.from_arrays([whose, *(pa.array(x) for x in found.values())], names=[key, *found])

    return both.mapInArrow(met, f"{key} {dict(rows.dtypes)[key]}, {out}")


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)
