"""Long recordings cut into slices, for folds whose state can be carried from slice to slice.

Rows are sorted by range partitions of (recording, order), so one recording is spread over as many tasks as its rows need, and cut into slices of one recording and of bounded length. A fold sums every slice up as a small function of
the state before it; `carried` runs over these functions alone, in order, and gives each slice its state, with which slices are folded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.components import stored

KEY = "recording"
SLICE = 8192


def sliced(df: DataFrame, order: list[str], key: str = KEY, rows: int = SLICE) -> DataFrame:
    """df with `slice`, a number that ascends with (recording, order), and `place` of the row in its slice. Order should leave no ties but of equal rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, here = (TaskContext.get().partitionId() << 40) - 1, 0, None
        for batch in batches:
            slices, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
            for i, own in enumerate(batch.column(key).to_pylist()):
                if here != (own,) or place == rows:
                    number, place, here = number + 1, 0, (own,)
                slices[i], places[i] = number, place
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slices), pa.array(places)], names=[*batch.schema.names, "slice", "place"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return stored(dealt.mapInArrow(cut, f"{schema}, slice long, place int"))


def carried(sums: DataFrame, step: Callable, state: str, key: str = KEY) -> DataFrame:
    """slice, state (DDL of its type; null at a recording's first slice). step(state, row) gives the state behind a slice from the one before it and the slice's row of sums (recording, slice and what step reads). One task runs over a recording's
    sums, a row a slice, and holds a batch of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, now = None, None
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                own = (getattr(row, key),)
                now = now if here == own else None
                out.append(now)
                here, now = own, step(now, row)
            yield pd.DataFrame({"slice": rows["slice"], "state": pd.Series(out, dtype=object)})

    return sums.repartition(key).sortWithinPartitions(key, "slice").mapInPandas(run, f"slice long, state {state}")
