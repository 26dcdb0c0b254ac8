"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from parley.operators.components import shared_dir

#: Java form of the word pattern: anything but ASCII white space. `bytes.split()` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """Results of `make(key)` for keys of up to CHARS characters, in two generations: a full one becomes the old one, and
    keys still in use come back from there, so frequent keys stay and memory is bounded by twice `entries`."""

    CHARS = 48

    def __init__(self, make: Callable, entries: int = 1 << 17):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.CHARS:
                return found
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `size` bytes of text, one row at least."""
    length = np.nan_to_num(np.asarray(pc.binary_length(batch.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    ends, start = np.cumsum(length), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def list_table(blobs: list[bytes], width: int) -> pa.LargeListArray:
    """Lists of ids of `width` bytes, one for each row of id bytes."""
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // width
    values = pa.Array.from_buffers(pa.int32() if width == 4 else pa.int16(), int(size.sum()), [None, pa.py_buffer(b"".join(blobs))])
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int64()), values)


def regrouped(lists: pa.LargeListArray, rows: np.ndarray) -> pa.LargeListArray:
    """Lists joined: the first rows[0] of them, then the next rows[1], and so on."""
    ends = np.concatenate([[0], np.cumsum(rows)])
    return pa.LargeListArray.from_arrays(pa.array(np.asarray(lists.offsets)[ends]), lists.values)
