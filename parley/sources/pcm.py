"""Raw audio as a stream, and WAV files as a sink, by Spark's Python data sources.

`pcm_slices` reads the files `*.pcm` of a folder as slices of `sliceBytes` (3,200 bytes are 100 ms of 16-bit mono at 16 kHz), in batch and as a stream. The offset is the name of a file and a number of its slices: files are taken in the order of
their names, so a new file's name must come after those there, and a file must be whole when it appears (moved into the folder, not written there). The last slice of a file may be shorter. A batch is planned again from its offsets alone, so a
restart reads the same slices.

`wav_files` writes one 16-bit mono WAV file for each row (recording, samples in -1..1). Tasks write into a hidden folder of the job; files move to the folder when all tasks have succeeded, and the hidden folder goes when one fails for good.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SLICE_BYTES, TASK_SLICES, BATCH_SLICES = 3200, 4096, 256
SCHEMA = "recording string, seq long, pcm binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Slices(InputPartition):
    """Slices first to last (exclusive) of a file."""

    name: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(self.name)


class _Folder:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("sliceBytes", SLICE_BYTES))
        self.each = int(options.get("taskSlices", TASK_SLICES))

    def files(self) -> list[tuple[str, int]]:
        """Names and numbers of slices, by name."""
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, -(-f.size // self.size)) for f in found if f.is_file and f.extension == "pcm" and f.size)

    def partitions_between(self, start: dict, end: dict) -> list[Slices]:
        out = []
        for name, n in self.files():
            first = 0 if name > start["file"] else start["slice"] if name == start["file"] else n
            last = n if name < end["file"] else end["slice"] if name == end["file"] else 0
            out += [Slices(name, k, min(k + self.each, last)) for k in range(first, last, self.each)]
        return out

    def latest(self) -> dict:
        files = self.files()
        return {"file": files[-1][0], "slice": files[-1][1]} if files else {"file": "", "slice": 0}

    def slices(self, part: Slices | None) -> Iterator[pa.RecordBatch]:
        """part is None where there are no partitions at all."""
        if part is None:
            return
        system, root = opened(self.path)
        recording = part.name.removesuffix(".pcm")
        with system.open_input_file(f"{root}/{part.name}") as file:
            file.seek(part.first * self.size)
            for k in range(part.first, part.last, BATCH_SLICES):
                wanted = min(BATCH_SLICES, part.last - k)
                data = file.read(wanted * self.size)
                pieces = [data[i : i + self.size] for i in range(0, len(data), self.size)]
                if len(pieces) < wanted:
                    raise OSError(f"{part.name} has become shorter")
                yield pa.RecordBatch.from_arrays([pa.array([recording] * wanted), pa.array(range(k, k + wanted), pa.int64()), pa.array(pieces, pa.binary())], names=["recording", "seq", "pcm"])


class PcmReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Slices]:
        return self.partitions_between({"file": "", "slice": 0}, self.latest())

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return self.slices(partition)


class PcmStream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "slice": 0}

    def latestOffset(self) -> dict:
        return self.latest()

    def partitions(self, start: dict, end: dict) -> list[Slices]:
        return self.partitions_between(start, end)

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return self.slices(partition)


class PcmSource(DataSource):
    """spark.read or spark.readStream.format("pcm_slices").option("sliceBytes", 3200).load(folder): recording (the file's name without .pcm), seq (from 0 in each recording), pcm."""

    @classmethod
    def name(cls) -> str:
        return "pcm_slices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(self.options)

    def streamReader(self, schema: StructType) -> PcmStream:
        return PcmStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def wav_bytes(samples: list[float] | None, rate: int) -> bytes:
    """16-bit mono: samples cut to -1..1, times 32,767, rounded."""
    values = np.nan_to_num(np.array(samples if samples is not None else [], float))
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.round(np.clip(values, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rate, self.job = options["path"], int(options.get("rate", 16000)), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each attempt of a task has its own folder, so that a repeated one doesn't meet its own files."""
        system, root = opened(self.path)
        folder, files = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = f"{row['recording']}.wav"
            if row["recording"] is None or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a name of a file: {row['recording']!r}")
            if not files:
                system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{len(files)}") as file:
                file.write(wav_bytes(row["samples"], self.rate))
            files.append((f"{folder}/{len(files)}", name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        twice = [name for name, n in Counter(name for _, name in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"recordings that stand twice: {sorted(twice)[:3]}")
        for at, name in files:
            system.move(at, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class WavSink(DataSource):
    """df.select("recording", "samples").write.format("wav_files").option("rate", 16000).mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "wav_files"

    def schema(self) -> str:
        return "recording string, samples array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        if overwrite:
            raise ValueError("wav_files appends to a folder")
        return WavWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (PcmSource, WavSink):
        spark.dataSource.register(source)
