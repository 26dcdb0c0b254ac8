"""WAV files as a table of mono 16-bit samples."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000


def pcm_of(data: bytes, rate: int = RATE) -> np.ndarray:
    """16-bit mono samples at `rate` of an uncompressed WAV file of one or two channels; others raise ValueError. Channels are averaged, other widths shifted to 16 bits (8-bit samples are read as signed),
    other rates read between samples by straight lines."""
    with wave.open(io.BytesIO(data), "rb") as f:
        channels, width, own, kind = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getcomptype()
        if kind != "NONE":
            raise ValueError(f"WAV data must be uncompressed, not {kind}")
        if channels not in (1, 2):
            raise ValueError(f"WAV data must have one or two channels, not {channels}")
        raw = np.frombuffer(f.readframes(f.getnframes()), np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, 4 - width :] = raw
    samples = (wide.view("<i4").reshape(-1) >> (8 * (4 - width))).astype(np.int64)
    if channels == 2:
        samples = (samples[::2] + samples[1::2]) >> 1
    bits = 8 * width - 16
    samples = samples >> bits if bits >= 0 else samples << -bits
    if own != rate and len(samples):
        at = np.arange(int((len(samples) - 1) * rate / own) + 1) * own / rate
        samples = np.floor(np.interp(at, np.arange(len(samples)), samples)).astype(np.int64)
    return samples.astype("<i2")


def read_wav(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """recording (file path), pcm (binary: little-endian 16-bit mono), samples (array of float in -1..1), error: of each file under `path`, found by Spark's own reader. A file that can't be
    decoded has an error and nothing else. One file meets in one task."""

    @F.pandas_udf("pcm binary, error string")
    def decode(files: pd.Series) -> pd.DataFrame:
        out = []
        for data in files:
            try:
                out.append((pcm_of(bytes(data), rate).tobytes(), None))
            except (ValueError, wave.Error, EOFError) as e:
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["pcm", "error"])

    @F.pandas_udf("array<float>")
    def floats(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda b: np.frombuffer(b, "<i2").astype(np.float32) / 32768, na_action="ignore")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.col("path").alias("recording"), decode("content").alias("d"))
    return found.select("recording", F.col("d.pcm").alias("pcm"), floats("d.pcm").alias("samples"), F.col("d.error").alias("error"))
