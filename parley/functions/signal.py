"""Functions on signals: arrays of samples in -1..1, and what embeddings are taken from. Null samples give null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RATE = 16000
#: Least energy, and of a voiced frame as shares of the median and of the largest; pitch range in Hz and least length in seconds; step of pitch in seconds, and the change of it that cuts.
QUIET, OF_MEDIAN, OF_MOST = 2e-4, 0.25, 0.08
LOW_HZ, HIGH_HZ, LEAST_PITCH = 70.0, 350.0, 0.06
PITCH_STEP, JUMP_HZ = 0.12, 45.0


def crop(samples: Column, t0: Column, t1: Column, rate: int = RATE) -> Column:
    """Samples of [t0, t1) seconds, within the array; empty if t1 isn't after t0."""
    first = F.greatest(F.lit(0), (t0 * rate).cast("int"))
    last = F.least(F.size(samples), (t1 * rate).cast("int"))
    return F.slice(samples, first + 1, F.greatest(F.lit(0), last - first))


def long_enough(samples: Column, seconds: float = 0.05, rate: int = RATE) -> Column:
    """Whether there are so many seconds of samples, and one at least."""
    return F.size(samples) >= max(1, int(seconds * rate))


def rms(samples: Column, tiny: float = 0.0) -> Column:
    """Root of the mean square and `tiny`; 0 for no samples."""
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples) + tiny)).when(F.size(samples) == 0, 0.0)


def loud_enough(samples: Column, least: float = QUIET) -> Column:
    return rms(samples, 1e-12) >= least


def frame_rms(samples: Column, frame: int, hop: int, tiny: float = 0.0) -> Column:
    """RMS of each whole frame, `hop` samples apart; none if there are fewer samples than a frame."""
    starts = F.sequence(F.lit(0), F.floor((F.size(samples) - frame) / hop).cast("int"))
    return F.when(F.size(samples) >= frame, F.transform(starts, lambda i: rms(F.slice(samples, i * hop + 1, F.lit(frame)), tiny))).when(samples.isNotNull(), F.array().cast("array<double>"))


def voiced(samples: Column, frame: int) -> Column:
    """Of each frame, side by side, whether its RMS reaches QUIET, OF_MEDIAN of the lower median and OF_MOST of the largest."""
    levels = frame_rms(samples, frame, frame, 1e-12)
    middle = F.get(F.array_sort(levels), F.floor((F.size(levels) - 1) / 2).cast("int"))
    least = F.greatest(F.lit(QUIET), OF_MEDIAN * middle, OF_MOST * F.array_max(levels))
    return F.transform(levels, lambda x: x >= least)


def pitch_of(y: np.ndarray, rate: int) -> float:
    """Pitch in Hz from the largest autocorrelation between the lags of HIGH_HZ and LOW_HZ, by FFT; 0 for under LEAST_PITCH seconds."""
    n = len(y)
    if n < int(LEAST_PITCH * rate):
        return 0.0
    spectrum = np.fft.rfft(y - y.mean(), 1 << (n - 1).bit_length())
    likeness = np.fft.irfft(np.abs(spectrum) ** 2)[:n]
    first = max(1, int(rate / HIGH_HZ))
    last = min(max(first + 1, int(rate / LOW_HZ)), n - 1)
    if last - first <= 2:
        return 0.0
    return rate / (first + int(np.argmax(likeness[first:last])))


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(int)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def steadiest(x: np.ndarray, rate: int = RATE, min_len: float = 0.6, frame: float = 0.02) -> tuple[int, int] | None:
    """First and last sample of the stretch to take an embedding from: runs of voiced frames of min_len seconds, cut where pitch jumps; the one of the largest length over 1 + spread of pitch, the first of equal ones."""
    hop = max(1, int(rate * frame))
    if len(x) < hop:
        return None
    levels = np.sqrt((x[: len(x) // hop * hop].reshape(-1, hop) ** 2).mean(axis=1) + 1e-12)
    least = max(QUIET, OF_MEDIAN * float(np.sort(levels)[(len(levels) - 1) // 2]), OF_MOST * float(levels.max()))
    step, shortest = max(1, round(PITCH_STEP * rate)), int(min_len * rate)
    best, most = None, -1.0
    for a, b in _runs(levels >= least):
        if b - a < max(1, int(np.ceil(min_len * rate / hop))) or (b - a) * hop < shortest:
            continue
        start, stop = a * hop, min(len(x), b * hop)
        pitch = np.array([pitch_of(x[start + t : min(stop, start + t + step)], rate) for t in range(0, max(1, stop - start - step + 1), step)])
        cuts = np.flatnonzero(np.abs(np.diff(pitch)) > JUMP_HZ) + 1
        if (pitch <= 0).all():
            parts = [(start, stop, 0.0)]
        elif not len(cuts):
            parts = [(start, stop, float(pitch.std()))]
        else:
            ends = [0, *cuts.tolist(), len(pitch)]
            parts = [(start + i * step, min(stop, start + j * step), float(pitch[i:j].std())) for i, j in zip(ends, ends[1:], strict=False)]
        for lo, hi, spread in parts:
            if hi - lo >= shortest and (hi - lo) / (1 + spread) > most:
                best, most = (lo, hi), (hi - lo) / (1 + spread)
    return best


def pitch(samples: Column, rate: int = RATE) -> Column:
    """Pitch of each array of samples, in Hz. There is no built-in transform to frequencies."""

    @F.pandas_udf(DoubleType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: pitch_of(np.asarray(x, float), rate), na_action="ignore")

    return run(samples)


def best_stretch(samples: Column, rate: int = RATE, min_len: float = 0.6, frame: float = 0.02) -> Column:
    """`steadiest` of each array, as a struct of start and end, null where there is none."""

    @F.pandas_udf("start long, end long")
    def run(rows: pd.Series) -> pd.DataFrame:
        found = [None if x is None else steadiest(np.asarray(x, float), rate, min_len, frame) for x in rows]
        return pd.DataFrame({"start": pd.array([f and f[0] for f in found], "Int64"), "end": pd.array([f and f[1] for f in found], "Int64")})

    found = run(samples)
    return F.when(found["start"].isNotNull(), found)


def embedding_input(samples: Column, rate: int = RATE, min_len: float = 0.6, frame: float = 0.02, whole: bool = True) -> Column:
    """What an embedding model gets: the best stretch of a loud enough signal; without one the whole signal, or null if `whole` is off; null too if that is shorter than min_len."""
    stretch = best_stretch(samples, rate, min_len, frame)
    cut = F.slice(samples, (stretch["start"] + 1).cast("int"), (stretch["end"] - stretch["start"]).cast("int"))
    taken = F.when(stretch.isNotNull(), cut)
    taken = F.coalesce(taken, samples) if whole else taken
    return F.when(loud_enough(samples) & (F.size(taken) >= int(min_len * rate)), taken)
