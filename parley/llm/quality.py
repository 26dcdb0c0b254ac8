"""Quality rules: word statistics and compression bands.

Every whole text is compressed with zstandard, once as a whole and once in fixed chunks: of 4,096 bytes from 8,192
bytes on, of 1,024 under that. The last chunk is the text's last full chunk, so no end goes unjudged. A ratio of
compressed to plain bytes under the floor marks repetitive text, one over the ceiling marks text that doesn't compress
(keys, encoded data, noise). The limits depend on the length and come from the table itself, by one rule for all lengths:
texts that pass the word rules count for each quarter octave of the length, the less the farther theirs is from it
(`Bands.fade` a step), and so give a weighted median and a spread (median distance from it, scaled to a standard deviation);
floor and ceiling lie a number of spreads from the median. They are averaged with the wide limits that `Bands` has for the
length: these weigh `Bands.prior` squared, the table's own the squared weight of its texts. So a length of many texts has limits of its own, a rare length leans on its
neighbours and on the wide limits, and one text alone is judged by the wide limits, moved by one part in `prior` squared + 1. Chunks
have limits of the same kind for each chunk size.

The measures of texts are written to the shared folder, about 100 bytes and 8 for each chunk, and the limits and verdicts
are DataFrame operations on them; `measure` so reads each text once, `keep`, which hands on the texts, twice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parley.operators.components import stored

_SYMBOL = re.compile(rb"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """`whole` holds (bytes under which it holds, floor, ceiling) by length, `chunk` (floor, ceiling): the wide limits."""

    whole: tuple[tuple[float, float, float], ...] = ((128, 0.40, 1.50), (256, 0.35, 1.05), (1024, 0.30, 0.90), (4096, 0.27, 0.80), (16384, 0.25, 0.75), (float("inf"), 0.22, 0.75))
    chunk: tuple[float, float] = (0.25, 0.75)
    chunk_bytes: int = 4096
    #: Of texts under two chunks of `chunk_bytes`.
    small_chunk_bytes: int = 1024
    #: A text goes if more than this share of its chunks lies outside the chunk band.
    chunk_share: float = 0.3
    #: Spreads from the median to floor (the usual cut of the modified z-score) and ceiling (further, as short clean texts lean upwards).
    below: float = 3.5
    above: float = 6.0
    #: Least spread as a share of the median, for tables of copies.
    least_spread: float = 0.01
    #: Texts (or chunks) at which the table's limits weigh as much as the wide ones; what a text of the next quarter octave weighs.
    prior: float = 3.0
    fade: float = 0.05
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = codes[:n]
    for i in range(1, width):
        if len(seen) ** 2 >= 2**62 or int(key.max()) >= 2**62 // len(seen):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + codes[i : i + n]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[at] > 1
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + n] |= often
    return int(inside.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def word_rules_fail(words: list[bytes], repeats: int, bands: Bands) -> bool:
    return len(words) < bands.min_words or 100 * repeats > bands.max_repeat_percent * len(words)


def _step(n: int) -> int:
    """Quarter octave of a length."""
    return math.floor(4 * math.log2(n))


def ratios(data: bytes, packer: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, list[float]]:
    """Ratio of the whole (0 if empty), chunk size, and ratios of the chunks; texts shorter than a chunk have none."""
    n = len(data)
    if not n:
        return 0.0, 0, []
    size = bands.chunk_bytes if n >= 2 * bands.chunk_bytes else bands.small_chunk_bytes
    starts = [*range(0, n - size + 1, size), *([n - size] if n > size and n % size else [])]
    return len(packer.compress(data)) / n, size, [len(packer.compress(data[i : i + size])) / size for i in starts]


#: (chunk size, or 0 for whole texts; quarter octave, or 0 for chunks) -> floor, ceiling
Limits = dict[tuple[int, int], tuple[float, float]]
_BIN = 5e-4
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, step long, ratio double, chunk long, parts array<double>"


def measured(docs: DataFrame, bands: Bands = Bands(), name: str = "measures") -> DataFrame:
    """docs with a struct of measures. step: quarter octave of the length in bytes (0 of empty text); chunk: chunk size; parts: the chunks' ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = data.split()
                n, repeats = len(words), repeated_words(words)
                chars = sum(map(len, words)) if data.isascii() else len(b"".join(words).decode())
                ratio, size, parts = ratios(data, packer, bands)
                rows.append((n, chars, len(_SYMBOL.findall(data)), repeated_lines(data), repeats, word_rules_fail(words, repeats, bands), _step(len(data)) if data else 0, ratio, size, parts))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _MEASURES.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(_MEASURES))]))


def limits(rows: DataFrame, bands: Bands = Bands()) -> Limits:
    """Limits from the measures of all texts of `rows` that pass the word rules, for each chunk size and each quarter octave of theirs. What reaches the driver is counts by
    length and ratio, whose number the ratios' width bounds and not the rows'."""
    good = rows.where("not measures.base_failed")
    whole = good.select(F.lit(0).cast("long").alias("size"), "measures.step", F.col("measures.ratio").alias("x"))
    parts = good.select(F.col("measures.chunk").alias("size"), F.lit(0).cast("long").alias("step"), F.explode("measures.parts").alias("x"))
    counted = whole.unionByName(parts).groupBy("size", "step", F.floor(F.col("x") / _BIN).alias("bin")).agg(F.count("*").alias("n")).toArrow()
    size, step, at, n = (counted.column(c).to_numpy() for c in ("size", "step", "bin", "n"))
    out: Limits = {}
    for key in {*zip(size.tolist(), step.tolist(), strict=True)}:
        own = size == key[0]
        weight = n[own] * bands.fade ** np.abs(step[own] - key[1])
        value = (at[own] + 0.5) * _BIN
        middle = weighted_median(value, weight)
        spread = max(1.4826 * weighted_median(np.abs(value - middle), weight), bands.least_spread * middle)
        wide = bands.chunk if key[0] else next((lo, hi) for under, lo, hi in bands.whole if 2 ** ((key[1] + 0.5) / 4) < under)
        share = weight.sum() ** 2 / (weight.sum() ** 2 + bands.prior**2)
        out[key] = tuple(float(share * x + (1 - share) * y) for x, y in zip((middle - bands.below * spread, middle + bands.above * spread), wide, strict=True))
    return out


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value up to which half of the weight lies, or half less rounding."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2 * (1 - 1e-9))])


def judged(rows: DataFrame, known: Limits, bands: Bands = Bands()) -> DataFrame:
    """rows with measures, with out (the share of chunks beyond their limits, 0 without chunks) and kept. The table of limits has a row for each quarter octave, 4 for each doubling of the longest text."""
    table = F.broadcast(rows.sparkSession.createDataFrame([(s, *v) for (size, s), v in known.items() if not size] or [(0, 0.0, 0.0)], "_step long, _floor double, _ceiling double"))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for (size, _), (floor, ceiling) in known.items():
        if size:
            low, high = F.when(F.col("measures.chunk") == size, floor).otherwise(low), F.when(F.col("measures.chunk") == size, ceiling).otherwise(high)
    beyond = F.size(F.filter("measures.parts", lambda x: (x < F.col("_low")) | (x > F.col("_high")))) / F.size("measures.parts")
    limited = rows.join(table, F.col("measures.step") == F.col("_step"), "left").withColumn("_low", low).withColumn("_high", high)
    out = F.when(F.size("measures.parts") > 0, beyond).otherwise(0.0)
    inside = F.col("measures.ratio").between(F.col("_floor"), F.col("_ceiling")) & (F.col("out") <= bands.chunk_share)
    return limited.withColumn("out", out).withColumn("kept", ~F.col("measures.base_failed") & F.coalesce(inside, F.lit(False))).drop("_step", "_floor", "_ceiling", "_low", "_high")


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of `docs` (doc_id, text), null text counting as empty: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunks_out. Other columns are ignored, so clashing names
    can't matter; repeated rows give repeated rows; an empty table gives none; texts of any length are read whole.
    Jobs for the measures and the limits run at once.
    """
    rows = stored(measured(docs.select("doc_id", "text"), bands).drop("text"))
    rows = judged(rows, limits(rows, bands), bands)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rows.select("doc_id", *(F.col(f"measures.{c}").alias(c) for c in counts), "kept", F.col("measures.ratio").alias("ratio"), F.col("out").alias("chunks_out"))


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs` whose text passes, with their columns. A first pass writes measures for the limits, a second one takes them again beside the rows: texts are neither written nor shuffled nor joined by their ids, and repeated
    or null ids need no care."""
    known = limits(stored(measured(docs.select("text"), bands).drop("text")), bands)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumnRenamed(f"c{names.index('text')}", "text")  # no name can clash
    kept = judged(measured(plain, bands), known, bands).where("kept")
    return kept.select(*(F.col("text" if n == "text" else f"c{i}").alias(n) for i, n in enumerate(names)))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ratio", "chunks_out")
