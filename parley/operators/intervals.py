"""Interval algebra over rows (recording, idx, t0, t1[, speaker]).

Every operator takes and returns DataFrames, keyed by `key` (the recording), lazily and without collecting. Times are
seconds. Operators that match points or intervals of a recording with each other join on bins of BIN seconds besides. `idx` is the row's place in its recording; it settles every tie, so results don't depend on the order in which rows arrive. Rows
with a null time are ignored; an empty table gives none. Windows are partitioned by recording: one recording's
rows meet in one task, recordings are spread over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.text import stripped
from parley.operators.slices import SLICE, carried, sliced

EPS = 1e-6
#: Seconds a bin of range joins: a few turns long, so that a row falls into few bins and a bin holds few rows.
BIN = 60.0
KEY = "recording"


def _known(df: DataFrame) -> DataFrame:
    return df.where("t0 is not null and t1 is not null")


def positive(df: DataFrame) -> DataFrame:
    """Rows of positive length."""
    return df.where("t1 > t0")


def at_least(df: DataFrame, min_len: float = 0.12) -> DataFrame:
    """Rows of min_len or longer."""
    return df.where(F.col("t1") - F.col("t0") >= min_len)


def merge_intervals(df: DataFrame, max_gap: float, min_len: float = 0.0, key: str = KEY) -> DataFrame:
    """recording, t0, t1: intervals joined over gaps of up to max_gap, then those of min_len or longer. Input of no positive length is dropped."""
    order = Window.partitionBy(key).orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("t0") - reach > max_gap), 1).otherwise(0)
    islands = positive(_known(df)).select(key, "t0", "t1").withColumn("opened", opened).withColumn("island", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).where(F.col("t1") - F.col("t0") >= min_len).drop("island")


def pad(df: DataFrame, by: float, total: Column | None = None) -> DataFrame:
    """Both ends moved out by `by`, not under 0 nor over `total` if given; what is then empty goes."""
    end = F.col("t1") + by if total is None else F.least(total, F.col("t1") + by)
    return positive(_known(df).withColumn("t1", end).withColumn("t0", F.greatest(F.lit(0.0), F.col("t0") - by)))


def split_long(df: DataFrame, max_len: float) -> DataFrame:
    """Intervals tiled from their start in steps of max_len, the last tile shorter; adds `part`, from 0. A rest of up to a microsecond is no tile."""
    parts = F.ceil((F.col("t1") - F.col("t0") - EPS) / max_len).cast("int")
    tiled = _known(df).withColumn("n_parts", parts).where("n_parts > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    start = F.col("t0") + F.col("part") * F.lit(float(max_len))
    return tiled.withColumn("t1", F.least(F.col("t1"), start + F.lit(float(max_len)))).withColumn("t0", start).drop("n_parts")


def drop_overlap(df: DataFrame, key: str = KEY) -> DataFrame:
    """Intervals in order of (t0, t1), each begun where all earlier ones have ended; what is left of up to a microsecond goes."""
    reach = F.max("t1").over(Window.partitionBy(key).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1))
    cut = _known(df).withColumn("reach", reach).withColumn("t0", F.greatest("t0", F.coalesce("reach", "t0")))
    return cut.where(F.col("t1") > F.col("t0") + EPS).drop("reach")


def speech_segments(vad: DataFrame, max_gap: float = 0.25, min_len: float = 0.25, padding: float = 0.05, max_len: float = 45.0, key: str = KEY) -> DataFrame:
    """Windows for the models from voice activity: merged, padded, split and without overlap."""
    merged = merge_intervals(vad, max_gap, min_len, key)
    return drop_overlap(split_long(pad(merged, padding), max_len).drop("part"), key)


def _islands(df: DataFrame, order: Window, same: Column, gap: float, key: str) -> DataFrame:
    """Numbers, in `order`, runs of one speaker whose gaps to what the run has reached are up to gap."""
    changed = F.when(F.lag("speaker").over(order).isNull() | ~same, 1).otherwise(0)
    runs = df.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.drop("changed")


def merge_same_speaker(df: DataFrame, max_gap: float, by_time: bool = True, slack: float = 1e-9, key: str = KEY) -> DataFrame:
    """recording, idx, t0, t1, speaker: neighbouring turns of one speaker joined over gaps of up to max_gap (and slack).

    by_time: neighbours in the order of (t0, t1, idx), otherwise in that of idx. idx of a joined turn is its first one's.
    """
    turns = _known(df).select(key, "idx", "t0", "t1", "speaker")
    within = Window.partitionBy(key)
    order = within.orderBy("t0", "t1", "idx") if by_time else within.orderBy("idx")
    runs = _islands(turns, order, F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), max_gap, key)
    inner = (Window.partitionBy(key, "run").orderBy("t0", "t1", "idx") if by_time else Window.partitionBy(key, "run").orderBy("idx"))
    reach = F.max("t1").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("t0") - reach > max_gap + slack), 1).otherwise(0)
    islands = runs.withColumn("opened", opened).withColumn("island", F.sum("opened").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("t0", "t1", "idx") if by_time else F.struct("idx", "t0")
    merged = islands.groupBy(key, "run", "island").agg(F.min(place).alias("first"), F.max("t1").alias("t1"), F.first("speaker").alias("speaker"))
    return merged.select(key, F.col("first.idx").alias("idx"), F.col("first.t0").alias("t0"), "t1", "speaker")


def merge_touching(df: DataFrame, key: str = KEY) -> DataFrame:
    """Turns of one speaker, neighbours by idx, joined where one begins within a microsecond of the other's end."""
    turns = _known(df).select(key, "idx", "t0", "t1", "speaker")
    order = Window.partitionBy(key).orderBy("idx")
    touches = F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.abs(F.lag("t1").over(order) - F.col("t0")) < EPS)
    opened = F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1)
    runs = turns.withColumn("opened", opened).withColumn("run", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(key, "run").agg(F.min(F.struct("idx", "t0", "speaker")).alias("first"), F.max(F.struct("idx", "t1")).alias("last"))
    return merged.select(key, F.col("first.idx").alias("idx"), F.col("first.t0").alias("t0"), F.col("last.t1").alias("t1"), F.col("first.speaker").alias("speaker"))


def build_turns(utterances: DataFrame, max_gap: float = 0.0, key: str = KEY) -> DataFrame:
    """recording, start, end, speaker, text: neighbouring utterances (t0, t1, speaker, text) of one speaker joined over gaps of up to
    max_gap and a microsecond; their texts, stripped and without blank ones, joined by a space; times rounded to 3 places."""
    rows = _known(utterances).select(key, "idx", "t0", "t1", "speaker", stripped(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy(key).orderBy("t0", "t1", "idx")
    runs = _islands(rows, order, F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), max_gap, key)
    inner = Window.partitionBy(key, "run").orderBy("t0", "t1", "idx")
    reach = F.max("t1").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("t0") - reach > max_gap + EPS), 1).otherwise(0)
    islands = runs.withColumn("opened", opened).withColumn("island", F.sum("opened").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("t0", "t1", "idx", "text")))
    turns = islands.groupBy(key, "run", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("speaker").alias("speaker"), parts.alias("parts"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " ")
    return turns.select(key, F.round("t0", 3).alias("start"), F.round("t1", 3).alias("end"), "speaker", text.alias("text"))


def _bin(t: Column, size: float) -> Column:
    return F.floor(t / size)


def _bins(df: DataFrame, t0: str, t1: str, size: float) -> DataFrame:
    """A row for each bin that [t0, t1] touches."""
    return df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(t0), size), _bin(F.col(t1), size))))


def _resolved(rows: list[tuple], after: float | None) -> list[tuple]:
    """(t0, t1, speaker) of a bin's pieces, joined where they touch. rows: (t0, t1, speaker, 1 if it begins and 2 more if it ends in the bin) in the order in which later ones win; after: the recording's first point behind the bin. Of the turns begun so far
    those stay at hand that end later than all that win over them, so the last of them ends first."""
    points = sorted({r[0] for r in rows if r[3] & 1} | {r[1] for r in rows if r[3] & 2})
    out, open_, i = [], [], 0
    for a, b in zip(points, [*points[1:], after], strict=False):  # a bin of no points has no pieces
        while i < len(rows) and rows[i][0] <= a:
            while open_ and open_[-1][0] <= rows[i][1]:
                open_.pop()
            open_.append(rows[i][1:3])
            i += 1
        while open_ and open_[-1][0] <= a:
            open_.pop()
        if open_ and b is not None and b - a >= 1e-9:
            speaker = open_[-1][1]
            if out and out[-1][2] == speaker and abs(out[-1][1] - a) < EPS:
                out[-1] = (out[-1][0], b, speaker)
            else:
                out.append((a, b, speaker))
    return out


def _units(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[tuple]]]:
    """((key, bin), rows) of a sorted batch (key, bin, others)."""
    if not batch.num_rows:
        return
    group, bins = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes, keys = group.indices.to_numpy(), group.dictionary.to_pylist()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(bins) != 0)) + 1
    speaker = batch.column("speaker").dictionary_encode()
    names = np.array([*speaker.dictionary.to_pylist(), None], dtype=object)[speaker.indices.fill_null(len(speaker.dictionary)).to_numpy()]
    times = (c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in (batch.column("t0"), batch.column("t1")))
    rows = list(zip(*times, names.tolist(), batch.column("ends_in").to_numpy().tolist(), strict=True))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield (keys[codes[a]], int(bins[a])), rows[a:b]


def resolve_overlaps(df: DataFrame, key: str = KEY, size: float = BIN) -> DataFrame:
    """recording, idx, t0, t1, speaker: time cut at every turn's ends; each piece goes to the turn over it that began last, of those to
    the first by idx; touching pieces of one speaker join. Pieces under a nanosecond are skipped. size: seconds a bin, whose pieces are those that begin in it; the result doesn't depend on it.

    A turn goes to the bin where it begins and to the one where it ends. Of the turns over a whole bin only the last one can win there, so a bin takes one for all of them, and rows don't grow with the number of turns that overlap. A bin is swept in one task."""
    at = [key, "_bin"]
    turns = positive(_known(df)).where(F.col(key).isNotNull()).select(key, "idx", "t0", "t1", "speaker").withColumn("_from", _bin(F.col("t0"), size)).withColumn("_to", _bin(F.col("t1"), size))
    placed = turns.withColumn("_bin", F.explode(F.array_distinct(F.array("_from", "_to"))))
    later = F.struct("t0", -F.col("idx"))
    last = F.max_by(F.struct("idx", "t0", "t1", "speaker", "_from", "_to"), later).alias("last")
    spans = turns.where(F.col("_to") - F.col("_from") > 1).groupBy(key, "_from", "_to").agg(last)
    inner = spans.select(key, "last.*").withColumn("_bin", F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)))
    over = inner.groupBy(*at).agg(last).select(key, "last.*", "_bin")
    ends = turns.select(key, F.explode(F.array(F.struct(F.col("_from").alias("_bin"), F.col("t0").alias("a")), F.struct(F.col("_to").alias("_bin"), F.col("t1").alias("a")))).alias("e"))
    firsts = ends.groupBy(key, F.col("e._bin").alias("_bin")).agg(F.min("e.a").alias("a"))
    after = firsts.select(*at, F.lead("a").over(Window.partitionBy(key).orderBy("_bin")).alias("t1"))
    rows = placed.unionByName(over).unionByName(after, allowMissingColumns=True)
    order = [*at, F.col("t0").asc_nulls_first(), F.col("idx").desc_nulls_first(), "t1", "speaker"]
    dealt = rows.repartition(*at).sortWithinPartitions(*order).select(*at, "t0", "t1", "speaker", F.coalesce((F.col("_from") == F.col("_bin")).cast("int") + (F.col("_to") == F.col("_bin")).cast("int") * 2, F.lit(-1)).alias("ends_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, behind, schema = None, [], None, None
        for batch in chain(batches, [None]):
            out = []
            for unit, rows in _units(batch) if batch else [(None, [])]:
                if here != unit:
                    out += [(here[0], *piece) for piece in _resolved(own, behind)] if own else []
                    here, own, behind = unit, [], None
                if rows and rows[0][3] < 0:
                    behind, rows = rows[0][1], rows[1:]
                own += rows
            schema = batch.schema if batch else schema
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(c).type) for x, c in zip(zip(*out, strict=True), (key, "t0", "t1", "speaker"), strict=True)], names=[key, "t0", "t1", "speaker"])

    kinds = dict(turns.dtypes)
    pieces = dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, "t0", "t1", "speaker")))
    ranked = pieces.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("t0")).cast("long"))
    return merge_touching(ranked, key)


def absorb_short(df: DataFrame, max_dur: float, key: str = KEY) -> DataFrame:
    """recording, idx, t0, t1, speaker: turns, in the order of (t0, t1, idx), under max_dur long go into their left neighbour, then what is
    still short into its right one; touching turns of one speaker join. A turn of max_dur or longer always stays and takes the short ones behind it, so these are groups; the short ones
    before the first such turn join the first of them, and only that one can still be short for the way back."""
    turns = _known(df).select(key, "idx", "t0", "t1", "speaker")
    order = Window.partitionBy(key).orderBy("t0", "t1", "idx")
    stays = F.when((F.row_number().over(order) == 1) | (F.col("t1") - F.col("t0") >= max_dur), 1).otherwise(0)
    grouped = turns.withColumn("stays", stays).withColumn("place", F.sum("stays").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    forth = grouped.groupBy(key, "place").agg(F.min(F.struct("t0", "t1", "idx", "speaker")).alias("first"), F.max("t1").alias("t1"))
    rows = forth.select(key, "place", F.col("first.t0").alias("t0"), "t1", F.col("first.speaker").alias("speaker"))
    place = Window.partitionBy(key).orderBy("place")
    short = F.col("t1") - F.col("t0") < max_dur
    marked = rows.withColumn("gone", short & (F.col("place") == 1) & F.lead("place").over(place).isNotNull()).withColumn("before", F.when(F.lag("gone").over(place), F.lag("t0").over(place)))
    back = marked.where("not gone").select(key, F.col("place").alias("idx"), F.least("t0", "before").alias("t0"), "t1", "speaker")
    return merge_touching(back, key)


def refine_boundaries(df: DataFrame, max_intrusion: float = 0.18, padding: float = 0.04, min_segment: float = 0.12, gap: float = 0.25, key: str = KEY) -> DataFrame:
    """Intrusions absorbed, turns padded, overlapping ones of a speaker joined, short ones absorbed or dropped, near ones of a speaker joined."""
    turns = merge_same_speaker(pad(absorb_short(df, max_intrusion, key), padding), 0.0, key=key)
    return merge_same_speaker(at_least(absorb_short(turns, min_segment, key), 0.5 * min_segment), gap, key=key)


def postprocess_turns(df: DataFrame, gap: float = 0.4, key: str = KEY) -> DataFrame:
    """Overlaps resolved, near turns of a speaker joined, boundaries refined, and joined again."""
    turns = merge_same_speaker(resolve_overlaps(df, key), gap, key=key)
    return merge_same_speaker(refine_boundaries(turns, key=key), gap, key=key)


def clip(df: DataFrame, vad: DataFrame, min_len: float = 0.12, key: str = KEY, size: float = BIN) -> DataFrame:
    """Each row's common time with every interval of `vad` (recording, t0, t1) in its recording, if min_len or longer. Rows of
    recordings that `vad` doesn't have stay as they are. size: seconds a bin of the range join; a pair counts in the bin where its common time begins."""
    spans = _known(vad).select(F.col(key).alias("vad_key"), F.col("t0").alias("v0"), F.col("t1").alias("v1"))
    rows = _known(df)
    left, right = _bins(rows.where("t1 >= t0"), "t0", "t1", size), _bins(spans.where("v1 >= v0"), "v0", "v1", size).withColumnRenamed("_bin", "_vad_bin")
    inside = left.join(right, (left[key] == F.col("vad_key")) & (F.col("_bin") == F.col("_vad_bin"))).where((F.col("t0") < F.col("v1")) & (F.col("t1") > F.col("v0"))).where(_bin(F.greatest("t0", "v0"), size) == F.col("_bin"))
    clipped = inside.withColumn("t0", F.greatest("t0", "v0")).withColumn("t1", F.least("t1", "v1")).drop("vad_key", "v0", "v1", "_bin", "_vad_bin")
    free = rows.join(spans.select("vad_key").distinct(), rows[key] == F.col("vad_key"), "left_anti")
    return at_least(clipped, min_len).unionByName(free)


def _next_kept(ends: np.ndarray, min_len: float) -> list[int]:
    """For each turn the first one behind it that ends min_len or more after it, or -1. From the last to the first, with the turns that nothing behind them overtakes at hand, the nearest last: their ends ascend with their distance."""
    out, ahead = [-1] * len(ends), []
    for j in range(len(ends) - 1, -1, -1):
        low, high = 0, len(ahead)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if ends[ahead[middle]] - ends[j] >= min_len else (low, middle)
        out[j] = ahead[low - 1] if low else -1
        while ahead and ends[ahead[-1]] <= ends[j]:
            ahead.pop()
        ahead.append(j)
    return out


def _exits(ends: np.ndarray, min_len: float) -> tuple[list[float], list[float]]:
    """Where the last kept turn of a slice ends, by where the last one before it ended: for turns that end later than all before them, the ends, and the exits when such a turn is the first one kept. Of neighbours with one exit the last stands for all."""
    follow, exits = _next_kept(ends, min_len), np.array(ends, float)
    for j in range(len(ends) - 1, -1, -1):
        if follow[j] >= 0:
            exits[j] = exits[follow[j]]
    record = np.flatnonzero(ends > np.concatenate([[-np.inf], np.maximum.accumulate(ends)[:-1]]))
    last = [i for i, j in enumerate(record) if i + 1 == len(record) or exits[record[i + 1]] != exits[j]]
    return ends[record[last]].tolist(), exits[record[last]].tolist()


def flatten(df: DataFrame, min_len: float = 0.12, key: str = KEY, rows: int = SLICE) -> DataFrame:
    """recording, t0, t1, speaker without overlap: in the order of (t0, t1, speaker) a turn begins where the last kept one ended and is kept if it then has min_len.

    Which turn is kept next depends on the last kept end alone, so a slice of turns is a step function from the end before it to the end behind it, and chains from different ends soon meet, so that function has few steps. Slices are folded in
    parallel once their ends are known; recordings may be of any length. The result doesn't depend on `rows`, those of a slice. Turns under min_len can't be kept and go first. The sorted turns are written to the shared folder at once."""
    turns = _known(df).where(F.col("t1") - F.col("t0") >= min_len).select(key, "t0", "t1", "speaker")
    cut = sliced(turns, ["t0", "t1", "speaker"], key, rows)
    kinds = dict(cut.dtypes)

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        reach, exits = _exits(part.sort_values("place")["t1"].to_numpy(), min_len)
        return pd.DataFrame({key: part[key].iloc[:1], "slice": part["slice"].iloc[:1], "reach": [reach], "exits": [exits]})

    def behind(end, row):
        entry = 0 if end is None else next((i for i, x in enumerate(row.reach) if x - end >= min_len), -1)
        return end if entry < 0 else float(row.exits[entry])

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        end, keep, starts = part["state"].iloc[0], [], []
        end = -np.inf if pd.isna(end) else end
        for i, (t0, t1) in enumerate(zip(part["t0"], part["t1"], strict=True)):
            start = max(t0, end)
            if t1 - start >= min_len:
                keep.append(i)
                starts.append(start)
                end = t1
        kept = part.iloc[keep]
        return pd.DataFrame({key: kept[key], "t0": starts, "t1": kept["t1"], "speaker": kept["speaker"]})

    sums = cut.groupBy("slice").applyInPandas(summed, f"{key} {kinds[key]}, slice long, reach array<double>, exits array<double>")
    ends = carried(sums, behind, "double", key)
    return cut.join(ends, "slice").groupBy("slice").applyInPandas(folded, f"{key} {kinds[key]}, t0 double, t1 double, speaker {kinds['speaker']}")


def speech_chunks(df: DataFrame, cuts: str = "cuts", max_len: float = 20.0, margin: float = 1.5) -> DataFrame:
    """Rows tiled into chunks of up to max_len, adds `part`: cut at the last of the row's ascending silence points (array `cuts`) that leaves `margin` on
    both sides of a chunk, else after max_len. A fold: every cut depends on the one before."""
    done = "struct<at:double,out:array<struct<t0:double,t1:double>>>"
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / F.lit(float(margin))).cast("int") + 1))

    def step(acc: Column, _: Column) -> Column:
        hard = acc["at"] + F.lit(float(max_len))
        fit = F.array_max(F.filter(F.coalesce(F.col(cuts), F.array().cast("array<double>")), lambda c: (c > acc["at"] + margin) & (c <= hard - margin)))
        stop = F.when(F.col("t1") - acc["at"] <= max_len + EPS, F.col("t1")).otherwise(F.coalesce(fit, hard))
        grown = F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("t0"), stop.alias("t1")))).alias("out"))
        return F.when(acc["at"] >= F.col("t1") - EPS, acc).otherwise(grown).cast(done)

    start = F.struct(F.col("t0").alias("at"), F.array().cast("array<struct<t0:double,t1:double>>").alias("out")).cast(done)
    chunks = _known(df).withColumn("chunk", F.aggregate(steps, start, step)["out"])
    exploded = chunks.select("*", F.posexplode("chunk").alias("part", "piece"))
    return exploded.withColumn("t0", F.col("piece.t0")).withColumn("t1", F.col("piece.t1")).drop("chunk", "piece")


def silence_points(frames: DataFrame, min_silence: float = 0.28, hop: float = 0.01, frame: float = 0.02, margin: float = 0.15, key: str = KEY) -> DataFrame:
    """recording, idx, cuts: middles of silences in each turn. frames: recording, idx (turn), t0, t1, frame_idx, rms. A frame is silent under the
    larger of the turn's first quartile and 0.35 of its mean; runs of min_silence or longer count, if inside the margins."""
    turn = Window.partitionBy(key, "idx")
    level = F.greatest(F.percentile("rms", F.lit(0.25)).over(turn), 0.35 * F.avg("rms").over(turn))
    silent = frames.withColumn("level", level).where("rms < level")
    runs = silent.withColumn("run", F.col("frame_idx") - F.row_number().over(turn.orderBy("frame_idx")))
    found = runs.groupBy(key, "idx", "t0", "t1", "run").agg(F.min("frame_idx").alias("start"), F.count("*").alias("n")).where(F.col("n") * hop >= min_silence)
    middle = F.col("t0") + (F.col("start") + F.floor(F.col("n") / 2)) * hop + 0.5 * frame
    points = found.withColumn("cut", middle).where((F.col("cut") > F.col("t0") + margin) & (F.col("cut") < F.col("t1") - margin))
    return points.groupBy(key, "idx").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def word_envelope(df: DataFrame, first_last: bool = False) -> DataFrame:
    """t0 and t1 from an array `words` of (start, end): least start and largest end, or the first word's start and the last one's end; rows without words stay."""
    if first_last:
        low, high = F.get("words", F.lit(0))["start"], F.get("words", F.size("words") - 1)["end"]
    else:
        low, high = F.array_min(F.transform("words", lambda w: w["start"])), F.array_max(F.transform("words", lambda w: w["end"]))
    return df.withColumn("t0", F.coalesce(low, "t0")).withColumn("t1", F.coalesce(high, "t1"))
