"""Operators on activity masks: rows (recording, chunk, frame, spk, p), p the probability that a chunk's local speaker talks in a frame.

Chunks are the unit of work: windows and groups are keyed by recording and chunk, whose frames are bounded by the chunk's length.
Null and NaN probabilities count as 0; an empty table gives none; other columns are ignored unless stated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "recording"
#: Fixed values of the exclusive region: on, margin over others, fewest frames, what is added to `on` where there are fewer; and of the overlap test: strong, share, least run and its share of a chunk.
ON, MARGIN, FEWEST, MORE = 0.35, 0.10, 5, 0.10
STRONG, OVERLAP, LEAST_RUN, RUN_SHARE = 0.35, 0.20, 3, 0.03
#: Fixed values of the path search.
FLOOR, STAY, STAY_OVERLAP, SWITCH, SILENCE, MIN_ON = 1e-6, 1.4, 1.2, 0.2, 0.6, 0.10
#: Posteriors in the arrays of a path search.
CELLS = 1 << 20


def _clean(frames: DataFrame) -> DataFrame:
    return frames.withColumn("p", F.coalesce(F.nanvl(F.col("p").cast("double"), F.lit(0.0)), F.lit(0.0)))


def exclusive_region(frames: DataFrame, key: str = KEY) -> DataFrame:
    """Adds other (the largest p of the frame's other speakers, 0 if there are none) and keep: own p is ON or more and MARGIN above the others'; where that holds for fewer than FEWEST
    frames of a speaker's chunk, own p is ON + MORE or more instead."""
    ranked = F.sort_array(F.collect_list("p").over(Window.partitionBy(key, "chunk", "frame")), asc=False)
    other = F.coalesce(F.when(F.col("p") == ranked[0], F.get(ranked, F.lit(1))).otherwise(ranked[0]), F.lit(0.0))
    marked = _clean(frames).withColumn("other", other).withColumn("sole", (F.col("p") >= ON) & (F.col("p") - F.col("other") >= MARGIN))
    enough = F.count_if("sole").over(Window.partitionBy(key, "chunk", "spk")) >= FEWEST
    return marked.withColumn("keep", F.when(enough, F.col("sole")).otherwise(F.col("p") >= ON + MORE)).drop("sole")


def usable_runs(frames: DataFrame, key: str = KEY) -> DataFrame:
    """recording, chunk, spk, first, n, overlap: of each speaker's chunk the longest run of kept frames (`exclusive_region`), the first of equal ones, if it has LEAST_RUN frames and RUN_SHARE of the
    chunk's and others are STRONG in less than OVERLAP of it."""
    unit = [key, "chunk", "spk"]
    marked = exclusive_region(frames, key)
    size = marked.groupBy(key, "chunk").agg(F.count_distinct("frame").alias("frames"))
    numbered = marked.where("keep").withColumn("run", F.col("frame") - F.row_number().over(Window.partitionBy(*unit).orderBy("frame")))
    runs = numbered.groupBy(*unit, "run").agg(F.min("frame").alias("first"), F.count("*").alias("n"), F.avg((F.col("other") >= STRONG).cast("double")).alias("overlap"))
    best = runs.groupBy(*unit).agg(F.max_by(F.struct("first", "n", "overlap"), F.struct("n", -F.col("first"))).alias("b")).select(*unit, "b.*")
    least = F.greatest(F.lit(LEAST_RUN), F.floor(F.col("frames") * RUN_SHARE))
    return best.join(size, [key, "chunk"]).where((F.col("n") >= least) & (F.col("overlap") < OVERLAP)).drop("frames")


def clustered(frames: DataFrame, clusters: DataFrame, key: str = KEY) -> DataFrame:
    """recording, chunk, frame, cluster, p: the largest p of the local speakers of each cluster. clusters: recording, chunk, spk, cluster; null means inactive."""
    named = clusters.where("cluster is not null").select(key, "chunk", "spk", "cluster")
    return _clean(frames).join(named, [key, "chunk", "spk"]).groupBy(key, "chunk", "frame", "cluster").agg(F.max("p").alias("p"))


def capped(counts: DataFrame, overlap: Column | None = None) -> DataFrame:
    """`count` of simultaneous speakers, at most 1 unless `overlap` holds."""
    one = F.least("count", F.lit(1))
    return counts.withColumn("count", one if overlap is None else F.when(overlap, F.col("count")).otherwise(one))


def reconstructed(frames: DataFrame, clusters: DataFrame, counts: DataFrame, step: int, key: str = KEY) -> DataFrame:
    """recording, at, cluster: who is active in each frame of a recording. Chunks begin `step` frames apart; a cluster's p is summed over the chunks that cover a frame, and as many clusters as `counts`
    (recording, at, count) says are active, those of largest sums, the first of equal ones."""
    summed = clustered(frames, clusters, key).groupBy(key, (F.col("chunk") * step + F.col("frame")).alias("at"), "cluster").agg(F.sum("p").alias("p"))
    ranked = summed.withColumn("place", F.row_number().over(Window.partitionBy(key, "at").orderBy(F.desc("p"), "cluster")))
    return ranked.join(counts.select(key, "at", "count"), [key, "at"]).where("place <= count and p > 0").select(key, "at", "cluster")


def gains(states: int, overlap: bool) -> np.ndarray:
    """What a move from state a to state b adds to a path's score; the last state is silence. Staying silent is free. Every other move gains the switch bias, less the stay bias if the state changes and less the silence bias if one of both is silence."""
    a, b = np.ogrid[:states, :states]
    silent = (a == states - 1).astype(int) + (b == states - 1)
    return np.where(silent == 2, 0.0, SWITCH - (STAY_OVERLAP if overlap else STAY) * (a != b) - SILENCE * silent)


def best_paths(posterior: np.ndarray, overlap: bool = False) -> np.ndarray:
    """The states (chunk, frame) on the paths of largest log score, of chunks of equal length: posterior (chunk, frame, cluster), states are the K clusters and silence (K). All chunks move from frame to frame together; on the way back the state
    before is the one from which the score of the next was reached, the lower of equal ones."""
    silence = 1 - posterior.max(axis=2, initial=0.0)
    shown = np.log(np.clip(np.concatenate([posterior, silence[:, :, None]], axis=2), FLOOR, 1))
    gain = gains(shown.shape[2], overlap)
    reached = [shown[:, 0]]
    for frame in range(1, shown.shape[1]):
        reached.append((reached[-1][:, :, None] + gain).max(axis=1) + shown[:, frame])
    path = [reached[-1].argmax(axis=1)]
    for score in reached[-2::-1]:
        path.append((score + gain.T[path[-1]]).argmax(axis=1))
    return np.stack(path[::-1], axis=1)


def best_path(posterior: np.ndarray, overlap: bool = False) -> np.ndarray:
    """`best_paths` of one chunk (frame, cluster)."""
    return best_paths(posterior[None], overlap)[0]


def _path_turns(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Turns of a batch of chunks, a row each (recording, chunk, k, start, end, offset, overlap, ascending frames, and cells: the arrays at, cluster, p). Paths of chunks of one form are searched together, CELLS of posteriors at a time."""
    frames, at = batch.column("frames"), batch.column("at")
    n, m = (pc.list_value_length(x).to_numpy() for x in (frames, at))
    k, overlap = batch.column("k").to_numpy(), batch.column("overlap").to_numpy(zero_copy_only=False)
    start, end, offset = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "offset"))
    known, rank = np.unique(frames.flatten().to_numpy(), return_inverse=True)
    row, owner = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    place = np.searchsorted(row * len(known) + rank, owner * len(known) + np.searchsorted(known, at.flatten().to_numpy())) - (np.cumsum(n) - n)[owner]
    cluster, p, first = batch.column("cluster").flatten().to_numpy(), batch.column("p").flatten().to_numpy(), np.cumsum(m) - m
    forms, form = np.unique(np.stack([n, k, overlap.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    out = []
    for f, (size, states, both) in enumerate(forms.tolist()):
        alike, step = np.flatnonzero(form.ravel() == f), max(1, CELLS // (size * (states + 1)))
        for own in (alike[i : i + step] for i in range(0, len(alike), step) if size > 1):
            cells = np.repeat(first[own] - np.cumsum(m[own]) + m[own], m[own]) + np.arange(m[own].sum())
            posterior = np.zeros((len(own), size, states))
            np.maximum.at(posterior, (np.repeat(np.arange(len(own)), m[own]), place[cells], cluster[cells]), p[cells])
            path = best_paths(posterior, bool(both))
            cut = np.concatenate([np.ones((len(own), 1), bool), path[:, 1:] != path[:, :-1]], axis=1)
            chunk, begin = np.nonzero(cut)
            stop = np.where(np.append(chunk[1:] != chunk[:-1], True), size, np.append(begin[1:], size))
            here, state = own[chunk], path[chunk, begin]
            t0, t1 = (start[here] + x * (end[here] - start[here]) / size for x in (begin, stop))
            kept = (state != states) & (t1 - t0 >= MIN_ON)
            out.append((here[kept], (t0 + offset[here])[kept], (t1 + offset[here])[kept], state[kept]))
    here, t0, t1, state = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), *[np.zeros(0)] * 2, np.zeros(0, np.int64))
    ids = [batch.column(i).take(pa.array(here, pa.int64())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*ids, pa.array(t0), pa.array(t1), pa.array(state, pa.int64())], names=[*batch.schema.names[:2], "t0", "t1", "cluster"])


def resegmented(frames: DataFrame, clusters: DataFrame, chunks: DataFrame, key: str = KEY) -> DataFrame:
    """recording, chunk, t0, t1, cluster: turns on each chunk's best path, those of MIN_ON seconds or more. chunks: recording, chunk, start, end, offset (of its window), overlap. A chunk of one frame has no
    turns. Chunks are independent and bounded, so each is one row, with its frames and its clusters' p as arrays, and the paths of many rows are searched at once."""
    unit, spans = [key, "chunk"], ("start", "end", "offset")
    named = clusters.where("cluster is not null").select(*unit, "spk", F.col("cluster").cast("long").alias("cluster"))
    shown = _clean(frames).where("frame is not null").select(*unit, "frame", "spk", "p").join(named, [*unit, "spk"], "left")
    cells = F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct(F.col("frame").alias("at"), "cluster", "p")))
    held = shown.groupBy(*unit).agg(F.sort_array(F.collect_set("frame")).alias("frames"), cells.alias("cells"))
    known = shown.groupBy(key).agg((F.max("cluster") + 1).alias("k")).where("k is not null")
    of_chunk = F.struct(*(F.col(c).cast("double").alias(c) for c in spans), F.coalesce(F.col("overlap").cast("boolean"), F.lit(False)).alias("overlap"))
    rows = held.join(chunks.groupBy(*unit).agg(F.min(of_chunk).alias("of")), unit).join(known, key).select(*unit, "k", "of.*", "frames", "cells.at", "cells.cluster", "cells.p")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda batches: map(_path_turns, batches), f"{key} {kinds[key]}, chunk {kinds['chunk']}, t0 double, t1 double, cluster long")


def masked(samples: Column, mask: Column) -> Column:
    """Samples (an array) times the mask of their chunk's frames, read between the frames' middles by straight lines and held at the ends."""
    frames, n = F.size(mask), F.size(samples)

    def weight(i: Column) -> Column:
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0) * (frames - 1), i * frames / n - 0.5))
        low = F.floor(at).cast("int")
        return F.get(mask, low) * (1 - (at - low)) + F.get(mask, F.least(low + 1, frames - 1)) * (at - low)

    return F.transform(samples, lambda x, i: x * F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight(i))))


def maskable(mask: Column) -> Column:
    """Whether a mask is on (over 0.25) in three frames and in a twentieth of them."""
    return F.size(F.filter(mask, lambda p: p > 0.25)) >= F.greatest(F.lit(3), F.floor(F.size(mask) * 0.05).cast("int"))
