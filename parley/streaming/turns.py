"""Turn events: what a live transcript keeps of them, in batch and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from parley.functions.text import stripped


def final(events: DataFrame) -> DataFrame:
    """Events that end a turn and have text."""
    return events.where(F.col("end_of_turn") & (stripped(F.col("transcript")) != ""))


def confidence(events: DataFrame) -> DataFrame:
    """Adds the mean confidence of the words, 0 without words, and stamps words with the turn's label where it has one."""
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"])
    label = F.nullif(F.col("speaker_label"), F.lit(""))
    stamped = F.transform("words", lambda w: w.withField("speaker", F.coalesce(label, w["speaker"])))
    return events.withColumn("confidence", F.coalesce(F.when(F.size("words") > 0, total / F.size("words")), F.lit(0.0))).withColumn("words", stamped)


def deduplicated(turns: DataFrame, key: str = "recording") -> DataFrame:
    """One row for each (start, end, trimmed text): a labelled one before others, of those the last by seq; adds `place`, the group's first seq."""
    group = Window.partitionBy(key, "start", "end", stripped(F.col("text")))
    best = F.row_number().over(group.orderBy(F.desc(F.coalesce("speaker", F.lit("")) != ""), F.desc("seq")))
    return turns.withColumn("place", F.min("seq").over(group)).withColumn("_best", best).where("_best = 1").drop("_best")


def sessions(events: DataFrame, gap: str, watermark: str, key: str = "recording") -> DataFrame:
    """An extension: sessions of a stream of (recording, ts) events that a silence of `gap` ends, late events up to `watermark` counted."""
    return events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_KEPT = "recording string, start long, end long, text string, speaker string, seq long, place long"


def deduplicated_stream(turns: DataFrame, forget_after: str = "1 hour") -> DataFrame:
    """An extension: `deduplicated` of a stream of (recording, start, end, text, speaker, seq), in update mode: a row each time a turn's best row changes, so the last one of a (recording, start, end, text)
    is the batch result. A turn's state, three values, is forgotten after so long without an event of it; one that comes later counts as new."""
    ms = int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = best = state.get if state.exists else None
        for part in parts:
            for speaker, seq in zip(part["speaker"], part["seq"].tolist(), strict=True):
                place = seq if best is None else min(best[2], seq)
                better = best is None or (bool(speaker), seq) >= (bool(best[0]), best[1])
                best = (speaker or "", seq, place) if better else (best[0], best[1], place)
        state.update(best)
        state.setTimeoutDuration(ms)
        if best != old:
            yield pd.DataFrame([(*key, *best)], columns=["recording", "start", "end", "text", "speaker", "seq", "place"])

    rows = turns.select(F.col("recording").cast("string").alias("recording"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), stripped(F.col("text")).alias("text"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("recording", "start", "end", "text").applyInPandasWithState(run, _KEPT, "speaker string, seq long, place long", "update", GroupStateTimeout.ProcessingTimeTimeout)
