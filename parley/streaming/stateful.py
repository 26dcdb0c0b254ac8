"""Streams of turns and of speech frames with event-time state: what is certain once the watermark has passed is emitted once.

Both operators use `transformWithStateInPandas`, which needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import stripped

_TURN = "recording string, start long, end long, text string, speaker string, seq long, place long"


class _Best(StatefulProcessor):
    """Of the rows of a turn the one to keep, until the watermark has passed the last of them by `hold` ms."""

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "speaker string, seq long, place long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.best.get() if self.best.exists() else None
        timer = best[3] if best else -1
        best = tuple(best[:3]) if best else None
        latest = timer
        for part in rows:
            for speaker, seq, at in zip(part["speaker"], part["seq"].tolist(), part["ts"], strict=True):
                better = best is None or (bool(speaker), seq) >= (bool(best[0]), best[1])
                place = seq if best is None else min(best[2], seq)
                best = (speaker or "", seq, place) if better else (best[0], best[1], place)
                latest = max(latest, int(at.timestamp() * 1000) + self.hold)
        if latest != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest)
        self.best.update((*best, latest))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        speaker, seq, place, _ = self.best.get()
        self.best.clear()
        yield pd.DataFrame([(*key, speaker, seq, place)], columns=[x.split()[0] for x in _TURN.split(", ")])

    def close(self) -> None:
        pass


def deduplicated_by_time(turns: DataFrame, watermark: str = "10 seconds", hold: str = "1 minute") -> DataFrame:
    """`turns.deduplicated` of a stream of (recording, start, end, text, speaker, seq, ts), in append mode: the best row of each (recording, start, end, trimmed text) once, when the watermark has passed the latest of its rows by
    `hold`. Rows that come late within watermark and hold count. A turn's state is four values, and goes with its timer."""
    ms = int(pd.Timedelta(hold).total_seconds() * 1000)
    rows = turns.select(F.col("recording").cast("string").alias("recording"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), stripped(F.col("text")).alias("text"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("seq").cast("long").alias("seq"), "ts")
    grouped = rows.withWatermark("ts", watermark).groupBy("recording", "start", "end", "text")
    return grouped.transformWithStateInPandas(_Best(ms), _TURN, "append", "eventtime")


@dataclass(frozen=True)
class Endpoint:
    """A frame is speech from `voice` on; a turn ends after `least` ms of silence if the model is `sure` of it, and after `most` ms in any case. frame: ms that a frame lasts."""

    voice: float = 0.4
    sure: float = 0.25
    least: int = 250
    most: int = 1280
    frame: int = 20


#: start and end of the speech of an open turn (-1: none is open), number of the next turn.
State = tuple[int, int, int]
CLOSED: State = (-1, -1, 0)


def listened(state: State, t: int, voice: float | None, confidence: float | None, how: Endpoint) -> tuple[State, tuple | None]:
    """The state after a frame that begins at t ms, and the turn (number, start, end, reason) that it ends. Time without frames is silence."""
    start, end, number = state
    ended = None
    if start >= 0 and t - end >= how.most:  # the frames between are missing
        ended, start, number = (number, start, end, "silence"), -1, number + 1
    if voice is not None and voice >= how.voice:
        return ((start if start >= 0 else t), max(end, t + how.frame) if start >= 0 else t + how.frame, number), ended
    if start >= 0:
        quiet = t + how.frame - end
        if quiet >= how.most or quiet >= how.least and confidence is not None and confidence >= how.sure:
            ended, start, number = (number, start, end, "silence" if quiet >= how.most else "confidence"), -1, number + 1
    return (start, end, number), ended


_ENDED = "recording string, number long, start long, end long, reason string"


class _Listener(StatefulProcessor):
    def __init__(self, how: Endpoint) -> None:
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "start long, end long, number long, timer long")

    def _keep(self, state: State, timer: int) -> None:
        """An open turn has a timer for when it must have ended."""
        wanted = state[1] + self.how.most if state[0] >= 0 else -1
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wanted >= 0:
                self.handle.registerTimer(wanted)
        self.now.update((*state, wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *state, timer = self.now.get() if self.now.exists() else (*CLOSED, -1)
        state, out = tuple(state), []
        for t, voice, confidence in pd.concat(rows)[["t", "voice", "confidence"]].sort_values("t").itertuples(index=False):
            state, ended = listened(state, int(t), None if pd.isna(voice) else voice, None if pd.isna(confidence) else confidence, self.how)
            if ended:
                out.append((key[0], *ended))
        self._keep(state, timer)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ENDED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end, number, timer = self.now.get()
        if start >= 0 and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.now.update((-1, -1, number + 1, -1))
            yield pd.DataFrame([(key[0], number, start, end, "silence")], columns=[x.split()[0] for x in _ENDED.split(", ")])

    def close(self) -> None:
        pass


def end_of_turns(frames: DataFrame, how: Endpoint = Endpoint(), watermark: str = "0 seconds") -> DataFrame:
    """recording, number, start, end (ms), reason of each turn of a stream of frames (recording, t: ms since the epoch, voice: probability of speech, confidence: that the turn has ended), once, in append mode. Frames of a recording must come in
    order from batch to batch; in a batch they may stand in any. A recording of which nothing more comes ends its last turn when the watermark of all has passed its longest silence. State: four numbers a recording."""
    rows = frames.select(F.col("recording").cast("string").alias("recording"), F.col("t").cast("long").alias("t"), F.col("voice").cast("double").alias("voice"), F.col("confidence").cast("double").alias("confidence"))
    timed = rows.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", watermark)
    return timed.groupBy("recording").transformWithStateInPandas(_Listener(how), _ENDED, "append", "eventtime")


def end_of_turns_batch(frames: DataFrame, how: Endpoint = Endpoint()) -> DataFrame:
    """`end_of_turns` of a table whose recordings are over: an open turn ends with reason "over"."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = CLOSED, []
        for t, voice, confidence in rows[["t", "voice", "confidence"]].sort_values("t").itertuples(index=False):
            state, ended = listened(state, int(t), None if pd.isna(voice) else voice, None if pd.isna(confidence) else confidence, how)
            out += [ended] if ended else []
        if state[0] >= 0:
            out.append((state[2], state[0], state[1], "over"))
        return pd.DataFrame([(rows["recording"].iloc[0], *x) for x in out], columns=[x.split()[0] for x in _ENDED.split(", ")])

    rows = frames.select(F.col("recording").cast("string").alias("recording"), F.col("t").cast("long").alias("t"), F.col("voice").cast("double").alias("voice"), F.col("confidence").cast("double").alias("confidence"))
    return rows.groupBy("recording").applyInPandas(run, _ENDED)
