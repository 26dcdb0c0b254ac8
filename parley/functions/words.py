"""Times and words: units, offsets, and payloads of utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T

_WORD = "array<struct<text:string,start:int,end:int,confidence:double,speaker:string>>"


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, halves away from zero."""
    return F.round(seconds * 1000.0).cast("int")


def to_seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def shifted(df: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """t0 and t1 moved by their window's start. windows: keys and `w0`. Rows whose window isn't there go."""
    return df.join(windows.select(*keys, "w0"), keys).withColumn("t0", F.col("t0") + F.col("w0")).withColumn("t1", F.col("t1") + F.col("w0")).drop("w0")


def absolute(words: Column, chunk_start: Column, speaker: Column) -> Column:
    """Words (structs of text, start, end, confidence; seconds from their chunk's start) in milliseconds of the recording, with their speaker. Words without a start are
    dropped; a missing end is the start. Null words give none."""
    kept = F.filter(F.coalesce(words, F.array()), lambda w: w["start"].isNotNull())

    def one(w: Column) -> Column:
        start = chunk_start + w["start"]
        end = F.coalesce(chunk_start + w["end"], start)
        return F.struct(w["text"].alias("text"), to_ms(start).alias("start"), to_ms(end).alias("end"), w["confidence"].alias("confidence"), speaker.alias("speaker"))

    return F.transform(kept, one).cast(_WORD)


def single_speaker(df: DataFrame, speaker: str = "—") -> DataFrame:
    """Replaces text and words by one utterance: speaker, normalised text, no confidence, start, end and words in milliseconds; missing word times are 0; without words start and end are 0."""

    def one(w: Column) -> Column:
        time = lambda x: F.coalesce(to_ms(x), F.lit(0))
        return F.struct(w["text"].alias("text"), time(w["start"]).alias("start"), time(w["end"]).alias("end"), w["confidence"].alias("confidence"), F.lit(speaker).alias("speaker"))

    words = F.transform(F.coalesce("words", F.array()), one).cast(_WORD)
    told = df.withColumn("words", words).withColumn("text", T.normalised(F.coalesce("text", F.lit("")))).withColumn("speaker", F.lit(speaker)).withColumn("confidence", F.lit(None).cast("double"))
    bound = lambda agg, part: F.coalesce(agg(F.transform("words", lambda w: w[part])), F.lit(0))
    return told.withColumn("start", bound(F.array_min, "start")).withColumn("end", bound(F.array_max, "end"))
