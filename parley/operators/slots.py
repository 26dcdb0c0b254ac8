"""Slots for models that work on one recording at a time, so that a recording on which one fails doesn't fail the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "recording"


def guarded(df: DataFrame, run: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], out: str, key: str = KEY) -> DataFrame:
    """recording, the columns `out` (DDL) of what run(rows of a recording) yields, and error. Where run raises, the rows yielded before stay, and one more row has the error's type and message and nulls besides. A recording that gives
    neither rows nor an error has no row. A recording's rows meet in one task, as the model needs them."""
    names = [x.split()[0] for x in out.split(",")]

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        parts, failed = [], []
        try:
            parts.extend(part[names].assign(error=None) for part in run(rows))
        except Exception as e:  # whatever the model raises is this recording's result
            failed.append(pd.DataFrame({**{name: [None] for name in names}, "error": [f"{type(e).__name__}: {e}"]}))
        whole = [p.astype(object) for p in (*parts, *failed) if len(p)]
        found = pd.concat(whole, ignore_index=True) if whole else pd.DataFrame(columns=[*names, "error"])
        found.insert(0, key, pd.Series([rows[key].iloc[0]] * len(found), dtype=object))
        return found

    return df.groupBy(key).applyInPandas(call, f"{key} {dict(df.dtypes)[key]}, {out}, error string")


def statuses(results: DataFrame, key: str = KEY) -> DataFrame:
    """recording, status ("ok" or "error"), turns (rows that stay), error: of each recording that `guarded` gave rows of."""
    turns = F.count_if(F.col("error").isNull())
    return results.groupBy(key).agg(F.when(F.count("error") > 0, "error").otherwise("ok").alias("status"), turns.alias("turns"), F.max("error").alias("error"))
