"""Text functions on columns and rows of transcripts."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; there is no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: White space at either end, of every kind that Python's str.strip() removes.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; `trim` takes only blanks."""
    return F.regexp_replace(text, _ENDS, "")


def normalised(text: Column, compose: bool = True) -> Column:
    """NFC, no-break blanks as blanks, three or more of one of . , ! ? ; : … - — cut to two, white space as one blank, stripped."""
    composed = nfc(text) if compose else text
    plain = F.replace(composed, F.lit(" "), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"([.,!?;:…\-—])\1{2,}", "$1$1"), r"(?U)\s+", " "))


def joined(texts: Column) -> Column:
    """Texts that aren't blank, by one blank."""
    return F.array_join(F.filter(F.transform(texts, stripped), lambda t: t != ""), " ")


def indexed(rows: DataFrame, key: str = "recording") -> DataFrame:
    """Adds `id`, from 1 by the original place idx, then drops rows without times or text, and adds duration_sec."""
    numbered = rows.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("idx")))
    good = numbered.where("t0 is not null and t1 is not null").where(stripped(F.coalesce("text", F.lit(""))) != "")
    return good.withColumn("duration_sec", F.round(F.col("t1") - F.col("t0"), 3))


def share_times(parts: DataFrame, key: list[str], total: Column) -> DataFrame:
    """Adds start and end: `total` seconds shared out to rows (part, text) of a key by their number of characters, in the order of part; evenly if there are none."""
    order = Window.partitionBy(*key).orderBy("part")
    whole = Window.partitionBy(*key)
    chars = F.length(F.coalesce("text", F.lit("")))
    counted = parts.withColumn("_n", chars).withColumn("_all", F.sum("_n").over(whole)).withColumn("_rows", F.count("*").over(whole))
    weight = F.when(F.col("_all") > 0, F.col("_n") / F.col("_all")).otherwise(1.0 / F.col("_rows"))
    reached = F.when(F.col("_all") > 0, F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all")).otherwise(F.row_number().over(order) / F.col("_rows"))
    return counted.withColumn("end", reached * total).withColumn("start", (reached - weight) * total).drop("_n", "_all", "_rows")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts, stripped and in lower case: twice the length of their matching blocks over both lengths (Ratcliff and Obershelp), 1 for two blank ones, 0 for one
    blank one. Null counts as blank. No built-in has it: `levenshtein` is another measure."""

    def one(x: str | None, y: str | None) -> float:
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        return float(x == y) if not x or not y else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def transcript(rows: DataFrame, key: str = "recording") -> DataFrame:
    """recording, text: each recording's texts that aren't blank, a line each, in the order of idx."""
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: stripped(F.coalesce(r["text"], F.lit("")))), lambda t: t != "")
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("text"))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))
