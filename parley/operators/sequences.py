"""Operators on ordered labels: rows (recording, idx, ..., speaker). idx orders the rows of a recording."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.slices import SLICE, carried, sliced

KEY = "recording"


def renumber(df: DataFrame, label: str = "speaker", order: tuple[str, ...] = ("t0", "t1", "idx"), key: str = KEY) -> DataFrame:
    """Adds `number`, from 0, by each label's first place in the order. A null label is a label of its own."""
    first = df.groupBy(key, label).agg(F.min(F.struct(*order)).alias("first"))
    ranked = first.select(F.col(key).alias("_k"), F.col(label).alias("_l"), (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).alias("number"))
    return df.join(ranked, (df[key] == F.col("_k")) & df[label].eqNullSafe(F.col("_l"))).drop("_k", "_l")


def numbered_name(number: Column) -> Column:
    """0 -> SPEAKER_1."""
    return F.concat(F.lit("SPEAKER_"), (number + 1).cast("string"))


def letter_name(number: Column) -> Column:
    """0 -> A ... 25 -> Z, 26 -> S1."""
    return F.when(number < 26, F.char(number + 65)).otherwise(F.concat(F.lit("S"), (number - 25).cast("string")))


def number_of_name(name: Column) -> Column:
    """SPEAKER_1 -> 0; 0 for what doesn't match."""
    digits = F.regexp_extract(name, "^SPEAKER_([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("int") - 1), F.lit(0))


def chronological_names(df: DataFrame, letters: bool = False, key: str = KEY) -> DataFrame:
    """Speakers renamed in the order in which they first speak."""
    numbered = renumber(df, key=key)
    return numbered.withColumn("speaker", (letter_name if letters else numbered_name)(F.col("number"))).drop("number")


def median_smooth(df: DataFrame, label: str, width: int = 3, key: str = KEY) -> DataFrame:
    """Each label becomes the upper median of the odd window around it, cut at the ends. Width 1 or less changes nothing."""
    reach = (width | 1) // 2
    if width <= 1:
        return df
    near = F.array_sort(F.collect_list(label).over(Window.partitionBy(key).orderBy("idx").rowsBetween(-reach, reach)))
    return df.withColumn(label, F.get(near, F.floor(F.size(near) / 2).cast("int")))


def _switched(before: str | None, speaker: str | None, after: str | None, short: bool) -> str | None:
    """The speaker of a row between two others; nulls are equal to nothing."""
    return before if short and before is not None and before == after and speaker is not None and before != speaker else speaker


def remove_micro_switches(df: DataFrame, min_run: float = 0.35, key: str = KEY, rows: int = SLICE) -> DataFrame:
    """A row under min_run long between two rows of one other label takes theirs. Left to right, so a change counts for the next row: a fold. What a slice of rows leaves as its last label depends on the label before it in one way only:
    one label, that behind the slice's first row, may lead to another end than all others. So slices are summed up in three labels, and folded in parallel once the label before each is known. The result doesn't depend on `rows`, those of a
    slice. The sorted rows are written to the shared folder at once."""
    ordered = df.select(key, F.col("idx").cast("long").alias("idx"), "t0", "t1", "speaker").withColumn("after", F.lead("speaker").over(Window.partitionBy(key).orderBy("idx")))
    cut = sliced(ordered.withColumn("short", F.coalesce(F.col("t1") - F.col("t0") < min_run, F.lit(False))), ["idx"], key, rows)
    kinds = dict(cut.dtypes)

    def turns(part: pd.DataFrame) -> list[tuple]:
        part = part.sort_values("place")
        known = lambda c: [None if pd.isna(x) else x for x in part[c]]
        return list(zip(known("speaker"), known("after"), part["short"], strict=True))

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        each = turns(part)
        special = each[0][1]
        ends = [special, None]  # of the special label and of any other
        for speaker, after, short in each:
            ends = [_switched(x, speaker, after, short) for x in ends]
        return pd.DataFrame({key: part[key].iloc[:1], "slice": part["slice"].iloc[:1], "special": [special], "then": [ends[0]], "otherwise": [ends[1]]})

    def behind(before, row):
        last = row.then if before is not None and before == row.special else row.otherwise
        return None if pd.isna(last) else last

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        before, out = None if pd.isna(part["state"].iloc[0]) else part["state"].iloc[0], []
        for speaker, after, short in turns(part):
            before = _switched(before, speaker, after, short)
            out.append(before)
        part = part.sort_values("place")
        return pd.DataFrame({key: part[key], "idx": part["idx"], "t0": part["t0"], "t1": part["t1"], "speaker": out})

    sums = cut.groupBy("slice").applyInPandas(summed, f"{key} {kinds[key]}, slice long, special string, then string, otherwise string")
    states = carried(sums, behind, "string", key)
    return cut.join(states, "slice").groupBy("slice").applyInPandas(folded, f"{key} {kinds[key]}, idx long, t0 {kinds['t0']}, t1 {kinds['t1']}, speaker string")


def runs(df: DataFrame, label: str = "speaker", key: str = KEY) -> DataFrame:
    """recording, run, label, first_idx, n: maximal runs of equal neighbours."""
    order = Window.partitionBy(key).orderBy("idx")
    new = F.when((F.row_number().over(order) == 1) | ~F.lag(label).over(order).eqNullSafe(F.col(label)), 1).otherwise(0)
    numbered = df.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min_by(label, "idx").alias(label), F.min("idx").alias("first_idx"), F.count("*").alias("n"))


def longest_run(df: DataFrame, label: str = "speaker", key: str = KEY) -> DataFrame:
    """Each recording's longest run, the first of equal ones."""
    best = F.max_by(F.struct(label, "first_idx", "n"), F.struct("n", -F.col("first_idx")))
    return runs(df, label, key).groupBy(key).agg(best.alias("best")).select(key, "best.*")
