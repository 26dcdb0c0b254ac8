"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Keys are uniform, so ranges of equal width are the range partition: a range is the
key's first hex digits, three or as many as keep about RANGE_ROWS rows in one. The token counts of a source's ranges are summed before the shuffle, a running sum over the
ranges of a source gives where each begins, and a running sum inside a range gives each row's own begin.
No task ever holds a source: its rows are dealt over all ranges. A source is cut at its exact budget, in the middle of a
row if need be, after as many whole epochs as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import WORD
from parley.operators.components import materialize

WEIGHTS, SHARE, MOST_EPOCHS, SEED, RANGE_ROWS = (3, 1, 2), 1.5, 2, "mix-1", 4096


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    """Hash-random by doc_id; rows without one by their text."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text, null: 0) and the hash-random key of each row."""
    return docs.select("doc_id", "source", _size().alias("size"), _key().alias("key"))


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size, target: sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all
    sizes; a target stops at MOST_EPOCHS times its source's size and the excess is shared again by weight until none is above.

    That fixed point is min(limit, level * weight) with one level for all, found in closed form: in ascending order of limit / weight, a source is
    full as long as sharing what is left by the weights that are left would pass its limit. One row a source, so these windows are over few rows.
    """
    ranked = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS) + 1).cast("double")).withColumn("limit", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, onward, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(SHARE) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = weighed.withColumn("level", level).withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight"))).alias("target"))


def _placed(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """Adds source_size, target, epochs and part to `rows` (doc_id, source, size, key and any others), which stand for the same table as `sized`."""
    digits = max(3, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    cut = F.substring("key", 1, digits)
    by_range = materialize(sized.groupBy("source", cut.alias("range")).agg(F.sum("size").alias("range_size")))
    begins = by_range.withColumn("range_begin", F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    ranges = begins.join(goals, begins.source.eqNullSafe(goals.source)).select(begins.source.alias("s"), F.col("range").alias("r"), "range_begin", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("range", cut).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ranges, placed.source.eqNullSafe(F.col("s")) & (placed.range == F.col("r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("range_begin") - F.col("inside")
    return placed.withColumn("epochs", epochs).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, key, source, size, source_size, target, epochs (whole passes), part (words of one more, from the text's beginning), taken.

    Null text has size 0 and is never taken; null is a source of its own; rows without a doc_id are ordered by a hash of their text; rows of equal
    doc_id are told apart by size only, so equal rows are ordered arbitrarily but take the same in sum; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(sizes(docs))
    return _placed(rows, rows).select("doc_id", "key", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of `docs`: each row once an epoch, and the row at its source's budget once more
    with only its first words, cut behind the last word taken. Each row carries its own share, so rows of equal or null doc_id are taken like all others."""
    rows = docs.select("doc_id", "source", "text", _size().alias("size"), _key().alias("key"), F.struct(*docs.columns).alias("row"))
    chosen = _placed(rows, materialize(sizes(docs))).select("row", "text", "part", "size", (F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)).cast("int").alias("wholes"))
    spread = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each piece is white space and one word
    cut = F.col("row").withField("text", F.array_join(F.slice(spread, F.lit(1), F.col("part").cast("int")), ""))
    whole = F.when(F.col("size") > 0, F.array_repeat("row", F.col("wholes"))).otherwise(F.array_repeat("row", 0))
    copies = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.concat(whole, F.array(cut))).otherwise(whole)
    return chosen.select(F.explode(copies).alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0 * source_size AS cap,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w
  FROM sources
), fill AS (
  SELECT 0 AS step, source, source_size, cap, w, false AS full_, 0.0::DOUBLE AS target FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, cap, w, full_ OR share >= cap, CASE WHEN full_ OR share >= cap THEN cap ELSE share END
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) FILTER (full_) OVER (), 0)) * w / sum(w) FILTER (NOT full_) OVER () AS share FROM fill)
  WHERE step < (SELECT count(*) FROM sources) + 1
), goals AS (
  SELECT source, source_size, target FROM fill WHERE step = (SELECT max(step) FROM fill)
), placed AS (
  SELECT r.*, g.source_size::BIGINT AS source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
  FROM rows_ r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - begin_)))::BIGINT AS taken
FROM placed
"""
