"""Audit of how quality filters interact: what each step of each order of five filters removes.

Every document gets five failure flags. Rows are counted by part and flags, 32 rows a part, and an SQL CUBE over the flags and the part counts those again: the row of a grouping set
that has only false in the flags it selects is the number of documents that survive just those filters, in any order. A step of an order joins two such subsets, the filters before it
and those with it, and what it removes is their difference. Texts are read once and never shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.components import materialize

FILTERS = "ABCDE"
_SPACES = "\t\n\x0b\x0c\r"
_COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and the flags A to D, from the text alone. Null text is empty and a null language the part ''."""
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    counted = read.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0].alias("words"),
        F.length("text").alias("chars"), F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    many = lambda c: 100 * F.col(c).cast("long")
    return counted.select("doc_id", "part", "digest", (F.col("words.all") < 100).alias("A"), (many("words.distinct") < 80 * F.col("words.all").cast("long")).alias("B"), (many("capitals") > 10 * F.col("chars").cast("long")).alias("C"), "D")


def flagged_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: documents by part and flags, and how many of them `labels` marks with quality 1 and toxic 1.

    E: a row with a smaller doc_id has the same text. Rows without a doc_id don't fail it and fail no others; of rows that share the least doc_id all pass. A doc_id labelled more than once is
    good (toxic) if any of its labels says so. A text's copies are counted before they meet: by part, labels and doc_id first, then without the doc_id, so that a group holds a few rows a part.
    """
    flags = ["A", "B", "C", "D"]
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = text_flags(docs)
    marked = rows.join(marks, rows["doc_id"] == F.col("_id"), "left").fillna(0, ["good", "toxic"]).drop("_id")
    each = marked.groupBy("digest", *flags, "part", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)
    groups = each.groupBy("digest", *flags, "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(known).alias("known"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    failed = F.col("known") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = groups.withColumn("first", first).withColumn("failed", failed).withColumn("E", F.explode(F.array(F.lit(False), F.lit(True))))
    sized = split.withColumn("n", F.when(F.col("E"), F.col("failed")).otherwise(F.col("n") - F.col("failed"))).where("n > 0")
    return sized.groupBy("part", *flags, "E").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset (bit i: the i-th filter), n, good, toxic: documents of the part that pass every filter of the subset. Subsets that nothing survives have no row."""
    cubed = counts.cube("part", *filters).agg(F.grouping_id("part", *filters).alias("_set"), *(F.sum(c).alias(c) for c in _COUNTS))
    # a grouping set's number has a bit, the part's highest, for each column that it leaves out; in it all flags that it selects must be false
    left_out = lambda i: F.col("_set").bitwiseAND(1 << (len(filters) - 1 - i)) != 0
    passed = cubed.where(F.col("_set").bitwiseAND(1 << len(filters)) == 0)
    for i, name in enumerate(filters):
        passed = passed.where(left_out(i) | ~F.col(name))
    subset = sum((F.when(left_out(i), 0).otherwise(1 << i) for i in range(len(filters))), F.lit(0))
    return passed.select("part", subset.cast("int").alias("subset"), *_COUNTS)


def steps(filters: str = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, before, after) of every order: the subsets of filters before the step and with it."""
    bit = {name: 1 << i for i, name in enumerate(filters)}
    return [("".join(p), k + 1, p[k], sum(bit[x] for x in p[:k]), sum(bit[x] for x in p[: k + 1])) for p in permutations(filters) for k in range(len(p))]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for every part, order of the filters and step in it. counts: part, a flag for each filter, n, good, toxic.

    kept: documents left after the step; removed: those it takes; redundant: those that fail its filter and went before; unique_fails: those that fail no other filter; good_lost and toxic_lost: the
    good and toxic ones it takes; shapley: what the filter takes, summed over all orders. No part, no rows.
    """
    spark = counts.sparkSession
    subsets = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    every = counts.select("part").distinct().select("part", F.explode(subsets).alias("subset"))
    whole = every.join(survivors(counts, filters), ["part", "subset"], "left").fillna(0, list(_COUNTS))
    table = F.broadcast(spark.createDataFrame(steps(filters), "filter_order string, step int, filter string, before int, after int"))  # as many rows as orders have steps, whatever the input
    after = whole.join(table, F.col("subset") == F.col("after")).drop("subset")
    before = whole.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in _COUNTS))
    lost = lambda c: F.col(f"{c}_before") - F.col(c)
    taken = after.join(before, ["part", "before"]).select("part", "filter_order", "step", "filter", F.col("n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    own = Window.partitionBy("part", "filter")
    alone = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(own)  # noqa: E731  as first of all filters, or after all others
    summed = taken.withColumn("redundant", alone(1) - F.col("removed")).withColumn("unique_fails", alone(len(filters))).withColumn("shapley", F.sum("removed").over(own))
    return summed.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    counts = flagged_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(materialize(counts))


OP12_SQL = r"""
WITH read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
    len(words) < 100 AS "A", 100 * len(list_distinct(words)) < 80 * len(words) AS "B",
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS "C", regexp_matches(text, '[#$%&*|]') AS "D",
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS "E"
  FROM read LEFT JOIN marks USING (doc_id)
), counts AS (
  SELECT part, "A"::INT + 2 * "B"::INT + 4 * "C"::INT + 8 * "D"::INT + 16 * "E"::INT AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY 1, 2
), passed AS (
  SELECT p.part, s.subset, coalesce(sum(n) FILTER (fails & subset = 0), 0) AS n, coalesce(sum(good) FILTER (fails & subset = 0), 0) AS good, coalesce(sum(toxic) FILTER (fails & subset = 0), 0) AS toxic
  FROM (SELECT DISTINCT part FROM counts) p CROSS JOIN (SELECT unnest(range(32)) AS subset) s JOIN counts c ON c.part = p.part GROUP BY 1, 2
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::BIGINT AS after, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), taken AS (
  SELECT a.part, filter_order, step, bit, a.n AS kept, b.n - a.n AS removed, b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
  FROM steps JOIN passed a ON a.subset = steps.after JOIN passed b ON b.part = a.part AND b.subset = steps.before
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, (max(removed) FILTER (step = 1) OVER w - removed)::BIGINT AS redundant,
  (max(removed) FILTER (step = 5) OVER w)::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER w)::BIGINT AS shapley
FROM taken WINDOW w AS (PARTITION BY part, bit)
"""
