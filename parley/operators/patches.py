"""Corrections to a transcript: patches from a language model's answer, applied to the rows that they name.

A patch names rows by `source_ids`, or by `id` alone. One that names several rows merges them, and chains of such patches merge
together; several that name one row split it; a single one replaces its speaker and text. Everything is joined and grouped by recording and id; merge
groups are connected components, so no recording is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.text import capitalised, stripped
from parley.operators.components import connected_components

KEY = "recording"
#: Seconds between the parts of a split row, and the least length of a part but the last.
GAP, LEAST = 0.05, 0.1


def json_array(answer: Column) -> Column:
    """The JSON array in a model's answer: of the first fenced part that begins with a bracket, or of the whole, what stands from the first `[` to the last `]`; all of it if there is none."""
    whole = stripped(answer)
    fenced = F.get(F.filter(F.transform(F.split(whole, "```"), stripped), lambda p: p.rlike(r"^[\[{]")), F.lit(0))
    part = F.when(whole.contains("```"), F.coalesce(fenced, whole)).otherwise(whole)
    found = F.regexp_extract(part, r"(?s)\[.*\]", 0)
    return F.when(found != "", found).otherwise(part)


def parsed(answers: DataFrame, answer: str = "answer", key: str = KEY) -> DataFrame:
    """recording, place (from 0), id, speaker, text, source_ids: the objects of each answer's array, as strings. Items that aren't objects are
    dropped; answers without a valid array, and null ones, give no rows. One answer a recording."""
    items = F.from_json(json_array(F.col(answer)), "array<string>")
    rows = answers.select(key, F.posexplode(items).alias("place", "item")).where(F.col("item").rlike(r"^\s*\{"))
    return rows.select(key, "place", F.from_json("item", "id string, speaker string, text string, source_ids string").alias("p")).select(key, "place", "p.*")


def _number(text: Column) -> Column:
    """An integer in a string, or null."""
    return F.when(stripped(text).rlike(r"^-?[0-9]{1,18}$"), stripped(text).cast("long"))


def resolved(patches: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """recording, place, ids (ascending, distinct), speaker, text of the patches all of whose ids stand in `rows` (recording, id). ids: the numbers in
    source_ids if that is a list with any item, else id. Patches that name no row, or one that isn't there, go."""
    listed = F.from_json("source_ids", "array<string>")
    ids = F.when(F.size(listed) > 0, F.filter(F.transform(listed, _number), lambda i: i.isNotNull())).otherwise(F.filter(F.array(_number(F.col("id"))), lambda i: i.isNotNull()))
    named = patches.select(key, "place", "speaker", "text", F.array_sort(F.array_distinct(ids)).alias("ids")).where(F.size("ids") > 0)
    known = rows.select(F.col(key).alias("_k"), F.col("id").cast("long").alias("_i"), F.lit(1).alias("_there")).distinct()
    each = named.select(key, "place", F.size("ids").alias("n"), F.explode("ids").alias("i"))
    there = each.join(known, (each[key] == F.col("_k")) & (F.col("i") == F.col("_i")), "left").groupBy(key, "place").agg(F.count("_there").alias("found"), F.first("n").alias("n")).where("found = n")
    return named.join(there.select(key, "place"), [key, "place"])


def merge_groups(resolved_patches: DataFrame, key: str = KEY) -> DataFrame:
    """recording, id, root: the least id of the group in which patches of several ids join each row. Rows that none joins are left out."""
    several = resolved_patches.where(F.size("ids") > 1)
    node = lambda i: F.struct(F.col(key).alias("r"), i.alias("i"))
    edges = several.select(key, F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))
    return connected_components(edges).select(F.col("node.r").alias(key), F.col("node.i").alias("id"), F.col("component.i").alias("root"))


def _given(text: Column) -> Column:
    """Stripped, null if blank."""
    return F.nullif(stripped(F.coalesce(text, F.lit(""))), F.lit(""))


def merged(rows: DataFrame, patches: DataFrame, groups: DataFrame, key: str = KEY) -> DataFrame:
    """recording, id (the root), start, end, speaker, text of each group: from its first start to its last end, with its patches' texts in their order, or the rows' own
    if they are blank, and the first speaker given, or the first row's."""
    several = patches.where(F.size("ids") > 1).withColumn("id", F.col("ids")[0])
    of_group = several.join(groups, [key, "id"]).groupBy(key, "root").agg(F.array_sort(F.collect_list(F.struct("place", _given(F.col("text")).alias("text"), _given(F.col("speaker")).alias("speaker")))).alias("parts"))
    members = rows.join(groups, [key, "id"]).groupBy(key, "root").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_sort(F.collect_list(F.struct("id", "text", "speaker"))).alias("rows"))
    first_speaker = F.get(F.filter(F.transform("parts", lambda p: p["speaker"]), lambda x: x.isNotNull()), F.lit(0))
    texts = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda x: x.isNotNull()), " ")
    own = stripped(F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), " "))
    found = members.join(of_group, [key, "root"])
    return found.select(key, F.col("root").alias("id"), F.round("t0", 3).alias("start"), F.round("t1", 3).alias("end"), F.coalesce(first_speaker, F.col("rows")[0]["speaker"], F.lit("")).alias("speaker"), F.when(texts != "", texts).otherwise(own).alias("text"))


def split_parts(parts: Column, t0: Column, t1: Column) -> Column:
    """Start and end of each part (an array of structs with text): time shared out by the stripped texts' lengths over the unstripped ones' sum, GAP between parts, at least LEAST each but the last, which ends at t1. A fold:
    each part begins where the one before was moved to."""
    total = F.aggregate(parts, F.lit(0), lambda s, p: s + F.length(p["text"]))
    done = "struct<at:double,n:int,out:array<struct<start:double,end:double>>>"

    def step(acc: Column, p: Column) -> Column:
        shared = acc["at"] + F.length(stripped(p["text"])) / total * (t1 - t0)
        end = F.when(acc["n"] + 1 < F.size(parts), F.greatest(acc["at"] + LEAST, shared - GAP)).otherwise(t1)
        piece = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + GAP).alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(piece)).alias("out")).cast(done)

    start = F.struct(t0.alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<start:double,end:double>>").alias("out")).cast(done)
    return F.aggregate(parts, start, step)["out"]


def corrected(rows: DataFrame, patches: DataFrame, key: str = KEY) -> DataFrame:
    """recording, idx (from 0, by start and end), start, end, speaker, text: `rows` (recording, id, t0, t1, speaker, text) with `patches` (recording,
    place, id, speaker, text, source_ids) applied. Rows without a patch stay; split parts lose leading dashes and are capitalised, others don't; a split row whose parts are all blank stays.
    Null speakers and texts count as blank; ids must be unique in a recording; an empty table gives none. Other columns are ignored."""
    rows = rows.select(key, F.col("id").cast("long").alias("id"), "t0", "t1", F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    found = resolved(patches, rows, key)
    groups = merge_groups(found, key)
    one = merged(rows, found, groups, key).select(key, F.lit(0).alias("kind"), "id", F.lit(0).alias("part"), "start", "end", "speaker", "text")
    single = found.where(F.size("ids") == 1).groupBy(key, F.col("ids")[0].alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"), _given(F.col("speaker")).alias("speaker")))).alias("own"))
    rest = rows.join(groups.select(key, "id"), [key, "id"], "left_anti").join(single, [key, "id"], "left")
    said = F.filter("own", lambda p: _given(p["text"]).isNotNull())
    rest = rest.withColumn("parts", F.when(F.size("own") > 1, said)).withColumn("only", F.when(F.size("own") == 1, F.col("own")[0]))
    whole = rest.where("parts is null or size(parts) = 0")
    plain = whole.select(key, F.lit(1).alias("kind"), "id", F.lit(0).alias("part"), F.round("t0", 3).alias("start"), F.round("t1", 3).alias("end"), F.coalesce("only.speaker", "speaker").alias("speaker"), F.coalesce(_given(F.col("only.text")), "text").alias("text"))
    cut = rest.where("size(parts) > 0").withColumn("times", split_parts(F.col("parts"), F.col("t0"), F.col("t1")))
    pieces = cut.select(key, "id", "speaker", F.posexplode(F.arrays_zip("parts", "times")).alias("part", "z"))
    text = capitalised(F.regexp_replace(stripped(F.col("z.parts.text")), r"(?U)^[—\-\s]+", ""))
    split = pieces.select(key, F.lit(1).alias("kind"), "id", "part", F.round("z.times.start", 3).alias("start"), F.round("z.times.end", 3).alias("end"), F.coalesce("z.parts.speaker", "speaker").alias("speaker"), text.alias("text"))
    every = one.unionByName(plain).unionByName(split)
    order = Window.partitionBy(key).orderBy("start", "end", "kind", "id", "part")
    return every.withColumn("idx", F.row_number().over(order) - 1).select(key, "idx", "start", "end", "speaker", "text")
