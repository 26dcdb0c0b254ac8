"""Average linkage on cosine distance, within recordings of any length.

The mean distance of two clusters of unit vectors needs only their sums and sizes: 1 - <S, T> / (|S| |T|). Two clusters that are nearest to each other can be merged at once, whatever else is merged, because no merge of
others can come between them; so all such pairs of all recordings merge in one round, and the dendrogram is the one that merging pair by pair gives. Rounds ask only clusters that are new or have lost their nearest one.
A recording of LOCAL clusters or fewer, at the start or after some rounds, is finished in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.blocks import BLOCK, KEY, Rows, against_blocks
from parley.operators.components import connected_components, stored

#: Clusters of a recording that a task takes: their distances are 8 bytes for each pair.
LOCAL = 4096


def distances(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    d = 1 - (total @ total.T) / (size[:, None] * size)
    np.fill_diagonal(d, np.inf)
    return d


def merges(total: np.ndarray, size: np.ndarray, threshold: float = np.inf) -> list[tuple[int, int, float]]:
    """(a, b, height) of the merges of clusters under `threshold`, a < b the places of their first members, those of a round together."""
    d, size = distances(total, size), size.astype(float).copy()
    near, out = d.argmin(axis=1) if len(d) > 1 else np.zeros(len(d), int), []
    alive = np.ones(len(d), bool)
    each = np.arange(len(d))
    while len(d) > 1:
        height = d[each, near]
        pairs = np.flatnonzero(alive & (near[near] == each) & (each < near) & (height < threshold))
        if not len(pairs):
            return out
        stale = np.zeros(len(d), bool)
        for a in pairs:
            b = near[a]
            out.append((int(a), int(b), float(height[a])))
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            row[[a, b]] = np.inf
            d[a], d[:, a] = row, row
            d[b], d[:, b] = np.inf, np.inf
            size[a] += size[b]
            alive[b] = False
            stale[[a, b]] = True
        again = np.flatnonzero(alive & stale[near])
        near[again] = d[again].argmin(axis=1)
    return out


def _nearest(asking: Rows, rows: Rows) -> dict[str, np.ndarray]:
    """The nearest cluster of the block to each one asked, the least id of equal ones. What is near the least by one product is measured again term by term, which gives both ends of a pair the same number."""
    own, vectors, size, _ = asking
    ids, others, sizes, _ = rows
    rough = 1 - (vectors @ others.T) / (size[:, None] * sizes)
    rough[own[:, None] == ids] = np.inf
    near, height = np.zeros(len(own), np.int64), np.full(len(own), np.inf)
    for i, least in enumerate(rough.min(axis=1)):
        if least < np.inf:
            there = np.flatnonzero(rough[i] <= least + 1e-9)
            exact = 1 - (others[there] * vectors[i]).sum(axis=1) / (sizes[there] * size[i])
            best = np.lexsort((ids[there], exact))[0]
            near[i], height[i] = ids[there[best]], exact[best]
    good = height < np.inf
    return {"id": own[good], "near": near[good], "height": height[good]}


def _round(clusters: DataFrame, threshold: float, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The merged pairs (recording, a, b, height) and the clusters after them. clusters: recording, id, total, size, near, height; near is null where it must be asked."""
    as_rows = lambda df: df.select(key, "id", F.col("total").alias("v"), F.col("size").alias("x"), F.lit(0).cast("long").alias("part"))
    asked = against_blocks(as_rows(clusters.where("near is null")), as_rows(clusters), _nearest, "id long, near long, height double", key, block)
    best = asked.groupBy(key, "id").agg(F.min(F.struct("height", "near")).alias("b")).select(F.col(key).alias("_k"), F.col("id").alias("_id"), "b")
    same = F.col(key).eqNullSafe(F.col("_k"))
    known = clusters.join(best, same & (F.col("id") == F.col("_id")), "left").select(key, "id", "total", "size", F.coalesce("near", "b.near").alias("near"), F.when(F.col("near").isNotNull(), F.col("height")).otherwise(F.col("b.height")).alias("height"))
    known = stored(known)
    first, second = known.where("near > id").where(F.col("height") < threshold), known.where("near < id").select(F.col(key).alias("_k"), F.col("id").alias("b"), F.col("near").alias("_a"), F.col("total").alias("other"), F.col("size").alias("more"))
    pairs = stored(first.join(second, same & (F.col("near") == F.col("b")) & (F.col("id") == F.col("_a"))).select(key, F.col("id").alias("a"), "b", "height", F.zip_with("total", "other", lambda x, y: x + y).alias("total"), (F.col("size") + F.col("more")).alias("size")))
    gone = pairs.select(F.col(key).alias("_k"), F.explode(F.array("a", "b")).alias("_id"))
    rest = known.join(gone, same & (F.col("id") == F.col("_id")), "left_anti").join(gone, same & (F.col("near") == F.col("_id")), "left")
    kept = rest.select(key, "id", "total", "size", F.when(F.col("_id").isNull(), F.col("near")).alias("near"), F.when(F.col("_id").isNull(), F.col("height")).alias("height"))
    new = pairs.select(key, F.col("a").alias("id"), "total", "size", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("height"))
    return pairs.select(key, "a", "b", "height"), stored(kept.unionByName(new))


def _in_tasks(clusters: DataFrame, threshold: float, key: str) -> DataFrame:
    """recording, a, b, height, turn (their order) of recordings that a task takes whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        found = merges(np.array(rows["total"].tolist(), float), rows["size"].to_numpy(), threshold)
        a, b, height = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({key: rows[key].iloc[0], "a": ids[list(a)], "b": ids[list(b)], "height": np.array(height, float), "turn": np.arange(len(found))})

    return clusters.select(key, "id", "total", "size").groupBy(key).applyInPandas(run, f"{key} {dict(clusters.dtypes)[key]}, a long, b long, height double, turn long")


def dendrogram(df: DataFrame, threshold: float = np.inf, vector: str = "embedding", key: str = KEY, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """recording, a, b, height, round, turn: the merges of clusters under `threshold`, named by their first members' idx (a < b), in the order (height, round, turn). Equal vectors meet first, at height 0."""
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    known = df.where(F.col(vector).isNotNull()).withColumn("_norm", F.when(size > 0, F.sqrt(size)).otherwise(1.0))
    units = stored(known.select(key, F.col("idx").cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") / F.col("_norm")).alias("total"), F.when(size == 0, F.col("idx")).alias("alone")))
    # equal vectors are one cluster from the start: all would be nearest to the first of them, and a round would merge one; zeros are as far from each other as from all
    firsts = units.groupBy(key, "total", "alone").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("size"))
    rows = firsts.select(key, "id", F.transform("total", lambda x: x * F.col("size")).alias("total"), "size")
    rows = stored(rows.withColumn("near", F.lit(None).cast("long")).withColumn("height", F.lit(None).cast("double")))
    first = firsts.where("size > 1").select(F.col(key).alias("_k"), F.col("total").alias("_t"), F.col("id").alias("a"))
    same = units.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("total") == F.col("_t"))).where("id <> a").where(F.lit(threshold) > 0)
    equal = same.select(key, "a", F.col("id").alias("b"), F.lit(0.0).alias("height"), F.col("id").alias("turn"), F.lit(-1).alias("round"))
    out, number, left = [equal], 0, rows
    while True:
        counts = left.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
        sized = left.join(counts, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
        out.append(_in_tasks(sized.where(F.col("_n") <= local), threshold, key).withColumn("round", F.lit(number)))
        left = sized.where(F.col("_n") > local).drop("_n")
        if left.isEmpty():
            break
        pairs, after = _round(left, threshold, key, block)
        met = pairs.select(F.col(key).alias("_k")).distinct()
        if met.isEmpty():
            break
        out.append(pairs.withColumn("turn", F.lit(0).cast("long")).withColumn("round", F.lit(number)))
        left, number = after.join(met, F.col(key).eqNullSafe(F.col("_k")), "left_semi"), number + 1  # a recording in which nothing merged is done
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return stored(whole)


def numbered(df: DataFrame, firsts: DataFrame, vector: str = "embedding", key: str = KEY) -> DataFrame:
    """recording, idx, cluster: the rows that have a vector, in clusters named by their first row's idx, numbered by it. firsts: recording, idx, first; rows without one are a cluster of their own."""
    rows = df.where(F.col(vector).isNotNull()).select(key, "idx")
    known = firsts.select(F.col(key).alias("_k"), F.col("idx").alias("_i"), "first")
    same = lambda other: F.col(key).eqNullSafe(F.col(other))
    named = rows.join(known, same("_k") & (F.col("idx") == F.col("_i")), "left").select(key, "idx", F.coalesce("first", "idx").alias("first"))
    order = named.where("idx = first").select(F.col(key).alias("_k"), F.col("idx").alias("_c"), (F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1).cast("long").alias("cluster"))
    return named.join(order, same("_k") & (F.col("first") == F.col("_c"))).select(key, "idx", "cluster")


def joined(links: DataFrame, key: str = KEY) -> DataFrame:
    """recording, idx, first: the least idx that each one reaches by links (recording, a, b)."""
    node = lambda c: F.struct(F.col(key).alias("r"), F.col(c).alias("i"))
    groups = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    return groups.select(F.col("node.r").alias(key), F.col("node.i").alias("idx"), F.col("component.i").alias("first"))


def agglomerate(df: DataFrame, k: int | None = None, threshold: float | None = 0.55, vector: str = "embedding", key: str = KEY, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """recording, idx, cluster: average linkage on cosine distance within each recording, to k clusters (fewer rows: one each) or of all merges under a distance. Clusters are numbered by their first row. Rows without
    a vector have no cluster; idx must be unique in a recording. Of merges of equal height the one of the earlier round comes first."""
    links = dendrogram(df, np.inf if k else threshold, vector, key, local, block)
    if k:
        rows = df.where(F.col(vector).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(key).orderBy("height", "round", "turn", "a")
        links = links.withColumn("_place", F.row_number().over(order)).join(rows, F.col(key).eqNullSafe(F.col("_k"))).where(F.col("_place") <= F.col("_n") - k)
    return numbered(df, joined(links, key), vector, key)
