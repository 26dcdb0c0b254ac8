"""Spectral groups of a recording's graph from its table of edges, for recordings whose matrix no task should hold.

The leading eigenvectors of the normalised similarities span what block power iteration converges to: a column of values for each of k vectors, one join with the edges for each product, and sums of k x k products to make the columns orthonormal
again. Half the matrix and half the identity are applied, so that negative eigenvalues can't lead. Similarity TINY, which every pair of nodes has besides, adds TINY times a column's sum and is never a row. Rows of length 1 are then grouped by
k-means from centres picked far apart; a turned basis gives the same groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.components import stored

KEY = "recording"
TINY, ROUNDS, PRODUCTS, STILL = 1e-6, 60, 4, 1e-10


def _same(key: str) -> Column:
    return F.col(key).eqNullSafe(F.col("_k"))


def _columns(k: int) -> list[str]:
    return [f"x{c}" for c in range(k)]


def _product(rows: DataFrame, edges: DataFrame, k: int, key: str) -> DataFrame:
    """rows (recording, id, scale, nodes, x0...) after one product. edges: recording, i, j, w, in both directions."""
    names = _columns(k)
    sums = rows.groupBy(F.col(key).alias("_k")).agg(*(F.sum(F.col("scale") * F.col(c)).alias(f"t_{c}") for c in names))
    sent = edges.join(rows.select(F.col(key).alias("_k"), F.col("id").alias("_j"), *((F.col("scale") * F.col(c)).alias(c) for c in names)), _same(key) & (F.col("j") == F.col("_j")))
    got = sent.groupBy(F.col(key).alias("_k"), F.col("i").alias("_i")).agg(*(F.sum(F.col("w") * F.col(c)).alias(f"g_{c}") for c in names))
    both = rows.join(got, _same(key) & (F.col("id") == F.col("_i")), "left").drop("_k", "_i").join(sums, _same(key)).drop("_k")
    new = lambda c: (F.col(c) + F.col("scale") * (F.coalesce(f"g_{c}", F.lit(0.0)) + TINY * F.col(f"t_{c}"))) / 2
    return both.select(key, "id", "scale", *(new(c).alias(c) for c in names))


def _orthonormal(rows: DataFrame, k: int, key: str) -> DataFrame:
    """rows with columns of length 1 that stand upright on each other, and `turn`: how far their span is from that of the columns y0..., which are orthonormal."""
    names = _columns(k)
    kind = dict(rows.dtypes)[key]
    products = rows.groupBy(key).agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).alias("own"), F.array(*(F.sum(F.col(f"y{c}") * F.col(b)) for c in range(k) for b in names)).alias("cross"))

    def solved(batches):
        for part in batches:
            out = []
            for own, cross in zip(part["own"], part["cross"], strict=True):
                values, vectors = np.linalg.eigh(np.array(own).reshape(k, k))
                change = vectors / np.sqrt(np.maximum(values, values.max() * 1e-24 + 1e-300))
                out.append((change.ravel().tolist(), float(1 - np.linalg.svd(np.array(cross).reshape(k, k) @ change, compute_uv=False).min())))
            yield pd.DataFrame({"_k": part[key], "change": [x for x, _ in out], "turn": [x for _, x in out]})

    found = products.mapInPandas(solved, f"_k {kind}, change array<double>, turn double")
    new = [sum((F.col(a) * F.col("change")[i * k + c] for i, a in enumerate(names)), F.lit(0.0)).alias(names[c]) for c in range(k)]
    return rows.join(found, _same(key)).select(key, "id", "scale", *new, "turn")


def embedded(nodes: DataFrame, edges: DataFrame, k: int, key: str = KEY) -> DataFrame:
    """recording, id, v: each node's place in the span of the k leading eigenvectors, scaled to length 1. nodes: recording, id; edges: recording, i, j, sim (each pair once); negative similarities count as 0."""
    pairs = edges.where("i <> j").select(key, "i", "j", F.greatest(F.col("sim"), F.lit(0.0)).alias("w")).where("w > 0")
    directed = stored(pairs.unionByName(pairs.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    weights = directed.groupBy(F.col(key).alias("_k"), F.col("i").alias("_i")).agg(F.sum("w").alias("_w"))
    sizes = nodes.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    begun = nodes.join(weights, _same(key) & (F.col("id") == F.col("_i")), "left").drop("_k", "_i").join(sizes, _same(key))
    start = [(F.xxhash64("id", F.lit(c)) / F.lit(2.0**63)).alias(f"x{c}") for c in range(k)]
    rows = begun.select(key, "id", (1 / F.sqrt(F.coalesce("_w", F.lit(0.0)) + TINY * F.col("_n"))).alias("scale"), *start)
    rows = stored(_orthonormal(rows.select("*", *(F.lit(0.0).alias(f"y{c}") for c in range(k))), k, key))
    for _ in range(ROUNDS):
        old = rows.select(F.col(key).alias("_k"), F.col("id").alias("_i"), *(F.col(f"x{c}").alias(f"y{c}") for c in range(k)))
        new = rows.drop("turn")
        for _ in range(PRODUCTS):
            new = stored(_product(new, directed, k, key))
        rows = stored(_orthonormal(new.join(old, _same(key) & (F.col("id") == F.col("_i"))).drop("_k", "_i"), k, key))
        if rows.agg(F.max("turn")).first()[0] < STILL:
            break
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in _columns(k)), F.lit(0.0)))
    return stored(rows.withColumn("_length", F.greatest(length, F.lit(1e-12))).select(key, "id", F.array(*(F.col(c) / F.col("_length") for c in _columns(k))).alias("v")))


def _away(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def grouped(rows: DataFrame, k: int, key: str = KEY, rounds: int = 100) -> DataFrame:
    """recording, id, part: k-means of rows (recording, id, v). The first centre is the row of least id, each other one the row farthest from those before it, the least id of equal ones; the centres of a recording are k vectors."""
    centres = rows.groupBy(F.col(key).alias("_k")).agg(F.array(F.min_by("v", "id")).alias("centres"))
    nearest = lambda c: F.array_min(F.transform(c, lambda m: _away(F.col("v"), m)))
    for _ in range(1, k):
        placed = rows.join(centres, _same(key)).withColumn("_far", nearest(F.col("centres")))
        more = placed.groupBy("_k").agg(F.max_by("v", F.struct("_far", -F.col("id"))).alias("_v"), F.first("centres").alias("centres"))
        centres = stored(more.select("_k", F.concat("centres", F.array("_v")).alias("centres")))
    part = F.array_min(F.transform("centres", lambda m, i: F.struct(_away(F.col("v"), m).alias("d"), i.alias("i"))))["i"]
    for _ in range(rounds):
        named = rows.join(centres, _same(key)).select("_k", "id", "v", part.alias("part"))
        sums = named.select("_k", "part", F.posexplode("v").alias("place", "x")).groupBy("_k", "part", "place").agg(F.avg("x").alias("x"))
        middles = sums.groupBy("_k", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("m"))
        found = middles.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("found")).withColumnRenamed("_k", "_f")
        new = centres.join(found, F.col("_k").eqNullSafe(F.col("_f"))).select("_k", F.col("centres").alias("old"), F.transform("centres", lambda m, i: F.coalesce(F.col("found")[i], m)).alias("centres"))
        new = stored(new)
        moved = new.agg(F.max(F.array_max(F.zip_with("old", "centres", _away)))).first()[0]
        centres = new.drop("old")
        if moved is None or moved < 1e-16:
            break
    return rows.join(centres, _same(key)).select(key, "id", part.alias("part"))


def large_partition(nodes: DataFrame, edges: DataFrame, k: int, key: str = KEY) -> DataFrame:
    """recording, idx, cluster: groups of nodes (recording, id), numbered by their first one."""
    parts = stored(grouped(embedded(nodes, edges, k, key), k, key))
    first = parts.groupBy(F.col(key).alias("_k"), F.col("part").alias("_p")).agg(F.min("id").alias("_first"))
    order = first.withColumn("cluster", (F.row_number().over(Window.partitionBy("_k").orderBy("_first")) - 1).cast("long"))
    return parts.join(order, _same(key) & (F.col("part") == F.col("_p"))).select(key, F.col("id").alias("idx"), "cluster")
