"""Density clusters of a recording's vectors: HDBSCAN as DataFrame rounds.

The core distance of a row is that to its m-th nearest other row; two rows are as far apart as the largest of their distance and their core distances. The minimum spanning tree under that distance grows by Boruvka's rounds: every
part takes the least edge that leaves it, and parts joined by such edges are one. Rows meet blocks of their recording's rows (`against_blocks`), and only the least edges of a part in a block leave a task. Edges are ordered by
(weight, lower idx, higher idx), so the tree is unique even where distances tie.

The tree's n - 1 edges, without the vectors, are then read in a task: joined from the least on they give the single-linkage hierarchy; a split counts where both sides have `least` rows or more, and of nested clusters those stay whose rows
persist over the larger range of 1 / distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.blocks import BLOCK, KEY, Rows, against_blocks
from parley.operators.components import connected_components, stored
from parley.operators.linkage import numbered

_NEAR = 1e-9


def _rough(asking: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, right up to rounding."""
    return np.maximum((asking**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * asking @ rows.T, 0)


def _exact(vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same numbers from both ends of a pair."""
    return np.sqrt(((rows - vector) ** 2).sum(axis=1))


def _nearest(m: int):
    def run(asking: Rows, rows: Rows) -> dict[str, np.ndarray]:
        """The m least distances of each asking row in the block."""
        own, vectors, _, _ = asking
        ids, others, _, _ = rows
        rough = _rough(vectors, others)
        rough[own[:, None] == ids] = np.inf
        who, far = [], []
        for i in range(len(own)):
            there = np.flatnonzero(rough[i] < np.inf)
            if len(there) > m:
                there = there[rough[i, there] <= np.partition(rough[i, there], m - 1)[m - 1] + _NEAR]
            exact = np.sort(_exact(vectors[i], others[there]))[:m]
            who.append(np.full(len(exact), own[i]))
            far.append(exact)
        return {"id": np.concatenate(who), "distance": np.concatenate(far)}

    return run


def _leaving(asking: Rows, rows: Rows) -> dict[str, np.ndarray]:
    """The least edge from each part among the asking rows to another part in the block."""
    own, vectors, core, parts = asking
    ids, others, cores, groups = rows
    rough = np.maximum(np.sqrt(_rough(vectors, others)), np.maximum(core[:, None], cores))
    rough[parts[:, None] == groups] = np.inf
    best: dict[int, tuple] = {}
    for i, least in enumerate(rough.min(axis=1)):
        if least == np.inf or parts[i] in best and least > best[parts[i]][0] + 1e-4:
            continue
        there = np.flatnonzero(rough[i] <= least + 1e-4)  # a distance near 0 is right up to the root of the rounding
        weight = np.maximum(_exact(vectors[i], others[there]), np.maximum(core[i], cores[there]))
        low, high = np.minimum(own[i], ids[there]), np.maximum(own[i], ids[there])
        j = np.lexsort((high, low, weight))[0]
        edge = (weight[j], low[j], high[j], groups[there[j]])
        best[parts[i]] = min(edge, best.get(parts[i], edge))
    weight, low, high, other = (np.array(x) for x in zip(*best.values(), strict=True)) if best else (np.zeros(0), *[np.zeros(0, np.int64)] * 3)
    return {"part": np.array(list(best), np.int64), "weight": weight.astype(float), "low": low, "high": high, "other": other}


def core_distances(rows: DataFrame, m: int, key: str = KEY, block: int = BLOCK) -> DataFrame:
    """recording, id, core: the distance to the m-th nearest other row, or to the farthest where there are fewer; 0 for a single row. rows: recording, id, v, x, part."""
    found = against_blocks(rows, rows, _nearest(m), "id long, distance double", key, block)
    m_th = F.get(F.array_sort(F.collect_list("distance")), F.least(F.lit(m), F.count("*").cast("int")) - 1)  # m from each block of the recording
    known = found.groupBy(F.col(key).alias("_k"), F.col("id").alias("_id")).agg(m_th.alias("core"))
    return rows.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("id") == F.col("_id")), "left").select(key, "id", F.coalesce("core", F.lit(0.0)).alias("core"))


def spanning_tree(rows: DataFrame, key: str = KEY, block: int = BLOCK) -> DataFrame:
    """recording, weight, low, high: the edges of each recording's minimum spanning tree. rows: recording, id, v, x (core distance), part (the id)."""
    trees, left = [], rows
    same = F.col(key).eqNullSafe(F.col("_k"))
    while True:
        found = against_blocks(left, left, _leaving, "part long, weight double, low long, high long, other long", key, block)
        least = stored(found.groupBy(key, "part").agg(F.min(F.struct("weight", "low", "high", "other")).alias("e")).select(key, "part", "e.*"))
        if least.isEmpty():
            break
        trees.append(least.select(key, "weight", "low", "high").distinct())
        node = lambda c: F.struct(F.col(key).alias("r"), F.col(c).alias("i"))
        joined = connected_components(least.select(node("part").alias("a"), node("other").alias("b"))).select(F.col("node.r").alias("_k"), F.col("node.i").alias("_part"), F.col("component.i").alias("_new"))
        left = stored(left.join(joined, same & (F.col("part") == F.col("_part"))).select(key, "id", "v", "x", F.col("_new").alias("part")))  # a recording of one part has no edges and is done
    out = trees[0] if trees else least.select(key, "weight", "low", "high")
    for more in trees[1:]:
        out = out.unionByName(more)
    return out


def chosen_clusters(weight: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, least: int) -> np.ndarray:
    """The chosen cluster of each of n rows, -1 for noise, from the edges of their spanning tree (weights and places of rows)."""
    size, sides, height = [1] * n, [()] * n, [0.0] * n
    top, parent = list(range(n)), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in np.lexsort((high, low, weight)):
        a, b = root(int(low[e])), root(int(high[e]))
        sides.append((top[a], top[b]))
        size.append(size[top[a]] + size[top[b]])
        height.append(float(weight[e]))
        parent[b], top[a] = a, len(sides) - 1
    # from the top: a node carries a cluster on, or its rows have fallen out of one
    born, above, stability = [0.0], [-1], [0.0]
    cluster, live = [0] * len(sides), [True] * len(sides)
    for node in range(len(sides) - 1, n - 1, -1):
        own, big = cluster[node], [size[s] >= least for s in sides[node]]
        if live[node]:
            rate = 1 / height[node] if height[node] else np.inf
            leave = size[node] if all(big) or not any(big) else size[sides[node][big.index(False)]]
            stability[own] += (rate - born[own]) * leave if rate > born[own] else 0.0
        for side, large in zip(sides[node], big, strict=True):
            cluster[side], live[side] = own, live[node] and large
            if live[node] and all(big):
                cluster[side] = len(born)
                born.append(rate)
                above.append(own)
                stability.append(0.0)
    below = [0.0] * len(born)
    whole = [False] * len(born)  # chosen, unless one above it is
    for c in range(len(born) - 1, 0, -1):
        whole[c] = stability[c] >= below[c]
        below[above[c]] += stability[c] if whole[c] else below[c]
    chosen = [-1] * len(born)
    for c in range(1, len(born)):
        chosen[c] = chosen[above[c]] if chosen[above[c]] >= 0 else c if whole[c] else -1
    return np.array([chosen[c] for c in cluster[:n]])


def hdbscan(df: DataFrame, least: int = 5, samples: int | None = None, vector: str = "embedding", key: str = KEY, block: int = BLOCK) -> DataFrame:
    """recording, idx, cluster: density clusters of `least` rows or more (2 at least), on the distances of vectors scaled to length 1. Rows that belong to none each are a cluster of their own; if no row belongs to any, all are one.
    Clusters are numbered by their first row. samples: m of the core distance, `least` if not given. Rows without a vector have no cluster; idx must be unique in a recording."""
    least = max(2, least)
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    known = df.where(F.col(vector).isNotNull()).withColumn("_norm", F.when(size > 0, F.sqrt(size)).otherwise(1.0))
    rows = stored(known.select(key, F.col("idx").cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") / F.col("_norm")).alias("v"), F.lit(0.0).alias("x"), F.col("idx").cast("long").alias("part")))
    core = core_distances(rows, samples or least, key, block).withColumnsRenamed({key: "_k", "id": "_id"})
    cored = stored(rows.join(core, F.col(key).eqNullSafe(F.col("_k")) & (F.col("id") == F.col("_id"))).select(key, "id", "v", F.col("core").alias("x"), "part"))

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        low, high = edges["low"].to_numpy(), edges["high"].to_numpy()
        ids = np.unique(np.concatenate([low, high]))
        found = chosen_clusters(edges["weight"].to_numpy(), np.searchsorted(ids, low), np.searchsorted(ids, high), len(ids), least)
        first = pd.Series(ids).groupby(found).transform("min").to_numpy() if (found >= 0).any() else np.full(len(ids), ids[0])
        return pd.DataFrame({key: edges[key].iloc[0], "idx": ids, "first": np.where((found < 0) & (found >= 0).any(), ids, first)})

    kind = dict(df.dtypes)
    firsts = spanning_tree(cored, key, block).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, idx long, first long")
    return numbered(df, firsts, vector, key)
