"""Operators on embedding vectors (array columns): normalisation, imputation, similarity and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.text import similarity as text_similarity
from parley.operators.components import connected_components, stored
from parley.operators.partition import large_partition

KEY = "recording"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """To length 1; a zero vector stays. The norm is bound by an outer lambda, so it is taken once a vector and not once a component."""
    norm = F.sqrt(_dot(v, v))
    return F.transform(F.array(F.when(norm > 0, norm).otherwise(1.0)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, _dot(a, b) / size).when(size == 0, 0.0)


def means(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """by, vector: component-wise mean of the vectors that aren't null. Aggregated by component before the shuffle, so a large group never meets in one task."""
    parts = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("place", "x"))
    averaged = parts.groupBy(*by, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return averaged.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias(vector))


def impute(df: DataFrame, vector: str = "embedding", size: int = 192, key: str = KEY) -> DataFrame:
    """Missing vectors become the mean of their recording's; zeros of `size` where it has none."""
    mean = means(df, [key], vector).select(F.col(key).alias("_k"), F.col(vector).alias("_mean"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.join(mean, df[key] == F.col("_k"), "left").withColumn(vector, F.coalesce(F.col(vector).cast("array<double>"), "_mean", zeros)).drop("_k", "_mean")


def centroid_similarity(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """a, b (a < b), sim: cosine of the labels' mean normalised vectors. Pairs of labels, which are few, not of rows."""
    centres = means(df.where(F.col(vector).isNotNull()).withColumn(vector, normalised(F.col(vector))), [label], vector)
    left, right = centres.select(F.col(label).alias("a"), F.col(vector).alias("va")), centres.select(F.col(label).alias("b"), F.col(vector).alias("vb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("sim"))


def temporal_proximity(mid_a: Column, mid_b: Column, sigma: float = 3.0) -> Column:
    return F.exp(-F.abs(mid_a - mid_b) / max(1e-6, sigma))


def neighbours_similarity(df: DataFrame, vector: str = "embedding", key: str = KEY) -> DataFrame:
    """Adds `sim`, the cosine of each row's vector and the one before it by idx; null for a first row."""
    return df.withColumn("sim", cosine(F.col(vector), F.lag(vector).over(Window.partitionBy(key).orderBy("idx"))))


def cosine_distances(df: DataFrame, vector: str = "embedding", key: str = KEY) -> DataFrame:
    """recording, i, j (i < j), distance: 1 - cosine, within 0..2, of all pairs of a recording's segments. Their number is bounded by the recording's length; the join is keyed by recording."""
    rows = df.where(F.col(vector).isNotNull()).select(key, "idx", normalised(F.col(vector)).alias("v"))
    left, right = rows.select(key, F.col("idx").alias("i"), F.col("v").alias("vi")), rows.select(key, F.col("idx").alias("j"), F.col("v").alias("vj"))
    return left.join(right, key).where("i < j").select(key, "i", "j", (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("vi"), F.col("vj"))))).alias("distance"))


def distance_threshold(similarity: float) -> float:
    """The distance that a similarity threshold stands for: one of 1 or more counts as 0.999, one under -1 as -1."""
    return 1.0 - max(-1.0, 0.999 if similarity >= 1.0 else similarity)


def centred_scale(df: DataFrame, centred: bool = False, vector: str = "embedding", key: str = KEY) -> DataFrame:
    """Vectors over their norm. centred: over the norm that they have less the recording's mean, though they keep the mean, as an older clustering does; a zero norm counts as 1."""
    if not centred:
        return df.withColumn(vector, normalised(F.col(vector)))
    mean = means(df, [key], vector).select(F.col(key).alias("_k"), F.col(vector).alias("_mean"))
    less = F.zip_with(F.col(vector), F.col("_mean"), lambda x, m: x.cast("double") - m)
    joined = df.join(mean, df[key] == F.col("_k"), "left").withColumn("_norm", F.sqrt(_dot(less, less)))
    return joined.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0))).drop("_k", "_mean", "_norm")


def centroids(df: DataFrame, label: str = "cluster", vector: str = "embedding", key: str = KEY) -> DataFrame:
    """recording, label, n, total: number and component-wise sum of each label's normalised vectors. Summed by component before the shuffle, so a large label never meets in one task."""
    known = df.where(F.col(vector).isNotNull()).select(key, label, F.posexplode(normalised(F.col(vector))).alias("place", "x"))
    summed = known.groupBy(key, label, "place").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return summed.groupBy(key, label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("total"))


def nearest_centroid(df: DataFrame, centres: DataFrame, label: str = "cluster", vector: str = "embedding", total: str = "total", key: str = KEY) -> DataFrame:
    """Adds `nearest`: the label of the centroid (recording, label, total) of largest cosine in the row's recording, the least of equal ones; null without a vector or centroid. idx must be unique in a recording."""
    each = df.where(F.col(vector).isNotNull()).join(centres.select(F.col(key).alias("_k"), F.col(label).alias("_l"), F.col(total).alias("_t")), df[key] == F.col("_k"))
    best = each.groupBy(key, "idx").agg(F.min_by("_l", F.struct(-cosine(F.col(vector), F.col("_t")), F.col("_l"))).alias("nearest"))
    return df.join(best, [key, "idx"], "left")


def merge_clusters(df: DataFrame, least: float = 0.92, label: str = "cluster", vector: str = "embedding", key: str = KEY) -> DataFrame:
    """Replaces label by one of merged clusters, from 0 in the order of the labels: as long as there is a pair of centroids of cosine `least` or more, the first one in the order of labels
    merges into the lower label and centroids are taken anew. Only a recording's centroids, one row a cluster, meet in a task. Rows without a vector keep a place in their cluster if it has any vector, else null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(label)
        names, sums = rows[label].tolist(), np.array(rows["total"].tolist(), float)
        into, alive = list(range(len(names))), list(range(len(names)))
        while True:
            unit = sums[alive] / (np.linalg.norm(sums[alive], axis=1, keepdims=True) + 1e-12)
            near = np.argwhere(np.triu(unit @ unit.T >= least, 1))
            if not len(near):
                break
            a, b = (alive[i] for i in near[0])
            sums[a] += sums[b]
            into = [a if x == b else x for x in into]
            alive.remove(b)
        return pd.DataFrame({key: rows[key].iloc[0], "_l": names, "_new": [alive.index(x) for x in into]})

    kinds = dict(df.dtypes)
    mapping = centroids(df, label, vector, key).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, _l {kinds[label]}, _new long").withColumnRenamed(key, "_k")
    return df.join(mapping, (df[key] == F.col("_k")) & (df[label] == F.col("_l")), "left").withColumn(label, F.col("_new")).drop("_k", "_l", "_new")


def merge_speakers(df: DataFrame, least: float = 0.92, label: str = "speaker", vector: str = "embedding", key: str = KEY) -> DataFrame:
    """Speakers whose centroids are joined by chains of pairs of cosine `least` or more take the least name among them. Recordings in which a row lacks its vector stay as they are."""
    lacking = df.where(F.col(vector).isNull()).select(F.col(key).alias("_k")).distinct()
    whole = df.join(lacking, df[key] == F.col("_k"), "left_anti")
    centres = centroids(whole, label, vector, key)
    left, right = (centres.select(key, F.col(label).alias(name), F.col("total").alias(f"v{name}")) for name in ("a", "b"))
    near = left.join(right, key).where("a < b").where(cosine(F.col("va"), F.col("vb")) >= least)
    node = lambda c: F.struct(F.col(key).alias("r"), F.col(c).alias("s"))
    groups = connected_components(near.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.r").alias("_k"), F.col("node.s").alias("_l"), F.col("component.s").alias("_to"))
    return df.join(groups, (df[key] == F.col("_k")) & (df[label] == F.col("_l")), "left").withColumn(label, F.coalesce("_to", label)).drop("_k", "_l", "_to")


def joint_similarity(df: DataFrame, weights: tuple[float, float, float] = (0.55, 0.25, 0.20), sigma: float = 3.0, vector: str = "embedding", key: str = KEY) -> DataFrame:
    """recording, i, j (i < j), sim of all pairs of a recording's segments (idx, t0, t1, text, vector): weighed sum of (cosine + 1) / 2, likeness of texts and nearness in time, within 0..1. Segments without a vector are left out."""
    alpha, beta, gamma = weights
    rows = df.where(F.col(vector).isNotNull()).select(key, "idx", normalised(F.col(vector)).alias("v"), F.coalesce("text", F.lit("")).alias("text"), ((F.col("t0") + F.col("t1")) / 2).alias("mid"))
    left, right = (rows.select(key, *(F.col(c).alias(f"{c}_{n}") for c in ("idx", "v", "text", "mid"))) for n in "ij")
    pairs = left.join(right, key).where("idx_i < idx_j")
    total = alpha * (_dot(F.col("v_i"), F.col("v_j")) + 1) / 2 + beta * text_similarity(F.col("text_i"), F.col("text_j")) + gamma * temporal_proximity(F.col("mid_i"), F.col("mid_j"), sigma)
    return pairs.select(key, F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("sim"))


def spectral_labels(similarity: np.ndarray, k: int) -> np.ndarray:
    """Labels of a graph's nodes: k eigenvectors of the normalised similarities, rows scaled to length 1, grouped by k-means from centres picked far apart, so equal input gives equal labels."""
    n = len(similarity)
    k = max(1, min(k, n))
    if k == 1 or n < 2:
        return np.zeros(n, int)
    w = np.clip(similarity, 0, None) + 1e-6
    np.fill_diagonal(w, 1e-6)
    scale = 1 / np.sqrt(w.sum(axis=1))
    vectors = np.linalg.eigh(w * scale[:, None] * scale)[1][:, -k:]
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    while len(centres) < k:
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    middle = np.array(centres)
    for _ in range(100):
        label = ((x[:, None] - middle) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == c].mean(axis=0) if (label == c).any() else middle[c] for c in range(k)])
        if np.allclose(new, middle):
            break
        middle = new
    return pd.factorize(label)[0]


def graph_partition(edges: DataFrame, nodes: DataFrame, k: int, key: str = KEY, most: int = 4000) -> DataFrame:
    """recording, idx, cluster: spectral groups of each recording's nodes (recording, idx) by its edges (recording, i, j, sim; each pair once). Pairs without an edge have similarity 0. Numbers follow the first node. A recording of `most` nodes
    or fewer is a matrix in a task; larger ones are found from the table of edges (`partition`), all together and at once."""

    def run(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(rows["idx"].to_numpy())
        w = np.zeros((len(ids), len(ids)))
        if len(ids):
            i, j = np.searchsorted(ids, links["i"]), np.searchsorted(ids, links["j"])
            w[i, j] = w[j, i] = links["sim"]
        return pd.DataFrame({key: rows["_k"].to_numpy(), "idx": ids, "cluster": spectral_labels(w, k)})

    kinds = dict(nodes.dtypes)
    counts = nodes.groupBy(F.col(key).alias("_r")).agg(F.count("*").alias("_n"))
    same = F.col(key).eqNullSafe(F.col("_r"))
    large = stored(counts.where(F.col("_n") > most).select("_r"))
    whole = lambda df: df.join(large, same, "left_anti")
    keyed = whole(nodes).select(F.col(key).alias("_k"), F.col("idx").alias("idx"))
    small = keyed.groupBy("_k").cogroup(whole(edges).groupBy(key)).applyInPandas(run, f"{key} {kinds[key]}, idx {kinds['idx']}, cluster long")
    if large.isEmpty() or k < 2:
        return small if large.isEmpty() else small.unionByName(nodes.join(large, same, "left_semi").select(key, "idx", F.lit(0).cast("long").alias("cluster")))
    rest = large_partition(nodes.join(large, same, "left_semi").select(key, F.col("idx").alias("id")), edges.join(large, same, "left_semi"), k, key)
    return small.unionByName(rest)
