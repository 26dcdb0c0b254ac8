"""Average linkage and density clusters over blocks and rounds against plain models of whole matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import density as D
from parley.operators import linkage as L
from parley.operators import vectors as V

SCHEMA = "recording string, idx int, embedding array<double>"


def average_linkage(distance, k, threshold):
    """Labels by joining the two clusters of least mean distance again and again."""
    n = len(distance)
    d, size, label = distance.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(n, (k or 1), -1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if threshold is not None and d[i, j] >= threshold:
            break
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i], d[i, i], d[j], d[:, j] = d[i], np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return pd.factorize(label)[0]


def cosine_distance(x):
    x = unit(x)
    return 1 - np.clip(x @ x.T, -1, 1)


def unit(x):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def dense(x, least, samples):
    """Density clusters by the book: the whole matrix, Kruskal's tree, sets of rows for clusters."""
    x, n = unit(x), len(x)
    d = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x])
    core = [sorted(np.delete(d[i], i))[min(samples, n - 1) - 1] if n > 1 else 0.0 for i in range(n)]
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    part, splits = {i: frozenset([i]) for i in range(n)}, {}
    for w, i, j in edges:
        if part[i] != part[j]:
            whole = part[i] | part[j]
            splits[whole] = (w, part[i], part[j])
            for r in whole:
                part[r] = whole
    selected = {}

    def grow(rows, born):
        """(stability, chosen sets) of a cluster that begins as `rows` at `born`."""
        total, here = 0.0, rows
        while True:
            if len(here) == 1:
                return total, 0.0, []
            w, one, two = splits[here]
            rate = np.inf if w == 0 else 1 / w
            gain = lambda k: (rate - born) * k if rate > born else 0.0  # noqa: B023, E731
            if len(one) >= least and len(two) >= least:
                total += gain(len(here))
                inner, chosen = 0.0, []
                for side in (one, two):
                    own, below, sets = grow(side, rate)
                    inner, chosen = inner + max(own, below), chosen + ([side] if own >= below else sets)
                return total, inner, chosen
            if len(one) < least and len(two) < least:
                return total + gain(len(here)), 0.0, []
            small, here = sorted((one, two), key=len)
            total += gain(len(small))

    chosen = grow(frozenset(range(n)), 0.0)[2] if n > 1 else []
    for number, rows in enumerate(chosen):
        selected |= {r: number for r in rows}
    labels = [selected.get(i, f"noise {i}" if chosen else "all") for i in range(n)]
    return pd.factorize(np.array(labels, object))[0]


def clumps(rng, n, size):
    middle = rng.normal(size=(4, size)) * 3
    return middle[rng.integers(0, 4, n)] + rng.normal(size=(n, size)) * rng.choice([0.1, 0.5, 1.0])


def table(spark, recordings):
    rows = [(r, i, [float(c) for c in v]) for r, x in recordings.items() for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, ("blank", 0, None), ("r0", 999, None)], SCHEMA).withColumn("first", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)


def clusters(df):
    found = df.toPandas().sort_values(["recording", "idx"])
    assert not found.duplicated(["recording", "idx"]).any()
    return {r: g["cluster"].tolist() for r, g in found.groupby("recording")}


def test_merges_in_rounds_are_those_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = unit(rng.normal(size=(rng.integers(1, 60), 5)))
        for threshold in (0.3, 0.6, 0.9):
            first = np.arange(len(x))
            for a, b, _height in L.merges(x, np.ones(len(x)), threshold):
                first[first == b] = a
            assert (pd.factorize(first)[0] == average_linkage(cosine_distance(x), None, threshold)).all()


@pytest.mark.parametrize("local", [4096, 12])
def test_average_linkage_whatever_a_task_takes(spark, local):
    rng = np.random.default_rng(1)
    recordings = {f"r{i}": rng.normal(size=(n, 6)) for i, n in enumerate((1, 2, 15, 40))} | {"zero": np.zeros((3, 6))}
    df = table(spark, recordings)
    assert clusters(L.agglomerate(df, threshold=0.5, local=local, block=16)) == {r: average_linkage(cosine_distance(x), None, 0.5).tolist() for r, x in recordings.items()}
    del recordings["zero"]
    df = df.where("recording <> 'zero'")
    assert clusters(L.agglomerate(df, k=4, local=local, block=16)) == {r: average_linkage(cosine_distance(x), min(4, len(x)), None).tolist() for r, x in recordings.items()}


def test_equal_vectors_meet_whatever_a_task_takes(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(3, 4)), 20, axis=0)
    df = table(spark, {"r0": x})
    for local in (4096, 2):
        assert clusters(L.agglomerate(df, threshold=0.01, local=local, block=16)) == {"r0": [0] * 20 + [1] * 20 + [2] * 20}
    assert len(set(clusters(L.agglomerate(df, k=30))["r0"])) == 30


def test_density_clusters_of_trees():
    """The hierarchy alone, on twenty random sets of rows."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n, least = int(rng.integers(2, 60)), int(rng.integers(2, 6))
        x = unit(clumps(rng, n, 3))
        d = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x])
        core = np.sort(d, axis=1)[:, min(least, n - 1)]
        edges, part = [], list(range(n))
        for w, i, j in sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n)):
            if part[i] != part[j]:
                edges.append((w, i, j))
                part = [part[i] if p == part[j] else p for p in part]
        found = D.chosen_clusters(*(np.array(c) for c in zip(*edges, strict=True)), n, least)
        labels = [f"noise {i}" if c < 0 and (found >= 0).any() else c for i, c in enumerate(found)]
        assert (pd.factorize(np.array(labels, object))[0] == dense(x, least, least)).all()


def test_density_clusters_of_recordings(spark):
    rng = np.random.default_rng(5)
    recordings = {f"r{i}": clumps(rng, n, 4) for i, n in enumerate((1, 2, 3, 9, *rng.integers(20, 90, 16)))}
    recordings["same"] = np.tile(rng.normal(size=(1, 4)), (12, 1))
    recordings["twice"] = np.repeat(clumps(rng, 20, 4), 2, axis=0)
    df = table(spark, recordings)
    assert clusters(D.hdbscan(df, 4, block=16)) == {r: dense(x, 4, 4).tolist() for r, x in recordings.items()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.hdbscan(empty).count() == 0 and L.agglomerate(empty).count() == 0 and L.agglomerate(empty, k=2).count() == 0


def test_groups_of_graphs_from_their_edges(spark):
    """What a task's matrix gives, from the table of edges alone."""
    rng = np.random.default_rng(1)
    nodes, edges, want = [], [], {}
    for name, n in (("large", 40), ("also", 36), ("small", 10)):
        own, w = rng.integers(0, 2, n), np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                if rng.random() < (0.8 if own[i] == own[j] else 0.05):
                    w[i, j] = w[j, i] = rng.uniform(0.5, 1)
                    edges.append((name, i, j, float(w[i, j])))
        nodes += [(name, i) for i in range(n)]
        want[name] = V.spectral_labels(w, 2).tolist()
    edges.append(("large", 0, 1, -0.5)) if not any(e[:3] == ("large", 0, 1) for e in edges) else None
    table = spark.createDataFrame(nodes, "recording string, idx int")
    found = clusters(V.graph_partition(spark.createDataFrame(edges, "recording string, i int, j int, sim double"), table, 2, most=20))
    assert found == want and {len(set(x)) for x in want.values()} == {2}
    assert clusters(V.graph_partition(spark.createDataFrame(edges, "recording string, i int, j int, sim double"), table, 1, most=20)) == {r: [0] * len(x) for r, x in want.items()}
