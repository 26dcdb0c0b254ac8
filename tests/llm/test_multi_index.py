"""The inverted multi-index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import multi_index as M

FOLDER = "/root/testdata/sf0.01"


def brute(rows, k, every):
    """query_id -> [(score, vec_id)] over plain tuples (vec_id, vector)."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min(tuple(v) for i, v in good if i == q)
        out[q] = sorted((float(np.sqrt(((v - np.array(own)) ** 2).sum())), i) for i, v in good if i != q)[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_pairs_come_in_order_of_their_sum():
    rng = np.random.default_rng(1)
    for a, b in ((1, 1), (1, 7), (6, 1), (9, 14)):
        one, two = rng.random(a).round(1), rng.random(b).round(1)
        found = list(M.traverse(one, two))
        assert len({(i, j) for _, i, j in found}) == a * b == len(found)
        assert [x[0] for x in found] == sorted(x[0] for x in found)
        assert all(x == one[i] + two[j] for x, i, j in found)
        count = rng.integers(0, 4, (a, b))
        limit = M.reach(one, two, count, 3)
        assert count[(one[:, None] + two) <= limit].sum() >= min(3, count.sum())


def test_shelves_part_a_full_cell_and_keep_others_whole():
    shelf, parts = M.shelves(np.array([3, 0, 4, 100, 2, 2]), 8)
    assert shelf.tolist() == [0, 0, 0, 1, 2, 2] and parts.tolist() == [1, 13, 1]


@pytest.mark.parametrize("seed", range(4))
def test_all_cells_visited_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    size = (8, 3, 1, 64)[seed]
    rows = [(int(i), rng.normal(size=size).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[9][1]), (20, rows[3][1]), (5, rows[9][1])]
    rows += [(None, [1.0] * size), (2010, None), (2020, [0.0] * size), (2030, [None] * size), (2040, [float("nan")] * size), (2050, [float("inf")] * size), (2060, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("v", F.lit(0)).repartition(5)
    usable = M.usable(table)
    result = M.search(usable.where("vec_id % 10 = 0"), usable, 6, share=1.0, shelf=50)
    assert got(result) == brute(rows, 6, 10)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<float>")
    rows = M.usable(table)
    assert got(M.search(rows.where("vec_id % 100 = 0"), rows, 10)) == {0: [(0.0, 100), (4.0, 3)], 100: [(0.0, 0), (4.0, 3)]}
    assert got(M.search(rows.where("vec_id = 3"), rows.where("vec_id = 3"), 10)) == {}
    empty = M.search(rows.where("vec_id < 0"), rows.where("vec_id < 0"), 10)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert M.search(rows.where("vec_id < 0"), rows, 10).count() == 0
    uneven = M.usable(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="unequal length"):
        M.search(uneven, uneven, 3).collect()


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    true, found = brute(rows, 10, 100), got(M.op11_multi_index(spark, FOLDER))
    assert found.keys() == true.keys() and all(len(x) == 10 for x in found.values())
    hits = sum(len({v for _, v in found[q]} & {v for _, v in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    exact = {i: np.array(v, float) for i, v in rows}
    assert all(s == float(np.sqrt(((exact[v] - exact[q]) ** 2).sum())) for q, x in found.items() for s, v in x)


def test_structure_needs_few_cells(spark):
    """Forty groups of vectors: a small share finds nine in ten of the neighbours."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    points = middle[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    first, second = M.centroids(points[:, :8], 32), M.centroids(points[:, 8:], 32)
    assert M.needed_share(points, first, second, 10, 0.95) < 0.1
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    usable = M.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    true, found = brute(rows, 10, 100), got(M.search(usable.where("vec_id % 100 = 0"), usable, 10))
    assert sum(len({v for _, v in found[q]} & {v for _, v in true[q]}) for q in true) >= 0.9 * 10 * len(true)
