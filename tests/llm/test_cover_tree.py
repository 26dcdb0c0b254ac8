"""Top-k search against brute force: random and clustered vectors, ties, copies, few rows, bad rows."""

import duckdb
import numpy as np
import pytest

from parley.llm import cover_tree

SCHEMA = "vec_id long, embedding array<double>, v string, cell int"


def brute(rows, k, every=3):
    good = [(i, np.floor(64 * np.array(e, float)).astype(np.int64)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q in good:
        if i % every == 0:
            ranked = sorted(((-int(q @ c), j) for j, c in good if j != i))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(ranked, 1)]
    return sorted(out)


def clustered(seed, n, size, groups, noise):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, size))
    return [(i, (centres[i % groups] + noise * rnd.normal(size=size)).tolist()) for i in range(n)]


TABLES = {
    "random": clustered(1, 300, 6, 300, 1.0),
    "clustered": clustered(2, 400, 8, 8, 0.01),
    "copies": [(i, [float(i % 3), 1.0, -1.0]) for i in range(200)] + [(1000 + i, [0.0, 0.0, 0.0]) for i in range(30)],
    "bad rows": [(i, [float(i), -float(i)]) for i in range(12)] + [(20, None), (21, [None, 1.0]), (24, [float("nan"), 1.0]), (27, [float("inf"), 1.0]), (None, [1.0, 1.0])],
    "one row": [(0, [1.0])],
    "no components": [(0, []), (3, []), (4, [])],
    "empty": [],
}


@pytest.mark.parametrize("name", TABLES)
def test_top_k_is_brute_force(spark, name):
    rows = TABLES[name]
    vectors = cover_tree.quantized(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA))
    found = cover_tree.top_k(vectors.where("vec_id % 3 = 0"), vectors, 5, cell_rows=40, candidate_block=30, query_block=20)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5)


def test_sql_is_brute_force_too():
    rows = clustered(3, 100, 4, 5, 0.3)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        assert sorted(con.execute(cover_tree.OP8_SQL).fetchall()) == brute(rows, 20, 20)


def test_clustered_vectors_are_pruned():
    rows = np.floor(64 * np.array([e for _, e in clustered(4, 8000, 16, 40, 0.02)])).astype(np.int64)
    ids = np.arange(len(rows))
    who, best, met = cover_tree.search(rows[:200], rows, ids, ids[:200], 10, leaves=(8, 32))
    full = rows[:200] @ rows.T
    np.fill_diagonal(full, cover_tree.NONE)
    assert (best == -np.sort(-full, axis=1)[:, :10]).all()
    assert met < 0.2 * 200 * len(rows)
    *_, again = cover_tree.search(rows[:200], rows, ids, ids[:200], 10, best[:, -1], (8, 32))  # with k-th scores known in advance
    assert again < met


@pytest.mark.parametrize("rows", [[(0, [1.0]), (3, [1.0, 2.0])], [(0, [1e7]), (3, [1.0])]])
def test_vectors_that_cannot_be_compared_fail(spark, rows):
    vectors = cover_tree.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="unequal length|too long for exact"):
        cover_tree.top_k(vectors, vectors, 2).collect()
