"""Hidden Markov smoothing over stretches against one long sequence, worked out in logarithms."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import hidden as H

SCHEMA = "recording string, idx int, speaker string"


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def plain_fit(codes, k, rounds):
    start, move, show = (np.log(x) for x in H.beginning(k))
    history = []
    for _ in range(rounds):
        n = len(codes)
        a, b = np.empty((n, k)), np.zeros((n, k))
        a[0] = start + show[:, codes[0]]
        for t in range(1, n):
            a[t] = log_sum(a[t - 1][:, None] + move, 0) + show[:, codes[t]]
        for t in range(n - 2, -1, -1):
            b[t] = log_sum(move + show[:, codes[t + 1]] + b[t + 1], 1)
        total = log_sum(a[-1], 0)
        history.append(float(total))
        inside = np.exp(a + b - total)
        moves = sum(np.exp(a[t][:, None] + move + show[:, codes[t + 1]] + b[t + 1] - total) for t in range(n - 1))
        shown = np.array([inside[codes == c].sum(axis=0) for c in range(k)]).T
        start, move, show = np.log(inside[0]), np.log(moves / moves.sum(axis=1, keepdims=True)), np.log(shown / shown.sum(axis=1, keepdims=True))
    return (start, move, show), history


def plain_path(codes, model):
    start, move, show = model
    score, back = start + show[:, codes[0]], []
    for code in codes[1:]:
        each = score[:, None] + move
        back.append(each.argmax(axis=0))
        score = each.max(axis=0) + show[:, code]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def sequence(rng, n, k):
    """Long turns with a wrong label now and then."""
    codes = np.repeat(rng.integers(0, k, n), rng.integers(3, 15, n))[:n]
    wrong = rng.random(n) < 0.1
    codes[wrong] = rng.integers(0, k, wrong.sum())
    codes[:k] = np.arange(k)
    return codes


def test_fit_of_a_short_sequence():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        k = int(rng.integers(2, 5))
        codes = sequence(rng, 80, k)
        model, known = H.fit(codes, k, 8, -np.inf)
        want, history = plain_fit(codes, k, 8)
        assert np.allclose(known, history, rtol=0, atol=1e-9) and all(b >= a - 1e-9 for a, b in zip(known, known[1:], strict=False))
        assert all(np.allclose(m, np.exp(w), rtol=0, atol=1e-9) for m, w in zip(model, want, strict=True))
        assert len(H.fit(codes, k, 200, 1e-2)[1]) < 200


def test_stretches_give_the_whole_sequence(spark):
    rng = np.random.default_rng(3)
    given = {"a": sequence(rng, 50, 3), "b": sequence(rng, 7, 2), "c": sequence(rng, 33, 2), "one": np.zeros(20, int)}
    rows = [(r, 2 * i, f"s{c}") for r, codes in given.items() for i, c in enumerate(codes)] + [("a", 1, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("x")).withColumn("stretch", F.lit(1)).repartition(3)
    _, pieces = H.stretches(df, "speaker", stretch=7)
    models = {r["recording"]: r for r in H.fitted(pieces, 4, -1e9).collect()}
    assert set(models) == set(given)
    for r, codes in given.items():
        if r != "one":
            want, history = plain_fit(codes, len(set(codes.tolist())), 4)
            assert np.allclose(models[r]["likelihoods"], history, rtol=0, atol=1e-9)
            assert np.allclose(models[r]["move"], np.exp(want[1]).ravel(), rtol=0, atol=1e-9) and np.allclose(models[r]["show"], np.exp(want[2]).ravel(), rtol=0, atol=1e-9)
    found = {(r["recording"], r["idx"]): r["speaker"] for r in H.hmm_smooth(df, rounds=4, tolerance=-1e9, stretch=7).collect()}
    assert len(found) == len(rows) and found["a", 1] is None and found["none", 0] is None
    for r, codes in given.items():
        path = codes if r == "one" else plain_path(codes, plain_fit(codes, len(set(codes.tolist())), 4)[0])
        assert [found[r, 2 * i] for i in range(len(codes))] == [f"s{c}" for c in path]


def test_lone_labels_go(spark):
    labels = [*"AAAAAABAAAAAAA", *"BBBBBBBBABBBBBB", *"AAAAAAAA"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(labels)], SCHEMA)
    found = [r["speaker"] for r in H.hmm_smooth(df).orderBy("idx").collect()]
    assert found == [*"A" * 14, *"B" * 15, *"A" * 8]
    assert H.hmm_smooth(df.where("false")).count() == 0
