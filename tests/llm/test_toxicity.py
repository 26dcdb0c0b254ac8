"""The toxicity field against enumeration, and its scores on documents held out of the fit."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import toxicity

TESTDATA = "/root/testdata/sf0.1"


def test_marginals_are_those_of_all_labellings():
    rnd = np.random.default_rng(1)
    trans = np.exp(rnd.normal(size=(2, 2)))
    model = toxicity.Model({}, 0.0, 0.4, trans, np.zeros(4))
    sequences = [np.exp(rnd.normal(size=n)) for n in (1, 2, 5, 8, 0, 8)]
    for odds, got in zip(sequences, toxicity.marginals(sequences, model), strict=True):
        n = len(odds)
        total, on = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            weight = np.exp(0.4) if n and labels[0] else 1.0
            for i, y in enumerate(labels):
                weight *= (odds[i] if y else 1.0) * (trans[labels[i - 1], y] if i else 1.0)
            total += weight
            on += weight * np.array(labels)
        assert np.allclose(got, on / total if n else [])


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("abdeghilmnoprstu", k=rnd.randrange(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.choice([6, 12, 60, 200]))
        if i % 7 == 0:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vilezo", "crudzak" + rnd.choice(plain)]))
        rows.append((i, " ".join(words).capitalize() + ".", int(i % 7 == 0)))
    return rows


def test_held_out_documents_and_edge_cases(spark):
    rows = corpus(1400, 2)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(5000, None, "x", 1), (5001, "", "x", 1), (5002, " \n", "x", 1), (None, "vilezo vilezo of", "x", 1), (0, rows[0][1], "x", 1)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, toxicity.fold(F.col("doc_id"), 4) != 2)
    found = {}
    for r in toxicity.score(docs, model).collect():
        found.setdefault(r["doc_id"], []).append(r)
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    caught = [found[i][0]["score"] >= 0.3 for i, _, y in held if y]
    assert np.mean(caught) >= 0.9 and not any(found[i][0]["score"] >= 0.3 for i, _, y in held if not y)
    assert len(found[0]) == 2 and found[0][0]["score"] == found[0][1]["score"]
    assert found[5000][0]["score"] == found[5001][0]["score"] == found[5002][0]["score"] < 0.3
    spans = [found[i][0] for i, _, y in held if y]
    texts = {i: t for i, t, _ in held}
    pieces = [texts[r["doc_id"]][s["start"] : s["end"]] for r in spans for s in r["spans"]]
    assert np.mean(["vilezo" in p.lower() or "crudzak" in p.lower() for p in pieces]) > 0.9
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labelled", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)]])
def test_labels_of_one_class_give_the_prior(spark, labelled):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert scores == {float(bool(labelled) and labelled[0][1])}


@pytest.mark.skipif(not os.path.exists(TESTDATA), reason="needs the test tables")
def test_recall_by_language_on_the_test_tables(spark):
    docs, labels = spark.read.parquet(f"{TESTDATA}/documents.parquet"), spark.read.parquet(f"{TESTDATA}/labels.parquet")
    found = toxicity.op10_toxicity(spark, TESTDATA).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    counts = {r["lang"]: r for r in found.where("toxic is not null").groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.sum(F.col("toxic") * F.col("predicted")).alias("caught"), F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("wrong"), F.count("*").alias("n")).collect()}
    assert all(r["caught"] >= 0.9 * r["toxic"] for r in counts.values())
    assert sum(r["wrong"] for r in counts.values()) <= 0.01 * sum(r["n"] for r in counts.values())
