"""The pipeline stage by stage, each against brute force on its own input."""

import hashlib
import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from parley.llm import bpe, quality, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id int, taken double"


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(2500)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(70, 300))) for _ in range(40)]
    texts[3] = texts[1]
    texts[5] = texts[2] + " one more word"
    texts[7], texts[9] = texts[7] + " " + passage, passage + " " + texts[9]
    texts += [None, "", "too short", "again " * 200, " ".join("".join(rnd.choices("ABCDEFGHJKxyz0123456789", k=30)) for _ in range(90))]
    rows = [(i * 2, t, "en", [None, "b", "a"][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, texts[11], "en", "a"), (None, " ".join(rnd.choices(words, k=100)), "en", None), (8, texts[4], "en", "b")]
    return [(i, t, lang, s, len(t or ""), "clash", 1, 0.5) for i, t, lang, s in rows]


def cut_by_earlier(rows):
    first = {}
    for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        data = r["text"].encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], r["doc_id"])
    out = Counter()
    for r in rows:
        data = r["text"].encode()
        gone = set()
        for p in range(len(data) - 49 if r["doc_id"] is not None else 0):
            if first[data[p : p + 50]] < r["doc_id"]:
                gone |= set(range(p, p + 50))
        out[r["doc_id"], bytes(b for i, b in enumerate(data) if i not in gone)] += 1
    return out


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(1), SCHEMA)
    columns, steps = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        steps.append((before.collect(), docs.collect()))
        assert n == 4 or docs.columns == columns
    given, good = steps[0]
    kept = {(r["doc_id"], r["ratio"]): r["kept"] for r in quality.measure(spark.createDataFrame(given, SCHEMA)).collect()}
    assert len(good) == sum(kept.values()) + 1 and {r["doc_id"] for r in good} == {i for (i, _), k in kept.items() if k}  # one row stands twice
    assert not {80, 82, 84, 86, 88} & {r["doc_id"] for r in good} and len(good) >= 36

    given, single = steps[1]
    known = [r for r in given if r["doc_id"] is not None]
    grams = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in known for w in [r["text"].lower().split()]}
    prints = {r["doc_id"]: simhash.fingerprint_of(r["text"]) for r in known}
    least = {i: i for i in grams}
    near = [(a, b) for a in grams for b in grams if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]))]
    for _ in grams:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert near and Counter(r["doc_id"] for r in single) == Counter(r["doc_id"] for r in given if r["doc_id"] is None or least[r["doc_id"]] == r["doc_id"])

    given, cut = steps[2]
    assert Counter((r["doc_id"], r["text"].encode()) for r in cut) == cut_by_earlier(given)
    assert all(r["n_chars"] == len(r["text"]) for r in cut) and sum(len(r["text"]) for r in cut) < sum(len(r["text"]) for r in given)

    given, mixed = steps[3]
    size = Counter()
    for r in given:
        size[r["source"]] += len(r["text"].split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s], left = 2.0 * size[s], left - 2 * size[s]
        open_ -= full
    words = Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - target[s]) <= 1 for s in order)
    whole = Counter((r["doc_id"], r["text"]) for r in given)
    assert sum(n for k, n in Counter((r["doc_id"], r["text"]) for r in mixed).items() if k not in whole) <= len(order)  # rows cut at a budget

    given, coded = steps[4]
    path = public.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    want = Counter()
    for r in given:
        ids = encoding.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded) == want


def test_run_is_the_stages_in_turn_and_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus(2)[:0], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "ids_sha256" in found.columns
