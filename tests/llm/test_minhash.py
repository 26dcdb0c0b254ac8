"""Near copies that share keys with many: blocks of a lead's partners, cells of several blocks, and repeated ids, against brute force."""

import random

import pytest

from parley.llm import minhash, simhash

SCHEMA = "doc_id long, text string"


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """The least id that each reaches over pairs of similarity 0.8 or more."""
    sets, least = [(i, grams(t)) for i, t in rows], {i: i for i, _ in rows}
    near = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) >= 0.8 * len(x | y)]
    for _ in range(20):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    return least


def corpus(rng, n, copies):
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randrange(40, 120))] for _ in range(n)]
    rows = [" ".join(x) for x in base]
    for x in base[:3]:
        for _ in range(copies):
            own = list(x)
            own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("cell", [1024, 7])
def test_links_join_what_is_alike(spark, monkeypatch, cell):
    """With cells of seven rows, a key's rows are dealt to many blocks."""
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = corpus(random.Random(6), 40, 25)
    found = minhash.links(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    least, want = {i: i for i, _ in rows}, groups(rows)
    for _ in range(20):
        for r in found:
            least[r["a"]] = least[r["b"]] = min(least[r["a"]], least[r["b"]])
    assert least == want and len(set(want.values())) < len(rows) - 60


@pytest.mark.parametrize("block", [1, 3, 256])
def test_a_lead_of_many_partners_goes_to_blocks(spark, block):
    rows = corpus(random.Random(7), 5, 30)
    docs = spark.createDataFrame([*rows, (3, "another text of this very id that nothing else is like")], SCHEMA)
    lead = rows[0][0]
    pairs = spark.createDataFrame([(i, lead) for i, _ in rows if i != lead], "a long, b long")
    texts = {i: [grams(t) for j, t in [*rows, (3, "another text of this very id that nothing else is like")] if j == i] for i, _ in rows}
    want = {i for i, _ in rows if i != lead and any(len(x & y) >= 0.8 * len(x | y) for x in texts[i] for y in texts[lead])}
    assert {r["a"] for r in minhash._checked(pairs, docs, 0.8, block).collect()} == want and want


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(8), 20, 10)
    rows += [(1000 + i, rows[4][1]) for i in range(30)] + [(2000 + i, "") for i in range(5)]
    docs = spark.createDataFrame([*rows, (None, "x y z")], SCHEMA)
    prints = {i: simhash.fingerprint_of(t) for i, t in rows}
    least = groups([r for r in rows if r[1]]) | {i: i for i, t in rows if not t}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    near += [(i, j) for i, j in least.items() if i != j]
    for _ in range(20):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs).where("doc_id is not null").collect())
    assert kept == sorted(i for i, j in least.items() if i == j)


@pytest.mark.parametrize("large", [2, 4096])
def test_fingerprints_link_however_groups_are_split(spark, large):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), large).collect()
    least = {f: f for f in fps}
    want = dict(least)
    plain = lambda x: x & ((1 << 64) - 1)
    for _ in range(len(fps)):
        for r in found:
            a, b = plain(r["a"]), plain(r["b"])
            least[a] = least[b] = min(least[a], least[b])
    for _ in range(20):
        for a in fps:
            for b in fps:
                if a < b and (a ^ b).bit_count() <= 3:
                    want[a] = want[b] = min(want[a], want[b])
    assert least == want


def test_op5_of_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (7, None), (9, "")], SCHEMA)
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(docs).collect()), key=str)
    assert found == sorted([(5, 2), (5, 2), (2, 2), (None, 2), (None, None), (7, 7), (9, 7)], key=str)
    assert simhash.components(docs.where("doc_id = 0")).count() == 0
