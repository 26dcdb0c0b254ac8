"""Training-data operators against brute force on small tables, with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, katz, mixing, quality, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, source string, spans string, fp int"


def table(spark, rows):
    """Documents with two columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA)


def texts(seed):
    rnd = random.Random(seed)
    shared = "".join(rnd.choice("abcd é") for _ in range(300))
    rows = []
    for i in range(40):
        t = "".join(rnd.choice("abc def gh") for _ in range(rnd.randrange(300)))
        if i % 3 == 0:
            a = rnd.randrange(200)
            t = t[:50] + shared[a : a + rnd.randrange(40, 160)] + t[50:]
        rows.append((i, t))
    return [*rows, (None, shared), (5, rows[5][1]), (200, None), (201, ""), (202, shared), (203, shared), (204, "é" * 60), (205, "é" * 61)]


def cut(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49 if i is not None else 0):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [texts(1), [(1, None)], []])
def test_suffix_dedup(spark, rows):
    found = suffix_dedup.repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect()), key=str) == cut(rows)


def test_remove_repeats_keeps_columns_and_rows(spark):
    docs = table(spark, texts(2))
    found = suffix_dedup.remove_repeats(docs)
    assert found.schema == docs.schema and found.count() == docs.count()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_agrees_with_plain_counts(spark, order):
    rows = [(i, random.Random(i).choice(["a b c", "a b d a b", "", "c C c", "zz", "a b c a b d", "d a"])) for i in range(40)] + [(40, None), (None, "a b")]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = katz.score(table(spark, rows), fold != 1, order).collect()
    words = lambda t: (t or "").lower().split() + [None]
    padded = lambda ws: [None] * (order - 1) + ws
    taught = [words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {n: Counter(tuple(padded(ws)[k - n + order : k + order]) for ws in taught for k in range(len(ws))) for n in range(1, order + 1)}
    total = sum(counts[1].values())
    d = {n: katz.discounts([0.0, *(float(sum(v == r for v in c.values())) for r in range(1, 7))]) for n, c in counts.items()}
    keep = lambda n, c: d[n][c] if c <= 5 else 1.0
    low = sum(c * (1 - keep(1, c)) for c in counts[1].values())

    def p(gram):
        n, c = len(gram), counts[len(gram)][gram]
        if n == 1:
            return keep(1, c) * c / total * (1 if low else total / (total + 1)) if c else (low / total if low else 1 / (total + 1))
        after = {g: k for g, k in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        left, mass = sum(k * (1 - keep(n, k)) for k in after.values()), sum(after.values())
        left, mass = (left, mass) if left else (1, mass + 1)
        return keep(n, c) * c / mass if c else left / mass / (1 - sum(p(g[1:]) for g in after)) * p(gram[1:])

    want = Counter()
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((counts[1][(w,)] + 0.5) / (total + 0.5 * (len(counts[1]) + 1))) for w in ws)
        score = sum(math.log10(p(tuple(padded(ws)[k : k + order]))) for k in range(len(ws)))
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 5 != 1, len(ws), sum(counts[1][(w,)] > 0 for w in ws), round(base, 6), round(score, 6))] += 1
    assert Counter((r["doc_id"], bool(r["teaches"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in found) == want
    assert {r["train_tokens"] for r in found} == {total}
    for context in {g[:-1] for g in counts[order]}:  # probabilities after a context add up to 1, unknown words taken as one
        assert abs(sum(p((*context, *g)) for g in counts[1]) + p((*context, "never")) - 1) < 1e-9
    assert katz.score(table(spark, []), fold != 1, order).count() == 0


def test_simhash_components(spark):
    rows = [(i, " ".join(random.Random(i // 2).choices("abcdefghij", k=60))) for i in range(20)] + [(30, None), (31, ""), (32, "one")]
    found = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.components(table(spark, rows)).collect()}
    prints = {i: simhash.fingerprint_of(t) for i, t in rows}
    component = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    component[a] = component[b] = min(component[a], component[b])
    assert found == {i: (prints[i], component[i]) for i in prints}


def test_near_copies_beyond_three_bits_go(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(30):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            changed = list(words)
            for at in rnd.sample(range(200), j * j):  # 5 shingles a word: similarities of about 0.95, 0.82 and 0.64
                changed[at] = "x"
            rows.append((10 * i + j, " ".join(changed)))
    rows += [(900, "one"), (901, "ONE "), (902, None), (903, ""), (None, "one")]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if i is not None for w in [(t or "").lower().split()]}
    prints = {i: simhash.fingerprint_of(t) for i, t in rows if i is not None}
    first = {i: i for i in prints}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    links = [(a, b) for a in prints for b in prints if a < b and (alike(a, b) or (prints[a] ^ prints[b]).bit_count() <= 3)]
    assert any((prints[a] ^ prints[b]).bit_count() > 3 for a, b in links)
    for _ in prints:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    found = sorted((r["doc_id"] for r in simhash.keep_first(table(spark, rows)).select("doc_id").collect()), key=str)
    assert found == sorted([None, *(i for i in prints if first[i] == i)], key=str)
    assert simhash.keep_first(table(spark, [])).count() == 0


def test_mixing_meets_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", None][i % 3], "x", 1) for i in range(300)] + [(400, None, "a", "x", 1)], SCHEMA)
    rows = mixing.plan(docs).collect()
    for source in ("a", "b", None):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)
    mixed = mixing.mix(docs).select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).agg(F.sum("n")).first()[0]
    assert mixed == sum(r["taken"] for r in rows)


@pytest.mark.parametrize("rows", [[(1, "a b c d e"), (1, "f g h i j k"), (2, None)], [(None, "a b c"), (None, "a b c"), (None, "d e"), (3, "x y z")], [(1, None), (2, "")], []])
def test_mix_takes_what_the_plan_says(spark, rows):
    """Repeated and null ids included: words of the mix are the plan's, and no text stands more often than its epochs allow."""
    docs = table(spark, rows)
    taken = mixing.plan(docs).agg(F.sum("taken")).first()[0] or 0
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    out = [r["text"] for r in mixed.collect()]
    assert sum(len(t.split()) for t in out) == taken
    assert all(sum(x == t for x in out) <= 2 * sum(r[1] == t for r in rows) for t in out if any(r[1] == t for r in rows))
    assert sum(map(len, map(str.split, out))) >= 0.9 * min(2.0, 1.5) * sum(len((t or "").split()) for _, t in rows)


def test_quality_counts(spark):
    rows = [(1, "a b c a b c"), (2, None), (3, ""), (4, "é#\n\né#\nx"), (5, " ".join(f"word{i} of note{i * i}" for i in range(200)))]
    found = {r["doc_id"]: r for r in quality.measure(table(spark, rows)).collect()}
    assert [found[1][c] for c in ("n_words", "word_chars", "n_repeat_words", "kept")] == [6, 6, 6, False]
    assert [found[4][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")] == [3, 5, 2, 1]
    assert found[2]["n_words"] == found[3]["n_words"] == 0 and found[2]["base_failed"]


def test_quality_bands_drop_junk(spark):
    rnd = random.Random(7)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    vocabulary = ["".join(rnd.choices(letters, range(26, 0, -1), k=rnd.randrange(2, 11))) for _ in range(4000)]
    prose = lambda n: rnd.choices(vocabulary, [1 / (k + 5) for k in range(4000)], k=n)
    clean = [" ".join(prose(rnd.randrange(250, 3000))) for _ in range(400)]
    symbols = [" ".join(w + rnd.choice("#$%&*") * 3 for w in prose(n)) for n in (1000, 1300, 1600)]
    menus = [" | ".join(prose(n)) for n in (400, 800, 1600)]
    noise = [" ".join("".join(rnd.choices(letters + letters.upper() + "0123456789", k=12)) for _ in range(n)) for n in (150, 400, 800)]
    half = [" ".join(prose(300)) + "\n" + " | ".join(prose(700))]  # under 8 KB: the chunks tell
    rows = [*enumerate(clean), *enumerate([*symbols, *menus, *noise, *half], 1000), (2000, None), (2001, "")]
    docs = table(spark, rows)
    kept = [r["doc_id"] for r in quality.keep(docs).select("doc_id").collect()]
    assert [i for i in kept if i >= 1000] == [] and len(kept) >= 395
    assert sorted(kept) == sorted(r["doc_id"] for r in quality.measure(docs).where("kept").collect())


def test_bpe_agrees_with_tiktoken(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello  world\n\n été naïve 12345 \t x"), (2, None), (3, ""), (4, "aaaa" * 500), (5, "日本語 テキスト 🎉🎉"), (6, "it's I'LL <|endoftext|>")]
    found = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"]).decode()) for r in bpe.decode(bpe.encode(table(spark, rows), path, public.PATTERN), path).collect()}
    assert found == {i: (encoding.encode_ordinary(t or ""), t or "") for i, t in rows}


@pytest.mark.parametrize("rows", [[(1, "Hello  world\n\n été 12345"), (2, None), (3, ""), (3, ""), (None, "aaaa" * 500), (5, "日本語 🎉")], []])
def test_one_pass_gives_the_digests_of_two(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, rows)
    two = bpe.decode(bpe.encode(docs, path, public.PATTERN), path).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = sorted(((r["doc_id"], len(r["ids"]), sha(",".join(map(str, r["ids"])).encode()), sha(bytes(r["decoded"])), list(r["ids"])) for r in two), key=str)
    assert sorted(((*r[:4], list(r[4])) for r in bpe.coded(docs, path, public.PATTERN, ids=True).collect()), key=str) == want
    assert sorted(map(tuple, bpe.coded(docs, path, public.PATTERN).collect()), key=str) == [r[:4] for r in want]
