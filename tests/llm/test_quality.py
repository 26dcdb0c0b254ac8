"""Quality rules: the counts against SQL, the verdict against a second reading of the bands."""

import math
import random

import duckdb
import pytest
import zstandard

from parley.llm import quality

COUNTS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
o AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM o, range(0, 3) s(k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_counts_agree_with_sql(spark, tmp_path, folder):
    path = f"{folder}/documents.parquet"
    if folder is None:
        rnd = random.Random(4)
        rows = [(i, "".join(rnd.choices(["a ", "b ", "é#", "\n", "\t", "$x ", " ", "\x0b"], k=rnd.randrange(200)))) for i in range(60)] + [(100, None), (101, ""), (102, "a a a a"), (103, "\n\n")]
        path = str(tmp_path / "documents")
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = sorted(tuple(r[c] for c in columns) for r in quality.measure(spark.read.parquet(path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}{'/*.parquet' if folder is None else ''}')")
        assert found == sorted(con.execute(COUNTS).fetchall())


def verdicts(texts, bands):
    """Kept or not, from the docstring alone."""
    packer = zstandard.ZstdCompressor(level=3)

    def passes(t):
        words = t.encode().split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        return len(words) >= 50 and 100 * len(often) <= 50 * len(words)

    def parts(data):
        size = 4096 if len(data) >= 8192 else 1024
        starts = [*range(0, len(data) - size + 1, size), *([len(data) - size] if len(data) > size and len(data) % size else [])]
        return size, [len(packer.compress(data[i : i + size])) / size for i in starts]

    good = [t.encode() for t in texts if passes(t)]
    step = lambda data: math.floor(4 * math.log2(len(data)))
    bin_of = lambda x: (int(x / 5e-4) + 0.5) * 5e-4
    whole = [(step(d), bin_of(len(packer.compress(d)) / len(d))) for d in good]
    chunks = [(size, bin_of(r)) for d in good for size, rs in [parts(d)] for r in rs]

    def limits(values, wide):
        """values: (ratio, weight)"""

        def median(pairs):
            pairs, below = sorted(pairs), 0.0
            for x, w in pairs:
                below += w
                if below >= sum(w for _, w in pairs) / 2 * (1 - 1e-9):
                    return x

        middle = median(values)
        spread = max(1.4826 * median([(abs(v - middle), w) for v, w in values]), 0.01 * middle)
        share = sum(w for _, w in values) ** 2 / (sum(w for _, w in values) ** 2 + bands.prior**2)
        return share * (middle - 3.5 * spread) + (1 - share) * wide[0], share * (middle + 6 * spread) + (1 - share) * wide[1]

    def kept(t):
        data = t.encode()
        if not passes(t):
            return False
        wide = next((lo, hi) for under, lo, hi in bands.whole if 2 ** ((step(data) + 0.5) / 4) < under)
        low, high = limits([(r, bands.fade ** abs(s - step(data))) for s, r in whole], wide)
        size, own = parts(data)
        of_size = [r for s, r in chunks if s == size]
        c_low, c_high = limits([(r, 1) for r in of_size], bands.chunk) if of_size else bands.chunk
        out = sum(not c_low <= r <= c_high for r in own) / len(own) if own else 0
        return low <= len(packer.compress(data)) / len(data) <= high and out <= 0.3

    return [kept(t) for t in texts]


def test_verdicts_follow_the_bands(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(900)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([40, 60, 150, 400, 1500]))) for _ in range(150)]
    texts += [" | ".join(rnd.choices(words, k=300)), " ".join("".join(rnd.choices("0123456789abcdefXYZ", k=20)) for _ in range(200)), " ".join(words[:60]) + " x" * 50, "é " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in quality.measure(docs).collect()}
    want = verdicts(texts, quality.Bands())
    assert [found[i] for i in range(len(texts))] == want and 0 < sum(want) < len(want)


def test_no_byte_of_the_end_goes_unjudged(spark):
    """Noise behind prose counts however many bytes of it there are, from a chunk's worth of the whole on."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(900)]
    prose = " ".join(rnd.choices(words, k=4000))
    noise = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=9000))
    clean = [(i, " ".join(rnd.choices(words, k=1500))) for i in range(60)]
    rows = [*clean, *((1000 + k, prose[:8192] + " " + noise[: 4095 + k]) for k in (0, 1, 2))]
    found = {r["doc_id"]: r["kept"] for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[1000 + k] for k in (0, 1, 2)] == [False] * 3 and sum(found[i] for i, _ in clean) >= 57


def test_one_more_text_moves_limits_little(spark):
    """No number of texts is a threshold: one more of 45 to 55 moves no limit by a twentieth of the band, and one text alone keeps the wide limits but for a part in prior squared + 1."""
    bands = quality.Bands()
    schema = f"n int, measures struct<{quality._MEASURES.replace(' ', ':').replace(',:', ',')}>"
    rows = [(n, (60, 300, 0, 0, 0, False, 40, 0.36 + 0.001 * (37 * n % 80), 1024, [])) for n in range(80)]
    table = spark.createDataFrame(rows, schema)
    found = [quality.limits(table.where(f"n < {n}"), bands)[0, 40] for n in (1, *range(45, 56))]
    wide = next((lo, hi) for under, lo, hi in bands.whole if 2 ** (40.5 / 4) < under)
    share, own = 1 / (1 + bands.prior**2), (int(rows[0][1][7] / 5e-4) + 0.5) * 5e-4
    assert all(abs(f - ((1 - share) * w + share * own * (1 + s * 0.01))) < 1e-9 for f, w, s in zip(found[0], wide, (-bands.below, bands.above), strict=True))
    steps = [abs(a - b) for one, two in zip(found[1:], found[2:], strict=False) for a, b in zip(one, two, strict=True)]
    assert max(steps) < 0.05 * (found[1][1] - found[1][0])


def test_halves_differ_by_their_limits_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    half = quality.stored(quality.measured(docs.where("doc_id % 2 = 0")))
    whole = quality.stored(quality.measured(docs))
    ours = {r["doc_id"]: r["measures"] for r in half.collect()}
    assert all(r["measures"] == ours[r["doc_id"]] for r in whole.where("doc_id % 2 = 0").collect()) and len(ours) == 100
