"""Operators against plain models of their semantics, on random intervals."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import intervals as I
from parley.operators import linkage as L
from parley.operators import sequences as S
from parley.streaming import turns as R

SCHEMA = "recording string, idx long, t0 double, t1 double, speaker string"


def rows_of(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for r in "ab":
        for i in range(40):
            t0 = rnd.randrange(200) / 2
            out.append((r, i, t0, t0 + rnd.randrange(0, 20) / 4, rnd.choice("XYZ")))
    return out + [("a", 99, None, 1.0, "X")]


def by_recording(rows: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for r in rows:
        if r[2] is not None:
            out.setdefault(r[0], []).append(r)
    return out


def merged(rows, gap, min_len):
    out = []
    for rec, own in by_recording(rows).items():
        cur = None
        for t0, t1 in sorted((r[2], r[3]) for r in own if r[3] > r[2]):
            if cur and t0 - cur[1] <= gap:
                cur[1] = max(cur[1], t1)
            else:
                cur = [t0, t1]
                out.append((rec, cur))
    return sorted((rec, a, b) for rec, (a, b) in out if b - a >= min_len)


def flat(rows, min_len):
    out = []
    for rec, own in by_recording(rows).items():
        at = None
        for t0, t1, who in sorted((r[2], r[3], r[4]) for r in own):
            s = t0 if at is None else max(t0, at)
            if t1 - s >= min_len:
                out.append((rec, s, t1, who))
                at = t1
    return sorted(out)


def switched(rows, min_run):
    out = []
    for rec, own in by_recording(rows).items():
        own = sorted(own, key=lambda r: r[1])
        who = [r[4] for r in own]
        for i in range(1, len(own) - 1):
            if who[i - 1] == who[i + 1] != who[i] and own[i][3] - own[i][2] < min_run:
                who[i] = who[i - 1]
        out += [(rec, r[1], w) for r, w in zip(own, who, strict=True)]
    return sorted(out)


def test_slices_of_turns_as_step_functions():
    """Whatever end comes in, the end that goes out is that of the fold."""
    rnd = random.Random(8)
    for _ in range(300):
        turns = sorted((a, a + rnd.randrange(4, 40) / 4) for a in (rnd.randrange(60) / 4 for _ in range(rnd.randrange(1, 25))))
        for min_len in (0.0, 1.0):
            reach, exits = I._exits(I.np.array([t1 for _, t1 in turns]), min_len)
            for end in [x / 4 for x in range(-4, 110)]:
                at = end
                for t0, t1 in turns:
                    at = t1 if t1 - max(t0, at) >= min_len else at
                entry = next((i for i, x in enumerate(reach) if x - end >= min_len), None)
                assert at == (end if entry is None else exits[entry])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_models(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, I.merge_intervals(df, 1.0, 1.5).select("recording", "t0", "t1").collect())) == merged(rows, 1.0, 1.5)
    assert sorted(map(tuple, I.flatten(df, 1.0).collect())) == flat(rows, 1.0)
    for min_len, size in ((1.0, 3), (0.0, 5), (2.5, 1)):
        assert sorted(map(tuple, I.flatten(df, min_len, rows=size).collect())) == flat(rows, min_len)
    clean = df.where("t0 is not null")
    for size in (8192, 3, 1):
        assert sorted(map(tuple, S.remove_micro_switches(clean, 2.0, rows=size).select("recording", "idx", "speaker").collect())) == switched(rows, 2.0)


def test_resolved_turns_are_disjoint(spark):
    found = sorted(map(tuple, I.resolve_overlaps(spark.createDataFrame(rows_of(3), SCHEMA)).select("recording", "t0", "t1").collect()))
    assert found and all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_later_start_wins(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 10.0, "X"), ("a", 1, 4.0, 6.0, "Y")], SCHEMA)
    assert sorted(map(tuple, I.resolve_overlaps(df).select("t0", "t1", "speaker").collect())) == [(0.0, 4.0, "X"), (4.0, 6.0, "Y"), (6.0, 10.0, "X")]


def test_speech_chunks(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 50.0, "X", [3.0, 17.0, 19.5]), ("b", 0, 0.0, 5.0, "X", None)], SCHEMA + ", cuts array<double>")
    assert sorted(map(tuple, I.speech_chunks(df).select("recording", "part", "t0", "t1").collect())) == [("a", 0, 0.0, 17.0), ("a", 1, 17.0, 19.5), ("a", 2, 19.5, 39.5), ("a", 3, 39.5, 50.0), ("b", 0, 0.0, 5.0)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for found in (I.merge_intervals(df, 1.0), I.flatten(df), I.resolve_overlaps(df), I.postprocess_turns(df), S.chronological_names(df), S.longest_run(df)):
        assert found.count() == 0


def test_names(spark):
    df = spark.createDataFrame([("a", 0, 5.0, 6.0, "q"), ("a", 1, 1.0, 2.0, "r")], SCHEMA)
    assert sorted(map(tuple, S.chronological_names(df, letters=True).select("idx", "speaker").collect())) == [(0, "B"), (1, "A")]


def test_average_linkage(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 0.1]), ("a", 3, None)], "recording string, idx long, embedding array<double>")
    assert sorted(map(tuple, L.agglomerate(df, threshold=0.5).select("idx", "cluster").collect())) == [(0, 0), (1, 1), (2, 0)]


def test_transcript(spark):
    df = spark.createDataFrame([(" a.... b  c!!! é",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalised(df.t)).collect()] == ["a.. b c!! é", None]


def test_labelled_turn_stays(spark):
    df = spark.createDataFrame([("a", 1, 0, 5, "", "hi"), ("a", 2, 0, 5, "A", "hi "), ("a", 3, 0, 5, "", "hi")], "recording string, seq long, start int, end int, speaker string, text string")
    assert [tuple(r) for r in R.deduplicated(df).select("place", "seq", "speaker").collect()] == [(1, 2, "A")]


def resolved(rows):
    out = []
    for rec, own in by_recording(rows).items():
        own = [r for r in own if r[3] > r[2]]
        points, runs = sorted({t for r in own for t in r[2:4]}), []
        for a, b in zip(points, points[1:], strict=False):
            over = [r for r in own if r[2] <= a and r[3] >= b]
            if b - a >= 1e-9 and over:
                who = max(over, key=lambda r: (r[2], -r[1]))[4]
                if runs and runs[-1][2] == who and abs(runs[-1][1] - a) < 1e-6:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, who])
        out += [(rec, *run) for run in runs]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0.5, 7.0, 60.0, 1e6])
def test_resolved_turns_against_all_pieces(spark, size):
    """Bins of any size: turns over many of them, nested ones, gaps, equal starts, null speakers, ends a rounding apart."""
    rnd = random.Random(11)
    rows = rows_of(4) + [("c", i, float(i), 100.0 - i, rnd.choice("XY")) for i in range(45)] + [("c", 50, 300.0, 301.0, "X")]
    rows += [("d", i, t0, t0 + rnd.choice([0.1, 3.0, 40.0]), rnd.choice(["X", None])) for i, t0 in enumerate(rnd.randrange(-300, 300) / 10 for _ in range(60))]
    rows += [("e", 0, 0.0, 0.3, "X"), ("e", 1, 0.1 + 0.2, 1.0, "X"), ("e", 2, 0.3, 0.1 + 0.2, "Y"), ("e", 3, 5.0, 5.0, "Z"), ("e", None, 0.0, 2.0, "W")]
    found = I.resolve_overlaps(spark.createDataFrame(rows, SCHEMA), size=size)
    want = resolved([r for r in rows if r[1] is not None] + [("e", 1e9, 0.0, 2.0, "W")])
    assert sorted(map(tuple, found.select("recording", "t0", "t1", "speaker").collect()), key=str) == want


def rows_between_operators(spark, run):
    """Sum of the rows that all nodes of the plans put out while `run` ran."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    done, total = store.executionsList(), 0
    for i in range(before, done.size()):
        nodes, values = store.planGraph(done.apply(i).executionId()).allNodes(), store.executionMetrics(done.apply(i).executionId())
        metrics = [m for n in range(nodes.size()) for m in (nodes.apply(n).metrics().apply(k) for k in range(nodes.apply(n).metrics().size()))]
        found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
        total += sum(int(x.get().replace(",", "")) for x in found if x.isDefined())
    return total


def test_rows_of_resolving_follow_the_turns(spark):
    """3,000 turns that all overlap take some rows each in every step, not one for each turn over each piece."""
    n = 3000
    turns = spark.range(n).select(F.lit("r").alias("recording"), F.col("id").alias("idx"), (F.col("id") * 0.01).alias("t0"), (F.col("id") * 0.01 + 50).alias("t1"), F.concat(F.lit("s"), F.col("id") % 3).alias("speaker"))
    assert 0 < rows_between_operators(spark, lambda: I.resolve_overlaps(turns).count()) < 100 * n


def test_rows_of_postprocessing_follow_the_turns(spark):
    n = 2000
    turns = spark.range(n).select(F.lit("r").alias("recording"), F.col("id").alias("idx"), (F.col("id") * 0.01).alias("t0"), (F.col("id") * 0.01 + 50).alias("t1"), F.concat(F.lit("s"), F.col("id") % 3).alias("speaker"))
    assert 0 < rows_between_operators(spark, lambda: I.postprocess_turns(turns).count()) < 200 * n
