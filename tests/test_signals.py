"""Frame masks, signals, vectors, WAV files and sinks against plain models."""

import io
import itertools
import json
import math
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import signal as G
from parley.operators import frames as M
from parley.operators import intervals as I
from parley.operators import linkage as L
from parley.operators import sequences as S
from parley.operators import vectors as V
from parley.sources import sinks, wav

FRAMES = "recording string, chunk int, frame int, spk int, p double"


def path_score(path, posterior, overlap):
    k = posterior.shape[1]
    emit = np.log(np.clip(np.column_stack([posterior, 1 - posterior.max(axis=1)]), 1e-6, 1))
    total = sum(emit[t, s] for t, s in enumerate(path))
    for a, b in itertools.pairwise(path):
        if a == b == k:
            continue
        total += 0.2 - (0 if a == b else 1.2 if overlap else 1.4) - 0.6 * ((a == k) + (b == k))
    return total


@pytest.mark.parametrize("overlap", [False, True])
def test_best_path_beats_all_others(overlap):
    rnd = np.random.default_rng(3)
    for _ in range(5):
        posterior = rnd.random((6, 2)) ** 2
        best = max(path_score(p, posterior, overlap) for p in itertools.product(range(3), repeat=6))
        assert math.isclose(path_score(M.best_path(posterior, overlap), posterior, overlap), best)


def test_resegmented_turns(spark):
    on = {0: [0.95] * 10 + [0.02] * 10, 1: [0.02] * 12 + [0.97] * 8, 2: [0.9] * 20}
    rows = [("r", 0, t, s, p[t]) for s, p in on.items() for t in range(20)] + [("r", 1, 0, 0, 1.0), ("r", 2, 0, 0, None), ("r", 2, 1, 0, float("nan"))]
    clusters = spark.createDataFrame([("r", 0, 0, 4), ("r", 0, 1, 1), ("r", 0, 2, None), ("r", 1, 0, 0), ("r", 2, 0, 0)], "recording string, chunk int, spk int, cluster int")
    chunks = spark.createDataFrame([("r", c, 10.0, 12.0, 100.0, False) for c in range(3)], "recording string, chunk int, start double, end double, offset double, overlap boolean")
    found = sorted((round(r["t0"], 3), round(r["t1"], 3), r["cluster"]) for r in M.resegmented(spark.createDataFrame(rows, FRAMES), clusters, chunks).collect())
    assert [r[2] for r in found] == [4, 1] and found[0][0] == 110.0 and found[1][1] == 112.0 and abs(found[0][1] - 111.1) <= 0.1001


def test_many_chunks_are_searched_together(monkeypatch):
    """Chunks of mixed forms against one path each; a search for each form and block of CELLS, not for each chunk."""
    rnd, rows, want = np.random.default_rng(7), [], []
    for chunk in range(120):
        n, k, overlap = int(rnd.integers(1, 4)) * 5 - 4, int(rnd.integers(1, 4)), bool(chunk % 2)
        frames = np.sort(rnd.choice(40, n, replace=False))
        at, cluster = rnd.choice(frames, 2 * n), rnd.integers(0, k, 2 * n)
        cells = list(zip(at.tolist(), cluster.tolist(), (rnd.random(2 * n) ** 0.5).tolist(), strict=True)) if chunk % 7 else []
        rows.append({"recording": "r", "chunk": chunk, "k": k, "start": 1.0, "end": 4.0, "offset": 0.5, "overlap": overlap, "frames": frames.tolist(), "at": [c[0] for c in cells], "cluster": [c[1] for c in cells], "p": [c[2] for c in cells]})
        posterior = np.zeros((n, k))
        for f, c, p in cells:
            i = frames.tolist().index(f)
            posterior[i, c] = max(posterior[i, c], p)
        path, i = M.best_path(posterior, overlap).tolist(), 0
        for state, run in itertools.groupby(path):
            j = i + len(list(run))
            if n > 1 and state != k and (j - i) * 3.0 / n >= 0.1:
                want.append((chunk, 1.5 + i * 3.0 / n, 1.5 + j * 3.0 / n, state))
            i = j
    kinds = {"k": pa.int64(), "frames": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "cluster": pa.list_(pa.int64()), "p": pa.list_(pa.float64())}
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c)) for c in rows[0]], names=list(rows[0]))
    calls, search = [], M.best_paths
    monkeypatch.setattr(M, "best_paths", lambda *args: calls.append(1) or search(*args))
    for cells, most in ((1 << 20, 12), (200, 120)):
        monkeypatch.setattr(M, "CELLS", cells)
        calls.clear()
        found = sorted((r["chunk"], r["t0"], r["t1"], r["cluster"]) for r in M._path_turns(batch).to_pylist())
        assert len(calls) <= most and len(found) == len(want) > 50
        assert all(f[0] == w[0] and f[3] == w[3] and math.isclose(f[1], w[1]) and math.isclose(f[2], w[2]) for f, w in zip(found, want, strict=True))
    assert M._path_turns(batch.slice(0, 0)).num_rows == 0


def test_exclusive_regions_fall_back_when_few(spark):
    rows = [("r", 0, t, s, [0.5, 0.1][s] if t < 6 else [0.5, 0.48][s]) for t in range(8) for s in (0, 1)] + [("r", 1, t, s, [0.46, 0.4][s]) for t in range(4) for s in (0, 1)]
    frames = spark.createDataFrame(rows, FRAMES)
    keep = {(r["chunk"], r["spk"], r["frame"]): r["keep"] for r in M.exclusive_region(frames).collect()}
    assert [keep[0, 0, t] for t in range(8)] == [True] * 6 + [False] * 2
    assert [keep[0, 1, t] for t in range(8)] == [False] * 6 + [True] * 2  # fewer than five: own p alone
    assert all(keep[1, 0, t] and not keep[1, 1, t] for t in range(4))
    runs = {(r["chunk"], r["spk"]): (r["first"], r["n"]) for r in M.usable_runs(frames).collect()}
    assert runs == {(0, 0): (0, 6)}
    assert M.usable_runs(frames.limit(0)).count() == 0


def test_masked_samples_are_interpolated(spark):
    rnd = np.random.default_rng(1)
    x, mask = rnd.normal(size=50), rnd.random(8)
    row = spark.createDataFrame([(x.tolist(), mask.tolist())], "x array<double>, m array<double>")
    want = x * np.clip(np.interp(np.linspace(0, 1, 50, endpoint=False), (np.arange(8) + 0.5) / 8, mask), 0, 1)
    assert np.allclose(row.select(M.masked(row.x, row.m)).first()[0], want)


def tone(hz, seconds, rate=16000, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_signal_functions(spark):
    x = np.concatenate([np.zeros(4000), tone(120, 1.0), tone(240, 1.6), np.zeros(3000)])
    df = spark.createDataFrame([(x.tolist(),), ([],), (None,), (tone(100, 0.3).tolist(),)], "x array<double>")
    got = df.select(G.best_stretch(df.x).alias("s"), F.size(G.embedding_input(df.x)).alias("n"), F.size(G.embedding_input(df.x, whole=False)).alias("cut"), G.frame_rms(df.x, 320, 160).alias("r"), G.pitch(df.x).alias("p"), F.size(G.crop(df.x, F.lit(0.5), F.lit(1.0))).alias("c")).collect()
    start, end = got[0]["s"]
    assert 18000 <= start <= 22000 and abs(end - 45600) <= 2000 and got[0]["n"] == got[0]["cut"] == end - start and got[0]["c"] == 8000
    want = [math.sqrt((x[i : i + 320] ** 2).mean()) for i in range(0, len(x) - 319, 160)]
    assert np.allclose(got[0]["r"], want)
    assert [(r["s"], r["r"] if r["r"] else None) for r in got[1:3]] == [(None, None)] * 2 and got[3]["s"] is None
    assert abs(got[3]["p"] - 100) < 1.5


def test_steadiest_needs_voice():
    assert G.steadiest(np.zeros(0)) is None and G.steadiest(np.full(100, 0.1)) is None
    assert G.steadiest(tone(100, 0.5)) is None
    start, end = G.steadiest(np.concatenate([tone(100, 1.0), np.zeros(8000), tone(150, 2.0)]))
    assert start >= 23000 and end == 56000


def wav_bytes(samples, rate=16000, channels=1, width=2):
    with wave.open(out := io.BytesIO(), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(b"".join(int(s).to_bytes(width, "little", signed=True) for s in samples))
    return out.getvalue()


def test_wav_files(spark, tmp_path):
    mono, stereo = [1, -2, 3000, -32768], [10, 20, -5, -6, 7, 8]
    files = {"mono": wav_bytes(mono), "stereo": wav_bytes(stereo, channels=2), "wide": wav_bytes([1 << 20, -(1 << 20)], width=3), "slow": wav_bytes([0, 100, 200], rate=8000), "bad": b"RIFF?", "many": wav_bytes([0] * 6, channels=3), "none": wav_bytes([])}
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    found = {r["recording"].rsplit("/", 1)[1][:-4]: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    ids = {k: list(struct.unpack(f"<{len(r['pcm']) // 2}h", r["pcm"])) for k, r in found.items() if r["error"] is None}
    assert ids == {"mono": mono, "stereo": [15, -6, 7], "wide": [4096, -4096], "slow": [0, 50, 100, 150, 200], "none": []}
    assert found["mono"]["samples"] == [s / 32768 for s in mono] and {k for k, r in found.items() if r["error"]} == {"bad", "many"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "B", 1.0, 2.0, "é"), ("r", 0, "A", 0.0, 1.0, None), ("q", 0, "A", 0.0, 1.0, "x")], "recording string, idx int, speaker string, start double, end double, text string")
    found = {r["recording"]: r["json"] for r in sinks.json_documents(rows).collect()}
    assert json.loads(found["r"]) == [{"speaker": "A", "start": 0.0, "end": 1.0, "text": None}, {"speaker": "B", "start": 1.0, "end": 2.0, "text": "é"}] and "é" in found["r"]
    sinks.write_json(rows, str(tmp_path / "out"))
    assert sorted(r["document"] for r in spark.read.format("text").load(str(tmp_path / "out")).select("document").distinct().collect()) == ["q_diarization_asr.json", "r_diarization_asr.json"]
    assert sinks.titled(sinks.json_documents(rows), "utterances").where("recording = 'q'").first()["text"].startswith("\n--- utterances ---\n[")
    assert {(r["name"], r["value"]) for r in sinks.run_parameters(spark, "1", {"gap": 0.4, "llm": None}).collect()} == {("gap", "0.4"), ("llm", None)}


def vectors(seed, n, groups, noise):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, 6))
    return [centres[rnd.integers(groups)] + noise * rnd.normal(size=6) for _ in range(n)]


def test_clusters_merge_pair_by_pair(spark):
    rows, want = [], {}
    for seed in range(6):
        x = np.array(vectors(seed, 30, 5, 0.5))
        label = np.random.default_rng(seed).integers(0, 9, 30)
        rows += [(f"r{seed}", i, int(label[i]) * 2, x[i].tolist()) for i in range(30)]
        unit, now = x / np.linalg.norm(x, axis=1, keepdims=True), label * 2
        while True:
            names = sorted(set(now.tolist()))
            c = [unit[now == k].mean(axis=0) for k in names]
            near = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if c[a] @ c[b] / np.linalg.norm(c[a]) / np.linalg.norm(c[b]) >= 0.5]
            if not near:
                break
            now = np.where(now == names[near[0][1]], names[near[0][0]], now)
        want |= {(f"r{seed}", i): sorted(set(now.tolist())).index(int(now[i])) for i in range(30)}
    df = spark.createDataFrame([*rows, ("none", 0, 3, None)], "recording string, idx int, cluster int, embedding array<double>")
    found = {(r["recording"], r["idx"]): r["cluster"] for r in V.merge_clusters(df, 0.5).collect()}
    assert found.pop(("none", 0)) is None and found == want


def test_speakers_merge_in_chains(spark):
    ring = [[math.cos(a), math.sin(a)] for a in (0.0, 0.3, 0.6, 2.0)]
    rows = [("r", i, "dcba"[i], v) for i, v in enumerate(ring)] + [("gap", i, "ba"[i % 2], ring[0] if i else None) for i in range(3)]
    df = spark.createDataFrame(rows, "recording string, idx int, speaker string, embedding array<double>")
    assert sorted((r["recording"], r["idx"], r["speaker"]) for r in V.merge_speakers(df, 0.95).collect()) == [("gap", 0, "b"), ("gap", 1, "a"), ("gap", 2, "b"), ("r", 0, "b"), ("r", 1, "b"), ("r", 2, "b"), ("r", 3, "a")]


def test_joint_similarity_and_partition(spark):
    x = vectors(1, 12, 2, 0.05)
    rows = [("r", i, i * 1.0, i + 0.5, f"text {i % 3}", x[i].tolist()) for i in range(12)] + [("r", 99, 0.0, 1.0, None, None), ("one", 0, 0.0, 1.0, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "recording string, idx int, t0 double, t1 double, text string, embedding array<double>")
    edges = V.joint_similarity(df)
    found = {(r["i"], r["j"]): r["sim"] for r in edges.collect()}
    assert len(found) == 66 and all(0 <= s <= 1 for s in found.values())
    unit = [v / np.linalg.norm(v) for v in x]
    text = spark.createDataFrame([("text 0", "text 1")], "a string, b string").select(V.text_similarity("a", "b")).first()[0]
    assert math.isclose(found[0, 1], 0.55 * (unit[0] @ unit[1] + 1) / 2 + 0.25 * text + 0.2 * math.exp(-1 / 3), rel_tol=1e-9)
    labels = {(r["recording"], r["idx"]): r["cluster"] for r in V.graph_partition(V.joint_similarity(df, (1.0, 0.0, 0.0)), df.where("embedding is not null"), 2).collect()}
    same = [unit[0] @ u > 0.9 for u in unit]
    assert [labels["r", i] == labels["r", 0] for i in range(12)] == same and labels["one", 0] == 0


def test_agglomerate_numbers_by_first_row(spark):
    rows = [("r", i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.9, 0.1], [0.1, 0.9]])]
    df = spark.createDataFrame(rows, "recording string, idx int, embedding array<double>")
    for how in ({"k": 2}, {"threshold": 0.3}):
        assert [r["cluster"] for r in L.agglomerate(df, **how).orderBy("idx").collect()] == [0, 1, 0, 1]
    assert [V.distance_threshold(s) for s in (0.4, 1.0, 7, -3)] == [0.6, 1 - 0.999, 1 - 0.999, 2.0]


def test_one_recording_of_many_turns(spark):
    n = 100_000
    t0 = F.col("id") * 0.5
    turns = spark.range(n).select(F.lit("r").alias("recording"), F.col("id").alias("idx"), t0.alias("t0"), (t0 + 0.2 + (F.col("id") % 5)).alias("t1"), F.concat(F.lit("s"), F.col("id") % 3).alias("speaker"))
    assert I.resolve_overlaps(turns).count() > 0 and I.flatten(turns).count() > 0
    assert I.absorb_short(turns, 1.0).count() > 0 and S.remove_micro_switches(turns, 0.3).count() == n
    vad = I.merge_intervals(turns.where("idx % 100 < 50"), 0.1)
    assert I.clip(turns, vad).count() > 0


@pytest.mark.parametrize("how", [{"k": 3, "threshold": None}, {"k": None, "threshold": 0.6}])
def test_average_linkage_joins_the_nearest_clusters(how):
    for seed in range(5):
        x = np.random.default_rng(seed).normal(size=(14, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        distance = 1 - x @ x.T
        clusters = [{i} for i in range(14)]
        while len(clusters) > (how["k"] or 1):
            mean = {(i, j): np.mean([distance[a, b] for a in clusters[i] for b in clusters[j]]) for i, j in itertools.combinations(range(len(clusters)), 2)}
            i, j = min(mean, key=mean.get)
            if how["threshold"] is not None and mean[i, j] >= how["threshold"]:
                break
            clusters[i] |= clusters.pop(j)
        merged = sorted(L.merges(x, np.ones(14), how["threshold"] or np.inf), key=lambda m: m[2])
        got = np.arange(14)
        for a, b, _ in merged[: 14 - how["k"]] if how["k"] else merged:
            got[got == got[b]] = got[a]
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == set(map(frozenset, clusters))
