"""Data sources and event-time streams: restarts, failures, and any cut into micro-batches."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.sources import pcm, wav
from parley.streaming import stateful as T
from parley.streaming import turns as R

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def sources(spark):
    pcm.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_slices_are_the_bytes_of_the_files(sources, tmp_path):
    rng = np.random.default_rng(1)
    data = {name: rng.bytes(n) for name, n in (("a", 3200 * 5), ("b", 3200 * 3 + 17), ("c", 12), ("d", 3200 * 9))}
    given, seen = tmp_path / "in", []
    given.mkdir()
    assert sources.read.format("pcm_slices").load(str(given)).count() == 0

    def run(names):
        for name in names:
            (given / f"{name}.pcm").write_bytes(data[name])
        (given / "other.txt").write_text("no audio")
        stream = sources.readStream.format("pcm_slices").option("taskSlices", 2).load(str(given))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()

    run("ab")
    first = len(seen)
    run("")  # a restart without news repeats nothing
    assert len(seen) == first == 5 + 4
    run("cd")
    assert len(seen) == len({r[:2] for r in seen})
    for name, whole in data.items():
        own = sorted((seq, bytes(part)) for recording, seq, part in seen if recording == name)
        assert [seq for seq, _ in own] == list(range(len(own))) and b"".join(p for _, p in own) == whole
    batch = sources.read.format("pcm_slices").option("sliceBytes", 1000).load(str(given))
    assert {r["recording"]: r["n"] for r in batch.groupBy("recording").agg(F.sum(F.length("pcm")).alias("n")).collect()} == {k: len(v) for k, v in data.items()}


def test_wav_files_round_trip_and_leave_nothing_on_failure(sources, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", [float(x) for x in rng.uniform(-1.2, 1.2, i * 50)]) for i in range(6)] + [("none", None)]
    table = sources.createDataFrame(rows, "recording string, samples array<double>").repartition(3)
    out = str(tmp_path / "wav")
    table.write.format("wav_files").mode("append").save(out)
    found = {os.path.basename(r["recording"]).removesuffix(".wav"): r for r in wav.read_wav(sources, out).collect()}
    assert set(found) == {r for r, _ in rows} and not any(r["error"] for r in found.values())
    for name, samples in rows:
        want = np.round(np.clip(np.array(samples or [], float), -1, 1) * 32767)
        assert np.frombuffer(found[name]["pcm"], "<i2").tolist() == want.astype(int).tolist()
    for bad in ([("ok", [0.1]), ("x/y", [0.1])], [("same", [0.1]), ("same", [0.2])]):
        with pytest.raises(Exception, match="not a name|twice"):
            sources.createDataFrame(bad, "recording string, samples array<double>").repartition(2).write.format("wav_files").mode("append").save(out)
        assert sorted(os.listdir(out)) == sorted(f"{r}.wav" for r, _ in rows)


def batches(spark, tmp_path, name, rows, schema, size):
    """A stream that takes `size` rows a batch."""
    folder = tmp_path / name
    folder.mkdir()
    for i in range(0, len(rows), size):
        (folder / f"{i:06d}.json").write_text("\n".join(json.dumps(r) for r in rows[i : i + size]))
        os.utime(folder / f"{i:06d}.json", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drained(stream, tmp_path, name):
    out = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_late_rows_of_a_turn_merge(sources, tmp_path):
    rng = random.Random(3)
    rows = []
    for turn in range(12):
        for copy in range(rng.randrange(1, 4)):
            rows.append({"recording": "r", "start": turn * 10, "end": turn * 10 + 5, "text": f" text {turn} "[copy % 2 :], "speaker": rng.choice(["", "A", None]), "ts": f"2024-01-01 00:00:{turn:02d}"})
    rng.shuffle(rows)
    rows = [{**r, "seq": i} for i, r in enumerate(rows)]
    batch = sources.createDataFrame([(r["recording"], r["start"], r["end"], r["text"], r["speaker"], r["seq"]) for r in rows], "recording string, start long, end long, text string, speaker string, seq long")
    want = {(r["start"], r["text"].strip(), r["speaker"] or "", r["seq"], r["place"]) for r in R.deduplicated(batch).collect()}
    last = [{"recording": "z", "start": 0, "end": 0, "text": "end", "speaker": "", "seq": 999 + i, "ts": "2024-01-01 01:00:00"} for i in range(2)]
    stream = batches(sources, tmp_path, "turns", rows + last, "recording string, start long, end long, text string, speaker string, seq long, ts timestamp", 7)
    found = drained(T.deduplicated_by_time(stream, "30 seconds", "30 seconds"), tmp_path, "turns")
    assert {(r[1], r[3], r[4], r[5], r[6]) for r in found if r[0] == "r"} == want and len([r for r in found if r[0] == "r"]) == len(want)


def frames_of(rng, n):
    out, t, voice = [], rng.randrange(0, 1000, 20), 0.9
    for _ in range(n):
        if rng.random() < 0.08:
            voice = rng.choice([0.05, 0.39, 0.4, 0.95])
        if rng.random() < 0.02:
            t += rng.choice([200, 1500])
        out.append((t, voice, rng.choice([0.0, 0.1, 0.25, 0.6, None])))
        t += 20
    return out


def plain(frames):
    """Every frame looked at with all those before it."""
    turns, open_at, heard = [], None, None
    for t, voice, sure in frames:
        if open_at is not None and t - heard >= 1280:
            turns.append((open_at, heard, "silence"))
            open_at = None
        if voice >= 0.4:
            open_at, heard = (t if open_at is None else open_at), t + 20
        elif open_at is not None:
            quiet = t + 20 - heard
            if quiet >= 1280 or quiet >= 250 and sure is not None and sure >= 0.25:
                turns.append((open_at, heard, "silence" if quiet >= 1280 else "confidence"))
                open_at = None
    return turns, (None if open_at is None else (open_at, heard))


@pytest.mark.parametrize("size", [61, 400])
def test_turns_end_alike_however_frames_are_batched(sources, tmp_path, size):
    rng = random.Random(4)
    given = {f"r{i}": frames_of(rng, rng.randrange(30, 150)) for i in range(20)}
    rows = sorted(({"recording": r, "t": t, "voice": v, "confidence": c} for r, frames in given.items() for t, v, c in frames), key=lambda r: r["t"])
    end = [{"recording": "z", "t": rows[-1]["t"] + 10_000 + i, "voice": 0.0, "confidence": None} for i in range(2)]
    schema = "recording string, t long, voice double, confidence double"
    stream = batches(sources, tmp_path, "frames", [*rows, *end], schema, size)
    found = sorted(drained(T.end_of_turns(stream), tmp_path, "frames"))
    want, over = [], []
    for r, frames in given.items():
        turns, still = plain(frames)
        want += [(r, i, *x) for i, x in enumerate([*turns, *([(*still, "silence")] if still else [])])]
        over += [(r, i, *x) for i, x in enumerate([*turns, *([(*still, "over")] if still else [])])]
    assert found == sorted(want) and len(want) > 40
    table = sources.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert sorted(map(tuple, T.end_of_turns_batch(table).collect())) == sorted(over)
