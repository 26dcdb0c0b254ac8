"""Patches, words, transcripts and streams against plain models of their semantics."""

import json
import random
from difflib import SequenceMatcher

import pytest

from parley.functions import text as T
from parley.functions import words as W
from parley.operators import patches as P
from parley.streaming import turns as R

ROWS = "recording string, id long, t0 double, t1 double, speaker string, text string, start string"


def plain(rows, patches):
    """One recording: rows by id, patches in order."""
    known = {r[1]: r for r in rows}

    def ids_of(p):
        if isinstance(p.get("source_ids"), list) and p["source_ids"]:
            ids = sorted({int(x) for x in map(str, p["source_ids"]) if x.strip().lstrip("-").isdigit()})
        else:
            ids = [int(p["id"])] if str(p.get("id")).strip().isdigit() else []
        return ids if ids and all(i in known for i in ids) else []

    given = [(ids_of(p), (p.get("speaker") or "").strip(), p.get("text") or "") for p in patches]
    root = {i: i for i in known}
    for _ in known:
        for ids, *_ in given:
            for i in ids:
                root[i] = min(root[j] for j in ids)
    out = []
    for r in sorted(set(root.values())):
        group = [i for i in known if root[i] == r]
        if len(group) > 1:
            parts = [g for g in given if len(g[0]) > 1 and g[0][0] in group]
            text = " ".join(t.strip() for _, _, t in parts if t.strip()) or " ".join(known[i][5] or "" for i in sorted(group)).strip()
            speaker = next((s for _, s, _ in parts if s), known[min(group)][4] or "")
            out.append((min(known[i][2] for i in group), max(known[i][3] for i in group), speaker, text, 0, r, 0))
            continue
        _, i, t0, t1, who, text, _ = known[r]
        own = [g for g in given if g[0] == [i]]
        said = [g for g in own if g[2].strip()]
        if len(own) > 1 and said:
            at, total = t0, sum(len(g[2]) for g in said)
            for k, (_, s, t) in enumerate(said):
                end = max(at + 0.1, at + len(t.strip()) / total * (t1 - t0) - 0.05) if k < len(said) - 1 else t1
                out.append((at, end, s or who or "", t.strip().lstrip("—- \t\n").capitalize(), 1, i, k))
                at = end + 0.05
        elif len(own) == 1:
            out.append((t0, t1, own[0][1] or who or "", own[0][2].strip() or text or "", 1, i, 0))
        else:
            out.append((t0, t1, who or "", text or "", 1, i, 0))
    out = [(round(a, 3), round(b, 3), *rest) for a, b, *rest in out]
    return [r[:4] for r in sorted(out, key=lambda r: (r[0], r[1], *r[4:]))]


def made(seed):
    rnd = random.Random(seed)
    rows = [(f"r{seed}", i, i * 4.0, i * 4.0 + rnd.choice([0.15, 2.0, 3.5]), rnd.choice(["a", "b", None]), rnd.choice(["one two", " x ", "three", None]), "clash") for i in range(1, 13)]
    patches = []
    for _ in range(14):
        ids = rnd.sample(range(1, 14), rnd.choice([1, 1, 1, 2, 2, 3]))
        patch = {"source_ids": ids} if rnd.random() < 0.7 else {"id": rnd.choice([ids[0], str(ids[0]), "x"]), "source_ids": []}
        patches.append(patch | {"text": rnd.choice(["— hello THERE", " ", "", "b", "quite a long part here\n"]), "speaker": rnd.choice(["", " ", "c", None])})
    return rows, patches


def test_patches_do_what_the_plain_model_does(spark):
    both = [made(seed) for seed in range(8)]
    rows = spark.createDataFrame([r for rows, _ in both for r in rows], ROWS)
    answers = [(rows[0][0], f"Sure.\n```\n{json.dumps(patches)}\n```" if i % 2 else json.dumps([*patches, 5, "x"])) for i, (rows, patches) in enumerate(both)]
    found = P.corrected(rows, P.parsed(spark.createDataFrame(answers, "recording string, answer string"))).orderBy("recording", "idx").collect()
    for own, patches in both:
        got = [(r["start"], r["end"], r["speaker"], r["text"]) for r in found if r["recording"] == own[0][0]]
        assert got == plain(own, patches)


def test_split_leaves_gaps_and_merge_leaves_none(spark):
    rows = spark.createDataFrame([("r", 1, 0.0, 8.0, "A", "one two", ""), ("r", 2, 9.0, 10.0, "A", "x", ""), ("r", 3, 10.0, 12.0, "B", "y", "")], ROWS)
    patches = [{"id": 1, "text": "- first half"}, {"id": 1, "speaker": "B", "text": "Second Half"}, {"source_ids": [3, 2]}]
    answers = spark.createDataFrame([("r", json.dumps(patches))], "recording string, answer string")
    found = P.corrected(rows, P.parsed(answers)).orderBy("idx").collect()
    assert [(r["speaker"], r["text"]) for r in found] == [("A", "First half"), ("B", "Second half"), ("A", "x y")]
    assert abs(found[1]["start"] - found[0]["end"] - 0.05) < 1e-9 and found[1]["end"] == 8.0
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("answer", [None, "", "no list", "{}", "[1, 2]", "[", '[{"id": 77, "text": "x"}]'])
def test_answers_without_patches_change_nothing(spark, answer):
    rows = spark.createDataFrame([("r", 1, 0.0, 1.0, None, None, "")], ROWS)
    patches = P.parsed(spark.createDataFrame([("r", answer)], "recording string, answer string"))
    assert [tuple(r) for r in P.corrected(rows, patches).collect()] == [("r", 0, 0.0, 1.0, "", "")]
    assert P.corrected(rows.limit(0), patches).count() == 0


def test_text_functions_take_every_white_space(spark):
    texts = [" \n a ", " ", None, " x y\u0085", "\x1cz\x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(T.stripped(rows.text)).collect()] == [t and t.strip() for t in texts]
    told = spark.createDataFrame([("r", 2, "b "), ("r", 1, " a"), ("r", 3, "\n"), ("r", 4, None)], "recording string, idx int, text string")
    assert T.transcript(told).first()["text"] == "a\nb"
    rows = spark.createDataFrame([("r", i, float(i), i + 1.0, t) for i, t in enumerate([" ", "x", "\n", None])], "recording string, idx int, t0 double, t1 double, text string")
    assert [r["id"] for r in T.indexed(rows).collect()] == [2]


def test_text_similarity_is_that_of_matching_blocks(spark):
    pairs = [("Hello there", "hello  World "), (None, ""), ("x", " "), ("abcd" * 80, "bcda" * 80), ("same", "SAME")]
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(T.similarity("a", "b")).collect()]
    clean = [((a or "").strip().lower(), (b or "").strip().lower()) for a, b in pairs]
    assert found == [float(a == b) if not a or not b else SequenceMatcher(None, a, b).ratio() for a, b in clean]


def test_word_times(spark):
    schema = "text string, speaker string, t0 double, words array<struct<text:string,start:double,end:double,confidence:double>>"
    rows = spark.createDataFrame([("A  b", "S", 1.5, [("A", 0.1, None, 0.5), ("b", None, 2.0, None)]), ("", "S", 0.0, None), (None, None, 2.0, [])], schema)
    found = rows.select(W.absolute(rows.words, rows.t0, rows.speaker).alias("w")).collect()
    assert [[tuple(w) for w in r["w"]] for r in found] == [[("A", 1600, 1600, 0.5, "S")], [], []]
    one = W.single_speaker(rows).collect()
    assert [(r["speaker"], r["text"], r["confidence"], r["start"], r["end"], len(r["words"])) for r in one] == [("—", "A b", None, 0, 2000, 2), ("—", "", None, 0, 0, 0), ("—", "", None, 0, 0, 0)]


def test_stream_of_turns_ends_as_the_batch_does(spark, tmp_path):
    schema = "recording string, seq long, start long, end long, text string, speaker string"
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.randrange(3), 9, rnd.choice(["x", " x", "y"]), rnd.choice(["", None, "A", "B"])) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    query = R.deduplicated_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len({r[0] for r in seen}) > 1
    last = {r[1:5]: r[5:] for r in sorted(seen, key=lambda r: r[0])}
    batch = R.deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert last == {(r["recording"], r["start"], r["end"], r["text"].strip()): (r["speaker"] or "", r["seq"], r["place"]) for r in batch}


def test_sessions_of_a_stream(spark, tmp_path):
    schema = "recording string, ts timestamp"
    rows = [("a", f"2024-01-01 10:{m:02d}:00") for m in (0, 4, 8, 30, 31)] + [("b", "2024-01-01 10:00:00"), ("z", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "recording string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = R.sessions(stream, "5 minutes", "1 minute").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("memory").queryName("found_sessions").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["recording"], r["n"]) for r in spark.table("found_sessions").collect()) == [("a", 2), ("a", 3), ("b", 1)]
