"""Conversation repair against plain dynamic programming over (cost, audit) and, on short conversations, against every possible edit."""

import hashlib
import random
import re
from functools import lru_cache
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from parley.llm import conversation_repair as C

FOLDER = "/root/testdata/sf0.01"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults_of(rows):
    """blank, duplicate, truncated or '' for each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(row, fault):
    """(letter, cost, role initial or '', line)"""
    _, role, text = row
    rest = 5 if fault == "truncated" else 0
    yield "D", 2, "", None
    if fault not in ("blank", "duplicate"):
        if role[:1] in ("s", "u", "a"):
            yield "K", rest, role[0], f"{role}:{text}"
        for other in ("user", "assistant"):
            yield "R", 1 + rest, other[0], f"{other}:{text}"


INSERTS = (("I", 5, "u", "user:"), ("I", 5, "a", "assistant:"))


def exhaustive(rows):
    """Cheapest (cost, audit, lines) over every choice at every turn, and up to two inserts at every place."""
    found, best = faults_of(rows), None
    gaps = [[], *([x] for x in INSERTS), *([x, y] for x, y in product(INSERTS, repeat=2))]
    for picks in product(*(list(options(r, f)) for r, f in zip(rows, found, strict=True))):
        for inserts in product(gaps, repeat=len(rows) + 1):
            edits = [e for i in range(len(rows) + 1) for e in (*inserts[i], *picks[i : i + 1])]
            if LEGAL.fullmatch("".join(e[2] for e in edits)):
                one = (sum(e[1] for e in edits), "".join(e[0] for e in edits), [e[3] for e in edits if e[3] is not None])
                best = one if best is None or one[:2] < best[:2] else best
    return best


def dynamic(rows):
    found, arcs = faults_of(rows), {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def rest(i, state, inserted):
        best = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for letter, cost, initial, line in INSERTS:
                if initial in arcs[state]:
                    more = rest(i, initial, inserted + 1)
                    best += [(cost + more[0], letter + more[1], (line, *more[2]))] if more else []
        if i < len(rows):
            for letter, cost, initial, line in options(rows[i], found[i]):
                if not initial or initial in arcs[state]:
                    more = rest(i + 1, initial or state, 0)
                    best += [(cost + more[0], letter + more[1], (*([line] if line is not None else []), *more[2]))] if more else []
        return min(best, default=None)

    return [rest(0, "", 0) for _ in (0,)][0]


def brute(rows, broken, solve=dynamic):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in broken if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, found = {r[0] for r in own} - {None}, faults_of(own)
        cost, audit, lines = solve(own) if own else (0, "", [])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def conversation(rng, n):
    text = lambda: rng.choice(["Yes.", "No!", "open", "", "  ", "Well? ", "é.\x1c", "No", "a" * rng.randrange(9) + "."])
    role = lambda: rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "u", "Assistant"])
    return [(rng.choice([None, *range(n)]), role(), text()) for _ in range(n)]


def test_every_edit_of_short_conversations():
    rng, automaton = random.Random(7), C.Automaton()
    for _ in range(60):
        rows = conversation(rng, rng.randrange(1, 4))
        assert dynamic(tuple(rows)) == (lambda b: (b[0], b[1], tuple(b[2])))(exhaustive(rows))
    for _ in range(400):
        rows = conversation(rng, rng.randrange(1, 30))
        turns = [None if f in ("blank", "duplicate") else (r[1][:1], f == "truncated") for r, f in zip(rows, faults_of(rows), strict=True)]
        states, minima, costs = automaton.scan(turns, C.END)
        edits, _ = automaton.trace(turns, states, minima, C.START, True)
        assert (costs[C.START], re.sub("[0-9]", "", "".join(edits))) == dynamic(tuple(rows))[:2]
    assert len(automaton.vectors) < 200  # few states are ever met


@pytest.mark.parametrize("size", [(1, 10), (3, 20), (4096, 1 << 22)])
def test_random_conversations(spark, size):
    """Whatever the slices, the result is that of the whole conversation."""
    rng = random.Random(3)
    rows = [(conv, *r) for conv in [*range(40), None, -5] for r in conversation(rng, rng.randrange(1, 40))]
    rows += [(500, 2, "user", "Hi."), (500, 2, "user", "Hi."), (500, 2, "user", "Hi."), (501, None, None, None), (502, 7, "system", "Be kind.")]
    rows = [(c, t, r if rng.random() < 0.95 else None, x if rng.random() < 0.95 else None) for c, t, r, x in rows]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("slice", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("copies", F.lit(9)).repartition(3)
    assert got(C.audited(table, C.damaged(table), *size)) == brute(rows, damage(rows))


def test_a_conversation_of_most_rows(spark):
    rng = random.Random(4)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "ok", f"Turn {i}."])) for i in range(3000)] + [(2, 0, "user", "ok."), (2, 1, "assistant", "Ok.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = got(C.audited(table, C.damaged(table), rows=100))
    whole = got(C.audited(table, C.damaged(table)))
    assert found == whole
    own = sorted((t, r, x) for c, t, r, x in damage(rows) if c == 1)
    kinds = faults_of(own)
    assert found[1][1:4] == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated")) and len(found[1][6].replace("I", "")) == len(own)


def test_repeated_turns_and_far_numbers(spark):
    rows = [(1, 5, "user", "Hi.")] * 500 + [(1, 6, "assistant", "Hello.")] + [(2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = C.counted(table.select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(1).alias("copies")))
    found = got(C.audited(table, plain))
    assert found[1] == (0, 0, 499, 0, 499, 998, "K" + "D" * 499 + "K", hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest())
    assert found[2][0] is None and found[2][6] == "KK"


def test_long_text_and_no_rows(spark):
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.audited(table, C.damaged(table))) == brute(rows, damage(rows))
    empty = table.where("false")
    assert C.audited(empty, C.damaged(empty)).count() == 0
    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert got(C.audited(gone, C.damaged(gone))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_give_the_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 3, "user", "V")]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("copies", F.lit(1).cast("long"))
    slices = C.sliced(table)
    found = C.edited(slices, C.traced(C.faults(slices))).orderBy("slice", "place", "number").collect()
    assert [(r["edit"], r["turn"], r["role"], r["text"]) for r in found] == [("K", 0, "system", "S."), ("R", 1, "user", "A."), ("R", 2, "assistant", "U."), ("D", 3, "user", None)]


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(C.op13_conversation_repair(spark, FOLDER)) == brute(rows, damage(rows))
