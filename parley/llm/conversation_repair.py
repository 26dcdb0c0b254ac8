"""Repair of conversation structure: the cheapest edits that turn a conversation's turns into an optional system turn and pairs of user and assistant.

What a well-formed conversation is, is an automaton of four states: nothing said yet, a system turn said, a user turn said, an assistant turn said. Edits make it a weighted, ambiguous one. It is
determinised lazily: a determinised state is a vector of the four costs to the end, less their minimum, and (state, turn) -> (state, minimum) is computed once and cached in a table. A conversation
is read from its last turn to its first by table lookups, which gives the least cost; then the turns are traced in order along tight arcs, those whose cost equals the difference of the two
vectors they join, and among tight arcs the letter that sorts least is taken, so that the least of all cheapest audits comes out.

Conversations may be longer than a task can hold. All turns are sorted by range partitions and cut into slices of one conversation, of bounded rows and bytes. A slice is summed up as a matrix
of costs from each state at its start to each state at its end; a pass from the last slice to the first, over matrices only, gives each slice the vector that holds behind it. Slices are then traced from
each of the four states, and a pass from the first to the last picks the trace that continues the one before. Only the digest of a whole conversation needs its text in order; it is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import partitions
from parley.operators.components import materialize

#: Rows and bytes of text of a slice at most; a row longer than that is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 22
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn of this initial leads to, from the states that allow it; an inserted or reroled turn leads to USER, from USER to ASSISTANT.
ARCS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")
Vector = tuple[float, ...]


def closed(costs: Iterable[float]) -> Vector:
    """Costs from each state when turns may be inserted first."""
    best = list(costs)
    for _ in range(3):  # START and SYSTEM lead to USER, USER and ASSISTANT to each other
        best = [min(c, INSERT + best[NEXT[q]]) for q, c in enumerate(best)]
    return tuple(best)


#: Costs to the end behind the last turn: a conversation may end empty or after an assistant's turn.
END = closed((0, inf, inf, 0))


class Automaton:
    """The determinised automaton, as far as it has been met. A turn is None if it must be deleted, else (initial, truncated)."""

    def __init__(self) -> None:
        self.ids: dict[Vector, int] = {}
        self.vectors: list[Vector] = []
        self.table: dict[tuple[int, object], tuple[int, float]] = {}

    def state(self, costs: Vector) -> tuple[int, float]:
        """The state that stands for these costs, and what they have above it."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def before(self, state: int, turn: tuple[str, bool] | None) -> tuple[int, float]:
        """The state before a turn, given the one behind it."""
        found = self.table.get((state, turn))
        if found is None:
            behind = self.vectors[state]
            found = self.table[state, turn] = self.state(closed(min(cost + behind[to] for _, cost, to in arcs(q, turn)) for q in range(4)))
        return found

    def scan(self, turns: list[tuple[str, bool] | None], behind: Vector) -> tuple[list[int], list[float], Vector]:
        """States before each turn and behind the last, minima of each turn, and the costs before the first turn."""
        state, cost = self.state(behind)
        states, minima = [state], []
        for turn in reversed(turns):
            state, least = self.before(state, turn)
            states.append(state)
            minima.append(least)
            cost += least
        return states[::-1], minima[::-1], tuple(cost + c for c in self.vectors[state])

    def trace(self, turns: list[tuple[str, bool] | None], states: list[int], minima: list[float], at: int, last: bool) -> tuple[list[str], int]:
        """The edits before and at each turn, letters with the state each leads to, least letters first, from state `at`, and the state they end in. last: with those behind the last turn, as one more item."""
        edits = []
        for i, turn in enumerate(turns):
            here, behind, least, letters = self.vectors[states[i]], self.vectors[states[i + 1]], minima[i], ""
            while True:
                tight = [(letter, to) for letter, cost, to in arcs(at, turn) if here[at] + least == cost + behind[to]]
                if here[at] == INSERT + here[NEXT[at]] and (not tight or min(tight)[0] > "I"):
                    at = NEXT[at]
                    letters += f"I{at}"
                    continue
                letter, at = min(tight)
                edits.append(f"{letters}{letter}{at}")
                break
        if last:
            letters = ""
            while END[at] > 0:
                at = NEXT[at]
                letters += f"I{at}"
            edits.append(letters)
        return edits, at


def arcs(q: int, turn: tuple[str, bool] | None) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind) of what can be done with a turn in state q."""
    out = [("D", DELETE, q)]
    if turn:
        initial, truncated = turn
        rest = UNFINISHED if truncated else 0
        out.append(("R", REROLE + rest, NEXT[q]))
        if q in ARCS.get(initial, {}):
            out.append(("K", rest, ARCS[initial][q]))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies (equal rows): every twentieth row dropped, emptied, stripped of its stops, repeated and given to the user, by crc32 of `conv_id:turn`. Nulls in role, text and that key are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    kept = rows.where("fate <> 0").select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))
    return counted(kept)


def counted(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: rows equal in all four as one, added up before the shuffle."""
    return turns.groupBy("conv", "turn", "role", "text").agg(F.sum(F.col("copies").cast("long")).alias("copies"))


def sliced(turns: DataFrame, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """Turns in slices: numbers (slice, place) ascend by conv, turn (nulls first), role, text. Adds blank, truncated, initial, digest (of role and text) and fresh: the first of its digest in its slice. Equal rows must be counted."""
    kinds = dict(turns.dtypes)
    order = ["conv", "turn", "role"]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, held, conv, seen = TaskContext.get().partitionId() << 40, 0, 0, None, None
        for batch in batches:
            found = []
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if seen is None or own != conv or place == rows or place and held + len(text) > size:
                    number, place, held, conv, seen = number + (seen is not None), 0, 0, own, set()
                stripped = text.rstrip(SPACES)
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                found.append((number, place, not stripped, not stripped.endswith(tuple(STOPS)), role[:1], digest, digest not in seen))
                seen.add(digest)
                place, held = place + 1, held + len(text)
            columns = zip(*found, strict=True) if found else [[]] * 7
            kind = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kind, strict=True))], names=[*batch.schema.names, "slice", "place", "blank", "truncated", "initial", "digest", "fresh"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in turns.columns)
    return materialize(dealt.mapInArrow(cut, f"{schema}, slice long, place int, blank boolean, truncated boolean, initial string, digest binary, fresh boolean"))


def _turns(row: dict) -> list[tuple[str, bool] | None]:
    return [(initial, truncated) if good else None for initial, truncated, good in zip(row["initials"], row["unfinished"], row["good"], strict=True)]


def _added(df: DataFrame, run: Callable, names: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df with columns added. run(carry, row as a dict) gives the next carry and the new values; the carry is None at the first row that a task holds of a conversation, so where carries matter a conversation must be in one task, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, carry = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                carry, values = run(carry if here == (row["conv"],) else None, row)
                here = (row["conv"],)
                out.append(values)
            new = [pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(names.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(rows, ", ".join([*(f"{c} {kind}" for c, kind in df.dtypes), *(f"{c} {kind}" for c, (kind, _) in names.items())]))


def faults(slices: DataFrame) -> DataFrame:
    """conv, slice; good, initials, unfinished and copies, a list item a turn; blank, duplicate, truncated: numbers of turns by their first fault. A turn is a duplicate if any turn of the conversation before it has its role and text:
    the first of each slice are compared, and the result comes back by (slice, place), so that no repeated turn meets in one task."""
    first = slices.where("fresh and not blank").groupBy("conv", "digest").agg(F.min(F.struct("slice", "place")).alias("at"))
    marks = first.select(F.col("at.slice").alias("slice"), F.col("at.place").alias("place"), F.lit(True).alias("first"))
    turns = slices.select("conv", "slice", "place", "initial", "copies", "blank", "truncated").join(marks, ["slice", "place"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    gone = F.col("copies") - F.col("first").cast("long")
    whole = F.array_sort(F.collect_list(F.struct("place", "first", "initial", "truncated", "copies")))
    sums = turns.groupBy("slice").agg(
        F.first("conv").alias("conv"), whole.alias("turns"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), gone).otherwise(0)).alias("duplicate"), F.sum((F.col("first") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    lists = {"good": "first", "initials": "initial", "unfinished": "truncated", "copies": "copies"}
    return materialize(sums.select("conv", "slice", *(F.col(f"turns.{c}").alias(name) for name, c in lists.items()), "blank", "duplicate", "truncated"))


def _matrix(automaton: Automaton, row: dict) -> list[float]:
    """Least costs from each state before a slice's turns (in rows) to each behind them."""
    turns, repeats = _turns(row), DELETE * sum(c - 1 for c in row["copies"])
    columns = [automaton.scan(turns, tuple(0 if p == q else inf for p in range(4)))[2] for q in range(4)]
    return [float(columns[q][p] + repeats) for p in range(4) for q in range(4)]


def _behind(costs: np.ndarray | None, row: dict) -> tuple[np.ndarray, tuple]:
    """From a conversation's last slice to its first: the costs to the conversation's end from behind the slice, whether it is the last, and what the whole costs if it is the first."""
    after = np.array(END, float) if costs is None else costs
    before = (np.array(row["m"]).reshape(4, 4) + after).min(axis=1)
    return before, (after.tolist(), costs is None, int(before[START]))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _all_traces(automaton: Automaton, row: dict) -> tuple:
    """Edits and last state from each of the four states, and illegal neighbours in the slice. Equal turns that follow each other are never legal."""
    turns = _turns(row)
    states, minima, _ = automaton.scan(turns, tuple(row["after"]))
    traces = [automaton.trace(turns, states, minima, q, row["last"]) for q in range(4)]
    return [t[0] for t in traces], [t[1] for t in traces], _illegal(row["initials"]) + sum(c - 1 for c in row["copies"])


def _entered(carry: tuple | None, row: dict) -> tuple[tuple, tuple]:
    """From the first slice to the last: the state that a slice begins in, the illegal neighbour across its start, and the cost at the conversation's first slice alone."""
    entry, initial = carry or (START, None)
    crossing = 0 if carry is None else _illegal([initial, row["initials"][0]])
    return (row["exits"][entry], row["initials"][-1]), (entry, crossing, row["cost_here"] if carry is None else 0)


def traced(slices: DataFrame) -> DataFrame:
    """conv, slice, edits and illegal, cost: the cheapest edits, a string a turn, of letters each with the state it leads to (`I2I3K2`): those before the turn and the one at it; a conversation's last slice has one item more. The
    cost is the whole conversation's, and stands at its first slice. slices: of `faults`."""
    automaton = Automaton()  # each task gets a copy, and fills it
    state, number = ("int", pa.int32()), ("long", pa.int64())
    matrices = _added(slices, lambda _, row: (None, (_matrix(automaton, row),)), {"m": ("array<double>", pa.list_(pa.float64()))}).select("conv", "slice", "m")
    ends = matrices.repartition("conv").sortWithinPartitions("conv", F.desc("slice"))
    behind = _added(ends, _behind, {"after": ("array<double>", pa.list_(pa.float64())), "last": ("boolean", pa.bool_()), "cost_here": number}).select("slice", "after", "last", "cost_here")
    strings = ("array<array<string>>", pa.list_(pa.list_(pa.string())))
    four = materialize(_added(slices.join(behind, "slice"), lambda _, row: (None, _all_traces(automaton, row)), {"edits": strings, "exits": ("array<int>", pa.list_(pa.int32())), "inner": number}))
    starts = four.select("conv", "slice", "exits", "cost_here", F.array(F.col("initials")[0], F.element_at("initials", -1)).alias("initials")).repartition("conv").sortWithinPartitions("conv", "slice")
    entries = _added(starts, _entered, {"entry": state, "crossing": number, "cost": number}).select("slice", "entry", "crossing", "cost")
    chosen = four.join(entries, "slice").select("conv", "slice", F.get("edits", "entry").alias("edits"), (F.col("inner") + F.col("crossing")).alias("illegal"), "cost", "blank", "duplicate", "truncated")
    return materialize(chosen)


def edited(slices: DataFrame, traces: DataFrame) -> DataFrame:
    """Every edit of every conversation, a row each: conv, slice, place, number (their order), edit (D, I, K, R), turn, role and text after it, copies. The text of a deleted turn is null; a row of several copies stands for
    as many turns, of which all but the first are deleted. slices: of `sliced`."""
    codes = F.regexp_extract_all("codes", F.lit("[A-Z][0-9]"), F.lit(0))
    each = traces.select("conv", "slice", F.posexplode("edits").alias("place", "codes")).select("conv", "slice", "place", F.posexplode(codes).alias("number", "code"))
    edit, state = F.substring("code", 1, 1), F.substring("code", 2, 1).cast("int")
    turns = slices.select("slice", "place", "turn", "role", "text", "copies")
    made = F.when(state == USER, "user").otherwise("assistant")
    own = lambda c: F.when(edit != "I", F.col(c))
    role = F.when(edit.isin("I", "R"), made).otherwise(F.col("role"))
    text = F.when(edit == "I", "").when(edit != "D", F.col("text"))
    return each.join(turns, ["slice", "place"], "left").select("conv", "slice", "place", "number", edit.alias("edit"), own("turn").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(own("copies"), F.lit(1)).alias("copies"))


def digests(edits: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256: the letters of each conversation's edits, and the SHA-256 of its repaired turns as `role:text`, joined by newlines. That hash can only be taken in order, so a conversation streams through one task, which holds a batch of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, audit, sha, empty, kind = None, [], None, True, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv").type
            for conv, edit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text", "copies")), strict=True):
                if here != (conv,):
                    if here:
                        done.append((here[0], "".join(audit), sha.hexdigest()))
                    here, audit, sha, empty = (conv,), [], hashlib.sha256(), True
                audit.append(edit + "D" * (copies - 1))
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if done:
                yield _finished(done, kind)
        if here:
            yield _finished([(here[0], "".join(audit), sha.hexdigest())], kind)

    def _finished(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        conv, audit, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(audit), pa.array(sha)], names=["conv", "audit", "repaired_sha256"])

    ordered = edits.repartition("conv").sortWithinPartitions("conv", "slice", "place", "number")
    return ordered.select("conv", "edit", "role", "text", "copies").mapInArrow(run, f"conv {dict(edits.dtypes)['conv']}, audit string, repaired_sha256 string")


def audited(conversations: DataFrame, turns: DataFrame, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """One row for every conv_id of `conversations`, null included: faults of its `turns` (conv, turn, role, text, copies), the cost and letters of the cheapest repair, and the digest of what it gives.

    gaps: turn numbers missing between the least and the largest; null where those are too far apart for a long. A conversation without turns has zeros, an empty audit and the hash of the empty string.
    Turns of equal number go by role and text. Roles whose first character isn't s, u or a in lower case, and empty ones, can't be kept. Equal rows are one turn and its repetitions. rows, size: of a slice; the result doesn't depend on them.
    """
    turns = materialize(turns)
    slices = sliced(turns, rows, size)
    traces = traced(faults(slices))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    span = (whole("high") - whole("low") + 1 - whole("different")).cast("decimal(38,0)")
    gaps = turns.groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("different")).select(F.col("conv").alias("conv_id"), F.when(F.col("low").isNull(), 0).otherwise(span.try_cast("long")).alias("gaps"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    sums = traces.groupBy(F.col("conv").alias("conv_id")).agg(*(F.sum(c).alias(c) for c in counts))
    out = conversations.select("conv_id").distinct()
    for part in (gaps, sums, digests(edited(slices, traces)).withColumnRenamed("conv", "conv_id")):
        out = out.join(part.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    known = lambda c: F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", known("gaps"), *(known(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audited(conversations, damaged(conversations))
