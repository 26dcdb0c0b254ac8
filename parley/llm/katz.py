"""Language-model scores with Katz backoff.

Counts are Good-Turing discounted up to TOP and kept above; what a context's seen continuations leave goes to its unseen ones in proportion
to the next lower order, with the one weight that makes the context's probabilities add up to 1 exactly:

    P(w | h) = d(c) c(hw) / c(h)   if c(hw) > 0,   else   weight(h) P(w | shorter h)

The lowest order is the discounted unigram, whose left mass is the probability of unknown words, taken as one. A
context all of whose counts lie above TOP leaves nothing; it gives 1 / (c(h) + 1) away instead.

The count tables are partitioned by unit: a unit keeps the entries, summed over the whole corpus, of the n-grams that
stand in its own texts, so a token is evaluated, recursively from the longest context down, where its text is. Round trips
(see `exchange`) fill them: one a level for the counts, one for the weights. Words and n-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import new_folder
from parley.llm.exchange import ask, bundle, get_arrays, put_arrays, store_units, told, unpacked
from parley.operators.components import materialize

ORDER, TOP = 2, 5
_UNIT = 10 << 20
_END = np.uint64(1)
_OWN = np.uint64(1 << 63)
#: What a context is told: the weight of its lower order, and what its counts are divided by.
_ANSWER = np.dtype([("weight", "<f8"), ("mass", "<u8")])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def tokenised(table: pa.Table) -> bytes:
    """What a unit keeps: documents (id, has one, teaches, tokens), distinct token hashes, ascending, and the tokens as places in them. Every document ends in the end token."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b" "]  # the end token: no word holds a blank
    ids, sizes = [], []
    for text in table.column("text").to_pylist():
        words = (text or "").encode().lower().split()
        ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        ids.append(np.zeros(1, np.int32))
        sizes.append(len(words) + 1)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    hashes[0] = _END
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    doc = table.column("doc_id")
    teaches = np.asarray(table.column("teaches").fill_null(False))
    return bundle({"doc": np.asarray(doc.fill_null(0)).astype(np.int64), "known": ~np.asarray(doc.is_null()), "teaches": teaches, "sizes": np.array(sizes, np.int64), "words": hashes[order], "tokens": place[np.concatenate(ids)]})


def discounts(n: list[float]) -> np.ndarray:
    """d[r] for r = 0..TOP from n[r], the number of distinct n-grams seen r times, r = 1..TOP + 1 (n[0] is not used). Where the
    counts give no factor above 0 and up to 1, it is (r - 0.5) / r."""
    d = np.ones(TOP + 1)
    a = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        d[r] = value if 0 < value <= 1 else (r - 0.5) / r
    return d


def factor(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= TOP, d[np.minimum(c, TOP).astype(np.int64)], 1.0)


class Level:
    """The n-grams of one order in a unit: `keys` ascending and distinct, `of` each token, a token `at` which each
    stands, the hashes of their contexts' distinct values `contexts` and `context_of` each n-gram."""

    def __init__(self, unit: dict[str, np.ndarray], n: int):
        words = unit["words"][unit["tokens"]]
        ends = np.cumsum(unit["sizes"])
        since = np.arange(len(words)) - np.repeat(ends - unit["sizes"], unit["sizes"])
        context = np.zeros(len(words), np.uint64)
        for back in range(n - 1, 0, -1):  # before its text a token sees the end token
            earlier = np.full(len(words), _END)
            earlier[back:] = np.where(since[back:] >= back, words[:-back] if back else words, _END)
            context = _stir(context * _M[0] + earlier)
        if n == 1:
            self.keys, self.at, self.of = unit["words"], None, unit["tokens"]
        else:
            self.keys, self.at, self.of = np.unique(_stir(context * _M[1] + words), return_index=True, return_inverse=True)
            self.contexts, self.context_of = np.unique(context[self.at], return_inverse=True)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[0]
    return (x ^ (x >> np.uint64(29))) * _M[1] ^ (x >> np.uint64(33))


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each key in it, sums of values by key)."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return order, first, np.add.reduceat(values[order], first, axis=0)


def score(docs: DataFrame, teaches: Column, order: int = ORDER) -> DataFrame:
    """doc_id, teaches, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id integer, text).

    teaches: a condition on doc_id for rows to learn from; null means no. Tokens: words between ASCII white space with
    A-Z lower-cased, and one end. Null text counts as empty: its end token only. base_score: the unigram baseline with a half added to each
    count. score: log10 probability of the row's tokens by Katz backoff of the given order. Repeated rows count and
    come out as often as they stand; other columns are ignored; an empty table gives none; without training rows every token is unknown.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "katz")
    units = store_units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", teaches.alias("teaches")), folder, tokenised, _UNIT)
    opened = lambda unit: get_arrays(folder, f"unit-{unit}")

    def counts(n: int):
        def question(unit: int) -> tuple[np.ndarray, list]:
            own = opened(unit)
            level = Level(own, n)
            taught = np.bincount(level.of[np.repeat(own["teaches"], own["sizes"])], minlength=len(level.keys))
            return level.keys, [taught.astype("<u4")]

        return question

    def summed(keys: np.ndarray, _: np.ndarray, values: list[list[bytes]]) -> np.ndarray:
        """A key's count; the first unit that taught it gets the mark of owning it."""
        count = np.concatenate([unpacked(v[0], "<u4") for v in values]).astype(np.uint64)
        by_key, first, sums = _added(keys, count)
        out = np.empty(len(keys), np.uint64)
        size = np.diff(np.append(first, len(keys)))
        out[by_key] = np.repeat(sums, size)
        taught = by_key[count[by_key] > 0]
        _, leader = np.unique(keys[taught], return_index=True)
        out[taught[leader]] |= _OWN
        return out

    def probabilities(own: dict[str, np.ndarray], unit: int, n: int, known: dict[int, np.ndarray], total: int, weights: np.ndarray | None = None) -> np.ndarray:
        """P(token | its n - 1 predecessors) of each token, recursively."""
        count = get_arrays(folder, f"counts-{n}-{unit}")["count"]
        level = Level(own, n)
        if n == 1:
            scale, left = known[0]
            table = scale * factor(known[1], count) * count / max(total, 1)
            return np.where(count > 0, table, left)[level.of]
        own_weights = np.ascontiguousarray(get_arrays(folder, f"weights-{n}-{unit}")["answers"] if weights is None else weights).view(_ANSWER).reshape(-1)
        seen = (factor(known[n], count) * count / own_weights["mass"][level.context_of])[level.of]
        lower = probabilities(own, unit, n - 1, known, total)
        return np.where(count[level.of] > 0, seen, own_weights["weight"][level.context_of][level.of] * lower)

    total = vocabulary = 0
    known: dict[int, np.ndarray] = {}
    for n in range(1, order + 1):

        def noted(unit: int, answers: np.ndarray, n: int = n) -> Iterator[pa.RecordBatch]:
            own, count = opened(unit), (answers & ~_OWN).astype(np.int64)
            mine = answers & _OWN > 0
            put_arrays(folder, f"counts-{n}-{unit}", count=count, mine=np.packbits(mine))
            r = np.bincount(np.minimum(count[mine], TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()
            taught = int(own["sizes"][own["teaches"]].sum())
            yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64()), "taught": pa.array([taught], pa.int64()), "types": pa.array([int(mine.sum())], pa.int64()), "r": pa.array([r], pa.list_(pa.int64()))})

        units = materialize(told(units, ask(units, counts(n), summed), noted, "unit long, taught long, types long, r array<long>", "<u8"))
        found = units.agg(F.sum("taught").alias("taught"), F.sum("types").alias("types"), *(F.sum(F.col("r")[k]).alias(f"r{k + 1}") for k in range(TOP + 1))).first()
        seen = [0.0, *(float(found[f"r{k}"] or 0) for k in range(1, TOP + 2))]
        known[n] = discounts(seen)
        if n == 1:
            total, vocabulary = found["taught"] or 0, found["types"] or 0
            low = sum(seen[k] * k * (1 - known[1][k]) for k in range(1, TOP + 1))
            # what unigrams are scaled by, and the unknown's share: where none was seen up to TOP times, that of one more event
            known[0] = np.array([1.0, low / total] if low else [total / (total + 1), 1 / (total + 1)])
            continue
        d = known[n]

        def partial(unit: int, n: int = n, known: dict = dict(known), total: int = total) -> tuple[np.ndarray, list]:
            """Of each context: its count and the numbers of its n-grams seen 1..TOP times, and what these have in the lower order; an n-gram counts in the unit that owns it."""
            own, table = opened(unit), get_arrays(folder, f"counts-{n}-{unit}")
            level, count = Level(own, n), table["count"]
            mine = np.unpackbits(table["mine"], count=len(count)).astype(bool)
            of, c, size = level.context_of[mine], count[mine], len(level.contexts)
            lower = np.bincount(of, probabilities(own, unit, n - 1, known, total)[level.at][mine], size)
            numbers = [np.bincount(of, c, size), *(np.bincount(of[c == k], minlength=size) for k in range(1, TOP + 1))]
            return level.contexts, [np.stack(numbers, axis=1).astype("<u8"), lower]

        def weighed(keys: np.ndarray, _: np.ndarray, values: list[list[bytes]], d: np.ndarray = d) -> np.ndarray:
            """Rows of `_ANSWER`."""
            by_key, first, sums = _added(keys, np.concatenate([unpacked(v[0], "<u8", TOP + 1) for v in values]).astype(np.int64))
            lower = np.add.reduceat(np.concatenate([unpacked(v[1], "<f8") for v in values])[by_key], first)
            count, r = sums[:, 0], sums[:, 1:]
            left = (r * np.arange(1, TOP + 1) * (1 - d[1:])).sum(axis=1)
            none = left == 0
            left = np.where(count == 0, 1.0, np.where(none, 1.0, left) / np.maximum(count + none, 1))
            row = np.empty(len(first), _ANSWER)
            row["weight"] = left / np.where(count == 0, 1.0, np.maximum(1 - lower, 1e-12))
            row["mass"] = np.maximum(count + none, 1)
            out = np.empty(len(keys), _ANSWER)
            out[by_key] = np.repeat(row, np.diff(np.append(first, len(keys))))
            return out.view("<u8").reshape(len(keys), 2)

        if n < order:

            def weights_noted(unit: int, answers: np.ndarray, n: int = n) -> Iterator[pa.RecordBatch]:
                put_arrays(folder, f"weights-{n}-{unit}", answers=answers)
                yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64())})

            units = materialize(told(units, ask(units, partial, weighed), weights_noted, "unit long", "<u8", 2))

    def scored(unit: int, answers: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = opened(unit)
        p = probabilities(own, unit, order, known, total, answers if order > 1 else None)
        count = get_arrays(folder, f"counts-1-{unit}")["count"][own["tokens"]]
        begin = np.cumsum(own["sizes"]) - own["sizes"]
        base = np.log10((count + 0.5) / (total + 0.5 * (vocabulary + 1)))
        columns = [
            pa.array(own["doc"], pa.int64(), mask=~own["known"]),
            pa.array(own["teaches"]),
            pa.array(own["sizes"], pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), begin), pa.int64()),
            pa.array(np.full(len(begin), total), pa.int64()),
            pa.array(np.add.reduceat(base, begin), pa.float64()),
            pa.array(np.add.reduceat(np.log10(p), begin), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "teaches", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = ask(units, partial, weighed) if order > 1 else ask(units, counts(1), summed)
    return told(units, answers, scored, "doc_id long, teaches boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "<u8", 2 if order > 1 else 1)


def op6_katz(spark, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 1)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
