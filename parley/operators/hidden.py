"""Smoothing of label sequences by a hidden Markov model that is fitted to each recording.

A recording's K labels are the symbols and, for smoothing, the states. Expectation-maximisation starts from states that stay (STAY) and show their own label (HIT). A sequence is cut into stretches of bounded length: the product
of a stretch's transition matrices says how it carries state weights from its start to its end, so weights at every stretch's ends follow from K x K matrices alone, and expected counts inside the stretches add up by groupBy. The
result is that of one long sequence. The most likely path is found in the same way, with maxima of sums for sums of products. A recording of one stretch is fitted within a task; longer ones by rounds over all their stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.components import stored

KEY = "recording"
STRETCH, STAY, HIT = 4096, 0.9, 0.9
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def beginning(k: int) -> Model:
    """Start, transition and emission weights before the first round."""
    mostly = lambda share: np.where(np.eye(k, dtype=bool), share, (1 - share) / max(k - 1, 1))
    return np.full(k, 1 / k), mostly(STAY), mostly(HIT)


def transfer(codes: np.ndarray, model: Model, first: bool) -> np.ndarray:
    """How a stretch carries weights of the states before it (of its first row, in the first stretch) to its last row, up to a factor."""
    _, move, show = model
    out = np.diag(show[:, codes[0]]) if first else move * show[:, codes[0]]
    for code in codes[1:]:
        out = out @ (move * show[:, code])
        out /= out.sum()
    return out / out.sum()


def expected(codes: np.ndarray, model: Model, before: np.ndarray, after: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of a stretch, and the log of its rows' probability given those before. before: weights of states ahead of the stretch (the start weights at the first); after: those behind it, both up to a factor."""
    _, move, show = model
    n, k = len(codes), len(move)
    forward, scale = np.empty((n, k)), np.empty(n)
    at = before / before.sum()
    for t, code in enumerate(codes):
        at = (at if first and t == 0 else at @ move) * show[:, code]
        scale[t] = at.sum()
        at = forward[t] = at / scale[t]
    backward = np.empty((n, k))
    backward[-1] = after / (forward[-1] @ after)
    for t in range(n - 1, 0, -1):
        backward[t - 1] = move @ (show[:, codes[t]] * backward[t]) / scale[t]
    inside = forward * backward
    moves = np.zeros((k, k))
    if n > 1:
        moves += move * (forward[:-1].T @ (show[:, codes[1:]].T * backward[1:] / scale[1:, None]))
    if not first:
        moves += move * np.outer(before / before.sum(), show[:, codes[0]] * backward[0] / scale[0])
    shown = np.zeros((k, show.shape[1]))
    np.add.at(shown.T, codes, inside)
    return inside[0] if first else np.zeros(k), moves, shown, float(np.log(scale).sum())


def improved(model: Model, starts: np.ndarray, moves: np.ndarray, shown: np.ndarray) -> Model:
    """Weights from expected counts. A state that nothing counts for keeps its own."""
    return tuple(np.where((total := c.sum(axis=-1, keepdims=True)) > 0, c / np.where(total > 0, total, 1), old) for c, old in zip((starts, moves, shown), model, strict=True))


def fit(codes: np.ndarray, k: int, rounds: int, tolerance: float) -> tuple[Model, list[float]]:
    """The model of one short sequence, and the log likelihood at the start of each round."""
    model, known = beginning(k), []
    for _ in range(rounds):
        *counts, likelihood = expected(codes, model, model[0], np.ones(k), True)
        model, known = improved(model, *counts), [*known, likelihood]
        if len(known) > 1 and known[-1] - known[-2] < tolerance:
            break
    return model, known


def _logs(model: Model) -> Model:
    with np.errstate(divide="ignore"):
        return tuple(np.log(x) for x in model)


def best_scores(codes: np.ndarray, model: Model, first: bool) -> np.ndarray:
    """The best log score from each state before a stretch (at its first row, in the first stretch) to each state at its last row."""
    _, move, show = _logs(model)
    out = np.where(np.eye(len(move), dtype=bool), show[:, codes[0]], -np.inf) if first else move + show[:, codes[0]]
    for code in codes[1:]:
        out = (out[:, :, None] + move[None]).max(axis=1) + show[:, code]
    return out


def best_path(codes: np.ndarray, model: Model, before: np.ndarray, end: int | None, first: bool) -> np.ndarray:
    """The states of a stretch's rows on the best path, the lower state of equal ones. before: best log scores of the states ahead of it; end: the state at its last row, if it is known."""
    _, move, show = _logs(model)
    back = np.zeros((len(codes), len(move)), int)
    score = before
    for t, code in enumerate(codes):
        if not (first and t == 0):
            each = score[:, None] + move
            back[t], score = each.argmax(axis=0), each.max(axis=0)
        score = score + show[:, code]
    path = np.empty(len(codes), int)
    path[-1] = score.argmax() if end is None else end
    for t in range(len(codes) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def stretches(df: DataFrame, label: str, key: str = KEY, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """df's rows that have a label with place and code; and recording, stretch, last (of the recording), k, codes (of its rows in order). A label's code is its rank among the recording's labels."""
    rows = df.where(F.col(label).isNotNull())
    names = rows.groupBy(F.col(key).alias("_k"), F.col(label).alias("_l")).count()
    ranked = names.select("_k", "_l", (F.row_number().over(Window.partitionBy("_k").orderBy("_l")) - 1).alias("_code"), F.count("*").over(Window.partitionBy("_k")).cast("int").alias("_states"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1)
    coded = placed.join(ranked, F.col(key).eqNullSafe(F.col("_k")) & (F.col(label) == F.col("_l"))).drop("_k", "_l")
    pieces = coded.groupBy(key, F.floor(F.col("_place") / stretch).alias("stretch")).agg(F.max("_states").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("_place", "_code"))), lambda s: s["_code"]).alias("codes"))
    last = F.col("stretch") == F.max("stretch").over(Window.partitionBy(key))
    return coded, stored(pieces.withColumn("last", last))


def _model(row) -> Model:
    k = int(row["k"])
    return np.array(row["start"]), np.array(row["move"]).reshape(k, k), np.array(row["show"]).reshape(k, -1)


_MODEL = "k int, start array<double>, move array<double>, show array<double>, likelihoods array<double>"


def _as_row(key: str, own, model: Model, known: list[float]) -> pd.DataFrame:
    return pd.DataFrame({key: [own], "k": len(model[0]), "start": [model[0].tolist()], "move": [model[1].ravel().tolist()], "show": [model[2].ravel().tolist()], "likelihoods": [known]})


def _carried(pieces: DataFrame, models: DataFrame, key: str, kind: str, product: bool) -> DataFrame:
    """pieces with their recording's model, before and after: weights (product) or best log scores and the last state. What meets in a task is one matrix a stretch."""
    whole = pieces.join(models.withColumnRenamed(key, "_k").drop("k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")

    def matrices(batches):
        for rows in batches:
            run = transfer if product else best_scores
            yield pd.DataFrame({key: rows[key], "stretch": rows["stretch"], "start": rows["start"], "matrix": [run(np.array(r["codes"]), _model(r), r["stretch"] == 0).ravel().tolist() for _, r in rows.iterrows()]})

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("stretch")
        k = len(rows["start"].iloc[0])
        each = [np.array(m).reshape(k, k) for m in rows["matrix"]]
        if product:
            before, after = [np.array(rows["start"].iloc[0])], [np.ones(k)]
            for m in each[:-1]:
                before.append((x := before[-1] @ m) / x.sum())
            for m in each[:0:-1]:
                after.append((x := m @ after[-1]) / x.sum())
            after.reverse()
        else:
            before = [_logs((np.array(rows["start"].iloc[0]),))[0]]
            for m in each:
                before.append((before[-1][:, None] + m).max(axis=0))
            last = [int(before[-1].argmax())]
            for m, score in zip(each[:0:-1], before[-2:0:-1], strict=True):
                last.append(int((score + m[:, last[-1]]).argmax()))
            before, after = before[:-1], [np.array([float(x)]) for x in reversed(last)]
        return pd.DataFrame({key: rows[key], "stretch": rows["stretch"], "before": [x.tolist() for x in before], "after": [x.tolist() for x in after]})

    found = whole.mapInPandas(matrices, f"{key} {kind}, stretch long, start array<double>, matrix array<double>").groupBy(key).applyInPandas(ends, f"{key} {kind}, stretch long, before array<double>, after array<double>")
    return whole.join(found.withColumnsRenamed({key: "_k", "stretch": "_s"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("stretch") == F.col("_s"))).drop("_k", "_s")


def fitted(pieces: DataFrame, rounds: int = 30, tolerance: float = 1e-2, key: str = KEY) -> DataFrame:
    """recording, k, start, move, show (rows of states), likelihoods (log, at the start of each round): the model of each recording. A recording is done when a round has gained less than `tolerance`. pieces: of `stretches`."""
    kind = dict(pieces.dtypes)[key]
    short = pieces.where("stretch = 0 and last")
    long = pieces.where("not (stretch = 0 and last)")

    def alone(batches):
        for rows in batches:
            found = [_as_row(key, r[key], *fit(np.array(r["codes"]), int(r["k"]), rounds, tolerance)) for _, r in rows.iterrows()]
            yield pd.concat(found) if found else pd.DataFrame({c: [] for c in (key, "k", "start", "move", "show", "likelihoods")})

    def first(batches):
        for rows in batches:
            found = [_as_row(key, r[key], beginning(int(r["k"])), []) for _, r in rows.iterrows()]
            yield pd.concat(found) if found else pd.DataFrame({c: [] for c in (key, "k", "start", "move", "show", "likelihoods")})

    def counted(batches):
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                *counts, likelihood = expected(np.array(r["codes"]), _model(r), np.array(r["before"]), np.array(r["after"]), r["stretch"] == 0)
                out.append(np.concatenate([*(c.ravel() for c in counts), [likelihood]]).tolist())
            yield pd.DataFrame({key: rows[key], "counts": out})

    def step(batches):
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                k, all_counts = int(r["k"]), np.array(r["counts"])
                parts = all_counts[:k], all_counts[k : k + k * k].reshape(k, k), all_counts[k + k * k : -1].reshape(k, -1)
                out.append(_as_row(key, r[key], improved(_model(r), *parts), [*r["likelihoods"], float(all_counts[-1])]))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in (key, "k", "start", "move", "show", "likelihoods")})

    schema = f"{key} {kind}, {_MODEL}"
    done = [short.mapInPandas(alone, schema)]
    models = stored(long.where("last").mapInPandas(first, schema))
    for _ in range(rounds):
        if models.isEmpty():
            break
        each = _carried(long, models, key, kind, True).mapInPandas(counted, f"{key} {kind}, counts array<double>")
        summed = each.select(key, F.posexplode("counts").alias("place", "x")).groupBy(key, "place").agg(F.sum("x").alias("x"))
        whole = summed.groupBy(F.col(key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("counts"))
        after = stored(models.join(whole, F.col(key).eqNullSafe(F.col("_k"))).drop("_k").mapInPandas(step, schema))
        n = F.size("likelihoods")
        ended = (n > 1) & (F.get("likelihoods", n - 1) - F.get("likelihoods", n - 2) < tolerance)
        done.append(after.where(ended))
        models = after.where(~ended)
    done.append(models)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out)


def hmm_smooth(df: DataFrame, label: str = "speaker", rounds: int = 30, tolerance: float = 1e-2, key: str = KEY, stretch: int = STRETCH) -> DataFrame:
    """df with each label replaced by that of the state on the recording's most likely path. idx must be unique in a recording. Rows without a label keep none and are left out of the sequence; a recording of one label stays as it is."""
    coded, pieces = stretches(df, label, key, stretch)
    kind = dict(df.dtypes)
    ends = _carried(pieces, fitted(pieces, rounds, tolerance, key), key, kind[key], False)

    def decoded(batches):
        for rows in batches:
            paths = [best_path(np.array(r["codes"]), _model(r), np.array(r["before"]), int(r["after"][0]), r["stretch"] == 0).tolist() for _, r in rows.iterrows()]
            yield pd.DataFrame({key: rows[key], "stretch": rows["stretch"], "path": paths})

    paths = ends.mapInPandas(decoded, f"{key} {kind[key]}, stretch long, path array<int>")
    states = paths.select(F.col(key).alias("_k"), F.col("stretch"), F.posexplode("path").alias("_at", "_state")).select("_k", (F.col("stretch") * stretch + F.col("_at")).alias("_p"), "_state")
    names = coded.groupBy(F.col(key).alias("_k"), F.col("_code").alias("_c")).agg(F.first(label).alias("_new"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    named = coded.join(states, same & (F.col("_place") == F.col("_p"))).drop("_k").join(names, same & (F.col("_state") == F.col("_c")))
    return named.withColumn(label, F.col("_new")).select(df.columns).unionByName(df.where(F.col(label).isNull()))
