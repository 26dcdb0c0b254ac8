"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and document scores.

Labels mark documents, so token labels come first: in toxic documents a token is marked if one of its traits (the word, or a beginning
of it) stands in many more different surroundings there than in clean documents, by a ratio of rates and a likelihood-ratio
statistic, which weighs evidence alike in samples of every size. (Surroundings, not occurrences: copies of one document repeat a word in the
same place.) The field is fitted to those labelled tokens: a weight for each frequent trait, a bias and the transitions. Forward-backward
marginals of every token of a whole text then give the spans, and a logistic regression on the largest marginal, on
the expected number of toxic tokens and on their share gives the document's score. Only the sample, of a documented bound in rows and bytes, goes to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Memo, slices

#: Labelled rows that the model learns from, at most, and bytes of their texts together (one row at least).
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1200, 2400, 64 << 20
#: Of toxic traits: least surroundings, least ratio of rates, least statistic (chance alone gives one trait in a million that much).
LEAST, RATIO, EVIDENCE = 3, 10.0, 25.0
#: The field's traits stand this often; its windows reach so far to both sides of their centre; those without a toxic token are WINDOWS at most, evenly spaced over the sample.
FREQUENT, REACH, WINDOWS, ROUNDS = 3, 10, 20000, 80
PREFIXES = (4, 5, 6, 7, 8)
_CELLS, _PIECE = 1 << 20, 4 << 20


def core(token: str) -> str:
    """The letters of a token, in lower case."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


@dataclass
class Model:
    """weights: of known traits; others weigh nothing. Scores of label 1 against 0, then transitions as
    exponentials trans[from][to]. prior: score of everything if there is nothing to tell classes apart."""

    weights: dict[str, float]
    bias: float
    start: float
    trans: np.ndarray
    logistic: np.ndarray
    prior: float | None = None

    def weight(self, token: bytes) -> float:
        return float(np.exp(self.bias + sum(self.weights.get(t, 0.0) for t in traits(core(token.decode())))))


def marginals(odds: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """P(label 1) of each token, from its own odds, for each sequence. Sequences of like length advance together: one
    step of the recursions on ratios of the two states serves all of them."""
    out: list[np.ndarray] = [np.zeros(0)] * len(odds)
    length = np.array([len(o) for o in odds])
    order = [int(i) for i in np.argsort(length, kind="stable") if length[i]]
    at = 0
    (t00, t01), (t10, t11) = model.trans.tolist()
    while at < len(order):
        least, stop = length[order[at]], at + 1
        while stop < len(order) and length[order[stop]] <= max(64, 1.3 * least) and (stop + 1 - at) * length[order[stop]] <= _CELLS:
            stop += 1
        rows = order[at:stop]
        at, steps = stop, int(length[rows[-1]])
        ahead, back = np.ones((steps, len(rows))), np.ones((steps, len(rows)))
        for c, i in enumerate(rows):
            ahead[: length[i], c] = odds[i]
            back[: length[i], c] = odds[i][::-1]
        f, g = np.empty_like(ahead), np.empty_like(back)
        f[0], g[0] = ahead[0] * np.exp(model.start), 1.0
        for t in range(1, steps):
            f[t] = ahead[t] * (t01 + f[t - 1] * t11) / (t00 + f[t - 1] * t10)
            e = back[t - 1] * g[t - 1]
            g[t] = (t10 + e * t11) / (t00 + e * t01)
        for c, i in enumerate(rows):
            both = f[: length[i], c] * g[: length[i], c][::-1]
            out[i] = both / (1 + both)
    return out


def features(p: np.ndarray) -> tuple[float, float, float, float]:
    top = float(np.clip(p.max(), 1e-6, 1 - 1e-6)) if len(p) else 1e-6
    toxic = float(p[p > 0.05].sum()) if len(p) else 0.0
    return 1.0, float(np.log(top / (1 - top))), float(np.log1p(toxic)), float(np.log((toxic + 0.05) / (len(p) + 20)))


def traits(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def toxic_traits(docs: list[np.ndarray], toxic: list[int], words: list[str]) -> set[str]:
    """Traits whose tokens in toxic documents count as toxic. docs: places in `words`."""
    found: list[Counter[str]] = []
    total = []
    for bad in (0, 1):
        places = []
        for d in (d for d, t in zip(docs, toxic, strict=True) if t == bad and len(d)):
            around = np.concatenate([[-1], d, [-1]]).astype(np.uint64)
            places.append(np.stack([d.astype(np.uint64), around[1:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (around[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (around[2:] * np.uint64(0x165667B19E3779F9) >> np.uint64(1))]))
        word, place = np.concatenate(places, axis=1) if places else np.zeros((2, 0), np.uint64)
        _, first = np.unique(place, return_index=True)
        count: Counter[str] = Counter()
        for w, n in zip(*np.unique(word[first], return_counts=True), strict=True):
            if words[int(w)]:
                for t in traits(words[int(w)]):
                    count[t] += int(n)
        found.append(count)
        total.append(max(1, len(first)))
    clean, dirty = found
    out = set()
    for t, k in dirty.items():
        if k < LEAST or k / total[1] < RATIO * (clean[t] + 0.5) / total[0]:
            continue
        share = (k + clean[t]) / (total[0] + total[1])
        statistic = 2 * (k * np.log(k / (share * total[1])) + (clean[t] * np.log(clean[t] / (share * total[0])) if clean[t] else 0.0))
        if statistic >= EVIDENCE:
            out.add(t)
    return out


def _fit_field(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Maximum conditional likelihood, with a Gaussian prior, of sequences of trait numbers x (0: none) and labels y of one length."""
    n, steps, k = x.shape
    theta, rest = np.zeros(size), np.array([-3.0, 0.0, 0.0, 0.0, 0.0, 0.0])  # rest: bias, start, transitions row by row
    moment = [np.zeros(size), np.zeros(size), np.zeros(6), np.zeros(6)]
    pairs = np.bincount((2 * y[:, :-1] + y[:, 1:]).ravel(), minlength=4)
    seen = np.bincount(x.ravel(), weights=np.repeat(y.ravel(), k), minlength=size)
    for step in range(1, ROUNDS + 1):
        e = np.exp(np.clip(rest[0] + theta[x].sum(2), -30, 30))
        t = np.exp(rest[2:]).reshape(2, 2)
        emit = np.stack([np.ones_like(e), e], axis=2)
        alpha, beta = np.empty((n, steps, 2)), np.ones((n, steps, 2))
        alpha[:, 0] = emit[:, 0] * np.array([1.0, np.exp(rest[1])])
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for i in range(1, steps):
            alpha[:, i] = emit[:, i] * (alpha[:, i - 1] @ t)
            alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
        for i in range(steps - 2, -1, -1):
            beta[:, i] = (emit[:, i + 1] * beta[:, i + 1]) @ t.T
            beta[:, i] /= beta[:, i].sum(1, keepdims=True)
        p = alpha * beta
        p = p[:, :, 1] / p.sum(2)
        joint = alpha[:, :-1, :, None] * t * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        grad = seen - np.bincount(x.ravel(), weights=np.repeat(p.ravel(), k), minlength=size) - 0.05 * theta
        grad[0] = 0.0
        more = np.concatenate([[(y - p).sum(), (y[:, 0] - p[:, 0]).sum()], pairs - joint.sum((0, 1)).ravel()]) - 0.05 * rest
        for m, (g, w) in enumerate(((grad, theta), (more, rest))):
            moment[2 * m] = 0.9 * moment[2 * m] + 0.1 * g
            moment[2 * m + 1] = 0.999 * moment[2 * m + 1] + 0.001 * g * g
            w += 0.2 * (moment[2 * m] / (1 - 0.9**step)) / (np.sqrt(moment[2 * m + 1] / (1 - 0.999**step)) + 1e-8)
    return theta, float(rest[0]), float(rest[1]), np.exp(rest[2:]).reshape(2, 2)


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * w)
    return w


def fit(texts: list[str | None], toxic: list[int], share: float) -> Model:
    """A model of labelled documents. share: of toxic ones among all labelled rows, which the sample need not have."""
    if len(set(toxic)) < 2:
        return Model({}, 0.0, 0.0, np.ones((2, 2)), np.zeros(4), share)
    cores, places = Memo(core), {}
    docs = [np.array([places.setdefault(cores[t.decode()], len(places)) for t in tokens_of(x)], np.int64) for x in texts]
    words = list(places)
    marked = toxic_traits(docs, toxic, words)
    if not marked:
        return Model({}, 0.0, 0.0, np.ones((2, 2)), np.zeros(4), share)
    often = np.bincount(np.concatenate(docs), minlength=len(words))
    counts: Counter[str] = Counter()
    for word, c in zip(words, often.tolist(), strict=True):
        counts.update(dict.fromkeys(traits(word), c))
    number = {t: i for i, t in enumerate(sorted(t for t, c in counts.items() if c >= FREQUENT), 1)}
    width = 2 * REACH + 1
    ids_of = np.zeros((len(words) + 1, len(PREFIXES) + 1), np.int32)  # the last row: what fills windows up beyond a text's end
    for i, word in enumerate(words):
        own = [number.get(t, 0) for t in traits(word)]
        ids_of[i, : len(own)] = own
    is_marked = np.array([any(t in marked for t in traits(word)) for word in words])
    stride = max(width, sum(map(len, docs)) // WINDOWS)
    x, y = [], []
    for d, bad in zip(docs, toxic, strict=True):
        labels = is_marked[d] & bool(bad)
        long = np.concatenate([d, np.full(max(0, width - len(d)), len(words))])
        wide = np.concatenate([labels, np.zeros(len(long) - len(d), bool)]).astype(np.int64)
        for c in np.flatnonzero(labels).tolist() + list(range(min(REACH, max(0, len(d) - 1)), len(d), stride)):
            lo = max(0, min(c - REACH, len(long) - width))
            x.append(ids_of[long[lo : lo + width]])
            y.append(wide[lo : lo + width])
    theta, bias, start, trans = _fit_field(np.array(x), np.array(y), len(number) + 1)
    del x, y
    model = Model({t: float(theta[i]) for t, i in number.items() if abs(theta[i]) > 1e-3}, bias, start, trans, np.zeros(4))
    weight = Memo(model.weight)
    found = np.array([features(p) for p in marginals([np.array([weight[t] for t in tokens_of(t_)]) for t_ in texts], model)])
    truth = np.array(toxic, float)
    own = truth.mean()
    model.logistic = _fit_logistic(found, truth, np.where(truth == 1, share / own, (1 - share) / (1 - own)))
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most toxic_rows and clean_rows labelled documents, the first in the order of a hash of doc_id, as far as sample_bytes of text go. Rows
    with a null doc_id or label don't count; a doc_id labelled twice takes the larger label; of a doc_id that `docs` repeats, rows count as long as the bounds allow.
    usable: a condition on doc_id for rows to learn from."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = (known if usable is None else known.where(usable)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = counts.get(0, 0) + counts.get(1, 0)
    if not total:
        return fit([], [], 0.0)
    picked = known.where("toxic = 1").orderBy("h", "doc_id").limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(clean_rows))
    joined = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "toxic", "h")), "doc_id").select("h", "doc_id", "text", "toxic")
    most = toxic_rows + clean_rows
    lengths = joined.select("h", "doc_id", F.octet_length("text").alias("n")).orderBy("h", "doc_id", "n").limit(most).collect()
    if not lengths:
        return fit([], [], 0.0)
    within = np.searchsorted(np.cumsum([r["n"] or 0 for r in lengths]), sample_bytes, "right")
    sample = joined.where(F.col("h") <= lengths[max(0, int(within) - 1)]["h"]).orderBy("h", "doc_id", F.octet_length("text"), "text").limit(max(1, int(within))).collect()
    return fit([r["text"] for r in sample], [int(r["toxic"]) for r in sample], counts.get(1, 0) / total)


def score(docs: DataFrame, model: Model, span_at: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start and end, in code points, of runs of tokens whose marginal is span_at or
    more) for each row. Null text counts as empty and, like every text without evidence, has the score of no toxic token; repeated rows give repeated rows; an empty table gives none. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        weight = Memo(own.weight)
        for big in batches:
            for batch in slices(big, _PIECE):
                texts = pc.fill_null(batch.column("text"), "")
                split = pc.ascii_split_whitespace(texts)
                coded = split.flatten().dictionary_encode()
                distinct = np.array([weight[t.encode()] if t else np.nan for t in coded.dictionary.to_pylist()])
                every = distinct[coded.indices.to_numpy()] if len(coded) else np.zeros(0)
                odds = [o[~np.isnan(o)] for o in np.split(every, np.cumsum(np.asarray(pc.list_value_length(split)))[:-1])]  # white space at an end leaves an empty word
                chances = marginals(odds, own)
                found = np.array([features(p) for p in chances])
                scores = np.full(len(odds), own.prior) if own.prior is not None else 1 / (1 + np.exp(-np.clip(found @ own.logistic, -30, 30)))
                spans = [_spans(texts[i].as_py(), p >= span_at) if own.prior is None and len(p) and p.max() >= span_at else [] for i, p in enumerate(chances)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long>>")


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit tokens in code points. Tokens are what ASCII white space parts."""
    out, at, last = [], 0, -2
    pieces = text.encode().split()
    for i, piece in enumerate(pieces):
        word = piece.decode()
        at = text.index(word, at)
        if hit[i]:
            if last == i - 1:
                out[-1]["end"] = at + len(word)
            else:
                out.append({"start": at, "end": at + len(word)})
            last = i
        at += len(word)
    return out


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, learn(docs, labels, fold(F.col("doc_id"), 4) != 2))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"))
