"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised apart: K centroids each, by k-means on a bounded sample. A vector's cell is the pair of its halves' centroids, so K + K
centroids part space into K * K cells. A query visits cells in the order of the summed squared distances of its halves to the pair's centroids, which a heap
yields one pair at a time, until the cells hold a set share of all rows; every row in them is then ranked by its distance on the original vectors.

The share is no constant: on the sample the true neighbours of some rows are found by brute force, and the share is the one that reaches `recall` of them there.
Vectors with structure need a small one, vectors without any need a third of all rows or more, and either is found out by the same rule.

Cells lie in shelves of about SHELF rows; one with more rows is dealt to several by hash. Every vector is shuffled once, to its shelf, and every query once to each
shelf where it visits a cell. A task holds one shelf at a time and lets the queries stream past.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import partitions
from parley.operators.components import materialize

#: Rows that centroids and share are fitted on at most; rows of it that stand as queries; most centroids of a half; rows that a cell should hold on the average;
#: rows of a shelf at most, and at least where there are too few shelves for all tasks; queries that meet a shelf at once.
SAMPLE, TRIALS, CENTROIDS, CELL, SHELF, LEAST_SHELF, TOGETHER = 16384, 512, 512, 16, 8192, 256, 64
ROUNDS, RECALL = 10, 0.95


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and `v` (doubles) of the rows that take part: those with a vec_id whose vector isn't null, empty or all zeros and holds no null and no non-finite component."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad & F.exists(x, lambda c: c != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(length) and not (length == size).all():
        raise ValueError(f"vectors of unequal length: {size} and {length[length != size][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def centroids(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from k of the points (fewer, if fewer differ), the same ones each time. A centroid that loses its points stays where it is."""
    points = np.unique(points, axis=0)
    middle = points[np.random.default_rng(42).permutation(len(points))[:k]]
    for _ in range(rounds):
        own = nearest(points, middle)
        size = np.bincount(own, minlength=len(middle))
        total = np.zeros_like(middle)
        np.add.at(total, own, points)
        middle = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], middle)
    return middle


def nearest(points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * points @ middle.T).argmin(axis=1)


def halves(vector: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of a vector's halves to the centroids of each. Taken a vector at a time, so that equal vectors get equal numbers wherever they are."""
    cut = first.shape[1]
    return ((first - vector[:cut]) ** 2).sum(axis=1), ((second - vector[cut:]) ** 2).sum(axis=1)


def traverse(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs in ascending order of one[i] + two[j]. The heap holds the next pair of each row of the table of sums that was begun, and a row begins when the one above it yields its first."""
    rows, cols = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    heap = [(one[rows[0]] + two[cols[0]], 0, 0)]
    while heap:
        total, a, b = heapq.heappop(heap)
        yield total, rows[a], cols[b]
        if b + 1 < len(cols):
            heapq.heappush(heap, (one[rows[a]] + two[cols[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(rows):
            heapq.heappush(heap, (one[rows[a + 1]] + two[cols[0]], a + 1, 0))


def reach(one: np.ndarray, two: np.ndarray, count: np.ndarray, enough: float) -> float:
    """The summed distance of the pair at which the pairs traversed hold `enough` rows; that of the last pair, if all together hold fewer. count: rows of each pair."""
    held, total = 0, 0.0
    for total, i, j in traverse(one, two):
        held += count[i, j]
        if held >= enough:
            break
    return total


def needed_share(points: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> float:
    """The share of `points` that queries must visit for `recall` of their true k nearest to lie in the cells visited. Brute force on the sample, which the driver holds."""
    cut = first.shape[1]
    cell = nearest(points[:, :cut], first) * len(second) + nearest(points[:, cut:], second)
    count = np.bincount(cell, minlength=len(first) * len(second))
    norm, needed = (points**2).sum(axis=1), []
    for i in np.linspace(0, len(points) - 1, min(trials, len(points))).astype(int):
        away = norm - 2 * points @ points[i]
        away[i] = np.inf
        true = np.argpartition(away, min(k, len(points) - 1) - 1)[:k]
        one, two = halves(points[i], first, second)
        order = np.argsort((one[:, None] + two).ravel(), kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(count[order])
        needed.append(held[cell[true]] / len(points))
    return float(np.quantile(np.concatenate(needed), recall, method="higher"))


def shelves(count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell, and the number of parts of each shelf: cells stand in order, a shelf takes cells as long as it has `most` rows or fewer, and a cell of more has one of several parts for itself."""
    shelf, parts, held = np.zeros(len(count), np.int64), [1], 0
    for cell, rows in enumerate(count.tolist()):
        if held and held + rows > most:
            parts.append(1)
            held = 0
        shelf[cell] = len(parts) - 1
        held += rows
        parts[-1] = max(1, -(-held // most))
    return shelf, np.array(parts)


def closest(queries: np.ndarray, own: np.ndarray, visits: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, ids, distances) of each query's k nearest of `rows` among those it visits (a mask by query and row), less rows of its own id, ties to smaller ids. Products pick the
    rows within rounding of the k-th distance, and only those are measured component by component."""
    norm, size = (rows**2).sum(axis=1), (queries**2).sum(axis=1)
    rough = size[:, None] + norm - 2 * queries @ rows.T
    rough[~visits | (ids == own[:, None])] = np.inf
    for i, far in enumerate(rough):
        there = np.flatnonzero(far < np.inf) if np.isfinite(size[i]) else np.flatnonzero(visits[i] & (ids != own[i]))
        if len(there) > k and np.isfinite(far[there]).all():
            kth = np.partition(far[there], k - 1)[k - 1]
            there = there[far[there] <= kth + 1e-12 * (size[i] + norm[there]) + 1e-12 * abs(kth)]
        exact = np.sqrt(((rows[there] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[there], exact))[:k]
        yield i, ids[there[best]], exact[best]


def search(queries: DataFrame, candidates: DataFrame, k: int, recall: float = RECALL, share: float | None = None, sample: int = SAMPLE, shelf: int = SHELF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query (vec_id, v) the k nearest candidates (vec_id, v; all, if fewer) in the cells it visits, by Euclidean distance, ties to smaller vec_id.

    A candidate with the query's vec_id is none of its own. Candidates that repeat a vec_id each count as a row; of queries that repeat one, the least vector is asked. An empty side gives no rows.
    Vectors of unequal length fail. Other columns are ignored. share: of the candidates that a query visits at least, and never fewer than k + 1 rows; without one it is fitted for `recall`. The driver holds
    the sample, of `sample` rows at most, and the number of rows of each cell, CENTROIDS squared at most.
    """
    spark = candidates.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], out)
    order = F.xxhash64("vec_id", "v").bitwiseAND((1 << 40) - 1)
    likely = candidates.where(order < (1 << 40) * min(1.0, (2 * sample + 1000) / n))  # so that few rows of each task go to the one that takes the first
    picked = likely.orderBy(order, "vec_id").limit(sample).select("v").toArrow()
    if not picked.num_rows:  # a few rows, repeated very often
        picked = candidates.limit(1).select("v").toArrow()
    size = int(picked.column("v").combine_chunks().value_lengths()[0].as_py())
    points = np.unique(matrix(picked.column("v"), size), axis=0)
    wanted = min(CENTROIDS, max(2, 2 ** int(np.ceil(np.log2(np.sqrt(n / CELL) + 1)))))
    first, second = centroids(points[:, : size // 2], wanted), centroids(points[:, size // 2 :], wanted)
    if share is None:
        share = needed_share(points, first, second, k, recall) if len(points) > k + 1 else 1.0
    known = spark.sparkContext.broadcast((first, second))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = known.value
        for batch in batches:
            rows = matrix(batch.column("v"), size)
            cell = nearest(rows[:, : size // 2], one) * len(two) + nearest(rows[:, size // 2 :], two)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int64())], names=["vec_id", "v", "cell"])

    entries = materialize(candidates.mapInArrow(placed, "vec_id long, v array<double>, cell long"))
    found = entries.groupBy("cell").count().toArrow()
    count = np.zeros(len(first) * len(second), np.int64)
    count[found.column("cell").to_numpy()] = found.column("count").to_numpy()
    enough = max(share * n, k + 1)
    of_cell, parts = shelves(count, min(shelf, max(LEAST_SHELF, n // (4 * partitions(spark)))))
    index = spark.sparkContext.broadcast((count.reshape(len(first), len(second)), of_cell, parts))
    row = "shelf long, part long, asks int, id long, v array<double>, cell long, reach double"

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at their shelf and part."""
        _, shelf_of, deals = index.value
        for batch in batches:
            at = shelf_of[batch.column("cell").to_numpy()]
            part = batch.column("deal").to_numpy() % deals[at]
            none = np.zeros(len(at))
            columns = [pa.array(at), pa.array(part), pa.array(none, pa.int32()), batch.column("vec_id"), batch.column("v"), batch.column("cell"), pa.array(none)]
            yield pa.RecordBatch.from_arrays(columns, names=["shelf", "part", "asks", "id", "v", "cell", "reach"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query, with how far it goes, once for each part of each shelf where it visits a cell that holds rows."""
        (one, two), (held, shelf_of, deals) = known.value, index.value
        full = (held > 0).ravel()
        for batch in batches:
            who, where, part, far = [], [], [], []
            for i, v in enumerate(matrix(batch.column("v"), size)):
                d, e = halves(v, one, two)
                limit = reach(d, e, held, enough)
                at = np.unique(shelf_of[full & ((d[:, None] + e) <= limit).ravel()])
                each = np.repeat(at, deals[at])
                who.append(np.full(len(each), i))
                where.append(each)
                part.append(np.concatenate([np.arange(x) for x in deals[at]]))
                far.append(np.full(len(each), limit))
            take = pa.array(np.concatenate(who) if who else np.zeros(0), pa.int64())
            same = np.zeros(len(take))
            columns = [*(pa.array(np.concatenate(x) if x else same, pa.int64()) for x in (where, part)), pa.array(same + 1, pa.int32()), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(same, pa.int64()), pa.array(np.concatenate(far) if far else same, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shelf", "part", "asks", "id", "v", "cell", "reach"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shelf's rows come before its queries."""
        (one, two), here, gathered, rows = known.value, None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shelf", "part", "asks")])
            starts = np.flatnonzero(np.r_[True, (np.diff(place) != 0).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                run, key = batch.slice(a, b - a), tuple(place[:2, a])
                if key != here:
                    here, gathered, rows = key, [], None
                vectors, ids = matrix(run.column("v"), size), run.column("id").to_numpy()
                if not place[2, a]:
                    gathered.append((vectors, ids, run.column("cell").to_numpy()))
                    continue
                if rows is None:
                    if not gathered:
                        continue
                    rows, gathered = [np.concatenate(x) for x in zip(*gathered, strict=True)], []
                    cells, of_row = np.unique(rows[2], return_inverse=True)
                for s in range(0, len(ids), TOGETHER):
                    asks, own, far = vectors[s : s + TOGETHER], ids[s : s + TOGETHER], run.column("reach").to_numpy()[s : s + TOGETHER]
                    sums = [halves(v, one, two) for v in asks]
                    visits = np.array([d[cells // len(two)] + e[cells % len(two)] <= r for (d, e), r in zip(sums, far, strict=True)])
                    best = list(closest(asks, own, visits[:, of_row], rows[0], rows[1], k))
                    each = np.concatenate([np.full(len(x[1]), own[x[0]]) for x in best])
                    yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(np.concatenate([x[1] for x in best]), pa.int64()), pa.array(np.concatenate([x[2] for x in best]), pa.float64())], names=["query_id", "vec_id", "score"])

    unique = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    both = entries.select("vec_id", "v", "cell", (F.xxhash64("vec_id").bitwiseAND((1 << 62) - 1)).alias("deal")).mapInArrow(stored, row).unionByName(unique.mapInArrow(asked, row))
    pairs = both.repartition("shelf", "part").sortWithinPartitions("shelf", "part", "asks").mapInArrow(met, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors.where("vec_id % 100 = 0"), vectors, 10)
