"""Exact top-k inner-product search with two cover trees.

The upper level of the candidates' tree spans all of them: CENTRES rows, picked far from each other out of a bounded sample, are its
nodes; every candidate goes to the nearest one, its cell, and a cell keeps its covering radius and largest norm. A first pass takes each query to the cells
of best bound that hold k rows, which gives a k-th score; a second one only to the cells whose bound still reaches that score.

Where queries and a cell meet, both sides are indexed by a cover tree: a node's children are points picked greedily so that they lie more
than half the node's radius apart and cover it at half the radius. A pair of nodes goes once no score under it can reach the worst k-th score among the query node's
queries. With centres q, c, covering radii R, largest angles from the centre A and largest norms N, that score is at most the least of <q, c> + R_q |c| + R_c |q| + R_q R_c and
N_q N_c cos(angle(q, c) - A_q - A_c). What is left meets in exact integer arithmetic. Cells of many rows are cut by hash into blocks, as are the queries that
meet one, so a task's memory is bounded by the block sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.components import materialize


NONE = -(2**50)
QUERY_LEAF, CANDIDATE_LEAF, CANDIDATE_BLOCK, QUERY_BLOCK = 64, 256, 16384, 4096
#: Rows a cell should hold; most cells; sampled rows for each cell to pick centres from.
CELL_ROWS, CENTRES, SAMPLE = 4096, 2048, 4
_NO_ANGLE = np.pi


@dataclass
class Node:
    """low, high: least and largest norm of the members; angle: their largest angle from the centre."""

    centre: np.ndarray
    radius: float
    norm: float
    low: float
    high: float
    angle: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def angles(dot: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Angles, rounded up, from inner products and products of norms; half a turn where a vector is zero."""
    cosine = np.clip(dot / np.where(size > 0, size, 1), -1, 1)
    return np.where(size > 0, np.minimum(np.arccos(cosine) + 1e-6, _NO_ANGLE), _NO_ANGLE)


def most(dot: np.ndarray, angle: np.ndarray, q: Node, norm: np.ndarray, radius: np.ndarray, spread: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score that members of q and of nodes with these centre products, norms, radii, angles and norm ranges can have. Scores are integers below 2**50, so the slack outweighs rounding."""
    straight = dot + q.radius * norm + radius * q.norm + q.radius * radius
    cosine = np.cos(np.maximum(0, np.where(angle > 3.1415, 0, angle) - q.angle - spread))  # half a turn may stand for no angle
    turned = np.where(cosine >= 0, q.high * high, q.low * low) * cosine
    return np.minimum(straight, turned) + 0.5 + 1e-9 * np.abs(straight)


def cover_tree(points: np.ndarray, leaf: int, members: np.ndarray | None = None, centre: int = 0) -> Node:
    """A cover tree over rows of float64 `points`. Leaves hold `leaf` points at most, or points that can't be parted. Radii are the members' true largest distances, so bounds hold however the cells were picked."""
    members = np.arange(len(points)) if members is None else members
    own = points[members]
    far = np.sqrt(((own - points[centre]) ** 2).sum(axis=1))
    norms = np.sqrt((own**2).sum(axis=1))
    norm = float(np.linalg.norm(points[centre]))
    node = Node(points[centre], float(far.max()), norm, float(norms.min()), float(norms.max()), float(angles(own @ points[centre], norms * norm).max()), members)
    if len(members) <= leaf or node.radius == 0:
        return node
    best, pick = np.full(len(members), np.inf), np.full(len(members), -1)
    at, centres = int(np.argmin(far)), 1
    while True:
        away = ((own - own[at]) ** 2).sum(axis=1)
        closer = away < best
        best[closer], pick[closer] = away[closer], at
        at = int(np.argmax(best))
        if best[at] <= (node.radius / 2) ** 2:
            break
        if centres * leaf > 2 * len(members):  # halving would give nearly single points: cells then keep their larger radius
            break
        centres += 1
    node.children = [cover_tree(points, leaf, members[pick == c], int(members[c])) for c in np.unique(pick)] if (pick == pick[0]).sum() < len(pick) else []
    return node


def bounds(a: Node, others: list[Node]) -> np.ndarray:
    """`most` of a query node against candidate nodes."""
    centres = np.array([b.centre for b in others])
    norm, radius, spread, low, high = np.array([(b.norm, b.radius, b.angle, b.low, b.high) for b in others]).T
    dot = centres @ a.centre
    return most(dot, angles(dot, norm * a.norm) - 2e-6, a, norm, radius, spread, low, high)


def search(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, reached: np.ndarray | None = None, leaves: tuple[int, int] = (QUERY_LEAF, CANDIDATE_LEAF)) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of each query's k best rows of integer `points`, best first, ties to smaller ids; NONE pads. A row whose id is in `own` at the query's place isn't its candidate. Rows that score
    less than a query has `reached` needn't be found. leaves: points a leaf of queries and of candidates; small ones prune more and cost more where nothing can be pruned. Last, the number of pairs that met in arithmetic."""
    q, p = queries.astype(np.float64), points.astype(np.float64)
    best = np.full((len(q), k), NONE, np.int64)
    who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    floor = np.full(len(q), NONE, np.int64) if reached is None else reached
    met = 0

    def leaf(rows: np.ndarray, cols: np.ndarray) -> None:
        nonlocal met
        met += len(rows) * len(cols)
        cols = cols[np.argsort(ids[cols], kind="stable")]
        score = (q[rows] @ p[cols].T).astype(np.int64)
        new_ids = np.broadcast_to(ids[cols], score.shape)
        score = np.where(new_ids == own[rows][:, None], NONE, score)
        hopeful = (score >= np.maximum(best[rows, k - 1], floor[rows])[:, None]).any(axis=1)
        rows, score, new_ids = rows[hopeful], score[hopeful], new_ids[hopeful]
        if len(rows) and score.shape[1] > 2 * k and np.abs(score).max() < 2**62 // score.shape[1]:
            key = score * score.shape[1] - np.arange(score.shape[1])  # columns stand by id: equal scores go by smaller id
            part = np.argpartition(-key, k - 1, axis=1)[:, :k]
            score, new_ids = np.take_along_axis(score, part, axis=1), np.take_along_axis(new_ids, part, axis=1)
        all_scores, all_ids = np.hstack([best[rows], score]), np.hstack([who[rows], new_ids])
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[rows], who[rows] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    def worst(a: Node) -> int:
        return np.maximum(best[a.members, k - 1], floor[a.members]).min()

    def visit(a: Node, b: Node) -> None:
        if not a.children and not b.children:
            leaf(a.members, b.members)
            return
        if a.children and (not b.children or a.radius > b.radius):
            pairs = [(child, b, float(bounds(child, [b])[0])) for child in a.children]
        else:
            pairs = [(a, child, float(x)) for child, x in zip(b.children, bounds(a, b.children), strict=True)]
        for x, y, bound in sorted(pairs, key=lambda pair: -pair[2]):
            if bound >= worst(x):
                visit(x, y)

    if len(q) and len(p):
        visit(cover_tree(q, leaves[0]), cover_tree(p, leaves[1]))
    return who, best, met


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and `v` (array of long, floor(scale * x)) of rows whose vec_id and vector hold no null and no non-finite component."""
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))



def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Integer vectors as rows. All must have `size` components, and norms whose products stay below 2**50, so that float64 holds every score exactly."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(length) and not (length == size).all():
        raise ValueError(f"vectors of unequal length: {size} and {length[length != size][0]}")
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    if len(rows) and float((rows.astype(np.float64) ** 2).sum(axis=1).max()) >= 2.0**50:
        raise ValueError("vectors too long for exact scores: a squared norm reaches 2**50")
    return rows


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows, each the farthest from those before it; fewer if the rest lies on them."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, cell_rows: int = CELL_ROWS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates (all, if fewer) by inner product of the
    integer vectors `v`, ties to smaller vec_id. A candidate of the query's own vec_id doesn't count. vec_id must be unique among
    the candidates and among the queries; an empty side gives no rows; vectors of unequal length or too long for exact scores fail. Other columns are ignored.
    The driver holds one row a cell, CENTRES at most, and SAMPLE vectors for each.
    """
    spark = candidates.sparkSession
    candidates, queries = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    n = candidates.count()
    wanted = min(CENTRES, max(1, -(-n // cell_rows)))
    picked = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * wanted).collect()
    size = len(picked[0]["v"]) if picked else 0
    sample = matrix(pa.array([r["v"] for r in picked], pa.list_(pa.int64())), size).astype(np.float64)
    centres = sample[spread_out(sample, wanted)] if picked else sample
    lengths = np.sqrt((centres**2).sum(axis=1))
    top = spark.sparkContext.broadcast((centres, lengths))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, norm = top.value
        for batch in batches:
            rows = matrix(batch.column("v"), size).astype(np.float64)
            own = np.sqrt((rows**2).sum(axis=1))
            cell = (norm**2 - 2 * rows @ middle.T).argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
            far = np.sqrt(((rows - middle[cell]) ** 2).sum(axis=1))
            angle = angles((rows * middle[cell]).sum(axis=1), own * norm[cell])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *(pa.array(x, pa.float64()) for x in (far, own, angle)), pa.array(cell, pa.int64())], names=["vec_id", "v", "far", "norm", "angle", "cell"])

    placed = materialize(candidates.mapInArrow(nearest, "vec_id long, v array<long>, far double, norm double, angle double, cell long"))
    stats = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.max("angle").alias("angle")).orderBy("cell").collect()
    known = spark.sparkContext.broadcast({c: np.array([r[c] for r in stats]) for c in ("cell", "rows", "radius", "low", "high", "angle")})

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, (middle, norm) = known.value, top.value
            own, length = middle[cells["cell"]] if len(cells["cell"]) else middle, norm[cells["cell"]] if len(cells["cell"]) else norm
            for batch in batches:
                rows = matrix(batch.column("v"), size).astype(np.float64)
                who, where = [], []
                for i, q in enumerate(rows):
                    if not len(cells["cell"]):
                        break
                    size_q = float(np.linalg.norm(q))
                    one = Node(q, 0.0, size_q, size_q, size_q, 0.0, np.zeros(0))
                    bound = most(own @ q, angles(own @ q, length * size_q) - 2e-6, one, length, cells["radius"], cells["angle"], cells["low"], cells["high"])
                    order = np.argsort(-bound, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(cells["rows"][order]), k + 1)) + 1  # its own row may be among them
                    go = order[:enough] if first else order[enough:]
                    go = go if first else go[bound[go] >= batch.column("reached")[i].as_py()]
                    who.append(np.full(len(go), i))
                    where.append(cells["cell"][go])
                at = np.concatenate(who) if who else np.zeros(0, np.int64)
                out = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(where) if where else at, pa.int64())], names=["vec_id", "v", "reached", "cell"])

        return run

    def met(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the k best of each query in each block of the cells it is sent to."""
        asks = asked.groupBy("cell").count().collect()
        per_cell = {r["cell"]: -(-r["count"] // query_block) for r in asks}
        blocks = {r["cell"]: -(-r["rows"] // candidate_block) for r in stats}
        counts = [(c, n_q, blocks[c]) for c, n_q in per_cell.items()]
        sizes = F.broadcast(spark.createDataFrame(counts, "cell long, of_queries long, of_rows long"))  # one row a cell, CENTRES at most
        hashed = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
        all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = asked.join(sizes, "cell").select("cell", "vec_id", "v", "reached", hashed("of_queries").alias("q"), all_of("of_rows").alias("c"))
        right = placed.join(sizes, "cell").select("cell", "vec_id", "v", hashed("of_rows").alias("c"), all_of("of_queries").alias("q"))

        def run(ask: pa.Table, rows: pa.Table) -> pa.Table:
            ids, own = rows.column("vec_id").to_numpy(), ask.column("vec_id").to_numpy()
            who, best, _ = search(matrix(ask.column("v").combine_chunks(), size), matrix(rows.column("v").combine_chunks(), size), ids, own, k, ask.column("reached").to_numpy())
            i, j = np.nonzero(best > NONE)
            return pa.table({"query_id": own[i], "vec_id": who[i, j], "score": best[i, j]})

        return left.groupBy("cell", "q", "c").cogroup(right.groupBy("cell", "q", "c")).applyInArrow(run, "query_id long, vec_id long, score long")

    schema = "vec_id long, v array<long>, reached long, cell long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asking = queries.withColumn("reached", F.lit(NONE).cast("long"))
    one = materialize(met(asking.mapInArrow(routed(True), schema)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    kth = one.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(NONE).alias("reached"))
    again = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "v", F.coalesce("reached", F.lit(NONE)).cast("long").alias("reached"))
    two = met(materialize(again.mapInArrow(routed(False), schema)))
    found = one.drop("rank").unionByName(two).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
