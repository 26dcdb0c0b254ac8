"""Connected components of a graph in a table, by alternating large-star and small-star rounds of DataFrame operations.

Each round joins edges only with one minimum per node, so a node of very high degree costs rows in proportion to its edges and
never one task's memory: minima are pre-aggregated before the shuffle. Rounds are cut off from their lineage by files in the shared folder, which
survive the loss of executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a fresh local folder under a
    `local` master; elsewhere executors would not see each other's files, so this raises."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if conf:
        if current.isEmpty():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parley-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again. For tables that rounds of joins hand on: a checkpoint keeps the estimated size of its plan, which every join multiplies, so after some rounds the estimates themselves are
    numbers too long to work with; files have their own size, and small ones are broadcast."""
    folder = f"{shared_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: link each node's larger neighbours to the least of the node and its neighbours. small: link its smaller neighbours, and the node, to it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that each node of an edge reaches. Edges have no direction; nodes may be structs, of a recording
    and a place in it say. Self-loops make a node its own component; edges with a null end are ignored; repeated edges count once; an empty table gives an empty result. Other columns are ignored."""
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given = given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    given = stored(given)
    stars, last = given.where("a <> b"), None
    while True:
        stars = stored(_star(_star(stars, large=True), large=False))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    own = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return own.join(stars.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
