"""Helpers that the training-data operators share: reading tables, staging intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blanks: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; any other master is refused,
    since executors could not read each other's local files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def unstage(*frames: DataFrame) -> None:
    """Delete the files of what stage returned; no frame that is still to be computed may read them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined to keyed, one row a key, whose column n counts the rows with that key; total rows there are in all.

    Keys that hold over a HOT_PARTS-th of the rows are HOT_PARTS at most, so they are broadcast; the others are shuffled.
    """
    heavy = F.col(n) * F.lit(HOT_PARTS) > F.lit(total)
    hot, cold = keyed.where(heavy).drop(n), keyed.where(~heavy).drop(n)
    if hot.isEmpty():
        return rows.join(cold, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of edges(a, b), root the smallest node reachable.

    Alternating large-star and small-star steps; each round is one grouped minimum and one join on node,
    and ends in a staged table. Stars keep the number of edges bounded by the input's. Nodes must be
    non-null and of one orderable type. Raises if max_rounds do not suffice (rounds grow with the
    logarithm of the longest path).
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = both.join(low, "a")
        moved = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select("a", F.col("m").alias("b"))
        return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()

    e = stage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        e = stage(star(star(e, True), False), "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = now
    raise RuntimeError("connected components did not settle")
