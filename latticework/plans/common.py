"""Tables of the driver as the operators' inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, dims: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """Embeddings as labelled points: id, label, x, y, z."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(d)).cast("double").alias(v) for d, v in zip(dims, "xyz")])


POINTS = "p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
PAIRS = POINTS + f""", q AS (SELECT l.id AS id, l.label AS a, r.id AS other, r.label AS b, (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z) AS d2
  FROM p l JOIN p r ON l.id <> r.id AND (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z) <= {RADIUS * RADIUS})"""


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out
