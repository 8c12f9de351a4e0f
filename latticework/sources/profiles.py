"""Sequence profiles: the HHM text format, and what scoring needs of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import file_stem

#: The order of a profile's columns, and the unit of its logarithms.
PROFILE_LETTERS, UNIT = "ACDEFGHIKLMNPQRSTVWY", 1000.0


def read_hhm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, pos, aa, freqs) for each match state: freqs are probabilities in the order of PROFILE_LETTERS.

    The format gives -1000 log2 of each, and * for zero. Files without a match state give no rows.
    """
    text = spark.read.text(path, wholetext=True)
    line = r"(?m)^[A-Z] +\d+\s+(?:(?:\d+|\*)\s+){20}\d+\s*$"
    rows = text.select(file_stem(F.col("_metadata.file_path")).alias("file"), F.regexp_extract("value", r"(?m)^NAME\s+(.*?)\s*$", 1).alias("name"), F.explode(F.regexp_extract_all("value", F.lit(line), F.lit(0))).alias("line"))
    parts = F.split(F.trim("line"), r"\s+")
    freqs = F.transform(F.slice(parts, 3, 20), lambda v: F.when(v == "*", 0.0).otherwise(F.pow(F.lit(2.0), -v.try_cast("double") / UNIT)))
    return rows.select("file", "name", F.get(parts, F.lit(1)).cast("int").alias("pos"), F.get(parts, F.lit(0)).alias("aa"), freqs.alias("freqs"))


def column_entropy(freqs):
    """Shannon entropy, in nats, of a column's probabilities."""
    return F.aggregate(freqs, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(F.when(p > 0, p))).otherwise(0.0))


def average_entropy(profile: DataFrame) -> DataFrame:
    return profile.groupBy("file").agg(F.avg(column_entropy(F.col("freqs"))).alias("avg_entropy"))


def read_training_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers of a CSV file with a header; rows in which one is missing are left out."""
    rows = spark.read.csv(path, header=True)
    if lacking := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"the file lacks the columns {', '.join(lacking)}")
    known = rows.select(*[F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    return known.dropna()
