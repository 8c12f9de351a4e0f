"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, mixing.

Every stage reads what its predecessor wrote. All but the last return the columns of documents; the last returns
the mix: those columns, with size, source_size, target and taken (words, repeats counted), for the documents it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.decontamination import decontaminate
from latticework.llm.line_dedup import dedup_lines
from latticework.llm.mixing import mix, quality_weight, word_count
from latticework.llm.quality import classify
from latticework.llm.shared import stage, table
from latticework.llm.simhash import near_duplicates

SHINGLE_WORDS, SIMILAR = 5, 80
FIGURES = ["size", "source_size", "target", "taken"]


def trusted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside their language's perplexity bounds go."""
    return classify(docs, table(spark, sf_dir, "labels")).where("keep").select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, except in the smallest document that holds them; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 80 percent or more, every such link found; or fingerprints of 3 bits or fewer) the smallest document stays.

    Rows with a null id stay. Rows that share an id stay if one of their texts is the first of its group.
    """
    near = near_duplicates(docs, width=SHINGLE_WORDS, similar=SIMILAR)
    copies = near.groupBy("doc").agg(F.max(F.col("doc") == F.col("component")).alias("first")).where("not first")
    return docs.join(copies, docs["doc_id"] == copies["doc"], "left_anti")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how many words of each.

    Every row is mixed by itself, rows with a null or repeated id too: rows get a number that is written with them, and
    those with a null id draw their key by their text. Columns named like the figures are replaced.
    """
    columns = [c for c in docs.columns if c not in FIGURES]
    row, key = (next(f"{n}{'_' * k}" for k in range(1, 99) if f"{n}{'_' * k}" not in columns) for n in ("row", "key"))
    rows = stage(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "rows")
    sizes = rows.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text")).alias(key))
    taken = mix(quality_weight(sizes, table(spark, sf_dir, "labels")), id_col=row, weight_col="mix_weight", size_col="size", key_col=key).where("taken > 0")
    return rows.join(taken, row).select(*[rows[c] for c in columns], *FIGURES)


STAGES = [
    ("quality classifier", trusted_quality),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("mixing", mixed),
]
#: Stages 1, 3 and 4 (a language model, fingerprints with components, alignments) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
