"""Line dedup: levelled sorted runs of line hashes.

Every line becomes a 128-bit hash of its key. Batches arrive in document order; the keys of a batch are
merge-joined with the runs written before it, the keys not found there (the anti join) become a new run of
level 0, and when a level holds `fanout` runs they are compacted into one run of the next level. A key is in
exactly one run, with the smallest document that holds it, so a line stays only there. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BLANKS, LOWER, UPPER, join_hot, shared_dir, stage, table, union_all

KEY = ["h1", "h2"]
#: The lines of a batch, about. A batch reads all runs before it, so batches are as large as a cluster sorts in one go.
BATCH_LINES = 1 << 32


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, th, pos, h1, h2) for every line whose key has min_chars code points; th tells apart rows of one id."""
    key = line_key(F.col("line"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    return rows.select("doc", "th", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def order_key(id_: Column, kind: T.DataType, skip: int = 0) -> Column:
    """A number that never falls as ids rise: numbers themselves, of others seven bytes of their text after the first skip."""
    if isinstance(kind, T.NumericType):
        return id_
    return F.conv(F.rpad(F.substring(F.hex(F.encode(id_.cast("string"), "UTF-8")), 2 * skip + 1, 14), 14, "0"), 16, 10).cast("long")


def shared_bytes(docs: DataFrame, id_col: str) -> int:
    """How many bytes all ids that are text begin with alike; 0 for numbers."""
    if isinstance(docs.schema[id_col].dataType, T.NumericType):
        return 0
    low, high = docs.agg(*[f(F.col(id_col).cast("string")) for f in (F.min, F.max)]).first()
    return len(commonprefix([(low or "").encode(), (high or "").encode()]))


class LineRuns:
    """The levelled runs. A run is a table (h1, h2, first), bucketed by key and sorted in each bucket.

    A batch is shuffled by key once and then merged with run after run where they lie: the runs are not shuffled.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def write(self, rows: DataFrame) -> DataFrame:
        """rows, which lie hashed by key, as a bucketed table in the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/staged/{name}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "zstd").saveAsTable(name)
        table_ = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, and the relation with its buckets is resolved already
        return table_

    def add(self, keys: DataFrame) -> DataFrame:
        """Take a batch's (h1, h2, doc); give (h1, h2, first, n) for the keys that more than one document holds, n times in the batch."""
        firsts = keys.groupBy(*KEY).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        known = self.runs()
        for k, run in enumerate(known):
            # one merge join answers both: no match (the anti join) makes a fresh key, a match tells its first document
            firsts = firsts.join(run.withColumnRenamed("first", f"seen{k}").hint("merge"), KEY, "left")
        # a key is in one run at most
        seen = F.coalesce(*[F.col(f"seen{k}") for k in range(len(known))], F.lit(None).cast(keys.schema["doc"].dataType))
        settled = firsts.select(*KEY, F.coalesce(seen, "low").alias("first"), "n", seen.isNull().alias("fresh"), (seen.isNotNull() | (F.col("low") < F.col("high"))).alias("shared"))
        settled = self.write(settled)
        self.levels[0].append(settled.where("fresh").select(*KEY, "first"))
        self._compact()
        return settled.where("shared").select(*KEY, "first", "n")

    def _compact(self) -> None:
        for n in range(len(self.levels)):
            if len(self.levels[n]) >= self.fanout:
                merged = union_all(self.levels[n])
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self.write(merged.repartition(self.buckets, *KEY)))
                self.levels[n] = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, n_batches: int = 4, batch_lines: int = BATCH_LINES, fanout: int = 3) -> DataFrame:
    """docs with text_col rebuilt, and n_lines (before), n_dropped.

    There are n_batches batches, or more so that they have about batch_lines lines at most. A null or empty text is one empty
    line. Rows of the same id count as one document, so none of them loses a line to another. Rows with a null id take no
    part and keep all their lines. Other columns stay as they are; columns named n_lines or n_dropped are replaced.
    """
    hashes = line_hashes(docs, id_col, text_col, min_chars)
    kind, skip = docs.schema[id_col].dataType, shared_bytes(docs, id_col)
    hashes = stage(hashes.withColumn("at", order_key(F.col("doc"), kind, skip)), "lines")
    total = hashes.count()
    n_batches = max(n_batches, -(-total // batch_lines))
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(order_key(F.col(id_col), kind, skip), shares, 100 * n_batches)).first()[0] or [] if shares else []))
    hashes = hashes.withColumn("batch", sum([(F.col("at") > F.lit(c)).cast("int") for c in cuts], F.lit(0)))
    runs, shared = LineRuns(docs.sparkSession, fanout), []
    for b in range(len(cuts) + 1):
        part = runs.add(hashes.where(F.col("batch") == b).select("doc", *KEY))
        shared.append(part.withColumn("batch", F.lit(b)))
    gone = join_hot(hashes.select("doc", "th", "pos", "batch", *KEY), union_all(shared), ["batch", *KEY], "n", total).where(F.col("first") < F.col("doc"))
    gone = gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone_"))
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    row = F.struct(*[F.col(c) for c in rest]).alias("row_")  # other columns may have any name
    rows = docs.select(row, F.col(id_col).alias("id_"), F.col(text_col).alias("was_"), F.xxhash64(F.col(text_col)).alias("th_"), text_lines(F.col(text_col)).alias("lines_"))
    found = rows.join(gone, (F.col("id_") == F.col("doc")) & (F.col("th_") == F.col("th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.col("gone_"))
    text = F.when(F.col("gone_").isNull(), F.col("was_")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines_"), i)), "\n"))
    made = {text_col: text, "n_lines": F.size("lines_").cast("long"), "n_dropped": F.coalesce(F.size("gone_"), F.lit(0)).cast("long")}
    names = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return found.select(*[(made[c] if c in made else F.col("row_").getField(c)).alias(c) for c in names])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT doc_id, pos, line, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
