"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / weight, u from a hash of its id. A source's target is
water-filled from the source weights; complete epochs of the source come first, and what remains is taken in
key order up to the token budget. The prefix sums run over stretches of keys: the one that the budget ends in is split
again until it holds few rows, whatever the weights, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, stage, table

WEIGHTS = (5.0, 2.0, 1.0)
#: A stretch is split into so many parts at a time, until it has MOST_ROWS or fewer. The columns that order rows of a source.
SPLITS, MOST_ROWS, ORDERED = 256, 256, ("key", "size", "ord")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc: Column, seed: str = "") -> Column:
    """In (0, 1), from the first 52 bits of md5(seed + id)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4503599627370496.0)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights in code-point order, null last.

    The table has one row a source, so its windows over all rows are small.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumn("all_", F.sum("source_size").over(everything) * share).withColumn("wsum", F.sum("w").over(everything)).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = left.withColumn("full", (F.col("all_") - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.col("wsum") - F.col("w_before")))
    spent = full.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)).withColumn("w_free", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything))
    return spent.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise((F.col("all_") - F.col("cap_full")) * F.col("w") / F.col("w_free")).alias("target"))


def _narrowed(rows: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """state with each source's stretch cut to the one of SPLITS parts of it, by column, that the budget ends in."""
    lo, hi = F.col(f"{column}_lo"), F.col(f"{column}_hi")
    spot = F.coalesce(F.least(F.lit(SPLITS - 1), F.floor(F.try_divide((F.col(column) - lo) * float(SPLITS), hi - lo))), F.lit(0)).cast("int")
    ends = [f"{c}_{e}" for c in ORDERED for e in ("lo", "hi") if c != column]
    inside = rows.join(state, rows["source"].eqNullSafe(state["s1"])).where(_inside()).withColumn("spot", spot)
    parts = inside.groupBy("s1", "spot").agg(F.sum("size").alias("here"), F.count("*").alias("rows"), F.min(column).alias(f"{column}_lo"), F.max(column).alias(f"{column}_hi"), *[F.first(c).alias(c) for c in ("part", "ahead", *ends)])
    ahead = F.coalesce(F.sum("here").over(Window.partitionBy("s1").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("ahead")
    return parts.withColumn("ahead", ahead).where((F.col("ahead") <= F.col("part")) & (F.col("ahead") + F.col("here") > F.col("part"))).select("s1", "part", "ahead", "rows", *[f"{c}_{e}" for c in ORDERED for e in ("lo", "hi")])


def _inside() -> Column:
    return F.col("key").between(F.col("key_lo"), F.col("key_hi")) & F.col("size").between(F.col("size_lo"), F.col("size_hi")) & F.col("ord").between(F.col("ord_lo"), F.col("ord_hi"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, size_col: str | None = None, key_col: str | None = None, share: float = 1.5, seed: str = "", most_rows: int = MOST_ROWS) -> DataFrame:
    """(id, size, source_size, target, taken) for every row.

    taken is size times the complete epochs, plus size again for a document that the fractional part selects.
    Sizes are word counts of the texts, or size_col where it is given, so that weights can be joined without the texts.
    The document that the budget ends in is taken if more than half of it fits. A null text has size 0, a null
    source is a source of its own, a null or non-positive weight counts as 1. Keys are drawn by key_col, the id unless given;
    rows of the same key are taken by size, and rows alike in every column one after the other. Sources are expected to be few
    beside rows: their windows hold one row a source. An empty table gives an empty result.
    """
    weight = F.coalesce(F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")), F.lit(1.0)) if weight_col else F.lit(1.0)
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(key_col or id_col).alias("by"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("w"))
    key = -F.ln(uniform(F.col("by"), seed)) / F.col("w")
    rows = stage(rows.select("doc", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("ord")), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), *[f(c).alias(f"{c}_{e}") for c in ORDERED for e, f in (("lo", F.min), ("hi", F.max))])
    sources = stage(sources, "sources")
    aims = targets(sources.select("source", "source_size"), share)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    aims = stage(aims.withColumn("epochs", epochs).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    parts = aims.select(F.col("source").alias("s1"), "part")
    state = sources.join(parts, F.col("source").eqNullSafe(F.col("s1"))).where("source_size > part").withColumn("ahead", F.lit(0).cast("long"))
    state = state.select("s1", "part", "ahead", "rows", *[f"{c}_{e}" for c in ORDERED for e in ("lo", "hi")])
    for column in ORDERED:
        # a stretch ends up with few rows, or with one value of the column
        while not (state := stage(state, "stretches")).where((F.col("rows") > most_rows) & (F.col(f"{column}_lo") < F.col(f"{column}_hi"))).isEmpty():
            state = _narrowed(rows, state, column)
    ends = state.select(F.col("s1").alias("s2"), "ahead", *[f"{c}_{e}" for c in ORDERED for e in ("lo", "hi")])
    aims = aims.withColumnRenamed("source", "s1").join(ends, F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2")
    found = rows.join(stage(aims, "ends"), rows["source"].eqNullSafe(F.col("s1")))
    edge = F.coalesce(_inside(), F.lit(False))
    same = F.lit(True)
    before = F.lit(False)
    for c in ORDERED:
        before = before | (same & (F.col(c) < F.col(f"{c}_lo")))
        same = same & (F.col(c) == F.col(f"{c}_lo"))
    plain = found.where(~edge).withColumn("chosen", F.when(F.col("key_lo").isNull(), F.lit(True)).otherwise(before))
    upto = F.col("ahead") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc", "size", "ord").rowsBetween(Window.unboundedPreceding, 0))
    ending = found.where(edge).withColumn("chosen", upto - F.col("size") / 2.0 <= F.col("part"))
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    return plain.unionByName(ending).select(F.col("doc").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def quality_weight(docs: DataFrame, labels: DataFrame, good: float = 1.0, unknown: float = 0.5, bad: float = 0.25) -> DataFrame:
    """docs with the column mix_weight, from labels(doc_id, quality); the best label counts where there are several.

    A column mix_weight that docs has is replaced; all its others stay, whatever their names.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.struct("doc_id", "quality").alias("label"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    quality = F.col("label.quality")
    w = F.when(quality >= 1, good).when(quality < 1, bad).otherwise(unknown)
    out = rows.join(known, F.col("row.doc_id") == F.col("label.doc_id"), "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "mix_weight"], w.alias("mix_weight"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(quality_weight(docs, table(spark, sf_dir, "labels")), weight_col="mix_weight", size_col="size")


OP2_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(documents.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (CASE WHEN q >= 1 THEN 1.0 WHEN q < 1 THEN 0.25 ELSE 0.5 END)::DOUBLE AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id
), s0 AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, 2 * n AS cap FROM s1),
s3 AS (SELECT *, sum(n) OVER () * 1.5::DOUBLE AS a, sum(w) OVER () AS wsum,
  coalesce(sum(cap) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb FROM s2
  WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (a - cb) * w >= cap * (wsum - wb) AS sat FROM s3),
s5 AS (SELECT *, sum(CASE WHEN sat THEN cap ELSE 0 END) OVER () AS cf, sum(CASE WHEN sat THEN 0 ELSE w END) OVER () AS wf FROM s4),
s AS (SELECT source, n, CASE WHEN sat THEN cap ELSE (a - cf) * w / wf END AS target FROM s5),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM s)
SELECT d.doc_id, size, n::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE <= target - epochs * n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
