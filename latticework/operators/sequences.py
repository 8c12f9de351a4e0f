"""Ordered operators: triplets, state smoothing, runs, reference sets, rule selection, sequence accounting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamped
from ..functions.scalars import missing_to_null


def triplets(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with prev_ and next_ value in their sequence."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("prev_" + value, F.lag(value).over(w)).withColumn("next_" + value, F.lead(value).over(w))


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, value, run, start, end, n): stretches of equal value, numbered by row; start and end are row numbers from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("at_", F.row_number().over(w)).withColumn("new_", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", value).agg(F.min("at_").alias("start"), F.max("at_").alias("end"), F.count("*").alias("n"))


def kept_states(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with kept: the value where a neighbour shares it, else null."""
    t = triplets(rows, by, order, value)
    same = F.coalesce(F.col("prev_" + value) == F.col(value), F.lit(False)) | F.coalesce(F.col("next_" + value) == F.col(value), F.lit(False))
    return t.withColumn("kept", F.when(same, F.col(value))).drop("prev_" + value, "next_" + value)


def size_matched_zs(models: DataFrame, reference: DataFrame, size: str, values: dict[str, str], low: int = 40, high: int = 600, spread: float = 0.1, invert: bool = False) -> DataFrame:
    """models with <column>_z_score for each column of values, which names the reference's column of each.

    A z-score is the distance from the reference rows of like size, in their sample standard deviations. The size is clamped to
    [low, high]; like is between (1 - spread) and (1 + spread) of it, as whole numbers. Reference rows are summed by size first, and
    each model size's window once for all columns, so that the range join is between distinct sizes. A model without a size has no z.
    """
    size_ = clamped(F.col(size), low, high)
    sizes = models.select(size_.alias("s_")).distinct().where("s_ is not null")
    theirs = [missing_to_null(F.col(c).cast("double")) for c in values.values()]
    # sums are of distances from one value near them all, lest the squares of large values swallow the spread
    centre = reference.agg(F.struct(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"c{k}") for k, v in enumerate(theirs)])).scalar()
    off = reference.select(F.col(size).cast("long").alias("r_"), *[(v - centre.getField(f"c{k}")).alias(f"o{k}_") for k, v in enumerate(theirs)])
    parts = {f"{n}{k}_": v for k in range(len(theirs)) for n, v in (("n", F.count(f"o{k}_")), ("x", F.sum(f"o{k}_")), ("xx", F.sum(F.col(f"o{k}_") * F.col(f"o{k}_"))))}
    by = off.groupBy("r_").agg(*[v.alias(n) for n, v in parts.items()])
    window = sizes.withColumn("r_", F.explode(F.sequence(F.floor(F.col("s_") * (1 - spread)).cast("long"), F.floor(F.col("s_") * (1 + spread)).cast("long"))))
    stat = window.join(by, "r_").groupBy("s_").agg(*[F.sum(n).alias(n) for n in parts])
    out = models.withColumn("s_", size_).join(stat, "s_", "left")
    for k, own in enumerate(values):
        n, mean = F.col(f"n{k}_"), F.try_divide(F.col(f"x{k}_"), F.col(f"n{k}_"))
        sd = F.sqrt(clamped(F.try_divide(F.col(f"xx{k}_") - n * mean * mean, n - 1), low=0.0))
        z = F.try_divide(missing_to_null(F.col(own).cast("double")) - centre.getField(f"c{k}") - mean, sd) * (-1 if invert else 1)
        out = out.withColumn(f"{own}_z_score", z)
    return out.drop("s_", *parts)


def size_matched_z(models: DataFrame, reference: DataFrame, size: str, value: str, low: int = 40, high: int = 600, spread: float = 0.1, invert: bool = False) -> DataFrame:
    """models with z, the z-score of one column that both tables have."""
    return size_matched_zs(models, reference, size, {value: value}, low, high, spread, invert).withColumnRenamed(f"{value}_z_score", "z")


def nearest_entry(values: Column, table: list[tuple[float, float]]) -> Column:
    """The entry of a fixed table (at, value) nearest to a value, the first of equals."""
    entries = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in table])
    best = F.aggregate(entries, F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("b")), lambda acc, x: F.when(F.abs(x["a"] - values) < acc["d"], F.struct(F.abs(x["a"] - values).alias("d"), x["b"].alias("b"))).otherwise(acc))
    return F.when(values.isNotNull(), best["b"])


def first_complete(groups: list[list[str]]) -> Column:
    """The number of the first group of columns without a missing value, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(groups) - 1, -1, -1):
        whole = F.lit(True)
        for c in groups[k]:
            whole = whole & F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNotNull()
        out = F.when(whole, F.lit(k)).otherwise(out)
    return out


def earliest_before(rows: DataFrame, by: list[str], date: str, order: list[str], before: str) -> DataFrame:
    """The first row of each group, in order, dated before the day given; groups without one go."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.where(F.to_date(date) < F.to_date(F.lit(before))).withColumn("at_", F.row_number().over(w)).where("at_ = 1").drop("at_")


def log_odds(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, log_odds): ln of the joint share over the product of the marginal shares, from counts(a, b, w)."""
    both = counts.groupBy(a, b).agg(F.sum("w").alias("w"))
    sums = {c: both.groupBy(c).agg(F.sum("w").alias(f"w_{c}")) for c in (a, b)}
    total = both.agg(F.sum("w").cast("double")).scalar()
    return both.join(sums[a], a).join(sums[b], b).select(a, b, F.ln(F.col("w") * total / (F.col(f"w_{a}") * F.col(f"w_{b}"))).alias("log_odds"))


def match_score(predicted: Column, observed: Column, known: list[str]) -> Column:
    """1 where equal, 0 where not, null where either is not one of the known letters."""
    return F.when(predicted.isin(*known) & observed.isin(*known), (predicted == observed).cast("double"))


def unique_by_hash(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row for each distinct text: hash, the first id columns in order, and how many rows have it."""
    return rows.groupBy(F.md5(text).alias("hash")).agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("n")).select("hash", "f.*", "n")


def annotated_by_hash(rows: DataFrame, text: str, annotations: DataFrame) -> DataFrame:
    """rows with the columns of annotations(hash, ...), by the hash of a text column; rows that none fits have nulls."""
    return rows.withColumn("hash", F.md5(text)).join(annotations, "hash", "left")


def differences(base: DataFrame, others: dict[str, DataFrame], on: list[str], score: str) -> DataFrame:
    """(on, <name>): base's score less that of each other table, for the keys that all of them have."""
    out = base.select(*on, F.col(score).alias("base_"))
    for name, t in others.items():
        out = out.join(t.select(*on, F.col(score).alias(f"o_{name}")), on)
    return out.select(*on, *[(F.col("base_") - F.col(f"o_{n}")).alias(n) for n in others])


def smoothed(rows: DataFrame, by: list[str], order: list[str], value: str, sigma: float, reach: int) -> DataFrame:
    """rows with smooth: Gaussian means of a value over the rows up to reach before and after, rescaled at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    terms = []
    for k in range(-reach, reach + 1):
        v = F.col(value) if k == 0 else (F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w))
        terms.append((v, math.exp(-0.5 * (k / sigma) ** 2)))
    total = sum((F.coalesce(v * g, F.lit(0.0)) for v, g in terms), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), g).otherwise(0.0) for v, g in terms), F.lit(0.0))
    return rows.withColumn("smooth", F.try_divide(total, weight))


def missing_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table lacks."""
    return rows.join(table, key, "left_anti")


def repeated_numbers(residues: DataFrame, by: list[str], number: str) -> DataFrame:
    """Groups in which a number occurs more than once."""
    return residues.groupBy(*by, number).agg(F.count("*").alias("n")).where("n > 1")


def removal_counts(before: DataFrame, after: DataFrame, by: list[str], parts: dict[str, str]) -> DataFrame:
    """(by, <part>_removed): distinct values of each part column before less after."""
    count = lambda df, p: df.groupBy(*by).agg(*[F.countDistinct(c).alias(f"{p}{n}") for n, c in parts.items()])
    return count(before, "b_").join(count(after, "a_"), by, "left").select(*by, *[(F.col(f"b_{n}") - F.coalesce(f"a_{n}", F.lit(0))).alias(f"{n}_removed") for n in parts])


def complete_sets(files: DataFrame, prefix: str, suffix: str, needed: list[str]) -> DataFrame:
    """Prefixes that have all needed suffixes."""
    return files.groupBy(prefix).agg(F.collect_set(suffix).alias("s")).where(F.size(F.array_except(F.array(*map(F.lit, needed)), "s")) == 0).select(prefix)
