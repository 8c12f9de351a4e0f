"""Weighted multi-dimensional histograms as long tables, their marginals and dense forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, keys: list[str], bins: list[str], weight: Column | float = 1.0) -> DataFrame:
    """(keys, bins, w); rows with a null key or bin are out of range and not counted."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys + bins], F.lit(True))
    return rows.where(known).groupBy(*keys, *bins).agg(F.sum(weight).alias("w"))


def merged(*counts: DataFrame) -> DataFrame:
    """The histogram of all rows that the given ones were made of."""
    cols = [c for c in counts[0].columns if c != "w"]
    return reduce(DataFrame.unionByName, counts).groupBy(*cols).agg(F.sum("w").alias("w"))


def marginals(counts: DataFrame, keys: list[str], bins: list[str]) -> DataFrame:
    """(keys, bins, level, w) at four levels in one pass: cell, keys, bins and total, by grouping sets."""
    sets = [[F.col(c) for c in s] for s in (keys + bins, keys, bins, [])]
    level = F.when(F.grouping(keys[0]) + F.grouping(bins[0]) == 0, "cell").when(F.grouping(bins[0]) == 1, F.when(F.grouping(keys[0]) == 1, "total").otherwise("keys")).otherwise("bins")
    return counts.groupingSets(sets, *keys, *bins).agg(level.alias("level"), F.sum("w").alias("w"))


def cell_count(counts: DataFrame, known: dict[str, list | int] | None = None, **at) -> DataFrame:
    """One row with w of the cell (or marginal) that the given columns name, 0 where nothing was counted.

    known has the values of a key column, or the number of a bin column's bins; a column that counts lacks, or a value that is not known, is an
    error.
    """
    if lacking := [c for c in at if c not in counts.columns or c == "w"]:
        raise ValueError(f"no such key or bin: {', '.join(lacking)}")
    for name, values in (known or {}).items():
        if name in at and not (0 <= at[name] < values if isinstance(values, int) else at[name] in values):
            raise ValueError(f"{at[name]!r} is no {name}")
    condition = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in at.items()], F.lit(True))
    return counts.where(condition).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def dense(counts: DataFrame, keys: list[str], sizes: dict[str, int]) -> DataFrame:
    """(keys, bins, w, n_): every bin of each key that occurs, w 0 where nothing was counted; n_ is the key's total.

    The keys come from their totals, so that all that is made of counts here reads one exchange of them.
    """
    grid = counts.groupBy(*keys).agg(F.sum("w").alias("n_")).where("n_ is not null")
    for b, n in sizes.items():
        grid = grid.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counts, [*keys, *sizes], "left").select(*keys, *sizes, F.coalesce("w", F.lit(0.0)).alias("w"), "n_")
