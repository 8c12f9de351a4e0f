"""Log-odds energies from histograms, and scoring by table lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import refusing
from .histogram import dense

SIGMA, MAX_ENERGY = 0.02, 8.0


def _energy(n: Column, share: Column, sigma: float) -> Column:
    return F.ln(1 + sigma * n) - F.ln(1 + sigma * n * share)


def sippl(counts: DataFrame, keys: list[str], sizes: dict[str, int], sigma: float = SIGMA, reference_state: str = "classic", within: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bins, e) for every bin of each key: sparse-data corrected log-odds against a reference state.

    classic takes the distribution over bins of all keys together, uniform gives each bin the same share. Every bin is
    there, counted or not; a key without counts has energy 0. within names key columns whose values have a table each: their
    distributions are their own.
    """
    if reference_state not in ("classic", "uniform"):
        raise ValueError(f"unknown reference state {reference_state!r}: classic and uniform are implemented")
    bins, keys = list(sizes), [*keys, *[c for c in within if c not in keys]]
    cells = 1
    for n in sizes.values():
        cells *= n
    rows = dense(counts, keys, sizes)
    if reference_state == "classic":
        by_bin = counts.groupBy(*within, *bins).agg(F.sum("w").alias("nb_"))
        rows = rows.join(by_bin, [*within, *bins], "left").withColumn("all_", F.sum(F.coalesce("nb_", F.lit(0.0))).over(Window.partitionBy(*keys)))
        ref = F.try_divide(F.coalesce("nb_", F.lit(0.0)), F.col("all_"))
    else:
        ref = F.lit(1.0 / cells)
    share = F.coalesce(F.try_divide(F.try_divide(F.col("w"), F.col("n_")), ref), F.lit(0.0))
    return rows.select(*keys, *bins, _energy(F.col("n_"), share, sigma).alias("e"))


def sippl_hybrid(first: DataFrame, second: DataFrame, keys: list[str], sizes: dict[str, int], sigma: float = SIGMA, max_energy: float = MAX_ENERGY) -> DataFrame:
    """Energies of two statistics, the first one's distribution blended with the second's by the second's counts."""
    bins = list(sizes)

    def shares(counts, name):
        rows = dense(counts, keys, sizes)
        by_bin = counts.groupBy(*bins).agg(F.sum("w").alias("nb_"))
        rows = rows.join(by_bin, bins, "left").withColumn("all_", F.sum(F.coalesce("nb_", F.lit(0.0))).over(Window.partitionBy(*keys)))
        share = F.coalesce(F.try_divide(F.try_divide(F.col("w"), F.col("n_")), F.try_divide(F.coalesce("nb_", F.lit(0.0)), F.col("all_"))), F.lit(0.0))
        return rows.select(*keys, *bins, F.col("n_").alias(f"n{name}_"), share.alias(f"p{name}_"))

    both = shares(first, 1).join(shares(second, 2), [*keys, *bins], "full")
    n, s = F.coalesce("n2_", F.lit(0.0)), F.coalesce("p1_", F.lit(0.0)) + sigma * F.coalesce("n2_", F.lit(0.0)) * F.coalesce("p2_", F.lit(0.0))
    e = F.when(s > 0, F.least(F.lit(max_energy), F.ln(1 + sigma * n) - F.ln(F.when(s > 0, s)))).otherwise(max_energy)
    return both.select(*keys, *bins, e.alias("e"))


def normalised_by_state(counts: DataFrame, state: str, sizes: dict[str, int], states: tuple | None = None) -> DataFrame:
    """(state, bins, e): -ln of the share over the uniform one, not above 0, scaled so that a state's expectation is -1.

    A state without a favoured bin has energy 0 throughout. Each of states, if given, must have counts; one without any is an error.
    """
    n_cells = 1
    for n in sizes.values():
        n_cells *= n
    w = Window.partitionBy(state)
    rows = dense(counts, [state], sizes).withColumn("p_", F.col("w") / F.col("n_"))
    rows = rows.withColumn("e_", -F.ln(F.greatest(F.col("p_") * n_cells, F.lit(1.0))))
    rows = rows.withColumn("t_", F.abs(F.sum(F.col("p_") * F.col("e_")).over(w)))
    out = rows.select(state, *sizes, F.coalesce(F.try_divide(F.col("e_"), F.col("t_")), F.lit(0.0)).alias("e"))
    if states is None:
        return out
    wanted = counts.sparkSession.createDataFrame([(s,) for s in states], f"state_ {counts.schema[state].dataType.simpleString()}")
    have = counts.groupBy(F.col(state).alias("state_")).agg(F.sum("w").alias("n_")).where("n_ > 0")
    return refusing(out, wanted.join(have, "state_", "left_anti"), F.concat(F.lit("no counts of state "), F.col("state_").cast("string")))


def lookup(rows: DataFrame, energies: DataFrame, on: list[str], missing: float | None = None) -> DataFrame:
    """rows with e from the table, null (or `missing`) where the table has no such cell."""
    out = rows.join(energies, on, "left")
    return out if missing is None else out.withColumn("e", F.coalesce("e", F.lit(missing)))


def residue_energies(residues: DataFrame, scored: DataFrame, id_cols: list[str], normalise: bool = True, empty: float | None = None, counts: bool = False) -> DataFrame:
    """(ids, energy) for every residue: mean (or sum) of its interactions, `empty` where it has none; with counts their number too.

    A row of scored stands for as many interactions as its column times says, where there is one.
    """
    known = F.sum(F.when(F.col("e").isNotNull(), F.col("times"))) if "times" in scored.columns else F.count("e")
    found = scored.groupBy(*id_cols).agg(_of_all(scored, normalise).alias("energy"), *([known.alias("count")] if counts else []))
    out = residues.select(*id_cols).distinct().join(found, id_cols, "left")
    if counts:
        out = out.withColumn("count", F.coalesce("count", F.lit(0)))
    return out if empty is None else out.withColumn("energy", F.coalesce("energy", F.lit(empty)))


def total_energy(scored: DataFrame, by: list[str] | None = None, normalise: bool = True) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(_of_all(scored, normalise).alias("energy"))


def _of_all(scored: DataFrame, normalise: bool) -> Column:
    """Mean (or sum) of e over rows, each as many times as the column times says, where there is one."""
    if "times" not in scored.columns:
        return F.avg("e") if normalise else F.sum("e")
    total = F.sum(F.col("e") * F.col("times"))
    return F.try_divide(total, F.sum(F.when(F.col("e").isNotNull(), F.col("times")))) if normalise else total
