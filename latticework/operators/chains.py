"""Chains against their full sequences: names, numbers, coverage, agreement with predictions, membrane sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import inner_gap_runs, without_gaps
from .checks import checked

#: Names for chains that have none, in the order in which they are given out.
CHAIN_NAMES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
BURIED_BELOW = 0.25


def named_chains(chains: DataFrame, by: list[str], chain: str = "chain") -> DataFrame:
    """Distinct (by, chain) with new_chain: blank names become the first unused ones of CHAIN_NAMES, others stay.

    by are the columns that tell structures apart. A structure with more blank chains than free names is an error.
    """
    w, blank = Window.partitionBy(*by), F.length(F.trim(F.coalesce(F.col(chain), F.lit("")))) == 0
    rows = chains.select(*by, chain).distinct().withColumn("blank_", blank)
    rows = rows.withColumn("used_", F.collect_set(F.when(~F.col("blank_"), F.col(chain))).over(w))
    rows = rows.withColumn("at_", F.row_number().over(Window.partitionBy(*by, "blank_").orderBy(chain)))
    free = F.array_except(F.array(*map(F.lit, CHAIN_NAMES)), F.col("used_"))
    given = F.coalesce(F.get(free, F.col("at_") - 1), F.raise_error(F.lit("no chain name is left")).cast("string"))
    return rows.select(*by, chain, F.when(F.col("blank_"), given).otherwise(F.col(chain)).alias("new_chain"))


def chain_sequences(chains: DataFrame, sequences: DataFrame) -> DataFrame:
    """chains with the columns of sequences(name, sequence): by chain name, or the only sequence for every chain.

    A chain without a sequence is an error.
    """
    only = sequences.agg(F.when(F.count("*") == 1, F.first("name"))).scalar()
    keyed = chains.withColumn("name_", F.coalesce(only, F.col("chain")))
    out = keyed.join(sequences.withColumnRenamed("name", "name_"), "name_", "left")
    missing = F.raise_error(F.concat(F.lit("no sequence for chain "), F.coalesce("chain", F.lit("?")))).cast("string")
    return out.withColumn("sequence", F.coalesce("sequence", missing)).drop("name_")


def numbered_by_sequence(residues: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """residues with rnum replaced by their column in the alignment of the full sequence t to the chain's sequence s.

    columns is (by, col, t, s, s_pos), col from 0; s_pos counts the chain's letters from 1, in the order of rnum.
    """
    w = Window.partitionBy(*by).orderBy("rnum")
    at = columns.where("s != '-'").select(*by, F.col("s_pos").alias("at_"), (F.col("col") + 1).cast("int").alias("new_"))
    return residues.withColumn("at_", F.row_number().over(w)).join(at, [*by, "at_"]).drop("rnum", "at_").withColumnRenamed("new_", "rnum")


def coverage(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, covered, coverage) of the full sequence t by s."""
    length, covered = F.count_if(F.col("t") != "-"), F.count_if((F.col("t") != "-") & (F.col("s") != "-"))
    return columns.groupBy(*keys).agg(length.alias("length"), covered.alias("covered"), F.try_divide(covered.cast("double"), length.cast("double")).alias("coverage"))


def predictions_on_chain(predictions: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s_pos, ...): the predictions (keys, t_pos, ...) of the full sequence, cut to the letters of the chain."""
    at = columns.where("t != '-' and s != '-'").select(*keys, "t_pos", "s_pos")
    return at.join(predictions, [*keys, "t_pos"]).drop("t_pos")


def agreement(rows: DataFrame, observed: DataFrame, predicted: DataFrame, joint: DataFrame) -> DataFrame:
    """rows(dssp, pred, conf, ...) with agreement: ln of the joint probability over the product of the single ones.

    observed is (dssp, p), predicted (pred, conf, p), joint (dssp, pred, conf, p). A state that a table lacks gives null.
    """
    p = [(observed, ["dssp"]), (predicted, ["pred", "conf"]), (joint, ["dssp", "pred", "conf"])]
    out = rows
    for k, (t, on) in enumerate(p):
        out = out.join(t.select(*on, F.col("p").alias(f"p{k}_")), on, "left")
    ratio = F.try_divide(F.col("p2_"), F.col("p0_") * F.col("p1_"))
    return out.withColumn("agreement", F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio)))).drop("p0_", "p1_", "p2_")


def agreement_parts(rows: DataFrame, observed: DataFrame, predicted: DataFrame, joint: DataFrame) -> DataFrame:
    """rows(dssp, pred, conf, ...) with p_observed, p_predicted and p_joint of the three tables, null where a table lacks the state.

    A confidence outside 0 to 9 is an error, which hangs on the rows themselves.
    """
    words = F.concat(F.lit("a confidence must be from 0 to 9: "), F.coalesce(F.col("conf").cast("string"), F.lit("null")))
    out = checked(rows, F.coalesce(F.col("conf").between(0, 9), F.lit(False)), words)
    for table, on, name in ((observed, ["dssp"], "p_observed"), (predicted, ["pred", "conf"], "p_predicted"), (joint, ["dssp", "pred", "conf"], "p_joint")):
        out = out.join(table.select(*on, F.col("p").alias(name)), on, "left")
    return out


def alignment_features(alignments: DataFrame, substitutions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq_id, seq_sim, n_insertions, n_deletions, seqres_length, seqres_coverage) of alignments(keys, t, s).

    t is the full sequence, s a template's. Insertions are runs of gaps within s, deletions within t; identity is in percent of
    the columns where both have a letter, similarity as by column_similarity, both null without such columns.
    """
    runs = alignments.select(*keys, inner_gap_runs(F.col("s")).alias("n_insertions"), inner_gap_runs(F.col("t")).alias("n_deletions"), F.length(without_gaps(F.col("t"))).alias("seqres_length"), "t", "s")
    letters = alignments.select(*keys, F.explode(F.zip_with(F.split("t", ""), F.split("s", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select(*keys, "p.a", "p.b")
    low, high = (substitutions.agg(f("s").cast("double").alias("v")).scalar() for f in (F.min, F.max))
    both = letters.where((F.col("a") != "-") & (F.col("b") != "-")).join(substitutions, ["a", "b"], "left")
    found = both.groupBy(*keys).agg((F.avg((F.col("a") == F.col("b")).cast("double")) * 100).alias("seq_id"), ((F.avg("s") - low) / (high - low)).alias("seq_sim"), F.count("*").alias("n_"))
    out = runs.drop("t", "s").join(found, keys, "left")
    covered = F.try_divide(F.coalesce("n_", F.lit(0)).cast("double"), F.col("seqres_length").cast("double"))
    return out.select(*keys, "seq_id", "seq_sim", "n_insertions", "n_deletions", "seqres_length", covered.alias("seqres_coverage"))


def exposure(relative_area: Column) -> Column:
    """b or e, by the accessible share of a residue's surface; null if it is missing."""
    known = F.nanvl(relative_area, F.lit(None).cast("double"))
    return F.when(known < BURIED_BELOW, "b").when(known.isNotNull(), "e")


def structure_class(predicted: Column, observed: Column) -> Column:
    """helix, extended or coil: by prediction where there is one, else by the observed state."""
    helix, extended = list("HGI"), list("EB")
    state = F.coalesce(predicted, observed)
    return F.when(state.isin(*helix), "helix").when(state.isin(*extended), "extended").when(state.isNotNull(), "coil")


def membrane_key(side: Column, structure: Column) -> Column:
    """The table that a residue of a membrane protein is scored with: membrane, interface or its structure class."""
    return F.when(side == "core", "membrane").when(side == "interface", "interface").otherwise(structure)


def helical_membranes(residues: DataFrame, by: list[str]) -> DataFrame:
    """(by, helix, extended) counts of residues in the membrane; more extended ones than helical ones are an error."""
    inside = residues.where("side = 'core'").groupBy(*by).agg(*[F.count_if(F.col("structure") == s).alias(s) for s in ("helix", "extended")])
    wrong = F.raise_error(F.lit("only helical membrane proteins can be scored")).cast("long")
    return inside.withColumn("helix", F.when(F.col("helix") < F.col("extended"), wrong).otherwise(F.col("helix")))


def disjoint(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """first, checked row by row to have no row in common with second."""
    marked = first.join(second.select(*on).distinct().withColumn("shared_", F.lit(True)), on, "left")
    bad = F.raise_error(F.lit("the two selections intersect")).cast("boolean")
    return marked.where(F.when(F.col("shared_"), bad).otherwise(F.lit(True))).drop("shared_")
