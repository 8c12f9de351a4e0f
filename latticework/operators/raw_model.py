"""Scores of raw models, which have backbone and CB positions only, at numbers of a known sequence with predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import add, clamped, cross, dihedral, distance2, dot, scale, sub, unit, vec
from ..functions.scalars import AMINO_ACIDS, bin_of, interpolated
from .chains import agreement
from .checks import checked
from .spatial import radius_join

#: The largest angle that falls into a bin, the least cosine, and the square of the longest C-N bond.
TOP_ANGLE, LEAST_COSINE, BOND2 = 3.141, -0.999999, 9.0
PI = 3.141592653589793


@dataclass(frozen=True)
class RawTables:
    """The tables that a raw model is scored with.

    reduced is (ss, a, b, d, alpha, beta, gamma, e), packing (ss, a, n, e), torsion (g, b0 ... b5, e), constraints (i, j, constraint);
    observed, predicted and joint are those of agreement. ss is H, E or C.
    """

    reduced: DataFrame
    packing: DataFrame
    torsion: DataFrame
    constraints: DataFrame
    observed: DataFrame
    predicted: DataFrame
    joint: DataFrame


@dataclass(frozen=True)
class RawOptions:
    """Bins and reaches of these tables."""

    reach: float
    distance_bins: int
    angle_bins: int
    dihedral_bins: int
    separation: int
    packing_reach: float
    most: int
    constraint_reach: float
    step: float
    torsion_bins: tuple[int, ...]
    low: float = 0.0


def _held_angle(cosine: Column) -> Column:
    return F.acos(clamped(cosine, LEAST_COSINE, 1.0))


def _torsions(residues: DataFrame, group: Column, torsion: DataFrame, options: RawOptions) -> DataFrame:
    """(model, torsion): mean energy over residues that have both angles themselves and at either side."""
    w = Window.partitionBy("model").orderBy("rnum")
    near = residues.select("model", "rnum", group.alias("g"), *[f"{a}{v}" for a in ("n", "ca", "c") for v in "xyz"], F.lag("rnum").over(w).alias("p_rnum"), F.lead("rnum").over(w).alias("n_rnum"), *[F.lag(f"c{v}").over(w).alias(f"p_c{v}") for v in "xyz"], *[F.lead(f"n{v}").over(w).alias(f"n_n{v}") for v in "xyz"])
    before = (F.col("p_rnum") + 1 == F.col("rnum")) & (distance2(vec("p_c"), vec("n")) < BOND2)
    after = (F.col("rnum") + 1 == F.col("n_rnum")) & (distance2(vec("c"), vec("n_n")) < BOND2)
    phi = F.when(before, clamped(dihedral(vec("p_c"), vec("n"), vec("ca"), vec("c")), high=TOP_ANGLE))
    psi = F.when(after, clamped(dihedral(vec("n"), vec("ca"), vec("c"), vec("n_n")), high=TOP_ANGLE))
    own = near.select("model", "rnum", "g", phi.alias("phi"), psi.alias("psi"))
    six = own.select("model", "g", *[F.lag(a).over(w).alias(f"v{i}") for i, a in enumerate(("phi", "psi"))], F.col("phi").alias("v2"), F.col("psi").alias("v3"), *[F.lead(a).over(w).alias(f"v{i + 4}") for i, a in enumerate(("phi", "psi"))])
    bins = six.dropna(subset=[f"v{i}" for i in range(6)]).select("model", "g", *[bin_of(F.col(f"v{i}"), -PI, PI, n).alias(f"b{i}") for i, n in enumerate(options.torsion_bins)])
    on = ["g", *[f"b{i}" for i in range(6)]]
    return bins.join(torsion, on, "left").groupBy("model").agg(F.avg(F.coalesce("e", F.lit(0.0))).alias("torsion"))


def raw_scores(residues: DataFrame, sequence: DataFrame, tables: RawTables, options: RawOptions) -> DataFrame:
    """(model, dist_const, reduced, cb_packing, torsion, ss_agreement, coverage) of every model.

    residues is (model, rnum, dssp, and n, ca, c, cb positions), sequence (rnum, aa, pred, conf, g): the letter, predicted state
    and torsion group of every position. Pairs count within the larger of the reduced and constraint reaches between CA atoms, for CB
    counts too. All means are over all positions of the model, those of torsion over residues with six angles; a model without
    any has torsion 0. A position of the sequence with another letter than the twenty or another state than H, E and C is an error, and so are
    numbers that are not 1, 2, 3, ...
    """
    length = sequence.agg(F.count("*").cast("double")).scalar()
    numbered = F.count("*").over(Window.partitionBy("rnum")) == 1
    good = F.col("aa").isin(*AMINO_ACIDS) & F.col("pred").isin("H", "E", "C") & (F.col("rnum") >= 1) & (F.col("rnum") <= length) & F.col("once_")
    words = F.concat_ws(" ", F.lit("not a position of a sequence with predictions:"), F.col("rnum").cast("string"), "aa", "pred")
    sequence = checked(sequence.withColumn("once_", numbered), F.coalesce(good, F.lit(False)), words).drop("once_")
    v = unit(add(unit(sub(vec("ca"), vec("n"))), unit(sub(vec("ca"), vec("c")))))
    known = residues.join(sequence, "rnum")
    points = known.select("model", "rnum", "aa", "pred", *[F.col(f"ca{x}").alias(x) for x in "xyz"], *[f"cb{x}" for x in "xyz"], *[p.alias(f"v{x}") for p, x in zip(v, "xyz")])
    pairs = radius_join(points, points, max(options.reach, options.constraint_reach), ["model"], strict=True).where("l_rnum <> r_rnum")
    d = F.sqrt("d2")
    to = scale(sub(vec("r_"), vec("l_")), 1 / d)
    alpha, beta = _held_angle(dot(vec("l_v"), to)), _held_angle(-dot(to, vec("r_v")))
    after = cross(to, vec("r_v"))
    gamma = clamped(F.atan2(-dot(vec("l_v"), after), -dot(cross(vec("l_v"), to), after)), high=TOP_ANGLE)
    rows = pairs.select(
        F.col("l_model").alias("model"), F.col("l_rnum").alias("rnum"), F.least("l_rnum", "r_rnum").alias("i"), F.greatest("l_rnum", "r_rnum").alias("j"), d.alias("at"),
        F.col("l_pred").alias("ss"), F.col("l_aa").alias("a"), F.col("r_aa").alias("b"), (distance2(vec("l_cb"), vec("r_cb")) < options.packing_reach**2).alias("packed"),
        F.when((d < options.reach) & (F.abs(F.col("l_rnum") - F.col("r_rnum")) >= options.separation), bin_of(d, options.low, options.reach, options.distance_bins)).alias("d"),
        bin_of(alpha, 0.0, PI, options.angle_bins).alias("alpha"), bin_of(beta, 0.0, PI, options.angle_bins).alias("beta"), bin_of(gamma, -PI, PI, options.dihedral_bins).alias("gamma"),
    )
    rows = rows.join(tables.reduced, ["ss", "a", "b", "d", "alpha", "beta", "gamma"], "left").join(tables.constraints.select("i", "j", "constraint"), ["i", "j"], "left")
    kept = F.when(F.col("at") < options.constraint_reach, interpolated(F.col("constraint"), F.col("at"), options.step))
    each = rows.groupBy("model", "rnum").agg(F.avg("e").alias("reduced"), F.avg(kept).alias("dist_const"), F.count_if("packed").alias("near"))
    by_residue = known.join(each, ["model", "rnum"], "left").withColumn("n", F.least(F.coalesce("near", F.lit(0)), F.lit(options.most)).cast("int"))
    by_residue = by_residue.join(tables.packing.select(F.col("ss").alias("pred"), F.col("a").alias("aa"), "n", F.col("e").alias("cb_packing")), ["pred", "aa", "n"], "left")
    by_residue = agreement(by_residue, tables.observed, tables.predicted, tables.joint).withColumnRenamed("agreement", "ss_agreement")
    mean = lambda c: (F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*")).alias(c)
    scores = by_residue.groupBy("model").agg(*[mean(c) for c in ("dist_const", "reduced", "cb_packing", "ss_agreement")], F.count("*").alias("placed"))
    scores = scores.withColumn("coverage", F.col("placed") / length).join(_torsions(known, F.col("g"), tables.torsion, options), "model", "left")
    return scores.select("model", "dist_const", "reduced", "cb_packing", F.coalesce("torsion", F.lit(0.0)).alias("torsion"), "ss_agreement", "coverage")
