"""From single terms to scores of residues and models: one wide feature table, averages, linear and network scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_of_known, missing_to_null
from .chains import membrane_key
from .models import GroupScorer, held, subset_score
from .sequences import nearest_entry, size_matched_zs

#: Expected error of a model's average local score, for lengths of 40, 45, 50, ... 400 residues.
EXPECTED_ERRORS = [
    0.115, 0.115, 0.112, 0.111, 0.109, 0.108, 0.107, 0.105, 0.096, 0.093, 0.092, 0.088, 0.08, 0.078, 0.078, 0.078, 0.076, 0.073, 0.072, 0.071, 0.071,
    0.067, 0.067, 0.066, 0.066, 0.067, 0.066, 0.066, 0.063, 0.063, 0.061, 0.06, 0.059, 0.059, 0.059, 0.058, 0.057, 0.056, 0.055, 0.054, 0.051, 0.052,
    0.053, 0.052, 0.052, 0.051, 0.051, 0.05, 0.051, 0.051, 0.052, 0.052, 0.052, 0.052, 0.052, 0.053, 0.053, 0.052, 0.051, 0.052, 0.051, 0.051, 0.051,
    0.05, 0.049, 0.05, 0.049, 0.05, 0.05, 0.05, 0.052, 0.053, 0.053,
]


def feature_table(residues: DataFrame, terms: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """residues with a column for each term (on, energy); a residue without a value has null.

    All terms share the key of residues, so that the joins reuse one partitioning.
    """
    out = residues
    for name, scores in terms.items():
        out = out.join(scores.select(*on, F.col("energy").alias(name)), on, "left")
    return out


def averages(features: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, residues, avg_<name>): means of the known values of each model."""
    return features.groupBy(*by).agg(F.count("*").alias("residues"), *[mean_of_known(F.col(n).cast("double")).alias(f"avg_{n}") for n in names])


def global_score(rows: DataFrame, weights: dict[str, float], intercept: float, name: str) -> DataFrame:
    """rows with the linear score of avg_ columns, within [0, 1]; null where a column is."""
    score = F.lit(float(intercept))
    for feature, w in weights.items():
        score = score + F.col(f"avg_{feature}") * float(w)
    return rows.withColumn(name, F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def z_scores(models: DataFrame, reference: DataFrame, columns: dict[str, str]) -> DataFrame:
    """models with <column>_z_score against reference rows of like size; columns names the reference column of each."""
    return size_matched_zs(models, reference, "residues", columns)


def model_scores(features: DataFrame, by: list[str], scores: dict[str, tuple[dict[str, float], float]], reference: DataFrame | None = None) -> DataFrame:
    """(by, residues, avg_<feature>, <score>, <either>_z_score): all global scores of each model and their parts.

    scores has the weights and the intercept of each score. A score that lacks one of its features is null. reference is a table of
    residues and columns named as the features and scores; each that it has gives a z-score.
    """
    names = sorted({f for weights, _ in scores.values() for f in weights})
    out = averages(features, by, names)
    for name, (weights, intercept) in scores.items():
        out = global_score(out, weights, intercept, name)
    if reference is None:
        return out
    columns = {f"avg_{n}": n for n in names} | {n: n for n in scores}
    return z_scores(out, reference, {own: other for own, other in columns.items() if other in reference.columns})


def linear_local_scores(features: DataFrame, scorer: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """features with score: weights of a row's own (by) for exactly the features it has, within [0, 1]; 0 where there are none."""
    return subset_score(features, scorer, by, names).withColumn("score", held(F.col("score")))


def membrane_local_scores(features: DataFrame, soluble: DataFrame, membrane: DataFrame, names: list[str], soluble_only: list[str], by: list[str]) -> DataFrame:
    """features(side, structure, ...) with score, of residues in and beside a membrane by scorers of their own.

    Both scorers have state besides by: soluble those of structure, membrane the states membrane and interface. The features
    named in soluble_only (agreement with predictions) are left out inside the membrane and at its faces.
    """
    inside = F.coalesce(F.col("side").isin("core", "interface"), F.lit(False))
    rows = features.withColumn("kept_", F.struct(*soluble_only)).withColumns({n: F.when(~inside, F.col(n)) for n in soluble_only})
    rows = rows.withColumn("state", membrane_key(F.col("side"), F.col("structure")))
    out = linear_local_scores(rows, soluble.unionByName(membrane), ["state", *by], names)
    return out.withColumns({n: F.col(f"kept_.{n}") for n in soluble_only}).drop("kept_", "state")


def local_scores(features: DataFrame, means: DataFrame, by: list[str], scorer: GroupScorer, letter: str = "aa") -> DataFrame:
    """features with score: the network's output for a residue's own features and its model's averages, within [0, 1]."""
    return features.join(means, by).withColumn("score", held(scorer.score(F.col(letter))))


def average_local_scores(scored: DataFrame, by: list[str], constrained: Column | None = None) -> DataFrame:
    """(by, residues, avg_local_score, avg_local_score_error); without constraints the error is null."""
    table = [(40.0 + 5 * k, e) for k, e in enumerate(EXPECTED_ERRORS)]
    known = F.bool_or(F.lit(True) if constrained is None else constrained)
    out = scored.groupBy(*by).agg(F.count("*").alias("residues"), F.avg(F.coalesce(missing_to_null(F.col("score")), F.lit(0.0))).alias("avg_local_score"), known.alias("known_"))
    error = nearest_entry(F.col("residues").cast("double"), table)
    return out.withColumn("avg_local_score_error", F.when(F.col("known_"), error)).drop("known_")
