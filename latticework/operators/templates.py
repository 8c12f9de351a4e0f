"""Scores of models that are built on templates: profile against profile, and the network score of an alignment and its model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, without_gaps
from ..sources.profiles import PROFILE_LETTERS, column_entropy
from .chains import alignment_features
from .models import GroupScorer

#: What of another letter's probability a letter gets, and what of the background's.
LETTER_WEIGHT, BACKGROUND_WEIGHT = 0.3, 0.05


def _by_letter(table: DataFrame, value: str, letters: str | list[str], *names: str) -> dict:
    """A small table as values by its letters; each combination must be there."""
    found = {tuple(r[n] for n in names): float(r[value]) for r in table.select(*names, value).collect()}
    if len(names) == 1:
        return {a: found[a,] for a in letters}
    return {(a, b): found[a, b] for a in letters for b in letters}


def with_pseudo_counts(profile: DataFrame, conditional: DataFrame, background: DataFrame, letters: str | list[str] = PROFILE_LETTERS, letter_weight: float = LETTER_WEIGHT, background_weight: float = BACKGROUND_WEIGHT) -> DataFrame:
    """profile with freqs mixed with what conditional(a, b, p), the probability of a given b, makes of them, then with background(a, p).

    freqs are in the order of letters. A column without any letters (all 0) becomes the background.
    """
    p, g = _by_letter(conditional, "p", letters, "a", "b"), _by_letter(background, "p", letters, "a")
    matrix = F.array(*[F.array(*[F.lit(p[a, b]) for b in letters]) for a in letters])
    null = F.array(*[F.lit(g[a]) for a in letters])
    seen = F.aggregate("freqs", F.lit(0.0), lambda n, f: n + f) > 0
    drawn = F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, "freqs", lambda x, f: x * f), F.lit(0.0), lambda n, v: n + v))
    mixed = F.zip_with("freqs", drawn, lambda f, d: (1 - letter_weight) * f + letter_weight * d)
    mixed = F.zip_with(mixed, null, lambda m, b: (1 - background_weight) * m + background_weight * b)
    return profile.withColumn("freqs", F.when(seen, mixed).otherwise(null))


def column_score(p: Column, q: Column, background: Column) -> Column:
    """log2 of how much likelier two columns have the same letter than by chance; null where they cannot have it."""
    odds = F.aggregate(F.zip_with(F.zip_with(p, q, lambda a, b: a * b), background, lambda v, g: F.when(g > 0, v / F.when(g > 0, g)).otherwise(0.0)), F.lit(0.0), lambda n, v: n + v)
    return F.when(odds > 0, F.log2(F.when(odds > 0, odds)))


def profile_scores(columns: DataFrame, target: DataFrame, template: DataFrame, background: DataFrame, keys: list[str], target_keys: list[str], template_keys: list[str], letters: str | list[str] = PROFILE_LETTERS) -> DataFrame:
    """(keys, profile_score, profile_columns, avg_entropy): the sum of column scores over columns in which both have a letter.

    columns is (keys, t_pos, s_pos), target (target_keys, pos, freqs) and template (template_keys, pos, freqs); the key columns of both are among
    keys. A column that a profile lacks is left out; avg_entropy is that of the target's whole profile. Alignments without any such
    column have null. Gaps are not counted: they are features of their own.
    """
    g = _by_letter(background, "p", letters, "a")
    null = F.array(*[F.lit(g[a]) for a in letters])
    both = columns.where("t_pos is not null and s_pos is not null").select(*keys, "t_pos", "s_pos")
    one = target.select(*target_keys, F.col("pos").alias("t_pos"), F.col("freqs").alias("p_"))
    two = template.select(*template_keys, F.col("pos").alias("s_pos"), F.col("freqs").alias("q_"))
    rows = both.join(one, [*target_keys, "t_pos"]).join(two, [*template_keys, "s_pos"])
    scores = rows.groupBy(*keys).agg(F.sum(column_score(F.col("p_"), F.col("q_"), null)).alias("profile_score"), F.count("*").alias("profile_columns"))
    entropy = target.groupBy(*target_keys).agg(F.avg(column_entropy(F.col("freqs"))).alias("avg_entropy"))
    return columns.select(*keys).distinct().join(scores, keys, "left").join(entropy, target_keys, "left").select(*keys, "profile_score", F.coalesce("profile_columns", F.lit(0)).alias("profile_columns"), "avg_entropy")


def of_its_sequence(alignments: DataFrame, sequences: DataFrame, keys: list[str]) -> DataFrame:
    """alignments(keys, t, s) whose t, without gaps, is the sequence of sequences(name of keys ..., sequence); any other is an error.

    The check is a filter, which the optimiser keeps whatever columns are selected.
    """
    on = [k for k in keys if k in sequences.columns]
    known = sequences.select(*on, F.col("sequence").alias("known_"))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("an alignment's first row is not its sequence:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    rows = alignments.join(known, on, "left")
    return rows.where(F.when(without_gaps(F.col("t")).eqNullSafe(F.col("known_")), F.lit(True)).otherwise(wrong)).drop("known_")


def template_scores(alignments: DataFrame, substitutions: DataFrame, keys: list[str], scorer: GroupScorer, *parts: DataFrame) -> DataFrame:
    """(keys, every feature, template_score): each alignment's features and those of further parts, scored in one plan.

    alignments is (keys, t, s). parts are tables of keys (or some of them) and features: scores of the raw model, of profiles, a model's
    average local score; what a part lacks is null. The score is that of the first feature group that an alignment has in full, within [0, 1],
    and 0 if it has none. Features that no part has are null columns, so that their groups are passed over.
    """
    out = alignment_features(alignments, substitutions, keys)
    for part in parts:
        on = [k for k in keys if k in part.columns]
        if twice := [c for c in part.columns if c in out.columns and c not in on]:
            raise ValueError(f"features given twice: {', '.join(twice)}")
        out = out.join(part, on, "left")
    wanted = dict.fromkeys(c for group in scorer.groups for c in group)
    for name in wanted:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.withColumn("template_score", clamp01(scorer.score(), 0.0))
