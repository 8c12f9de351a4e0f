"""Command line: train statistical terms on structures, and score models with them.

    python -m latticework train --structures 'x/*.pdb' --terms terms.json --out tables
    python -m latticework score --models 'y/*.pdb' --tables tables --out scores

terms.json is an object of {name: {"term": ..., options}}, as {"pairs": {"term": "interaction", "low": 0, "high": 10, "bins": 10,
"separation": 4}}. tables holds the counts and the energies, each with its term's options. out gets the features and averages as Parquet, the
local values as CSV and a JSON document for each model: global_scores, local_terms with every term of every chain, preprocessing with
what was left out of the model, and local_scores, the network's or else the first term's. --scores is a JSON file of {name: {"weights": {feature: w}, "intercept": i}},
With --annotations when training, terms have a table for each structure class, and with --slabs for membrane and interface; scoring then
needs them too. --reference a Parquet table of residues, features and scores for z-scores, --network a folder that GroupScorer.load reads.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.checks import at_most, checked, unique_numbers
from .operators.constraints import ConstraintSet
from .operators.features import average_local_scores, averages, local_scores, model_scores
from .operators.membrane import scoring_states, sides
from .operators.models import GroupScorer
from .operators.structures import FEATURES, STATE_KEY, Constraints, make_term, residue_id, structure_features, term_points
from .sources.readers import backbone, preprocessed, preprocessing_report, read_structures
from .sources.sinks import Container, result_documents, score_arrays, term_arrays, write_scores


def _structures(given: DataFrame, most_models: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Atoms and backbone of what was read; residues of one number in a chain, insertion codes and too many models are errors."""
    code = F.concat_ws(" ", F.lit("an insertion code:"), "model", "chain", F.col("rnum").cast("string"), "icode")
    atoms = checked(preprocessed(given), F.coalesce(F.trim("icode"), F.lit("")) == "", code)
    residues = unique_numbers(backbone(atoms), ["model", "chain"])
    return atoms, at_most(residues, ["model"], most_models, "models") if most_models else residues


def _terms(settings: dict) -> dict:
    """(kind, term) of every name; lists of rules and ranges may come from JSON."""
    out = {}
    for name, options in settings.items():
        options = dict(options)
        out[name] = (kind := options.pop("term"), make_term(kind, **options))
    return out


def _json(path: str | None) -> dict | None:
    if path is None:
        return None
    with open(path) as f:
        return json.load(f)


def _states(spark: SparkSession, residues: DataFrame, annotations: str | None, slabs: str | None) -> DataFrame | None:
    """What residues are scored with: their structure class, or their place in a membrane; None without annotations."""
    if annotations is None:
        if slabs:
            raise ValueError("slabs need annotations")
        return None
    outside = residues.select("model", "chain", "rnum", residue_id(F.col("chain"), F.col("rnum")).alias("res"), F.lit("outside").alias("side"), F.lit(False).alias("in_membrane"))
    return scoring_states(sides(residues, spark.read.parquet(slabs)) if slabs else outside, spark.read.parquet(annotations))


def train(spark: SparkSession, structures: str, settings: dict, out: str, sigma: float, annotations: str | None = None, slabs: str | None = None) -> None:
    """Counts and energies of every term; with annotations, a table for each state of residues, but for terms that are scaled by state."""
    atoms, residues = _structures(read_structures(spark, structures))
    states = _states(spark, residues, annotations, slabs)
    counts, energies = Container(kind="counts", options=settings), Container(kind="energies", options=settings)
    for name, (kind, term) in _terms(settings).items():
        points = term_points(kind, atoms, residues)
        keyed = states is not None and not term.sums
        own = points.join(states.select("model", "res", STATE_KEY), ["model", "res"]) if keyed else points
        counts[name] = term.train(own, points, extra=(STATE_KEY,) if keyed else ())
    counts.save(f"{out}/counts")
    saved = Container.load(spark, f"{out}/counts", "counts")
    for name, (_, term) in _terms(settings).items():
        energies[name] = term.energies(saved[name], sigma, extra=(STATE_KEY,) if STATE_KEY in saved[name].columns else ())
    energies.save(f"{out}/energies")


def score(spark: SparkSession, models: str, tables: str, out: str, names: tuple[str, ...] = (), scores: dict | None = None, reference: str | None = None, network: str | None = None, constraints: str | None = None, annotations: str | None = None, most_models: int | None = None, slabs: str | None = None) -> None:
    """Features of every residue, averages and global scores of every model, and a document of both."""
    energies = Container.load(spark, f"{tables}/energies", "energies")
    terms = _terms(energies.options)
    given = read_structures(spark, models)
    atoms, residues = _structures(given, most_models)
    columns = [*terms, *names]
    inputs = {"annotations": spark.read.parquet(annotations), "states": _states(spark, residues, annotations, slabs)} if annotations else {}
    if constraints:
        bounds = ConstraintSet.load(spark, constraints)
        inputs["constraints"] = Constraints(bounds.table.withColumnRenamed("target", "chain"), bounds.options.step, bounds.options.cutoff)
    structure_features(atoms, residues, terms, energies, names, **inputs).write.mode("overwrite").parquet(f"{out}/features")
    features = spark.read.parquet(f"{out}/features")  # what follows reads the features, instead of scoring again
    means = averages(features, ["model"], columns)
    if scores:
        linear = {name: (s["weights"], s["intercept"]) for name, s in scores.items()}
        scored = model_scores(features, ["model"], linear, spark.read.parquet(reference) if reference else None)
        means = means.join(scored.drop(*[c for c in means.columns if c != "model"]), "model")
    local, shown = columns[0], features
    if network:
        local, shown = "score", local_scores(features, means, ["model"], GroupScorer.load(spark, network)).select(*features.columns, "score")
        means = means.join(average_local_scores(shown, ["model"], F.col("dist_const").isNotNull() if constraints and "dist_const" in names else F.lit(False)).drop("residues"), "model")
    means.write.mode("overwrite").parquet(f"{out}/averages")
    columns += [local] if network else []
    write_scores(shown, f"{out}/local", ["chain", "rnum", "rname", *columns])
    arrays = score_arrays(features.select("model", "chain", "rnum"), shown.select("model", "chain", "rnum", local), ["model", "chain"], "rnum", local)
    every = term_arrays(shown, columns, ["model", "chain"], "rnum")
    result_documents(arrays, spark.read.parquet(f"{out}/averages"), terms=every, preprocessing=preprocessing_report(given)).select("json").write.mode("overwrite").text(f"{out}/documents")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="latticework", description=__doc__.partition("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("train", help="count and turn into energies")
    one.add_argument("--structures", required=True)
    one.add_argument("--terms", required=True, help="JSON file of the terms")
    one.add_argument("--sigma", type=float, default=0.02)
    two = commands.add_parser("score", help="score models")
    two.add_argument("--models", required=True)
    two.add_argument("--tables", required=True, help="what train wrote")
    two.add_argument("--features", nargs="*", default=[], choices=FEATURES, help="features besides the terms")
    two.add_argument("--scores", help="JSON file of linear global scores")
    two.add_argument("--reference", help="reference table for z-scores")
    two.add_argument("--network", help="folder of the local network scorer")
    two.add_argument("--constraints", help="folder of a constraint set whose targets are chains, for dist_const")
    two.add_argument("--most-models", type=int, help="more models than these are an error")
    for p in (one, two):
        p.add_argument("--annotations", help="Parquet table of annotations: for features that need them, and for tables by state of residues")
        p.add_argument("--slabs", help="Parquet table of the models' membranes")
        p.add_argument("--out", required=True)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("latticework").getOrCreate()
    if a.command == "train":
        train(spark, a.structures, _json(a.terms), a.out, a.sigma, a.annotations, a.slabs)
    else:
        score(spark, a.models, a.tables, a.out, tuple(a.features), _json(a.scores), a.reference, a.network, a.constraints, a.annotations, a.most_models, a.slabs)


if __name__ == "__main__":
    main()
