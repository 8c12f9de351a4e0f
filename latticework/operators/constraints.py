"""Pairwise distance constraints from templates: similarity, clustering, constraint functions, scoring."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import interpolated
from .checks import checked
from .spatial import self_pairs
from .tiles import blocks, coded, numbers, tiled

#: Least length of a sequence that is too long, most templates of a target, and the largest cutoff of distances.
TOO_LONG, MOST_TEMPLATES, FARTHEST = 65535, 65534, 30.0
#: Up to so many templates, what a pair has of them is looked up by which they are.
PATTERNS = 10


def column_similarity(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, similarity) of aligned columns pairs(keys, a, b): mean substitution score, scaled to [0, 1] by the table's range.

    scores is (a, b, s). Columns with a gap in either row are left out.
    """
    low, high = (scores.agg(f("s").cast("double").alias("v")).scalar() for f in (F.min, F.max))
    hit = pairs.where((F.col("a") != "-") & (F.col("b") != "-")).join(scores, ["a", "b"])
    return hit.groupBy(*keys).agg(((F.avg("s") - low) / (high - low)).alias("similarity"))


def identity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, identity) in percent over the columns where both rows have a letter."""
    return pairs.where((F.col("a") != "-") & (F.col("b") != "-")).groupBy(*keys).agg((F.avg((F.col("a") == F.col("b")).cast("double")) * 100).alias("identity"))


def linkage_clusters(similarities: DataFrame, target: str, threshold: float, linkage: str = "average", above: bool = True) -> DataFrame:
    """(target, item, cluster) by agglomeration of each target's items, from similarities(target, i, j, s) with i < j.

    The two clusters of best linkage merge as long as it reaches the threshold (above: similarities, else distances); a cluster
    is named by its smallest item. Linkage is over the pairs that are given, clusters without one never merge. One target's
    templates are a few hundred at most; the targets are what Spark spreads. Merging keeps each cluster's sum, count, least and
    largest value to every other, so that a merge costs one row.
    """
    pick = {"average": 0, "max": 1, "min": 2}[linkage]
    sign = 1.0 if above else -1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["i", "j", "s"])
        items = sorted({*pdf["i"], *pdf["j"]})
        spot, n = {x: k for k, x in enumerate(items)}, len(items)
        total, count = np.zeros((n, n)), np.zeros((n, n))
        most, least = np.full((n, n), -np.inf), np.full((n, n), np.inf)
        a, b, v = pdf["i"].map(spot).to_numpy(int), pdf["j"].map(spot).to_numpy(int), pdf["s"].to_numpy(float)
        for p, q in ((a, b), (b, a)):
            np.add.at(total, (p, q), v)
            np.add.at(count, (p, q), 1)
            np.maximum.at(most, (p, q), v)
            np.minimum.at(least, (p, q), v)

        def link(row):
            known = count[row] > 0
            value = (total[row] / np.maximum(count[row], 1), most[row], least[row])[pick]
            return np.where(known, sign * np.where(known, value, 0.0), -np.inf)

        links = np.array([link(k) for k in range(n)]).reshape(n, n)
        np.fill_diagonal(links, -np.inf)
        home = np.arange(n)
        while n > 1:
            x, y = divmod(int(np.argmax(links)), n)  # the first of equals; x < y, as links are symmetric
            if not links[x, y] > -np.inf or links[x, y] < sign * threshold:
                break
            for m, add in ((total, np.add), (count, np.add), (most, np.maximum), (least, np.minimum)):
                m[x] = add(m[x], m[y])
                m[:, x] = m[x]
            count[y], count[:, y] = 0, 0
            home[home == y] = x
            links[x] = link(x)
            links[x, x] = -np.inf
            links[:, x] = links[x]
            links[y], links[:, y] = -np.inf, -np.inf
        return pd.DataFrame({target: [pdf[target].iloc[0]] * n if n else [], "item": items, "cluster": [items[k] for k in home]})

    kinds = dict(similarities.dtypes)
    return similarities.groupBy(target).applyInPandas(run, f"{target} {kinds[target]}, item {kinds['i']}, cluster {kinds['i']}")


def linkage_rounds(similarities: DataFrame, target: str, threshold: float, folder: str, linkage: str = "average", above: bool = True) -> DataFrame:
    """What linkage_clusters gives, for targets of any size: all pairs that are each other's best merge at once, round by round, on tables.

    The linkages are reducible (a merged cluster is no nearer to a third than the nearer of the two was), so that mutual best pairs merge in
    any order. Of equal partners the least is best. A round is a grouped best, a join and a grouped sum; its tables lie in folder, which all
    executors must share, and are deleted when the next ones are there. There are about as many rounds as the longest merging chain.
    """
    spark, sign = similarities.sparkSession, 1.0 if above else -1.0
    given = similarities.where("i is not null and j is not null and s is not null").select(target, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("s").cast("double").alias("s"))
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")]
    value = {"average": F.col("total") / F.col("n"), "max": F.col("most"), "min": F.col("least")}[linkage] * sign

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    links = given.select(target, "i", "j", F.col("s").alias("total"), F.lit(1).cast("long").alias("n"), F.col("s").alias("most"), F.col("s").alias("least")).where("i != j")
    links, at = written(links.groupBy(target, "i", "j").agg(*sums), "links")
    items = given.select(target, F.explode(F.array("i", "j")).alias("item")).distinct()
    home, home_at = written(items.withColumn("cluster", F.col("item")), "home")
    while True:
        scored = links.select(target, "i", "j", value.alias("v")).where(F.col("v") >= sign * threshold)
        both = scored.unionByName(scored.select(target, F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        # a cluster's best partner among all, not among those that reach the threshold: the same, where one does
        best = both.groupBy(target, "i").agg(F.min(F.struct((-F.col("v")).alias("v"), "j")).alias("b")).select(target, "i", F.col("b.j").alias("j"))
        mutual = best.join(best.select(target, F.col("i").alias("j"), F.col("j").alias("back")), [target, "j"]).where("back = i and i < j")
        moves, moves_at = written(mutual.select(target, F.col("j").alias("from"), F.col("i").alias("to")), "moves")
        if moves.isEmpty():
            remove_folders(spark, [at, moves_at])
            return home
        for column in ("i", "j"):
            moved = moves.withColumnsRenamed({"from": column, "to": "to_"})
            links = links.join(moved, [target, column], "left").withColumn(column, F.coalesce("to_", column)).drop("to_")
        merged = links.where("i != j").select(target, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "total", "n", "most", "least").groupBy(target, "i", "j").agg(*sums)
        old = [at, home_at, moves_at]
        links, at = written(merged, "links")
        home, home_at = written(home.join(moves.withColumnsRenamed({"from": "cluster", "to": "to_"}), [target, "cluster"], "left").select(target, "item", F.coalesce("to_", "cluster").alias("cluster")), "home")
        remove_folders(spark, old)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cluster_weights(members: DataFrame, keys: list[str], gamma: float = 70.0) -> DataFrame:
    """(keys, cluster, similarity, weight) with the weight exp(gamma * mean similarity of the members)."""
    return members.groupBy(*keys, "cluster").agg(F.avg("similarity").alias("similarity")).withColumn("weight", F.exp(gamma * F.col("similarity")))


def constraint_functions(distances: DataFrame, keys: list[str], cutoff: float, step: float) -> DataFrame:
    """(keys, constraint, num_clusters, variance) from distances(keys, cluster, weight, d).

    If distances has seqsim and seqid, their largest values are added as max_seqsim and max_seqid. A constraint is a sum of unit Gaussians at the distances, on the grid 0, step, ... cutoff; each distance has its
    cluster's share of the weights of the clusters present, divided among the cluster's distances. Distances are cut to thousandths.
    """
    d = F.floor(F.col("d") * 1000) / 1000.0
    rows = distances.withColumn("d", d)
    n = rows.groupBy(*keys, "cluster").agg(F.count("*").alias("n_"), F.first("weight").alias("w_"))
    total = n.groupBy(*keys).agg(F.sum("w_").alias("t_"), F.count("*").alias("num_clusters"))
    rows = rows.join(n, [*keys, "cluster"]).join(total, keys)
    points = int(math.ceil(cutoff / step))
    share = F.col("w_") / F.col("t_") / F.col("n_")
    values = [F.sum(share * F.exp(-0.5 * (F.col("d") - k * step) * (F.col("d") - k * step))).alias(f"c{k}") for k in range(points + 1)]
    out = rows.groupBy(*keys, "num_clusters").agg(*values, F.var_pop("d").alias("variance"), *[F.max(c).alias(f"max_{c}") for c in ("seqsim", "seqid") if c in distances.columns])
    best = [f"max_{c}" for c in ("seqsim", "seqid") if c in distances.columns]
    return out.select(*keys, F.array(*[f"c{k}" for k in range(points + 1)]).alias("constraint"), "num_clusters", "variance", *best)


def constraint_scores(pairs: DataFrame, constraints: DataFrame, keys: list[str], step: float, models: tuple[str, ...] = ()) -> DataFrame:
    """(keys, models, res, score, count, clusters, variance) from pairs(keys, models, i, j, d) with i < j.

    A pair's score is interpolated in its constraint and credited to both ends; a residue's is the mean. models names the
    columns that tell several models of one target apart.
    """
    hit = pairs.join(constraints, [*keys, "i", "j"])
    hit = hit.withColumn("s", interpolated(F.col("constraint"), F.col("d"), step)).withColumn("res", F.explode(F.array("i", "j")))
    return hit.groupBy(*keys, *models, "res").agg(F.avg("s").alias("score"), F.count("s").alias("count"), F.avg("num_clusters").alias("clusters"), F.avg("variance").alias("variance"))


def placed_constraint_scores(points: DataFrame, target: str, residue: str, templates: list[tuple[str, int, float]], model: str, cutoff: float, step: float) -> DataFrame:
    """(target, residue, score, count, clusters, variance): constraint_scores of the model's pairs closer than cutoff, in the constraint_functions of the templates'.

    points(target, residue, ...) have a place (columns <prefix>x, <prefix>y, <prefix>z) in each of templates (prefix, cluster, weight) and in the
    model, a prefix too. Pairs are found by the model's places; their distances in the templates, constraint and score are worked out where they
    are found, and a residue's sums are all that leaves. Templates of a cluster have equal weights.
    """
    last, levels = int(math.ceil(cutoff / step)), int(math.floor(cutoff * 1000)) + 2
    clusters = sorted({c for _, c, _ in templates})
    weight = {c: w for _, c, w in templates}

    def of_patterns(here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each template's share, how many templates, how many clusters) where here (templates, patterns) says which templates have the pair."""
        held = {c: sum(h.astype(np.int64) for h, t in zip(here, templates) if t[1] == c) for c in clusters}
        total = sum(np.where(held[c] > 0, weight[c], 0.0) for c in clusters)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = [np.where(h, t[2] / total / np.maximum(held[t[1]], 1), 0.0) for h, t in zip(here, templates)]
        return np.array(share), here.sum(axis=0), sum((held[c] > 0).astype(float) for c in clusters)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        (li, ri), _ = coded(left["id_"], right["id_"])
        li, ri = li.astype(np.int32), np.where(ri < 0, -2, ri).astype(np.int32)
        missing = (li < 0).any() or (ri < 0).any()
        mine, theirs = (np.array([numbers(t, f"t{k}_{v}") for k in range(len(templates)) for v in "xyz"]) for t in (left, right))
        few = len(templates) <= PATTERNS
        bits = 1 << np.arange(len(templates))
        known = of_patterns((np.arange(1 << len(templates)) & bits[:, None]) > 0) if few else None
        # distances are whole thousandths, so that their exponentials at the places of the grid are a small table
        place, level = np.arange(last + 1, dtype=float)[:, None], np.arange(levels) / 1000
        table = np.exp(-0.5 * (level - place * step) * (level - place * step)).ravel()
        sums = np.zeros((5, len(left)))
        for part, met in blocks(left, right, cutoff):
            for there, d2 in met:
                near = d2 < cutoff * cutoff
                near &= li[part][:, None] != ri[there]
                if missing:
                    near &= (li[part] >= 0)[:, None] & (ri[there] >= 0)
                at = np.flatnonzero(near)
                rows, columns = np.divmod(at.astype(np.int32), there.stop - there.start)
                to = mine[:, part].take(rows, axis=1)
                to -= theirs[:, there].take(columns, axis=1)
                to *= to
                e2 = to[0::3] + to[1::3]
                e2 += to[2::3]
                here = e2 < cutoff * cutoff
                some = np.flatnonzero(here.any(axis=0))
                i, d = rows.take(some) + part.start, np.sqrt(d2.ravel()[at[some]])
                here, e2 = here.take(some, axis=1), e2.take(some, axis=1)
                e2[~here] = 0.0  # places that are missing too
                own = np.floor(np.sqrt(e2) * 1000)
                if few:
                    pattern = bits @ here
                    share, count, present = (x.take(pattern, axis=-1) for x in known)
                else:
                    share, count, present = of_patterns(here)
                near = own / 1000
                off = np.where(here, near - near.sum(axis=0) / count, 0.0)
                whole = np.floor(d / step)
                spot = own.astype(np.int32) + whole.astype(np.int32) * levels
                inside = whole + 1 <= last
                spot *= inside
                low, high = ((share * table.take(x)).sum(axis=0) for x in (spot, spot + levels))
                part_ = d / step - whole
                score = low * (1 - part_) + high * part_
                for n, v in enumerate((np.where(inside, score, 0.0), inside, present, (off * off).sum(axis=0) / count, None)):
                    sums[n] += np.bincount(i, v, minlength=len(left))
        return pa.table({"target_": left["target_"], "id_": left["id_"], "score": sums[0], "count": sums[1].astype(np.int64), "clusters": sums[2], "variance": sums[3], "rows": sums[4].astype(np.int64)})

    kinds = dict(points.dtypes)
    at = [F.col(f"{p}{v}").cast("double").alias(f"t{k}_{v}") for k, (p, _, _) in enumerate(templates) for v in "xyz"]
    placed = points.select(F.col(target).alias("target_"), F.col(residue).alias("id_"), *[F.col(f"{model}{v}").cast("double").alias(v) for v in "xyz"], *at)
    found = tiled(placed, placed, cutoff, kernel, f"target_ {kinds[target]}, id_ {kinds[residue]}, score double, count long, clusters double, variance double, rows long", ["target_"])
    found = found.groupBy(F.col("target_").alias(target), F.col("id_").alias(residue)).agg(*[F.sum(c).alias(c) for c in ("score", "count", "clusters", "variance", "rows")]).where("rows > 0")
    return found.select(target, residue, F.try_divide("score", "count").alias("score"), "count", (F.col("clusters") / F.col("rows")).alias("clusters"), (F.col("variance") / F.col("rows")).alias("variance"))


def constraint_data(pairs: DataFrame, constraints: DataFrame, keys: list[str], cutoff: float, step: float, models: tuple[str, ...] = ()) -> DataFrame:
    """(keys, models, res, disco, counts, avg_num_clusters, avg_variance, avg_max_seqsim, avg_max_seqid, num_constraints, fraction_observed).

    pairs(keys, i, j, d), i < j, are all pairs of a model; those beyond the cutoff count for num_constraints only. constraints
    may have max_seqsim and max_seqid, from the best cluster member of the pair; without them the averages are null.
    """
    hit = pairs.join(constraints, [*keys, "i", "j"])
    near = F.col("d") < cutoff
    s = F.when(near, interpolated(F.col("constraint"), F.col("d"), step))
    rows = hit.withColumn("s_", s).withColumn("near_", near).withColumn("res", F.explode(F.array("i", "j")))
    mean = lambda c: (F.avg(F.when(F.col("near_"), F.col(c))) if c in constraints.columns else F.lit(None).cast("double")).alias(f"avg_{c}")
    out = rows.groupBy(*keys, *models, "res").agg(F.avg("s_").alias("disco"), F.count_if("near_").alias("counts"), *[mean(c) for c in ("num_clusters", "variance", "max_seqsim", "max_seqid")], F.count("*").alias("num_constraints"))
    return out.withColumn("fraction_observed", fraction_observed(F.col("counts"), F.col("num_constraints")))


def fraction_observed(count: Column, constraints: Column) -> Column:
    return F.when(constraints == 0, 0.0).otherwise(count / constraints)


def quantised(values: Column) -> Column:
    """Constraint values as whole numbers of 1/250, raising on what a byte cannot hold."""
    return F.transform(values, lambda v: F.when((v >= 0) & (v * 250 + 0.5 < 256), F.floor(v * 250 + 0.5)).otherwise(F.raise_error(F.lit("constraint value out of range"))).cast("int"))


def dequantised(values: Column) -> Column:
    return F.transform(values, lambda v: v * 0.004)


def aligned_positions(columns: DataFrame, keys: list[str]) -> DataFrame:
    """columns(keys, col, t, s) with the running positions t_pos and s_pos of letters, null at gaps."""
    w = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return columns.select("*", *[F.when(F.col(c) != "-", F.sum((F.col(c) != "-").cast("int")).over(w)).alias(f"{c}_pos") for c in ("t", "s")])


def merged_columns(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, k, t, s) of the pairwise alignments (keys, t, s) of one full sequence t: its letters have k = 0 at their place `at`.

    Letters of s that t has a gap for have k = 1, 2, ... after the place before them, from the left, so that insertions of
    several templates at one place share columns.
    """
    letters = alignments.select(*keys, F.posexplode(F.zip_with(F.split("t", ""), F.split("s", ""), lambda a, b: F.struct(a.alias("t"), b.alias("s")))).alias("col", "p")).select(*keys, "col", "p.t", "p.s")
    w = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    placed = letters.withColumn("at", F.sum((F.col("t") != "-").cast("int")).over(w))
    inserted = Window.partitionBy(*keys, "at").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(*keys, "at", F.sum((F.col("t") == "-").cast("int")).over(inserted).alias("k"), "t", "s")


@dataclass(frozen=True)
class ConstraintOptions:
    """cutoff of distances, gamma of the cluster weights, least average similarity within a cluster, and the grid's step."""

    cutoff: float = 15.0
    gamma: float = 70.0
    similarity: float = 0.5
    step: float = 0.5
    padding: float = 3.0  # past the cutoff, for the last Gaussians to fade out

    def __post_init__(self) -> None:
        if not 0 < self.cutoff <= FARTHEST or self.step <= 0:
            raise ValueError(f"the cutoff must be above 0 and at most {FARTHEST}, the step above 0")


class ConstraintSet:
    """Distance constraints of many targets: (target, i, j, constraint, num_clusters, variance, max_seqsim, max_seqid)."""

    KEYS = ["target", "i", "j"]

    def __init__(self, table: DataFrame, options: ConstraintOptions):
        self.table, self.options = table, options

    @classmethod
    def build(cls, sequences: DataFrame, alignments: DataFrame, positions: DataFrame, substitutions: DataFrame, options: ConstraintOptions | None = None) -> ConstraintSet:
        """From sequences(target, sequence), alignments(target, template, t, s) and positions(target, template, pos, x, y, z).

        t without gaps is the target's sequence, pos the place in it (from 1) of a template's residue. substitutions is (a, b, s).
        Templates of a target are clustered by their average similarity; a cluster weighs by its mean similarity to the target.
        """
        options = options or ConstraintOptions()
        long = F.concat_ws(" ", F.lit(f"a sequence must have no gaps and fewer than {TOO_LONG} letters:"), "target")
        sequences = checked(sequences, F.coalesce((F.length("sequence") < TOO_LONG) & ~F.col("sequence").contains("-"), F.lit(False)), long)
        many = alignments.groupBy("target").agg(F.count("*").alias("templates_"))
        crowd = F.concat_ws(" ", F.lit(f"a target has at most {MOST_TEMPLATES} templates:"), "target")
        alignments = checked(alignments.join(many, "target"), F.col("templates_") <= MOST_TEMPLATES, crowd).drop("templates_")
        known = alignments.join(sequences, "target", "left")
        wrong = F.raise_error(F.lit("an alignment's first sequence must be the target's, without gaps there")).cast("string")
        fits = (F.regexp_replace("t", "-", "") == F.col("sequence")) & ~F.col("sequence").contains("-")
        fitting = known.select("target", "template", F.when(F.coalesce(fits, F.lit(False)), F.col("t")).otherwise(wrong).alias("t"), "s")
        columns = merged_columns(fitting, ["target", "template"])
        to_target = columns.select("target", "template", F.col("t").alias("a"), F.col("s").alias("b"))
        own = column_similarity(to_target, substitutions, ["target", "template"]).withColumnRenamed("similarity", "seqsim")
        own = fitting.select("target", "template").distinct().join(own, ["target", "template"], "left")
        own = own.join(identity(to_target, ["target", "template"]).withColumn("seqid", F.col("identity") / 100).drop("identity"), ["target", "template"], "left").na.fill(0.0, ["seqsim", "seqid"])
        letters = columns.where("s != '-'").select("target", "template", "at", "k", "s")
        i, j = letters.withColumnsRenamed({"template": "i", "s": "a"}), letters.withColumnsRenamed({"template": "j", "s": "b"})
        between = column_similarity(i.join(j, ["target", "at", "k"]).where("i < j"), substitutions, ["target", "i", "j"]).withColumnRenamed("similarity", "s")
        members = linkage_clusters(between, "target", options.similarity).withColumnRenamed("item", "template")
        members = own.join(members, ["target", "template"], "left").withColumn("cluster", F.coalesce("cluster", "template"))
        weights = members.groupBy("target", "cluster").agg(F.avg("seqsim").alias("seqsim"), F.avg("seqid").alias("seqid"))
        weights = members.select("target", "template", "cluster").join(weights.withColumn("weight", F.exp(options.gamma * F.col("seqsim"))), ["target", "cluster"])
        outside = F.raise_error(F.lit("a position is not in the target's sequence")).cast("int")
        inside = F.col("pos").between(1, F.length("sequence"))
        places = positions.join(sequences, "target").withColumn("pos", F.when(inside, F.col("pos")).otherwise(outside)).drop("sequence")
        pairs = self_pairs(places, options.cutoff, "pos", ["target", "template"], ordered=False, strict=True)
        distances = pairs.select(*[F.col(f"l_{c}").alias(c) for c in ("target", "template")], F.col("l_pos").alias("i"), F.col("r_pos").alias("j"), F.sqrt("d2").alias("d")).join(weights, ["target", "template"])
        return cls(constraint_functions(distances, cls.KEYS, options.cutoff + options.padding, options.step), options)

    def at(self, target, i: int, j: int) -> DataFrame:
        """The row of one pair, in either order; no row where there is no constraint."""
        return self.table.where((F.col("target") == target) & (F.col("i") == min(i, j)) & (F.col("j") == max(i, j)))

    def data(self, pairs: DataFrame, models: tuple[str, ...] = ("model",)) -> DataFrame:
        """constraint_data of pairs(target, models, i, j, d), i < j."""
        return constraint_data(pairs, self.table, ["target"], self.options.cutoff, self.options.step, models)

    def save(self, path: str) -> None:
        """Values as whole numbers of 1/250, similarities of 1/100; a value that they cannot hold is an error."""
        bad = F.raise_error(F.lit("a similarity is over 1")).cast("double")
        held = {c: F.when(F.col(c) > 1, bad).otherwise(F.floor(F.col(c) * 100 + 0.5) / 100) for c in ("max_seqsim", "max_seqid")}
        self.table.withColumns({**held, "constraint": quantised(F.col("constraint")).cast("array<smallint>")}).write.mode("overwrite").parquet(f"{path}/constraints")
        self.table.sparkSession.createDataFrame([(json.dumps(asdict(self.options)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConstraintSet:
        options = ConstraintOptions(**json.loads(spark.read.text(f"{path}/options").first()["value"]))
        return cls(spark.read.parquet(f"{path}/constraints").withColumn("constraint", dequantised(F.col("constraint"))), options)
