"""Linear scorers and small networks."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import clamped
from ..functions.scalars import AMINO_ACIDS, clamp01, missing_to_null, one_hot

MIN_ROWS = 100
#: Of this repository's own network files.
#: The first two numbers of a regressor file, and its activations.
MAGIC, VERSION, LINEAR, RELU = 444222, 1, 0, 1


def _subset_sums(rows: DataFrame, by: list[str], features: list[str], target: str) -> tuple[DataFrame, int]:
    """Sums of products of the known values of every row, by the bits of the features that it has, and how many columns they are of.

    Sums are of distances from the columns' means, lest the squares of large values swallow the spread. A feature that a row lacks
    adds nothing to its sums.
    """
    cols = {c: missing_to_null(F.col(c).cast("double")).alias(c) for c in [*features, target]}
    known = rows.select(*by, *cols.values()).where(F.col(target).isNotNull())
    centre = known.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(cols)]).alias("c")).scalar()
    x = [F.lit(1.0), *[F.coalesce(F.col(c) - centre.getField(f"c{k}"), F.lit(0.0)) for k, c in enumerate(cols)]]
    y, x, k = x[-1], x[:-1], len(x) - 1
    has = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(features)), F.lit(0))
    sums = [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(v * y).alias(f"v{i}") for i, v in enumerate(x)]
    centres = [F.first(centre.getField(f"c{i}")).alias(f"c{i}") for i in range(len(cols))]
    return known.groupBy(*by, has.alias("has_")).agg(*centres, F.count("*").alias("n"), *sums), k


def _solved(sums: dict, at: list[int], k: int) -> np.ndarray:
    """Intercept and weights of the features at the given places, from centred sums."""
    spots = [0, *at]
    m = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in spots] for i in spots])
    v = np.array([sums[f"v{i}"] for i in spots])
    centre, top = np.array([sums[f"c{i - 1}"] for i in at]), sums[f"c{k - 1}"]
    shift = np.eye(len(spots))
    shift[1:, 0] = centre
    scales = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    if np.linalg.matrix_rank(m / np.outer(scales, scales)) == len(spots):
        w = np.linalg.solve(m / np.outer(scales, scales), v / scales) / scales
        return np.concatenate([[w[0] + top - centre @ w[1:]], w[1:]])
    # features that depend on each other: the solution of least norm is one of the values as they are
    return np.linalg.lstsq(shift @ m @ shift.T, shift @ (v + top * m[:, 0]), rcond=None)[0]


def _fits(rows: DataFrame, by: list[str], features: list[str], target: str, subsets: list[tuple[int, ...]], min_rows: int) -> DataFrame:
    """(by, subset, n, intercept, weights) for each subset of feature places, of the rows that have all of its features.

    One pass over the rows gives sums by the features that are there; what a subset needs is added up from these few.
    """
    sums, k = _subset_sums(rows, by, features, target)
    masks = F.array(*[F.struct(F.lit(i).alias("subset"), F.lit(sum(1 << p for p in s)).alias("mask_")) for i, s in enumerate(subsets)])
    wide = sums.withColumn("s_", F.explode(masks)).select("*", "s_.*").where(F.col("has_").bitwiseAND(F.col("mask_")) == F.col("mask_"))
    add = [F.sum(c).alias(c) for c in ["n", *[f"m{i}_{j}" for i in range(k) for j in range(i, k)], *[f"v{i}" for i in range(k)]]]
    centres = [F.first(f"c{i}").alias(f"c{i}") for i in range(k)]
    totals = wide.groupBy(*by, "subset").agg(*centres, *add)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at = [p + 1 for p in subsets[r["subset"]]]
                w = _solved(r, at, k) if r["n"] >= min_rows else np.zeros(len(at) + 1)
                out.append({**{b: r[b] for b in by}, "subset": r["subset"], "n": r["n"], "intercept": w[0], "weights": w[1:].tolist()})
            yield pd.DataFrame(out, columns=[*by, "subset", "n", "intercept", "weights"])

    kinds = dict(rows.dtypes)
    return totals.mapInPandas(solve, ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "subset int", "n long", "intercept double", "weights array<double>"]))


def least_squares(rows: DataFrame, by: list[str], features: list[str], target: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """(by, n, intercept, weights) by normal equations: one pass of sums in Spark, a small solve for each group.

    Rows with a missing feature or target are left out; groups of fewer than min_rows rows get zeros. Features that
    depend on each other get the solution of least norm.
    """
    return _fits(rows, by, features, target, [tuple(range(len(features)))], min_rows).drop("subset")


def linear(features: list[Column], intercept: Column, weights: Column) -> Column:
    out = intercept
    for i, f in enumerate(features):
        out = out + f * F.get(weights, F.lit(i))
    return out


def present(features: list[str]) -> Column:
    """The names of the features that are there, with commas between."""
    return F.concat_ws(",", *[F.when(missing_to_null(F.col(c).cast("double")).isNotNull(), F.lit(c)) for c in features])


def subset_scorer(rows: DataFrame, by: list[str], features: list[str], target: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Weights for every non-empty subset of the features: (by, pattern, n, intercept, weights), by one pass over the rows."""
    subsets = [s for k in range(1, len(features) + 1) for s in combinations(range(len(features)), k)]
    names = F.array(*[F.lit(",".join(features[p] for p in s)) for s in subsets])
    return _fits(rows, by, features, target, subsets, min_rows).withColumn("subset", F.get(names, F.col("subset"))).withColumnRenamed("subset", "pattern")


def saved_scorer(scorer: DataFrame, path: str) -> None:
    """Writes the weights of a linear scorer, to be read by loaded_scorer."""
    scorer.write.mode("overwrite").parquet(path)


def loaded_scorer(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A linear scorer's weights; a file that lacks the scorer of all the features is an error."""
    out = spark.read.parquet(path)
    if out.where(F.col("pattern") == ",".join(features)).isEmpty():
        raise ValueError(f"no weights of {', '.join(features)} in {path}")
    return out


def subset_score(rows: DataFrame, scorer: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """rows with score, from the weights of exactly the features each row has; null where there are none."""
    named = rows.withColumn("pattern", present(features)).join(scorer.select(*by, "pattern", "intercept", "weights"), [*by, "pattern"], "left")
    values = F.array_compact(F.array(*[missing_to_null(F.col(c).cast("double")) for c in features]))
    score = F.aggregate(F.zip_with(values, "weights", lambda v, w: v * w), F.col("intercept"), lambda a, v: a + v)
    return named.withColumn("score", score).drop("pattern", "intercept", "weights")


def _unit(inputs: Column, relu: bool):
    """A unit of a layer, from its row of weights (w, b)."""

    def out(row):
        s = F.aggregate(F.zip_with(inputs, row["w"], lambda a, b: a * b), row["b"], lambda a, v: a + v)
        return clamped(s, low=0.0) if relu else s

    return out


@dataclass
class Network:
    """A small regressor: inputs are normalised, layers are (weights, bias, relu)."""

    mean: list[float]
    std: list[float]
    layers: list[tuple[list[list[float]], list[float], bool]] = field(default_factory=list)

    def add_layer(self, weights: list[list[float]], bias: list[float], relu: bool) -> Network:
        width = len(self.layers[-1][1]) if self.layers else len(self.mean)
        if any(len(row) != width for row in weights) or len(weights) != len(bias):
            raise ValueError("a layer's weights must fit the layer before and its bias")
        self.layers.append((weights, bias, relu))
        return self

    def apply(self, inputs: Column) -> Column:
        """The first output for an array column, in built-in functions; null if an input is."""
        z = F.zip_with(F.zip_with(inputs, F.array(*map(F.lit, self.mean)), lambda a, b: a - b), F.array(*map(F.lit, self.std)), lambda a, b: a / b)
        for weights, bias, relu in self.layers:
            table = F.array(*[F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(weights, bias)])
            z = F.transform(table, _unit(z, relu))
        return F.when(~F.exists(inputs, lambda v: v.isNull()), F.get(z, F.lit(0)))

    def predict_batch(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.std)
        for w, b, relu in self.layers:
            z = z @ np.array(w).T + np.array(b)
            z = np.maximum(z, 0) if relu else z
        return z[:, 0]

    def vectorised(self):
        """A pandas UDF over an array column, for networks too wide for expressions."""
        net = self

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            known = x.map(lambda v: v is not None and not any(i is None for i in v))
            out = pd.Series(np.nan, index=x.index)
            if known.any():
                out[known] = net.predict_batch(np.stack(x[known].to_numpy()))
            return out

        return run

    def to_bytes(self) -> bytes:
        """magic, version, number of layers with the inputs, their sizes and activations; then mean, std, every bias, all weights."""
        if not self.layers or len(self.layers[-1][1]) != 1:
            raise ValueError("the last layer must have one output")
        sizes = [len(self.mean), *(len(b) for _, b, _ in self.layers)]
        kinds = [LINEAR, *(RELU if r else LINEAR for *_, r in self.layers)]
        head = [MAGIC, VERSION, len(sizes), *sizes, *kinds]
        body = [*self.mean, *self.std, *(v for _, b, _ in self.layers for v in b), *(v for w, _, _ in self.layers for row in w for v in row)]
        return struct.pack(f"<{len(head)}i", *head) + np.array(body, "<f4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        """The network of such a file; another magic, version or activation, or a file of another length, is an error."""
        if len(data) < 12 or (head := struct.unpack_from("<3i", data))[:2] != (MAGIC, VERSION):
            raise ValueError("not a regressor file of a known version")
        n = head[2]
        if n < 2 or len(data) < 12 + 8 * n:
            raise ValueError("a regressor file needs an input layer and another")
        sizes, kinds = struct.unpack_from(f"<{n}i", data, 12), struct.unpack_from(f"<{n}i", data, 12 + 4 * n)
        if any(k not in (LINEAR, RELU) for k in kinds) or kinds[0] != LINEAR:
            raise ValueError(f"unknown activations {kinds}")
        if min(sizes) < 1 or len(data) != 12 + 8 * n + 4 * (2 * sizes[0] + sum(b + a * b for a, b in zip(sizes, sizes[1:]))):
            raise ValueError("a regressor file's length does not fit its layers")
        values = iter(np.frombuffer(data, "<f4", offset=12 + 8 * n).astype(float).tolist())
        take = lambda k: [next(values) for _ in range(k)]
        net = cls(take(sizes[0]), take(sizes[0]))
        biases = [take(k) for k in sizes[1:]]
        for width, bias, kind in zip(sizes, biases, kinds[1:]):
            net.add_layer([take(width) for _ in bias], bias, kind == RELU)
        return net


class GroupScorer:
    """The network of the first feature group that a row has in full; 0 where there is none or the letter is unknown."""

    def __init__(self, groups: list[list[str]], networks: list[Network], alphabet: str = AMINO_ACIDS):
        if len(groups) != len(networks):
            raise ValueError("each feature group needs a network")
        self.groups, self.networks, self.alphabet = groups, networks, alphabet

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> GroupScorer:
        """feature_groups.json and nn_<i>.dat, through Spark's readers."""
        groups = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/feature_groups.json").collect()))
        return cls(groups, [Network.from_bytes(bytes(spark.read.format("binaryFile").load(f"{folder}/nn_{i}.dat").first()["content"])) for i in range(len(groups))])

    def score(self, letter: Column | None = None) -> Column:
        from .sequences import first_complete

        which, out = first_complete(self.groups), F.lit(0.0)
        for k, (g, net) in enumerate(zip(self.groups, self.networks)):
            x = F.array(*[F.col(c).cast("double") for c in g])
            x = x if letter is None else F.concat(x, one_hot(letter, self.alphabet))
            out = F.when(which == k, net.apply(x)).otherwise(out)
        known = F.lit(True) if letter is None else letter.isin(*self.alphabet)
        return F.when(known, out).otherwise(0.0)


def held(score: Column) -> Column:
    """A local score clamped to [0, 1], 0 where missing."""
    return clamp01(score, 0.0)
