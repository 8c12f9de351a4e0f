"""Nearest neighbours by vantage-point trees, one a shard.

Vectors are scaled to length one, where the chord length orders pairs as the cosine does and obeys the triangle
inequality. Each vector belongs to the cell of its nearest pivot, and cells are cut into shards of bounded size. A query is
searched in one shard of its own cell first; the distance of its k-th neighbour there then closes every cell that the
inequality, its bound times `factor`, puts out of reach, and within a shard's tree every such subtree. The query's own row
does not count. Factor 1 is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 8192, 64
#: Pivots at most: the only vectors that every task has.
PIVOTS = 256
#: Queries searched and pairs scored at a time; what rounding may add to a cosine and to a chord.
BLOCK, CHUNK, TIE, EPS = 512, 65536, 1e-12, 1e-6


class VantageTree:
    """Over the rows of unit, each of length one."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = rows[len(rows) // 2]
        d = chord(self.unit[rows] @ self.unit[point])
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all():
            return rows
        return point, radius, self._build(rows[inner]), self._build(rows[~inner])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, barred=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows found that score as high as the k-th best of the query, ties with it included.

        barred(active, rows) marks the pairs that take no part, so that they do not bound the search either.
        """
        best, found = np.full((len(queries), k), -np.inf), []  # the k-th best is in column 0

        def reach(active):
            return chord(best[active, 0] - TIE) + EPS

        def visit(node, active):
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                new = queries[active] @ self.unit[node].T
                if barred is not None:
                    new[barred(active, node)] = -np.inf
                best[active] = np.partition(np.hstack([best[active], new]), len(node), axis=1)[:, -k:]
                q, at = np.nonzero((new >= best[active, :1] - TIE) & (new > -np.inf))
                found.append((active[q], node[at], new[q, at]))
                return
            point, radius, inner, outer = node
            d = chord(queries[active] @ self.unit[point])
            near = d <= radius
            visit(inner, active[near])
            visit(outer, active[~near])
            visit(outer, active[near & ((radius - d) * factor <= reach(active))])
            visit(inner, active[~near & ((d - radius) * factor <= reach(active))])

        visit(self.root, np.arange(len(queries)))
        query, row, score = (np.concatenate(x) for x in zip(*found))
        good = score >= best[query, 0] - TIE
        return query[good], row[good]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(cosine, -1.0)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last, so that every engine gets the same bits."""
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def shard_nearest(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k nearest of one shard for each query: at (the query's place), query_id, vec_id, score."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    # of equal vectors, k rows of an id and 2 k rows in all are enough for k neighbours, a query's own id apart
    by = by[place(np.cumsum(np.r_[0, (np.diff(group[by]) != 0) | (np.diff(ids[by]) != 0)])) < k]
    by = by[place(group[by]) < 2 * k]
    starts, counts = np.searchsorted(group[by], np.arange(len(first))), np.bincount(group[by], minlength=len(first))
    low, one_id = ids[by[starts]], ids[by[starts]] == ids[by[starts + counts - 1]]
    unit = vectors[first] / np.linalg.norm(vectors[first], axis=1, keepdims=True)
    tree, parts = VantageTree(unit), []
    for begin in range(0, len(qids), BLOCK):
        own, asked = qids[begin : begin + BLOCK], queries[begin : begin + BLOCK]
        barred = lambda active, rows: one_id[rows] & (low[rows] == own[active][:, None])  # noqa: B023, E731
        q, found = tree.search(asked / np.linalg.norm(asked, axis=1, keepdims=True), k, factor, barred)
        n = counts[found]
        q = np.repeat(q, n)
        member = by[np.repeat(starts[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        other = ids[member] != own[q]
        q, member = q[other], member[other]
        score = np.empty(len(q))
        for c in range(0, len(q), CHUNK):
            score[c : c + CHUNK] = cosines(asked[q[c : c + CHUNK]], vectors[member[c : c + CHUNK]])
        out = pd.DataFrame({"at": begin + q, "query_id": own[q], "vec_id": ids[member], "score": score})
        parts.append(out.sort_values(["at", "score", "vec_id"], ascending=[True, False, True]).groupby("at", sort=False).head(k))
    return pd.concat(parts)


def place(keys: np.ndarray) -> np.ndarray:
    """The place of each of the sorted keys among its equals, from 0."""
    return np.arange(len(keys)) - np.searchsorted(keys, keys)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part: not null, not zero, all components finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))


def near_cells(pivots: dict[int, np.ndarray]):
    """For mapInArrow: rows (..., v, dim) with cell, the number of the nearest pivot (-1 where the dimension has none), and its distance away."""

    def run(batches):
        for b in batches:
            dims, values = b.column("dim").to_numpy(), b.column("v")
            cell, away = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                if (known := pivots.get(int(dim))) is not None:
                    rows = np.flatnonzero(dims == dim)
                    far = chord(_unit(values.take(pa.array(rows)), dim) @ known.T)
                    cell[rows], away[rows] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], [*b.schema.names, "cell", "away"])

    return run


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    v = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def open_cells(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], factor: float):
    """For mapInArrow: (row, query_id, v, dim, kth) to the same with every cell that may hold a neighbour as near as the k-th found (null: none yet)."""

    def run(batches):
        for b in batches:
            dims, values, out, cells = b.column("dim").to_numpy(), b.column("v"), [], []
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(float)
            reach = np.where(np.isnan(kth), np.inf, chord(kth - TIE) + EPS)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                mine = np.array([c for d, c in sorted(radius) if d == dim], np.int64)
                if not len(mine):
                    continue
                far = np.zeros((len(rows), len(mine)))
                if (known := pivots.get(int(dim))) is not None:
                    far = chord(_unit(values.take(pa.array(rows)), dim) @ known[mine].T) - np.array([radius[dim, c] for c in mine])
                q, c = np.nonzero(far * factor <= reach[rows][:, None])
                out.append(rows[q])
                cells.append(mine[c])
            if out:
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.concatenate(out))).columns[:4], pa.array(np.concatenate(cells).astype(np.int32))], [*b.schema.names[:4], "cell"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, most_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of every row of queries, rows of its own id left out.

    Vectors of another length than the query's are not compared with it. Ids should be unique; a repeated id is a vector of
    its own, and a query of its own. Other columns take no part, whatever their names. No vectors or no queries: no rows.
    """
    if factor < 1:
        raise ValueError("factor is at least 1, where the search is exact")
    vecs = stage(usable(vectors, id_col, vector_col), "vectors")
    total = vecs.count()
    wanted = min(most_pivots, math.ceil(total / shard_rows))
    picked: dict[int, list] = {}
    for r in vecs.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(wanted).collect() if wanted > 1 else []:
        picked.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: np.array(v) / np.linalg.norm(v, axis=1, keepdims=True) for d, v in picked.items()}
    placed = "id long, v array<double>, dim int, cell int, away double"
    vecs = stage(vecs.mapInArrow(near_cells(pivots), placed), "placed")
    cells = vecs.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    cells = stage(cells, "cells")
    # pivots bound the cells, one more for each dimension without a pivot
    radius = {(r["dim"], r["cell"]): r["radius"] for r in cells.collect()}
    sub = F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")).cast("int")
    vecs = vecs.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).select("id", "v", "dim", "cell", sub.alias("shard"))
    asks = usable(queries, id_col, vector_col).mapInArrow(near_cells(pivots), placed)
    asks = stage(asks.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("query_id"), "v", "dim", "cell"), "queries")

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        found = shard_nearest(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), ask["query_id"].to_numpy(), np.stack(ask["v"].to_numpy()), k, factor)
        return found.assign(row=ask["row"].to_numpy()[found["at"].to_numpy()])[["row", "query_id", "vec_id", "score"]]

    def search(asked: DataFrame) -> DataFrame:
        """asked(row, query_id, v, dim, cell, shard): queries of a shard come in blocks of bounded size."""
        keys = ["dim", "cell", "shard"]
        blocks = asked.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))
        own = vecs.join(blocks, keys).select(*keys, "id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        ask = asked.join(blocks.withColumnRenamed("blocks", "of"), keys).select(*keys, "row", "query_id", "v", F.pmod(F.xxhash64("row"), F.col("of")).cast("int").alias("block"))
        return own.groupBy(*keys, "block").cogroup(ask.groupBy(*keys, "block")).applyInPandas(run, "row long, query_id long, vec_id long, score double")

    home = asks.join(cells.select("dim", "cell", "shards"), ["dim", "cell"])
    home = stage(home.select("row", "query_id", "v", "dim", "cell", F.pmod(F.xxhash64("row", F.lit(2)), F.col("shards")).cast("int").alias("shard")), "home")
    first = stage(search(home), "first")
    kth = first.groupBy("row").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("kth"))
    rest = asks.join(kth, "row", "left").select("row", "query_id", "v", "dim", "kth").mapInArrow(open_cells(pivots, radius, factor), "row long, query_id long, v array<double>, dim int, cell int")
    rest = rest.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rest = stage(rest.join(home.select("row", "cell", "shard"), ["row", "cell", "shard"], "left_anti").select("row", "query_id", "v", "dim", "cell", "shard"), "open")
    found = first.unionByName(search(rest))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS length FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.length * c.length) AS score
  FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
