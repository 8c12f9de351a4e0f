"""Radius joins over 3-D points by grid cells, and what is built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance2, vec
from .tiles import apart_test, coded, numbers, row_sums, steps, tiled


def cell(v: Column, width: Column) -> Column:
    return F.floor(v / width).cast("long")


def _reach(radius: float | str, side: str) -> Column:
    return F.col(f"{side}_{radius}") if isinstance(radius, str) else F.lit(radius)


def cells_around(targets: DataFrame, width: float | str) -> DataFrame:
    """targets with the prefix l_, once for each of the 27 cells around them, as l_cell_x, l_cell_y, l_cell_z."""
    out = targets.select(*[F.col(c).alias(f"l_{c}") for c in targets.columns]).withColumn("s_", steps())
    return out.select("*", *[(cell(F.col(f"l_{v}"), _reach(width, "l")) + F.col(f"s_.{s}")).alias(f"l_cell_{v}") for v, s in zip("xyz", "abc")]).drop("s_")


def radius_join(left: DataFrame, right: DataFrame, radius: float | str, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Pairs of points at most radius apart, within equal keys; columns get the prefixes l_ and r_, and d2 is added.

    Both sides have x, y, z. The grid's cells are one radius wide, so a left point meets the 27 cells around it; the
    join is an equi-join on cell and keys with the exact distance as its residual condition. Null coordinates match
    nothing. With strict, pairs at exactly radius are left out. A radius that is a name is a column of both sides, with one value in all
    rows of equal keys.
    """
    a = cells_around(left, radius)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.select("*", *[cell(F.col(f"r_{v}"), _reach(radius, "r")).alias(f"r_cell_{v}") for v in "xyz"])
    d2, reach = distance2(vec("l_"), vec("r_")), _reach(radius, "l")
    on = [F.col(f"l_cell_{v}") == F.col(f"r_cell_{v}") for v in "xyz"] + [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys or []]
    near = d2 < reach * reach if strict else d2 <= reach * reach
    out = a.join(b, [*on, near])
    return out.withColumn("d2", d2).drop(*[f"{p}_cell_{v}" for p in "lr" for v in "xyz"])


def self_pairs(points: DataFrame, radius: float, id_col: str, keys: list[str] | None = None, ordered: bool = True, strict: bool = False) -> DataFrame:
    """radius_join of points with themselves: both orders of each pair, or one of them."""
    other = F.col(f"l_{id_col}") != F.col(f"r_{id_col}") if ordered else F.col(f"l_{id_col}") < F.col(f"r_{id_col}")
    return radius_join(points, points, radius, keys, strict).where(other)


def apart_in_sequence(pairs: DataFrame, chain: str, number: str, separation: int) -> DataFrame:
    """Without pairs of one chain whose numbers differ by less than separation."""
    return pairs.where((F.col(f"l_{chain}") != F.col(f"r_{chain}")) | (F.abs(F.col(f"l_{number}") - F.col(f"r_{number}")) >= separation))


def counts_within(targets: DataFrame, around: DataFrame, radii: dict[str, float], id_col: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, names of radii): others within each radius of each target, zero included, in one look at what is near."""
    on, reach = [*(keys or []), id_col], max(radii.values())

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        (li, ri), _ = coded(left[id_col], right[id_col])
        known = (li >= 0)[:, None], ri >= 0

        def counted(i, j, d2):
            other = (li[i][:, None] != ri[j]) & known[0][i] & known[1][j]
            return np.array([((d2 <= r * r) & other).sum(axis=1) for r in radii.values()]).T

        sums = row_sums(left, right, reach, counted, len(radii))
        return pa.table({c: left[c] for c in on} | {n: sums[:, k].astype(np.int64) for k, n in enumerate(radii)})

    kinds = dict(targets.dtypes)
    needed = list(dict.fromkeys([*on, *"xyz"]))
    parts = tiled(targets.select(*needed), around.select(*needed), reach, kernel, ", ".join([*[f"{c} {kinds[c]}" for c in on], *[f"{n} long" for n in radii]]), keys)
    found = parts.groupBy(*on).agg(*[F.sum(n).alias(n) for n in radii]).where(" or ".join(f"`{n}` > 0" for n in radii))
    return targets.select(*on).join(found, on, "left").select(*on, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in radii])


def neighbor_counts(targets: DataFrame, around: DataFrame, radius: float, id_col: str, keys: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(keys, id, n): others within radius of each target, zero included, clamped to most."""
    found = counts_within(targets, around, {"n": radius}, id_col, keys)
    return found if most is None else found.withColumn("n", F.least("n", F.lit(most)).cast("long"))


def near_any(targets: DataFrame, others: DataFrame, radius: float, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """targets with the flag near: some point of others within radius."""
    on = [*(keys or []), id_col]
    hit = radius_join(targets, others, radius, keys).select(*[F.col(f"l_{c}").alias(c) for c in on]).distinct().withColumn("near", F.lit(True))
    return targets.join(hit, on, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def kernel_smooth(points: DataFrame, values: list[str], sigma: float, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """Gaussian-weighted means of values over all points within 3 sigma, the point itself included.

    Missing values are left out and the weights of the others rescaled; a point without a value of its own stays without.
    All value columns are smoothed in one pass over the pairs, which are summed where they are found.
    """
    on = [*(keys or []), id_col]
    reach, each = 3 * sigma, range(len(values))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.array([numbers(right, v) for v in values]).T
        known = ~np.isnan(own)
        columns = np.hstack([np.where(known, own, 0.0), known])

        def weighed(part, there, d2):
            far = d2 > reach * reach
            d2 /= -2 * sigma * sigma
            w = np.exp(d2, out=d2)
            w[far] = 0.0
            return w @ columns[there]

        sums = row_sums(left, right, reach, weighed, columns.shape[1])
        return pa.table({c: left[c] for c in on} | {f"{n}{k}": sums[:, k + p * len(values)] for p, n in enumerate("sw") for k in each})

    kinds = dict(points.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in on] + [f"{n}{k} double" for n in "sw" for k in each])
    rows = points.select(*on, *"xyz", *values)
    parts = tiled(points.select(*dict.fromkeys([*on, *"xyz"])), rows.select(*dict.fromkeys(rows.columns)), reach, kernel, schema, keys)
    smooth = parts.groupBy(*on).agg(*[F.try_divide(F.sum(f"s{k}"), F.sum(f"w{k}")).alias(f"s_{v}") for k, v in zip(each, values)])
    own = {v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in values}
    return points.join(smooth, on, "left").select(*on, *[F.when(own[v].isNotNull(), F.col(f"s_{v}")).alias(v) for v in values])


#: Contact radii by element, and the two slopes of the clash function.
RADII = {"C": 1.6, "N": 1.3, "O": 1.3, "S": 1.7}
CLASH_REACH, CLASH_FULL, CLASH_MOST, CLASH_SLOPE = 3.2, 0.8254, 10.0, 57.273
#: Numbers that atoms of one chain must be apart.
CLASH_APART = 2


def clash_penalty(element: str, d2: Column) -> Column:
    """The penalty of a pair with l_ and r_ elements at the square root of d2; 0 where an element has no radius."""
    contact = sum(F.coalesce(*[F.when(F.col(f"{p}_{element}") == e, r) for e, r in RADII.items()]) for p in "lr")
    d = F.sqrt(d2)
    return F.when(d < CLASH_FULL * contact, CLASH_MOST).when(d <= contact, CLASH_SLOPE * (1 - d / contact)).otherwise(0.0)


def clash_scores(atoms: DataFrame, id_col: str, element: str, residue: str, chain: str, number: str, separation: int = CLASH_APART, disulfide: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, residue, clash): penalties of close atom pairs, summed over each residue's atoms, 0 where there are none."""
    on = [*(keys or []), residue]
    if disulfide is not None:
        pairs = apart_in_sequence(self_pairs(atoms, CLASH_REACH, id_col, keys), chain, number, separation).where(~disulfide)
        found = pairs.groupBy(*[F.col(f"l_{c}").alias(c) for c in on]).agg(F.sum(clash_penalty(element, F.col("d2"))).alias("s"))
    else:
        found = _clashes(atoms, id_col, element, on, chain, number, separation, keys).groupBy(*on).agg(F.sum("s").alias("s"))
    return atoms.select(*on).distinct().join(found, on, "left").select(*on, F.coalesce("s", F.lit(0.0)).alias("clash"))


def _clashes(atoms: DataFrame, id_col: str, element: str, on: list[str], chain: str, number: str, separation: int, keys: list[str] | None) -> DataFrame:
    """(on, s) of atoms: penalties of their pairs, summed where the atoms meet."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        (li, ri), _ = coded(left[id_col], right[id_col])
        li, ri = li.astype(np.int32), ri.astype(np.int32)
        nameless = (li < 0).any() or (ri < 0).any()
        lr, rr = (np.array([RADII.get(e, np.nan) for e in t[element].to_pylist()], float) for t in (left, right))
        apart = apart_test(left, right, chain, number, separation)

        def penalties(part, there, d2):
            contact = np.add.outer(lr[part], rr[there])
            score = np.sqrt(d2)
            full, part_of = score < CLASH_FULL * contact, score <= contact
            score /= contact
            np.subtract(1, score, out=score)
            score *= CLASH_SLOPE
            score = np.where(full, CLASH_MOST, np.where(part_of, score, 0.0))
            score *= (d2 <= CLASH_REACH * CLASH_REACH) & (li[part][:, None] != ri[there])
            if nameless:
                score *= (li[part] >= 0)[:, None] & (ri[there] >= 0)
            if apart is not None:
                score *= apart(part, there)
            return score.sum(axis=1)[:, None]

        return pa.table({c: left[c] for c in on} | {"s": row_sums(left, right, CLASH_REACH, penalties, 1)[:, 0]})

    kinds = dict(atoms.dtypes)
    needed = atoms.select(*dict.fromkeys([*on, *"xyz", id_col, element, chain, number]))
    return tiled(needed, needed, CLASH_REACH, kernel, ", ".join([*[f"{c} {kinds[c]}" for c in on], "s double"]), keys)


#: Thresholds of the distance-preservation similarity.
PRESERVED = (0.5, 1.0, 2.0, 4.0)


def distance_similarity(reference: DataFrame, model: DataFrame, radius: float, id_col: str, keys: list[str] | None = None, thresholds=PRESERVED) -> DataFrame:
    """(keys, similarity): mean over thresholds of the share of reference pairs whose distance the model preserves.

    Pairs that the model lacks count as not preserved.
    """
    keys = keys or []
    pairs = self_pairs(reference, radius, id_col, keys, ordered=False, strict=True)
    pairs = pairs.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col(f"l_{id_col}").alias("i_"), F.col(f"r_{id_col}").alias("j_"), F.sqrt("d2").alias("d_"))

    def side(n):
        return model.select(*keys, F.col(id_col).alias(f"{n}_"), *[F.col(v).alias(f"{n}{v}") for v in "xyz"])

    both = pairs.join(side("i"), [*keys, "i_"], "left").join(side("j"), [*keys, "j_"], "left")
    off = F.abs(F.col("d_") - F.sqrt(distance2(vec("i"), vec("j"))))
    kept = sum(F.count_if(F.coalesce(off < t, F.lit(False))) for t in thresholds)
    return both.groupBy(*keys).agg((kept / (F.count("*") * float(len(thresholds)))).alias("similarity"))


def plane_class(points: DataFrame, normal: tuple[float, float, float], position: float, width: float, reach: float = 5.0) -> DataFrame:
    """points with side: interface near either plane of a slab, core inside it, outside elsewhere."""
    n = tuple(map(F.lit, normal))
    along = F.col("x") * n[0] + F.col("y") * n[1] + F.col("z") * n[2] - position
    top, bottom = F.abs(along - width / 2), F.abs(along + width / 2)
    return points.withColumn("side", F.when((top < reach) | (bottom < reach), "interface").when((top < width) & (bottom < width), "core").otherwise("outside"))
