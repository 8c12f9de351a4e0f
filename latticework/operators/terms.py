"""The seven statistical terms: how each turns structures into keys and bins, shared by training and scoring.

A term gives rows with its key and bin columns and the residue they belong to; Term.train counts them, Term.score looks
them up. Points come as tables with model, chain, rnum, res (unique in the model) and x, y, z.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import add, angle, dihedral, scale, sub, vec, wrap
from ..functions.scalars import bin_of
from .checks import checked
from .environment import Environment, pairs_within, points_of
from .histogram import histogram
from .oriented import Axes, Bonds, cells_of
from .potential import SIGMA, lookup, normalised_by_state, residue_energies, sippl, total_energy
from .spatial import neighbor_counts
from .tiles import Cells, apart_test, bins_of, coded, edges, numbers, pair_counts, tiled


@dataclass(frozen=True)
class Role:
    """A way in which a pair is an interaction: when, and its keys and bins; both from l_ and r_ columns and the squared distance."""

    holds: Callable[[Column], Column]
    columns: Callable[[Column], dict[str, Column]]


@dataclass(frozen=True)
class Term:
    """rows(target, environment) has keys, the bins of sizes, model and res.

    Terms of pairs say how far they reach and which roles a pair has; counted ones take the number of pairs that hold as their only bin,
    held to the size less one, and kind is their key's column.
    """

    keys: tuple[str, ...]
    sizes: dict[str, int]
    rows: Callable[[DataFrame, DataFrame | Environment], DataFrame]
    sums: bool = False  # energies are scaled by state; a residue's is a sum, and 0 without interactions
    reach: float | None = None
    roles: tuple[Role, ...] = ()
    counted: bool = False
    kind: str | None = None
    states: tuple[int, ...] | None = None  # of summed terms: the states that must have counts
    columns: tuple[str, ...] = ()  # of points, that cells needs besides res and x, y, z
    cells: Callable[[pa.Table, pa.Table], Cells] | None = None  # the roles once more, for points that meet in tiles

    def train(self, target: DataFrame, environment: DataFrame | Environment, weight: float = 1.0, extra: tuple[str, ...] = ()) -> DataFrame:
        """Counts; extra names columns of target whose values are counted apart, in one pass over the rows."""
        rows = self._times(target, environment, extra, by_residue=bool(extra))
        return histogram(rows, [*self.keys, *extra], list(self.sizes), F.col("times") * float(weight) if "times" in rows.columns else weight)

    def energies(self, counts: DataFrame, sigma: float = SIGMA, reference_state: str = "classic", extra: tuple[str, ...] = ()) -> DataFrame:
        """Energies of counts, a table of its own for each value of the extra columns."""
        if self.sums:
            if extra:
                raise ValueError("energies that are scaled by state have no further tables")
            return normalised_by_state(counts, self.keys[0], self.sizes, self.states)
        return sippl(counts, list(self.keys), self.sizes, sigma, reference_state, extra)

    def _rows(self, target: DataFrame, environment: DataFrame | Environment, extra: tuple[str, ...]) -> DataFrame:
        rows = self.rows(target, environment)
        return rows.join(target.select("model", "res", *extra).distinct(), ["model", "res"]) if extra else rows

    def _times(self, target: DataFrame, environment: DataFrame | Environment, extra: tuple[str, ...], by_residue: bool = True) -> DataFrame:
        """rows, of terms of pairs counted where they are found: equal ones (of one residue, unless all are counted together) are one row with times."""
        if self.cells is None or isinstance(environment, Environment):
            return self._rows(target, environment, extra)
        needed = ["model", *dict.fromkeys(["x", "y", "z", "res", *self.columns])]
        by = ["model", "res"] if by_residue else []
        kinds = dict(target.dtypes)
        names = [f"{c} {kinds[c]}" for c in by] + [f"{k} {kinds[self.kind if k in ('a', 'b') else k]}" for k in self.keys] + [f"{b} int" for b in self.sizes]
        cells, reach = self.cells, self.reach
        found = tiled(target.select(*needed), environment.select(*needed), reach, lambda left, right: pair_counts(left, right, reach, cells(left, right), by), ", ".join([*names, "times long"]), ["model"])
        found = found.groupBy(*by, *self.keys, *self.sizes).agg(F.sum("times").alias("times"))
        return found.join(target.select("model", "res", *extra).distinct(), ["model", "res"]) if extra else found

    def score(self, target: DataFrame, environment: DataFrame | Environment, energies: DataFrame, extra: tuple[str, ...] = (), normalise: bool = True, counts: bool = False) -> DataFrame:
        """(model, res, energy), with counts also how many interactions a residue has. extra names key columns of target and
        energies besides the term's, as a secondary structure state.

        A residue's rows take its own values of them, so that tables of all states are looked up in one join.
        """
        return self._scored(target, self._times(target, environment, extra), energies, extra, normalise, counts)

    def _scored(self, target: DataFrame, rows: DataFrame, energies: DataFrame, extra: tuple[str, ...], normalise: bool, counts: bool) -> DataFrame:
        scored = lookup(rows, energies, [*self.keys, *extra, *self.sizes], 0.0 if self.sums else None)
        return residue_energies(target, scored, ["model", "res"], normalise and not self.sums, 0.0 if self.sums else None, counts)

    def fitted(self, target: DataFrame, environment: DataFrame | Environment, extra: tuple[str, ...] = (), normalise: bool = True, counts: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, energies, scores) of a target scored with what is counted on itself: one look for interactions serves both.

        rows have times where equal interactions of a residue are one row. They, of which those with a missing key or bin are left out, are persisted on the executors, in memory or on their disks; what is
        lost with one is looked for again. Whoever has used the result may unpersist them.
        """
        columns = [*self.keys, *extra, *self.sizes]
        rows = self._times(target, environment, extra)
        times = [c for c in rows.columns if c == "times"]
        rows = rows.select("model", "res", *columns, *times).dropna().persist()
        energies = self.energies(histogram(rows, [*self.keys, *extra], list(self.sizes), F.col("times").cast("double") if times else 1.0), extra=extra, **options)
        return rows, energies, self._scored(target, rows, energies, extra, normalise, counts)

    def total(self, target: DataFrame, environment: DataFrame | Environment, energies: DataFrame, normalise: bool = True) -> DataFrame:
        """(model, energy): of all interactions their mean, or sum. Summed terms take each pair once, and the mean is over residues."""
        if self.sums:
            each = self.score(target, environment, energies)
            total = F.sum("energy") / 2  # both residues of a pair have its energy
            return each.groupBy("model").agg((total / F.count("*") if normalise else total).alias("energy"))
        scored = lookup(self._times(target, environment, ()), energies, [*self.keys, *self.sizes])
        found = total_energy(scored, ["model"], normalise)
        return target.select("model").distinct().join(found, "model", "left")

    def at(self, rows: DataFrame, energies: DataFrame, values: dict[str, tuple[Column, float, float]], keys: dict[str, list], free: tuple[str, ...] = ()) -> DataFrame:
        """rows with e of given keys and values: values has each bin's (value, low, high).

        A key that is not among the known ones, or a value outside its range, is an error; for the values named in free it gives null, or 0
        for summed terms.
        """
        bins = {n: bin_of(v, low, high, self.sizes[n]) for n, (v, low, high) in values.items()}
        right = F.lit(True)
        for name, known in keys.items():
            right &= F.coalesce(F.col(name).isin(*known), F.lit(False))
        for name, b in bins.items():
            if name not in free:
                right &= b.isNotNull()
        shown = F.concat_ws(", ", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in keys], *[F.coalesce(v.cast("string"), F.lit("null")) for v, _, _ in values.values()])
        found = checked(rows, right, F.concat(F.lit("no energy of "), shown)).withColumns(bins)
        return lookup(found, energies, [*self.keys, *self.sizes], 0.0 if self.sums else None).drop(*bins)

    def keyed(self, tables: dict[str, DataFrame], name: str) -> DataFrame:
        """Energies of several tables as one, with their names in a column."""
        parts = [t.withColumn(name, F.lit(k)) for k, t in tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _check(low: float, high: float, *counts: int) -> None:
    if not low < high or min(counts) < 1:
        raise ValueError("a range needs low < high and at least one bin")


def apart(separation: int) -> Column:
    """Of a pair: in different chains, or so many numbers apart."""
    return (F.col("l_chain") != F.col("r_chain")) | (F.abs(F.col("l_rnum") - F.col("r_rnum")) >= separation)


def _of_pairs(keys: tuple[str, ...], sizes: dict[str, int], reach: float, roles: tuple[Role, ...], **options) -> Term:
    def rows(target, around):
        pairs, d2 = pairs_within(target, around, reach), F.col("d2")
        names = [F.col("l_model").alias("model"), F.col("l_res").alias("res")]
        if len(roles) == 1:
            return pairs.where(roles[0].holds(d2)).select(*names, *[c.alias(n) for n, c in roles[0].columns(d2).items()])
        each = [F.when(r.holds(d2), F.struct(*[c.alias(n) for n, c in r.columns(d2).items()])) for r in roles]
        return pairs.select(*names, F.explode(F.array(*each)).alias("i_")).where("i_ is not null").select("model", "res", *[F.col(f"i_.{n}").alias(n) for n in (*keys, *sizes)])

    return Term(keys, sizes, rows, reach=reach, roles=roles, **options)


def pair_distance(low: float, high: float, bins: int, separation: int, kind: str) -> Term:
    """All-atom (kind is the atom type) and side-chain (kind is the residue type) distance terms."""
    _check(low, high, bins)

    def holds(d2):
        return (F.col("l_res") != F.col("r_res")) & (d2 >= low * low) & (d2 < high * high) & apart(separation)

    def columns(d2):
        return {"a": F.col(f"l_{kind}"), "b": F.col(f"r_{kind}"), "d": bin_of(F.sqrt(d2), low, high, bins)}

    def cells(left, right):
        (a, b), kinds = coded(left[kind], right[kind])
        found = Cells({"a": left[kind]}, {"b": kinds}, {"d": bins}, [])
        held = _held(left, right, separation, low, high)

        def role(i, j, d2):
            i, j, d2 = held(i, j, d2)
            return i, found.cell([b[j], bins_of(np.sqrt(d2), low, high, bins)])

        found.roles.append(role)
        found.plain = b, _distance_edges(low, high, bins), _held_by_slices(left, right, separation)
        return found

    return _of_pairs(("a", "b"), {"d": bins}, high, (Role(holds, columns),), kind=kind, columns=("chain", "rnum", kind), cells=cells)


def reduced(low: float, high: float, bins: int, angle_bins: int, dihedral_bins: int, separation: int) -> Term:
    """Distance and orientation of two residues: points with an axis (ax, ay, az) and the residue type aa."""
    _check(low, high, bins, angle_bins, dihedral_bins)

    def holds(d2):
        return (F.col("l_res") != F.col("r_res")) & (d2 >= low * low) & (d2 < high * high) & apart(separation)

    def columns(d2):
        p, q, u, v = vec("l_"), vec("r_"), vec("l_a"), vec("r_a")
        to = sub(q, p)
        top = math.pi + 1e-9
        angles = {"alpha": bin_of(angle(u, to), 0.0, top, angle_bins), "beta": bin_of(angle(v, scale(to, F.lit(-1.0))), 0.0, top, angle_bins)}
        gamma = dihedral(add(p, u), p, q, add(q, v))
        return {"a": F.col("l_aa"), "b": F.col("r_aa"), "d": bin_of(F.sqrt(d2), low, high, bins), **angles, "gamma": bin_of(gamma, -math.pi, top, dihedral_bins)}

    sizes = {"d": bins, "alpha": angle_bins, "beta": angle_bins, "gamma": dihedral_bins}

    def cells(left, right):
        (a, b), kinds = coded(left["aa"], right["aa"])
        found = Cells({"a": left["aa"]}, {"b": kinds}, sizes, [])
        held, top = _held(left, right, separation, low, high), math.pi + 1e-9
        p, u, q, v = (_places(t, c) for t, c in ((left, ""), (left, "a"), (right, ""), (right, "a")))

        def role(i, j, d2):
            i, j, d2 = held(i, j, d2)
            pi, ui, qj, vj = p[:, i], u[:, i], q[:, j], v[:, j]
            to = qj - pi
            alpha, beta = bins_of(_angle(ui, to), 0.0, top, angle_bins), bins_of(_angle(vj, -to), 0.0, top, angle_bins)
            gamma = bins_of(_dihedral(pi + ui, pi, qj, qj + vj), -math.pi, top, dihedral_bins)
            return i, found.cell([b[j], bins_of(np.sqrt(d2), low, high, bins), alpha, beta, gamma])

        axes, by_slices, steps_ = Axes(p, u, q, v), _held_by_slices(left, right, separation), _distance_edges(low, high, bins)

        def whole(part, there, d2):
            numbers_, missing, unsure = axes.bins(part, there, d2, (0.0, top, angle_bins), (-math.pi, top, dihedral_bins))
            holds = by_slices(part, there) & (d2 >= steps_[0]) & (d2 < steps_[-1])
            near = np.zeros(d2.shape, np.int8 if bins < 128 else np.int32)
            for e in steps_[1:-1]:
                near += d2 >= e
            cell = cells_of([near, *numbers_], list(sizes.values()), b[there])
            if missing is not None:
                cell[missing] = found.count
            if (b[there] < 0).any():
                cell[:, b[there] < 0] = found.count
            np.copyto(cell, np.int32(found.count + 1), where=~holds)
            unsure &= holds
            return cell, unsure

        found.roles.append(role)
        if max(angle_bins, dihedral_bins) < 100:
            found.whole = [whole]
        return found

    return _of_pairs(("a", "b"), sizes, high, (Role(holds, columns),), kind="aa", columns=("chain", "rnum", "aa", "ax", "ay", "az"), cells=cells)


def _held(left: pa.Table, right: pa.Table, separation: int, low: float = 0.0, high: float = math.inf) -> Callable:
    """Of pairs (i, j, d2) those of two residues that are far enough apart in sequence and whose distance is in [low, high)."""
    (lr, rr), _ = coded(left["res"], right["res"])
    apart_ = apart_test(left, right, "chain", "rnum", separation)

    def held(i, j, d2):
        keep = (lr[i] != rr[j]) & (lr[i] >= 0) & (rr[j] >= 0) & (d2 >= low * low) & (d2 < high * high)
        if apart_ is not None:
            keep &= apart_(i, j)
        return (i, j, d2) if keep.all() else (i[keep], j[keep], d2[keep])

    return held


@lru_cache(maxsize=None)
def _distance_edges(low: float, high: float, bins: int) -> np.ndarray:
    def bins_and_beyond(d2):
        return np.where((d2 >= high * high) | (np.sqrt(d2) >= high), bins, np.where(d2 < low * low, -1, bins_of(np.sqrt(d2), low, high, bins)))

    return edges(bins_and_beyond, bins, high)


def _held_by_slices(left: pa.Table, right: pa.Table, separation: int) -> Callable:
    """Of rows against rows: whether they are of two residues far enough apart in sequence."""
    (lr, rr), _ = coded(left["res"], right["res"])
    lr, rr = lr.astype(np.int32), np.where(rr < 0, -2, rr).astype(np.int32)
    apart_, missing = apart_test(left, right, "chain", "rnum", separation), (lr < 0).any() or (rr < 0).any()

    def held(i, j):
        out = lr[i][:, None] != rr[j]
        if missing:
            out &= (lr[i] >= 0)[:, None] & (rr[j] >= 0)
        if apart_ is not None:
            out &= apart_(i, j)
        return out

    return held


def _places(points: pa.Table, prefix: str) -> np.ndarray:
    return np.array([numbers(points, prefix + v) for v in "xyz"])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: np.ndarray, b: np.ndarray) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """functions.geometry.angle, NaN for null."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip(_dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b))), -1.0, 1.0))


def _dihedral(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """functions.geometry.dihedral, NaN for null."""
    u, v, w = b - a, c - b, d - c
    n1, n2 = _cross(u, v), _cross(v, w)
    return np.arctan2(np.sqrt(_dot(v, v)) * _dot(u, n2), _dot(n1, n2))


def packing(cutoff: float, most: int, kind: str) -> Term:
    """How many points of other residues lie within cutoff, clamped; no neighbours is a count of its own.

    Environment points of residue MEM (column rname, where there is one) stand for a membrane: they count like others, but
    as targets they have no kind and are left out.
    """
    _check(0, cutoff, most)

    def holds(d2):
        return (F.col("l_res") != F.col("r_res")) & (d2 <= cutoff * cutoff)

    def rows(target, around):
        # an atom and a residue are the same row here: id is unique in the model
        pairs = pairs_within(target, around, cutoff).where(holds(F.col("d2")))
        n = pairs.groupBy(F.col("l_model").alias("model"), F.col("l_id").alias("id")).agg(F.count("*").alias("c"))
        out = target.where(F.col(kind).isNotNull()).join(n, ["model", "id"], "left")
        return out.select("model", "res", F.col(kind).alias("a"), F.least(F.coalesce("c", F.lit(0)), F.lit(most)).cast("int").alias("n"))

    return Term(("a",), {"n": most + 1}, rows, reach=cutoff, roles=(Role(holds, lambda d2: {}),), counted=True, kind=kind)


def torsion(rules: list[tuple[str, str, str]], bins: tuple[int, ...], names: list[str] | None = None) -> Term:
    """Backbone angles of three residues in a row, by the first rule that fits their names.

    A rule has three entries, each `all` or names with commas between. residues need aa3, phi and psi; all three residues
    must follow each other and have both angles. Angles are held within [-pi, pi]. With names, rules that leave one of their
    triplets without a group are an error.
    """
    if len(bins) != 6:
        raise ValueError("six bin counts are needed: phi and psi of three residues")
    if names is not None and (gap := uncovered(rules, names)):
        raise ValueError(f"no rule covers {', '.join(gap)}")
    most = math.pi - 0.0001

    def rows(target, around):
        w = Window.partitionBy("model", "chain").orderBy("rnum")
        out = points_of(around).select("*", *[f.over(w).alias(n) for n, f in (("p_aa3", F.lag("aa3")), ("n_aa3", F.lead("aa3")), ("p_phi", F.lag("phi")), ("p_psi", F.lag("psi")), ("n_phi", F.lead("phi")), ("n_psi", F.lead("psi")))])
        names = [F.col("p_aa3"), F.col("aa3"), F.col("n_aa3")]
        group = first_rule(names, rules)
        values = ["p_phi", "p_psi", "phi", "psi", "n_phi", "n_psi"]
        whole = F.lit(True)
        for v in values:
            whole = whole & F.col(v).isNotNull()
        held = [bin_of(F.greatest(F.lit(-most), F.least(F.lit(most), F.col(v))), -math.pi, math.pi, n).alias(f"b{i}") for i, (v, n) in enumerate(zip(values, bins))]
        out = out.where(whole).select("model", "res", group.alias("g"), *held)
        return out.join(target.select("model", "res"), ["model", "res"], "left_semi")

    return Term(("g",), {f"b{i}": n for i, n in enumerate(bins)}, rows)


def uncovered(rules: list[tuple[str, ...]], names: list[str]) -> tuple[str, ...] | None:
    """The first triplet of names that no rule fits, or None."""
    entries = [[None if e == "all" else {x.strip() for x in e.split(",")} for e in r] for r in rules]
    return next((t for t in product(names, repeat=3) if not any(all(e is None or n in e for n, e in zip(t, r)) for r in entries)), None)


def triplets_by_rule(names: DataFrame, rules: list[tuple[str, ...]], required: bool = True) -> DataFrame:
    """(p_aa3, aa3, n_aa3, g) of every three of names(aa3), a small table: g is the number of the first rule that fits.

    Rules are rows joined by what they name; with required, a triplet that no rule fits is an error.
    """
    spark = names.sparkSession
    rows = [(k, *[None if e == "all" else [x.strip() for x in e.split(",")] for e in r]) for k, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "g int, r1 array<string>, r2 array<string>, r3 array<string>")
    every = names.select("aa3").distinct().agg(F.sort_array(F.collect_list("aa3")).alias("all"))
    three = every.select(F.explode("all").alias("p_aa3"), "all").select("p_aa3", F.explode("all").alias("aa3"), "all").select("p_aa3", "aa3", F.explode("all").alias("n_aa3"))
    fits = F.lit(True)
    for name, rule in (("p_aa3", "r1"), ("aa3", "r2"), ("n_aa3", "r3")):
        fits &= F.col(rule).isNull() | F.array_contains(rule, F.col(name))
    found = three.join(F.broadcast(table), fits, "left").groupBy("p_aa3", "aa3", "n_aa3").agg(F.min("g").alias("g"))
    return checked(found, F.col("g").isNotNull(), F.concat_ws(" ", F.lit("no rule covers"), "p_aa3", "aa3", "n_aa3")) if required else found


def triplet_energies(rows: DataFrame, triplets: DataFrame, energies: DataFrame, bins: tuple[int, ...], angles: list[str]) -> DataFrame:
    """rows(p_aa3, aa3, n_aa3, six angle columns) with g and e of a torsion table by the three residues' names.

    Names that triplets lacks, and groups that the table lacks, have null; angles are wrapped, and a missing one gives null.
    """
    return angle_energies(rows.join(triplets, ["p_aa3", "aa3", "n_aa3"], "left"), energies, bins, angles)


def angle_energies(rows: DataFrame, energies: DataFrame, bins: tuple[int, ...], angles: list[str]) -> DataFrame:
    """rows(g, six angle columns) with e of a torsion table; angles of any turn are wrapped, an unknown group has null."""
    cells = {f"b{i}": bin_of(wrap(F.col(a)), -math.pi, math.pi, n) for i, (a, n) in enumerate(zip(angles, bins, strict=True))}
    return lookup(rows.withColumns(cells), energies, ["g", *cells]).drop(*cells)


def first_rule(names: list, rules: list[tuple[str, ...]]):
    """The number of the first rule whose entries all fit, else null; `all` fits anything."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        fits = F.lit(True)
        for n, entry in zip(names, rules[k]):
            if entry != "all":
                fits = fits & n.isin(*[x.strip() for x in entry.split(",")])
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def hbond(ranges: dict[str, tuple[float, float, int]], separation: int, reach: float = 9.0, states: tuple[int, ...] | None = None) -> Term:
    """Donor and acceptor geometry between residues, by the state that both have, or 0 where their states differ.

    ranges has (low, high, bins) for d, alpha, beta and gamma. Points are residues with state, donates, and the positions n,
    h (donor) and o, c, ca; a bond is looked for between residues whose ca are within reach. Each of the states, if given, must have counts.
    """
    for low, high, n in ranges.values():
        _check(low, high, n)

    def role(donor: str, acceptor: str) -> Role:
        def holds(d2):
            return (F.col("l_res") != F.col("r_res")) & (d2 <= reach * reach) & apart(separation) & F.col(f"{donor}_donates")

        def columns(d2):
            h, n, o, c, ca = *(vec(f"{donor}_{k}") for k in ("h", "n")), *(vec(f"{acceptor}_{k}") for k in ("o", "c", "ca"))
            ho = sub(o, h)
            geometry = {"d": F.sqrt(sum(x * x for x in ho)), "alpha": angle(sub(n, h), ho), "beta": angle(sub(c, o), sub(h, o)), "gamma": dihedral(ca, c, o, h)}
            state = F.when(F.col("l_state") == F.col("r_state"), F.col("l_state")).otherwise(F.lit(0))
            return {"state": state, **{k: bin_of(v, *ranges[k]) for k, v in geometry.items()}}

        return Role(holds, columns)

    sizes = {k: v[2] for k, v in ranges.items()}
    atoms = ("h", "n", "o", "c", "ca")

    def cells(left, right):
        kind = left["state"].type
        (ls, rs, zero), states_ = coded(left["state"], right["state"], pa.chunked_array([pa.array([0]).cast(kind)]))
        found = Cells({}, {"state": states_}, sizes, [])
        held = _held(left, right, separation)
        sides = [({a: _places(t, a) for a in atoms}, t["donates"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)) for t in (left, right)]

        def role(first: bool):
            def of_pairs(i, j, d2):
                (donor, donates), acceptor = (sides[0], sides[1][0]) if first else (sides[1], sides[0][0])
                keep = donates[i if first else j]
                i, j, _ = held(i[keep], j[keep], d2[keep])
                p, q = (i, j) if first else (j, i)
                h, n, o, c, ca = donor["h"][:, p], donor["n"][:, p], acceptor["o"][:, q], acceptor["c"][:, q], acceptor["ca"][:, q]
                ho = o - h
                geometry = {"d": np.sqrt(_dot(ho, ho)), "alpha": _angle(n - h, ho), "beta": _angle(c - o, h - o), "gamma": _dihedral(ca, c, o, h)}
                state = np.where((ls[i] == rs[j]) & (ls[i] >= 0), ls[i], zero[0])
                return i, found.cell([state, *[bins_of(geometry[k], *ranges[k]) for k in sizes]])

            return of_pairs

        by_slices = _held_by_slices(left, right, separation)
        mine, theirs = np.where(ls < 0, -2, ls).astype(np.int32), rs.astype(np.int32)
        ahead = (theirs - np.int32(zero[0])) * np.int32(math.prod(sizes.values()))  # cells from those of state 0 to those of a right point's state

        def whole(first: bool):
            (donor, donates), acceptor = (sides[0], sides[1][0]) if first else (sides[1], sides[0][0])
            bonds = Bonds(*[donor[a] for a in ("h", "n")], *[acceptor[a] for a in ("o", "c", "ca")])

            def block(part, there, d2):
                numbers_, missing, unsure = bonds.bins(part if first else there, there if first else part, ranges, first)
                holds = d2 <= reach * reach
                holds &= by_slices(part, there)
                holds &= donates[part][:, None] if first else donates[there]
                cell = cells_of(numbers_, list(sizes.values()), zero[0])
                cell += (mine[part][:, None] == theirs[there]) * ahead[there]
                if missing is not None:
                    cell[missing] = found.count
                np.copyto(cell, np.int32(found.count + 1), where=~holds)
                unsure &= holds
                return cell, unsure

            return block

        found.roles += [role(True), role(False)]
        if max(sizes.values()) < 100:
            found.whole = [whole(True), whole(False)]
        return found

    # each pair is an interaction twice, with either end as the donor
    needed = ("chain", "rnum", "state", "donates", *[f"{a}{v}" for a in atoms for v in "xyz"])
    return _of_pairs(("state",), sizes, reach, (role("l", "r"), role("r", "l")), sums=True, states=states, columns=needed, cells=cells)


def smoothed_states(residues: DataFrame, state: str = "state") -> DataFrame:
    """A state stays where a neighbour in the chain has it too, and is 0 elsewhere."""
    w = Window.partitionBy("model", "chain").orderBy("rnum")
    shared = F.coalesce((F.lag(state).over(w) == F.col(state)), F.lit(False)) | F.coalesce((F.lead(state).over(w) == F.col(state)), F.lit(False))
    return residues.withColumn(state, F.when(shared, F.col(state)).otherwise(F.lit(0)))


def residue_counts(residues: DataFrame, radius: float = 15.0) -> DataFrame:
    """(model, res, n): other residues' points within radius."""
    return neighbor_counts(residues, residues, radius, "res", ["model"])
