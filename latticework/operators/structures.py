"""From atom tables to the points, angles and states that the statistical terms take."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atom_types import atom_type
from ..functions.geometry import add, box_state, dihedral, distance2, place_atom, rebuilt_cb, sub, unit, vec
from .chains import agreement, exposure, structure_class
from .features import feature_table
from .sequences import match_score
from .spatial import CLASH_APART, CLASH_REACH, clash_penalty
from .stream import Part, atom_stream, constraint_value, residue_stream
from .terms import Term, apart, hbond, packing, pair_distance, reduced, smoothed_states, torsion

#: Bond and angle of an amide hydrogen, and the angles that residues at chain ends are given.
H_BOND, H_ANGLE, END_PHI, END_PSI = 0.9970, 2.0420, -1.0472, -0.78540
#: Fixed values: (phi, psi) boxes of helices, state 1, and sheets, state 2.
STATE_BOXES = [
    (-math.pi, -0.34907, -math.pi / 2, -0.17453, 1),
    (-math.pi, -0.34907, 0.34907, math.pi, 2),
    (-math.pi, -0.34907, -math.pi, -2.9671, 2),
]


def residue_id(chain: Column, rnum: Column) -> Column:
    return F.concat_ws(":", chain, rnum.cast("string"))


def _here(rows: DataFrame) -> list[Column]:
    return [F.col("model"), F.col("chain"), F.col("rnum"), residue_id(F.col("chain"), F.col("rnum")).alias("res")]


def atom_points(atoms: DataFrame) -> DataFrame:
    """(model, chain, rnum, res, rname, id, kind, x, y, z) of atoms of known type, and of membrane points, which have none."""
    rows = atoms.select(*_here(atoms), "rname", F.col("serial").alias("id"), atom_type(F.col("rname"), F.col("aname")).alias("kind"), "x", "y", "z")
    return rows.where("kind is not null or rname = 'MEM'")


def side_chain_points(backbone: DataFrame) -> DataFrame:
    """One point a residue: its CB, or where that is missing the place that the backbone gives it; id is res, kind is aa."""
    cb = [F.coalesce(F.col(f"cb{v}"), p) for v, p in zip("xyz", rebuilt_cb(vec("n"), vec("ca"), vec("c")))]
    rows = backbone.select(*_here(backbone), F.col("aa").alias("kind"), *[p.alias(v) for p, v in zip(cb, "xyz")])
    return rows.withColumn("id", F.col("res")).where("x is not null and kind is not null")


def oriented_points(backbone: DataFrame) -> DataFrame:
    """CA points with the axis away from N and C, for the reduced term."""
    axis = add(unit(sub(vec("ca"), vec("n"))), unit(sub(vec("ca"), vec("c"))))
    rows = backbone.select(*_here(backbone), "aa", *[F.col(f"ca{v}").alias(v) for v in "xyz"], *[p.alias(f"a{v}") for p, v in zip(axis, "xyz")])
    return rows.where("ax is not null and aa is not null")


def backbone_angles(backbone: DataFrame) -> DataFrame:
    """Residues with aa3, phi and psi; an angle is null where the next residue's number does not follow or an atom is missing."""
    w = Window.partitionBy("model", "chain").orderBy("rnum")
    near = backbone.select("*", F.lag("rnum").over(w).alias("p_rnum"), F.lead("rnum").over(w).alias("n_rnum"), *[F.lag(f"c{v}").over(w).alias(f"p_c{v}") for v in "xyz"], *[F.lead(f"n{v}").over(w).alias(f"n_n{v}") for v in "xyz"])
    phi = F.when(F.col("p_rnum") + 1 == F.col("rnum"), dihedral(vec("p_c"), vec("n"), vec("ca"), vec("c")))
    psi = F.when(F.col("rnum") + 1 == F.col("n_rnum"), dihedral(vec("n"), vec("ca"), vec("c"), vec("n_n")))
    return near.select(*_here(near), F.col("rname").alias("aa3"), phi.alias("phi"), psi.alias("psi"), *[f"{a}{v}" for a in ("n", "ca", "c", "o") for v in "xyz"])


def bonding_points(backbone: DataFrame) -> DataFrame:
    """Residues with state, donates and the places of n, h, o, c, ca, for the hydrogen-bond term; x, y, z is ca."""
    rows = backbone_angles(backbone)
    phi, psi = F.coalesce("phi", F.lit(END_PHI)), F.coalesce("psi", F.lit(END_PSI))
    h = place_atom(H_BOND, H_ANGLE, phi + math.pi, vec("c"), vec("ca"), vec("n"))
    rows = rows.withColumn("state", box_state(phi, psi, STATE_BOXES)).withColumn("donates", F.col("aa3") != "PRO")
    rows = rows.select("*", *[p.alias(f"h{v}") for p, v in zip(h, "xyz")], *[F.col(f"ca{v}").alias(v) for v in "xyz"])
    return smoothed_states(rows.where("nx is not null and cax is not null and cx is not null and ox is not null"))


#: Of each term: the points it takes (of atoms or of the backbone) and how it is made.
TERMS = {
    "interaction": (atom_points, lambda low, high, bins, separation: pair_distance(low, high, bins, separation, "kind")),
    "cbeta": (side_chain_points, lambda low, high, bins, separation: pair_distance(low, high, bins, separation, "kind")),
    "reduced": (oriented_points, reduced),
    "packing": (atom_points, lambda cutoff, most: packing(cutoff, most, "kind")),
    "cb_packing": (side_chain_points, lambda cutoff, most: packing(cutoff, most, "kind")),
    "torsion": (backbone_angles, torsion),
    "hbond": (bonding_points, lambda ranges, separation, reach=9.0, states=(0, 1, 2): hbond(ranges, separation, reach, states)),
}


def term_points(name: str, atoms: DataFrame, backbone: DataFrame) -> DataFrame:
    """The rows that the named term takes."""
    if name not in TERMS:
        raise ValueError(f"unknown term {name!r}: {', '.join(TERMS)} are known")
    make = TERMS[name][0]
    return make(atoms if make is atom_points else backbone)


def make_term(name: str, **options) -> Term:
    if name not in TERMS:
        raise ValueError(f"unknown term {name!r}: {', '.join(TERMS)} are known")
    return TERMS[name][1](**options)


#: Features that need no energies: of pairs, of constraints, and of annotations.
FEATURES = ("counts", "clash", "dist_const", "exposed", "fraction_loops", "ss_agreement", "acc_agreement")
COUNT_REACH = 15.0


@dataclass(frozen=True)
class Constraints:
    """Distance constraints of chains: rows (chain, i, j, constraint), the step of their values and the cutoff of distances."""

    rows: DataFrame
    step: float = 0.5
    cutoff: float = 15.0


def disulfide_contact() -> Column:
    """Of pairs of atoms with l_ and r_ names: contacts within a disulfide bridge, which are no clashes."""

    def bridge(p, q):
        return (F.col(f"{p}_aname") == "SG") & ((F.col(f"{q}_aname") == "SG") | ((F.col(f"{q}_rname") == "CYS") & (F.col(f"{q}_aname") == "CB")))

    return bridge("l", "r") | bridge("r", "l")


def annotated(name: str, backbone: DataFrame, annotations: DataFrame | None, tables: tuple[DataFrame, DataFrame, DataFrame] | None) -> DataFrame:
    """(model, res, energy) of a feature of annotations; without what it needs, it is null.

    annotations is (model, chain, rnum, dssp, pred, conf, area, acc): the observed state, the predicted one and its confidence, the
    accessible share of the surface and the predicted b or e. tables are the probabilities that chains.agreement takes.
    """
    if annotations is None or (name == "ss_agreement" and tables is None):
        return backbone.select("model", residue_id(F.col("chain"), F.col("rnum")).alias("res"), F.lit(None).cast("double").alias("energy"))
    rows = annotations.withColumn("res", residue_id(F.col("chain"), F.col("rnum")))
    if name == "ss_agreement":
        return agreement(rows, *tables).select("model", "res", F.col("agreement").alias("energy"))
    value = {
        "exposed": F.col("area").cast("double"),
        "fraction_loops": (structure_class(F.lit(None).cast("string"), F.col("dssp")) == "coil").cast("double"),
        "acc_agreement": match_score(F.col("acc"), exposure(F.col("area")), ["b", "e"]),
    }
    return rows.select("model", "res", value[name].alias("energy"))


def stream_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms for atom_stream: kind is null for those of unknown type, point tells those that packing counts."""
    kind = atom_type(F.col("rname"), F.col("aname"))
    rows = atoms.select(*_here(atoms), "rname", "aname", "element", F.col("serial").alias("id"), kind.alias("kind"), "x", "y", "z")
    return rows.withColumn("point", F.col("kind").isNotNull() | (F.col("rname") == "MEM"))


def stream_residues(backbone: DataFrame, bonds: bool) -> DataFrame:
    """Residues for residue_stream: met by CA, or by CB where that is missing; with axis, CB, and what bonds need."""
    axis = add(unit(sub(vec("ca"), vec("n"))), unit(sub(vec("ca"), vec("c"))))
    cb = [F.coalesce(F.col(f"cb{v}"), p) for v, p in zip("xyz", rebuilt_cb(vec("n"), vec("ca"), vec("c")))]
    rows = backbone.select(*_here(backbone), "aa", F.col("aa").alias("kind"), *[p.alias(f"cb{v}") for p, v in zip(cb, "xyz")], *[p.alias(f"a{v}") for p, v in zip(axis, "xyz")], F.col("cax").isNotNull().alias("has_ca"), *[F.coalesce(f"ca{v}", p).alias(v) for p, v in zip(cb, "xyz")])
    rows = rows.withColumn("id", F.col("res"))
    if not bonds:
        return rows
    own = bonding_points(backbone).select("model", "res", "state", "donates", *[f"{a}{v}" for a in ("n", "h", "o", "c", "ca") for v in "xyz"])
    return rows.join(own, ["model", "res"], "left")


#: The column of energies that are tables of several states, and of the states that residues have.
STATE_KEY = "table_key"


def _part(kind: str, term: Term, energies: DataFrame) -> Part:
    """How a term of pairs takes part in the stream of atoms or of residues."""
    part = _plain_part(kind, term, energies)
    return replace(part, extra=(STATE_KEY,)) if STATE_KEY in energies.columns else part


def _plain_part(kind: str, term: Term, energies: DataFrame) -> Part:
    d2, both = F.col("d2"), lambda c: F.col(f"l_{c}").isNotNull() & F.col(f"r_{c}").isNotNull()
    between_cb = distance2(vec("l_cb"), vec("r_cb"))
    known = F.col("kind").isNotNull()
    if kind == "interaction":
        return Part(term, energies, known, both("kind"), d2)
    if kind == "packing":
        return Part(term, energies, known, F.col("l_kind").isNotNull() & F.col("r_point"), d2, "kind")
    if kind == "cbeta":
        return Part(term, energies, known, both("kind"), between_cb)
    if kind == "cb_packing":
        return Part(term, energies, known & F.col("cbx").isNotNull(), both("kind"), between_cb, "kind")
    if kind == "reduced":
        return Part(term, energies, F.col("ax").isNotNull(), both("ax") & both("aa"), d2)
    return Part(term, energies, F.col("state").isNotNull(), both("state"), d2)


OF_ATOMS, OF_RESIDUES = ("interaction", "packing"), ("cbeta", "cb_packing", "reduced", "hbond")


def structure_features(atoms: DataFrame, backbone: DataFrame, terms: dict[str, tuple[str, Term]], energies: dict[str, DataFrame], names: tuple[str, ...] = (), annotations: DataFrame | None = None, tables: tuple[DataFrame, DataFrame, DataFrame] | None = None, constraints: Constraints | None = None, states: DataFrame | None = None) -> DataFrame:
    """(model, chain, rnum, rname, aa, res, ...): a column for each term, scored with its energies, and for each of the named FEATURES.

    terms has the kind and the term of each name. All terms of atoms and the clashes come from one radius join, all terms of residues, counts and
    distance constraints from another; torsions need none. Without constraints dist_const is null.
    Energies with a column table_key are several tables in one: a residue is scored by that of its own key in states(model, res, table_key), as its
    structure class or its place in a membrane; a residue without a key, or with one that has no table, has null.
    """
    keyed = [n for n in terms if STATE_KEY in energies[n].columns]
    if keyed and states is None:
        raise ValueError(f"the energies of {', '.join(keyed)} have several tables: states are needed")
    with_key = (lambda rows: rows.join(states.select("model", "res", STATE_KEY), ["model", "res"], "left")) if keyed else (lambda rows: rows)
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown feature {unknown[0]!r}: {', '.join(FEATURES)} are known")
    residues = backbone.select("model", "chain", "rnum", "rname", "aa", residue_id(F.col("chain"), F.col("rnum")).alias("res"))
    wanted, out = [*terms, *names], residues
    atom_parts = {n: _part(k, t, energies[n]) for n, (k, t) in terms.items() if k in OF_ATOMS}
    residue_parts = {n: _part(k, t, energies[n]) for n, (k, t) in terms.items() if k in OF_RESIDUES}
    if atom_parts or "clash" in names:
        apart_enough = (F.col("l_id") != F.col("r_id")) & apart(CLASH_APART) & ~disulfide_contact() & (F.col("d2") <= CLASH_REACH**2)
        clash = {"clash": F.when(apart_enough, clash_penalty("element", F.col("d2")))} if "clash" in names else {}
        rows = with_key(stream_atoms(atoms))
        found = atom_stream(rows, rows, atom_parts, CLASH_REACH if clash else 0.0, sums=clash)
        out = out.join(found.select("model", "res", *[n for n in wanted if n in atom_parts or n in clash]), ["model", "res"], "left")
    bound = constraints is not None and "dist_const" in names
    if residue_parts or "counts" in names or bound:
        rows = with_key(stream_residues(backbone, any(k == "hbond" for k, _ in terms.values())))
        placed = F.col("l_has_ca") & F.col("r_has_ca") & (F.col("l_res") != F.col("r_res"))
        more = {"counts": {"counts": F.coalesce(placed & (F.col("d2") <= COUNT_REACH**2), F.lit(False))}} if "counts" in names else {}
        far = [COUNT_REACH] * bool(more)
        if bound:
            more |= {"constraints": constraints.rows.select("chain", "i", "j", "constraint"), "means": {"dist_const": F.when(placed, constraint_value(constraints.step, constraints.cutoff, F.col("d2")))}}
            far.append(constraints.cutoff)
        found = residue_stream(rows, residue_parts, max(far, default=0.0), **more)
        found = found.select("model", "res", *[n for n in wanted if n in residue_parts or (n == "counts" and more) or (n == "dist_const" and bound)])
        out = out.join(found, ["model", "res"], "left")
        if "counts" in names:
            out = out.join(backbone.select("model", residue_id(F.col("chain"), F.col("rnum")).alias("res"), F.col("cax").isNotNull().alias("has_ca_")), ["model", "res"]).withColumn("counts", F.when(F.col("has_ca_"), F.col("counts").cast("double"))).drop("has_ca_")
    others = {}
    for name in wanted:
        if name in out.columns:
            continue
        if name in terms:
            points = term_points(terms[name][0], atoms, backbone)
            own = (STATE_KEY,) if name in keyed else ()
            others[name] = terms[name][1].score(with_key(points) if own else points, points, energies[name], own)
        elif name == "dist_const":
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            others[name] = annotated(name, backbone, annotations, tables)
    return feature_table(out, others, ["model", "res"]).select(*residues.columns, *wanted)
