"""Membranes of structures: which residues lie in one, at its faces or outside, and the tables that these are scored with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import helical_membranes, membrane_key, structure_class
from .checks import checked
from .spatial import near_any
from .structures import STATE_KEY, residue_id

#: How near a face residues count as interface, and how near a given membrane residue as associated.
FACE_REACH, MEMBER_REACH = 5.0, 5.0


def _ca(backbone: DataFrame) -> DataFrame:
    rows = backbone.select("model", "chain", "rnum", residue_id(F.col("chain"), F.col("rnum")).alias("res"), *[F.col(f"ca{v}").alias(v) for v in "xyz"])
    return rows


def _along(slab: str) -> Column:
    """Of a point and its slab: the place along the slab's normal, from its centre."""
    n = [F.col(f"{slab}.n{v}") for v in "xyz"]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return (F.col("x") * n[0] + F.col("y") * n[1] + F.col("z") * n[2]) / length - F.col(f"{slab}.position")


def sides(backbone: DataFrame, slabs: DataFrame) -> DataFrame:
    """(model, chain, rnum, res, side, in_membrane) of every residue: core, interface or outside, by its CA.

    slabs is (model, nx, ny, nz, position, width): the normal of any length, and the middle's place along it. Within 5 of a face is
    interface; less than a width from both faces is core, and in_membrane in either case. Residues without CA, and models without a slab, are
    outside. A slab without a normal or width is an error, and so are two slabs of one model.
    """
    one = slabs.groupBy("model").agg(F.count("*").alias("n"), F.first(F.struct("nx", "ny", "nz", "position", "width")).alias("slab"))
    square = sum(F.col(f"slab.n{v}") * F.col(f"slab.n{v}") for v in "xyz")
    good = (F.col("n") == 1) & (square > 0) & (F.col("slab.width") > 0) & F.col("slab.position").isNotNull()
    # checked on the residues: a look-up that nothing is selected of would be left out of the plan
    rows = checked(_ca(backbone).join(one, "model", "left"), F.col("n").isNull() | F.coalesce(good, F.lit(False)), F.concat_ws(" ", F.lit("not one slab with a normal and a width:"), "model"))
    along, half = _along("slab"), F.col("slab.width") / 2
    top, bottom = F.abs(along - half), F.abs(along + half)
    inside = F.coalesce((top < F.col("slab.width")) & (bottom < F.col("slab.width")), F.lit(False))
    side = F.when((top < FACE_REACH) | (bottom < FACE_REACH), "interface").when(inside, "core").otherwise("outside")
    return rows.select("model", "chain", "rnum", "res", side.alias("side"), inside.alias("in_membrane"))


def selected_sides(backbone: DataFrame, membrane: DataFrame, interface: DataFrame) -> DataFrame:
    """(model, chain, rnum, res, side, in_membrane) from given residues (model, chain, rnum) of a membrane and of its faces.

    Residues whose CA is within 5 of that of a membrane residue are in_membrane. A residue given as both is an error.
    """
    on = ["model", "chain", "rnum"]
    marks = membrane.select(*on, F.lit("core").alias("side")).distinct().unionByName(interface.select(*on, F.lit("interface").alias("side")).distinct())
    given = marks.groupBy(*on).agg(F.count("*").alias("n_"), F.first("side").alias("side"))
    both = F.concat_ws(" ", F.lit("given as membrane and as interface:"), *[F.col(c).cast("string") for c in on])
    rows = checked(_ca(backbone).join(given, on, "left"), F.coalesce("n_", F.lit(1)) == 1, both)
    rows = rows.withColumn("side", F.coalesce("side", F.lit("outside"))).drop("n_")
    near = near_any(rows, rows.where("side = 'core'"), MEMBER_REACH, "res", ["model"])
    return near.select("model", "chain", "rnum", "res", "side", F.col("near").alias("in_membrane"))


def scoring_states(placed: DataFrame, annotations: DataFrame) -> DataFrame:
    """(model, res, side, in_membrane, structure, table_key): what the residues of sides are scored with.

    annotations is (model, chain, rnum, dssp, pred): a residue in the membrane or at its face is scored by the tables membrane and interface, any
    other by those of its structure class, predicted where there is a prediction. A model with more extended than helical residues in the
    membrane is an error.
    """
    own = annotations.select("model", "chain", "rnum", structure_class(F.col("pred"), F.col("dssp")).alias("structure"), structure_class(F.lit(None).cast("string"), F.col("dssp")).alias("observed_"))
    rows = placed.join(own, ["model", "chain", "rnum"], "left")
    counts = helical_membranes(rows.select("model", "side", F.col("observed_").alias("structure")), ["model"])
    # helix carries the error, so it must be looked at
    right = counts.select("model", F.col("helix").alias("helix_"))
    rows = rows.join(right, "model", "left").where(F.coalesce(F.col("helix_"), F.lit(0)) >= 0)
    return rows.select("model", "res", "side", "in_membrane", "structure", membrane_key(F.col("side"), F.col("structure")).alias(STATE_KEY))


def keyed_energies(tables: dict[str, DataFrame]) -> DataFrame:
    """The energies of several tables as one, with their names as table_key."""
    parts = [t.withColumn(STATE_KEY, F.lit(k)) for k, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
