"""Chemical types of protein atoms."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Atoms that every residue has, and the side-chain atoms of each.
BACKBONE = "N CA C O"
SIDE_CHAINS = {
    "ALA": "CB",
    "ARG": "CB CG CD NE CZ NH1 NH2",
    "ASN": "CB CG OD1 ND2",
    "ASP": "CB CG OD1 OD2",
    "CYS": "CB SG",
    "GLN": "CB CG CD OE1 NE2",
    "GLU": "CB CG CD OE1 OE2",
    "GLY": "",
    "HIS": "CB CG ND1 CD2 CE1 NE2",
    "ILE": "CB CG1 CG2 CD1",
    "LEU": "CB CG CD1 CD2",
    "LYS": "CB CG CD CE NZ",
    "MET": "CB CG SD CE",
    "PHE": "CB CG CD1 CD2 CE1 CE2 CZ",
    "PRO": "CB CG CD",
    "SER": "CB OG",
    "THR": "CB OG1 CG2",
    "TRP": "CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2",
    "TYR": "CB CG CD1 CD2 CE1 CE2 CZ OH",
    "VAL": "CB CG1 CG2",
}
#: Atoms that stand for another atom's type.
SAME_TYPE = {
    "ARG NE1": "ARG NE",
    "ARG NH2": "ARG NH1",
    "ASP OD2": "ASP OD1",
    "GLU OE2": "GLU OE1",
    "ILE CD": "GLN CD",
    "LEU CD2": "LEU CD1",
    "PHE CD2": "PHE CD1",
    "PHE CE2": "PHE CE1",
    "TYR CD2": "TYR CD1",
    "TYR CE2": "TYR CE1",
    "VAL CG2": "VAL CG1",
}


@cache
def atom_types() -> dict[str, int]:
    """The type number of every known `residue atom`; equivalent atoms share one."""
    names = [f"{r} {a}" for r, side in SIDE_CHAINS.items() for a in f"{BACKBONE} {side}".split()]
    numbers = {n: k for k, n in enumerate(n for n in names if n not in SAME_TYPE)}
    return numbers | {n: numbers[same] for n, same in SAME_TYPE.items()}


def atom_type(rname: Column, aname: Column) -> Column:
    """An atom's type number, null where the residue or the atom is unknown."""
    known = F.create_map(*[F.lit(x) for pair in atom_types().items() for x in pair])
    return known[F.concat_ws(" ", rname, aname)]
