"""Membranes from structures, and the tables that residues are scored with."""

import json
import os

import pytest
from pyspark.sql import functions as F

from latticework.__main__ import main
from latticework.operators import membrane as MB
from latticework.operators import structures as ST
from latticework.sources import readers as R

FILE = f"{os.path.dirname(os.path.abspath(__file__))}/data/1crn.pdb"


@pytest.fixture(scope="module")
def crambin(spark):
    atoms = R.preprocessed(R.read_pdb(spark, FILE))
    return atoms, R.backbone(atoms)


def slab(spark, *rows):
    return spark.createDataFrame(rows, "model string, nx double, ny double, nz double, position double, width double")


def test_sides_by_planes(spark, crambin):
    _, backbone = crambin
    got = {r["rnum"]: r for r in MB.sides(backbone, slab(spark, ("1crn", 0.0, 0.0, 3.0, 6.0, 12.0))).collect()}
    for r in backbone.collect():
        z = r["caz"] - 6.0
        top, bottom = abs(z - 6), abs(z + 6)
        want = "interface" if min(top, bottom) < 5 else "core" if max(top, bottom) < 12 else "outside"
        assert got[r["rnum"]]["side"] == want and got[r["rnum"]]["in_membrane"] == (max(top, bottom) < 12)
    assert {r["side"] for r in got.values()} >= {"interface", "core"}
    assert {r["side"] for r in MB.sides(backbone, slab(spark, ("other", 0.0, 0.0, 1.0, 0.0, 5.0))).collect()} == {"outside"}
    for bad in ([("1crn", 0.0, 0.0, 0.0, 6.0, 12.0)], [("1crn", 0.0, 0.0, 1.0, 6.0, 0.0)], [("1crn", 0.0, 0.0, 1.0, 6.0, 5.0)] * 2):
        with pytest.raises(Exception, match="not one slab"):
            MB.sides(backbone, slab(spark, *bad)).select("res").collect()


def test_sides_by_selection(spark, crambin):
    _, backbone = crambin
    pick = lambda *n: spark.createDataFrame([("1crn", "A", k) for k in n], "model string, chain string, rnum int")
    got = {r["rnum"]: r for r in MB.selected_sides(backbone, pick(10, 11), pick(12)).collect()}
    assert [got[k]["side"] for k in (9, 10, 11, 12)] == ["outside", "core", "core", "interface"]
    assert all(got[k]["in_membrane"] for k in (9, 10, 11, 12)) and not got[30]["in_membrane"]
    with pytest.raises(Exception, match="as membrane and as interface: 1crn A 10"):
        MB.selected_sides(backbone, pick(10), pick(10)).select("res").collect()


def test_residues_are_scored_by_their_own_table(spark, crambin):
    atoms, backbone = crambin
    placed = MB.sides(backbone, slab(spark, ("1crn", 0.0, 0.0, 1.0, 6.0, 12.0)))
    notes = backbone.select("model", "chain", "rnum", F.when(F.col("rnum") % 3 == 0, "E").otherwise("H").alias("dssp"), F.when(F.col("rnum") % 5 == 0, "C").alias("pred"))
    states = MB.scoring_states(placed, notes).cache()
    assert {r["table_key"] for r in states.collect()} >= {"membrane", "interface"}
    settings = {"interaction": {"low": 0.0, "high": 8.0, "bins": 4, "separation": 3}, "cb_packing": {"cutoff": 9.0, "most": 20}, "torsion": {"rules": [["all", "all", "all"]], "bins": [1, 1, 3, 3, 1, 1]}}
    terms = {n: (n, ST.make_term(n, **o)) for n, o in settings.items()}
    plain, keyed = {}, {}
    for n, (_, t) in terms.items():
        p = ST.term_points(n, atoms, backbone)
        plain[n] = t.energies(t.train(p, p)).cache()
        factor = {"membrane": 1.0, "interface": 2.0, "helix": 3.0, "extended": 4.0}  # no table for coil
        keyed[n] = MB.keyed_energies({k: plain[n].withColumn("e", F.col("e") * f) for k, f in factor.items()})
    one = {r["res"]: r for r in ST.structure_features(atoms, backbone, terms, plain).collect()}
    many = {r["res"]: r for r in ST.structure_features(atoms, backbone, terms, keyed, states=states).collect()}
    key = {r["res"]: r["table_key"] for r in states.collect()}
    for res, k in key.items():
        for n in terms:
            want = one[res][n] * factor[k] if k in factor and one[res][n] is not None else None
            assert many[res][n] == (None if want is None else pytest.approx(want)), (res, k, n)
    with pytest.raises(ValueError, match="states are needed"):
        ST.structure_features(atoms, backbone, terms, keyed)


def test_extended_membranes_are_refused(spark, crambin):
    _, backbone = crambin
    placed = MB.sides(backbone, slab(spark, ("1crn", 0.0, 0.0, 1.0, 6.0, 12.0)))
    notes = backbone.select("model", "chain", "rnum", F.lit("E").alias("dssp"), F.lit(None).cast("string").alias("pred"))
    with pytest.raises(Exception, match="only helical membrane proteins"):
        MB.scoring_states(placed, notes).select("res").collect()


def test_tables_by_state_from_the_command_line(spark, crambin, tmp_path):
    atoms, backbone = crambin
    settings = {"pairs": {"term": "interaction", "low": 0.0, "high": 10.0, "bins": 5, "separation": 4}, "packing": {"term": "packing", "cutoff": 5.0, "most": 32}}
    (tmp_path / "terms.json").write_text(json.dumps(settings))
    none = F.lit(None)
    notes = backbone.select("model", "chain", "rnum", F.when(F.col("rnum") % 4 == 0, "E").otherwise("H").alias("dssp"), none.cast("string").alias("pred"), none.cast("int").alias("conf"), none.cast("double").alias("area"), none.cast("string").alias("acc"))
    notes.write.parquet(f"{tmp_path}/notes")
    slab(spark, ("1crn", 0.0, 0.0, 1.0, 6.0, 12.0)).write.parquet(f"{tmp_path}/slabs")
    more = ["--annotations", f"{tmp_path}/notes", "--slabs", f"{tmp_path}/slabs"]
    main(["train", "--structures", FILE, "--terms", f"{tmp_path}/terms.json", "--out", f"{tmp_path}/t", *more], spark)
    main(["score", "--models", FILE, "--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/s", *more], spark)
    states = MB.scoring_states(MB.sides(backbone, spark.read.parquet(f"{tmp_path}/slabs")), spark.read.parquet(f"{tmp_path}/notes"))
    term, points = ST.make_term("interaction", low=0.0, high=10.0, bins=5, separation=4), ST.atom_points(atoms)
    own, extra = points.join(states.select("model", "res", "table_key"), ["model", "res"]), ("table_key",)
    want = {r["res"]: r["energy"] for r in term.score(own, points, term.energies(term.train(own, points, extra=extra), extra=extra), extra).collect()}
    got = {f"A:{r['rnum']}": r for r in spark.read.parquet(f"{tmp_path}/s/features").collect()}
    assert len(got) == 46 and all(got[k]["pairs"] == pytest.approx(v) for k, v in want.items()) and all(r["packing"] is not None for r in got.values())
    with pytest.raises(ValueError, match="states are needed"):
        main(["score", "--models", FILE, "--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/x"], spark)
