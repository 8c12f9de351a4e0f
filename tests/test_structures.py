"""Real structures end to end: points of every term, the command line, against brute force on 1CRN."""

import json
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.__main__ import main
from latticework.operators import models as M
from latticework.operators import structures as ST
from latticework.operators.constraints import ConstraintOptions, ConstraintSet
from latticework.operators.terms import packing
from latticework.sources import readers as R

FILE = f"{os.path.dirname(os.path.abspath(__file__))}/data/1crn.pdb"


@pytest.fixture(scope="module")
def crambin(spark):
    atoms = R.preprocessed(R.read_pdb(spark, FILE))
    return atoms, R.backbone(atoms)


def test_pair_counts_are_brute_force(crambin):
    points = ST.atom_points(crambin[0])
    term = ST.make_term("interaction", low=0.0, high=10.0, bins=10, separation=4)
    got = {(r["a"], r["b"], r["d"]): r["w"] for r in term.train(points, points).collect()}
    rows = points.select("kind", "rnum", "x", "y", "z").collect()
    want = Counter()
    for a in rows:
        for b in rows:
            d = math.dist(a[2:], b[2:])
            if abs(a["rnum"] - b["rnum"]) >= 4 and d < 10:
                want[a["kind"], b["kind"], int(d)] += 1
    assert got == want


def test_side_chains_are_near_the_given_ones(crambin):
    given = {r["rnum"]: (r["cbx"], r["cby"], r["cbz"]) for r in crambin[1].where("cbx is not null").collect()}
    built = ST.side_chain_points(crambin[1].select(*[F.lit(None).cast("double").alias(c) if c.startswith("cb") else F.col(c) for c in crambin[1].columns]))
    rows = {r["rnum"]: (r["x"], r["y"], r["z"]) for r in built.collect()}
    assert len(rows) == 46 and len(given) == 42 and max(math.dist(rows[k], given[k]) for k in given) < 0.3


def test_hydrogens_and_states(crambin):
    rows = {r["rnum"]: r for r in ST.bonding_points(crambin[1]).collect()}
    assert len(rows) == 46 and not rows[5]["donates"] and rows[6]["donates"]
    assert sum(r["state"] == 1 for r in rows.values()) > 15 and rows[33]["state"] == 2
    for r in rows.values():
        n, h, ca = (np.array([r[f"{a}{v}"] for v in "xyz"]) for a in ("n", "h", "ca"))
        cosine = np.dot(h - n, ca - n) / np.linalg.norm(h - n) / np.linalg.norm(ca - n)
        assert abs(np.linalg.norm(h - n) - 0.997) < 1e-6 and abs(math.acos(cosine) - 2.042) < 1e-6
    # an amide hydrogen points away from the oxygen of the peptide bond
    back = [np.dot(np.array([rows[k][f"h{v}"] - rows[k][f"n{v}"] for v in "xyz"]), np.array([rows[k - 1][f"o{v}"] - rows[k - 1][f"c{v}"] for v in "xyz"])) for k in range(2, 47)]
    assert sum(b < 0 for b in back) == 45


def test_unknown_terms(crambin):
    with pytest.raises(ValueError):
        ST.make_term("other")
    with pytest.raises(ValueError):
        ST.term_points("other", *crambin)


def test_command_line(spark, tmp_path):
    settings = {
        "pairs": {"term": "interaction", "low": 0.0, "high": 10.0, "bins": 10, "separation": 4},
        "packing": {"term": "packing", "cutoff": 5.0, "most": 32},
        "torsion": {"term": "torsion", "rules": [["all", "GLY", "all"], ["all", "all", "all"]], "bins": [1, 1, 9, 9, 1, 1]},
        "hbond": {"term": "hbond", "ranges": {"d": [1.0, 4.0, 3], "alpha": [0.0, 3.15, 2], "beta": [0.0, 3.15, 2], "gamma": [-3.15, 3.15, 2]}, "separation": 2},
    }
    (tmp_path / "terms.json").write_text(json.dumps(settings))
    main(["train", "--structures", FILE, "--terms", str(tmp_path / "terms.json"), "--out", str(tmp_path / "t")], spark)
    main(["score", "--models", FILE, "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "s")], spark)
    local = spark.read.csv(str(tmp_path / "s/local"), header=True, inferSchema=True)
    means = spark.read.parquet(str(tmp_path / "s/averages")).first()
    document = json.loads(spark.read.text(str(tmp_path / "s/documents")).first()["value"])
    assert local.count() == 46 and means["residues"] == 46
    # what was counted is favoured: every energy is below zero on the structure it was made of
    assert all(means[f"avg_{n}"] < 0 for n in ("pairs", "packing", "torsion", "hbond"))
    assert len(document["local_scores"]["A"]) == 46 and abs(document["global_scores"]["avg_pairs"] - means["avg_pairs"]) < 6e-4
    assert {k: len(v) for k, v in document["local_terms"]["A"].items()} == {k: 46 for k in settings}


def test_composed_scores(spark, crambin, tmp_path):
    settings = {"pairs": {"term": "interaction", "low": 0.0, "high": 10.0, "bins": 10, "separation": 4}, "cb": {"term": "cb_packing", "cutoff": 9.0, "most": 20}}
    (tmp_path / "terms.json").write_text(json.dumps(settings))
    main(["train", "--structures", FILE, "--terms", str(tmp_path / "terms.json"), "--out", str(tmp_path / "t")], spark)
    scores = {"two": {"weights": {"pairs": -1.0, "counts": 0.01}, "intercept": 0.1}, "none": {"weights": {"exposed": 1.0}, "intercept": 0.0}}
    (tmp_path / "scores.json").write_text(json.dumps(scores))
    spark.createDataFrame([(n, 0.1 * n, 0.01 * n) for n in (42, 45, 50, 70)], "residues int, pairs double, two double").write.parquet(str(tmp_path / "ref"))
    (tmp_path / "net").mkdir()
    (tmp_path / "net/feature_groups.json").write_text(json.dumps([["counts", "avg_pairs"]]))
    wide = M.Network([0.0] * 22, [1.0] * 22).add_layer([[0.01, -0.1, *[0.0] * 20]], [0.2], False)
    (tmp_path / "net/nn_0.dat").write_bytes(wide.to_bytes())
    main(["score", "--models", FILE, "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "s"), "--features", "counts", "clash", "exposed", "--scores", str(tmp_path / "scores.json"), "--reference", str(tmp_path / "ref"), "--network", str(tmp_path / "net")], spark)
    m = spark.read.parquet(str(tmp_path / "s/averages")).first()
    two = min(1.0, max(0.0, 0.1 - m["avg_pairs"] + 0.01 * m["avg_counts"]))
    ref = np.array([0.01 * n for n in (42, 45, 50)])
    assert abs(m["two"] - two) < 1e-12 and m["none"] is None and m["avg_exposed"] is None
    assert abs(m["two_z_score"] - (two - ref.mean()) / ref.std(ddof=1)) < 1e-9 and m["avg_pairs_z_score"] is not None
    f = spark.read.parquet(str(tmp_path / "s/features")).collect()
    local = {r["rnum"]: min(1.0, max(0.0, 0.2 + 0.01 * r["counts"] - 0.1 * m["avg_pairs"])) for r in f}
    assert abs(m["avg_local_score"] - sum(local.values()) / 46) < 1e-6
    document = json.loads(spark.read.text(str(tmp_path / "s/documents")).first()["value"])
    assert sorted(document["local_terms"]["A"]) == ["cb", "clash", "counts", "exposed", "pairs", "score"]
    assert document["local_scores"]["A"][0] == round(local[1], 3) and max(r["clash"] for r in f) < 10
    # three disulfide bridges are no clashes
    bridges = [r["clash"] for r in f if r["rname"] == "CYS"]
    assert len(bridges) == 6 and max(bridges) < 1


def test_membrane_points_count_as_neighbours(spark):
    atoms = spark.createDataFrame([("m", "A", 1, "ALA", "CA", 1, 0.0), ("m", "A", 1, "ALA", "CB", 2, 1.0), ("m", "M", 9, "MEM", "X", 3, 2.0)], "model string, chain string, rnum int, rname string, aname string, serial int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    points = ST.atom_points(atoms)
    rows = packing(3.0, 5, "kind").rows(points, points).collect()
    assert sorted((r["res"], r["n"]) for r in rows) == [("A:1", 1), ("A:1", 1)]


def test_constraints_from_the_command_line(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps({"pairs": {"term": "interaction", "low": 0.0, "high": 10.0, "bins": 10, "separation": 4}}))
    main(["train", "--structures", FILE, "--terms", str(tmp_path / "terms.json"), "--out", str(tmp_path / "t")], spark)
    rows = [("A", i, j, [0.5] * 37, 1, 0.0, 0.5, 0.5) for i in range(1, 40) for j in range(i + 1, 41)]
    shape = "target string, i int, j int, constraint array<double>, num_clusters int, variance double, max_seqsim double, max_seqid double"
    ConstraintSet(spark.createDataFrame(rows, shape), ConstraintOptions()).save(str(tmp_path / "c"))
    spark.createDataFrame([("1crn", "A", 3, "H", "H", 9, 0.1, "b")], "model string, chain string, rnum int, dssp string, pred string, conf int, area double, acc string").write.parquet(str(tmp_path / "a"))
    main(["score", "--models", FILE, "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "s"), "--features", "dist_const", "exposed", "acc_agreement", "--constraints", str(tmp_path / "c"), "--annotations", str(tmp_path / "a")], spark)
    f = {r["rnum"]: r for r in spark.read.parquet(str(tmp_path / "s/features")).collect()}
    assert all(abs(f[k]["dist_const"] - 0.5) < 1e-9 for k in range(1, 41)) and f[45]["dist_const"] is None
    assert f[3]["exposed"] == 0.1 and f[3]["acc_agreement"] == 1.0 and f[4]["exposed"] is None
    document = json.loads(spark.read.text(str(tmp_path / "s/documents")).first()["value"])
    assert document["preprocessing"]["atoms"] == 327 and document["preprocessing"]["residues_removed"] == 0


def test_the_command_line_refuses(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps({"pairs": {"term": "interaction", "low": 0.0, "high": 10.0, "bins": 10, "separation": 4}}))
    main(["train", "--structures", FILE, "--terms", str(tmp_path / "terms.json"), "--out", str(tmp_path / "t")], spark)
    lines = open(FILE).read().splitlines()
    atoms = [x for x in lines if x.startswith("ATOM")]
    coded = [x[:26] + "B" + x[27:] if int(x[22:26]) == 5 else x for x in atoms]
    twice = [x[:22] + "   4" + x[26:] if int(x[22:26]) == 5 else x for x in atoms]
    for name, text, words in (("coded", coded, "an insertion code: coded A 5 B"), ("twice", twice, "unique and without insertion codes: twice A 4")):
        (tmp_path / f"{name}.pdb").write_text("\n".join(text) + "\n")
        with pytest.raises(Exception, match=words):
            main(["score", "--models", str(tmp_path / f"{name}.pdb"), "--tables", str(tmp_path / "t"), "--out", str(tmp_path / f"o{name}")], spark)
    for k in range(3):
        (tmp_path / f"m{k}.ent").write_text("\n".join(atoms) + "\n")
    with pytest.raises(Exception, match="more than 2 models: 3"):
        main(["score", "--models", str(tmp_path / "m*.ent"), "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--most-models", "2"], spark)
