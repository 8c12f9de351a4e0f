"""Clustering in rounds, limits of constraint sets, agreement tables, settings."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import chains as CH
from latticework.operators import constraints as C
from latticework.operators import raw_model as RM
from latticework.settings import MembraneSettings, Settings


def agglomerated(items, pairs, threshold, combine):
    clusters = [[k] for k in items]
    while True:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                v = [pairs[min(i, j), max(i, j)] for i in clusters[a] for j in clusters[b] if (min(i, j), max(i, j)) in pairs]
                if v and combine(v) >= threshold and (best is None or combine(v) > best[0] + 1e-12):
                    best = (combine(v), a, b)
        if best is None:
            return {i: min(c) for c in clusters for i in c}
        _, a, b = best
        clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("linkage,combine,least", [("average", lambda v: sum(v) / len(v), 0.55), ("max", max, 0.93), ("min", min, 0.3)])
def test_rounds_are_brute_force(spark, tmp_path, linkage, combine, least):
    r = random.Random(len(linkage))
    rows, want = [], {}
    for t in range(3):
        items = list(range(14))
        pairs = {(i, j): r.random() for i in items for j in items if i < j and r.random() < 0.8}
        rows += [(t, *((j, i) if r.random() < 0.5 else (i, j)), v) for (i, j), v in pairs.items()]
        used = sorted({x for p in pairs for x in p})
        want |= {(t, i): c for i, c in agglomerated(used, pairs, least, combine).items()}
    data = spark.createDataFrame(rows, "t int, i int, j int, s double")
    got = {(x["t"], x["item"]): x["cluster"] for x in C.linkage_rounds(data, "t", least, str(tmp_path), linkage).collect()}
    assert got == want and 3 < len(set(got.values())) < 14
    assert [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["home"]
    plain = {(x["t"], x["item"]): x["cluster"] for x in C.linkage_clusters(data.select("t", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "s"), "t", least, linkage).collect()}
    assert plain == want


def test_distances_cluster_from_below(spark, tmp_path):
    data = spark.createDataFrame([(0, 1, 2, 0.1), (0, 2, 3, 0.9), (0, 1, 3, 0.8), (0, 4, 5, None)], "t int, i int, j int, s double")
    got = {x["item"]: x["cluster"] for x in C.linkage_rounds(data, "t", 0.5, str(tmp_path), above=False).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_limits_of_constraint_sets(spark, monkeypatch):
    for options in ({"cutoff": 30.5}, {"cutoff": 0.0}, {"step": 0.0}):
        with pytest.raises(ValueError, match="cutoff"):
            C.ConstraintOptions(**options)
    assert C.ConstraintOptions(cutoff=30.0).cutoff == 30.0
    monkeypatch.setattr(C, "TOO_LONG", 5)
    monkeypatch.setattr(C, "MOST_TEMPLATES", 1)
    places = spark.createDataFrame([("x", "a", k, float(k), 0.0, 0.0) for k in (1, 2)], "target string, template string, pos int, x double, y double, z double")
    letters = spark.createDataFrame([(a, b, int(a == b)) for a in "ACD" for b in "ACD"], "a string, b string, s int")

    def build(sequence, *templates):
        own = spark.createDataFrame([("x", sequence)], "target string, sequence string")
        aligned = spark.createDataFrame([("x", t, sequence, sequence) for t in templates], "target string, template string, t string, s string")
        return C.ConstraintSet.build(own, aligned, places, letters).table.collect()

    assert len(build("ACDA", "a")) == 1
    with pytest.raises(Exception, match="fewer than 5 letters: x"):
        build("ACDAC", "a")
    with pytest.raises(Exception, match="at most 1 templates: x"):
        build("ACDA", "a", "b")


def test_agreement_tables(spark):
    rows = spark.createDataFrame([("H", "C", 3), ("E", "C", 3)], "dssp string, pred string, conf int")
    one = spark.createDataFrame([("H", 0.5)], "dssp string, p double")
    two = spark.createDataFrame([("C", 3, 0.25)], "pred string, conf int, p double")
    three = spark.createDataFrame([("H", "C", 3, 0.2)], "dssp string, pred string, conf int, p double")
    got = {r["dssp"]: (r["p_observed"], r["p_predicted"], r["p_joint"]) for r in CH.agreement_parts(rows, one, two, three).collect()}
    assert got == {"H": (0.5, 0.25, 0.2), "E": (None, 0.25, None)}
    for conf in (10, -1, None):
        bad = spark.createDataFrame([("H", "C", conf)], rows.schema)
        with pytest.raises(Exception, match="from 0 to 9"):
            CH.agreement_parts(bad, one, two, three).select(F.lit(1)).collect()


def test_settings(spark, tmp_path):
    s = MembraneSettings("/data/", tables="hdfs://x/t", membrane_scorer="/abs/m")
    assert s.path("tables") == "hdfs://x/t" and s.path("membrane_scorer") == "/abs/m" and s.path("reference") == "/data/reference"
    s.save(spark, str(tmp_path / "s"))
    assert MembraneSettings.load(spark, str(tmp_path / "s")) == s
    with pytest.raises(ValueError, match="unknown settings: membrane_scorer, membrane_tables"):
        Settings.load(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no setting"):
        s.path("root")


def test_sequences_of_raw_models_are_checked(spark):
    o = RM.RawOptions(reach=6.0, distance_bins=3, angle_bins=2, dihedral_bins=2, separation=2, packing_reach=5.0, most=4, constraint_reach=7.0, step=1.0, torsion_bins=(1, 1, 3, 3, 1, 1))
    none = lambda shape: spark.createDataFrame([], shape)
    tables = RM.RawTables(
        none("ss string, a string, b string, d int, alpha int, beta int, gamma int, e double"),
        none("ss string, a string, n int, e double"),
        none("g int, b0 int, b1 int, b2 int, b3 int, b4 int, b5 int, e double"),
        none("i int, j int, constraint array<double>"),
        none("dssp string, p double"),
        none("pred string, conf int, p double"),
        none("dssp string, pred string, conf int, p double"),
    )
    residues = spark.createDataFrame([("m", k, "H", *[float(k * j) for j in range(12)]) for k in (1, 2)], "model string, rnum int, dssp string, " + ", ".join(f"{k}{v} double" for k in ("n", "ca", "c", "cb") for v in "xyz"))
    shape = "rnum int, aa string, pred string, conf int, g int"
    good = [(1, "A", "C", 1, 0), (2, "C", "H", 1, 0)]
    assert RM.raw_scores(residues, spark.createDataFrame(good, shape), tables, o).first()["coverage"] == 1.0
    for bad in ((2, "X", "H", 1, 0), (2, "C", "T", 1, 0), (1, "C", "H", 1, 0), (3, "C", "H", 1, 0), (2, None, "H", 1, 0)):
        with pytest.raises(Exception, match="not a position of a sequence"):
            RM.raw_scores(residues, spark.createDataFrame([good[0], bad], shape), tables, o).select("model").collect()
