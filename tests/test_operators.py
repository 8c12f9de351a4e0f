import math
import os
import random

import pytest
from pyspark.sql import functions as F

from latticework.functions.geometry import angle, clamped, dihedral, distance, place_atom, vec
from latticework.operators import constraints as C
from latticework.operators import histogram as H
from latticework.operators import models as M
from latticework.operators import potential as P
from latticework.operators import sequences as Q
from latticework.operators import spatial as S
from latticework.operators.terms import torsion
from latticework.sources import readers as R
from latticework.sources.sinks import Container, pdb_line, score_arrays
from latticework.streaming.incremental import running_histogram

HERE = os.path.dirname(os.path.abspath(__file__))


def cloud(n, seed=1):
    r = random.Random(seed)
    return [(i, i % 3, *(r.uniform(-1, 1) for _ in range(3))) for i in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(cloud(120), "id long, label long, x double, y double, z double")


def test_radius_join_is_brute_force(points):
    got = {(r["l_id"], r["r_id"]) for r in S.self_pairs(points, 0.4, "id").select("l_id", "r_id").collect()}
    rows = cloud(120)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= 0.16}
    assert got == want


def test_neighbor_counts_have_zeros(spark, points):
    lone = points.unionByName(spark.createDataFrame([(999, 0, 50.0, 50.0, 50.0), (998, 0, None, 0.0, 0.0)], points.schema))
    got = {r["id"]: r["n"] for r in S.neighbor_counts(lone, lone, 0.4, "id").collect()}
    assert got[999] == 0 and got[998] == 0 and len(got) == 122


def test_smoothing_keeps_constants_and_gaps(points):
    flat = points.withColumn("v", F.lit(2.0)).withColumn("w", F.when(F.col("id") != 5, 3.0))
    for r in S.kernel_smooth(flat, ["v", "w"], 0.2, "id").collect():
        assert abs(r["v"] - 2) < 1e-12 and (r["w"] is None if r["id"] == 5 else abs(r["w"] - 3) < 1e-12)


def test_histograms_add_up_and_energies_vanish(spark):
    rows = spark.createDataFrame([("a", i % 4) for i in range(40)] + [("b", None), ("c", 1)], "k string, bin int")
    whole = H.histogram(rows, ["k"], ["bin"])
    parts = H.merged(H.histogram(rows.where("bin < 2"), ["k"], ["bin"]), H.histogram(rows.where("bin >= 2"), ["k"], ["bin"]))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert H.cell_count(whole, k="z").first()["w"] == 0
    e = {(r["k"], r["bin"]): r["e"] for r in P.sippl(whole, ["k"], {"bin": 5}).collect()}
    assert len(e) == 10 and abs(e["a", 4] - math.log(1 + 0.02 * 40)) < 1e-12
    with pytest.raises(ValueError):
        P.sippl(whole, ["k"], {"bin": 5}, reference_state="other")


def test_marginals_levels(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "k string, bin int")
    got = {(r["level"], r["k"], r["bin"]): r["w"] for r in H.marginals(H.histogram(rows, ["k"], ["bin"]), ["k"], ["bin"]).collect()}
    assert got["total", None, None] == 3 and got["keys", "a", None] == 2 and got["bins", None, 1] == 2 and got["cell", "b", 1] == 1


def test_crambin_torsion_groups(spark):
    """Counts of 1CRN by central residue: 42 triplets, 4 GLY, 5 PRO, 5 before PRO, 6 VAL or ILE, 22 others."""
    b = R.backbone(R.preprocessed(R.read_pdb(spark, f"{HERE}/data/1crn.pdb")))
    from pyspark.sql import Window

    w = Window.partitionBy("model", "chain").orderBy("rnum")
    near = b.select("*", *[f(c).over(w).alias(p + c) for p, f in (("p_", F.lag), ("n_", F.lead)) for c in ("nx", "ny", "nz", "cx", "cy", "cz")])
    phi, psi = dihedral(vec("p_c"), vec("n"), vec("ca"), vec("c")), dihedral(vec("n"), vec("ca"), vec("c"), vec("n_n"))
    rows = near.select("model", "chain", "rnum", F.col("rnum").alias("res"), F.col("rname").alias("aa3"), phi.alias("phi"), psi.alias("psi")).where("phi is not null or psi is not null")
    rules = [("all", "GLY", "all"), ("all", "PRO", "all"), ("all", "all", "PRO"), ("all", "VAL,ILE", "all"), ("all", "all", "all")]
    counts = torsion(rules, (1, 1, 18, 18, 1, 1)).train(rows, rows).groupBy("g").agg(F.sum("w").alias("w"))
    assert {r["g"]: r["w"] for r in counts.collect()} == {0: 4, 1: 5, 2: 5, 3: 6, 4: 22}


def test_pdb_lines_round_trip(spark, tmp_path):
    atoms = R.read_pdb(spark, f"{HERE}/data/1crn.pdb")
    atoms.orderBy("serial").coalesce(1).select(pdb_line(F.col("hetero"))).write.text(str(tmp_path / "x.pdb"))
    cols = ["serial", "aname", "rname", "chain", "rnum", "x", "y", "z", "bfac"]
    assert R.read_pdb(spark, str(tmp_path / "x.pdb")).select(cols).orderBy("serial").collect() == atoms.select(cols).orderBy("serial").collect()
    with pytest.raises(ValueError):
        R.structure_format("model.txt")


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACD\nEF\n>two\nA-D\n")
    assert [tuple(r) for r in R.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("name").select("name", "sequence").collect()] == [("one x", "ACDEF"), ("two", "A-D")]
    (tmp_path / "p.horiz").write_text("# PSIPRED HFORMAT (V3)\n\nConf: 9876\nPred: CHHC\n  AA: ACDE\n\nConf: 12\nPred: EE\n  AA: FG\n")
    assert tuple(R.read_psipred(spark, str(tmp_path / "p.horiz")).first())[1:] == ("ACDEFG", "CHHCEE", "987612")
    (tmp_path / "acc").write_text("name\nACD\ne-e\n")
    assert R.read_accpro_output(spark, str(tmp_path / "acc")).first()["accessibility"] == "ebe"
    (tmp_path / "m.a3m").write_text(">ss_pred x\nHHC\n>ss_conf x\n998\n>q\nACD\n>h\nAcgD-\n")
    assert {r["name"][:7]: r["sequence"] for r in R.read_a3m(spark, str(tmp_path / "m.a3m")).collect()}["h"] == "AD-"
    (tmp_path / "c").write_text("h1 1abc.A,2xyz.B 3foo.C\n")
    (tmp_path / "d.csv").write_text("pdb_id,release_date\n1abc,2020-01-01\n2xyz,2010-05-05\n3foo,2021-01-01\n")
    got = R.first_released(R.read_clusters(spark, str(tmp_path / "c")), R.read_release_dates(spark, str(tmp_path / "d.csv")), "2015-01-01").collect()
    assert [tuple(r) for r in got] == [("h1", "2xyz.B")]


def test_place_atom_inverts(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 2.0, 1.4, 0.0)], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    x, y, z = place_atom(1.3, 2.0, 0.7, vec("a"), vec("b"), vec("c"))
    q = p.select("*", x.alias("dx"), y.alias("dy"), z.alias("dz"))
    r = q.select(distance(vec("c"), vec("d")).alias("d"), dihedral(vec("a"), vec("b"), vec("c"), vec("d")).alias("t")).first()
    assert abs(r["d"] - 1.3) < 1e-9 and abs(r["t"] - 0.7) < 1e-9


def test_clusters_and_constraints(spark):
    s = spark.createDataFrame([("t", 1, 2, 0.9), ("t", 1, 3, 0.1), ("t", 2, 3, 0.2)], "target string, i int, j int, s double")
    assert {r["item"]: r["cluster"] for r in C.linkage_clusters(s, "target", 0.5).collect()} == {1: 1, 2: 1, 3: 3}
    d = spark.createDataFrame([(1, 2, 0, 1.0, 3.0004)], "i int, j int, cluster int, weight double, d double")
    f = C.constraint_functions(d, ["i", "j"], 5.0, 1.0).first()
    assert abs(f["constraint"][3] - 1) < 1e-9 and f["num_clusters"] == 1
    back = spark.createDataFrame([([0.1, 0.5],)], "c array<double>").select(C.dequantised(C.quantised(F.col("c"))).alias("c")).first()["c"]
    assert all(abs(a - b) <= 0.002 for a, b in zip(back, [0.1, 0.5]))


def test_runs_and_selection(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b"])], "g int, o int, v string")
    assert sorted((r["start"], r["end"], r["v"]) for r in Q.runs(rows, ["g"], ["o"], "v").collect()) == [(1, 2, "a"), (3, 4, None), (5, 5, "b")]
    x = spark.createDataFrame([(1.0, None), (1.0, 2.0), (None, float("nan"))], "a double, b double")
    assert [r[0] for r in x.select(Q.first_complete([["a", "b"], ["a"]])).collect()] == [1, 0, None]


def test_network_forms_agree(spark):
    net = M.Network([0.0, 1.0], [1.0, 2.0]).add_layer([[1.0, -1.0], [0.5, 2.0]], [0.0, 0.1], True).add_layer([[1.0, -0.5]], [0.2], False)
    again = M.Network.from_bytes(net.to_bytes())
    rows = spark.createDataFrame([([0.3, 0.7],), ([2.0, -1.0],), ([None, 1.0],)], "x array<double>")
    got = rows.select(again.apply(F.col("x")).alias("a"), net.vectorised()("x").alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-5 for r in got[:2]) and got[2]["a"] is None
    with pytest.raises(ValueError):
        M.Network([0.0], [1.0]).to_bytes()


def test_least_squares_needs_rows(spark):
    rows = spark.createDataFrame([(i % 2, float(i), 3.0 * i + 1) for i in range(300)] + [(7, 1.0, 2.0), (0, None, 1.0)], "g int, x double, y double")
    got = {r["g"]: r for r in M.least_squares(rows, ["g"], ["x"], "y").collect()}
    assert abs(got[0]["intercept"] - 1) < 1e-6 and abs(got[1]["weights"][0] - 3) < 1e-6 and got[7]["weights"] == [0.0]


def test_container_round_trip(spark, tmp_path):
    c = Container({"a": spark.range(3), "b": spark.range(5)})
    c.save(str(tmp_path / "c"))
    again = Container.load(spark, str(tmp_path / "c"))
    assert sorted(again) == ["a", "b"] and again["b"].count() == 5
    del again["a"]
    with pytest.raises(KeyError):
        again["a"]


def test_score_arrays_have_nulls(spark):
    p = spark.createDataFrame([("m", i) for i in range(3)], "m string, p int")
    s = spark.createDataFrame([("m", 1, 0.12345)], "m string, p int, s double")
    assert score_arrays(p, s, ["m"], "p", "s").first()["scores"] == [None, 0.123, None]


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", i % 3) for i in range(30)] + [("b", None)], "k string, bin int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], ["bin"]).writeStream.outputMode("complete").format("memory").queryName("h").start()
    try:
        q.processAllAvailable()
        assert sorted(spark.table("h").collect()) == sorted(H.histogram(rows, ["k"], ["bin"]).collect())
    finally:
        q.stop()


def test_missing_values_stay_missing(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, None, 0.0, 1.0), (2, 1.0, 0.0, 0.0)], "id int, x double, y double, z double")
    one = tuple(F.lit(v) for v in (0.0, 2.0, 0.0))
    got = {r["id"]: r["a"] for r in rows.select("id", angle(vec(""), one).alias("a")).collect()}
    assert got[0] is None and got[1] is None and abs(got[2] - math.pi / 2) < 1e-12
    assert rows.select(clamped(F.col("x"), 0.5, 0.7).alias("h")).orderBy("id").toPandas()["h"].tolist()[0::2] == [0.5, 0.7]
    assert rows.where("id = 1").select(clamped(F.col("x"), 0.5, 0.7), clamped(F.col("x"), high=1.0)).first()[:] == (None, None)
    reference = spark.createDataFrame([(n, 1e9 + n % 7) for n in range(40, 600)], "size int, v double")
    models = spark.createDataFrame([(None, 5.0), (100, 1e9 + 3.0), (100, None)], reference.schema)
    z = [r["z"] for r in Q.size_matched_z(models, reference, "size", "v").collect()]
    near = [1e9 + n % 7 for n in range(90, 111)]
    mean = sum(near) / len(near)
    sd = math.sqrt(sum((v - mean) ** 2 for v in near) / (len(near) - 1))
    assert sum(v is None for v in z) == 2 and abs([v for v in z if v is not None][0] - (1e9 + 3 - mean) / sd) < 1e-6
    net = M.Network([0.0], [1.0]).add_layer([[1.0]], [0.0], True).add_layer([[1.0]], [0.5], False)
    assert [r[0] for r in rows.orderBy("id").select(net.apply(F.array("x"))).collect()] == [0.5, None, 1.5]
