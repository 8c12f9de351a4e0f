"""Chains, profiles, atom types, feature tables and raw models, against small cases worked out by hand or in numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from latticework.functions.atom_types import atom_type, atom_types
from latticework.operators import chains as CH
from latticework.operators import constraints as C
from latticework.operators import features as FT
from latticework.operators import models as M
from latticework.operators import raw_model as RM
from latticework.operators.terms import hbond, pair_distance, torsion
from latticework.sources.profiles import average_entropy, column_entropy, read_hhm, read_training_rows


def test_atom_types(spark):
    kinds = atom_types()
    assert len(kinds) == 169 and set(kinds.values()) == set(range(158))
    rows = spark.createDataFrame([("VAL", "CG1"), ("VAL", "CG2"), ("GLY", "CB"), (None, "N"), ("GLY", "N")], "r string, a string")
    got = [r[0] for r in rows.select(atom_type(F.col("r"), F.col("a"))).collect()]
    assert got[0] == got[1] is not None and got[2] is None and got[3] is None and got[4] == kinds["GLY N"]


def test_hhm(spark, tmp_path):
    stars = "\t".join(["*"] * 18)
    (tmp_path / "p.hhm").write_text(f"HHsearch 1.5\nNAME  query one\nSEQ\n>q\nAC\n#\nNULL   3706\t5728\t\nHMM    A\tC\n       M->M\tM->I\n       0\t*\nA 1    0\t*\t{stars}\t1\n       0\t*\n\nC 2    1000\t1000\t{stars}\t2\n       0\t*\n\n//\n")
    rows = read_hhm(spark, str(tmp_path / "p.hhm")).orderBy("pos").collect()
    assert [(r["name"], r["pos"], r["aa"]) for r in rows] == [("query one", 1, "A"), ("query one", 2, "C")]
    assert rows[0]["freqs"][:2] == [1.0, 0.0] and rows[1]["freqs"][:3] == [0.5, 0.5, 0.0]
    assert abs(average_entropy(read_hhm(spark, str(tmp_path / "p.hhm"))).first()["avg_entropy"] - math.log(2) / 2) < 1e-12
    assert spark.range(1).select(column_entropy(F.array(F.lit(1.0)))).first()[0] == 0


def test_training_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n,3\nnan,4\n5,x\n6,7\n")
    assert sorted(map(tuple, read_training_rows(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect())) == [(1.0, 2.0), (6.0, 7.0)]
    with pytest.raises(ValueError):
        read_training_rows(spark, str(tmp_path / "t.csv"), ["c"])


def test_chain_names_and_sequences(spark):
    chains = spark.createDataFrame([("m", ""), ("m", " "), ("m", "A"), ("m", "C"), ("n", "X")], "model string, chain string")
    got = {(r["model"], r["chain"]): r["new_chain"] for r in CH.named_chains(chains, ["model"]).collect()}
    assert got == {("m", ""): "B", ("m", " "): "D", ("m", "A"): "A", ("m", "C"): "C", ("n", "X"): "X"}
    one = spark.createDataFrame([("any", "ACD")], "name string, sequence string")
    assert {r["sequence"] for r in CH.chain_sequences(chains, one).collect()} == {"ACD"}
    two = spark.createDataFrame([("A", "AA"), ("C", "CC")], one.schema)
    assert {r["sequence"] for r in CH.chain_sequences(chains.where("chain in ('A', 'C')"), two).collect()} == {"AA", "CC"}
    with pytest.raises(PySparkException):
        CH.chain_sequences(chains, two).collect()


def test_numbers_and_predictions_follow_the_alignment(spark):
    cols = C.aligned_positions(spark.createDataFrame([("A", i, t, s) for i, (t, s) in enumerate(zip("ACDEF", "-C-EF"))], "chain string, col int, t string, s string"), ["chain"])
    res = spark.createDataFrame([("A", 10, "C"), ("A", 12, "E"), ("A", 13, "F")], "chain string, rnum int, aa string")
    assert {r["aa"]: r["rnum"] for r in CH.numbered_by_sequence(res, cols, ["chain"]).collect()} == {"C": 2, "E": 4, "F": 5}
    pred = spark.createDataFrame([("A", i + 1, p) for i, p in enumerate("HHECC")], "chain string, t_pos long, ss string")
    assert {r["s_pos"]: r["ss"] for r in CH.predictions_on_chain(pred, cols, ["chain"]).collect()} == {1: "H", 2: "C", 3: "C"}
    assert tuple(CH.coverage(cols, ["chain"]).first())[1:] == (5, 3, 0.6)


def test_agreement_and_classes(spark):
    rows = spark.createDataFrame([("H", "H", 9), ("X", "H", 9)], "dssp string, pred string, conf int")
    obs, pred = spark.createDataFrame([("H", 0.3)], "dssp string, p double"), spark.createDataFrame([("H", 9, 0.2)], "pred string, conf int, p double")
    joint = spark.createDataFrame([("H", "H", 9, 0.18)], "dssp string, pred string, conf int, p double")
    got = {r["dssp"]: r["agreement"] for r in CH.agreement(rows, obs, pred, joint).collect()}
    assert abs(got["H"] - math.log(3)) < 1e-12 and got["X"] is None
    x = spark.createDataFrame([(0.1, "H", None, "core"), (0.25, None, "E", "outside"), (float("nan"), None, "T", "interface"), (None, None, None, "outside")], "a double, p string, o string, side string")
    cls = CH.structure_class(F.col("p"), F.col("o"))
    out = x.select(CH.exposure(F.col("a")), cls, CH.membrane_key(F.col("side"), cls)).collect()
    assert [tuple(r) for r in out] == [("b", "helix", "membrane"), ("e", "extended", "extended"), (None, "coil", "interface"), (None, None, None)]


def test_membrane_checks(spark):
    r = spark.createDataFrame([("m", "core", "helix"), ("m", "core", "extended"), ("n", "core", "extended")], "model string, side string, structure string")
    assert tuple(CH.helical_membranes(r.where("model = 'm'"), ["model"]).first()) == ("m", 1, 1)
    with pytest.raises(PySparkException):
        CH.helical_membranes(r, ["model"]).collect()
    assert CH.disjoint(spark.range(3), spark.range(5, 8), ["id"]).count() == 3
    with pytest.raises(PySparkException):
        CH.disjoint(spark.range(3), spark.range(2, 8), ["id"]).collect()


def test_constraint_data_counts_far_pairs(spark):
    d = spark.createDataFrame([("t", 1, 2, 0, 1.0, 1.0, 0.5, 40.0), ("t", 1, 2, 0, 1.0, 1.0, 0.7, 30.0), ("t", 1, 3, 0, 1.0, 2.0, 0.1, 10.0)], "m string, i int, j int, cluster int, weight double, d double, seqsim double, seqid double")
    f = C.constraint_functions(d, ["m", "i", "j"], 5.0, 1.0)
    pairs = spark.createDataFrame([("t", 1, 2, 1.0), ("t", 1, 3, 9.0)], "m string, i int, j int, d double")
    got = {r["res"]: r for r in C.constraint_data(pairs, f, ["m"], 5.0, 1.0).collect()}
    assert got[1]["counts"] == 1 and got[1]["num_constraints"] == 2 and got[1]["fraction_observed"] == 0.5
    assert abs(got[2]["disco"] - 1) < 1e-9 and got[2]["avg_max_seqsim"] == 0.7 and got[2]["avg_max_seqid"] == 40.0
    assert got[3]["disco"] is None and got[3]["counts"] == 0


def test_keyed_scores_use_each_state(spark):
    pts = spark.createDataFrame([(0, "A", 1, 1, "a", "H", 0.0, 0.0, 0.0), (0, "A", 2, 2, "a", "E", 1.0, 0.0, 0.0)], "model int, chain string, rnum int, res int, k string, ss string, x double, y double, z double")
    term = pair_distance(0.0, 2.0, 1, 0, "k")
    e = {s: spark.createDataFrame([("a", "a", 0, v)], "a string, b string, d int, e double") for s, v in (("H", 1.0), ("E", -2.0))}
    got = {r["res"]: r["energy"] for r in term.score(pts, pts, term.keyed(e, "ss"), ("ss",)).collect()}
    assert got == {1: 1.0, 2: -2.0}


def test_hbond_energies_are_scaled_by_state(spark):
    term = hbond({"d": (0.0, 2.0, 2), "alpha": (0.0, 4.0, 1), "beta": (0.0, 4.0, 1), "gamma": (-4.0, 4.0, 1)}, 1)
    counts = spark.createDataFrame([(1, 0, 0, 0, 0, 9.0), (1, 1, 0, 0, 0, 1.0)], "state int, d int, alpha int, beta int, gamma int, w double")
    got = {r["d"]: r["e"] for r in term.energies(counts).collect()}
    assert abs(got[0] * 0.9 + 1) < 1e-12 and got[1] == 0


def test_feature_table_to_scores(spark):
    res = spark.createDataFrame([("m", i, "A") for i in range(4)], "model string, res int, aa string")
    t = spark.createDataFrame([("m", i, float(i) if i else float("nan")) for i in range(3)], "model string, res int, energy double")
    wide = FT.feature_table(res, {"t": t}, ["model", "res"])
    means = FT.averages(wide, ["model"], ["t"])
    assert means.first()["avg_t"] == 1.5 and means.first()["residues"] == 4
    assert FT.global_score(means, {"t": 2.0}, 0.0, "s").first()["s"] == 1.0
    net = M.Network([0.0, 0.0], [1.0, 1.0]).add_layer([[0.25, 0.1]], [0.0], False)
    got = {r["res"]: r["score"] for r in FT.local_scores(wide, means, ["model"], M.GroupScorer([["t", "avg_t"]], [net], ""), "aa").collect()}
    assert len(got) == 4 and got[3] == 0.0
    out = FT.average_local_scores(spark.createDataFrame([("m", 0.5), ("m", None)], "model string, score double"), ["model"]).first()
    assert out["avg_local_score"] == 0.25 and out["avg_local_score_error"] == 0.115
    ref = spark.createDataFrame([(4, 1.0), (4, 2.0), (40, 3.0), (40, 5.0)], "residues int, t double")
    z = FT.z_scores(means, ref, {"avg_t": "t"}).first()["avg_t_z_score"]
    assert abs(z - (1.5 - 4) / math.sqrt(2)) < 1e-12


def _unit(v):
    return v / np.linalg.norm(v)


def test_raw_model_is_brute_force(spark):
    r = random.Random(3)
    n, o = 14, RM.RawOptions(reach=6.0, distance_bins=3, angle_bins=2, dihedral_bins=2, separation=2, packing_reach=5.0, most=4, constraint_reach=7.0, step=1.0, torsion_bins=(1, 1, 3, 3, 1, 1))
    at = {k: np.array([[1.9 * i + r.uniform(-1, 1) for _ in range(1)] + [r.uniform(-3, 3) for _ in range(2)] for i in range(n)]) for k in ("n", "ca", "c", "cb")}
    for i in [i for i in range(1, n) if i != 9]:  # a chain with one break
        at["n"][i] = at["c"][i - 1] + np.array([1.0, 0.6, -0.4])
    seq = [("ACDEF"[i % 5], "HEC"[i % 3], i % 10, i % 2) for i in range(n)]
    red = {(s, a, b, d, x, y, g): r.uniform(-1, 1) for s in "HEC" for a in "ACDEF" for b in "ACDEF" for d in range(3) for x in range(2) for y in range(2) for g in range(2)}
    pack = {(s, a, k): r.uniform(-1, 1) for s in "HEC" for a in "ACDEF" for k in range(5)}
    tor = {(g, 0, 0, x, y, 0, 0): r.uniform(-1, 1) for g in range(2) for x in range(3) for y in range(3)}
    con = {(1, 3): [r.random() for _ in range(9)], (2, 5): [r.random() for _ in range(9)], (4, 5): [r.random() for _ in range(9)]}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    residues = frame([("m", i + 1, "H", *(float(v) for k in ("n", "ca", "c", "cb") for v in at[k][i])) for i in range(n)], "model string, rnum int, dssp string, " + ", ".join(f"{k}{v} double" for k in ("n", "ca", "c", "cb") for v in "xyz"))
    sequence = frame([(i + 1, *s) for i, s in enumerate(seq)] + [(n + 1, "A", "C", 0, 0)], "rnum int, aa string, pred string, conf int, g int")
    tables = RM.RawTables(
        frame([(*k, v) for k, v in red.items()], "ss string, a string, b string, d int, alpha int, beta int, gamma int, e double"),
        frame([(*k, v) for k, v in pack.items()], "ss string, a string, n int, e double"),
        frame([(*k, v) for k, v in tor.items()], "g int, b0 int, b1 int, b2 int, b3 int, b4 int, b5 int, e double"),
        frame([(*k, v) for k, v in con.items()], "i int, j int, constraint array<double>"),
        frame([("H", 0.5)], "dssp string, p double"),
        frame([(s, c, 0.1) for s in "HEC" for c in range(10)], "pred string, conf int, p double"),
        frame([("H", s, c, 0.1) for s in "HEC" for c in range(10)], "dssp string, pred string, conf int, p double"),
    )
    got = RM.raw_scores(residues, sequence, tables, o).first()
    v = [_unit(_unit(at["ca"][i] - at["n"][i]) + _unit(at["ca"][i] - at["c"][i])) for i in range(n)]
    es, cs, near = [[] for _ in range(n)], [[] for _ in range(n)], [0] * n
    for i in range(n):
        for j in range(n):
            d = np.linalg.norm(at["ca"][i] - at["ca"][j])
            if i == j or d >= 7.0:
                continue
            near[i] += np.linalg.norm(at["cb"][i] - at["cb"][j]) < 5.0
            k = (min(i, j) + 1, max(i, j) + 1)
            if k in con:
                cs[i].append(np.interp(d, range(9), con[k]))
            if d < 6.0 and abs(i - j) >= 2:
                u = (at["ca"][j] - at["ca"][i]) / d
                al, be = math.acos(np.dot(v[i], u)), math.acos(-np.dot(u, v[j]))
                ga = math.atan2(-np.dot(v[i], np.cross(u, v[j])), np.dot(-np.cross(v[i], u), np.cross(u, v[j])))
                es[i].append(red[seq[i][1], seq[i][0], seq[j][0], int(d / 2), int(al / math.pi * 2), int(be / math.pi * 2), int((ga + math.pi) / math.pi)])
    assert sum(map(len, es)) > 10 and sum(map(len, cs)) >= 2
    assert abs(got["reduced"] - sum(np.mean(e) for e in es if e) / n) < 1e-9
    assert abs(got["dist_const"] - sum(np.mean(c) for c in cs if c) / n) < 1e-9
    assert abs(got["cb_packing"] - sum(pack[seq[i][1], seq[i][0], min(near[i], 4)] for i in range(n)) / n) < 1e-9
    assert abs(got["ss_agreement"] - math.log(2)) < 1e-9 and abs(got["coverage"] - n / (n + 1)) < 1e-12

    def turn(a, b, c, d):
        x, y, z = b - a, c - b, d - c
        return min(math.atan2(np.linalg.norm(y) * np.dot(x, np.cross(y, z)), np.dot(np.cross(x, y), np.cross(y, z))), 3.141)

    N, A, K = at["n"], at["ca"], at["c"]
    tied = [i > 0 and np.sum((K[i - 1] - N[i]) ** 2) < 9 for i in range(n)] + [False]
    phi = [turn(K[i - 1], N[i], A[i], K[i]) if tied[i] else None for i in range(n)]
    psi = [turn(N[i], A[i], K[i], N[i + 1]) if tied[i + 1] else None for i in range(n)]
    whole = [i for i in range(1, n - 1) if all(p[k] is not None for p in (phi, psi) for k in (i - 1, i, i + 1))]
    bin3 = lambda x: int((x + math.pi) / (2 * math.pi) * 3)
    assert 4 <= len(whole) <= 10
    want = np.mean([tor[seq[i][3], 0, 0, bin3(phi[i]), bin3(psi[i]), 0, 0] for i in whole])
    assert abs(got["torsion"] - want) < 1e-9


def _similar(a, b, sub, low, high):
    s = [sub[p, q] for p, q in zip(a, b) if p != "-" and q != "-"]
    return (sum(s) / len(s) - low) / (high - low) if s else 0.0


def test_constraint_set_is_brute_force(spark, tmp_path):
    r = random.Random(5)
    sub = {(a, b): float(ord(a) * ord(b) % 9 - 4) if a != b else 5.0 for a in "ACDE" for b in "ACDE"}
    sub = {(a, b): sub[min(a, b), max(a, b)] for a in "ACDE" for b in "ACDE"}
    target = "ACDEACDEAC"
    rows = {"p": "ACDEACDE-C", "q": "ACDEACD-AC", "r": "EE-CCADEDA"}
    places = {t: {k + 1: [r.uniform(0, 6) for _ in "xyz"] for k, c in enumerate(s) if c != "-"} for t, s in rows.items()}
    o = C.ConstraintOptions(cutoff=5.0, gamma=3.0, similarity=0.8, step=0.5)
    frames = (
        spark.createDataFrame([("t", target)], "target string, sequence string"),
        spark.createDataFrame([("t", k, target, s) for k, s in rows.items()], "target string, template string, t string, s string"),
        spark.createDataFrame([("t", k, p, *x) for k, at in places.items() for p, x in at.items()], "target string, template string, pos int, x double, y double, z double"),
        spark.createDataFrame([(*k, v) for k, v in sub.items()], "a string, b string, s double"),
    )
    low, high = min(sub.values()), max(sub.values())
    own = {k: _similar(target, s, sub, low, high) for k, s in rows.items()}
    assert _similar(rows["p"], rows["q"], sub, low, high) >= 0.8 > max(_similar(rows[k], rows["r"], sub, low, high) for k in "pq")
    cluster = {"p": "p", "q": "p", "r": "r"}
    weight = {"p": math.exp(3 * (own["p"] + own["q"]) / 2), "r": math.exp(3 * own["r"])}
    want = {}
    for i in range(1, 11):
        for j in range(i + 1, 11):
            ds = [(cluster[k], math.floor(math.dist(at[i], at[j]) * 1000) / 1000) for k, at in places.items() if i in at and j in at and math.dist(at[i], at[j]) < 5]
            n = Counter(c for c, _ in ds)
            total = sum(weight[c] for c in n)
            if ds:
                want[i, j] = [sum(weight[c] / total / n[c] * math.exp(-0.5 * (d - 0.5 * k) ** 2) for c, d in ds) for k in range(17)]
    built = C.ConstraintSet.build(*frames, o)
    got = {(x["i"], x["j"]): x for x in built.table.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k]["constraint"], v)
    built.save(str(tmp_path / "c"))
    back = C.ConstraintSet.load(spark, str(tmp_path / "c"))
    i, j = next(iter(want))
    assert back.options == o and np.allclose(back.at("t", j, i).first()["constraint"], want[i, j], atol=0.0021)
    assert back.at("t", 1, 99).isEmpty()
    with pytest.raises(Exception, match="first sequence must be the target's"):  # several stages fail at once, so the type varies
        C.ConstraintSet.build(frames[0], frames[1].withColumn("t", F.lit("ACDE")), *frames[2:], o).table.collect()


def test_linkage_is_brute_force(spark):
    r = random.Random(2)
    for linkage, combine in (("average", lambda v: sum(v) / len(v)), ("max", max), ("min", min)):
        s = {(i, j): r.random() for i in range(9) for j in range(i + 1, 9) if r.random() < 0.8}
        groups = [[i] for i in range(9)]
        while True:
            links = [(combine(v), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y and (v := [s[min(p, q), max(p, q)] for p in a for q in b if (min(p, q), max(p, q)) in s])]
            if not links or max(links)[0] < 0.5:
                break
            _, x, y = max(links)
            groups[-x] += groups.pop(-y)
        rows = spark.createDataFrame([("t", i, j, v) for (i, j), v in s.items()], "t string, i int, j int, s double")
        got = {x["item"]: x["cluster"] for x in C.linkage_clusters(rows, "t", 0.5, linkage).collect()}
        assert got == {i: min(g) for g in groups for i in g}


def test_fits_are_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2)) + 1e6
    rows = [("g", float(a), float(b) if k % 3 else None, float(2 * a - b + 3 + e)) for k, ((a, b), e) in enumerate(zip(x, r.normal(size=400)))]
    table = spark.createDataFrame(rows, "g string, a double, b double, y double")
    got = {p["pattern"]: p for p in M.subset_scorer(table, ["g"], ["a", "b"], "y").collect()}
    for pattern, use in (("a", [0]), ("b", [1]), ("a,b", [0, 1])):
        known = [(v[1:3], v[3]) for v in rows if all(v[1 + u] is not None for u in use)]
        m = np.array([[v[0][u] - 1e6 for u in use] for v in known])
        w = np.linalg.lstsq(np.c_[np.ones(len(m)), m], np.array([v[1] for v in known]), rcond=None)[0]
        assert got[pattern]["n"] == len(known) and np.allclose(got[pattern]["weights"], w[1:], rtol=1e-6)
        assert abs(got[pattern]["intercept"] + 1e6 * sum(got[pattern]["weights"]) - w[0]) < 1e-3
    twice = spark.createDataFrame([("g", float(k), 2.0 * k, 5.0 * k + 1) for k in range(120)], "g string, a double, b double, y double")
    fit = M.least_squares(twice, ["g"], ["a", "b"], "y").first()
    assert np.allclose(fit["weights"], [1, 2]) and abs(fit["intercept"] - 1) < 1e-6


def test_rules_must_cover(spark):
    with pytest.raises(ValueError):
        torsion([("A", "all", "all")], (1, 1, 3, 3, 1, 1), ["A", "B"])
    assert torsion([("A", "all", "all"), ("all", "all", "all")], (1, 1, 3, 3, 1, 1), ["A", "B"]).keys == ("g",)
