"""Points that meet in tiles give what the joins of rows give, and no pair leaves a tile."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.operators import spatial as S
from latticework.operators import terms as T
from latticework.operators import tiles
from latticework.plans import templates


@pytest.fixture(scope="module")
def crowd(spark):
    """Two models of crowded points, some without a place, a kind or a number."""
    r = random.Random(3)
    rows = []
    for k in range(240):
        x = [r.gauss(0, 0.2) for _ in range(15)]
        rows.append(("m" if k % 3 else "n", "AB"[k % 2] if k % 17 else None, k // 2 if k % 19 else None, f"r{k // 2}", k, "cd"[k % 2] if k % 11 else None, "XYZ"[k % 3] if k % 13 else None, k % 3 if k % 7 else None, k % 5 > 0, *(x if k % 23 else [None] * 15)))
    names = [f"{a}{v}" for a in ("ca", "h", "n", "o", "c") for v in "xyz"]
    df = spark.createDataFrame(rows, "model string, chain string, rnum int, res string, id int, kind string, aa string, state int, donates boolean, " + ", ".join(f"{n} double" for n in names))
    return df.withColumns({**{v: F.col(f"ca{v}") for v in "xyz"}, **{f"a{v}": F.col(f"h{v}") for v in "xyz"}}).cache()


TERMS = {
    "pair": T.pair_distance(0.02, 0.25, 5, 1, "kind"),
    "reduced": T.reduced(0.0, 0.25, 2, 3, 4, 0),
    "hbond": T.hbond({"d": (0.0, 1.0, 4), "alpha": (0.0, 3.15, 3), "beta": (0.0, 3.15, 3), "gamma": (-3.15, 3.15, 4)}, 1, 0.25),
}


@pytest.mark.parametrize("parts", [(1 << 12, 1 << 17, 256), (16, 16, 0)])
@pytest.mark.parametrize("name", TERMS)
def test_counts_are_those_of_the_rows(crowd, name, parts, monkeypatch):
    for n, v in zip(("LEFT", "RIGHT", "PRODUCTS"), parts):
        monkeypatch.setattr(tiles, n, v)
    term = TERMS[name]
    columns = [*term.keys, *term.sizes]
    count = lambda rows, by, n: {tuple(r)[:-1]: r["times"] for r in rows.groupBy(*by).agg(n.alias("times")).collect()}
    rows = term.rows(crowd, crowd).dropna().cache()
    assert count(term._times(crowd, crowd, ()).dropna(), ["model", "res", *columns], F.sum("times")) == count(rows, ["model", "res", *columns], F.count("*"))
    assert {tuple(r)[:-1]: r["w"] for r in term.train(crowd, crowd, 2.0).collect()} == {k: 2.0 * n for k, n in count(rows, columns, F.count("*")).items()}


def test_no_row_for_each_pair(spark):
    """Of a thousand points that are all near each other, what is kept grows with the points: it was a row for each of a million pairs."""
    p = spark.range(1000).select(F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("id").alias("rnum"), F.col("id").alias("res"), F.lit(1).alias("label"), *[(F.col("id") % n * 0.001).alias(v) for v, n in (("x", 7), ("y", 11), ("z", 13))])
    rows, _, scores = T.pair_distance(0.0, 1.0, 5, 0, "label").fitted(p, p, counts=True)
    assert rows.count() <= 5 * 1000 and {r["count"] for r in scores.collect()} == {999}
    rows.unpersist()


def test_edges_to_the_last_bit():
    import numpy as np

    bins = lambda d2: np.minimum(np.floor(np.sqrt(d2) * 20.0).astype(int), 5)
    for m, t in enumerate(tiles.edges(bins, 5, 0.25)):
        assert bins(np.array([t]))[0] == m and (m == 0 or bins(np.nextafter(np.array([t]), -1))[0] == m - 1)


def test_sums_in_tiles(crowd):
    """Smoothed values, clashes and counts of neighbours are those of the joined rows."""
    p = crowd.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("hx"))).withColumn("e", F.upper("kind"))
    joined = S.radius_join(p, p, 0.3, ["model"])
    w = F.exp(-F.col("d2") / 0.02)
    want = joined.groupBy("l_model", "l_id").agg((F.sum(w * F.col("r_v")) / F.sum(F.when(F.col("r_v").isNotNull(), w))).alias("v"))
    want = {(r[0], r[1]): r[2] for r in want.collect() if r[1] % 5}
    got = {(r[0], r[1]): r[2] for r in S.kernel_smooth(p, ["v"], 0.1, "id", ["model"]).collect() if r[2] is not None}
    assert got == pytest.approx(want) and len(got) > 100
    n = joined.where("l_id != r_id").groupBy("l_model", "l_id").agg(F.count("*"))
    assert {(r[0], r[1]): r[2] for r in S.neighbor_counts(p, p, 0.3, "id", ["model"]).collect() if r[2]} == {(r[0], r[1]): r[2] for r in n.collect()}
    atoms = p.withColumns({v: F.col(v) * 5 for v in "xyz"})
    clash = lambda **o: {(r[0], r[1]): r[2] for r in S.clash_scores(atoms, "id", "e", "res", "chain", "rnum", keys=["model"], **o).collect()}
    assert clash() == pytest.approx(clash(disulfide=F.lit(False))) and sum(clash().values()) > 0


def test_sums_of_all_pairs_have_no_join_of_points(spark):
    """Crowded points met as joined rows, one for each pair."""
    p = spark.range(50).select("id", *[F.rand(k).alias(v) for k, v in enumerate("xyz")], F.lit("C").alias("element"), F.lit(0).alias("chain"))
    for df in (S.kernel_smooth(p, ["x"], 0.1, "id"), S.clash_scores(p, "id", "element", "id", "chain", "id")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x and " l_x#" in x.replace("(", " ")]


def test_constraints_of_placed_points(crowd):
    """Scores worked out where pairs are found are those of tables of constraints, and no table of pairs is made."""
    from functools import reduce

    from latticework.operators import constraints as C

    p = crowd.select(F.lit(0).alias("target"), "id", *[F.col(f"{a}{v}") for a in ("h", "n", "o", "c") for v in "xyz"])
    near = lambda a: S.self_pairs(p.select("id", *[F.col(f"{a}{v}").alias(v) for v in "xyz"]), 0.15, "id", ordered=False, strict=True).select(F.lit(0).alias("target"), F.col("l_id").alias("i"), F.col("r_id").alias("j"), F.sqrt("d2").alias("d"))
    templates = [("h", 0, 1.0), ("n", 1, 2.0), ("o", 0, 1.0)]
    rows = reduce(lambda x, y: x.unionByName(y), [near(a).select("*", F.lit(c).alias("cluster"), F.lit(w).alias("weight")) for a, c, w in templates])
    want = C.constraint_scores(near("c"), C.constraint_functions(rows, ["target", "i", "j"], 0.15, 0.05), ["target"], 0.05)
    want = {r["res"]: (r["score"], r["count"], r["clusters"], r["variance"]) for r in want.collect()}
    out = C.placed_constraint_scores(p, "target", "id", templates, "c", 0.15, 0.05)
    got = {r["id"]: (r["score"], r["count"], r["clusters"], r["variance"]) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 50 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_counts_at_several_radii_and_streamed_terms_keep_pairs_in_tiles(spark):
    r = random.Random(5)
    rows = [(k % 2, k, *[r.uniform(0, 2) for _ in range(3)]) for k in range(120)]
    points = spark.createDataFrame(rows, "model int, id int, x double, y double, z double")
    radii = {"near": 0.9, "close": 0.3}
    got = {tuple(x) for x in S.counts_within(points, points, radii, "id", ["model"]).collect()}
    assert got == {(m, i, *[sum(m == o and i != j and math.dist(p, q) <= d for o, j, *q in rows) for d in radii.values()]) for m, i, *p in rows}
    plan = templates.streamed_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_cell_x" not in plan and plan.count("FlatMapGroupsInArrow") >= 2


@pytest.mark.parametrize("name", ["reduced", "hbond"])
def test_whole_blocks_give_the_bins_of_single_pairs(name):
    """Angles on the edges of bins, points and axes that coincide, axes without a length or a value: what blocks come to is what pairs one by one do."""
    r = np.random.default_rng(5)
    n, names = 300, ["x", "y", "z", "ax", "ay", "az", *[f"{a}{v}" for a in ("h", "n", "o", "c", "ca") for v in "xyz"]]
    rough = np.arange(n) < n // 2
    values = {c: np.where(rough, r.integers(-2, 3, n) * 0.0625, r.normal(0, 0.12, n)) for c in names}
    values["ax"][::37] = np.nan
    for c in ("cx", "cy", "cz"):
        values[c][::29] = values["o" + c[1]][::29]
    points = pa.table({c: pa.chunked_array([pa.array(v, mask=np.isnan(v))]) for c, v in values.items()} | {"res": pa.chunked_array([pa.array(np.arange(n) // 2)]), "chain": pa.chunked_array([pa.array(["A"] * n)]), "rnum": pa.chunked_array([pa.array(np.arange(n))]), "aa": pa.chunked_array([pa.array([None if i % 11 == 0 else i % 4 for i in range(n)], pa.int64())]), "state": pa.chunked_array([pa.array([None if i % 13 == 0 else i % 3 for i in range(n)], pa.int64())]), "donates": pa.chunked_array([pa.array([i % 5 > 0 for i in range(n)])])})
    term, got = TERMS[name], []
    for whole in (True, False):
        for by in ([], ["res"]):
            cells = term.cells(points, points)
            assert cells.whole
            cells.whole = cells.whole if whole else None
            got.append(sorted(map(str, tiles.pair_counts(points, points, 0.25, cells, by).group_by([*by, *cells.own, *cells.keys, *cells.sizes]).aggregate([("times", "sum")]).to_pylist())))
    assert got[:2] == got[2:] and len(got[0]) > 50


def test_constraints_of_few_templates_are_looked_up(crowd, monkeypatch):
    """Templates in two clusters, some places missing: what is looked up by templates is what is worked out pair by pair, and both are what the exponentials say."""
    from latticework.operators import constraints as C

    p = crowd.select("model", F.col("id").alias("res"), *[F.col(f"{a}{v}").alias(f"{a}_{v}") for a in ("h", "n", "o", "c") for v in "xyz"])
    p = p.withColumn("n_x", F.when(F.col("res") % 5 > 0, F.col("n_x"))).where("h_x is not null").cache()
    templates = [("n_", 0, 1.0), ("o_", 1, 2.0), ("c_", 0, 1.0)]
    got = []
    for most in (10, 0):
        monkeypatch.setattr(C, "PATTERNS", most)
        got.append({(x["model"], x["res"]): x for x in C.placed_constraint_scores(p, "model", "res", templates, "h_", 0.3, 0.1).collect()})
    assert got[0] == got[1] and len(got[0]) > 100
    rows, sums = p.collect(), {}

    def apart(a, b, name):
        if any(x[f"{name}{v}"] is None for x in (a, b) for v in "xyz"):
            return math.inf
        return math.sqrt(sum((a[f"{name}{v}"] - b[f"{name}{v}"]) ** 2 for v in "xyz"))

    for a in rows:
        for b in rows:
            if a["model"] == b["model"] and a["res"] != b["res"] and (d := apart(a, b, "h_")) < 0.3:
                near = [(c, w, math.floor(e * 1000) / 1000) for n, c, w in templates if (e := apart(a, b, n)) < 0.3]
                if near:
                    held = {c: w for c, w, _ in near}
                    value = lambda k: sum(w / sum(held.values()) / sum(x[0] == c for x in near) * math.exp(-0.5 * (e - k * 0.1) ** 2) for c, w, e in near)
                    k = math.floor(d / 0.1)
                    sums.setdefault((a["model"], a["res"]), []).append(value(k) * (1 - (d / 0.1 - k)) + value(k + 1) * (d / 0.1 - k))
    assert sums.keys() == got[0].keys()
    for key, each in sums.items():
        assert got[0][key]["count"] == len(each) and got[0][key]["score"] == pytest.approx(sum(each) / len(each), abs=1e-12)
