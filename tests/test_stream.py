"""One pass over pairs against term by term; environments and shared pairs seen in the plan."""

import math
import os

import pytest
from pyspark.sql import functions as F

from latticework.operators import structures as ST
from latticework.operators import terms as T
from latticework.operators.environment import Environment
from latticework.operators.spatial import clash_scores, radius_join
from latticework.plans import QUERIES
from latticework.sources import readers as R

FILE = f"{os.path.dirname(os.path.abspath(__file__))}/data/1crn.pdb"
DATA = "/root/testdata/sf0.001"
RANGES = {"d": [1.0, 4.0, 3], "alpha": [0.0, 3.15, 2], "beta": [0.0, 3.15, 2], "gamma": [-3.15, 3.15, 2]}
SETTINGS = {
    "interaction": {"low": 3.0, "high": 10.0, "bins": 7, "separation": 4},
    "cbeta": {"low": 3.0, "high": 12.0, "bins": 9, "separation": 4},
    "reduced": {"low": 0.0, "high": 9.0, "bins": 3, "angle_bins": 2, "dihedral_bins": 3, "separation": 2},
    "packing": {"cutoff": 5.0, "most": 32},
    "cb_packing": {"cutoff": 9.0, "most": 20},
    "torsion": {"rules": [["all", "GLY", "all"], ["all", "all", "all"]], "bins": [1, 1, 9, 9, 1, 1]},
    "hbond": {"ranges": RANGES, "separation": 2, "states": [0]},
}


@pytest.fixture(scope="module")
def models(spark):
    """Crambin, and a copy that lacks some atoms, has a point of a membrane, an unknown atom and a CB far away."""
    atoms = R.preprocessed(R.read_pdb(spark, FILE))
    other = atoms.withColumn("model", F.lit("other")).where("not (rnum = 7 and aname = 'CA') and not (rnum = 9 and aname = 'CB') and not (rnum in (12, 13) and aname = 'N') and not (rnum = 20 and aname = 'O')")
    other = other.withColumn("x", F.when((F.col("rnum") == 30) & (F.col("aname") == "CB"), F.col("x") + 9).otherwise(F.col("x"))).withColumn("aname", F.when(F.col("serial") == 5, "QQ").otherwise(F.col("aname")))
    membrane = other.limit(1).withColumns({"rname": F.lit("MEM"), "aa": F.lit(None).cast("string"), "rnum": F.lit(900), "chain": F.lit("M"), "serial": F.lit(9000), "aname": F.lit("X")})
    both = atoms.unionByName(other).unionByName(membrane).cache()
    return both, R.backbone(both)


def values(rows, name):
    return {(r["model"], r["res"]): r[name] for r in rows.collect()}


def same(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_two_joins_give_what_seven_terms_give(spark, models):
    atoms, backbone = models
    terms = {n: (n, ST.make_term(n, **o)) for n, o in SETTINGS.items()}
    energies = {}
    for n, (_, t) in terms.items():
        p = ST.term_points(n, atoms, backbone)
        energies[n] = t.energies(t.train(p, p)).cache()
    rows = [("A", i, j, [math.sin(i * j + k) for k in range(40)]) for i in range(1, 47) for j in range(i + 1, 47) if (i + j) % 3]
    bounds = ST.Constraints(spark.createDataFrame(rows, "chain string, i int, j int, constraint array<double>"), 0.5, 12.0)
    wide = ST.structure_features(atoms, backbone, terms, energies, ("counts", "clash", "dist_const", "exposed"), constraints=bounds)
    got = wide.cache()
    assert got.count() == backbone.count()
    residues = [(r["model"], r["res"]) for r in got.select("model", "res").collect()]
    for n, (_, t) in terms.items():
        p = ST.term_points(n, atoms, backbone)
        want, have = values(t.score(p, p, energies[n]), "energy"), values(got, n)
        assert all(same(have[k], want.get(k)) for k in residues), n
        assert sum(v is not None for v in have.values()) > 60, n
    ca = [r for r in backbone.collect() if r["cax"] is not None]
    place = {(r["model"], r["rnum"]): [r[f"ca{v}"] for v in "xyz"] for r in ca}
    counts, disco = values(got, "counts"), values(got, "dist_const")
    table = {(i, j): v for _, i, j, v in rows}
    for r in backbone.collect():
        key, own = (r["model"], f"A:{r['rnum']}"), place.get((r["model"], r["rnum"]))
        near = [(n, math.dist(own, q)) for (m, n), q in place.items() if m == r["model"] and n != r["rnum"]] if own else []
        assert counts[key] == (float(sum(d <= 15 for _, d in near)) if own else None)
        found = []
        for n, d in near:
            pair = (min(n, r["rnum"]), max(n, r["rnum"]))
            if pair in table and d < 12:
                at, part = int(d / 0.5), d / 0.5 - int(d / 0.5)
                found.append(table[pair][at] * (1 - part) + table[pair][at + 1] * part)
        assert same(disco[key], sum(found) / len(found) if found else None)
    clash = clash_scores(atoms.withColumn("res", ST.residue_id(F.col("chain"), F.col("rnum"))), "serial", "element", "res", "chain", "rnum", disulfide=ST.disulfide_contact(), keys=["model"])
    want = values(clash, "clash")
    assert all(same(v, want[k]) for k, v in values(got, "clash").items())
    assert all(v is None for v in values(got, "exposed").values())


def test_two_joins_in_the_plan(models):
    atoms, backbone = models
    kinds = [k for k in SETTINGS if k != "torsion"]
    terms = {n: (n, ST.make_term(n, **SETTINGS[n])) for n in kinds}
    empty = {n: atoms.sparkSession.createDataFrame([], ", ".join([*[f"{k} string" if n != "hbond" else f"{k} int" for k in t.keys], *[f"{b} int" for b in t.sizes], "e double"])) for n, (_, t) in terms.items()}
    plan = ST.structure_features(atoms, backbone, terms, empty, ("counts", "clash"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(struct(a, -1") + plan.count("Generate explode([[-1,-1,-1]") == 2


def test_environments_are_read_where_they_lie(spark, models, tmp_path):
    atoms, _ = models
    points = ST.atom_points(atoms)
    Environment.write(points, 10.0, f"{tmp_path}/e", 4)
    env = Environment.open(spark, f"{tmp_path}/e")
    pick = lambda d: sorted(map(tuple, d.select("l_model", "l_id", "r_id", F.round("d2", 6)).collect()))
    for radius in (3.0, 10.0):
        assert pick(env.pairs(points, radius)) == pick(radius_join(points, points, radius, ["model"]))
    with pytest.raises(ValueError, match="too far"):
        env.pairs(points, 11.0)
    for name in ("interaction", "packing"):
        term = ST.make_term(name, **SETTINGS[name])
        energies = term.energies(term.train(points, env))
        want = values(term.score(points, points, energies), "energy")
        got = term.score(points, env, energies, counts=True)
        assert all(same(v, want[k]) for k, v in values(got, "energy").items())
        assert all((r["count"] > 0) == (r["energy"] is not None) for r in got.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = env.pairs(points, 5.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["residue_energy_mean", "total_energy", "keyed_energy"])
def test_pairs_are_looked_for_once(spark, name):
    """Pairs are kept: whatever uses them reads them there, and the join stands in no other place of the plan."""
    spark.catalog.clearCache()  # a plan that has run is shown twice
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("explode([[-1,-1,-1]") == plan.count("InMemoryRelation") > 1
    spark.catalog.clearCache()


def test_totals(spark, models):
    atoms, backbone = models
    term = ST.make_term("hbond", **SETTINGS["hbond"])
    p = ST.bonding_points(backbone)
    energies = term.energies(term.train(p, p))
    each = term.score(p, p, energies).where("model = '1crn'").collect()
    total = {r["model"]: r["energy"] for r in term.total(p, p, energies).collect()}
    assert total["1crn"] == pytest.approx(sum(r["energy"] for r in each) / 2 / 46)
    whole = {r["model"]: r["energy"] for r in term.total(p, p, energies, normalise=False).collect()}
    assert whole["1crn"] == pytest.approx(total["1crn"] * 46) and whole["1crn"] < 0


def test_a_state_without_counts_is_an_error(spark):
    term = T.hbond(RANGES, 2, states=(0, 1, 2))
    counts = spark.createDataFrame([(0, 0, 0, 0, 0, 2.0), (1, 1, 1, 1, 1, 3.0)], "state int, d int, alpha int, beta int, gamma int, w double")
    with pytest.raises(Exception, match="no counts of state 2"):
        term.energies(counts).select("e").collect()
    assert T.hbond(RANGES, 2, states=(0, 1)).energies(counts).count() == 2 * 24


def test_bonds_of_unequal_states_are_state_0(spark):
    rows = [("m", "A", k, f"A:{k}", s, True, *[float(v) for v in (0, 0, 0, 1, 0, 0, 2 * k, 1, 0, 3, 1, 0, 1, 2, 0)]) for k, s in ((1, 1), (5, 2))]
    names = [f"{a}{v}" for a in ("n", "h", "o", "c", "ca") for v in "xyz"]
    p = spark.createDataFrame(rows, "model string, chain string, rnum int, res string, state int, donates boolean, " + ", ".join(f"{n} double" for n in names)).withColumns({v: F.col(f"ca{v}") for v in "xyz"})
    assert {r["state"] for r in T.hbond({**RANGES, "d": [0.0, 20.0, 2]}, 2).rows(p, p).collect()} == {0}


def test_triplets_by_rule(spark):
    names = spark.createDataFrame([("GLY",), ("ALA",), ("PRO",)], "aa3 string")
    rules = [("all", "GLY", "PRO, ALA"), ("PRO", "all", "all"), ("all", "all", "all")]
    got = {(r["p_aa3"], r["aa3"], r["n_aa3"]): r["g"] for r in T.triplets_by_rule(names, rules).collect()}
    assert len(got) == 27 and got["ALA", "GLY", "PRO"] == 0 and got["PRO", "GLY", "GLY"] == 1 and got["ALA", "GLY", "GLY"] == 2
    with pytest.raises(Exception, match="no rule covers"):
        T.triplets_by_rule(names, rules[:2]).select("aa3").collect()
    assert T.triplets_by_rule(names, rules[:2], required=False).where("g is null").count() > 0


def test_look_ups_refuse(spark):
    term = T.pair_distance(0.0, 10.0, 5, 0, "kind")
    energies = spark.createDataFrame([("C", "D", 2, -1.5)], "a string, b string, d int, e double")
    keys = {"a": ["C", "D"], "b": ["C", "D"]}
    rows = spark.createDataFrame([("C", "D", 4.5), ("C", "C", 4.5), ("C", "D", 11.0)], "a string, b string, v double")
    look = lambda r, **o: term.at(r, energies, {"d": (F.col("v"), 0.0, 10.0)}, keys, **o)
    assert [r["e"] for r in look(rows, free=("d",)).orderBy("v", F.desc("b")).collect()] == [-1.5, None, None]
    for bad in (rows, spark.createDataFrame([("X", "D", 4.5)], rows.schema), spark.createDataFrame([(None, "D", 4.5)], rows.schema)):
        with pytest.raises(Exception, match="no energy of"):
            look(bad).select("a").collect()
