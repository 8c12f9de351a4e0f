"""Queries over histograms, potentials and spatial terms, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import angle, dihedral, sub
from ..functions.scalars import bin_of
from ..operators import histogram as H
from ..operators import potential as P
from ..operators import spatial as S
from ..operators.terms import packing, pair_distance
from .common import PAIRS, POINTS, RADIUS, points, r6, table

QUANTITY = {"bin": 10}
BINS = 5


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", bin_of(F.col("l_quantity"), 0.0, 50.0, 10).alias("bin"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return H.histogram(_lines(spark, d), ["l_returnflag"], ["bin"])


LINES = "c AS (SELECT l_returnflag, l_linestatus, floor(l_quantity / 5)::INT AS bin FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50)"
GRID = LINES + ", w AS (SELECT l_returnflag, bin, count(*)::DOUBLE AS w FROM c GROUP BY ALL), g AS (SELECT k.l_returnflag, b.bin, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT l_returnflag FROM c) k CROSS JOIN (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN w ON w.l_returnflag = k.l_returnflag AND w.bin = b.bin)"
SHARES = GRID + ", t AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag) AS n, sum(w) OVER (PARTITION BY bin) AS nb, sum(w) OVER () AS al FROM g)"


def hist_counts(spark, d):
    return H.histogram(_lines(spark, d), ["l_returnflag", "l_linestatus"], ["bin"])


def hist_marginals(spark, d):
    return H.marginals(hist_counts(spark, d), ["l_returnflag", "l_linestatus"], ["bin"])


def hist_merged(spark, d):
    parts = [H.histogram(_lines(spark, d).where(c), ["l_returnflag"], ["bin"]) for c in ("l_linestatus = 'F'", "l_linestatus <> 'F'")]
    return H.merged(*parts)


def hist_dense(spark, d):
    return H.dense(_counts(spark, d), ["l_returnflag"], QUANTITY).drop("n_")


def potential_classic(spark, d):
    return P.sippl(_counts(spark, d), ["l_returnflag"], QUANTITY).select("l_returnflag", "bin", r6("e"))


def potential_uniform(spark, d):
    return P.sippl(_counts(spark, d), ["l_returnflag"], QUANTITY, reference_state="uniform").select("l_returnflag", "bin", r6("e"))


def potential_hybrid(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", bin_of(F.col("l_quantity"), 0.0, 50.0, 10).alias("bin"))
    one, two = (H.histogram(rows.where(F.col("l_returnflag") == f), ["l_linestatus"], ["bin"]) for f in "AR")
    return P.sippl_hybrid(one, two, ["l_linestatus"], QUANTITY).select("l_linestatus", "bin", r6("e"))


def hbond_style_potential(spark, d):
    return P.normalised_by_state(_counts(spark, d), "l_returnflag", QUANTITY).select("l_returnflag", "bin", (F.round("e", 6) + 0.0).alias("e"))


def neighbor_count(spark, d):
    p = points(spark, d)
    return S.neighbor_counts(p, p, RADIUS, "id")


def packing_hist(spark, d):
    p = points(spark, d).withColumn("model", F.lit(0)).withColumn("res", F.col("id"))
    return packing(RADIUS, 32, "label").train(p, p)


def _species() -> object:
    return pair_distance(0.0, RADIUS, BINS, 0, "label")


def _residues(spark, d) -> DataFrame:
    return points(spark, d).select(F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("id").alias("rnum"), F.col("id").alias("res"), "label", "x", "y", "z")


def pair_hist(spark, d):
    r = _residues(spark, d)
    return _species().train(r, r)


def pair_energy(spark, d):
    term = _species()
    return term.energies(pair_hist(spark, d)).select("a", "b", "d", r6("e"))


def _scored(spark, d, normalise: bool) -> DataFrame:
    r, term = _residues(spark, d), _species()
    return term.fitted(r, r, normalise=normalise)[2].select(F.col("res").alias("id"), r6("energy"))


def residue_energy_mean(spark, d):
    return _scored(spark, d, True)


def residue_energy_sum(spark, d):
    return _scored(spark, d, False)


def total_energy(spark, d):
    r, term = _residues(spark, d), _species()
    rows, energies, _ = term.fitted(r, r)
    return P.total_energy(P.lookup(rows, energies, ["a", "b", "d"]), ["a"]).select(F.col("a").alias("label"), r6("energy"))


def seq_sep_pairs(spark, d):
    p = points(spark, d)
    pairs = S.apart_in_sequence(S.self_pairs(p, RADIUS, "id"), "label", "id", 50)
    return pairs.groupBy(F.col("l_label").alias("label")).agg(F.count("*").alias("n"))


def kernel_smooth(spark, d):
    p = points(spark, d).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("x") * 10)).withColumn("u", F.col("y"))
    return S.kernel_smooth(p, ["v", "u"], 0.08, "id").select("id", r6("v"), r6("u"))


def _atoms(spark, d) -> DataFrame:
    p = points(spark, d)
    at = {v: (F.col(v) * 12).alias(v) for v in "xyz"}
    return p.select("id", "label", F.substring(F.lit("CNOS"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("element"), F.floor(F.col("id") / 5).alias("residue"), *at.values())


def clash_score(spark, d):
    return S.clash_scores(_atoms(spark, d), "id", "element", "residue", "label", "residue").select("residue", r6("clash"))


def dist_similarity(spark, d):
    return S.distance_similarity(points(spark, d), points(spark, d, (3, 4, 5)), 0.3, "id", ["label"], (0.02, 0.05, 0.1, 0.2)).select("label", r6("similarity"))


def proximity_flag(spark, d):
    p = points(spark, d)
    return S.near_any(p.where("label < 5"), p.where("label >= 5"), 0.1, "id").select("id", "near")


def slab_class(spark, d):
    return S.plane_class(points(spark, d), (0.0, 0.6, 0.8), 0.01, 0.1, 0.03).groupBy("label", "side").agg(F.count("*").alias("n"))


def angle_dihedral(spark, d):
    e = table(spark, d, "embeddings")
    a, b, c, f = (tuple(F.get("embedding", F.lit(3 * k + i)).cast("double") for i in range(3)) for k in range(4))
    return e.select("vec_id", F.round(angle(sub(a, b), sub(c, b)), 5).alias("angle"), F.round(dihedral(a, b, c, f), 5).alias("dihedral"))


def angle_gaps(spark, d):
    """Angles where a fifth of the first vectors is missing and a seventh of the second has no length."""
    e = table(spark, d, "embeddings")
    at = lambda k: tuple(F.get("embedding", F.lit(3 * k + i)).cast("double") for i in range(3))
    a = tuple(F.when(F.col("vec_id") % 5 != 0, v) for v in at(0))
    b = tuple(F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(v) for v in at(1))
    return e.select("vec_id", F.round(angle(a, b), 5).alias("angle"))


_PAIR_BINS = PAIRS + f", h AS (SELECT a, b, id, floor(sqrt(d2) * ({BINS} / {RADIUS}))::INT AS d FROM q WHERE d2 < {RADIUS * RADIUS}), w AS (SELECT a, b, d, count(*)::DOUBLE AS w FROM h GROUP BY ALL)"
_PAIR_E = _PAIR_BINS + f""", g AS (SELECT k.a, k.b, x.d, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT a, b FROM w) k CROSS JOIN (SELECT unnest(range({BINS}))::INT AS d) x LEFT JOIN w ON w.a = k.a AND w.b = k.b AND w.d = x.d),
t AS (SELECT *, sum(w) OVER (PARTITION BY a, b) AS n, sum(w) OVER (PARTITION BY d) AS nb, sum(w) OVER () AS al FROM g),
e AS (SELECT a, b, d, ln(1 + 0.02 * n) - ln(1 + 0.02 * n * coalesce((w / n) / nullif(nb / al, 0), 0)) AS e FROM t)"""


def _acos(u: str, v: str) -> str:
    dot = lambda p, q: " + ".join(f"{a} * {b}" for a, b in zip(p, q))
    return f"acos(greatest(-1, least(1, ({dot(u, v)}) / (sqrt({dot(u, u)}) * sqrt({dot(v, v)})))))"


def _dihedral_sql() -> str:
    at = lambda k: [f"embedding[{3 * k + i + 1}]::DOUBLE" for i in range(3)]
    diff = lambda p, q: [f"({a} - {b})" for a, b in zip(p, q)]
    a, b, c, f = map(at, range(4))
    cols = ", ".join(f"{e} AS {n}{x}" for n, v in (("u", diff(b, a)), ("v", diff(c, b)), ("w", diff(f, c)), ("s", diff(a, b))) for x, e in zip("xyz", v))
    u, v, w, s = (tuple(f"{n}{x}" for x in "xyz") for n in "uvws")
    cross = lambda p, q: [f"({p[1]}*{q[2]}-{p[2]}*{q[1]})", f"({p[2]}*{q[0]}-{p[0]}*{q[2]})", f"({p[0]}*{q[1]}-{p[1]}*{q[0]})"]
    dot = lambda p, q: " + ".join(f"{x} * {y}" for x, y in zip(p, q))
    return f"WITH c AS (SELECT vec_id, {cols} FROM embeddings) SELECT vec_id, round({_acos(s, v)}, 5) AS angle, round(atan2(sqrt({dot(v, v)}) * ({dot(u, cross(v, w))}), {dot(cross(u, v), cross(v, w))}), 5) AS dihedral FROM c"


QUERIES = {f.__name__: f for f in (hist_counts, hist_marginals, hist_merged, hist_dense, potential_classic, potential_uniform, potential_hybrid, hbond_style_potential, neighbor_count, packing_hist, pair_hist, pair_energy, residue_energy_mean, residue_energy_sum, total_energy, seq_sep_pairs, kernel_smooth, clash_score, dist_similarity, proximity_flag, slab_class, angle_dihedral, angle_gaps)}

ORACLES = {
    "hist_counts": f"WITH {LINES} SELECT l_returnflag, l_linestatus, bin, count(*)::DOUBLE AS w FROM c GROUP BY ALL",
    "hist_marginals": f"""WITH {LINES} SELECT l_returnflag, l_linestatus, bin, count(*)::DOUBLE AS w,
      CASE WHEN grouping(l_returnflag) + grouping(bin) = 0 THEN 'cell' WHEN grouping(bin) = 1 AND grouping(l_returnflag) = 1 THEN 'total' WHEN grouping(bin) = 1 THEN 'keys' ELSE 'bins' END AS level
      FROM c GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, bin), (l_returnflag, l_linestatus), (bin), ())""",
    "hist_merged": f"WITH {LINES} SELECT l_returnflag, bin, count(*)::DOUBLE AS w FROM c GROUP BY ALL",
    "hist_dense": f"WITH {GRID} SELECT l_returnflag, bin, w FROM g",
    "potential_classic": f"WITH {SHARES} SELECT l_returnflag, bin, round(ln(1 + 0.02 * n) - ln(1 + 0.02 * n * coalesce((w / n) / nullif(nb / al, 0), 0)), 6) AS e FROM t",
    "potential_uniform": f"WITH {SHARES} SELECT l_returnflag, bin, round(ln(1 + 0.02 * n) - ln(1 + 0.02 * n * ((w / n) / 0.1)), 6) AS e FROM t",
    "potential_hybrid": """WITH c AS (SELECT l_linestatus, l_returnflag, floor(l_quantity / 5)::INT AS bin FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 AND l_returnflag IN ('A', 'R')),
      w AS (SELECT l_returnflag, l_linestatus, bin, count(*)::DOUBLE AS w FROM c GROUP BY ALL),
      g AS (SELECT k.l_returnflag, k.l_linestatus, b.bin, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM c) k CROSS JOIN (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN w ON w.l_returnflag = k.l_returnflag AND w.l_linestatus = k.l_linestatus AND w.bin = b.bin),
      t AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS n, sum(w) OVER (PARTITION BY l_returnflag, bin) AS nb, sum(w) OVER (PARTITION BY l_returnflag) AS al FROM g),
      s AS (SELECT l_returnflag, l_linestatus, bin, n, coalesce((w / n) / nullif(nb / al, 0), 0) AS p FROM t),
      j AS (SELECT coalesce(a.l_linestatus, r.l_linestatus) AS l_linestatus, coalesce(a.bin, r.bin) AS bin, coalesce(r.n, 0) AS n, coalesce(a.p, 0) + 0.02 * coalesce(r.n, 0) * coalesce(r.p, 0) AS s
        FROM (SELECT * FROM s WHERE l_returnflag = 'A') a FULL JOIN (SELECT * FROM s WHERE l_returnflag = 'R') r ON a.l_linestatus = r.l_linestatus AND a.bin = r.bin)
      SELECT l_linestatus, bin, round(CASE WHEN s > 0 THEN least(8.0, ln(1 + 0.02 * n) - ln(CASE WHEN s > 0 THEN s END)) ELSE 8.0 END, 6)::DOUBLE AS e FROM j""",
    "hbond_style_potential": f"""WITH {GRID}, s AS (SELECT l_returnflag, bin, w / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM g), e AS (SELECT *, -ln(greatest(p * 10, 1)) AS e0 FROM s),
      t AS (SELECT *, abs(sum(p * e0) OVER (PARTITION BY l_returnflag)) AS t FROM e) SELECT l_returnflag, bin, round(coalesce(e0 / nullif(t, 0), 0), 6) + 0.0 AS e FROM t""",
    "neighbor_count": f"WITH {PAIRS} SELECT p.id, count(q.other)::BIGINT AS n FROM p LEFT JOIN q ON p.id = q.id GROUP BY p.id",
    "packing_hist": f"WITH {PAIRS}, n AS (SELECT p.id, p.label AS a, least(count(q.other), 32)::INT AS n FROM p LEFT JOIN q ON p.id = q.id GROUP BY p.id, p.label) SELECT a, n, count(*)::DOUBLE AS w FROM n GROUP BY ALL",
    "pair_hist": f"WITH {_PAIR_BINS} SELECT a, b, d, w FROM w",
    "pair_energy": f"WITH {_PAIR_E} SELECT a, b, d, round(e, 6) AS e FROM e",
    "residue_energy_mean": f"WITH {_PAIR_E}, s AS (SELECT h.id, avg(e.e) AS energy FROM h JOIN e USING (a, b, d) GROUP BY h.id) SELECT p.id, round(energy, 6) AS energy FROM p LEFT JOIN s ON p.id = s.id",
    "residue_energy_sum": f"WITH {_PAIR_E}, s AS (SELECT h.id, sum(e.e) AS energy FROM h JOIN e USING (a, b, d) GROUP BY h.id) SELECT p.id, round(energy, 6) AS energy FROM p LEFT JOIN s ON p.id = s.id",
    "total_energy": f"WITH {_PAIR_E} SELECT h.a AS label, round(avg(e.e), 6) AS energy FROM h JOIN e USING (a, b, d) GROUP BY h.a",
    "seq_sep_pairs": f"WITH {PAIRS} SELECT a AS label, count(*)::BIGINT AS n FROM q WHERE a <> b OR abs(id - other) >= 50 GROUP BY a",
    "kernel_smooth": f"""WITH {POINTS}, v AS (SELECT *, CASE WHEN id % 7 <> 0 THEN x * 10 END AS v, y AS u FROM p),
      k AS (SELECT l.id, l.v AS own, r.v, r.u, exp(-((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z)) / (2 * 0.08 * 0.08)) AS w FROM v l JOIN v r ON (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z) <= 0.24 * 0.24)
      SELECT id, round(CASE WHEN any_value(own) IS NOT NULL THEN sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) END, 6) AS v, round(sum(w * u) / sum(w), 6) AS u FROM k GROUP BY id""",
    "clash_score": f"""WITH {POINTS}, t AS (SELECT id, label, substr('CNOS', (id % 4 + 1)::INT, 1) AS element, (id // 5)::BIGINT AS residue, x * 12 AS x, y * 12 AS y, z * 12 AS z FROM p),
      r AS (SELECT * FROM (VALUES ('C', 1.6::DOUBLE), ('N', 1.3), ('O', 1.3), ('S', 1.7)) r(element, r)), m AS (SELECT t.*, r.r FROM t JOIN r USING (element)),
      c AS (SELECT a.residue, a.r + b.r AS s, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM m a JOIN m b ON a.id <> b.id AND (a.label <> b.label OR abs(a.residue - b.residue) >= 2) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 3.2 * 3.2),
      s AS (SELECT residue, sum(CASE WHEN d < 0.8254 * s THEN 10.0 WHEN d <= s THEN 57.273 * (1 - d / s) ELSE 0 END) AS s FROM c GROUP BY residue)
      SELECT u.residue, round(coalesce(s, 0), 6)::DOUBLE AS clash FROM (SELECT DISTINCT residue FROM t) u LEFT JOIN s ON s.residue = u.residue""",
    "dist_similarity": """WITH p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings),
      d AS (SELECT l.label, sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z)) AS a, sqrt((l.u-r.u)*(l.u-r.u)+(l.v-r.v)*(l.v-r.v)+(l.w-r.w)*(l.w-r.w)) AS b FROM p l JOIN p r ON l.label = r.label AND l.id < r.id AND (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z) < 0.3 * 0.3)
      SELECT label, round(((count(*) FILTER (abs(a - b) < 0.02)) + (count(*) FILTER (abs(a - b) < 0.05)) + (count(*) FILTER (abs(a - b) < 0.1)) + (count(*) FILTER (abs(a - b) < 0.2))) / (count(*) * 4.0::DOUBLE), 6) AS similarity FROM d GROUP BY label""",
    "proximity_flag": f"WITH {POINTS} SELECT l.id, coalesce(bool_or(r.id IS NOT NULL), false) AS near FROM p l LEFT JOIN p r ON r.label >= 5 AND (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z) <= 0.1::DOUBLE * 0.1::DOUBLE WHERE l.label < 5 GROUP BY l.id",
    "slab_class": f"""WITH {POINTS}, a AS (SELECT label, x * 0.0 + y * 0.6::DOUBLE + z * 0.8::DOUBLE - 0.01::DOUBLE AS a FROM p)
      SELECT label, CASE WHEN abs(a - 0.05::DOUBLE) < 0.03 OR abs(a + 0.05::DOUBLE) < 0.03 THEN 'interface' WHEN abs(a - 0.05::DOUBLE) < 0.1 AND abs(a + 0.05::DOUBLE) < 0.1 THEN 'core' ELSE 'outside' END AS side, count(*)::BIGINT AS n FROM a GROUP BY ALL""",
    "angle_dihedral": _dihedral_sql(),
    "angle_gaps": f"SELECT vec_id, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN round({_acos(['embedding[1]::DOUBLE', 'embedding[2]::DOUBLE', 'embedding[3]::DOUBLE'], ['embedding[4]::DOUBLE', 'embedding[5]::DOUBLE', 'embedding[6]::DOUBLE'])}, 5) END AS angle FROM embeddings",
}
