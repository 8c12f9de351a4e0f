"""Queries over chains, keyed scoring, feature tables and model scores, with the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import interpolated
from ..operators import chains as CH
from ..operators import constraints as C
from ..operators import features as FT
from ..operators.terms import packing, pair_distance, reduced, residue_counts, torsion
from ..sources.readers import alignment_columns
from .common import PAIRS, POINTS, RADIUS, points, r6, table
from .scoring import CUTOFF, STEP, _functions, _templates
from .scoring import ORACLES as SCORING_SQL

GRID = [0.0, 0.2, 0.7, 1.0, 0.4, 0.1, 0.0]
RULES = [("0,1", "all", "all"), ("all", "2,3,4", "5,6"), ("all", "all", "all")]
WEIGHTS = {"tax": 2.0, "discount": 4.0}
VOWELS = "[AEIOU]"


def _residues(spark, d):
    p = points(spark, d)
    return p.select(F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("id").alias("rnum"), F.col("id").alias("res"), "label", (F.col("id") % 3).alias("ss"), "x", "y", "z")


def constraint_interp(spark, d):
    at = F.col("l_discount") * 5
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(interpolated(F.array(*map(F.lit, GRID)), at, 0.1)), 6).alias("v"))


def constraint_data(spark, d):
    """Every label's points as a model."""
    pairs = _templates(spark, d).select("target", "label", "i", "j", "d")
    out = C.constraint_data(pairs, _functions(spark, d), ["target"], CUTOFF / 2, STEP, ("label",))
    return out.select("label", "res", r6("disco"), "counts", F.round("avg_num_clusters", 6).alias("clusters"), "num_constraints", r6("fraction_observed"))


def chain_names(spark, d):
    chain = F.when(F.col("n_nationkey") % 3 == 0, F.rpad(F.lit(""), F.col("n_nationkey") % 7, F.lit(" "))).otherwise(F.substring("n_name", 1, 1))
    rows = table(spark, d, "nation").select("n_regionkey", chain.alias("chain"))
    return CH.named_chains(rows, ["n_regionkey"]).select("n_regionkey", "chain", "new_chain")


def sequence_by_name(spark, d):
    chains = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("chain"))
    return CH.chain_sequences(chains, table(spark, d, "region").select(F.col("r_name").alias("name"), F.reverse("r_name").alias("sequence"))).select("n_name", "chain", "sequence")


def _alignment(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("sequence"))
    cols = alignment_columns(n, n.withColumn("sequence", F.regexp_replace("sequence", VOWELS, "-")), ["n_nationkey"])
    return C.aligned_positions(cols, ["n_nationkey"])


def alignment_positions(spark, d):
    return _alignment(spark, d).select("n_nationkey", "col", "t", "s", F.col("t_pos").cast("long").alias("t_pos"), F.col("s_pos").cast("long").alias("s_pos"))


def sequence_coverage(spark, d):
    return CH.coverage(_alignment(spark, d), ["n_nationkey"]).select("n_nationkey", "length", "covered", r6("coverage"))


def keyed_energy(spark, d):
    """Energies by a state of the residue: three tables in one, counted in one pass and looked up in one join."""
    r, term, state = _residues(spark, d), pair_distance(0.0, RADIUS, 5, 0, "label"), ("ss",)
    return term.fitted(r, r, state)[2].select(F.col("res").alias("id"), r6("energy"))


def packing_energy(spark, d):
    p, term = _residues(spark, d).withColumn("id", F.col("res")), packing(RADIUS, 8, "label")
    return term.energies(term.train(p, p)).select("a", "n", r6("e"))


def reduced_hist(spark, d):
    e = table(spark, d, "embeddings")
    at = {n: F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(("x", "y", "z", "ax", "ay", "az"))}
    r = e.select(F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("vec_id").alias("rnum"), F.col("vec_id").alias("res"), F.col("label").alias("aa"), *at.values())
    return reduced(0.0, RADIUS, 2, 3, 4, 0).train(r, r).groupBy("d", "alpha", "beta", "gamma").agg(F.sum("w").alias("w"))


def torsion_hist(spark, d):
    p = points(spark, d).select(F.lit(0).alias("model"), F.col("label").alias("chain"), F.col("id").alias("rnum"), F.col("id").alias("res"), (F.col("id") % 7).cast("string").alias("aa3"), (F.col("x") * 3).alias("phi"), (F.col("y") * 3).alias("psi"))
    return torsion(RULES, (1, 1, 6, 6, 1, 1)).train(p, p).select("g", "b2", "b3", "w")


def residue_neighbours(spark, d):
    return residue_counts(_residues(spark, d), RADIUS).select(F.col("res").alias("id"), "n")


def _models(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("tax"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("discount"))
    return FT.averages(rows, ["l_orderkey"], ["tax", "discount"])


def feature_averages(spark, d):
    return _models(spark, d).select("l_orderkey", "residues", r6("avg_tax"), r6("avg_discount"))


def global_score(spark, d):
    return FT.global_score(_models(spark, d), WEIGHTS, 0.3, "score").select("l_orderkey", r6("score"))


def average_local_score(spark, d):
    scored = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("score"))
    out = FT.average_local_scores(scored, ["l_suppkey"])
    return out.select("l_suppkey", "residues", F.round("avg_local_score", 6).alias("score"), F.col("avg_local_score_error").alias("error"))


QUERIES = {f.__name__: f for f in (constraint_interp, constraint_data, chain_names, sequence_by_name, alignment_positions, sequence_coverage, keyed_energy, packing_energy, reduced_hist, torsion_hist, residue_neighbours, feature_averages, global_score, average_local_score)}

_AVG = "a AS (SELECT l_orderkey, count(*)::BIGINT AS residues, avg(CASE WHEN l_tax > 0.01 THEN l_tax END) AS t, avg(CASE WHEN l_linenumber <> 2 THEN l_discount END) AS s FROM lineitem GROUP BY l_orderkey)"
_COLS = """c AS (SELECT n_nationkey, (k - 1)::INT AS col, upper(n_name)[k] AS t, regexp_replace(upper(n_name), '[AEIOU]', '-', 'g')[k] AS s FROM (SELECT *, unnest(range(1, len(n_name) + 1)) AS k FROM nation))"""
_ERRORS = ", ".join(f"({40 + 5 * k}, {e}::DOUBLE)" for k, e in enumerate(FT.EXPECTED_ERRORS))
_GRID = "[" + ", ".join(f"{v}::DOUBLE" for v in GRID) + "]"
_CONSTRAINED = SCORING_SQL["constraint_function"].rpartition(" SELECT ")[0]


def _reduced_sql() -> str:
    def dot(p, q):
        return "(" + " + ".join(f"{a} * {b}" for a, b in zip(p, q)) + ")"

    def cross(p, q):
        return [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]

    def acos(p, q):
        return f"acos(greatest(-1, least(1, {dot(p, q)} / (sqrt({dot(p, p)}) * sqrt({dot(q, q)})))))"

    v, a, b = (tuple(f"{n}{x}" for x in "xyz") for n in "vau")
    n1, n2 = cross([f"(-{x})" for x in a], v), cross(v, b)
    gamma = f"atan2(sqrt({dot(v, v)}) * (-{dot(a, n2)}), {dot(n1, n2)})"
    back = tuple(f"(-{x})" for x in v)
    coords = ", ".join(f"embedding[{k + 1}]::DOUBLE AS {n}" for k, n in enumerate(("x", "y", "z", "ax", "ay", "az")))
    diff = ", ".join(f"r.{x} - l.{x} AS v{x}, l.a{x} AS a{x}, r.a{x} AS u{x}" for x in "xyz")
    d2 = " + ".join(f"(l.{x} - r.{x}) * (l.{x} - r.{x})" for x in "xyz")
    top = math.pi + 1e-9
    bins = f"floor(sqrt(d2) * (2 / {RADIUS}::DOUBLE))::INT AS d, floor({acos(a, v)} * (3 / {top}::DOUBLE))::INT AS alpha, floor({acos(b, back)} * (3 / {top}::DOUBLE))::INT AS beta, floor(({gamma} + {math.pi}::DOUBLE) * (4 / {top + math.pi}::DOUBLE))::INT AS gamma"
    return f"WITH p AS (SELECT vec_id AS id, {coords} FROM embeddings), q AS (SELECT {d2} AS d2, {diff} FROM p l JOIN p r ON l.id <> r.id AND {d2} < {RADIUS**2}) SELECT d, alpha, beta, gamma, count(*)::DOUBLE AS w FROM (SELECT {bins} FROM q) GROUP BY ALL"


ORACLES = {
    "constraint_interp": f"WITH t AS (SELECT l_returnflag, l_linestatus, l_discount * 5 / 0.1::DOUBLE AS u FROM lineitem), w AS (SELECT *, floor(u)::INT AS k, {_GRID} AS g FROM t) SELECT l_returnflag, l_linestatus, round(avg(g[k + 1] * (1 - (u - k)) + g[k + 2] * (u - k)), 6) AS v FROM w GROUP BY ALL",
    "constraint_data": _CONSTRAINED + f""", m AS (SELECT label, i, j, d, floor(d / {STEP}::DOUBLE)::INT AS k FROM d WHERE d < {CUTOFF}),
      x AS (SELECT m.label, m.i, m.j, m.d < {CUTOFF / 2} AS near, lo.num_clusters, lo.v * (1 - (m.d / {STEP}::DOUBLE - m.k)) + hi.v * (m.d / {STEP}::DOUBLE - m.k) AS s FROM m JOIN f lo ON lo.i = m.i AND lo.j = m.j AND lo.k = m.k LEFT JOIN f hi ON hi.i = m.i AND hi.j = m.j AND hi.k = m.k + 1)
      SELECT label, res, round(avg(s) FILTER (near), 6) AS disco, (count(*) FILTER (near))::BIGINT AS counts, round(avg(num_clusters) FILTER (near), 6) AS clusters, count(*)::BIGINT AS num_constraints, round((count(*) FILTER (near)) / count(*)::DOUBLE, 6) AS fraction_observed FROM (SELECT label, unnest([i, j]) AS res, s, near, num_clusters FROM x) GROUP BY label, res""",
    "chain_names": f"""WITH c AS (SELECT DISTINCT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN repeat(' ', n_nationkey % 7) ELSE substr(n_name, 1, 1) END AS chain FROM nation),
      b AS (SELECT n_regionkey, chain, row_number() OVER (PARTITION BY n_regionkey ORDER BY chain) AS k FROM c WHERE trim(chain) = ''),
      f AS (SELECT r.n_regionkey, n.name, row_number() OVER (PARTITION BY r.n_regionkey ORDER BY n.spot) AS k FROM (SELECT DISTINCT n_regionkey FROM c) r CROSS JOIN (SELECT unnest(range(1, 65)) AS spot, substr('{CH.CHAIN_NAMES}', spot, 1) AS name) n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_regionkey = r.n_regionkey AND c.chain = n.name))
      SELECT c.n_regionkey, c.chain, coalesce(f.name, c.chain) AS new_chain FROM c LEFT JOIN b USING (n_regionkey, chain) LEFT JOIN f ON f.n_regionkey = c.n_regionkey AND f.k = b.k""",
    "sequence_by_name": "SELECT n_name, r_name AS chain, reverse(r_name) AS sequence FROM nation JOIN region ON n_regionkey = r_regionkey",
    "alignment_positions": f"WITH {_COLS} SELECT n_nationkey, col, t, s, (CASE WHEN t <> '-' THEN sum((t <> '-')::INT) OVER w END)::BIGINT AS t_pos, (CASE WHEN s <> '-' THEN sum((s <> '-')::INT) OVER w END)::BIGINT AS s_pos FROM c WINDOW w AS (PARTITION BY n_nationkey ORDER BY col)",
    "sequence_coverage": f"WITH {_COLS} SELECT n_nationkey, count(*) FILTER (t <> '-')::BIGINT AS length, count(*) FILTER (t <> '-' AND s <> '-')::BIGINT AS covered, round(count(*) FILTER (t <> '-' AND s <> '-') / (count(*) FILTER (t <> '-'))::DOUBLE, 6) AS coverage FROM c GROUP BY n_nationkey",
    "keyed_energy": f"""WITH {PAIRS}, h AS (SELECT a, b, id, id % 3 AS ss, floor(sqrt(d2) * (5 / {RADIUS}))::INT AS d FROM q WHERE d2 < {RADIUS * RADIUS}), w AS (SELECT ss, a, b, d, count(*)::DOUBLE AS w FROM h GROUP BY ALL),
      g AS (SELECT k.ss, k.a, k.b, x.d, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT ss, a, b FROM w) k CROSS JOIN (SELECT unnest(range(5))::INT AS d) x LEFT JOIN w ON w.ss = k.ss AND w.a = k.a AND w.b = k.b AND w.d = x.d),
      t AS (SELECT *, sum(w) OVER (PARTITION BY ss, a, b) AS n, sum(w) OVER (PARTITION BY ss, d) AS nb, sum(w) OVER (PARTITION BY ss) AS al FROM g),
      e AS (SELECT ss, a, b, d, ln(1 + 0.02 * n) - ln(1 + 0.02 * n * coalesce((w / n) / nullif(nb / al, 0), 0)) AS e FROM t), s AS (SELECT h.id, avg(e.e) AS energy FROM h JOIN e USING (ss, a, b, d) GROUP BY h.id)
      SELECT p.id, round(energy, 6) AS energy FROM p LEFT JOIN s ON p.id = s.id""",
    "packing_energy": f"""WITH {PAIRS}, c AS (SELECT p.id, p.label AS a, least(count(q.other), 8)::INT AS n FROM p LEFT JOIN q ON p.id = q.id GROUP BY p.id, p.label), w AS (SELECT a, n, count(*)::DOUBLE AS w FROM c GROUP BY ALL),
      g AS (SELECT k.a, x.n, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT a FROM w) k CROSS JOIN (SELECT unnest(range(9))::INT AS n) x LEFT JOIN w ON w.a = k.a AND w.n = x.n),
      t AS (SELECT *, sum(w) OVER (PARTITION BY a) AS s, sum(w) OVER (PARTITION BY n) AS nb, sum(w) OVER () AS al FROM g)
      SELECT a, n, round(ln(1 + 0.02 * s) - ln(1 + 0.02 * s * coalesce((w / s) / nullif(nb / al, 0), 0)), 6) AS e FROM t""",
    "reduced_hist": _reduced_sql(),
    "torsion_hist": f"""WITH {POINTS}, t AS (SELECT id, label, id % 7 AS a, x * 3 AS phi, y * 3 AS psi, lag(id % 7) OVER w AS pa, lead(id % 7) OVER w AS na, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY label ORDER BY id)),
      u AS (SELECT CASE WHEN pa IN (0, 1) THEN 0 WHEN a IN (2, 3, 4) AND na IN (5, 6) THEN 1 ELSE 2 END AS g, greatest(-{math.pi - 0.0001}::DOUBLE, least({math.pi - 0.0001}::DOUBLE, phi)) AS phi, greatest(-{math.pi - 0.0001}::DOUBLE, least({math.pi - 0.0001}::DOUBLE, psi)) AS psi FROM t WHERE px IS NOT NULL AND nx IS NOT NULL AND py IS NOT NULL AND ny IS NOT NULL AND phi IS NOT NULL AND psi IS NOT NULL)
      SELECT g, floor((phi + {math.pi}::DOUBLE) * (6 / {2 * math.pi}::DOUBLE))::INT AS b2, floor((psi + {math.pi}::DOUBLE) * (6 / {2 * math.pi}::DOUBLE))::INT AS b3, count(*)::DOUBLE AS w FROM u GROUP BY ALL""",
    "residue_neighbours": f"WITH {PAIRS} SELECT p.id, count(q.other)::BIGINT AS n FROM p LEFT JOIN q ON p.id = q.id GROUP BY p.id",
    "feature_averages": f"WITH {_AVG} SELECT l_orderkey, residues, round(t, 6) AS avg_tax, round(s, 6) AS avg_discount FROM a",
    "global_score": f"WITH {_AVG} SELECT l_orderkey, round(CASE WHEN t IS NOT NULL AND s IS NOT NULL THEN greatest(0, least(1, 0.3::DOUBLE + t * 2 + s * 4)) END, 6)::DOUBLE AS score FROM a",
    "average_local_score": f"""WITH s AS (SELECT l_suppkey, count(*)::BIGINT AS residues, avg(l_discount * 10) AS score FROM lineitem GROUP BY l_suppkey), t(n, e) AS (VALUES {_ERRORS}),
      r AS (SELECT s.*, e, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(n - residues), n) AS k FROM s CROSS JOIN t) SELECT l_suppkey, residues, round(score, 6) AS score, e AS error FROM r WHERE k = 1""",
}
