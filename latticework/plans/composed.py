"""Queries over composed scores, alignments, bonds and agreement, with the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geometry import box_state, rebuilt_cb, vec
from ..operators import chains as CH
from ..operators import constraints as C
from ..operators import features as FT
from ..operators import histogram as H
from ..operators import sequences as Q
from ..operators.structures import STATE_BOXES
from ..operators.terms import angle_energies, hbond
from .common import RADIUS, r6, table
from .scoring import ORACLES as SCORING_SQL
from .scoring import _functions

SCORES = {"two": ({"a": 2.0, "b": 4.0}, 0.3), "one": ({"a": 5.0}, 0.1)}
STATES = ["helix", "extended", "coil", "membrane", "interface"]
LETTERS = ["F", "O"]
RANGES = {"d": (0.0, 1.0, 4), "alpha": (0.0, 3.15, 3), "beta": (0.0, 3.15, 3), "gamma": (-3.15, 3.15, 4)}
BINS = (1, 1, 6, 6, 1, 1)
SIGMA, REACH = 2.0, 4


def model_scores(spark, d):
    """Suppliers as models, their lines as residues."""
    lines = table(spark, d, "lineitem")
    rows = lines.select("l_suppkey", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("a"), F.col("l_discount").alias("b"))
    ref = lines.groupBy("l_suppkey").agg(F.count("*").alias("residues"), F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"), (F.avg("l_quantity") / 50).alias("two"))
    out = FT.model_scores(rows, ["l_suppkey"], SCORES, ref)
    return out.select("l_suppkey", "residues", r6("avg_a"), r6("avg_b"), r6("two"), r6("one"), *[F.round(f"{c}_z_score", 4).alias(f"{c}_z_score") for c in ("avg_a", "avg_b", "two")])


def _weights():
    """(state, aa, pattern, intercept, weights): of both features, and of packing alone."""
    both = [(s, x, "packing,ss_agreement", 0.1 * (k + j), [0.5 + 0.1 * k, 2.0 + j]) for k, s in enumerate(STATES[:3]) for j, x in enumerate(LETTERS)]
    return both + [(s, x, "packing", 0.05 * (k + j), [1.0 + 0.1 * k]) for k, s in enumerate(STATES) for j, x in enumerate(LETTERS)]


def membrane_scores(spark, d):
    scorer = spark.createDataFrame(_weights(), "state string, aa string, pattern string, intercept double, weights array<double>")
    inside = F.col("state").isin("membrane", "interface")
    side = F.when(F.col("l_linenumber") % 3 == 0, "core").when(F.col("l_linenumber") % 3 == 1, "interface").otherwise("outside")
    structure = F.when(F.col("l_returnflag") == "A", "helix").when(F.col("l_returnflag") == "N", "extended").otherwise("coil")
    rows = table(spark, d, "lineitem").select(side.alias("side"), structure.alias("structure"), F.col("l_linestatus").alias("aa"), (F.col("l_discount") * 3).alias("packing"), F.when(F.col("l_tax") < 0.06, F.col("l_tax")).alias("ss_agreement"))
    out = FT.membrane_local_scores(rows, scorer.where(~inside), scorer.where(inside), ["packing", "ss_agreement"], ["ss_agreement"], ["aa"])
    return out.groupBy("side", "structure", "aa").agg(F.count("*").alias("n"), F.count("ss_agreement").alias("predicted"), F.round(F.avg("score"), 6).alias("score"))


def _substitutions(spark):
    """A substitution score for every pair of letters, by a rule."""
    k = spark.range(26 * 26)
    a, b = (F.floor(F.col("id") / 26) + 65).cast("int"), (F.col("id") % 26 + 65).cast("int")
    return k.select(F.char(a).alias("a"), F.char(b).alias("b"), (a * b % 9 - 4).cast("double").alias("s"))


def _aligned(spark, d):
    """Part names with their reverse, a gap for each blank and there for each vowel."""
    n = F.upper("p_name")
    return table(spark, d, "part").select("p_partkey", F.translate(n, " ", "-").alias("t"), F.regexp_replace(F.reverse(n), "[AEIOU ]", "-").alias("s"))


def column_similarity(spark, d):
    letters = C.merged_columns(_aligned(spark, d), ["p_partkey"]).select("p_partkey", F.col("t").alias("a"), F.col("s").alias("b"))
    return C.column_similarity(letters, _substitutions(spark), ["p_partkey"]).select("p_partkey", r6("similarity"))


def alignment_features(spark, d):
    out = CH.alignment_features(_aligned(spark, d), _substitutions(spark), ["p_partkey"])
    return out.select("p_partkey", r6("seq_id"), r6("seq_sim"), F.col("n_insertions").cast("long").alias("n_insertions"), F.col("n_deletions").cast("long").alias("n_deletions"), F.col("seqres_length").cast("long").alias("seqres_length"), r6("seqres_coverage"))


def hbond_energy(spark, d):
    """Five points of an embedding as the atoms of a residue; bonds by the state of both residues, 0 if they differ."""
    at = {f"{a}{v}": F.get("embedding", F.lit(3 * k + i)).cast("double") for k, a in enumerate(("h", "n", "o", "c", "ca")) for i, v in enumerate("xyz")}
    r = table(spark, d, "embeddings").select(F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("vec_id").alias("rnum"), F.col("vec_id").alias("res"), (F.col("label") % 2).alias("state"), (F.col("vec_id") % 3 != 0).alias("donates"), *[c.alias(n) for n, c in at.items()])
    r = r.select("*", *[F.col(f"ca{v}").alias(v) for v in "xyz"])
    term = hbond(RANGES, 0, RADIUS)
    return term.fitted(r, r)[2].select(F.col("res").alias("id"), r6("energy"))


def exposure_counts(spark, d):
    lines = table(spark, d, "lineitem")
    observed, predicted = F.substring(F.lit("HGIEBTS"), F.col("l_linenumber"), F.lit(1)), F.when(F.col("l_tax") > 0.05, "E")
    cls = CH.structure_class(predicted, observed)
    side = F.when(F.col("l_quantity") < 10, "core").when(F.col("l_quantity") < 20, "interface")
    rows = lines.select(CH.exposure(F.when(F.col("l_tax") > 0, F.col("l_discount") * 4)).alias("exposure"), cls.alias("class"), CH.membrane_key(side, cls).alias("key"))
    return rows.groupBy("exposure", "class", "key").agg(F.count("*").alias("n"))


def ss_agreement(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("dssp"), F.col("o_orderpriority").alias("pred"), (F.month("o_orderdate") % 3).alias("conf"))
    total = rows.agg(F.count("*").cast("double")).scalar()
    share = lambda *by: rows.groupBy(*by).agg((F.count("*") / total).alias("p"))
    out = CH.agreement(rows, share("dssp"), share("pred", "conf"), share("dssp", "pred", "conf"))
    return out.groupBy("dssp", "pred", "conf").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 6).alias("agreement"))


def hash_annotations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    notes = Q.unique_by_hash(docs, "text", ["doc_id"]).select("hash", F.col("doc_id").alias("first_doc"), F.col("n").alias("copies"))
    return Q.annotated_by_hash(docs, "text", notes).select("doc_id", "first_doc", "copies")


def score_differences(spark, d):
    lines = table(spark, d, "lineitem")
    mean = lambda rows: rows.groupBy("l_orderkey").agg(F.avg("l_discount").alias("s"))
    others = {"open": mean(lines.where("l_linestatus = 'O'")), "returned": mean(lines.where("l_returnflag = 'R'")), "small": mean(lines.where("l_quantity < 25"))}
    return Q.differences(mean(lines), others, ["l_orderkey"], "s").select("l_orderkey", *[r6(n) for n in others])


def smoothed_values(spark, d):
    out = Q.smoothed(table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("value") > 5, F.col("value")).alias("value")), ["user_id"], ["ts", "event_id"], "value", SIGMA, REACH)
    return out.select("event_id", r6("smooth"))


def quantised_constraints(spark, d):
    f = _functions(spark, d).withColumn("constraint", C.dequantised(C.quantised(F.col("constraint"))))
    return f.select("i", "j", F.posexplode("constraint").alias("k", "v")).select("i", "j", "k", r6("v"))


def cluster_weights(spark, d):
    rows = table(spark, d, "part").select("p_type", F.col("p_brand").alias("cluster"), (F.col("p_size") / 1000).alias("similarity"))
    return C.cluster_weights(rows, ["p_type"]).select("p_type", "cluster", r6("similarity"), r6("weight"))


def hist_cell(spark, d):
    counts = H.histogram(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linenumber"])
    return H.cell_count(counts, l_returnflag="R", l_linenumber=3)


def torsion_energy(spark, d):
    """Six values as angles of many turns, looked up in a table that a rule makes."""
    cells = spark.range(72).select((F.col("id") % 2).cast("int").alias("g"), *[F.lit(0).alias(f"b{i}") for i in (0, 1)], (F.floor(F.col("id") / 2) % 6).cast("int").alias("b2"), F.floor(F.col("id") / 12).cast("int").alias("b3"), *[F.lit(0).alias(f"b{i}") for i in (4, 5)])
    energies = cells.withColumn("e", F.col("g") + F.col("b2") * 0.1 + F.col("b3") * 0.01)
    names = [f"v{i}" for i in range(6)]
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("g"), *[(F.get("embedding", F.lit(i)).cast("double") * 40).alias(n) for i, n in enumerate(names)])
    return angle_energies(rows, energies, BINS, names).select("vec_id", r6("e"))


def rebuilt_points(spark, d):
    at = {f"{a}{v}": F.get("embedding", F.lit(3 * k + i)).cast("double") for k, a in enumerate(("n", "ca", "c")) for i, v in enumerate("xyz")}
    rows = table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for n, c in at.items()])
    cb = rebuilt_cb(vec("n"), vec("ca"), vec("c"))
    state = box_state(F.col("nx") * 12, F.col("ny") * 12, STATE_BOXES)
    return rows.select("vec_id", *[r6(p, v) for p, v in zip(cb, "xyz")], state.alias("state"))


QUERIES = {f.__name__: f for f in (model_scores, membrane_scores, column_similarity, alignment_features, hbond_energy, exposure_counts, ss_agreement, hash_annotations, score_differences, smoothed_values, quantised_constraints, cluster_weights, hist_cell, torsion_energy, rebuilt_points)}


def _dot(p, q):
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(p, q)) + ")"


def _cross(p, q):
    return [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]


def _bin(v, low, high, n):
    return f"CASE WHEN {v} >= {low}::DOUBLE AND {v} < {high}::DOUBLE THEN floor(({v} - {low}::DOUBLE) * {n / (high - low)}::DOUBLE)::INT END"


def _hbond_sql() -> str:
    at = ", ".join(f"embedding[{3 * k + i + 1}]::DOUBLE AS {a}{v}" for k, a in enumerate(("h", "n", "o", "c", "ca")) for i, v in enumerate("xyz"))
    d2 = " + ".join(f"(p.ca{v} - q.ca{v}) * (p.ca{v} - q.ca{v})" for v in "xyz")
    diff = {"ho": "q.o{0} - p.h{0}", "nh": "p.n{0} - p.h{0}", "co": "q.c{0} - q.o{0}", "u": "q.c{0} - q.ca{0}", "v": "q.o{0} - q.c{0}"}
    parts = ", ".join(f"{e.format(v)} AS {n}{v}" for n, e in diff.items() for v in "xyz")
    ho, nh, co, u, v = ([f"{n}{x}" for x in "xyz"] for n in diff)
    oh = [f"(-{x})" for x in ho]
    acos = lambda a, b: f"acos(greatest(-1, least(1, {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))))"
    n1, n2 = _cross(u, v), _cross(v, oh)
    geometry = {"d": f"sqrt({_dot(ho, ho)})", "alpha": acos(nh, ho), "beta": acos(co, oh), "gamma": f"atan2(sqrt({_dot(v, v)}) * {_dot(u, n2)}, {_dot(n1, n2)})"}
    bins = ", ".join(f"{_bin(n, *RANGES[n])} AS b_{n}" for n in RANGES)
    cells = math.prod(n for _, _, n in RANGES.values())
    on = " AND ".join(f"e.b_{n} = b.b_{n}" for n in RANGES)
    return f"""WITH r AS (SELECT vec_id AS id, label % 2 AS state, vec_id % 3 <> 0 AS donates, {at} FROM embeddings),
      f AS (SELECT p.id AS l, q.id AS r, CASE WHEN p.state = q.state THEN p.state ELSE 0 END AS state, {parts} FROM r p JOIN r q ON p.id <> q.id AND p.donates AND {d2} <= {RADIUS * RADIUS}),
      g AS (SELECT l, r, state, {", ".join(f"{e} AS {n}" for n, e in geometry.items())} FROM f), b AS (SELECT l, r, state, {bins} FROM g),
      c AS (SELECT state, {", ".join(f"b_{n}" for n in RANGES)}, count(*) * 2.0::DOUBLE AS w FROM b WHERE {" AND ".join(f"b_{n} IS NOT NULL" for n in RANGES)} GROUP BY ALL),
      s AS (SELECT *, w / sum(w) OVER (PARTITION BY state) AS p FROM c), t AS (SELECT *, -ln(greatest(p * {cells}, 1.0::DOUBLE)) AS e0 FROM s),
      e AS (SELECT *, coalesce(e0 / nullif(abs(sum(p * e0) OVER (PARTITION BY state)), 0), 0) AS e FROM t),
      x AS (SELECT b.l, b.r, coalesce(e.e, 0) AS e FROM b LEFT JOIN e ON e.state = b.state AND {on}),
      y AS (SELECT id, sum(e) AS e FROM (SELECT l AS id, e FROM x UNION ALL SELECT r, e FROM x) GROUP BY id)
      SELECT r.id, round(coalesce(y.e, 0), 6) AS energy FROM r LEFT JOIN y USING (id)"""


def _smooth_sql() -> str:
    at = [(k, math.exp(-0.5 * (k / SIGMA) ** 2)) for k in range(-REACH, REACH + 1)]
    near = ", ".join(f"{'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER w AS v{k + REACH}" for k, _ in at)
    total = " + ".join(f"coalesce(v{k + REACH} * {g}::DOUBLE, 0)" for k, g in at)
    weight = " + ".join(f"CASE WHEN v{k + REACH} IS NOT NULL THEN {g}::DOUBLE ELSE 0 END" for k, g in at)
    return f"WITH e AS (SELECT event_id, user_id, ts, CASE WHEN value > 5 THEN value END AS v FROM events), n AS (SELECT event_id, {near} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(({total}) / nullif({weight}, 0), 6) AS smooth FROM n"


def _rebuilt_sql() -> str:
    at = ", ".join(f"embedding[{3 * k + i + 1}]::DOUBLE AS {a}{v}" for k, a in enumerate(("n", "ca", "c")) for i, v in enumerate("xyz"))
    b, e = ([f"(ca{v} - n{v})" for v in "xyz"], [f"(c{v} - ca{v})" for v in "xyz"])
    cb = [f"ca{v} + ({n} * -0.58273431::DOUBLE + ({p} * 0.56802827::DOUBLE + {q} * -0.54067466::DOUBLE))" for v, n, p, q in zip("xyz", _cross(b, e), b, e)]
    state = " ".join(f"WHEN nx * 12 > {a}::DOUBLE AND nx * 12 < {z}::DOUBLE AND ny * 12 > {y}::DOUBLE AND ny * 12 < {x}::DOUBLE THEN {s}" for a, z, y, x, s in STATE_BOXES)
    return f"WITH r AS (SELECT vec_id, {at} FROM embeddings) SELECT vec_id, {', '.join(f'round({p}, 6) AS {v}' for p, v in zip(cb, 'xyz'))}, (CASE {state} ELSE 0 END)::INT AS state FROM r"


_Z = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("a", "b", "two"))
_VALUES = ", ".join(f"('{s}', '{x}', {'true' if ',' in p else 'false'}, {i}::DOUBLE, {w[0]}::DOUBLE, {w[1] if len(w) > 1 else 0}::DOUBLE)" for s, x, p, i, w in _weights())
_ALIGNED = """a AS (SELECT p_partkey, replace(upper(p_name), ' ', '-') AS t, regexp_replace(reverse(upper(p_name)), '[AEIOU ]', '-', 'g') AS s FROM part),
      c AS (SELECT p_partkey, t[k] AS x, s[k] AS y FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM a)),
      f AS (SELECT p_partkey, avg((x = y)::INT) * 100 AS seq_id, (avg(ascii(x) * ascii(y) % 9 - 4) - -4) / (4 - -4) AS seq_sim, count(*) AS n FROM c WHERE x <> '-' AND y <> '-' GROUP BY p_partkey)"""
_WRAPPED = [f"(v{i} + {math.pi}::DOUBLE - {2 * math.pi}::DOUBLE * floor((v{i} + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE))" for i in range(6)]
_TURN = 6 / (2 * math.pi)

ORACLES = {
    "model_scores": f"""WITH m AS (SELECT l_suppkey, count(*)::BIGINT AS residues, avg(CASE WHEN l_tax > 0.01 THEN l_tax END) AS a, avg(l_discount) AS b FROM lineitem GROUP BY l_suppkey),
      q AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE + a * 2 + b * 4)) AS two, greatest(0, least(1, 0.1::DOUBLE + a * 5)) AS one, greatest(40, least(600, residues)) AS size FROM m),
      r AS (SELECT count(*) AS residues, avg(l_tax) AS a, avg(l_discount) AS b, avg(l_quantity) / 50 AS two FROM lineitem GROUP BY l_suppkey),
      z AS (SELECT size, {_Z} FROM (SELECT DISTINCT size FROM q) u JOIN r ON r.residues BETWEEN floor(u.size * 0.9::DOUBLE) AND floor(u.size * 1.1::DOUBLE) GROUP BY size)
      SELECT l_suppkey, residues, round(a, 6) AS avg_a, round(b, 6) AS avg_b, round(two, 6) AS two, round(one, 6) AS one, round((a - m_a) / nullif(s_a, 0), 4) AS avg_a_z_score, round((b - m_b) / nullif(s_b, 0), 4) AS avg_b_z_score, round((two - m_two) / nullif(s_two, 0), 4) AS two_z_score FROM q LEFT JOIN z USING (size)""",
    "membrane_scores": f"""WITH r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'interface' ELSE 'outside' END AS side, CASE l_returnflag WHEN 'A' THEN 'helix' WHEN 'N' THEN 'extended' ELSE 'coil' END AS structure, l_linestatus AS aa, l_discount * 3 AS p, CASE WHEN l_tax < 0.06 THEN l_tax END AS q FROM lineitem),
      k AS (SELECT *, CASE side WHEN 'core' THEN 'membrane' WHEN 'interface' THEN 'interface' ELSE structure END AS state, side = 'outside' AND q IS NOT NULL AS paired FROM r), w(state, aa, paired, i, wp, wq) AS (VALUES {_VALUES})
      SELECT side, structure, aa, count(*)::BIGINT AS n, count(q)::BIGINT AS predicted, round(avg(coalesce(greatest(0, least(1, i + p * wp + CASE WHEN paired THEN q * wq ELSE 0 END)), 0)), 6) AS score FROM k LEFT JOIN w USING (state, aa, paired) GROUP BY ALL""",
    "column_similarity": f"WITH {_ALIGNED} SELECT p_partkey, round(seq_sim, 6) AS similarity FROM f",
    "alignment_features": f"""WITH {_ALIGNED} SELECT p_partkey, round(seq_id, 6) AS seq_id, round(seq_sim, 6) AS seq_sim, len(regexp_extract_all(trim(s, '-'), '-+'))::BIGINT AS n_insertions, len(regexp_extract_all(trim(t, '-'), '-+'))::BIGINT AS n_deletions, len(replace(t, '-', ''))::BIGINT AS seqres_length, round(coalesce(n, 0)::DOUBLE / len(replace(t, '-', '')), 6) AS seqres_coverage FROM a LEFT JOIN f USING (p_partkey)""",
    "hbond_energy": _hbond_sql(),
    "exposure_counts": """WITH r AS (SELECT CASE WHEN l_tax > 0 THEN l_discount * 4 END AS area, CASE WHEN l_tax > 0.05 THEN 'E' ELSE substr('HGIEBTS', l_linenumber, 1) END AS s, l_quantity AS q FROM lineitem),
      c AS (SELECT CASE WHEN area < 0.25 THEN 'b' WHEN area IS NOT NULL THEN 'e' END AS exposure, CASE WHEN s IN ('H', 'G', 'I') THEN 'helix' WHEN s IN ('E', 'B') THEN 'extended' ELSE 'coil' END AS class, q FROM r)
      SELECT exposure, class, CASE WHEN q < 10 THEN 'membrane' WHEN q < 20 THEN 'interface' ELSE class END AS key, count(*)::BIGINT AS n FROM c GROUP BY ALL""",
    "ss_agreement": """WITH c AS (SELECT o_orderstatus AS dssp, o_orderpriority AS pred, (month(o_orderdate) % 3)::INT AS conf, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
      SELECT dssp, pred, conf, n, round(ln(n::DOUBLE * sum(n) OVER () / (sum(n) OVER (PARTITION BY dssp) * sum(n) OVER (PARTITION BY pred, conf))), 6) AS agreement FROM c""",
    "hash_annotations": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc, count(*) OVER (PARTITION BY text) AS copies FROM documents",
    "score_differences": """WITH s AS (SELECT l_orderkey, avg(l_discount) AS s, avg(l_discount) FILTER (l_linestatus = 'O') AS o, avg(l_discount) FILTER (l_returnflag = 'R') AS r, avg(l_discount) FILTER (l_quantity < 25) AS q FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, round(s - o, 6) AS open, round(s - r, 6) AS returned, round(s - q, 6) AS small FROM s WHERE o IS NOT NULL AND r IS NOT NULL AND q IS NOT NULL""",
    "smoothed_values": _smooth_sql(),
    "quantised_constraints": SCORING_SQL["constraint_function"].rpartition(" SELECT ")[0] + " SELECT i, j, k, round(floor(v * 250 + 0.5) * 0.004::DOUBLE, 6) AS v FROM f",
    "cluster_weights": "SELECT p_type, p_brand AS cluster, round(avg(p_size / 1000), 6) AS similarity, round(exp(70 * avg(p_size / 1000)), 6) AS weight FROM part GROUP BY ALL",
    "hist_cell": "SELECT count(*)::DOUBLE AS w FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3",
    "torsion_energy": f"WITH r AS (SELECT vec_id, vec_id % 3 AS g, embedding[3]::DOUBLE * 40 AS v2, embedding[4]::DOUBLE * 40 AS v3 FROM embeddings) SELECT vec_id, round(CASE WHEN g < 2 THEN g + floor({_WRAPPED[2]} * {_TURN}::DOUBLE) * 0.1::DOUBLE + floor({_WRAPPED[3]} * {_TURN}::DOUBLE) * 0.01::DOUBLE END, 6) AS e FROM r",
    "rebuilt_points": _rebuilt_sql(),
}
