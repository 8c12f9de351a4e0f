"""Queries over ordered data, reference sets, constraints, sequences and models, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, inner_gap_runs, mean_of_known, one_hot
from ..operators import constraints as C
from ..operators import histogram as H
from ..operators import models as M
from ..operators import sequences as Q
from ..operators.potential import sippl
from ..operators.terms import first_rule
from ..sources.sinks import score_arrays
from .common import points, r6, table

ORDER = ["ts", "event_id"]
RULES = [("all", "purchase", "all"), ("all", "error", "all"), ("all", "all", "error,purchase"), ("all", "click,view", "all"), ("all", "all", "all")]
NET = M.Network([25.0, 1500.0, 0.05], [15.0, 400.0, 0.03]).add_layer([[0.5, -0.25, 0.1], [-0.3, 0.8, 0.2]], [0.1, -0.2], True).add_layer([[0.7, -0.4]], [0.05], False)
ERRORS = [(5, 0.115), (10, 0.101), (20, 0.083), (30, 0.071), (40, 0.062), (50, 0.053)]
STEP, CUTOFF, RESIDUES = 0.05, 0.5, 40


def _triplets(spark: SparkSession, d: str):
    t = Q.triplets(table(spark, d, "events"), ["user_id"], ORDER, "event_type").where("prev_event_type is not null and next_event_type is not null")
    return t.withColumn("g", first_rule([F.col("prev_event_type"), F.col("event_type"), F.col("next_event_type")], RULES))


def triplet_groups(spark, d):
    return _triplets(spark, d).groupBy("g").agg(F.count("*").alias("n"))


def triplet_potential(spark, d):
    rows = _triplets(spark, d).withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int"))
    return sippl(H.histogram(rows, ["g"], ["bin"]), ["g"], {"bin": 10}).select("g", "bin", r6("e"))


def state_smoothing(spark, d):
    kept = Q.kept_states(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ORDER, "event_type")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.count("kept").alias("kept"))


def run_segments(spark, d):
    return Q.runs(table(spark, d, "events"), ["user_id"], ORDER, "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


def zscore_refset(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.sum("o_totalprice") / 10000).cast("long").alias("size"), F.avg("o_totalprice").alias("price"))
    return Q.size_matched_z(o, o, "size", "price", 40, 600).select("o_custkey", F.round("z", 5).alias("z"))


def zscore_unsized(spark, d):
    """A third of the customers has no size, and a third of the prices is large beside its spread."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.sum("o_totalprice") / 10000).cast("long").alias("size"), (F.avg("o_totalprice") + 1e9).alias("price"))
    unsized = o.withColumn("size", F.when(F.col("o_custkey") % 3 != 0, F.col("size")))
    return Q.size_matched_z(unsized, o, "size", "price", 40, 600).select("o_custkey", F.round("z", 4).alias("z"))


def agreement_logodds(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").cast("double").alias("w"))
    return Q.log_odds(counts, "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", r6("log_odds"))


def match_fraction(spark, d):
    rows = table(spark, d, "lineitem").select("l_shipdate", Q.match_score(F.when(F.col("l_quantity") < 25, "F").otherwise("O"), F.col("l_linestatus"), ["F", "O"]).alias("m"))
    return rows.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg("m"), 6).alias("m"))


def nearest_bucket_error(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.nearest_entry(F.col("p_size").cast("double"), ERRORS).alias("error"))


def nan_mean(spark, d):
    v = F.when(F.col("l_tax") > 0.05, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(mean_of_known(v), 4).alias("mean"), F.round(clamp01(mean_of_known(v) / 40000, 0.0), 6).alias("held"))


def lstsq_fit(spark, d):
    fit = M.least_squares(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    return fit.select("l_returnflag", "n", F.round("intercept", 3).alias("intercept"), F.round(F.get("weights", F.lit(0)), 3).alias("slope"))


def linear_predict(spark, d):
    rows = table(spark, d, "lineitem")
    fit = M.least_squares(rows, ["l_returnflag"], ["l_quantity"], "l_extendedprice").drop("n")
    out = rows.join(fit, "l_returnflag").withColumn("p", M.linear([F.col("l_quantity")], F.col("intercept"), F.col("weights")))
    return out.groupBy("l_returnflag").agg(F.round(F.avg(F.abs(F.col("p") - F.col("l_extendedprice"))), 2).alias("error"))


def null_pattern_scorer(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") < 4, F.col("l_discount")).alias("c"))
    scorer = M.subset_scorer(rows, ["l_linestatus"], ["q", "c"], "l_extendedprice")
    scored = M.subset_score(rows, scorer, ["l_linestatus"], ["q", "c"])
    return scored.groupBy("l_linestatus", "l_linenumber").agg(F.count("score").alias("n"), F.round(F.avg("score"), 2).alias("score"))


def feature_group_select(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("b"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("c"))
    return rows.groupBy(Q.first_complete([["a", "b", "c"], ["a", "b"], ["b", "c"], ["a"]]).alias("g")).agg(F.count("*").alias("n"))


def mlp_predict(spark, d):
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey") % 10 / 100.0)
    # many outputs are halves of the last digit: they are rounded in doubles, as the SQL does it, not as decimals
    return table(spark, d, "part").select("p_partkey", (F.round(NET.apply(x) * 10000.0) / 10000.0).alias("y"))


def one_hot_counts(spark, d):
    letters = table(spark, d, "part").select(F.upper(F.substring("p_type", 1, 1)).alias("c"))
    return letters.select("c", one_hot(F.col("c"), "EPS").alias("h")).groupBy("c").agg(*[F.sum(F.get("h", F.lit(i))).alias(f"n{i}") for i in range(3)])


def _templates(spark, d):
    """Distances of residue pairs in templates: a label is a cluster, its points fall on RESIDUES positions."""
    p = points(spark, d).select("label", (F.col("id") % RESIDUES).cast("int").alias("pos"), "x", "y", "z").groupBy("label", "pos").agg(*[F.avg(v).alias(v) for v in "xyz"])
    a, b = (p.select("label", *[F.col(c).alias(f"{s}{c}") for c in ("pos", "x", "y", "z")]) for s in "ij")
    d2 = sum((F.col(f"i{v}") - F.col(f"j{v}")) * (F.col(f"i{v}") - F.col(f"j{v}")) for v in "xyz")
    pairs = a.join(b, "label").where("ipos < jpos").select("label", F.lit(0).alias("target"), F.col("ipos").alias("i"), F.col("jpos").alias("j"), F.sqrt(d2).alias("d"))
    return pairs.where(F.col("d") < CUTOFF)


def _functions(spark, d):
    rows = _templates(spark, d).select("target", "i", "j", (F.col("label") % 4).alias("cluster"), F.exp(F.col("label") % 4 * 0.5).alias("weight"), "d")
    return C.constraint_functions(rows, ["target", "i", "j"], CUTOFF, STEP)


def constraint_function(spark, d):
    f = _functions(spark, d).select("i", "j", "num_clusters", F.round("variance", 8).alias("variance"), F.posexplode("constraint").alias("k", "v"))
    return f.select("i", "j", "num_clusters", "variance", "k", r6("v"))


def constraint_score(spark, d):
    """Every label's points as a model."""
    pairs = _templates(spark, d).select("target", "label", "i", "j", "d")
    out = C.constraint_scores(pairs, _functions(spark, d), ["target"], STEP, ("label",))
    return out.select("label", "res", r6("score"), "count", F.round("clusters", 6).alias("clusters"), F.round("variance", 8).alias("variance"))


def pairwise_similarity(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_name", F.posexplode(F.split(F.rpad("n_name", 14, "-"), "")).alias("col", "c"))
    a, b = n.select("n_regionkey", F.col("n_name").alias("one"), "col", F.col("c").alias("a")), n.select("n_regionkey", F.col("n_name").alias("two"), "col", F.col("c").alias("b"))
    pairs = a.join(b, ["n_regionkey", "col"]).where("one < two")
    return C.identity(pairs, ["one", "two"]).select("one", "two", r6("identity"))


def cluster_avg_linkage(spark, d):
    sims = pairwise_similarity(spark, d).join(table(spark, d, "nation").select(F.col("n_name").alias("one"), F.col("n_regionkey").alias("region")), "one")
    return C.linkage_clusters(sims.select("region", F.col("one").alias("i"), F.col("two").alias("j"), F.col("identity").alias("s")), "region", 12.0)


def gap_counts(spark, d):
    gapped = F.regexp_replace("text", "[aeiou]", "-")
    rows = table(spark, d, "documents").select("lang", inner_gap_runs(gapped).alias("runs"), F.regexp_count(gapped, F.lit("-")).alias("gaps"))
    return rows.groupBy("lang").agg(F.sum("runs").cast("long").alias("runs"), F.sum("gaps").cast("long").alias("gaps"))


def md5_dedup(spark, d):
    return Q.unique_by_hash(table(spark, d, "documents"), "text", ["doc_id"])


def date_filtered_first(spark, d):
    return Q.earliest_before(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey"], "1996-01-01").select("o_custkey", "o_orderkey")


def removal_accounting(spark, d):
    before = table(spark, d, "lineitem")
    after = before.where("l_discount > 0.02 and l_quantity > 5")
    return Q.removal_counts(before, after, ["l_returnflag"], {"orders": "l_orderkey", "parts": "l_partkey"})


def repeated_numbers(spark, d):
    return Q.repeated_numbers(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey")


def complete_prefixes(spark, d):
    return Q.complete_sets(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


def missing_customers(spark, d):
    return Q.missing_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def result_arrays(spark, d):
    lines = table(spark, d, "lineitem")
    known = lines.where("l_discount > 0.03").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("s"))
    out = score_arrays(lines.select("l_orderkey", "l_linenumber").distinct(), known, ["l_orderkey"], "l_linenumber", "s")
    return out.select("l_orderkey", F.array_join(F.transform("scores", lambda v: F.when(v.isNull(), "null").otherwise(F.round(v * 1000).cast("long").cast("string"))), ",").alias("scores"))


QUERIES = {f.__name__: f for f in (triplet_groups, triplet_potential, state_smoothing, run_segments, zscore_refset, zscore_unsized, agreement_logodds, match_fraction, nearest_bucket_error, nan_mean, lstsq_fit, linear_predict, null_pattern_scorer, feature_group_select, mlp_predict, one_hot_counts, constraint_function, constraint_score, pairwise_similarity, cluster_avg_linkage, gap_counts, md5_dedup, date_filtered_first, removal_accounting, repeated_numbers, complete_prefixes, missing_customers, result_arrays)}

_TRIPLETS = """t AS (SELECT *, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'error' THEN 1 WHEN n IN ('error', 'purchase') THEN 2 WHEN event_type IN ('click', 'view') THEN 3 ELSE 4 END AS g FROM t WHERE p IS NOT NULL AND n IS NOT NULL)"""
_TEMPLATES = f"""p AS (SELECT label, (vec_id % {RESIDUES})::INT AS pos, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y, avg(embedding[3]::DOUBLE) AS z FROM embeddings GROUP BY ALL),
d AS (SELECT a.label, a.pos AS i, b.pos AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM p a JOIN p b ON a.label = b.label AND a.pos < b.pos),
e AS (SELECT i, j, label % 4 AS cluster, exp(label % 4 * 0.5) AS weight, floor(d * 1000) / 1000 AS d FROM d WHERE d < {CUTOFF}),
n AS (SELECT i, j, cluster, count(*) AS n, any_value(weight) AS w FROM e GROUP BY ALL), s AS (SELECT i, j, sum(w) AS t, count(*) AS num_clusters FROM n GROUP BY ALL),
v AS (SELECT i, j, var_pop(d) AS variance FROM e GROUP BY ALL),
f AS (SELECT e.i, e.j, any_value(s.num_clusters)::BIGINT AS num_clusters, any_value(v.variance) AS variance, k.k, sum(n.w / s.t / n.n * exp(-0.5 * (e.d - k.k * {STEP}) * (e.d - k.k * {STEP}))) AS v
  FROM e JOIN n USING (i, j, cluster) JOIN s USING (i, j) JOIN v USING (i, j) CROSS JOIN (SELECT unnest(range(11))::INT AS k) k GROUP BY e.i, e.j, k.k)"""
_Z = "z1 AS (SELECT ((p_size - 25.0::DOUBLE) / 15) AS a, (p_retailprice - 1500) / 400 AS b, ((p_partkey % 10) / 100.0::DOUBLE - 0.05) / 0.03 AS c, p_partkey FROM part)"

ORACLES = {
    "triplet_groups": f"WITH {_TRIPLETS} SELECT g, count(*)::BIGINT AS n FROM g GROUP BY g",
    "triplet_potential": f"""WITH {_TRIPLETS}, c AS (SELECT g, least(floor(value / 10), 9)::INT AS bin, count(*)::DOUBLE AS w FROM g GROUP BY ALL), k AS (SELECT DISTINCT g FROM c),
      h AS (SELECT k.g, b.bin, coalesce(c.w, 0) AS w FROM k CROSS JOIN (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN c ON c.g = k.g AND c.bin = b.bin),
      u AS (SELECT *, sum(w) OVER (PARTITION BY g) AS n, sum(w) OVER (PARTITION BY bin) AS nb, sum(w) OVER () AS al FROM h)
      SELECT g, bin, round(ln(1 + 0.02 * n) - ln(1 + 0.02 * n * coalesce((w / n) / nullif(nb / al, 0), 0)), 6) AS e FROM u""",
    "state_smoothing": "WITH t AS (SELECT user_id, event_type, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (p = event_type OR n = event_type))::BIGINT AS kept FROM t GROUP BY user_id",
    "run_segments": """WITH t AS (SELECT user_id, event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM t)
      SELECT user_id, run::BIGINT AS run, event_type, min(rn)::BIGINT AS start, max(rn)::BIGINT AS "end", count(*)::BIGINT AS n FROM r GROUP BY user_id, run, event_type""",
    "zscore_refset": """WITH o AS (SELECT o_custkey, floor(sum(o_totalprice) / 10000)::BIGINT AS size, avg(o_totalprice) AS price FROM orders GROUP BY o_custkey),
      m AS (SELECT *, greatest(40, least(600, size)) AS s FROM o), u AS (SELECT DISTINCT s FROM m), r AS (SELECT u.s, avg(o.price) AS mean, stddev_samp(o.price) AS sd FROM u JOIN o ON o.size BETWEEN floor(u.s * 0.9::DOUBLE) AND floor(u.s * 1.1::DOUBLE) GROUP BY u.s)
      SELECT o_custkey, round((price - mean) / nullif(sd, 0), 5) AS z FROM m LEFT JOIN r USING (s)""",
    "zscore_unsized": """WITH o AS (SELECT o_custkey, floor(sum(o_totalprice) / 10000)::BIGINT AS size, avg(o_totalprice) AS price FROM orders GROUP BY o_custkey),
      m AS (SELECT o_custkey, price, CASE WHEN o_custkey % 3 <> 0 THEN greatest(40, least(600, size)) END AS s FROM o), u AS (SELECT DISTINCT s FROM m WHERE s IS NOT NULL), r AS (SELECT u.s, avg(o.price) AS mean, stddev_samp(o.price) AS sd FROM u JOIN o ON o.size BETWEEN floor(u.s * 0.9::DOUBLE) AND floor(u.s * 1.1::DOUBLE) GROUP BY u.s)
      SELECT o_custkey, round((price - mean) / nullif(sd, 0), 4) AS z FROM m LEFT JOIN r ON m.s = r.s""",
    "agreement_logodds": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS w FROM orders GROUP BY ALL)
      SELECT o_orderstatus, o_orderpriority, round(ln(w * sum(w) OVER () / (sum(w) OVER (PARTITION BY o_orderstatus) * sum(w) OVER (PARTITION BY o_orderpriority))), 6) AS log_odds FROM c""",
    "match_fraction": "SELECT year(l_shipdate)::INT AS year, round(avg(CASE WHEN l_linestatus IN ('F', 'O') THEN ((CASE WHEN l_quantity < 25 THEN 'F' ELSE 'O' END) = l_linestatus)::INT::DOUBLE END), 6) AS m FROM lineitem GROUP BY ALL",
    "nearest_bucket_error": "WITH t(spot, e) AS (VALUES " + ", ".join(f"({a}, {b}::DOUBLE)" for a, b in ERRORS) + "), r AS (SELECT p_partkey, e, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(spot - p_size), spot) AS k FROM part CROSS JOIN t) SELECT p_partkey, e AS error FROM r WHERE k = 1",
    "nan_mean": "WITH m AS (SELECT l_suppkey, avg(CASE WHEN l_tax <= 0.05 THEN l_extendedprice END) AS m FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(m, 4) AS mean, round(coalesce(greatest(0, least(1, m / 40000)), 0), 6)::DOUBLE AS held FROM m",
    "lstsq_fit": "SELECT l_returnflag, count(*)::BIGINT AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY l_returnflag",
    "linear_predict": "WITH f AS (SELECT l_returnflag, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(avg(abs(a + b * l_quantity - l_extendedprice)), 2) AS error FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag",
    "null_pattern_scorer": """WITH r AS (SELECT l_linestatus, l_linenumber, l_extendedprice AS y, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS q, CASE WHEN l_linenumber < 4 THEN l_discount END AS c FROM lineitem),
      q AS (SELECT l_linestatus, regr_intercept(y, q) AS a, regr_slope(y, q) AS b FROM r WHERE q IS NOT NULL GROUP BY l_linestatus), c AS (SELECT l_linestatus, regr_intercept(y, c) AS a, regr_slope(y, c) AS b FROM r WHERE c IS NOT NULL GROUP BY l_linestatus),
      b AS (SELECT l_linestatus, avg(q) AS mq, avg(c) AS mc, avg(y) AS my, var_pop(q) AS vq, var_pop(c) AS vc, covar_pop(q, c) AS vqc, covar_pop(q, y) AS vqy, covar_pop(c, y) AS vcy FROM r WHERE q IS NOT NULL AND c IS NOT NULL GROUP BY l_linestatus),
      w AS (SELECT *, (vqy * vc - vcy * vqc) / (vq * vc - vqc * vqc) AS bq, (vcy * vq - vqy * vqc) / (vq * vc - vqc * vqc) AS bc FROM b),
      s AS (SELECT r.l_linestatus, r.l_linenumber, CASE WHEN r.q IS NOT NULL AND r.c IS NOT NULL THEN w.my + w.bq * (r.q - w.mq) + w.bc * (r.c - w.mc) WHEN r.q IS NOT NULL THEN q.a + q.b * r.q WHEN r.c IS NOT NULL THEN c.a + c.b * r.c END AS score FROM r JOIN q USING (l_linestatus) JOIN c USING (l_linestatus) JOIN w USING (l_linestatus))
      SELECT l_linestatus, l_linenumber, count(score)::BIGINT AS n, round(avg(score), 2) AS score FROM s GROUP BY ALL""",
    "feature_group_select": "SELECT CASE WHEN l_quantity > 10 AND l_discount > 0.03 AND l_tax > 0.02 THEN 0 WHEN l_quantity > 10 AND l_discount > 0.03 THEN 1 WHEN l_discount > 0.03 AND l_tax > 0.02 THEN 2 WHEN l_quantity > 10 THEN 3 END AS g, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL",
    "mlp_predict": f"WITH {_Z} SELECT p_partkey, round(0.05 + 0.7 * greatest(0.1 + 0.5 * a - 0.25 * b + 0.1 * c, 0) - 0.4 * greatest(-0.2 - 0.3 * a + 0.8 * b + 0.2 * c, 0), 4)::DOUBLE AS y FROM z1",
    "one_hot_counts": "WITH c AS (SELECT upper(substr(p_type, 1, 1)) AS c FROM part) SELECT c, sum((c = 'E')::INT)::DOUBLE AS n0, sum((c = 'P')::INT)::DOUBLE AS n1, sum((c = 'S')::INT)::DOUBLE AS n2 FROM c GROUP BY c",
    "constraint_function": f"WITH {_TEMPLATES} SELECT i, j, num_clusters, round(variance, 8) AS variance, k, round(v, 6) AS v FROM f",
    "constraint_score": f"""WITH {_TEMPLATES}, m AS (SELECT label, i, j, d, floor(d / {STEP}::DOUBLE)::INT AS k FROM d WHERE d < {CUTOFF}),
      x AS (SELECT m.label, m.i, m.j, lo.num_clusters, lo.variance, lo.v * (1 - (m.d / {STEP}::DOUBLE - m.k)) + hi.v * (m.d / {STEP}::DOUBLE - m.k) AS s FROM m JOIN f lo ON lo.i = m.i AND lo.j = m.j AND lo.k = m.k LEFT JOIN f hi ON hi.i = m.i AND hi.j = m.j AND hi.k = m.k + 1)
      SELECT label, res, round(avg(s), 6) AS score, count(s)::BIGINT AS count, round(avg(num_clusters), 6) AS clusters, round(avg(variance), 8) AS variance FROM (SELECT label, unnest([i, j]) AS res, s, num_clusters, variance FROM x) GROUP BY label, res""",
    "pairwise_similarity": """WITH n AS (SELECT n_regionkey, n_name, unnest(range(1, 15)) AS col FROM nation), c AS (SELECT n_regionkey, n_name, col, substr(rpad(n_name, 14, '-'), col::INT, 1) AS c FROM n)
      SELECT a.n_name AS one, b.n_name AS two, round(avg((a.c = b.c)::INT::DOUBLE) * 100, 6) AS identity FROM c a JOIN c b ON a.n_regionkey = b.n_regionkey AND a.col = b.col AND a.n_name < b.n_name WHERE a.c <> '-' AND b.c <> '-' GROUP BY ALL""",
    "gap_counts": "WITH g AS (SELECT lang, regexp_replace(text, '[aeiou]', '-', 'g') AS t FROM documents) SELECT lang, sum(len(regexp_extract_all(trim(t, '-'), '-+')))::BIGINT AS runs, sum(len(t) - len(replace(t, '-', '')))::BIGINT AS gaps FROM g GROUP BY lang",
    "md5_dedup": "SELECT md5(text) AS hash, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "date_filtered_first": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderdate < DATE '1996-01-01') WHERE k = 1",
    "removal_accounting": "SELECT l_returnflag, (count(DISTINCT l_orderkey) - count(DISTINCT l_orderkey) FILTER (l_discount > 0.02 AND l_quantity > 5))::BIGINT AS orders_removed, (count(DISTINCT l_partkey) - count(DISTINCT l_partkey) FILTER (l_discount > 0.02 AND l_quantity > 5))::BIGINT AS parts_removed FROM lineitem GROUP BY l_returnflag",
    "repeated_numbers": "SELECT l_orderkey, l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "complete_prefixes": "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3",
    "missing_customers": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "result_arrays": """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), k AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS s FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL)
      SELECT l_orderkey, string_agg(coalesce(round(s * 1000)::BIGINT::VARCHAR, 'null'), ',' ORDER BY l_linenumber) AS scores FROM p LEFT JOIN k USING (l_orderkey, l_linenumber) GROUP BY l_orderkey""",
}
