"""Alignments to full sequences, profiles and template scores."""

import math
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import alignment as A
from latticework.operators import templates as T
from latticework.operators.models import GroupScorer, Network

LETTERS = "ACDE"


def best_score(t, s, matrix, gaps):
    m, n = len(t), len(s)
    h, e, f = ([[v] * (n + 1) for _ in range(m + 1)] for v in (0, A.LOW, A.LOW))
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] + gaps.open, e[i][j - 1] + gaps.extend)
            f[i][j] = max(h[i - 1][j] + gaps.open, f[i - 1][j] + gaps.extend)
            h[i][j] = max(h[i - 1][j - 1] + matrix[LETTERS.index(t[i - 1]), LETTERS.index(s[j - 1])], e[i][j], f[i][j])
    return max([h[m][j] for j in range(n + 1)] + [h[i][n] for i in range(m + 1)])


def worth(a, b, matrix, gaps):
    sides = [0 if x != "-" and y != "-" else 1 if y == "-" else 2 for x, y in zip(a, b)]
    runs = [(side, list(own)) for side, own in groupby(range(len(a)), key=lambda k: sides[k])]
    total = 0
    for i, (side, own) in enumerate(runs):
        if side == 0:
            total += sum(matrix[LETTERS.index(a[k]), LETTERS.index(b[k])] for k in own)
        elif 0 < i < len(runs) - 1:
            total += gaps.open + gaps.extend * (len(own) - 1)
    return total


def test_alignments_are_the_best():
    r = random.Random(1)
    for _ in range(40):
        matrix = np.array([[r.randint(-4, 6) for _ in LETTERS] for _ in LETTERS], np.int32)
        gaps = A.Gaps(-r.randint(3, 6), -r.randint(1, 3))
        pairs = [tuple("".join(r.choice(LETTERS) for _ in range(r.randint(0, 14))) for _ in "ts") for _ in range(20)]
        codes = [np.array([[LETTERS.index(c) for c in p[k]] + [0] * (14 - len(p[k])) for p in pairs]) for k in (0, 1)]
        sizes = [np.array([len(p[k]) for p in pairs]) for k in (0, 1)]
        scores, steps = A.semi_global(*codes, *sizes, matrix, gaps)
        for (t, s), score, own in zip(pairs, scores, steps):
            a, b = A.gapped(t, s, own)
            assert a.replace("-", "") == t and b.replace("-", "") == s and len(a) == len(b)
            assert score == best_score(t, s, matrix, gaps) == worth(a, b, matrix, gaps)


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([(a, b, 5 if a == b else -9) for a in LETTERS for b in LETTERS], "a string, b string, s int")


def chain(name, sequence, s, first):
    return [(name, k, c, sequence) for k, c in enumerate(s, first)]


def test_chains_get_columns(spark, letters, monkeypatch):
    monkeypatch.setattr(A, "BATCH_CELLS", 100)
    full = "ACDEACCDDEEACDEA"
    rows = chain("good", full, full[3:9], 4) + chain("off", full, full[3:9], 9) + chain("gap", full, full[1:5] + full[9:], 1) + chain("whole", full, full, 1)
    data = spark.createDataFrame(rows, "name string, rnum int, aa string, sequence string")
    got = {}
    for r in A.chain_columns(data, letters, ["name"]).orderBy("col").collect():
        t, s, p, fell = got.get(r["name"], ("", "", [], None))
        got[r["name"]] = (t + r["t"], s + r["s"], p + [(r["t_pos"], r["s_pos"])] * (r["s_pos"] is not None), r["fallback"])
    assert all(t == full for t, *_ in got.values())
    assert got["good"][1] == got["off"][1] == "---EACCDD-------" and got["gap"][1] == "-CDEA----EEACDEA" and got["whole"][1] == full
    assert [got[k][3] for k in ("good", "off", "gap", "whole")] == [False, True, True, False]
    assert got["off"][2][0] == (4, 1) and got["good"][2][-1] == (9, 6)


def test_a_residue_that_the_sequence_lacks_is_an_error(spark, letters):
    data = spark.createDataFrame(chain("bad", "ACDEACDE", "ACDEEEACDE", 1), "name string, rnum int, aa string, sequence string")
    with pytest.raises(Exception, match="does not fit its sequence: bad"):
        A.chain_columns(data, letters, ["name"]).select("name").collect()


def test_alignments_of_odd_inputs(spark, letters, monkeypatch):
    data = spark.createDataFrame([(1, None, "ACD", "k"), (2, "", "", "k"), (3, "AXC", "AXC", "k"), (4, "A" * 400, "A" * 300, "k")], "id int, t string, s string, t_aligned string")
    got = {r["id"]: (r["t_aligned"], r["s_aligned"], r["alignment_score"]) for r in A.aligned(data, letters).collect()}
    assert got[1] == ("---", "ACD", 0) and got[2] == ("", "", 0) and got[3][2] == 5 - 9 + 5
    assert got[4][2] == 1500 and len(got[4][0]) == 400
    monkeypatch.setattr(A, "MOST_CELLS", 10)
    assert A.aligned(data.limit(0), letters).count() == 0


def test_profiles(spark):
    profile = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [0.0, 0.0]), ("q", 1, [0.5, 0.5]), ("q", 2, [0.0, 1.0])], "file string, pos int, freqs array<double>")
    conditional = spark.createDataFrame([("A", "A", 0.9), ("A", "C", 0.2), ("C", "A", 0.1), ("C", "C", 0.8)], "a string, b string, p double")
    background = spark.createDataFrame([("A", 0.6), ("C", 0.4)], "a string, p double")
    mixed = {(r["file"], r["pos"]): r["freqs"] for r in T.with_pseudo_counts(profile, conditional, background, "AC", 0.5, 0.1).collect()}
    assert mixed["p", 1] == pytest.approx([0.9 * (0.5 + 0.45) + 0.06, 0.9 * 0.05 + 0.04]) and mixed["p", 2] == [0.6, 0.4]
    columns = spark.createDataFrame([("x", "p", "q", 1, 1), ("x", "p", "q", None, 2), ("x", "p", "q", 2, None), ("y", "p", "q", 2, 2), ("z", "p", "none", 1, 1)], "aln string, file string, other string, t_pos int, s_pos int")
    own, other = profile.where("file = 'p'"), profile.withColumnRenamed("file", "other")
    got = {r["aln"]: r for r in T.profile_scores(columns, own, other, background, ["aln", "file", "other"], ["file"], ["other"], "AC").collect()}
    assert got["x"]["profile_score"] == pytest.approx(math.log2(1.0 * 0.5 / 0.6)) and got["x"]["profile_columns"] == 1
    assert got["y"]["profile_score"] is None and got["z"]["profile_columns"] == 0 and got["z"]["avg_entropy"] == 0
    with pytest.raises(KeyError):
        T.with_pseudo_counts(profile, conditional, background, "ACD")


def test_template_score_is_that_of_the_first_whole_group(spark, letters):
    alignments = spark.createDataFrame([(1, "AC-DE", "ACC-E"), (2, "ACDE", "AC--"), (3, "AC", "--")], "id int, t string, s string")
    raw = spark.createDataFrame([(1, 0.2), (3, None)], "id int, dist_const double")
    net = lambda w, b: Network([0.0], [1.0]).add_layer([[w]], [b], False)
    scorer = GroupScorer([["dist_const"], ["seqres_coverage"], ["never"]], [net(2.0, 0.1), net(3.0, 0.0), net(1.0, 1.0)])
    got = {r["id"]: r for r in T.template_scores(alignments, letters, ["id"], scorer, raw).collect()}
    assert got[1]["template_score"] == pytest.approx(0.5) and got[2]["template_score"] == 1.0 and got[3]["template_score"] == 0.0
    assert got[1]["never"] is None and got[3]["seq_id"] is None
    with pytest.raises(ValueError, match="given twice: dist_const"):
        T.template_scores(alignments, letters, ["id"], scorer, raw, raw)


def test_an_alignment_of_another_sequence_is_an_error(spark):
    alignments = spark.createDataFrame([(1, "AC-DE", "ACC-E")], "id int, t string, s string")
    good, bad = (spark.createDataFrame([(1, x)], "id int, sequence string") for x in ("ACDE", "ACDF"))
    assert T.of_its_sequence(alignments, good, ["id"]).select("id").count() == 1
    for other in (bad, good.limit(0)):
        with pytest.raises(Exception, match="is not its sequence: 1"):
            T.of_its_sequence(alignments, other, ["id"]).select(F.lit(1)).collect()
