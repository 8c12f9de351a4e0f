import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import decontamination as D
from latticework.llm import language_id as L
from latticework.llm import line_dedup, mixing, nearest, quality, simhash, substring_dedup, suffix_dedup, url_filter
from latticework.llm.shared import connected_components, shared_dir, stage

SYLLABLES = "an er on th en in ed ti re st".split()


def prose(words, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


BASE = prose(300, 1)
ITEM = prose(40, 2)
EDGE = [
    (0, BASE, "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, BASE, "en", "a"),
    (3, BASE, "en", "a"),
    (4, prose(60, 3) + "\n" + ITEM + "\n" + prose(60, 4), "fr", "b"),
    (5, "one shared line of text\nx\n" + prose(30, 5), "en", "b"),
    (6, "x\n  ONE shared line of text\t\n" + prose(30, 6), "de", None),
    (7, "long " * 40_000, "en", "a"),
    (8, " ".join(prose(20, 7).split()[:9] + BASE.split()[40:140] + prose(20, 8).split()), "en", "c"),
    (None, BASE, "en", "a"),
    (9, "12345 !!", "en", "c"),
    (10, BASE[:-1] + "q", "en", "c"),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, doc string, perplexity string, score string, n_lines string"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "s", "d", "p", "x", "n") for r in rows], SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_lines(spark, docs, empty):
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(docs, n_batches=3, fanout=2).collect()}
    six = next(r for k, r in out.items() if k[0] == 6)
    assert six["n_dropped"] == 1 and six["text"] == "x\n" + prose(30, 6) and six["key"] == "k"
    assert next(r for k, r in out.items() if k[0] == 5)["n_dropped"] == 0
    assert out[1, None]["n_lines"] == 1 and out[None, BASE]["n_dropped"] == 0
    three = [r for r in line_dedup.dedup_lines(docs).collect() if r["doc_id"] == 3]
    assert len(three) == 2 and all(r["n_dropped"] == 1 and r["text"] == "" for r in three)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_batches_do_not_matter(docs):
    one, many = (sorted(map(str, line_dedup.dedup_lines(docs, n_batches=n, fanout=2).collect())) for n in (1, 5))
    assert one == many


def test_lines_of_any_id_and_column(spark, docs):
    named = docs.select(F.lpad(F.col("doc_id").cast("string"), 3, "0").alias("doc_id"), "text", *[F.lit(n).alias(n) for n in ("doc", "th", "was_", "lines_", "gone_", "row_", "id_", "n", "first")])
    out = line_dedup.dedup_lines(named, n_batches=5, fanout=2, batch_lines=3).collect()
    assert out[0].asDict().keys() == {*named.columns, "n_lines", "n_dropped"} and all(r["first"] == "first" and r["row_"] == "row_" for r in out)
    plain = line_dedup.dedup_lines(docs, n_batches=1).collect()
    assert sorted((int(r["doc_id"]) if r["doc_id"] else -1, str(r["text"]), r["n_dropped"]) for r in out) == sorted((-1 if r["doc_id"] is None else r["doc_id"], str(r["text"]), r["n_dropped"]) for r in plain)


def test_runs_are_read_where_they_lie(spark):
    runs = line_dedup.LineRuns(spark, 9)
    keys = spark.range(50).select(F.col("id").alias("doc"), F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    for _ in range(3):
        found = runs.add(keys)
    assert found.count() == 50 and [r.count() for r in runs.runs()] == [50, 0, 0]
    joined = keys.groupBy("h1", "h2").agg(F.min("doc")).join(runs.runs()[0].hint("merge"), ["h1", "h2"], "left")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_mix(docs, empty):
    out = mixing.mix(docs.drop("size")).collect()
    assert len(out) == len(EDGE) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert next(r for r in out if r["doc_id"] == 1)["size"] == 0
    by = {}
    for r in out:
        by.setdefault(r["target"], []).append(r)
    for target, rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mix_is_plain_sampling_at_any_width(spark):
    """However few rows a stretch may hold, the rows taken are those of one sort by key and prefix sums."""
    r = random.Random(12)
    rows = [(r.choice([i, 7, None]) if i % 5 == 0 else i, r.choice("aaab") if i % 9 else None, r.randint(0, 50), r.choice([1.0, 0.25, None, -2.0])) for i in range(900)]
    rows += [(7, "a", 10, 1.0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, w double")
    keyed = docs.select("doc_id", "source", "n", (-F.ln(mixing.uniform(F.col("doc_id"))) / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)).alias("k")).collect()
    for most in (256, 5):
        got = mixing.mix(docs, size_col="n", weight_col="w", most_rows=most).collect()
        aim = {r["source_size"]: r["target"] for r in got}
        want = []
        for source in {x["source"] for x in keyed}:
            own = sorted((x for x in keyed if x["source"] == source), key=lambda x: (x["k"], x["n"]))
            size = sum(x["n"] for x in own)
            epochs, upto = int(aim[size] // size), 0
            for x in own:
                upto += x["n"]
                want.append((str(x["doc_id"]), x["n"], x["n"] * (epochs + (upto - x["n"] / 2 <= aim[size] - epochs * size))))
        assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted(want)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.example.NET/en/x?q", "http://example.net/de/", "ftp://b.org#f", "https://x.org/fr/1", "http://example.com/de/a", "http://notexample.com/de/a", "http:///p"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert (out[3]["host"], out[3]["path"], out[3]["rule"], out[3]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert out[4]["rule"] == "net/" and out[4]["verdict"] == "block" and out[5]["rule"] is None and out[6]["rule"] == "org/fr/"
    assert out[7]["verdict"] == "block" and out[8]["rule"] is None and out[0]["host"] == "" and out[9]["host"] == ""
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    clash = pages.select("page_id", "url", *[F.lit(7).alias(n) for n in ("bound", "rate", "said", "h", "row_", "host", "verdict", "n", "x")])
    twice = url_filter.judge_urls(clash.unionByName(clash)).collect()
    assert len(twice) == 2 * len(urls) and all(r["bound"] == r["rate"] == r["row_"] == 7 and r["verdict"] == out[r["page_id"]]["verdict"] for r in twice)


def test_suffixes_and_outcomes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.com",), ("w.x.com",), ("",), ("localhost",), ("q.r.s.t",)], "host string")
    sfx = url_filter.suffix(F.col("host"), (*url_filter.SUFFIXES, "r.s.t"))
    got = {r["host"]: (r["s"], r["d"]) for r in hosts.select("host", sfx.alias("s"), url_filter.registered_domain(F.col("host"), sfx).alias("d")).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"), "w.x.com": ("com", "x.com"), "": ("", ""), "localhost": ("localhost", "localhost"), "q.r.s.t": ("r.s.t", "q.r.s.t")}
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.one.com", "new.one.com", "good.two.com", "other.com"])], "page_id long, url string")
    labels = spark.createDataFrame([("bad.one.com", 1)] * 40 + [("worse.one.com", 1)] * 40 + [("good.two.com", 0)] * 40 + [("fine.three.com", 0)] * 40, "host string, bad int")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(), outcomes=labels).collect()}
    assert verdicts == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_language(spark, docs, empty):
    words = {"aa": "ka lo mi", "bb": "zu fe ry"}
    rows = [(i, " ".join(random.Random(i).choice(words[x].split()) for _ in range(30)), x, "s") for i in range(40) for x in [["aa", "bb"][i % 2]]]
    model = L.train(table(spark, rows), L.load_pieces())
    got = model.predict(table(spark, rows)).select("lang", "lang_pred", "score", "key").collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in model.predict(docs).collect()}
    assert [edge[i]["lang_pred"] for i in (1, 2, 9)] == ["und"] * 3 and model.predict(empty).count() == 0
    assert L.train(empty, L.load_pieces()).predict(docs).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab"]
    probs = np.r_[np.array([0.1, 0.2, 0.3, 0.15, 0.15, 0.1]), L.UNKNOWN].reshape(-1, 1)
    p = dict(zip(pieces, probs[:, 0]))
    want = p["▁"] * p["a"] * p["b"] + p["▁a"] * p["b"] + p["▁"] * p["ab"] + p["▁ab"]
    assert abs(np.exp(L.Lattice(pieces).log_probs(["▁ab"], probs))[0, 0] - want) < 1e-12
    counts = L.Lattice(pieces).expected(["▁ab"], np.array([2.0]), np.array([0]), probs)[:, 0]
    assert abs(counts[1] - 2 * p["▁"] * p["a"] * p["b"] / want) < 1e-12


def test_language_is_plain_marginalisation(spark):
    """Scores of whole texts, words of hundreds of characters among them, against one table of prefix probabilities."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "abbab", "é", "日a"]
    r = np.random.default_rng(0)
    probs = np.vstack([r.dirichlet(np.ones(len(pieces)), 3).T * 0.01, np.full((1, 3), L.UNKNOWN)])
    number = {p: i for i, p in enumerate(pieces)}
    texts = ["ab ba\tbabab", "", None, "x" * 40, "".join(random.Random(3).choice("abé日z") for _ in range(700)) + " ab", "123 !", "ab" * 300 + "\n" + "ba" * 50]

    def plain(word, k):
        logs = [0.0]
        for j in range(1, len(word) + 1):
            ways = [logs[j - n] + np.log(probs[number[word[j - n : j]], k]) for n in range(1, min(j, 5) + 1) if word[j - n : j] in number]
            logs.append(np.logaddexp.reduce(ways) if word[j - 1] in number else np.logaddexp.reduce([*ways, logs[j - 1] + np.log(L.UNKNOWN)]))
        return logs[-1]

    want = np.array([[sum(plain("▁" + w, k) for w in (t or "").split() or [""]) for k in range(3)] for t in texts])
    got = L.score_texts(L.Lattice(pieces), probs, pa.array(texts))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    model = L.LanguageModel(["x", "y", "z"], pieces, probs)
    out = {r["doc_id"]: r for r in model.predict(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        share = np.exp(want[i] - np.logaddexp.reduce(want[i]))
        if any(c.isalpha() for c in t or ""):
            assert out[i]["lang_pred"] == "xyz"[share.argmax()] and abs(out[i]["score"] - share.max()) < 1e-6
        else:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment_is_edit_distance():
    r = random.Random(5)
    for _ in range(60):
        item = "".join(r.choice("abc") for _ in range(r.randint(5, 25)))
        text = list("".join(r.choice("abc") for _ in range(r.randint(0, 8))) + item + "".join(r.choice("abc") for _ in range(5)))
        for _ in range(r.randint(0, 3)):
            text[r.randrange(len(text))] = r.choice("abc")
        text = "".join(text)
        got, want = D.banded_alignments(D.codes(item), D.codes(text), np.array([0, 3]), 6)[0], edit_distance_within(item, text)
        assert (got[0] if got else None) == (want if want <= 6 else None)
        if got:
            assert edit_distance_within(item, text[got[1] : got[2]]) == got[0]


def test_filter_finds_what_plain_search_finds():
    r = random.Random(6)
    letters = "abcé日 "
    items = [(i, D.normalise("".join(r.choice(letters) for _ in range(n)))) for i, n in enumerate([0, 1, 3, 7, 8, 11, 12, 16, 17, 20, 34, 40, 60, 90] * 3)]
    index = D.Items(items)
    for _ in range(40):
        text = []
        for _, item in r.sample(items, 4):
            t = list(item)
            for _ in range(r.randint(0, 4)):
                if t:
                    k, how = r.randrange(len(t)), r.choice("xdi")
                    t[k : k + 1] = {"x": [r.choice("abé")], "d": [], "i": [t[k], r.choice("abé")]}[how]
            text += ["".join(r.choice("abc") for _ in range(r.randint(0, 5))), "".join(t)]
        text = D.normalise(" ".join(text))
        got = {name: edits for _, name, edits, *_ in index.matches([text, ""])}
        want = {}
        for i, item in items:
            if len(item) >= D.SHORT:
                if (d := edit_distance_within(item, text)) <= int(D.EDIT_RATE * len(item)):
                    want[i] = d
            elif item and f" {item} " in f" {text} ":
                want[i] = 0
        assert got == want


def test_repetitive_texts_are_searched_in_bounded_work():
    unit = "ab " * 70
    index = D.Items([(1, unit.strip()), (2, unit[:100] + "x" + unit[101:].strip()), (3, prose(40, 9))])
    began = time.time()
    assert [m[1] for m in index.matches([D.normalise("ab " * 350_000)])] == [1, 2]
    assert time.time() - began < 40


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, ITEM.upper()), (2, None), (3, "a b"), (4, prose(40, 99)), (5, ITEM), (6, " "), (7, "!!")], "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert {(r["doc"], r["item"], r["edits"]) for r in got} == {(4, 1, 0), (4, 5, 0), (9, 7, 0)}
    words = ITEM.split()
    words[10], words[30] = "xx" + words[10][2:], words[30] + "e"
    near = table(spark, [(20, prose(50, 21) + " " + "  ".join(words) + "\n" + prose(50, 22), "en", "a"), (21, prose(200, 23), "en", "a")])
    assert [(r["doc"], r["item"]) for r in D.contamination(near, bench.where("item_id = 1")).collect()] == [(20, 1)]
    assert sorted(r["doc_id"] for r in D.decontaminate(near, bench).collect()) == [21]
    assert D.contamination(empty, bench).count() == 0 and D.contamination(docs, bench.limit(0)).count() == 0
    blocks = D.contamination(docs, bench, block_bytes=100).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_nearest_is_exact_at_factor_one(spark):
    r = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(300, 6)))]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0]), (404, [None] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0 or vec_id = 7")
    good = {i: np.array(x) for i, x in rows if i < 400}
    want = set()
    for i in [i for i in good if i % 50 == 0 or i == 7]:
        best = sorted((-float(nearest.cosines(good[i][None], x[None])[0]), j) for j, x in good.items() if j != i)[:5]
        want |= {(i, k + 1, j) for k, (_, j) in enumerate(best)}
    for shard in (50, 10_000):
        got = {(x["query_id"], x["rank"], x["vec_id"]) for x in nearest.nearest(v, q, shard_rows=shard, query_rows=4).collect() if x["query_id"] != 403}
        assert got == want
    loose = {(x["query_id"], x["vec_id"]) for x in nearest.nearest(v, q, factor=1.2).collect()}
    assert len(loose & {(a, c) for a, _, c in want}) >= 0.9 * len(want)
    assert nearest.nearest(v.limit(0), q).count() == 0


def test_nearest_bound_leaves_out_the_own_row():
    r = np.random.default_rng(8)
    centres = r.normal(size=(200, 6))
    near = np.repeat(centres, 5, axis=0) + 1e-4 * r.normal(size=(1000, 6))
    scaled = centres[:1] * np.arange(1, 41)[:, None]
    own = np.repeat(near[:1], 9, axis=0)
    vectors = np.vstack([near, scaled, own])
    ids = np.r_[np.arange(1040), [0] * 8, 1040]  # id 0 nine times, eight of them alike
    asks = np.arange(0, 1040, 3)
    got = nearest.shard_nearest(ids, vectors, asks, vectors[asks], 5, 1.0)
    want = []
    for i in asks:
        best = sorted((-s, j) for s, j in zip(nearest.cosines(np.broadcast_to(vectors[i], vectors.shape), vectors), ids) if j != i)[:5]
        want += [(i, j, -s) for s, j in best]
    assert list(got[["query_id", "vec_id", "score"]].itertuples(index=False, name=None)) == want


def test_nearest_ties_clusters_and_repeated_queries(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + 0.01 * r.normal(size=8)).tolist()) for i in range(600)]
    rows += [(600 + i, (np.eye(8)[0] + np.eye(8)[1 + i % 7]).tolist()) for i in range(126)]  # equal cosines with the first axis
    rows += [(1000, np.eye(8)[0].tolist()), (1000, np.eye(8)[1].tolist())] + [(1001 + i, rows[3][1]) for i in range(200)]
    v = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<double>, row int, cell string")
    q = v.where("vec_id % 50 = 0")
    want = []
    for i, x in rows:
        if i % 50 == 0:
            others = [(j, np.array(y)) for j, y in rows if j != i]
            score = nearest.cosines(np.broadcast_to(np.array(x), (len(others), 8)), np.stack([y for _, y in others]))
            want += [(i, k + 1, j) for k, (_, j) in enumerate(sorted(zip(-score, [j for j, _ in others]))[:5])]
    for shard, pivots in ((40, 256), (40, 3), (100_000, 256)):
        got = [(x["query_id"], x["rank"], x["vec_id"]) for x in nearest.nearest(v, q, shard_rows=shard, query_rows=3, most_pivots=pivots).collect()]
        assert sorted(got) == sorted(want)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(0)
    for _ in range(150):
        t = r.integers(0, r.integers(1, 5) + 1, r.integers(1, 50))
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_common_prefixes():
    r = np.random.default_rng(1)
    for depth in (None, 6):
        for _ in range(150):
            t = r.integers(0, r.integers(1, 4) + 1, r.integers(1, 70))
            order = suffix_dedup.suffix_array(t, depth)
            got = suffix_dedup.common_prefixes(t.astype(np.uint16), order)
            for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
                k = 0
                while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                    k += 1
                assert got[b] == k
            assert got[order[0]] == 0


@pytest.mark.parametrize("hot", [1 << 23, 2000])
def test_repeats_are_brute_force(spark, docs, empty, hot):
    texts = [(i, t or "") for i, t, *_ in EDGE]
    seen = {}
    for n, (_, t) in enumerate(texts):
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], []).append((n, k))
    mark = [np.zeros(len(t) + 1, int) for _, t in texts]
    for v in seen.values():
        if len(v) > 1:
            for n, k in v:
                mark[n][k] += 1
                mark[n][k + 200] -= 1
    want = sorted((str(i), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[np.cumsum(m)[:-1] == 0])).hexdigest()) for (i, t), m in zip(texts, mark))
    out = suffix_dedup.remove_repeats(docs, hot_bytes=hot).collect()
    assert sorted((str(r["doc"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_passages(spark, docs, empty):
    got = {(r["doc"], r["other"]): r for r in substring_dedup.fuzzy_passages(docs).collect()}
    assert (8, 0) in got and got[8, 0]["end"] - got[8, 0]["start"] == 100 and got[8, 0]["other_start"] == 40
    assert (3, 0) in got and (4, 0) not in got
    words = BASE.split()
    for k in (60, 120, 200):
        words[k] = "edit"
    near = table(spark, EDGE[:1] + [(30, " ".join(words), "en", "a"), (31, prose(300, 77), "en", "a")])
    rows = substring_dedup.fuzzy_passages(near).collect()
    assert [(r["doc"], r["other"], r["start"], r["end"]) for r in rows] == [(30, 0, 0, 300)] and rows[0]["similarity"] > 0.98
    assert substring_dedup.fuzzy_passages(empty).count() == 0


def test_passages_made_of_frequent_lines(spark):
    lines = [prose(15, 3000 + i) for i in range(6)]
    rows = [(i, f"{prose(30, 3100 + i)} {t} {prose(30, 3200 + i)}", "en", "a") for i, t in enumerate(lines)]
    rows += [(10 + i, f"{prose(40, 3300 + i)} {' '.join(lines[:4])} {prose(40, 3310 + i)}", "en", "a") for i in range(2)]
    # in the first holder, its own earlier fragments take the seeds
    rows += [(20, f"{' | '.join(lines[4:])} {prose(40, 3320)} {' '.join(lines[4:])} {lines[0]} {prose(40, 3321)}", "en", "a")]
    rows += [(21, f"{prose(40, 3330)} {' '.join(lines[4:])} {lines[0]} {prose(40, 3331)}", "en", "a")]
    got = {(r["doc"], r["other"], r["start"], r["end"], r["other_start"], r["other_end"]) for r in substring_dedup.fuzzy_passages(table(spark, rows)).collect()}
    assert got >= {(11, 10, 40, 100, 40, 100), (21, 20, 40, 85, 71, 116)}


def chain_scores(pts):
    """The best score of a chain that ends at each seed, by trying all predecessors."""
    best = {}
    for x, y in sorted(pts):
        gains = [s - 0.1 * ((x - p - 5) + (y - q - 5)) for (p, q), s in best.items() if p < x and q < y]
        best[x, y] = 5 + max([0.0, *(min(g, s) for g, s in zip(gains, [s for (p, q), s in best.items() if p < x and q < y]))])
    return best


def test_fenwick_chain_is_quadratic_chain():
    r = random.Random(9)
    for _ in range(60):
        pts = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(12)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = chain_scores(pts)
        top = max(best.values())
        got = substring_dedup.chain(x, y, max_gap=1000)
        ends = {(z - 5, oz - 5) for _, z, _, oz in got}
        assert all(a < z and oa < oz for a, z, oa, oz in got)
        assert any(abs(best[e] - top) < 1e-9 for e in ends)  # the best chain is kept whole


def test_passages_shared_with_scattered_pieces(spark):
    """Two documents share 120 words of which a third, earlier one holds pieces of 20 words."""
    shared = prose(120, 4000).split()
    for step in (40, 20, 10):
        pieces = " ".join(f"{prose(25, 4100 + k)} {' '.join(shared[k : k + 20])}" for k in range(0, 101, step))
        rows = [(1, pieces, "en", "a"), *[(i, f"{prose(50, 4200 + i)} {' '.join(shared)} {prose(50, 4300 + i)}", "en", "a") for i in (2, 3)]]
        covered = set()
        for x in substring_dedup.fuzzy_passages(table(spark, rows)).where("doc = 3").collect():
            covered |= set(range(x["start"], x["end"]))
        assert covered >= set(range(50, 170))


def test_edited_passages_shared_with_scattered_pieces(spark):
    """As above with a word in 30 edited in one of three documents."""
    shared = prose(120, 4500).split()
    edited = [f"e{k}" if k % 30 == 15 else w for k, w in enumerate(shared)]
    for step in (40, 20, 10):
        pieces = " ".join(f"{prose(25, 4600 + k)} {' '.join(shared[k : k + 20])}" for k in range(0, 101, step))
        rows = [(1, pieces, "en", "a"), *[(i, f"{prose(50, 4700 + i)} {' '.join(t)} {prose(50, 4800 + i)}", "en", "a") for i, t in ((2, shared), (3, edited), (4, shared))]]
        found = substring_dedup.fuzzy_passages(table(spark, rows)).where("other = 2").collect()
        assert (3, 50, 170, 50, 170) in {(r["doc"], r["start"], r["end"], r["other_start"], r["other_end"]) for r in found}
        assert {k for r in found if r["doc"] == 4 for k in range(r["start"], r["end"])} == set(range(50, 170))


def test_a_line_of_many_texts_does_not_tie_them_all(spark, monkeypatch):
    """Texts with a line in common, each among words of its own, do not all meet; those that share words beyond edits about it too are found."""
    line, before, after = prose(32, 5000), prose(4, 5001), prose(4, 5002)
    rows = [(i, f"{prose(50, 5100 + i)} {line} {prose(50, 5300 + i)}", "en", "a") for i in range(90)]
    rows += [(i, f"{prose(50, 5500 + i)} {before} e{i} {line} f{i} {after} {prose(50, 5510 + i)}", "en", "a") for i in (200, 201, 202)]
    met, chained = [], substring_dedup.met_chains
    monkeypatch.setattr(substring_dedup, "met_chains", lambda linked, pairs, known: met.append(pairs.count()) or chained(linked, pairs, known))
    got = {(r["doc"], r["other"], r["start"], r["end"], r["other_start"], r["other_end"]) for r in substring_dedup.fuzzy_passages(table(spark, rows)).collect()}
    assert got >= {(201, 200, 50, 92, 50, 92), (202, 200, 50, 92, 50, 92)} and all(r[0] >= 200 for r in got)
    assert sum(met) < 10 * len(rows)


def test_passages_leave_no_large_tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "staged"
    before = set(folder.glob("*"))
    text = prose(60, 5600)
    rows = [(i, f"{prose(30, 5610 + i)} {text} {prose(30, 5620 + i)}", "en", "a") for i in range(2)]
    got = substring_dedup.fuzzy_passages(table(spark, rows))
    left = {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before}
    assert not left & {"seeds", "firsts", "stretches", "cuts", "chains", "grams"}
    assert [(r["doc"], r["start"], r["end"]) for r in got.collect()] == [(1, 30, 90)]


def test_words_beside_a_span_are_brute_force():
    words = np.random.default_rng(7).integers(0, 1 << 32, 300).astype(np.uint64)
    h, x, y = substring_dedup.run_hashes(words, 3), np.array([0, 5, 140, 290]), np.array([6, 30, 150, 300])
    got = sorted(zip(*(c.tolist() for c in substring_dedup.side_grams(h, x, y))))
    value = lambda v: int(v.view(np.int64))
    want = [(n, value(h[k]), k + 3 - b) for n, b in enumerate(y) for k in range(298) if 0 < k + 3 - b <= substring_dedup.FAR]
    want += [(n, value(substring_dedup.mixed(h[k : k + 1])[0]), k - a) for n, a in enumerate(x) for k in range(298) if 0 < a - k <= substring_dedup.FAR]
    assert got == sorted((n, g, int(d)) for n, g, d in want)
    assert len(substring_dedup.side_grams(h[:0], x, y)[0]) == 0


def test_least_spans_hold_no_other():
    r = np.random.default_rng(8)
    for n in (0, 1, 5, 60):
        seed, pos = r.integers(0, 4, n), np.sort(r.choice(300, n, replace=False))
        key, i, j = substring_dedup.near_seeds(seed, pos)
        spans = list(zip(key.tolist(), i.tolist(), j.tolist()))
        want = [k for k, (c, a, b) in enumerate(spans) if not any(c == c_ and a <= a_ and b_ <= b and (a, b) != (a_, b_) for c_, a_, b_ in spans)]
        assert substring_dedup.least_spans(key, i, j).tolist() == want


def test_seeds_are_the_least_of_their_windows():
    words = [w.encode() for w in (prose(80, 4900) + " of" * 60 + prose(40, 4901)).split()]
    for n in (1, 3, 12, 40, len(words)):
        h = substring_dedup.run_hashes(words, n)
        assert len(h) == len(words) - n + 1 and len(set(h.tolist())) == len({tuple(words[i : i + n]) for i in range(len(h))})
    h = substring_dedup.run_hashes(words, 5)
    want = sorted({i + int(h[i : i + 12].argmin()) for i in range(len(h) - 11)})
    found, at = substring_dedup.minimizers(words)
    assert at.tolist() == want and found.view(np.uint64).tolist() == h[want].tolist()
    assert substring_dedup.minimizers(words[:7])[1].tolist() == [int(h[:3].argmin())]
    assert len(substring_dedup.minimizers([])[1]) == 0


def test_minimizers_of_texts_together_are_those_of_each():
    r = random.Random(1)
    texts = [(i * 7 % 101, [str(r.randint(0, 9 if i % 3 else 5000)).encode() for _ in range(r.randint(16, 90))]) for i in range(60)]
    h, doc, at = substring_dedup.minimizers_of_each(texts)
    want = [(d, *x) for d, words in texts for x in zip(*(c.tolist() for c in substring_dedup.minimizers(words)))]
    assert list(zip(doc.tolist(), h.tolist(), at.tolist())) == want
    new = substring_dedup.first_seen(h, doc)
    assert [x for x, n in zip(want, new) if n] == [x for k, x in enumerate(want) if x[:2] not in {w[:2] for w in want[:k]}]


def test_open_pairs_of_seeds_are_brute_force():
    """Near seeds that lie together in no span; covered ones are not listed first."""
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 30, 400):
        pos = np.sort(r.integers(0, 4 * n + 1, n))
        seed = r.integers(0, 50, n)
        for count in (0, 1, 6):
            start = np.unique(r.integers(0, 4 * n + 1, count))
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(start, np.maximum.accumulate(start + r.integers(5, 80, len(start))) + np.arange(len(start)))]
            key, i, j = substring_dedup.near_seeds(seed, pos)
            bare = np.array([not any(x["start"] <= pos[a] and pos[b] + substring_dedup.K <= x["end"] for x in spans) for a, b in zip(i, j)], bool)
            got = substring_dedup.near_seeds(seed, pos, substring_dedup.known_ends(pos, r.permutation(spans).tolist()))
            assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(key[bare].tolist(), i[bare].tolist(), j[bare].tolist()))
    pos = np.arange(0, 600_000, 6)
    assert len(substring_dedup.near_seeds(pos, pos, substring_dedup.known_ends(pos, [{"start": 0, "end": 600_010}]))[0]) == 0


def test_short_passages_with_edits(spark):
    words = prose(51, 4400).split()
    edited = [w if k not in (5, 45) else "edit" for k, w in enumerate(words)]
    rows = [(1, f"{prose(40, 4401)} {' '.join(words)} {prose(40, 4402)}", "en", "a"), (2, f"{prose(40, 4403)} {' '.join(edited)} {prose(40, 4404)}", "en", "a")]
    got = substring_dedup.fuzzy_passages(table(spark, rows)).collect()
    assert [(r["doc"], r["other"], r["start"], r["end"]) for r in got] == [(2, 1, 40, 91)]
    twice = table(spark, [*rows, (2, prose(30, 4405), "en", "a"), (1, None, "en", "a")])
    assert len({tuple(map(str, substring_dedup.fuzzy_passages(twice.repartition(n)).collect())) for n in (1, 3)}) == 1


def test_common_words():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([1, 9, 3, 4, 8, 5])
    assert substring_dedup.common_words(a, b) == 4 and substring_dedup.common_words(a, a) == 5


def test_close_pairs_are_brute_force(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {frozenset((x["a"], x["b"])) for x in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_near_duplicates(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    comp = {(r["doc"], r["component"]) for r in out}
    assert len(out) == len(EDGE) and (3, 0) in comp and (2, 1) in comp and (1, 1) in comp and (4, 4) in comp and (None, 0) in comp
    assert {r["fp"] for r in out if r["doc"] in (1, 2)} == {0} and simhash.near_duplicates(empty).count() == 0


def test_fingerprints_and_components_are_brute_force(docs):
    def plain(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [(i, plain(t)) for i, t, *_ in EDGE]
    low = {n: n for n in range(len(fps))}
    for _ in fps:  # as many rounds as rows settle every path
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
    least = {n: min(i for m, (i, _) in enumerate(fps) if low[m] == low[n] and i is not None) for n in low}
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc"]), r["fp"] & (1 << 64) - 1, r["component"]) for r in got) == sorted((str(i), fp, least[n]) for n, (i, fp) in enumerate(fps))


def test_similar_texts_link(spark, docs, empty):
    def edited(text, every, mark):
        return " ".join(mark if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))

    def jaccard(a, b):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
        return len(a & b) / len(a | b)

    texts = [prose(300, 2000 + i) for i in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(100 + i, edited(t, 60, "qqq"), "en", "b") for i, t in enumerate(texts[:20])]
    rows += [(200 + i, edited(t, 8, "zzz"), "en", "b") for i, t in enumerate(texts[20:])]
    assert all(0.8 <= jaccard(rows[i][1], rows[40 + i][1]) < 0.9 for i in range(20)) and all(jaccard(rows[i][1], rows[40 + i][1]) < 0.6 for i in range(20, 40))
    linked = lambda samples: {r["doc"]: r["component"] for r in simhash.near_duplicates(table(spark, rows), width=5, samples=samples).collect()}
    found = linked(16)
    assert sum(found[100 + i] == i for i in range(20)) >= 19 and all(found[200 + i] == 200 + i for i in range(20))
    assert all(found[i] == i for i in range(40)) and sum(linked(0)[100 + i] == i for i in range(20)) < 10
    assert simhash.near_duplicates(docs, width=5, samples=16).count() == len(EDGE) and simhash.near_duplicates(empty, width=5, samples=16).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and 200 not in got


def plain_kneser_ney(texts):
    """p(gram) of every n-gram of the texts that are asked for, by dictionaries."""
    counts = [{} for _ in range(quality.ORDER + 1)]
    for t in texts:
        t = "\n" * (quality.ORDER - 1) + t + "\n"
        for k in range(len(t) - quality.ORDER + 1):
            g = t[k : k + quality.ORDER]
            counts[-1][g] = counts[-1].get(g, 0) + 1
    for n in range(quality.ORDER, 1, -1):
        for g in counts[n]:
            counts[n - 1][g[1:]] = counts[n - 1].get(g[1:], 0) + 1

    def p(g, chars):
        if not g:
            return 1 / chars
        c = counts[len(g)]
        d = [0, *quality.discount(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])]
        own = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total, n = sum(own.values()), c.get(g, 0)
        lower = p(g[1:], chars)
        return (n - d[min(n, 3)]) / total + sum(d[min(v, 3)] for v in own.values()) / total * lower if total else lower

    return p


def test_perplexity_is_plain_kneser_ney(spark):
    texts = [prose(30, 800 + i) + "é日😀"[i % 3] for i in range(14)] + ["", None, "unseen ßø¿ 12"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality long, toxic long")
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.half_of("doc_id").alias("h")).collect()}
    models = [plain_kneser_ney([texts[i] for i in range(8) if half[i] == h]) for h in (0, 1)]
    chars = len({c for t in texts for c in (t or "") + "\n"})
    for size in (quality.BLOCK_BYTES, 500):
        got = {r["doc_id"]: r["perplexity"] for r in quality.classify(docs, labels, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            padded = "\n" * (quality.ORDER - 1) + (t or "") + "\n"
            logs = [np.log(models[1 - half[i]](padded[k : k + quality.ORDER], chars)) for k in range(len(t or "") + 1)]
            assert abs(np.log(got[i]) + np.mean(logs)) < 1e-5


def test_kneser_ney_is_a_distribution(spark):
    r = random.Random(2)
    every = [a + b + c + d for a in "xyz" for b in "xyz" for c in "xyz" for d in "xyz"]
    counts = spark.createDataFrame([(g, r.choice([0, 0, 1, 2, 3, 7]), r.choice([0, 1])) for g in every], "gram string, c0 long, c1 long")
    sums = quality.kneser_ney(counts).groupBy(F.substring("gram", 1, 3)).agg(F.sum("p0").alias("a"), F.sum("p1").alias("b")).collect()
    assert len(sums) == 27 and all(abs(x["a"] - 1) < 1e-9 and abs(x["b"] - 1) < 1e-9 for x in sums)


def test_quality(spark, docs, empty):
    rows = [(i, prose(120, 1000 + i), "en", "a") for i in range(60)] + [(100, "#!%& $$$ ??? " * 60, "en", "a"), (101, None, "en", "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 0)], "doc_id long, quality long, toxic long")
    out = {r["doc_id"]: r for r in quality.classify(table(spark, rows), labels).collect()}
    assert not out[100]["keep"] and out[101]["keep"] and sum(out[i]["keep"] for i in range(60)) >= 57 and out[0]["key"] == "k"
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == len(EDGE)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(empty, labels.limit(0)).count() == 0
    repeated = quality.classify(docs, spark.createDataFrame([(3, 1, 0), (3, 1, 0), (0, 1, 0)], labels.schema)).collect()
    assert len(repeated) == len(EDGE) and len({r['perplexity'] for r in repeated if r['doc_id'] == 3}) == 1


def test_pipeline_against_plain_steps(spark, tmp_path):
    rows = [(i, prose(100, 500 + i) + ("\nthe same line in many texts" if i % 3 == 0 else ""), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(40, "#!%& $$$ ??? " * 60, "en", "a"), (41, rows[1][1].replace(" ", "\n", 1).replace(" ", "\n ", 1), "en", "b"), (42, prose(40, 600) + " " + ITEM + " " + prose(40, 601), "en", "a"), (43, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, str(tmp_path)), "t")
        left.append({r["doc_id"] for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == before.columns
    assert 40 not in left[0] and left[0] >= set(range(40)) - {40} and 43 in left[0]
    assert left[1] == left[0] and 41 not in left[2] and 42 in left[2] and 42 not in left[3]
    assert left[4] <= left[3] and all(0 < r["taken"] <= 2 * r["size"] for r in docs.collect())
    lines = [ln for r in docs.collect() for ln in r["text"].split("\n") if ln == "the same line in many texts"]
    assert len(lines) <= 1


def test_pipeline_stages_on_repeated_and_null_ids(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, BASE, "en", "a"), (None, prose(50, 700), "en", "a"), (3, prose(50, 701), None, None)]
    docs = spark.createDataFrame([(*r, len(r[1]), "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, taken string, doc string")
    first = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and sorted(str(r["doc_id"]) for r in first.collect()) == ["1", "1", "3", "None"]
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    out = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "size", "source_size", "target", "taken"]
    assert len(out) <= 5 and all(r["taken"] in (r["size"], 2 * r["size"]) for r in out) and sorted(r["taken"] for r in out if r["source"] is None) in ([50], [100])
    assert sum(r["taken"] for r in out) >= 1.4 * sum(len(r[1].split()) for r in rows) and None in {r["doc_id"] for r in out}
    assert corpus_pipeline.mixed(spark, docs.limit(0), str(tmp_path)).count() == 0
