import random
import re

import numpy as np
import pytest

from latticework.llm import ngram_join as J


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, similar=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similar * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr), links


def texts(seed, n, sizes=(1, 2, 4, 5, 7, 9, 12, 20, 39, 43, 44, 48, 60, 100, 300)):
    """Chains of edits near the threshold, copies, and texts that share long passages without being linked."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(80)]
    out = []
    while len(out) < n:
        size = r.choice(sizes)
        words = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
        if r.random() < 0.3:
            words = words[: size // 2] + passage[: r.choice([5, 30, 80])]
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            out.append(r.choice([" ", "\n"]).join(words))
            words = list(words)
            for _ in range(r.choice([0, 1, max(1, len(words) // 60), max(1, len(words) // 40)])):
                k = r.randrange(len(words))
                kind = r.random()
                if kind < 0.4:
                    words[k] = words[k].upper() if r.random() < 0.3 else f"e{r.randint(0, 10**6)}"
                elif kind < 0.7 and len(words) > 1:
                    del words[k]
                else:
                    words.insert(k, f"i{r.randint(0, 10**6)}")
    return out[:n]


def test_frequent_ngrams_are_counted(monkeypatch):
    monkeypatch.setattr(J, "COUNTED", 50)
    monkeypatch.setattr(J, "FREQUENT", 5)
    c = J.Counts()
    for i in range(40):
        c.add(np.array([1, 2, 100 + i] if i % 2 else [1, 200 + i], np.uint64))
    c.settle()
    assert dict(zip(c.kept.tolist(), c.times.tolist())) == {1: 40, 2: 20}


def run(spark, rows, **args):
    docs = spark.createDataFrame([(*x, "k", "n", 1) for x in rows], "doc_id long, text string, key string, n string, grp int")
    return sorted(map(tuple, J.jaccard_components(docs, **args).collect()), key=repr)


def test_linked_sets_have_a_part_in_common():
    r = random.Random(4)
    for n in [*range(1, 130), 150, 199, 260, 400, 1000, 5000]:
        for similar in (80, 85, 93):
            for _ in range(3):
                most = 100 * n // similar  # the larger set, and how far both may differ
                size = r.randint(n, most)
                common = -(-similar * (n + size) // (100 + similar))
                if common > n:
                    continue
                hashes = [r.getrandbits(64) for _ in range(n + size - common)]
                a, b = (np.array(sorted(x), np.uint64) for x in (hashes[:n], hashes[n - common :]))
                assert len(a) == n and len(b) == size
                often = np.sort(np.array(r.sample(hashes, r.choice([0, len(hashes) // 2, len(hashes)])) + [7], np.uint64))
                if len(a) != len(b) or (a != b).any():
                    assert np.intersect1d(J.part_keys(a, similar, often), J.part_keys(b, similar, often)).size, (n, size, similar, len(often))
                    assert np.intersect1d(J.part_keys(a, similar), J.part_keys(b, similar)).size, (n, size, similar)


def test_parts_that_are_empty(monkeypatch):
    """Sets of very unequal parts: where many are empty, empty ones count too."""
    monkeypatch.setattr(J, "LEAST_CUT", 10)
    J.schemes.cache_clear()
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(20, 80)
        h = [r.getrandbits(64) >> r.choice([0, 3, 6]) for _ in range(n)]
        cut = max(1, int(n * 0.07))
        a, b = np.unique(np.array(h, np.uint64)), np.unique(np.array(h[cut:] + [r.getrandbits(64) for _ in range(cut)], np.uint64))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert np.intersect1d(J.part_keys(a), J.part_keys(b)).size
    J.schemes.cache_clear()


def test_components_are_brute_force(spark):
    found = texts(1, 700)
    rows = [(i * 3 % 701, t) for i, t in enumerate(found)]
    rows += [(5, None), (800, ""), (801, " \n"), (None, rows[10][1]), (None, "only null id"), (None, None), (rows[3][0], rows[3][1]), (rows[4][0], found[200]), (802, "long " * 30_000), (803, "word " * 3), (804, "x" * 100_000), (805, "WORD  word word")]
    want, links = brute(rows)
    assert links > 150 and run(spark, rows) == want
    assert run(spark, rows, similar=93) == brute(rows, 93)[0]
    assert run(spark, []) == []


@pytest.mark.parametrize("docs,pivots,split,least", [(20, 4, 0.7, 1), (60, 6, 0.9, 1)])
def test_large_groups_are_divided(spark, monkeypatch, docs, pivots, split, least):
    r = random.Random(docs)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3, 5])):
            words[r.randrange(90)] = f"e{r.randint(0, 5)}" if r.random() < 0.5 else f"e{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(J, "GROUP_DOCS", docs)
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "SPLIT", split)
    levels, divided = [], J._divided
    monkeypatch.setattr(J, "_divided", lambda *a: levels.append(a) or divided(*a))
    want, links = brute(rows)
    assert links > 300 and 5 < len({w[2] for w in want}) < 240 and run(spark, rows) == want and len(levels) >= least


def test_metric_join(monkeypatch):
    monkeypatch.setattr(J, "LEAF", 3)
    for seed in range(6):
        r = random.Random(seed)
        base = [f"w{i}" for i in range(60)]
        rows = []
        for i in range(150):
            words = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                words[r.randrange(60)] = f"e{r.randint(0, 3)}" if seed % 2 else f"e{i}"
            rows.append((i, " ".join(words)))
        keys = list(range(150))
        sets = [J.ngrams(t.encode(), 4) for _, t in rows]
        up = J.Forest(keys)
        for a, b in J.group_links(keys, keys, sets, 85):
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
            up.join(a, b)
        assert [up.root(i) for i in keys] == [c for _, _, c in sorted(brute(rows)[0])]


def test_ngrams_of_large_groups_stay_where_they_are(spark, monkeypatch):
    """Pivots are few: their n-grams go to the others', which are not shuffled to meet them; either way gives the same."""
    r, staged, stage = random.Random(8), {}, J.stage
    rows = [(1, k, 30, sorted(r.sample(range(90), 30)), 24) for k in range(24)]
    large = spark.createDataFrame(rows, "grp long, key long, n long, set array<long>, docs long")
    monkeypatch.setattr(J, "stage", lambda df, label: staged.setdefault(label, df) and stage(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for most in (1 << 19, 0):
            staged.clear()
            monkeypatch.setattr(J, "SENT_NGRAMS", most)
            links, cells = J._divided(large, 0, 80)
            got.append((sorted(map(tuple, links.collect())), sorted(map(tuple, cells.collect()), key=str)))
            assert ("ResolvedHint (strategy=broadcast)" in staged["pivots"]._jdf.queryExecution().analyzed().toString()) == (most > 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and got[0][1]


def test_linked_sets_have_as_many_parts_in_common_as_they_need():
    r, most = random.Random(11), 0
    for n in [*range(1, 60), 75, 130, 260, 1000, 3000]:
        for similar in (80, 85, 93):
            size = r.randint(n, 100 * n // similar)
            common = min(n, -(-similar * (n + size) // (100 + similar)))
            hashes = [r.getrandbits(64) for _ in range(n + size - common)]
            a, b = (np.array(sorted(x), np.uint64) for x in (hashes[:n], hashes[n - common :]))
            if len(a) == len(b) and (a == b).all() or 100 * common < similar * len(hashes):
                continue
            for often in (None, np.sort(np.array(r.sample(hashes, r.choice([1, len(hashes) // 2, len(hashes)])), np.uint64))):
                (x, p), (y, q) = (J.needed_parts(s, similar, often) for s in (a, b))
                assert len(np.intersect1d(x, y)) >= max(p, q), (n, size, similar, often is None)
                most = max(most, p, q)
    assert most > 50


def test_a_passage_in_common_does_not_tie_documents(spark):
    r = random.Random(12)
    words = lambda k: [f"w{r.randint(0, 10**9)}" for _ in range(k)]
    passage, copy = words(150), words(400)
    rows = [(i, " ".join(words(200) + passage + words(200))) for i in range(12)]
    rows += [(100 + i, " ".join([*copy[:k], "new", *copy[k:]])) for i, k in enumerate((50, 150, 250))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = {(J.xxhash.xxh64_intdigest(J.ngrams(t.encode(), 5).tobytes()) - (1 << 63)) >> J.NEED_BITS: i for i, t in rows}
    got = {(name[a], name[b]) for a, b in J.candidate_links(docs, "doc_id", "text", 5, 80, np.empty(0, np.uint64)).collect()}
    assert {tuple(sorted(x)) for x in got} == {(100, 101), (100, 102), (101, 102)}


def test_parts_of_many_sets_over_batches(spark, monkeypatch):
    """Few sets to a pair's part, and batches that end within a part: the same components."""
    rows = list(enumerate(texts(13, 300)))
    want = brute(rows)[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for met in (1, 3):
            monkeypatch.setattr(J, "MET", met)
            assert run(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_passage_of_many_documents_ties_none_and_many_copies_stay_linked(spark):
    """A passage that over MET documents have joined them all, through parts of few n-grams of it."""
    r = random.Random(14)
    words = lambda k: [f"w{r.randint(0, 10**9)}" for _ in range(k)]
    passage, copy = words(60), words(300)
    rows = [(i, " ".join(words(60) + passage + words(60))) for i in range(3 * J.MET)]
    rows += [(1000 + i, " ".join([*copy[: 3 * i], "new", *copy[3 * i :]])) for i in range(2 * J.MET)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = {(J.xxhash.xxh64_intdigest(J.ngrams(t.encode(), 5).tobytes()) - (1 << 63)) >> J.NEED_BITS: i for i, t in rows}
    links = J.candidate_links(docs, "doc_id", "text", 5, 80, np.empty(0, np.uint64))
    groups = {}
    for x in J.connected_components(links).collect():
        groups.setdefault(x["root"], set()).update({name[x["node"]]} if x["node"] in name else ())
    assert [g for g in groups.values() if len(g) > 1] == [{i for i, _ in rows if i >= 1000}]
    found = {x["doc"]: x["component"] for x in J.jaccard_components(docs, width=5, similar=80).collect()}
    assert found == {i: min(i, 1000) for i, _ in rows}
