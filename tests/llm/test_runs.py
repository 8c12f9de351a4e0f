import hashlib
import random
import zlib

import pytest

from latticework.llm import periodic_runs as P


def brute(words, least=12):
    """Every run by its definition: from every start and period as far as it goes, smallest period of each stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - i >= 2 * p and e + p - i >= least:
                found.setdefault((i, e + p), p)
            i = e
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def nested(r, depth):
    part = [r.choice("abcdef") for _ in range(r.randint(1, 4))]
    for _ in range(depth):
        part = part * r.randint(1, 4) + [r.choice("abcdef") for _ in range(r.randint(0, 3))]
    return part[:400]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_all_runs_of_many_texts(least):
    r = random.Random(least)
    texts = [[r.choice("ab"[: r.randint(1, 2)]) for _ in range(r.randint(0, 60))] for _ in range(150)]
    texts += [nested(r, r.randint(1, 4)) for _ in range(150)]
    texts += [nested(r, 3) + [str(i) for i in range(r.randint(0, 30))] + nested(r, 2) for _ in range(60)]
    texts += [texts[3], texts[200], []]
    coded = [[w.encode() for w in t] for t in texts]
    assert P.text_runs(coded, least) == [brute(t, least) for t in texts]


def test_border_pairs_in_parts(monkeypatch):
    r = random.Random(5)
    texts = [[w.encode() for w in nested(r, 4)] for _ in range(20)]
    whole = P.text_runs(texts, 2)
    monkeypatch.setattr(P, "PAIRS", 7)
    assert P.text_runs(texts, 2) == whole and sum(map(len, whole)) > 100


def digest(doc, text):
    words = P.planted(doc, (text or "").encode().split())
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_is_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.choice(" \n\t").join(nested(r, r.randint(0, 4)))) for i in range(120)]
    rows += [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(1, 150)))) for i in range(120, 320)]
    rows += [(None, "a b " * 20), (320, None), (321, ""), (322, " \n\t "), (323, "x" * 5000), (5, rows[5][1]), (5, "é ü " * 9), (324, "long " * 3000), (325, "a b " * 12)]
    docs = spark.createDataFrame([(*x, "d", "s", "k") for x in rows], "doc_id long, text string, doc string, start string, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digest(*x) for x in rows), key=repr)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_damage():
    words = [b"%d" % i for i in range(100)]
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert P.planted(None, words) == words and P.planted(doc, []) == [] and len(P.planted(doc, words)) == 100 and P.planted(doc, words) != words
    assert len(P.text_runs([P.planted(doc, words)])[0]) >= 1
