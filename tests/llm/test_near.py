import random

from latticework.llm import decontamination, line_dedup, mixing, simhash


def prose(words, seed):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randint(0, 10**7)}" for _ in range(words)]


def jaccard(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_pairs_under_a_template_are_found(spark):
    """Two texts that are linked, and an earlier one with most of their words that is linked to neither."""
    rows, want = [], 0
    for k in range(40):
        template, own, other = prose(255, 3 * k), prose(45, 3 * k + 1), prose(45, 3 * k + 2)
        one, first = template + own, template[:255] + other
        two = list(one)
        for at in range(20, 300, 75):
            two[at] = f"e{at}"
        assert jaccard(one, two) >= 0.8 > max(jaccard(first, one), jaccard(first, two))
        rows += [(k, " ".join(first)), (1000 + k, " ".join(one)), (2000 + k, " ".join(two))]
        want += 1
    got = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, samples=16).collect()}
    assert all(got[k] == k for k in range(40))
    assert sum(got[2000 + k] == 1000 + k for k in range(40)) == want


def test_a_passage_of_many_does_not_join_them(spark):
    passage = prose(80, 1)
    rows = [(k, " ".join(prose(40, 100 + k) + passage + prose(40, 900 + k))) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(20)]
    got = {r["doc"]: r["component"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, samples=16).collect()}
    assert all(got[k] == k for k in range(300)) and all(got[1000 + k] == k for k in range(20))


def test_weights_whatever_columns_are_called(spark):
    names = ["q_", "ld_", "row", "label", "quality", "rows", "mix_weight"]
    docs = spark.createDataFrame([(1, *"abcdefg"), (2, *"abcdefg"), (None, *"abcdefg")], "doc_id long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    out = mixing.quality_weight(docs, labels)
    assert out.columns == ["doc_id", *names[:-1], "mix_weight"]
    assert {(r["doc_id"], r["q_"], r["quality"], r["mix_weight"]) for r in out.collect()} == {(1, "a", "e", 1.0), (2, "a", "e", 0.25), (None, "a", "e", 0.5)}


def test_blocks_of_items_take_turns(spark):
    items = [(k, " ".join(prose(30, 5000 + k))) for k in range(6)]
    rows = [(k, " ".join(prose(20, 6000 + k)) + " " + (items[k % 6][1] if k % 2 else "")) for k in range(24)] + [(None, items[0][1]), (99, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontamination.decontaminate(docs, benchmark).collect()), key=repr)
    blocks = decontamination.decontaminate(docs, benchmark, block_bytes=200)
    assert len(want) == 13 and sorted(map(tuple, blocks.collect()), key=repr) == want
    assert blocks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_long_prefixes_of_ids_make_no_single_batch(spark, monkeypatch):
    rows = [(f"https://example.org/page/{k:02}", f"one shared line of text\nown line number {k:05}\nanother of {k // 2:05} ones") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    added = []
    add = line_dedup.LineRuns.add
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, part: added.append(part.count()) or add(self, part))
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs, batch_lines=30, fanout=2).collect()}
    assert len(added) >= 4 and max(added) <= 60 and sum(added) == 150
    assert out == {i: int(k > 0) + k % 2 for k, (i, _) in enumerate(rows)}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_the_pipeline_leaves_no_link_out(spark, tmp_path):
    """Two texts of one fingerprint, that of a word they repeat; a third has nearly all shingles of the greater one, which no sample stood for."""
    import corpus_pipeline

    rows = [(1, ["ha"] * 300 + prose(100, 1)), (2, ["ha"] * 300 + prose(100, 2)), (3, prose(100, 2)), (4, prose(100, 3))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    first = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 4]
