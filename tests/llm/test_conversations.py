import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from latticework.llm import conversations as C

GO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best(rows):
    """(cost, audit, repaired) by trying every edit at every turn; rows are (role, text, must go, cut)."""

    @cache
    def go(i, state, inserts):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))

        def step(cost, letter, line, to):
            c, a, rest = to
            found.append((cost + c, letter + a, (*line, *rest)))

        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in GO:
                    step(2, "I", (f"{role}:",), go(i, GO[state, role[0]], inserts + 1))
        if i < len(rows):
            role, text, must, cut = rows[i]
            step(3, "D", (), go(i + 1, state, 0))
            if not must:
                if (state, role[:1]) in GO:
                    step(cut, "K", (f"{role}:{text}",), go(i + 1, GO[state, role[:1]], 0))
                for new in ("user", "assistant"):
                    if (state, new[0]) in GO:
                        step(2 + cut, "R", (f"{new}:{text}",), go(i + 1, GO[state, new[0]], 0))
        return min(found, default=(10**9, "", ()))

    return go(0, 0, 0)


def brute(rows):
    original = {r[0] for r in rows}
    out = []
    for conv in original:
        turns = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                turns += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort()
        seen, coded, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in turns:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            coded.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        known = [t for there, t, _, _ in turns if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit, lines = best(tuple(coded))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ü"]
    texts = ["Yes.", "No!", "and then", "", " \n", None, "Why?  ", "a.b", "é", ". ", "x" * 3000]
    out = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 8, 12, 40 if c == 7 else 4])):
            text = f"Turn {c} {t}{r.choice('.!?;')}" if r.random() < 0.6 else r.choice(texts)
            out.append((None if c == 5 else c, r.choice([t, t, t, t, 2, None, 3 * t]), r.choice(roles[:4] if r.random() < 0.8 else roles), text))
    return out + out[:20]


@pytest.mark.parametrize("bits", [12, 1])
def test_query_is_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    found = rows(bits, 60)
    data = spark.createDataFrame([(*x, 0, "k") for x in found], "conv_id long, turn long, role string, text string, at long, conv string")
    data.write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(found)
    assert dict(got.dtypes)["cost"] == "bigint"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op13_conversation_repair(spark, str(tmp_path)).count() == 0


def test_edits_keep_texts(spark):
    data = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "user", "Hi."), ("x", 3, "assistant", "Well."), ("x", 4, "assistant", "More.")], "who string, n int, says string, what string")
    edits, faults = C.repair(data, "who", "n", "says", "what")
    got = [(r["edit"], r["role"], r["text"], r["cost"]) for r in edits.orderBy("at", "part").collect()]
    assert got == [("K", "user", "Hi.", 0), ("D", "user", "Hi.", 3), ("K", "assistant", "Well.", 0), ("I", "user", "", 2), ("K", "assistant", "More.", 0)]
    assert faults.first()[1:] == (0, 0, 1, 0, 2)
