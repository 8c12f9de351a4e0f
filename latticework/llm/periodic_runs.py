"""Periodic runs of words: longest previous factors, LZ blocks, Main's extensions at block borders, bucketed copying.

A run is a stretch of words in which words q apart are identical, q as small as possible, at least 2 * q long, that neither
neighbouring word extends. A suffix array of a text's words comes from prefix doubling, whose ranks are kept: equal ranks of level k
mean 2 ** k equal words, so they also tell how far two places agree, forwards and backwards. Suffix array and common prefixes give the
longest previous factor of every place, and these the LZ blocks. A run that meets a block's border is found there: for each
period that fits, words a period apart are compared both ways from the border. Any other run lies inside a block, and is
copied from the block's earlier occurrence, run starts being kept in order.

Every text is searched by itself, whole, in the task that reads it: no shuffle. Many short texts are searched together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .suffix_dedup import refine

LEAST = 12
#: Words of short texts that are searched together, and pairs of border and period that are compared together.
TOGETHER, PAIRS = 1 << 17, 1 << 20

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Ranks:
    """Ranks of all stretches of 2 ** k words of texts laid end to end, up to the longest that repeats within a text."""

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        n = len(words)
        rank, tied = np.zeros(n, np.int64), np.arange(n)
        tied = refine(rank, tied, text.astype(np.int64) << 40 | words)
        self.levels = [np.r_[rank, -1]]
        while len(tied):
            step = 1 << len(self.levels) - 1
            beyond = tied + step
            # ranks are counts of smaller suffixes; stretches that leave their text come before all others of equal beginning
            inside = (beyond < n) & (text[np.minimum(beyond, n - 1)] == text[tied])
            key = np.where(inside, self.levels[-1][np.minimum(beyond, n)], -1)
            tied = refine(rank, tied, key)
            if len(tied):
                self.levels.append(np.r_[rank, -1])
        self.order = np.argsort(rank)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a < b on are equal."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            length += (level[a + length] == level[b + length]).astype(np.int64) << k
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a < b are equal."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x = self.levels[k], a - length - (1 << k)
            length += ((x >= 0) & (level[np.maximum(x, 0)] == level[np.maximum(b - length - (1 << k), 0)])).astype(np.int64) << k
        return length


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """(length, earlier place) of the longest factor at every place that also begins earlier.

    Suffixes leave the order from the last place to the first; what is left beside a suffix then begins earlier.
    """
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at, where, common = order.tolist(), place.tolist(), [*common.tolist(), 0]  # common[r]: of ranks r - 1 and r
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = where[i]
        p, q = before[r], after[r]
        left, right = common[r], common[q]
        if left >= right:
            length[i] = left
            if left:
                source[i] = at[p]
            common[q] = right
        else:
            length[i], source[i] = right, at[q]
            common[q] = left
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Starts of the LZ blocks: each is the longest factor that begins earlier too, or one new word."""
    starts, i = [], 0
    while i < len(length):
        starts.append(i)
        i += length[i] or 1
    return starts


def border_runs(ranks: Ranks, border: np.ndarray, before: np.ndarray, after: np.ndarray, least: int) -> set[Run]:
    """(start, length, period) of the runs of least words or more that meet a border between blocks of before and after words."""
    found: dict[tuple[int, int], int] = {}
    left = np.r_[before + after, np.zeros_like(after)]  # periods that lie to the left of the border, then those to its right
    most = np.where(np.arange(len(left)) < len(border), left, np.r_[after, after])
    side, places = np.repeat([True, False], len(border)), np.r_[border, border]
    cut = np.searchsorted(np.cumsum(most), np.arange(0, max(int(most.sum()), 1), PAIRS))
    first = ranks.levels[min(1, len(ranks.levels) - 1)]
    for a, z in zip(cut, [*cut[1:], len(most)]):
        count = most[a:z]
        of = np.repeat(np.arange(a, z), count)
        period = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 1
        x = places[of] - np.where(side[of], period, 0)
        y = x + period
        inside = (x >= 0) & (y < len(first))
        x, y, period = x[inside], y[inside], period[inside]
        # a run of 12 words or more has 6 that agree with those a period on: two at least on one side of the border
        near = (first[x] == first[y]) | ((x >= 2) & (first[np.maximum(x - 2, 0)] == first[np.maximum(y - 2, 0)])) if least >= 12 else np.ones(len(x), bool)
        x, y, period = x[near], y[near], period[near]
        low, high = ranks.behind(x, y), ranks.ahead(x, y)
        good = low + high >= np.maximum(period, least - period)
        for s, e, p in zip((x - low)[good].tolist(), (y + high)[good].tolist(), period[good].tolist()):
            if found.get((s, e), p) >= p:
                found[s, e] = p
    return {(s, e - s, p) for (s, e), p in found.items()}


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs of least words or more in texts laid end to end (text: number of each word's text, rising), by start, then period."""
    if len(words) < 2:
        return []
    ranks = Ranks(words, text)
    n, order = len(words), ranks.order
    low, high = np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:])
    length, source = previous_factors(order, np.r_[0, ranks.ahead(low, high)])
    starts = np.array(blocks(length), np.int64)
    sizes = np.diff(np.r_[starts, n])
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) + 1  # the end of a text is a border too, with nothing after it
    opening = np.isin(starts, np.r_[0, last])
    ends = np.searchsorted(starts, last) - 1
    border = np.r_[starts, last]
    before = np.r_[np.where(opening, 0, np.r_[0, sizes[:-1]]), sizes[ends]]
    found = border_runs(ranks, border, before, np.r_[sizes, np.zeros(len(last), np.int64)], least)
    known = sorted(found)
    inner = np.flatnonzero(sizes >= least + 2)
    for b, size in zip(starts[inner].tolist(), sizes[inner].tolist()):
        src, k = source[b], bisect_right(known, (source[b] + 1,))
        while k < len(known) and known[k][0] < src + size - least:
            s, m, p = known[k]
            if s + m < src + size:
                insort(known, (s - src + b, m, p))
            k += 1
    return sorted(known, key=lambda r: (r[0], r[2]))


def repeats(words: list[np.ndarray], width: int) -> np.ndarray:
    """For every text, whether some stretch of width words occurs in it twice (by a hash: never missed, if sometimes in vain)."""
    sizes = np.array([len(w) for w in words])
    of = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    flat = np.concatenate(words).astype(np.uint64)
    if len(flat) < width:
        return np.zeros(len(words), bool)
    h = np.zeros(len(flat) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ flat[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h + of[: len(h)]) * np.uint64(0xD6E8FEB86659FD93)
    whole = of[: len(h)] == of[width - 1 :]
    h, of = h[whole], of[: len(whole)][whole]
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(words), bool)
    out[of[order[1:][again]].astype(np.int64)] = True
    return out


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each text, given as lists of words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    coded = [np.fromiter((number(w, len(known)) for w in t), np.int64, len(t)) for t in texts]
    out: list[list[Run]] = [[] for _ in texts]
    # a run of least words has (least + 1) // 2 words that occur a period later again
    some = np.flatnonzero(repeats(coded, (least + 1) // 2)) if coded else []
    if len(some):
        sizes = [len(coded[i]) for i in some]
        first = np.cumsum([0, *sizes])
        for s, m, p in runs_of(np.concatenate([coded[i] for i in some]), np.repeat(np.arange(len(some)), sizes), least):
            i = int(np.searchsorted(first, s, "right")) - 1
            out[some[i]].append((s - int(first[i]), m, p))
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, m, p in runs:
        edge[s + p] += 1
        edge[s + m] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc, n_words, runs array of (start, length, period), kept) for every row of docs.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0, and compared byte by byte. kept is the text with every run cut to its first period,
    its words joined by one space. A null, empty or blank text has no words, no runs and an empty kept. Rows are independent: repeated
    and null ids, equal texts and further columns, whatever their names, change nothing. Memory is some 400 bytes for each word of the longest
    text. rewrite(id, words), if given, changes each text's words first.
    """

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc").to_pylist(), b.column("t").cast(pa.large_binary())
            done, group, words = [], [], 0

            def flush():
                for (i, t), runs in zip(group, text_runs([t for _, t in group], least)):
                    done.append((i, len(t), [{"start": s, "length": m, "period": p} for s, m, p in runs], b" ".join(kept_words(t, runs))))
                group.clear()

            for i, t in zip(ids, texts):
                t = (t.as_py() or b"").split()
                if rewrite:
                    t = rewrite(i, t)
                if words + len(t) > TOGETHER:
                    flush()
                    words = 0
                group.append((i, t))
                words += len(t)
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), schema)] if done else [pa.array([], k) for k in schema], ["doc", "n_words", "runs", "kept"])

    long = pa.int64()
    schema = [long, long, pa.list_(pa.struct([("start", long), ("length", long), ("period", long)])), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(run, "doc long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten (by crc32 of its id), made periodic from some word on; a null id changes nothing."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda top, r: F.when((r["length"] > top["length"]) | ((r["length"] == top["length"]) & ((r["start"] < top["start"]) | ((r["start"] == top["start"]) & (r["period"] < top["period"])))), r).otherwise(top))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted).withColumn("top", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(F.col("doc").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
