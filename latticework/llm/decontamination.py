"""Benchmark decontamination: the q-gram lemma over diagonal bands, verified by banded alignment.

An item of m characters that occurs in a text with at most e edits keeps at least m + 1 - q (e + 1) of its q-grams,
and their diagonals (text position less item position) span at most e. Shared q-grams are counted in overlapping
bands of 2 (e + 1) diagonals, a band that reaches the bound is a region, and a banded alignment decides it. Every item has the
longest q-grams, Q at most, for which the bound is above 0; items under SHORT characters are found where they stand as whole words.
Texts are lower-cased and their white space is collapsed; characters are code points. The items are sent to the tasks in blocks
of bounded size; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, table, union_all

Q, SHORT, EDIT_RATE, BLOCK_BYTES, CHUNK = 12, 8, 0.06, 16 << 20, 2_000_000
#: Pairs of q-grams counted, and regions aligned, at a time.
PAIRS, REGIONS = 1 << 22, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAP = "\U0010ffff"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position on, by doubling."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width = data.astype(np.uint64) + np.uint64(1), 1
        out, done, r = None, 0, _MIX
        left = q
        while left:
            if left & 1:
                tail = power[done:]
                out = power if out is None else out[: len(tail)] * r + tail[: len(out)]
                done += width
            left >>= 1
            if left:
                power, width, r = power[:-width] * r + power[width:], width * 2, r * r + _MIX
        out = out[: len(data) - q + 1]
        return (out ^ (out >> np.uint64(31))) * _MIX


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sum of their weights (1 each if None)."""
    if not len(values):
        return values, values
    low, high = int(values.min()), int(values.max())
    if high - low <= 2 * PAIRS:
        n = np.bincount(values - low, weights)
        at = np.flatnonzero(n)
        return at + low, n[at].astype(np.int64)
    keys, back, n = np.unique(values, return_inverse=True, return_counts=True)
    return keys, n if weights is None else np.bincount(back.ravel(), weights, len(keys)).astype(np.int64)


class GramIndex:
    """The q-grams of items(number, text, edits) of one q, by hash."""

    def __init__(self, items: list[tuple[int, str, int]], q: int):
        self.q, self.items = q, items
        hashes = [gram_hashes(codes(t), q) for _, t, _ in items]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]).astype(np.int64)[order]
        self.pos = np.concatenate([np.arange(len(h)) for h in hashes]).astype(np.int64)[order]
        self.budget = np.array([e for _, _, e in items], np.int64)
        self.size = np.array([len(t) for _, t, _ in items], np.int64)
        self.need = self.size + 1 - q * (self.budget + 1)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, texts: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(text number, item number): lowest diagonals of the bands that reach the bound, and the least edits that their counts allow.

        A q-gram that repeats counts at each of its places, so a count is never too low.
        """
        data = codes((_GAP * self.q).join(texts))
        starts = np.cumsum([0] + [len(t) + self.q for t in texts[:-1]])
        h = gram_hashes(data, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        if not len(at):
            return {}
        text = np.searchsorted(starts, at, side="right") - 1
        offset = at - starts[text]
        most = int(max(map(len, texts)) + self.size.max()) + 2  # bands of a text and item, numbered from 1
        shift = int(self.size.max()) + 1
        n = self.count[k]
        upto, parts = np.cumsum(n), []
        cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)) + 1, len(at)])
        for a, z in zip(cuts, cuts[1:]):
            each = n[a:z]
            entry = np.repeat(self.first[k[a:z]] - np.cumsum(each) + each, each) + np.arange(each.sum())
            item = self.item[entry]
            band = (np.repeat(offset[a:z], each) - self.pos[entry] + shift) // (self.budget[item] + 1) + 1
            parts.append(counted((np.repeat(text[a:z], each) * len(self.items) + item) * most + band))
        keys, sums = counted(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
        keys, sums = counted(np.r_[keys, keys - 1], np.r_[sums, sums])  # a region is a band and the next one
        of, band = keys // most, keys % most
        item = of % len(self.items)
        good = sums >= self.need[item]
        of, item, band, sums = of[good], item[good], band[good], sums[good]
        low = (band - 1) * (self.budget[item] + 1) - shift
        least = np.maximum(0, -(-(self.size[item] + 1 - sums) // self.q) - 1)
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        return {(int(of[s] // len(self.items)), int(item[s])): (low[s:e], least[s:e]) for s, e in zip(new, [*new[1:], len(of)])}

    def matches(self, texts: list[str]):
        """(text number, item's number, edits, start, end) of the best occurrence, the first one of equals."""
        for (t, i), (low, least) in self.regions(texts).items():
            number, item, most = self.items[i]
            if (at := texts[t].find(item)) >= 0:
                yield t, number, 0, at, at + len(item)
                continue
            if not most:
                continue
            best = None
            least = np.maximum(least, 1)  # it does not stand there as it is
            window, pattern = codes(texts[t]), codes(item)
            low, least = first_of_equals(window, low, least, most, len(item) + 4 * most + 2)
            order = np.lexsort((low, least))
            while len(order):
                found = banded_alignments(pattern, window, low[order[:REGIONS]], most)
                best, order = min([x for x in (best, *found) if x], default=None), order[REGIONS:]
                if best:  # the others have more edits, or as many and begin later
                    order = order[(least[order] < best[0]) | ((least[order] == best[0]) & (low[order] - most <= best[1]))]
            if best:
                yield t, number, *best


def first_of_equals(text: np.ndarray, low: np.ndarray, least: np.ndarray, most: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The regions without those whose size characters, from most before the lowest diagonal on, are those of an earlier region."""
    whole = np.flatnonzero((low >= most) & (low - most + size <= len(text)))
    if len(whole) < REGIONS:
        return low, least
    _, first = np.unique(gram_hashes(text, size)[low[whole] - most], return_index=True)
    kept = np.sort(np.r_[whole[first], np.setdiff1d(np.arange(len(low)), whole)])
    return low[kept], least[kept]


class Items:
    """Normalised items, each distinct text once, in indexes by q; found by the names that share a text."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        named: dict[str, list[int]] = {}
        for name, text in rows:
            if text:
                named.setdefault(text, []).append(name)
        self.texts, self.names = list(named), list(named.values())
        by: dict[int, list[tuple[int, str, int]]] = {}
        self.words: dict[int, dict[str, int]] = {}
        for i, t in enumerate(self.texts):
            if len(t) < SHORT:
                self.words.setdefault(t.count(" ") + 1, {})[t] = i
            else:
                edits = int(rate * len(t))
                by.setdefault(min(q, len(t) // (edits + 1)), []).append((i, t, edits))
        self.indexes = [GramIndex(items, n) for n, items in sorted(by.items())]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int, float]]:
        """(text number, item's name, edits, start, end, similarity), in order."""
        out = [m for index in self.indexes for m in index.matches(texts)]
        for t, text in enumerate(texts if self.words else []):
            words = text.split(" ")
            for n, known in self.words.items():
                first: dict[int, int] = {}
                at = 0
                for k in range(len(words) - n + 1):
                    i = known.get(" ".join(words[k : k + n]))
                    if i is not None:
                        first.setdefault(i, at)
                    at += len(words[k]) + 1
                out += [(t, i, 0, a, a + len(self.texts[i])) for i, a in first.items()]
        return sorted((t, name, *rest, 1 - rest[0] / len(self.texts[i])) for t, i, *rest in out for name in self.names[i])

def banded_alignments(pattern: np.ndarray, text: np.ndarray, low: np.ndarray, most: int) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of pattern in text with at most `most` edits, along 2 (most + 1) diagonals from each of low on; else None.

    The pattern must be used up; what lies before and after it in the text is free. All bands advance together.
    """
    width, big = 2 * (most + 1) + 2 * most, len(pattern) + len(text) + 1
    diagonals = low[:, None] - most + np.arange(width)
    inside = (diagonals >= 0) & (diagonals <= len(text))
    cost, start = np.where(inside, 0, big), np.where(inside, diagonals, 0)
    steps, edge = np.arange(width), np.full((len(low), 1), big)
    none = np.zeros((len(low), 1), start.dtype)
    for i in range(1, len(pattern) + 1):
        j = i + diagonals  # text characters used after i of the pattern's
        valid = (j >= 0) & (j <= len(text))
        differs = (text[np.clip(j - 1, 0, len(text) - 1)] != pattern[i - 1]) if len(text) else np.ones(j.shape, bool)
        swap = np.where(valid & (j >= 1), cost + differs, big)
        skip = np.hstack([cost[:, 1:] + 1, edge])  # a pattern character that the text lacks
        begin = np.where(swap <= skip, start, np.hstack([start[:, 1:], none]))
        best = np.where(valid, np.minimum(swap, skip), big)
        slack = best - steps  # a text character that the pattern lacks
        low_so_far = np.minimum.accumulate(slack, axis=1)
        source = np.maximum.accumulate(np.where(slack == low_so_far, steps, 0), axis=1)
        cost, start = np.where(valid, low_so_far + steps, big), np.take_along_axis(begin, source, axis=1)
        if cost.min() > most:
            return [None] * len(low)
    k = cost.argmin(axis=1)
    rows = np.arange(len(low))
    return [(int(c), int(s), int(len(pattern) + d)) if c <= most else None for c, s, d in zip(cost[rows, k], start[rows, k], diagonals[rows, k])]


def _chunks(column: pa.Array):
    """(first row, normalised texts) of about CHUNK characters each."""
    begin, texts, size = 0, [], 0
    for k, t in enumerate(column):
        texts.append(normalise(t.as_py()))
        size += len(texts[-1])
        if size >= CHUNK:
            yield begin, texts
            begin, texts, size = k + 1, [], 0
    if texts:
        yield begin, texts


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items in lists of about block_bytes of text, read partition by partition; null texts match nothing."""
    block, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((r["i"], normalise(r["t"])))
        size += len(r["t"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, item, edits, start, end, similarity) for every item found in a row's text, its best occurrence.

    start and end count characters of the normalised text. A null text holds nothing, and an item without a word is in none; rows that
    repeat an id are searched one by one, and items that repeat an id or a text are all reported.
    """
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    for items in item_blocks(benchmark, block_bytes=block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Items(sent.value, q, rate)
            for b in batches:
                for begin, texts in _chunks(b.column("t")):
                    if found := index.matches(texts):
                        t, *rest, similarity = zip(*found)
                        ids = b.column("doc").take(pa.array([begin + x for x in t], pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rest), pa.array(similarity, pa.float64())], ["doc", "item", "edits", "start", "end", "similarity"])

        parts.append(rows.mapInArrow(run, "doc long, item long, edits long, start long, end long, similarity double"))
    return union_all(parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are.

    A benchmark of several blocks takes a pass for each, whose rows are written for the next one: a task holds one block's index at a time.
    """
    for k, items in enumerate(item_blocks(benchmark, block_bytes=block_bytes)):
        docs = stage(docs, "clean") if k else docs
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Items(sent.value, q, rate)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for begin, texts in _chunks(b.column(text_col)):
                    clean[[begin + m[0] for m in index.matches(texts)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits", "start", "end", "similarity")
