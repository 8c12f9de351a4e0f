"""Exact Jaccard self-join of word n-gram sets: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, but documents that share nothing are all at distance 1 from each other, so pivots cannot tell them apart.
Documents are therefore grouped first by parts of their sets. Sets of LEAST_CUT n-grams or more are cut by ranges of the n-grams' hashes into more
parts than two linked sets can differ in, with room for empty parts: some part that is not empty is the same in both. Of smaller sets, the
first few n-grams in order of their hashes give triples, one of which is in both. N-grams that over a thousandth of the documents hold (counted
over all) are left out of parts and come last in that order, unless too little of a set is left; so passages that many share do not
join their documents. Most of two linked sets' parts are equal, as a differing n-gram spoils one part at most: sets with fewer equal parts
than that are not tied. Parts that over MET sets hold count as equal where both sets have so many such parts, and tie the sets that have as many of them
as a link needs. Documents reachable over such ties form a group; most documents are in none. No link leaves its group.

Within a group, documents are told apart once more by their n-grams that are rarest in it, and then the metric join runs. Pivots far from one another are chosen until every document is linked to one or is one itself; a
document belongs to the region of its nearest pivot p. If x of that region and y of another are within r, then y is within d(x, p) + r of
p: such windows join the region, and region and window are joined in the same way. A group too large for one task is divided by pivots on
Spark first: intersections with the pivots are a join on n-grams, regions and windows become groups of the next level, and a region that is
hardly smaller than its group is compared block against block. Only components are asked for, so documents already connected are not compared.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, stage, table, union_all

WIDTH, SIMILAR = 4, 85
#: Sets from this size on are cut into parts; sizes of one class differ by CLASS at most; smaller sets give TUPLE-subsets.
LEAST_CUT, CLASS, TUPLE = 40, 1.5, 3
#: Sets of an equal part whose pairs are counted. Low bits of a set's name, which say how many parts it must share. Bits of a part, NEED_BITS less than a long's at most.
MET, NEED_BITS, PART_BITS = 32, 12, 40
#: Most n-grams and documents of a group that one task joins; n-grams in a task; pivots of a larger group; documents below which regions are not divided.
GROUP_SHINGLES, GROUP_DOCS, TASK_SHINGLES, PIVOTS, LEAF = 1 << 22, 1 << 14, 1 << 22, 16, 32
#: An n-gram is frequent if more than one in so many documents have it, and FEWEST at least; n-grams that a task counts at a time; bits of the filter of wanted rows, at most.
FREQUENT, FEWEST, COUNTED, FILTER_BITS = 1000, 100, 1 << 22, 1 << 27
#: Documents in groups that are sent to all tasks, 16 bytes each; more are joined by shuffling sets.
SENT = 1 << 20
#: N-grams of pivots that are sent to all tasks, 32 bytes each; more are joined by shuffling all n-grams of large groups.
SENT_NGRAMS = 1 << 19
#: A region with more of its group's documents than this share is compared block against block.
SPLIT = 0.7
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---- parts


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return (h ^ (h >> np.uint64(29))) * _ODD


def least_common(n: int, similar: int) -> int:
    """N-grams that a set of n shares at least with any set it is linked to."""
    return -(-similar * n // 100)


@lru_cache(maxsize=None)
def schemes(n: int, similar: int) -> list[tuple[int, int, int]]:
    """(class, parts, differences) of the classes that a set of n >= LEAST_CUT n-grams is cut for.

    Two sets are cut alike for the class of the larger one. A class has sets that differ in so many n-grams at most, and as many parts
    more as even its smallest sets leave empty by six standard deviations.
    """
    out, low, c = [], LEAST_CUT, 0
    while low * similar <= n * 100:
        high = ceil(low * CLASS)
        if n < high:
            differ = 2 * (high - 1) * (100 - similar) // (100 + similar)
            parts = differ + 1
            for _ in range(20):
                empty = parts * exp(-max(low * similar / 100, LEAST_CUT) / parts)
                parts = max(parts, differ + 3 + ceil(empty + 6 * sqrt(empty)))
            out.append((c, parts, differ))
        low, c = high, c + 1
    return out


@lru_cache(maxsize=None)
def subsets(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), TUPLE)), np.int64).reshape(-1, TUPLE)


def part_keys(h: np.ndarray, similar: int = SIMILAR, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set of sorted distinct hashes: any two different linked sets have one in common, whichever n-grams are frequent (sorted)."""
    return needed_parts(h, similar, frequent)[0]


def needed_parts(h: np.ndarray, similar: int, frequent: np.ndarray | None) -> tuple[np.ndarray, int]:
    """part_keys, and how many of them any different linked set has too, at least.

    Linked sets are cut alike once at least. Then a part of this set that is not empty is the other's too unless one of the n-grams in which the sets
    differ falls into it, and these are 100 n / similar - n at most.
    """
    n, out = len(h), []
    common, fewest = least_common(n, similar), n
    if common == n and n * 100 < (n + 1) * similar:
        return np.empty(0, np.uint64), 1  # linked with equal sets only
    often = np.zeros(n, bool)
    if frequent is not None and len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    with np.errstate(over="ignore"):
        if common < LEAST_CUT:
            chosen = np.r_[h[~often], h[often]][subsets(min(n, n - common + TUPLE))]
            key = np.zeros(len(chosen), np.uint64)
            for k in range(TUPLE):
                key = mixed(key + chosen[:, k])
            out.append(key)
            fewest = 0
        if n >= LEAST_CUT:
            for c, parts, differ in schemes(n, similar):
                salt = np.uint64(c + 1) * _MIX
                for own in (h[~often], h) if often.any() else (h,):
                    of = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(own) else np.empty(0, np.int64)
                    if len(own):
                        out.append(mixed(np.add.reduceat(mixed(own), begin) + salt))
                    fewest = min(fewest, len(begin))
                    if len(begin) > differ:
                        break
                else:  # so many are empty that two sets might agree in empty parts only
                    out.append(mixed(mixed(np.setdiff1d(np.arange(parts, dtype=np.uint64), of[begin]) + salt) + salt))
    return np.concatenate(out), max(1, fewest - (100 * n // similar - n))


def ngrams(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct word n-grams, sorted; of all its words if they are fewer than width."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - width + 1, min(len(h), 1))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = mixed(out * np.uint64(3) + h[k : k + n])
    return np.unique(out)


class Counts:
    """N-grams that many documents hold, counted in bounded memory: what is rare when the buffer is full is dropped."""

    def __init__(self) -> None:
        self.kept, self.times, self.new, self.size, self.docs = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0, 0

    def add(self, h: np.ndarray) -> None:
        self.new.append(h)
        self.size += len(h)
        self.docs += 1
        if self.size > COUNTED:
            self.settle()

    def settle(self) -> None:
        flat = np.concatenate([self.kept, *self.new])
        times = np.r_[self.times, np.ones(len(flat) - len(self.times), np.int64)]
        self.kept, of = np.unique(flat, return_inverse=True)
        self.times = np.bincount(of, weights=times).astype(np.int64)
        often = (self.times > 1) & (self.times * 2 * FREQUENT > self.docs)
        self.kept, self.times, self.new, self.size = self.kept[often], self.times[often], [], 0


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))


def _texts(batch: pa.RecordBatch):
    for t in batch.column("t").cast(pa.large_binary()):
        yield t.as_py()


def ngram_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, n, key, th) for every row: set size, hash of the set (null if empty), hash of the text.

    After its rows, each task gives its frequent n-grams: n is -1, key the n-gram and th how many documents have it.
    """

    def run(batches):
        counts, names = Counts(), ["doc", "n", "key", "th"]
        for b in batches:
            sizes, keys = [], []
            for t in _texts(b):
                h = ngrams(t, width)
                counts.add(h)
                sizes.append(len(h))
                keys.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), b.column("th")], names)
        counts.settle()
        n = len(counts.kept)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, -1)), pa.array(counts.kept.view(np.int64)), pa.array(counts.times)], names)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc long, n long, key long, th long")


def counted_ngrams(docs: DataFrame, text_col: str, hashes) -> DataFrame:
    """(n, key, th), staged: a row of n 0 for every row, and each task's frequent n-grams as ngram_sets gives them; hashes(text) are a text's n-grams."""

    def run(batches):
        counts = Counts()
        for b in batches:
            for t in _texts(b):
                counts.add(np.unique(hashes(t or b"")))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int64)), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], ["n", "key", "th"])
        counts.settle()
        n = len(counts.kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), pa.array(counts.kept.view(np.int64)), pa.array(counts.times)], ["n", "key", "th"])

    return stage(docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "n long, key long, th long"), "counted")


def frequent_ngrams(found: DataFrame) -> np.ndarray:
    """Sorted hashes of n-grams that over one in FREQUENT documents have, and FEWEST at least: FREQUENT times a document's n-grams in the mean, at most."""
    total = found.where("n >= 0").count()
    counts = found.where("n < 0").groupBy("key").agg(F.sum("th").alias("c")).where((F.col("c") * FREQUENT > total) & (F.col("c") >= FEWEST))
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(np.uint64))


def candidate_links(docs: DataFrame, id_col: str, text_col: str, width: int, similar: int, frequent: np.ndarray) -> DataFrame:
    """(a, b), keys >> NEED_BITS of different sets that can have as many parts in common as links need, or such a set and a part (a number of its own).

    Pairs are counted in parts that at most MET sets have. Of the other parts two sets have no more in common than either of them has, so a pair is tied
    where this many more would do. Two linked sets with large parts only in common have as many of these as they need: such sets are tied to their large parts, other
    sets to none. A set's name is its key with the number of parts that it needs in the low bits; keys that are equal but for these only add ties, and so do
    parts that are equal in PART_BITS bits. A set that stood earlier in the same partition gives its parts once.
    """
    most = (1 << NEED_BITS) - 1

    def cut(batches):
        seen = set()
        for b in batches:
            parts, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in _texts(b):
                h = ngrams(t, width)
                key = xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)
                if len(h) and key not in seen:
                    seen.add(key)
                    own, need = needed_parts(h, similar, frequent)
                    own = np.unique(own)
                    parts.append(np.unique(own >> np.uint64(64 - PART_BITS)))
                    need = max(1, need - (len(own) - len(parts[-1])))  # parts of one set that are equal in so many bits count once
                    names.append(np.full(len(parts[-1]), key & ~most | min(need, most)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(parts).view(np.int64))], ["name", "part"])

    def ties(part, name, large):
        """Of whole parts; the first is large if so said. Pairs, and (part, name) of large parts with a negative number; no name ends in NEED_BITS zeros."""
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[new, len(part)])
        many = sizes > MET
        many[0] |= large
        many, left = np.repeat(many, sizes), np.repeat(new + sizes, sizes) - np.arange(len(part)) - 1
        out = [(part[many] << NEED_BITS, name[many], np.full(many.sum(), -1))]
        i = np.flatnonzero(~many & (left > 0))
        for step in range(1, MET):
            out.append((name[i], name[i + step], np.ones(len(i), np.int64)))
            i = i[left[i] > step]
            if not len(i):
                break
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "shared"])

    def pair(batches):
        part, name, large = np.empty(0, np.int64), np.empty(0, np.int64), False
        for b in batches:
            part, name = np.r_[part, b.column("part").to_numpy()], np.r_[name, b.column("name").to_numpy()]
            kept = np.r_[True, (part[1:] != part[:-1]) | (name[1:] != name[:-1])][: len(part)]
            part, name = part[kept], name[kept]
            last = int(np.searchsorted(part, part[-1])) if len(part) else 0  # this part may go on in the next batch
            if last:
                yield ties(part[:last], name[:last], large)
                part, name, large = part[last:], name[last:], False
            if len(part) > MET:
                yield ties(part, name, True)
                part, name, large = part[-1:], name[-1:], True
        if len(part):
            yield ties(part, name, large)

    def need(*names: str) -> Column:
        return F.greatest(*[F.col(c).bitwiseAND(F.lit(most)) for c in names], F.lit(0))

    parts = _rows(docs, id_col, text_col).mapInArrow(cut, "name long, part long")
    met = parts.repartition("part").sortWithinPartitions("part", "name").mapInArrow(pair, "a long, b long, shared long")
    met = stage(met.groupBy("a", "b").agg(F.sum("shared").alias("shared")), "parts-met")
    held = met.where("shared < 0").select(F.col("a").alias("part"), F.col("b").alias("name"))
    large = stage(held.groupBy("name").agg(F.count("*").alias("large")), "large-parts")
    pairs, of = met.where("shared > 0"), {c: large.select(F.col("name").alias(c), F.col("large").alias(f"large_{c}")) for c in "ab"}
    more = pairs.where(F.col("shared") < need("a", "b")).join(of["a"], "a").join(of["b"], "b").where(F.col("shared") + F.least("large_a", "large_b") >= need("a", "b"))
    tied = pairs.where(F.col("shared") >= need("a", "b")).select("a", "b").unionByName(more.select("a", "b"))
    alone = held.join(large.where(F.col("large") >= need("name")), "name")
    ends = [F.shiftright(c, NEED_BITS) for c in ("a", "b", "name", "part")]
    part = ends[3] + F.lit(1 << (64 - NEED_BITS))
    return tied.select(ends[0].alias("a"), ends[1].alias("b")).unionByName(alone.select(ends[2].alias("a"), part.alias("b")))


def wanted_sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame, count: int) -> DataFrame:
    """(doc, th, n, set) of the rows of docs that wanted(doc, th) names, count in all, and of a few others.

    Which rows are wanted is a filter of hashed bits, 16 for each up to FILTER_BITS, so that texts are read where they lie and not shuffled.
    """
    bits = 1 << 20
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    spot = F.pmod(F.xxhash64("doc", "th"), F.lit(bits)) + 1
    maps = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    known = np.zeros(bits // 8, np.uint8)
    for r in maps:
        known[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def run(batches):
        for b in batches:
            at = b.column("spot").to_numpy() - 1
            here = b.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            found = [ngrams(t, width) for t in _texts(here)]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([here.column("doc"), here.column("th"), pa.array([len(h) for h in found], pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["doc", "th", "n", "set"])

    return _rows(docs, id_col, text_col).withColumn("spot", spot).select("spot", "doc", "th", "t").mapInArrow(run, "doc long, th long, n long, set array<long>")


# ---- the metric join of a group


class Forest:
    def __init__(self, labels) -> None:
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]
        self.trees = len(first)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        self.trees -= i != j
        return i != j


class Region:
    """Sets by number, laid end to end as numbers of n-grams, so that one pass counts a set's intersections with all."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.first = np.cumsum(np.r_[0, self.sizes[:-1]])
        known, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def common(self, i: int) -> np.ndarray:
        own = self.flat[self.first[i] : self.first[i] + self.sizes[i]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[self.flat], self.first, dtype=np.int64)
        self.mark[own] = False
        return out


def metric_join(sets: list[np.ndarray], forest: Forest, names: list[int], similar: int, found: list[tuple[int, int]]) -> None:
    """Connect in forest, by name, what links of sets connect, and note the links in found. Sets are not empty."""
    radius, count = 1 - similar / 100 + 1e-9, len(sets)
    region, own = Region(sets), [forest.root(i) for i in names]
    if len(set(own)) < 2:
        return
    nearest, cell = np.full(count, 2.0), np.zeros(count, np.int64)
    pivots: list[int] = []
    away: list[np.ndarray] = []
    while nearest.max() > radius:  # sets that are linked to a pivot lie within the radius
        p = int(nearest.argmax())
        both = region.common(p)
        union = region.sizes + region.sizes[p] - both
        d = 1 - both / union
        for y in np.flatnonzero(100 * both >= similar * union).tolist():
            if y != p and forest.join(names[p], names[y]):
                found.append((names[p], names[y]))
        closer = d < nearest
        nearest[closer], cell[closer] = d[closer], len(pivots)
        pivots.append(p)
        away.append(d)
        if len({forest.root(i) for i in names}) < 2:
            return
    if len(pivots) == count:
        return  # every set was a pivot
    for k in range(len(pivots)):
        inner = np.flatnonzero(cell == k)
        reach = nearest[inner].max() + radius
        window = np.flatnonzero((cell != k) & (away[k] <= reach) & (away[k] <= nearest + 2 * radius))
        roots = np.array([forest.root(i) for i in names])
        window = window[roots[window] != roots[inner[0]]]  # all of a region are linked to its pivot
        if not len(window) or len(inner) == 1:
            continue  # a pivot alone has met all others
        chosen = np.r_[inner, window]
        if LEAF < len(chosen) < SPLIT * count:
            metric_join([sets[i] for i in chosen], forest, [names[i] for i in chosen], similar, found)
            continue
        small = Region([sets[i] for i in chosen])
        for j, y in enumerate(window.tolist(), len(inner)):
            both = small.common(j)[: len(inner)]
            near = np.flatnonzero(100 * both >= similar * (small.sizes[: len(inner)] + small.sizes[j] - both))
            if len(near) and forest.join(names[inner[near[0]]], names[y]):
                found.append((names[inner[near[0]]], names[y]))


def rare_groups(sets: list[np.ndarray], similar: int) -> list[list[int]]:
    """Sets that may be linked, by number: those reachable over n-grams that are among the rarest in both sets, counted in these sets.

    Of two linked sets each lacks less than its n - least_common + 1 rarest ones, so that they share one of these.
    """
    sizes = np.array([len(s) for s in sets])
    _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((flat, times[flat], of))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = order[place < (sizes - -(-similar * sizes // 100) + 1)[of]]
    first = first[np.lexsort((of[first], flat[first]))]
    forest = Forest(range(len(sets)))
    same = np.flatnonzero(flat[first[1:]] == flat[first[:-1]])
    for a, b in np.unique(np.stack([of[first[same]], of[first[same + 1]]], axis=1), axis=0).tolist():
        forest.join(a, b)
    out: dict[int, list[int]] = {}
    for i in range(len(sets)):
        out.setdefault(forest.root(i), []).append(i)
    return [g for g in out.values() if len(g) > 1]


def group_links(keys: list[int], roots: list[int], sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """Links (a, b) between keys that connect all that links of the group connect; keys of equal root are connected already."""
    forest, found = Forest(roots), []
    for own in rare_groups(sets, similar):
        metric_join([sets[i] for i in own], forest, own, similar, found)
    return [(keys[a], keys[b]) for a, b in found]


def _task_links(members: DataFrame, similar: int, total: int) -> DataFrame:
    """(a, b) from members(grp, key, root, n, set) whose groups fit one task, with total n-grams in all."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.lexsort((t.column("key").to_numpy(), t.column("grp").to_numpy()))
        grp, key, root = (t.column(c).to_numpy()[order] for c in ("grp", "key", "root"))
        sets, out = t.column("set"), []
        kept = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (key[1:] != key[:-1])])  # rows alike in id and text came twice
        for rows in np.split(kept, np.flatnonzero(np.diff(grp[kept])) + 1):
            own = [sets[int(order[i])].values.to_numpy().view(np.uint64) for i in rows]
            out += group_links(key[rows].tolist(), root[rows].tolist(), own, similar)
        a, b = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
        return pa.Table.from_arrays([a, b], ["a", "b"])

    tasks = int(total // TASK_SHINGLES) + 1
    return members.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks))).groupBy("task").applyInArrow(run, "a long, b long")


def _too_large() -> Column:
    return (F.col("docs") > GROUP_DOCS) | (F.col("shingles") > GROUP_SHINGLES)


def _divided(large: DataFrame, level: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """(links with pivots, members of regions with their windows) of large(grp, key, n, set, docs).

    Pivots are the documents of least hash, PIVOTS of a group in the mean. Windows go from a region to those of later pivots only,
    where each pair then meets. A document that shares nothing with a later pivot p has no distance to it here, but is at 1: whoever is linked to it
    from p's region is at 1 - r or more from p, and itself it is at 1 - 2 r or more from its own pivot. These are one more region, the rest.
    """
    order = F.xxhash64(F.lit(level), "key")
    some = (F.shiftrightunsigned(order, 1) < F.lit(float(2**63)) * PIVOTS / F.col("docs")) | (order == F.col("least"))
    lows = large.groupBy("grp").agg(F.min(order).alias("least"))
    pivots = large.join(lows, "grp").where(some).select("grp", F.col("key").alias("pivot"), F.col("n").alias("pn"), F.explode("set").alias("h"))
    pivots = stage(pivots, "pivot-ngrams")  # a few documents of each group, so that the others' n-grams stay where they are
    pivots = F.broadcast(pivots) if pivots.count() <= SENT_NGRAMS else pivots
    both = large.select("grp", "key", "n", F.explode("set").alias("h")).join(pivots, ["grp", "h"]).groupBy("grp", "key", "n", "pivot", "pn").agg(F.count("*").alias("both"))
    both = stage(both.withColumn("d", 1 - F.col("both") / (F.col("n") + F.col("pn") - F.col("both"))), "pivots")
    linked = F.lit(100) * F.col("both") >= F.lit(similar) * (F.col("n") + F.col("pn") - F.col("both"))
    links = both.where(linked & (F.col("key") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    radius = 1 - similar / 100 + 1e-9
    near = both.groupBy("grp", "key").agg(F.min(F.struct("d", "pivot")).alias("own"))
    met = both.join(near, ["grp", "key"])
    window = (F.col("pivot") >= F.col("own.pivot")) & (F.col("d") <= F.col("own.d") + 2 * radius)
    cells = met.where(window).select("grp", "key", "pivot")
    rest = large.select("grp", "key").join(near, ["grp", "key"], "left").where(F.coalesce(F.col("own.d"), F.lit(1.0)) >= 1 - 2 * radius).select("grp", "key", F.lit(None).cast("long").alias("pivot"))
    cells = cells.unionByName(rest).withColumn("cell", F.xxhash64(F.lit(level), "grp", "pivot"))
    return links, cells.select("grp", "cell", "key")


def links_in_groups(docs: DataFrame, id_col: str, text_col: str, width: int, similar: int, members: DataFrame) -> list[DataFrame]:
    """Tables (a, b) of links between keys that connect all that links connect within the groups of members(key, grp, doc, th, n), a written table.

    A key stands for one text, that of the row of docs with this id and hash of its text; n is how many n-grams it has.
    """
    sizes = stage(members.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")), "sizes")
    count = members.count()
    content = wanted_sets(docs, id_col, text_col, width, members.select("doc", "th"), count)
    of = members.select("key", "grp", F.col("doc").alias("of_doc"), F.col("th").alias("of_th"))
    placed = content.join(F.broadcast(of) if count <= SENT else of, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th"))).select("key", "grp", "n", "set")
    if large_ones := not sizes.where(_too_large()).isEmpty():
        content = placed = stage(placed, "content")
        large = placed.join(sizes.where(_too_large()), "grp").dropDuplicates(["grp", "key"])
        placed = placed.join(sizes.where(~_too_large()).select("grp"), "grp", "left_semi")
    total = sizes.where(~_too_large()).agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    links = [stage(_task_links(placed.withColumn("root", F.col("key")), similar, total), "links")]
    level = 0
    while large_ones:
        more, cells = _divided(stage(large, "large"), level, similar)
        links.append(stage(more, "links"))
        roots = connected_components(union_all(links))
        placed = cells.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed = placed.join(content.select("key", "n", "set").dropDuplicates(["key"]), "key").join(large.select("grp", F.col("docs").alias("parent")).distinct(), "grp")
        counts = placed.groupBy("cell").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.first("parent").alias("before")).where("r1 < r2").drop("r1", "r2")
        placed = stage(placed.drop("grp").join(counts, "cell").withColumnRenamed("cell", "grp"), "cells")
        stuck = _too_large() & (F.col("docs") > SPLIT * F.col("before"))
        blocks = F.ceil(2 * F.greatest(F.col("docs") / GROUP_DOCS, F.col("shingles") / GROUP_SHINGLES)).cast("int")
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("grp", F.least(k, F.col("own")), F.greatest(k, F.col("own")))))
        pairs = placed.where(stuck).withColumn("blocks", blocks).withColumn("own", own).withColumn("grp", other)
        columns = ["grp", "key", "root", "n", "set"]
        fitting = placed.where(~_too_large()).select(*columns).unionByName(pairs.select(*columns))
        links.append(stage(_task_links(fitting, similar, fitting.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "links"))
        large = placed.where(_too_large() & ~stuck).select("grp", "key", "n", "set", "docs", "shingles")
        large_ones, level = not large.isEmpty(), level + 1
    return links


def linked_sets(docs: DataFrame, id_col: str, text_col: str, width: int, similar: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, n, key, th) of every row, (key, doc, th, low, n) of every set, and (key, root) of those reachable over links, as jaccard_components has them."""
    if not 80 <= similar <= 100:
        raise ValueError("similar must be from 80 to 100")
    found = stage(ngram_sets(docs, id_col, text_col, width), "sets")
    sets = found.where("n >= 0")
    links = candidate_links(docs, id_col, text_col, width, similar, frequent_ngrams(found))
    groups = stage(connected_components(links).select(F.col("node").alias("high"), F.col("root").alias("grp")), "groups")
    known = sets.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "th")).alias("at"), F.min("doc").alias("low"), F.first("n").alias("n"))
    known = stage(known.select("key", "at.doc", "at.th", "low", "n"), "known")
    members = stage(known.withColumn("high", F.shiftright("key", NEED_BITS)).join(groups, "high").drop("high"), "members")
    links = links_in_groups(docs, id_col, text_col, width, similar, members)
    roots = stage(connected_components(union_all(links)), "roots").withColumnRenamed("node", "key")
    return sets, known, roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """(doc, n_shingles, component) for every row: component is the smallest id reachable over links.

    Two documents link when their sets of distinct word n-grams (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased; fewer words than width are one
    n-gram) have a Jaccard similarity of similar percent or more, 80 to 100. N-grams and sets are told apart by 64-bit hashes. Texts that are null
    or have no words have no n-grams and link with nothing. Equal sets are taken together first. Rows with a null id take part in links, and get
    their component's smallest id (null if it has none); rows that share an id share no component by that. Texts of any length, empty
    tables and further columns of any name need nothing special.
    """
    sets, known, roots = linked_sets(docs, id_col, text_col, width, similar)
    named = known.select("key", "low").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select(F.col("key").alias("key_"), "component")
    return sets.join(named, F.col("key") == F.col("key_"), "left").select("doc", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
