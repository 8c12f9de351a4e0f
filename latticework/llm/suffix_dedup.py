"""Suffix-array dedup of repeated byte strings, by induced sorting in shards.

Equal strings of LENGTH bytes have the same smallest GRAM-byte hash within, so consecutive starts that share it form a
piece, and pieces are dealt to shards by it: equal strings always meet. Pieces whose hash occurs once cannot
repeat and stay out; equal pieces are counted together first and enter their shard once. A shard's suffix array
comes from induced sorting: suffixes are classified, the leftmost smaller ones are sorted by their substrings and then by
refined ranks, and all others are induced from them, bucket by bucket. Prefixes common to neighbours, back in text order,
tell the starts whose string stands elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import gram_hashes
from .shared import stage, table

LENGTH, GRAM, MOST_STARTS, SHARD_BYTES, HOT_BYTES = 200, 32, 4096, 2 << 20, 8 << 20
#: How often groups over HOT_BYTES are cut anew. Whose text a piece is from: a row's (id, hash), or a larger piece.
DEEPEST, OWNER = 12, ["o1", "o2", "o3"]
_ODD = np.uint64(0xD6E8FEB86659FD93)


# ---- suffix arrays


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is not (an end counts as smallest)."""
    step = np.sign(np.diff(text.astype(np.int32), append=-1))
    nearest = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(nearest[::-1])[::-1]] > 0


def refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by key, in place; gives the rows that are still tied. A rank is the number of smaller ones."""
    order = np.lexsort((key, rank[rows]))
    rows, key = rows[order], key[order]
    old = rank[rows]
    at = np.arange(len(rows))
    group = np.r_[True, old[1:] != old[:-1]]
    part = group | np.r_[True, key[1:] != key[:-1]]
    rank[rows] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    size = np.diff(np.r_[np.flatnonzero(part), len(rows)])
    return rows[np.repeat(size, size) > 1]


def sort_leftmost(text: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the leftmost smaller suffixes in order of their first depth characters."""
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    m, n = len(starts), len(text)
    if m < 2:
        return starts
    ends = np.r_[starts[1:] + 1, n]  # a substring reaches to the next such start, inclusive
    symbol = np.r_[(text.astype(np.int64) << 1 | smaller) + 1, np.zeros(8, np.int64)]
    rank, rows = np.zeros(m, np.int64), np.arange(m)
    for done in range(0, depth, 6):
        at = starts[rows] + done
        key = np.zeros(len(rows), np.int64)
        for k in range(6):
            key = key << 10 | np.where(at + k < ends[rows], symbol[np.minimum(at + k, n)], 0)
        rows = refine(rank, rows, key)
        rows = rows[starts[rows] + done + 6 < ends[rows]]
        if not len(rows):
            break
    step = 1
    size = np.bincount(rank, minlength=m)[rank]
    rows = np.flatnonzero(size > 1)
    while len(rows) and 2 * step < 2 * depth:  # every substring has two characters of its own at least
        rows = refine(rank, rows, np.where(rows + step < m, rank[np.minimum(rows + step, m - 1)], -1))
        step *= 2
    return starts[np.argsort(rank, kind="stable")]


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order (of their first depth characters, if given). Characters are below 500."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    text = text.astype(np.uint16)
    smaller = smaller_types(text)
    leftmost = sort_leftmost(text, smaller, depth or n)
    top = int(text.max()) + 1
    seeds = np.split(leftmost, np.searchsorted(text[leftmost], np.arange(1, top)))
    larger: list[list[np.ndarray]] = [[] for _ in range(top)]
    lesser: list[list[np.ndarray]] = [[] for _ in range(top)]

    def push(found, lists):
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(found, cuts):
            if len(part):
                lists[text[part[0]]].append(part)

    def induced(rows, kind):
        rows = rows[rows > 0] - 1
        return rows[smaller[rows] == kind]

    push(np.array([n - 1]), larger)
    for c in range(top):
        queue, larger[c], k = larger[c], [], 0
        while k < len(queue):
            larger[c].append(queue[k])
            found = induced(queue[k], False)
            same = text[found] == c
            if same.any():
                queue.append(found[same])
            push(found[~same], larger)
            k += 1
        push(induced(seeds[c], False), larger)
    for c in range(top - 1, -1, -1):
        queue, k = lesser[c], 0
        while k < len(queue):
            found = induced(queue[k], True)
            same = text[found] == c
            if same.any():
                queue.append(found[same])
            push(found[~same], lesser)
            k += 1
        if larger[c]:
            push(induced(np.concatenate(larger[c])[::-1], True), lesser)
    empty = [np.empty(0, np.int64)]
    return np.concatenate([x for c in range(top) for x in (np.concatenate(larger[c] or empty), np.concatenate(lesser[c] or empty)[::-1])])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every suffix, in text order, how many characters it has in common with the one before it in order (0 for the first).

    Where both suffixes go on from two that are neighbours and share their first character, the value is one less than there; only the
    other places are compared, character by character.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    start = np.flatnonzero(~goes_on & (before >= 0))
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]  # 0 is beyond the end
    word = np.zeros(n + 4, np.uint64)
    for k in range(4):
        word = word << np.uint64(16) | padded[k : k + n + 4]
    value, rows, done = np.zeros(n, np.int64), start, 0
    while len(rows):
        a, b = rows + done, before[rows] + done
        inside = np.maximum(a, b) + 4 <= n
        same = inside & (word[np.minimum(a, n)] == word[np.minimum(b, n)])
        rest, a, b = rows[~same], a[~same], b[~same]
        for _ in range(4):
            good = padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
            good &= np.maximum(a, b) < n
            value[rest[~good]] = b[~good] - before[rest[~good]]
            rest, a, b = rest[good], a[good] + 1, b[good] + 1
        value[rest] = b - before[rest]
        rows, done = rows[same], done + 4
    last = np.maximum.accumulate(np.where(goes_on, -1, np.arange(n)))
    return np.where(goes_on, value[last] - (np.arange(n) - last), value)


def repeated_starts(text: np.ndarray, order: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at the valid starts whose length characters are those of another valid start: one of its neighbours in order."""
    again = common_prefixes(text, order) >= length
    before = np.zeros(len(text), np.int64)
    before[order[1:]] = order[:-1]
    out = again.copy()
    out[before[again]] = True
    return out & valid


def shard_repeats(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every piece, the starts in it whose string stands elsewhere in the shard."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    left = np.repeat(ends, sizes) - np.arange(len(text))
    flags = repeated_starts(text, suffix_array(text, length), left >= length, length)
    return [np.flatnonzero(flags[e + 1 - s : e]) for e, s in zip(ends, sizes)]


# ---- pieces


def piece_runs(text: bytes, length: int = LENGTH, gram: int = GRAM, most: int = MOST_STARTS, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, number of starts, inward): consecutive starts whose strings have the same smallest gram hash.

    inward tells pieces that hold the gram more than once, which alone can repeat a string within themselves: there
    some start has the gram at its very place and the next start has it again.
    """
    n = len(text) - length + 1
    if n < 1:
        return (*[np.empty(0, np.int64)] * 3, np.empty(0, bool))
    h, w = gram_hashes(np.frombuffer(text, np.uint8), gram), length - gram + 1
    if salt:  # another order of the grams
        with np.errstate(over="ignore"):
            h = (h + np.uint64(salt)) * _ODD
            h = (h ^ (h >> np.uint64(29))) * _ODD
    rows = -(-len(h) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[: len(h)] = h
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[begin, n])
    inward = np.logical_or.reduceat(np.r_[(h[: n - 1] == low[:-1]) & (low[1:] == low[:-1]), False], begin)
    if count.max() > most:
        extra = -(-count // most)
        k = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
        begin, count, inward = np.repeat(begin, extra) + k * most, np.minimum(np.repeat(count, extra) - k * most, most), np.repeat(inward, extra)
    return low[begin].view(np.int64), begin, count, inward


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive values as (first, last + 1)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + 1).tolist()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("o1"), F.xxhash64(text).alias("o2"), F.lit(0).alias("o3"), text.cast("binary").alias("t"))


def _pieces(texts: DataFrame, length: int, salt: int) -> DataFrame:
    """(key, hash, n, owner, start, inward) of every piece of texts(owner, t). Pieces of pieces keep to their piece's key."""

    def run(batches):
        for b in batches:
            out, rows = [], []
            for i, (o1, t) in enumerate(zip(b.column("o1").to_pylist(), b.column("t"))):
                t = t.as_py()
                key, begin, count, inward = piece_runs(t, length, salt=salt)
                if len(key):
                    ends = (begin + count + length - 1).tolist()
                    content = np.fromiter((xxhash.xxh64_intdigest(t[a:z]) for a, z in zip(begin.tolist(), ends)), np.uint64, len(key)).view(np.int64)
                    if salt:
                        with np.errstate(over="ignore"):
                            key = key ^ (np.array([o1], np.int64).view(np.uint64) * _ODD).view(np.int64)
                    out.append((key, content, count.astype(np.int32), begin.astype(np.int32), inward))
                    rows.append(np.full(len(key), i))
            if out:
                key, content, count, begin, inward = (pa.array(np.concatenate(x)) for x in zip(*out))
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([key, content, count, *(b.column(c).take(of) for c in OWNER), begin, inward], ["key", "hash", "n", *OWNER, "start", "inward"])

    return texts.mapInArrow(run, "key long, hash long, n int, o1 long, o2 long, o3 int, start int, inward boolean")


def _same(left: DataFrame, right: DataFrame):
    return left["o1"].eqNullSafe(right["p1"]) & (left["o2"] == right["p2"]) & (left["o3"] == right["p3"])


def _spans(texts: DataFrame, length: int, shard_bytes: int, hot_bytes: int, depth: int = 0) -> DataFrame:
    """(owner, a, z): runs of starts in texts(owner, t) whose strings stand elsewhere too."""
    what = ["key", "hash", "n"]
    pieces = stage(_pieces(texts, length, depth), "pieces")
    often = stage(pieces.groupBy("key").agg(F.count("*").alias("c"), F.max("inward").alias("i")).where("c > 1 or i").select("key"), "often")
    pieces = stage(pieces.join(often, "key"), "repeated")
    kinds = stage(pieces.groupBy(*what).agg(F.count("*").alias("times"), F.min(F.struct(*OWNER, "start")).alias("at"), F.max("inward").alias("inward")), "kinds")
    groups = stage(kinds.groupBy("key").agg(F.count("*").alias("contents"), F.sum(F.col("n") + length - 1).alias("bytes"), F.max("inward").alias("within")).where("contents > 1 or within").select("key", "bytes"), "groups")
    whole = kinds.where("times > 1").select(*what, F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z"))
    mixed = kinds.join(groups, "key")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    asked = mixed.groupBy(*[F.col(f"at.{o}").alias(p) for o, p in zip(OWNER, ("p1", "p2", "p3"))]).agg(F.collect_list(F.struct(*what, "at.start", "bytes")).alias("ask"))

    def cut(batches):
        for b in batches:
            out = []
            for t, ask in zip(b.column("t"), b.column("ask").to_pylist()):
                t = t.as_py()
                out += [(x["key"], x["hash"], x["n"], x["bytes"], t[x["start"] : x["start"] + x["n"] + length - 1]) for x in ask]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], [*what, "bytes", "piece"])

    cuts = stage(texts.join(asked, _same(texts, asked)).select("t", "ask").mapInArrow(cut, "key long, hash long, n int, bytes long, piece binary"), "cuts")

    def run(t: pa.Table) -> pa.Table:
        _, first = np.unique(np.stack([t.column(c).to_numpy().astype(np.int64) for c in what], axis=1), axis=0, return_index=True)
        t = t.take(pa.array(first))  # rows alike in id and text have cut the same pieces
        found = [intervals(s) for s in shard_repeats(t.column("piece").to_pylist(), length)]
        of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        a, z = (pa.array([x[k] for f in found for x in f], pa.int64()) for k in (0, 1))
        return pa.Table.from_arrays([*(t.column(c).take(of) for c in what), a, z], [*what, "a", "z"])

    hot = F.col("bytes") > hot_bytes if depth < DEEPEST else F.lit(False)
    shard = F.pmod(F.xxhash64("key"), F.lit(int(total // shard_bytes) + 1))
    found = whole.unionByName(cuts.where(~hot).withColumn("shard", shard).groupBy("shard").applyInArrow(run, "key long, hash long, n int, a long, z long"))
    if depth < DEEPEST and not groups.where(hot).isEmpty():
        # a group too large for one shard: its pieces are cut again, by another order of the grams
        large = stage(cuts.where(hot).dropDuplicates(what).select(F.col("key").alias("o1"), F.col("hash").alias("o2"), F.col("n").alias("o3"), F.col("piece").alias("t")), "large")
        below = _spans(large, length, shard_bytes, hot_bytes, depth + 1)
        found = found.unionByName(below.select(F.col("o1").alias("key"), F.col("o2").alias("hash"), F.col("o3").alias("n"), "a", "z"))
    placed = pieces.join(stage(found, "found"), what)
    return placed.select(*OWNER, (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(p1, p2, p3, spans): of each row with repeats, the starts (first, last + 1) whose length bytes stand elsewhere too.

    p1 is the id and p2 the hash of the text, which tells apart rows that repeat an id; rows alike in both have the same spans.
    Pieces of one key that come to more than hot_bytes are cut and dealt anew by another order of the grams, so that they too
    are sorted in shards of bounded size.
    """
    spans = _spans(_rows(docs, id_col, text_col), length, shard_bytes, hot_bytes)
    return spans.groupBy(*[F.col(o).alias(p) for o, p in zip(OWNER, ("p1", "p2", "p3"))]).agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, kept binary, n_bytes, removed array of (a, z)) for every row; a null text is empty.

    Bytes in a repeated string go, wherever it stands, so kept may break a UTF-8 character. Rows that have both id and text in
    common are copies of each other like any other.
    """
    spans = stage(repeated_spans(docs, id_col, text_col, length, shard_bytes, hot_bytes), "spans")
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            kept, sizes, gone = [], [], []
            for t, spans in zip(b.column("t"), b.column("spans").to_pylist()):
                t = t.as_py()
                merged: list[list[int]] = []
                for a, z in sorted((x["a"], x["z"] + length - 1) for x in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                edges = [0, *(x for m in merged for x in m), len(t)]
                kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2])))
                sizes.append(len(t))
                gone.append([{"a": a, "z": z} for a, z in merged])
            yield pa.RecordBatch.from_arrays([b.column("o1"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))], ["doc", "kept", "n_bytes", "removed"])

    return rows.join(spans, _same(rows, spans), "left").select("o1", "t", "spans").mapInArrow(run, "doc long, kept binary, n_bytes long, removed array<struct<a: long, z: long>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["z"] - x["a"])
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
