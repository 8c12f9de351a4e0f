"""SimHash near-dedup: segment-popcount embedding, grid range join, exact check, components.

A 64-bit fingerprint becomes 32 counts of set bits, one for each two-bit segment. Manhattan distance between
such vectors is a lower bound of the Hamming distance: fingerprints that differ in at most 3 bits have vectors
at most 3 apart, so in one of the two halves of 16 segments they are at most 1 apart. The grid join looks up
each half's own cell and the cells one step up; pairs found are verified on the fingerprints themselves.

Three bits of 64 find only texts that are nearly equal. For links down to a given shingle similarity, each text
also gets fingerprints of small samples of its shingles: the few that are smallest under a permutation of the
hashes, without those that over a thousandth of the texts have. Texts reachable over equal fingerprints of samples form a group; groups
are then joined exactly on their shingles. Samples miss a link now and then; where none may be missed, the exact join of ngram_join gives the links.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ngram_join import counted_ngrams, frequent_ngrams, linked_sets, links_in_groups
from .shared import connected_components, stage, table, union_all

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Shingles in a sample. Texts of similarity s agree in one sample with a chance of about s ** SAMPLE.
SAMPLE = 3


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z lower-cased; of all its words if they are fewer than width."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit value: a bit is set where over half the hashes have it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        block = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def sample_bits(distinct: np.ndarray, samples: int, seed: int = SEED, frequent: np.ndarray | None = None) -> list[int]:
    """Fingerprints of the SAMPLE shingles, of sorted distinct ones, that are smallest under each of so many permutations.

    Frequent shingles (sorted) are left out, unless fewer than SAMPLE others are left.
    """
    if frequent is not None and len(frequent):
        others = distinct[frequent[np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)] != distinct]
        distinct = others if len(others) >= SAMPLE else distinct
    if not len(distinct):
        return []
    odd = np.random.default_rng(seed).integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
    if len(distinct) <= SAMPLE:
        return [majority_bits(distinct)] * samples
    return [majority_bits(distinct[np.argpartition(distinct * m, SAMPLE)[:SAMPLE]]) for m in odd]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, samples: int = 0, frequent: np.ndarray | None = None) -> DataFrame:
    """(doc, fp, th, n, parts) for every row: th is the text's hash; parts are the samples' fingerprints and n the distinct shingles.

    Without words, fp is 0 and parts are empty; without samples, parts are empty and n is 0.
    """

    def run(batches):
        for b in batches:
            fps, sizes, parts = [], [], []
            for t in b.column("t").cast(pa.large_binary()):
                hashes = shingle_hashes(t.as_py() or b"", width, seed)
                fps.append(majority_bits(hashes))
                distinct = np.unique(hashes) if samples else hashes[:0]
                sizes.append(len(distinct))
                parts.append(sample_bits(distinct, samples, seed, frequent) if samples else [])
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fps, pa.int64()), b.column("th"), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], ["doc", "fp", "th", "n", "parts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc long, fp long, th long, n long, parts array<long>")


def segment_counts(half: Column) -> Column:
    """The 16 counts (0 to 2) of the two-bit segments of half a fingerprint, each in two bits."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def _halves(df: DataFrame) -> DataFrame:
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return df.select("*", segment_counts(low).alias("g0"), segment_counts(high).alias("g1"))


def close_pairs(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b) for distinct fingerprints fps(fp) at most 3 bits apart, each pair at least once."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with one step each cover at most 3 differing bits")
    both = _halves(fps.select("fp"))
    own = both.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col("g0").alias("cell")), F.struct(F.lit(1).alias("g"), F.col("g1").alias("cell")))).alias("k")).select(F.col("fp").alias("b"), "k.g", "k.cell")
    steps = []
    for g in (0, 1):
        half = F.col(f"g{g}")
        steps.append(F.struct(F.lit(g).alias("g"), half.alias("cell"), F.lit(False).alias("up")))
        for i in range(16):
            room = F.shiftrightunsigned(half, 2 * i).bitwiseAND(F.lit(3)) < 2
            steps.append(F.when(room, F.struct(F.lit(g).alias("g"), (half + F.lit(1 << (2 * i))).alias("cell"), F.lit(True).alias("up"))))
    probe = both.select(F.col("fp").alias("a"), F.explode(F.array(*steps)).alias("k")).where("k is not null").select("a", "k.g", "k.cell", "k.up")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    return probe.join(own, (probe["g"] == own["g"]) & (probe["cell"] == own["cell"]) & near & (F.col("up") | (F.col("a") < F.col("b")))).where("a != b").select("a", "b")


def sample_groups(nodes: DataFrame) -> DataFrame:
    """(key, grp), fingerprints of nodes(fp, parts) reachable over samples' fingerprints: each is tied to the next one of equal sample."""
    entries = nodes.select("fp", F.posexplode("parts").alias("part", "bits"))
    tied = entries.select("fp", F.lead("fp").over(Window.partitionBy("part", "bits").orderBy("fp")).alias("next")).where("next is not null")
    return connected_components(tied.select(F.col("fp").alias("a"), F.col("next").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("grp"))


def similar_texts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> list[DataFrame]:
    """Tables (a, b) of links between fingerprints of nodes(fp, low, th, n, parts) whose texts, in one group of samples, share enough shingles.

    Every two texts of a group whose similarity reaches the threshold are connected, whatever else the group holds.
    """
    known = nodes.where("low is not null and n > 0")
    groups = sample_groups(known)
    members = groups.join(known.select(F.col("fp").alias("key"), F.col("low").alias("doc"), "th", "n"), "key")
    return links_in_groups(docs, id_col, text_col, width, ceil(100 * similarity), stage(members, "members"))


def equal_sets(fps: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similar: int) -> DataFrame:
    """(a, b), links between fingerprints of fps(doc, fp, th) whose texts links of similar percent connect, exactly, or that have one set of shingles.

    Texts are told apart by their sets, so those of one fingerprint each have their own links.
    """
    sets, _, roots = linked_sets(docs, id_col, text_col, width, similar)
    of = sets.where("key is not null").join(roots, "key", "left").select(F.col("doc").alias("d"), F.col("th").alias("t"), F.coalesce("root", "key").alias("grp")).distinct()
    entries = fps.select("doc", "th", "fp").join(of, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("grp", "fp").distinct()
    tied = entries.select("fp", F.lead("fp").over(Window.partitionBy("grp").orderBy("fp")).alias("next")).where("next is not null")
    return stage(tied.select(F.col("fp").alias("a"), F.col("next").alias("b")), "equal-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, most_bits: int = MOST_BITS, samples: int = 0, similarity: float = 0.8, similar: int | None = None) -> DataFrame:
    """(doc, fp, component) for every row; component is the smallest id reachable over links.

    Fingerprints link at most_bits or fewer differing bits. With samples above 0, texts also link where at least
    the given share of their distinct shingles is common (Jaccard, in whole percent, 0.8 or more), found with a chance of
    1 - (1 - share ** SAMPLE) ** samples, share being that of the shingles that are not frequent. With similar, a whole percentage from 80 on,
    all texts of that similarity or more link: none is left out. Equal fingerprints are taken together
    first, so groups of copies cost one fingerprint; the text with the smallest id stands for them. Rows with a null id have a fingerprint, take
    part in its links, and get the component's smallest id (null if it has none); they are not compared on shingles. Where rows share an id, any of
    their texts stands for it.
    """
    frequent = None
    if samples:
        frequent = frequent_ngrams(counted_ngrams(docs, text_col, lambda t: shingle_hashes(t, width, seed)))
    fps = stage(fingerprints(docs, id_col, text_col, width, seed, samples, frequent), "fingerprints")
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "th")))
    nodes = fps.groupBy("fp").agg(first.alias("at"), F.min_by("n", "doc").alias("n"), F.min_by("parts", "doc").alias("parts")).select("fp", F.col("at.doc").alias("low"), F.col("at.th").alias("th"), "n", "parts")
    nodes = stage(nodes, "nodes") if samples else nodes
    links = close_pairs(nodes, most_bits)
    if samples:
        links = union_all([links, *similar_texts(nodes, docs, id_col, text_col, width, similarity)])
    if similar is not None:
        links = links.unionByName(equal_sets(fps, docs, id_col, text_col, width, similar))
    roots = connected_components(links)
    groups = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = groups.groupBy("root").agg(F.min("low").alias("component"))
    named = groups.select("fp", "root").join(lows, "root").select(F.col("fp").alias("fp_"), "component")
    return fps.join(named, F.col("fp") == F.col("fp_")).select("doc", "fp", "component")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
