"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity bounds by language.

The model is over characters (code points as they are) in n-grams of ORDER. Documents are dealt to blocks of bounded size; a
block's distinct n-grams, with their counts in trusted text, are one sharded table, from which the probabilities of all
n-grams of the corpus come by joins and grouped sums. Each block is sent back the probabilities of its own n-grams and
nothing else, so neither the model nor the counts are ever in one place. There are two half models, so that no text is
judged by itself. Documents outside their language's quantiles of the trusted documents' perplexity are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontamination import gram_hashes
from .shared import stage, table

ORDER, BLOCK_BYTES, CHUNK, LEVEL, MERGE = 4, 24 << 20, 1_000_000, 7, 16
#: Marks the start (ORDER - 1 times) and the end of a text.
EDGE = "\n"


# ---- n-grams of a block


def chunks(column: pa.Array):
    """(row numbers, texts) of about CHUNK characters; null texts are empty."""
    rows, texts, size = [], [], 0
    for k, t in enumerate(column):
        rows.append(k)
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, hashes of the n-grams, where they start, and their number in each text: one a character and one for the end."""
    lengths = np.array([len(t) + 1 for t in texts])
    pad = EDGE * (ORDER - 1)
    codes = np.frombuffer((pad + (EDGE + pad).join(texts) + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return codes, gram_hashes(codes, ORDER)[at], at, lengths


class GramCounts:
    """Distinct n-grams with their counts in trusted text of either half."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str], half: int | None) -> None:
        """half is that of trusted texts, None for others, whose n-grams are listed with counts of 0."""
        codes, hashes, at, _ = grams(texts)
        keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
        counts = np.zeros((len(keys), 2), np.int64)
        if half is not None:
            counts[:, half] = n
        self.parts.append((keys, codes[at[first][:, None] + np.arange(ORDER)], counts))
        if len(self.parts) >= MERGE:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty((0, ORDER), np.uint32), np.zeros((0, 2), np.int64)
        keys, codes, counts = (np.concatenate(x) for x in zip(*self.parts))
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(back.ravel(), counts[:, k], len(keys)) for k in (0, 1)], axis=1)
        return keys, codes[first], sums.astype(np.int64)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue())


def _unpack(packed: pa.ChunkedArray):
    for rows in packed:
        yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows.as_py()))


def packed(rows: DataFrame) -> DataFrame:
    """(block_, rows_): the rows of each block, compressed, in as many pieces as there are batches."""

    def run(batches):
        for b in batches:
            block = b.column("block_").to_numpy()
            rest = b.drop_columns(["block_"])
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]], pa.int64()), pa.array([_pack(rest.take(pa.array(part)))], pa.binary())], ["block_", "rows_"])

    return rows.mapInArrow(run, "block_ long, rows_ binary")


# ---- the model


def discounts(counts: DataFrame, half: int) -> list[Column]:
    """Aggregates n1 to n4 (n-grams seen so often), the total, and the number of all n-grams."""
    c = F.col(f"c{half}")
    return [*[F.count_if(c == k).alias(f"n{k}_{half}") for k in (1, 2, 3, 4)], F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"all_{half}")]


def discount(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more; some mass is always left for the unseen."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.1 if k > 1 else 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(gram, p0, p1) for every row of counts(gram, c0, c1), which lists each n-gram once: p(last character | the others).

    Lower orders count in how many distinct longer n-grams an n-gram ends. An unseen context has the probability of the
    shorter one; the shortest is uniform over all characters of the table.
    """
    levels = [counts]
    for n in range(ORDER, 1, -1):
        shorter = levels[-1].groupBy(F.substring("gram", 2, n - 1).alias("gram")).agg(*[F.count_if(F.col(f"c{h}") > 0).alias(f"c{h}") for h in (0, 1)])
        levels.append(stage(shorter, f"grams-{n - 1}"))
    out = None
    for n, level in zip(range(1, ORDER + 1), reversed(levels)):
        facts = level.agg(F.count("*").alias("chars"), *discounts(level, 0), *discounts(level, 1)).first()
        context = Window.partitionBy(F.substring("gram", 1, n - 1))
        if out is None:
            uniform = F.lit(1.0 / max(1, facts["chars"]))
            rows = level.withColumns({"q0": uniform, "q1": uniform})
        else:
            shorter = out.select(F.col("gram").alias("tail_"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            rows = level.withColumn("tail_", F.substring("gram", 2, n - 1)).join(shorter, "tail_")
        made = {}
        for h in (0, 1):
            d = [F.lit(x) for x in discount(*[facts[f"n{k}_{h}"] for k in (1, 2, 3, 4)])]
            c = F.col(f"c{h}")
            off = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
            # the shortest context is that of every n-gram: its sums are known already, and no task gathers them
            total = F.lit(facts[f"all_{h}"]) if n == 1 else F.sum(c).over(context).cast("double")
            spared = F.lit(level.agg(F.coalesce(F.sum(off), F.lit(0.0))).first()[0]) if n == 1 else F.sum(off).over(context)
            made[f"p{h}"] = F.when(total > 0, (c - off) / total + spared / total * F.col(f"q{h}")).otherwise(F.col(f"q{h}"))
        out = rows.select("gram", *[p.alias(k) for k, p in made.items()])
    return out


# ---- scores


def half_of(id_col: str) -> Column:
    """0 or 1, by a hash of the id."""
    return F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int")


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, carry: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """carry0_ and so on (the columns carry of every row), n_ (characters and the end), blank_ (no word), trusted_ and perplexity."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(int(size // block_bytes) + 1))
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).where("q = 1 and x = 0")
    good = good.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("good_"))
    ids = docs.select(block.alias("block_"), F.col(id_col).alias("id_")).where("id_ is not null")
    trusted = stage(ids.join(good, F.col("id_") == F.col("good_")).select("block_", "good_").distinct(), "trusted")
    names = [f"carry{i}_" for i in range(len(carry))]

    def bundles(extra: list[Column]) -> DataFrame:
        return packed(docs.select(block.alias("block_"), F.col(id_col).alias("id_"), F.col(text_col).alias("t_"), half_of(id_col).alias("half_"), *extra))

    def count(own: pa.Table, good: pa.Table) -> pa.Table:
        found, known = GramCounts(), good.column("good_").combine_chunks()
        for b in _unpack(own.column("rows_")):
            half = np.where(pc.is_in(b.column("id_"), known).to_numpy(zero_copy_only=False), b.column("half_").to_numpy(), 2)
            for h in (0, 1, 2):
                for _, texts in chunks(b.column("t_").filter(pa.array(half == h))):
                    found.add(texts, h if h < 2 else None)
        _, codes, counts = found.merged()
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        made = pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string())
        return pa.Table.from_arrays([pa.array(np.repeat(own.column("block_")[0].as_py() if len(own) else 0, len(made)).astype(np.int64)), made, pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["block_", "gram", "c0", "c1"])

    seen = bundles([]).groupBy("block_").cogroup(trusted.groupBy("block_")).applyInArrow(count, "block_ long, gram string, c0 long, c1 long")
    seen = stage(seen, "grams")
    counts = stage(seen.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), f"grams-{ORDER}")
    logs = kneser_ney(counts).select("gram", *[F.ln(f"p{h}").cast("float").alias(f"l{h}") for h in (0, 1)])
    lookup = seen.select("block_", "gram").join(logs, "gram").unionByName(trusted, allowMissingColumns=True)
    fields = [T.StructField(a, docs.schema[c].dataType) for a, c in zip(names, carry)]
    shape = T.StructType([*fields, T.StructField("n_", T.LongType()), T.StructField("blank_", T.BooleanType()), T.StructField("trusted_", T.BooleanType()), T.StructField("perplexity", T.DoubleType())])

    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        known = asked.column("good_").drop_null().combine_chunks()
        asked = asked.filter(pc.is_valid(asked.column("gram")))
        text = "".join(asked.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
        keys = gram_hashes(np.frombuffer(text, np.uint32), ORDER)[::ORDER]
        order = np.argsort(keys)
        # a text of half h is scored with the model of the other half
        keys, logs = keys[order], np.stack([asked.column(f"l{1 - h}").to_numpy()[order] for h in (0, 1)]).astype(np.float64) if len(order) else None
        out = []
        for b in _unpack(own.column("rows_")):
            half, total, n = b.column("half_").to_numpy(), np.zeros(b.num_rows), np.ones(b.num_rows, np.int64)
            for rows, texts in chunks(b.column("t_")):
                _, hashes, _, lengths = grams(texts)
                each = logs[np.repeat(half[rows], lengths), np.searchsorted(keys, hashes)]
                total[rows], n[rows] = np.add.reduceat(each, np.cumsum(lengths) - lengths), lengths
            blank = pc.invert(pc.match_substring_regex(pc.fill_null(b.column("t_"), ""), r"\S"))
            trust = pc.fill_null(pc.is_in(b.column("id_"), known), False)
            out.append(pa.Table.from_arrays([*[b.column(c) for c in names], pa.array(n), blank, trust, pa.array(np.exp(-total / n))], [f.name for f in shape]))
        return pa.concat_tables(out)

    every = bundles([F.col(c).alias(a) for a, c in zip(names, carry)])
    return every.groupBy("block_").cogroup(lookup.groupBy("block_")).applyInArrow(score, shape)


LOW, HIGH, EVIDENCE, MARGIN = 0.001, 0.995, 200.0, 1.2


def bounds(scored: DataFrame, low: float = LOW, high: float = HIGH, evidence: float = EVIDENCE, margin: float = MARGIN) -> DataFrame:
    """(lang, mean, least, most) from trusted rows (lang, n, perplexity); the row with null lang is over all.

    mean is of log perplexity. least and most are quantiles of the distance from it, weighted by n / (n + evidence), times margin:
    a short text says little, and needs a larger distance to be out of bounds.
    """
    rows = scored.select("lang", "n", F.ln("perplexity").alias("l"))
    both = rows.where("lang is not null").withColumn("over", F.lit(1)).unionByName(rows.withColumn("lang", F.lit(None).cast("string")).withColumn("over", F.lit(0)))
    means = both.groupBy("over", "lang").agg((F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("mean"))
    far = both.join(means.select(F.col("over").alias("o_"), F.col("lang").alias("l_"), "mean"), (F.col("over") == F.col("o_")) & F.col("lang").eqNullSafe(F.col("l_")))
    q = F.percentile_approx((F.col("l") - F.col("mean")) * F.col("n") / (F.col("n") + evidence), [low, high], 10_000)
    return far.groupBy("over", "lang", "mean").agg(q.alias("q")).select("lang", "mean", (F.col("q")[0] * margin).alias("least"), (F.col("q")[1] * margin).alias("most"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH, evidence: float = EVIDENCE, columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or only the given columns of it) with perplexity, least, most (the bounds for the text's language and length) and keep.

    Trusted are the documents that labels calls good (quality 1) and not toxic. A language without trusted
    documents, or a null one, has the bounds of all of them; without any trusted document everything is kept.
    A text without a word is kept, there being nothing to judge; a null text counts as empty. Rows that share an id share its
    label and are judged one by one. Columns of the names made here, in docs, are replaced. Languages are expected to be few:
    their bounds are collected.
    """
    made = ("perplexity", "least", "most", "keep")
    carry = [c for c in (columns or docs.columns) if c not in made]
    found = stage(scored(docs, labels, id_col, text_col, [*carry, lang_col], block_bytes), "scored").withColumnRenamed(f"carry{len(carry)}_", "lang_")
    limits = {r["lang"]: (r["mean"], r["least"], r["most"]) for r in bounds(found.where("trusted_").select(F.col("lang_").alias("lang"), F.col("n_").cast("double").alias("n"), "perplexity"), low, high, evidence).collect()}
    rest = limits.pop(None, (None, None, None))
    known = F.create_map(*[F.lit(x) for k, v in sorted(limits.items()) for x in (k, F.array(*map(F.lit, v)))]) if limits else F.lit(None).cast("map<string,array<double>>")
    limit = F.coalesce(known[F.coalesce("lang_", F.lit(""))], F.array(*[F.lit(x).cast("double") for x in rest]))
    stretch = (F.col("n_") + evidence) / F.col("n_")
    least, most = (F.exp(limit[0] + limit[k] * stretch) for k in (1, 2))
    keep = F.col("blank_") | F.coalesce(F.col("perplexity").between(least, most), F.lit(True))
    return found.select(*[F.col(f"carry{i}_").alias(c) for i, c in enumerate(carry)], "perplexity", least.alias("least"), most.alias("most"), keep.alias("keep"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])
