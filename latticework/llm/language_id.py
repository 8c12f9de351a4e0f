"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are trained by expectation-maximisation (forward-backward) on word counts of labelled documents.
Distinct words are scored once a batch, in arrays of words of equal length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage, table

#: In training only, words are cut after LONGEST code points; probabilities are not below FLOOR, of unknown characters UNKNOWN.
LONGEST, FLOOR, UNKNOWN = 32, 1e-7, 1e-6
#: The forward algorithm goes STEP code points at a time and is scaled after each; so many code points of words are taken together.
STEP, TOGETHER = 16, 640_000
#: Where the vocabulary file is, unless the setting spark.latticework.pieces names another.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = PIECES) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class Lattice:
    """Finds pieces in words: hashes of all substrings up to the longest piece."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.most = pieces, max(map(len, pieces))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(max(self.most, LONGEST) + 1, _BASE)].astype(np.uint64))
        hashes = np.empty(len(pieces), np.uint64)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for rows in by.values():
            hashes[rows] = self._prefixes(_codes([pieces[i] for i in rows]))[:, -1]
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out[:, j + 1] = out[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def ids(self, codes: np.ndarray, after: int = 0):
        """{(end, length): piece number or -1 for every row}, of pieces that end after so many code points."""
        p, found = self._prefixes(codes), {}
        with np.errstate(over="ignore"):
            for j in range(after + 1, codes.shape[1] + 1):
                for n in range(1, min(j, self.most) + 1):
                    h = p[:, j] - p[:, j - n] * self.powers[n]
                    k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                    hit = self.sorted[k] == h
                    if n == 1 or hit.any():
                        found[j, n] = np.where(hit, self.order[k], -1)
        return found

    def groups(self, words: list[str]):
        """(row numbers, code points) of words of one length at a time, TOGETHER code points or one word."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for width, rows in by.items():
            many = max(1, TOGETHER // max(1, width))
            for k in range(0, len(rows), many):
                part = rows[k : k + many]
                yield np.array(part), _codes([words[i] for i in part])

    def log_probs(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities, a column for each of table's languages; table[-1] is for unknowns.

        Of a word of any length, the forward probabilities of the last code points, as many as a piece can have, go on from step to step.
        """
        out = np.zeros((len(words), table.shape[1]))
        for rows, codes in self.groups(words):
            last = np.zeros((self.most, len(rows), table.shape[1]))  # the last of it is where the word has been read to
            last[-1] = 1.0
            for s in range(0, codes.shape[1], STEP):
                part = codes[:, max(0, s - self.most) : s + STEP]
                read = min(s, self.most)
                alpha = np.concatenate([last, np.zeros((part.shape[1] - read, *last.shape[1:]))])
                for (j, n), ids in self.ids(part, read).items():
                    at = self.most - 1 + j - read
                    if n == 1:
                        alpha[at] += alpha[at - 1] * table[ids]
                    else:
                        hit = np.flatnonzero(ids >= 0)
                        alpha[at, hit] += alpha[at - n, hit] * table[ids[hit]]
                scale = alpha[-1]
                out[rows] += np.log(scale)
                last = alpha[-self.most :] / scale
        return out

    def expected(self, words: list[str], counts: np.ndarray, langs: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected piece counts by (piece, language) of words that have one language each."""
        total = np.zeros(table.size)
        for rows, codes in self.groups(words):
            width, lang = codes.shape[1], langs[rows]
            ids = self.ids(codes)
            probs = {k: np.where(i >= 0, table[i, lang], UNKNOWN if k[1] == 1 else 0.0) for k, i in ids.items()}
            alpha, beta = np.zeros((width + 1, len(rows))), np.zeros((width + 1, len(rows)))
            alpha[0] = beta[width] = 1.0
            for (j, n), p in probs.items():
                alpha[j] += alpha[j - n] * p
            for (j, n), p in sorted(probs.items(), key=lambda x: -x[0][0]):
                beta[j - n] += beta[j] * p
            for (j, n), p in probs.items():
                share = counts[rows] * alpha[j - n] * p * beta[j] / alpha[width]
                hit = ids[j, n] >= 0
                total += np.bincount(ids[j, n][hit] * table.shape[1] + lang[hit], share[hit], total.size)
        return total.reshape(table.shape)


def text_words(column: pa.Array) -> pa.ListArray:
    """Words of each text, split at white space; a null text has none."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(column, "").cast(pa.large_string())))


def stretches(word: str) -> list[str]:
    """The mark of a word's start and the word, in stretches of LONGEST code points, to train on."""
    word = "▁" + word
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


class LanguageModel:
    """langs, and the probability of every piece in each (the last row is for unknown characters)."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with lang_pred and score, the posterior probability under equal priors; columns of these names go.

        A null text, one without a letter, or a model without languages: und and 0.
        """
        sent = docs.sparkSession.sparkContext.broadcast((self.langs, self.pieces, self.probs))
        rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
        docs = docs.select(*rest)
        schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

        def run(batches):
            langs, pieces, probs = sent.value
            lattice = Lattice(pieces)
            for b in batches:
                texts = b.column(text_col)
                scores = score_texts(lattice, probs, texts)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if langs:
                    post = np.exp(scores - scores.max(axis=1, keepdims=True))
                    top = np.where(letters, post.max(axis=1) / post.sum(axis=1), 0.0)
                    named = [langs[k] if ok else "und" for k, ok in zip(scores.argmax(axis=1), letters)]
                else:
                    top, named = np.zeros(b.num_rows), ["und"] * b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, pa.string()), pa.array(top, pa.float64())], [*b.schema.names, "lang_pred", "score"])

        return docs.mapInArrow(run, schema)


def score_texts(lattice: Lattice, probs: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Log probability of every text in every language. Texts are taken in turns of about 2,000,000 characters."""
    out = np.zeros((len(texts), probs.shape[1]))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(2_000_000, sizes[-1], 2_000_000)) + 1 if len(sizes) else [], len(texts)].astype(int))
    for a, z in zip(cuts, cuts[1:]):
        words = text_words(texts.slice(a, z - a))
        coded = words.flatten().dictionary_encode()
        if not len(coded.dictionary):
            continue
        each = lattice.log_probs(["▁" + w for w in coded.dictionary.to_pylist()], probs)
        of = np.repeat(np.arange(a, z), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        index = coded.indices.to_numpy()
        for k in range(probs.shape[1]):
            out[:, k] += np.bincount(of, each[index, k], len(texts))
    return out


def train(labelled: DataFrame, pieces: list[str], lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = 1500, rounds: int = 3) -> LanguageModel:
    """Piece probabilities from documents with a language: about max_docs of each, picked by a hash of their ids."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).alias("u"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    number = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(pieces) + 1, max(1, len(langs))), 1.0 / len(pieces))
    table[-1] = UNKNOWN
    if not langs:
        return LanguageModel([], pieces, table)
    most = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 20, int((1 << 20) * max_docs / sizes[lang]) + 1))])
    words = rows.where(F.col("u") < most[F.col("lang")]).select("lang", F.explode(F.split("t", r"\s+")).alias("w")).where("w != ''")
    counts = stage(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, number, table))

        def run(batches):
            pieces, number, table = sent.value
            lattice, total = Lattice(pieces), np.zeros_like(table)
            for b in batches:
                parts = [stretches(w) for w in b.column("w").to_pylist()]
                times = list(map(len, parts))
                n = np.repeat(b.column("n").to_numpy().astype(float), times)
                lang = np.repeat(np.array([number[x] for x in b.column("lang").to_pylist()], np.int64), times)
                total += lattice.expected([s for p in parts for s in p], n, lang, table)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros_like(table)
        new[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
        new[-1] = 0
        table = np.maximum((new + 0.01) / (new.sum(axis=0) + 0.01 * len(pieces)), FLOOR)
        table[-1] = UNKNOWN
    return LanguageModel(langs, pieces, table)


def held_out(doc: Column) -> Column:
    return F.pmod(F.crc32(doc.cast("string")), F.lit(3)) == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = load_pieces(spark.conf.get("spark.latticework.pieces", PIECES))
    model = train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), pieces)
    out = model.predict(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
