"""Alignments of chains to their full sequences: by residue number where that fits, else semi-global with affine gaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .constraints import aligned_positions

#: Cells of one batch of dynamic programming tables, a byte each, and of the largest table.
BATCH_CELLS, MOST_CELLS = 1 << 24, 1 << 30
LOW = -(1 << 28)


@dataclass(frozen=True)
class Gaps:
    """A gap's cost: open for its first letter, extend for each further one, both negative. Gaps at the ends are free."""

    open: int = -5
    extend: int = -2


def semi_global(t: np.ndarray, s: np.ndarray, t_len: np.ndarray, s_len: np.ndarray, matrix: np.ndarray, gaps: Gaps) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(scores, steps) of a batch of pairs of letter codes t (pairs, m) and s (pairs, n), filled up at the end.

    Rows are one vector for all pairs: within a row, the best open gap is a running maximum. A byte a cell tells which way is
    best, diagonal before a gap in s, before a gap in t. Steps are 0 both letters, 1 gap in s, 2 gap in t, with their
    number, from the start.
    """
    pairs, m = t.shape
    n = s.shape[1]
    rows = np.arange(pairs)
    column = np.arange(n + 1)
    best = np.zeros((pairs, n + 1), np.int32)
    down = np.full((pairs, n + 1), LOW, np.int32)  # ends in a gap in s
    ways = np.zeros((m + 1, pairs, n + 1), np.uint8)
    last_row = np.zeros((pairs, n + 1), np.int32)
    last_col = np.zeros((pairs, m + 1), np.int32)
    for i in range(1, m + 1):
        diagonal = np.full((pairs, n + 1), LOW, np.int32)
        diagonal[:, 1:] = best[:, :-1] + matrix[t[:, i - 1][:, None], s]
        opened = best + gaps.open
        extended = down + gaps.extend
        down = np.maximum(opened, extended)
        down_opens = opened >= extended
        plain = np.maximum(diagonal, down)
        plain[:, 0] = 0
        running = np.maximum.accumulate(plain - gaps.extend * column, axis=1)
        right = np.full((pairs, n + 1), LOW, np.int32)
        right[:, 1:] = running[:, :-1] + gaps.open + gaps.extend * (column[1:] - 1)
        best = np.maximum(plain, right)
        right_opens = np.zeros((pairs, n + 1), bool)
        right_opens[:, 1:] = right[:, 1:] == best[:, :-1] + gaps.open
        ways[i] = (diagonal >= best) | (down >= best) << 1 | down_opens << 2 | right_opens << 3
        here = t_len == i
        last_row[here] = best[here]
        last_col[:, i] = best[rows, s_len]
    # the best end in the last row or column of each pair; of equal ones that nearest to the corner of both ends
    last_row[column > s_len[:, None]] = LOW
    last_col[np.arange(m + 1) > t_len[:, None]] = LOW
    j, i = n - last_row[:, ::-1].argmax(axis=1), m - last_col[:, ::-1].argmax(axis=1)
    in_row = last_row[rows, j] >= last_col[rows, i]
    i, j = np.where(in_row, t_len, i), np.where(in_row, j, s_len)
    scores = np.where(in_row, last_row[rows, j], last_col[rows, i])
    steps: list[list[tuple[int, int]]] = [[(1, int(a)), (2, int(b))] for a, b in zip(t_len - i, s_len - j)]
    walks = []
    state = np.zeros(pairs, np.int64)  # 0 anywhere, 1 within a gap in s, 2 within a gap in t
    live = (i > 0) & (j > 0)
    while live.any():
        way = ways[i, rows, j]
        at = np.where(state > 0, state, np.where(way & 1, 0, np.where(way & 2, 1, 2)))
        ends = ((at == 1) & ((way & 4) > 0)) | ((at == 2) & ((way & 8) > 0))
        walks.append(np.where(live, at, -1))
        i, j = i - (live & (at < 2)), j - (live & (at != 1))
        state = np.where((at == 0) | ends, 0, at)
        live &= (i > 0) & (j > 0)
    walk = np.array(walks, np.int8).reshape(-1, pairs)
    for k in range(pairs):
        own = walk[:, k][walk[:, k] >= 0]
        cut = np.flatnonzero(np.diff(own)) + 1
        steps[k] += [(int(p[0]), len(p)) for p in np.split(own, cut) if len(p)]
        steps[k] += [(1, int(i[k])), (2, int(j[k]))]
        steps[k].reverse()
    return scores, steps


def gapped(t: str, s: str, steps: list[tuple[int, int]]) -> tuple[str, str]:
    a, b, i, j = [], [], 0, 0
    for kind, count in steps:
        a.append("-" * count if kind == 2 else t[i : i + count])
        b.append("-" * count if kind == 1 else s[j : j + count])
        i, j = i + (0 if kind == 2 else count), j + (0 if kind == 1 else count)
    return "".join(a), "".join(b)


def aligned(pairs: DataFrame, substitutions: DataFrame, t: str = "t", s: str = "s", gaps: Gaps = Gaps()) -> DataFrame:
    """pairs with t_aligned, s_aligned and alignment_score: the best semi-global alignment of two sequences without gaps.

    substitutions is (a, b, s), a square table of at most a few hundred letters; letters that it lacks are worth its least value against any. A null
    sequence is empty. Pairs of like lengths are aligned together; two sequences whose lengths multiply to over MOST_CELLS are an error.
    """
    entries = substitutions.select("a", "b", F.col("s").cast("int").alias("s")).collect()
    letters = sorted({r["a"] for r in entries} | {r["b"] for r in entries})
    code = {x: k for k, x in enumerate(letters)}
    matrix = np.full((len(letters) + 1, len(letters) + 1), min((r["s"] for r in entries), default=0), np.int32)
    for r in entries:
        matrix[code[r["a"]], code[r["b"]]] = r["s"]

    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in texts])
        out = np.full((len(texts), sizes.max(initial=0)), len(letters), np.int64)
        for k, x in enumerate(texts):
            out[k, : len(x)] = [code.get(c, len(letters)) for c in x]
        return out, sizes

    def run(batches):
        for b in batches:
            one, two = ([x or "" for x in b.column(c).to_pylist()] for c in (t, s))
            order = sorted(range(len(one)), key=lambda k: (len(one[k]), len(two[k])))
            found: list = [None] * len(one)
            group: list[int] = []

            def flush():
                (a, la), (c, lc) = codes([one[k] for k in group]), codes([two[k] for k in group])
                scores, steps = semi_global(a, c, la, lc, matrix, gaps)
                for k, score, own in zip(group, scores.tolist(), steps):
                    found[k] = (*gapped(one[k], two[k], own), score)
                group.clear()

            wide = 0
            for k in order:
                if (len(one[k]) + 1) * (len(two[k]) + 1) > MOST_CELLS:
                    raise ValueError(f"sequences of {len(one[k])} and {len(two[k])} letters are too long to be aligned")
                wide = max(wide, len(two[k]))
                if group and (len(one[k]) + 1) * (wide + 1) * (len(group) + 1) > BATCH_CELLS:
                    flush()
                    wide = len(two[k])
                group.append(k)
            if group:
                flush()
            new = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "t_aligned", "s_aligned", "alignment_score"])

    names = {"t_aligned", "s_aligned", "alignment_score"}
    rows = pairs.drop(*names)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{shape}, t_aligned string, s_aligned string, alignment_score int")


def aligned_columns(alignments: DataFrame, keys: list[str], t: str = "t_aligned", s: str = "s_aligned") -> DataFrame:
    """(keys, col, t, s, t_pos, s_pos): the columns of two gapped sequences of equal length; positions count letters from 1."""
    letters = [F.filter(F.split(c, ""), lambda x: x != "").alias(n) for c, n in ((t, "t"), (s, "s"))]
    rows = alignments.select(*keys, F.posexplode(F.arrays_zip(*letters)).alias("col", "p")).select(*keys, "col", "p.t", "p.s")
    return aligned_positions(rows, keys)


def by_number(residues: DataFrame, keys: list[str], letter: str = "aa", number: str = "rnum") -> DataFrame:
    """(keys, sequence, s, numbered): each chain's letters in order of number, and whether each stands at its number in the full sequence.

    Numbers must rise and lie within the sequence. A chain is one row of its letters; residues of one number are taken in order
    of letter, and do not fit.
    """
    rows = residues.select(*keys, "sequence", F.struct(F.col(number).alias("n"), F.col(letter).alias("c")).alias("r"))
    chains = rows.groupBy(*keys, "sequence").agg(F.sort_array(F.collect_list("r")).alias("r"))
    numbers = F.transform("r", lambda r: r["n"])
    fits = F.forall("r", lambda r: F.coalesce(F.substring("sequence", r["n"], F.lit(1)) == r["c"], F.lit(False)) & (r["n"] > 0)) & (F.size(F.array_distinct(numbers)) == F.size(numbers))
    return chains.select(*keys, "sequence", F.array_join(F.transform("r", lambda r: F.coalesce(r["c"], F.lit("X"))), "").alias("s"), fits.alias("numbered"), numbers.alias("numbers"))


def chain_columns(residues: DataFrame, substitutions: DataFrame, keys: list[str], letter: str = "aa", number: str = "rnum", gaps: Gaps = Gaps()) -> DataFrame:
    """(keys, col, t, s, t_pos, s_pos, fallback) of every chain of residues(keys, number, letter, sequence) to its full sequence.

    A chain whose letters stand at their numbers is placed by these. Any other is aligned; an alignment that puts a gap into the full
    sequence is an error, since the chain then has a residue that the sequence lacks. The error hangs on the rows themselves, so it is raised
    whatever columns are selected.
    """
    chains = by_number(residues, keys, letter, number)
    good = chains.where("numbered")
    letters = F.filter(F.split("sequence", ""), lambda c: c != "")
    each = good.select(*keys, "numbers", F.posexplode(letters).alias("col", "t"))
    at = F.array_position("numbers", F.col("col") + 1)
    direct = each.select(*keys, "col", "t", F.when(at > 0, F.col("t")).otherwise("-").alias("s"), (F.col("col") + 1).alias("t_pos"), F.when(at > 0, at.cast("int")).alias("s_pos"), F.lit(False).alias("fallback"))
    other = aligned(chains.where("not numbered").select(*keys, F.col("sequence").alias("t"), "s"), substitutions, gaps=gaps)
    lacking = F.raise_error(F.concat_ws(" ", F.lit("a chain does not fit its sequence:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    checked = other.where(F.when(F.contains("t_aligned", F.lit("-")), lacking).otherwise(F.lit(True)))
    return direct.unionByName(aligned_columns(checked, keys).withColumn("fallback", F.lit(True)))


def alignment_score(columns: DataFrame, substitutions: DataFrame, keys: list[str], gaps: Gaps = Gaps()) -> DataFrame:
    """(keys, score) of given columns: substitutions and gaps, but for a gap that the alignment begins or ends with."""
    w, span = Window.partitionBy(*keys).orderBy("col"), Window.partitionBy(*keys)
    least = substitutions.agg(F.min("s").cast("int")).scalar()
    side = F.when((F.col("t") != "-") & (F.col("s") != "-"), 0).when(F.col("s") == "-", 1).otherwise(2)
    rows = columns.withColumn("side_", side).withColumn("opens_", ~F.col("side_").eqNullSafe(F.lag("side_").over(w)))
    rows = rows.withColumn("run_", F.sum(F.col("opens_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("free_", (F.col("run_") == 1) | (F.col("run_") == F.max("run_").over(span)))
    rows = rows.join(F.broadcast(substitutions.select(F.col("a").alias("t"), F.col("b").alias("s"), F.col("s").cast("int").alias("w_"))), ["t", "s"], "left")
    worth = F.when(F.col("side_") == 0, F.coalesce("w_", least)).when(F.col("free_"), 0).when(F.col("opens_"), gaps.open).otherwise(gaps.extend)
    return rows.groupBy(*keys).agg(F.sum(worth).cast("long").alias("score"))
