"""Conversation structure repair: cheapest edits that give every conversation the roles (s?(ua)+)?, by a time-major tensor DP.

Turns are sorted once, by ranges, and numbered; stretches of at most SEGMENT consecutive turns of a conversation become rows of one byte
a turn (role initial and fault), so no text enters the DP and no conversation must fit one task. Stretches are bucketed by length. For a
bucket, the costs to go from every state are one tensor (turn, stretch, state), filled backwards turn by turn for all
stretches at once, and the edits are traced forwards in the same way. A conversation of several stretches has each stretch's 4 x 4
matrix of costs between states; these are chained backwards to the costs at each stretch's end, and forwards to its entry state.

States: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's. Initials: 0 s, 1 u, 2 a, 3 any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BLANKS, stage, table

SEGMENT_BITS = 12
#: Turns times stretches in one tensor.
CELLS = 1 << 20
REROLE, DELETE, INSERT = 2, 3, 2
#: Bits of a code: initial, blank or duplicate (must go), ends in the middle of a sentence; NO_ROW fills a bucket up.
MUST, CUT, NO_ROW = 4, 8, 16
NEVER = 1 << 28
#: State after an inserted or reroled turn; state after a kept turn by state and initial, -1 where it may not stand.
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs to end a conversation from each state.
DONE = [0, 2 * INSERT, INSERT, 0]


# ---- the tensor


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs from every state when turns may be inserted first."""
    out = np.empty_like(cost)
    out[:, 2] = np.minimum(cost[:, 2], cost[:, 3] + INSERT)
    out[:, 3] = np.minimum(cost[:, 3], cost[:, 2] + INSERT)
    out[:, 0] = np.minimum(cost[:, 0], out[:, 2] + INSERT)
    out[:, 1] = np.minimum(cost[:, 1], out[:, 2] + INSERT)
    return out


def choices(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go when a turn is deleted, kept or reroled, by stretch and state; after are the costs behind the turn."""
    extra = ((code & CUT) > 0).astype(after.dtype)[:, None]
    stays = ((code & MUST) == 0)[:, None]
    to = KEPT.T[code & 3]
    keep = np.where(stays & (to >= 0), extra + np.take_along_axis(after, np.maximum(to, 0), axis=1), NEVER)
    rerole = np.where(stays, REROLE + extra + after[:, NEXT], NEVER)
    return after + DELETE, keep, rerole


def sweep(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go (turns + 1, stretches, states) for codes (turns, stretches), from the costs behind the last turn."""
    cost = np.empty((len(codes) + 1, *end.shape), np.int64)
    cost[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        best = with_inserts(np.minimum.reduce(choices(codes[t], cost[t + 1])))
        cost[t] = np.where((codes[t] == NO_ROW)[:, None], cost[t + 1], np.minimum(best, NEVER))
    return cost


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(state before each turn and its inserts, inserts, edit, state at the end): cheapest, of these the least in ASCII order.

    Edits are 0 delete, 1 keep, 2 rerole. D < I < K < R, and each leads on in one way only, so the least possible letter is taken.
    """
    shape, rows = codes.shape, np.arange(codes.shape[1])
    came, inserts, edits = np.zeros(shape, np.int8), np.zeros(shape, np.int8), np.zeros(shape, np.int8)
    for t, code in enumerate(codes):
        came[t] = state
        there = code != NO_ROW
        delete, keep, _ = choices(code, cost[t + 1])
        for _ in range(2):
            to_go = cost[t, rows, state]
            more = there & (delete[rows, state] != to_go) & (cost[t, rows, NEXT[state]] + INSERT == to_go)
            state = np.where(more, NEXT[state], state)
            inserts[t] += more
        to_go = cost[t, rows, state]
        gone, kept = delete[rows, state] == to_go, keep[rows, state] == to_go
        edits[t] = np.where(gone, 0, np.where(kept, 1, 2))
        state = np.where(~there | gone, state, np.where(kept, KEPT[state, code & 3], NEXT[state]))
    return came, inserts, edits, state


def buckets(codes: pa.ListArray):
    """(rows, codes by turn and row) for each bucket of rows of about equal length, filled up at the end."""
    offsets, flat = codes.offsets.to_numpy(), codes.values.to_numpy().astype(np.int8)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes[order], 1))).astype(np.int64))
    for group in np.split(order, np.flatnonzero(np.diff(width)) + 1):
        longest = int(sizes[group].max()) if len(group) else 0
        for rows in np.split(group, range(k := max(1, CELLS // max(longest, 1)), len(group), k)):
            out = np.full((longest, len(rows)), NO_ROW, np.int8)
            turn = np.arange(longest)[:, None]
            inside = turn < sizes[rows]
            out[inside] = flat[(offsets[rows] + turn)[inside]]
            yield rows, out


# ---- turns


def numbered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, at), staged: at rises with conversation and turn (nulls first), equal turns by role, then text.

    Turns are dealt by ranges of all these, so that a conversation may lie in many partitions.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "text", "row"]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def fault_codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, at, code, fault), staged: each turn's first fault of blank, duplicate and truncated, or null."""
    rest, letter = F.rtrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    light = rows.select("conv", "turn", "at", initial.alias("initial"), (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"))
    firsts = light.groupBy("conv", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    code = F.col("initial") + F.when(fault == "truncated", CUT).when(fault.isNotNull(), MUST).otherwise(0)
    return stage(light.join(firsts, "at", "left").select("conv", "turn", "at", code.cast("byte").alias("code"), fault.alias("fault")), "codes")


def segments(coded: DataFrame) -> DataFrame:
    """(conv, block, first, codes), staged: stretches of consecutive turns of a conversation, first being the number of the first."""
    turns = F.sort_array(F.collect_list(F.struct("at", "code")))
    grouped = coded.groupBy("conv", F.shiftright("at", SEGMENT_BITS).alias("block")).agg(F.min("at").alias("first"), turns.alias("turns"))
    return stage(grouped.select("conv", "block", "first", F.col("turns.code").alias("codes")), "segments")


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    on = left["conv"].eqNullSafe(right["conv"])
    for name in more:
        on &= left[name] == right[name]
    return on


def _chained(parts: DataFrame, backward: bool, value: str, kind: str) -> DataFrame:
    """(conv, block, value, last) of stretches parts(conv, block, given): costs behind each from matrices, or entries from exits.

    One row a conversation, with 16 numbers for 4,096 turns.
    """

    def run(batches):
        for b in batches:
            out = []
            for row in b.column("steps").to_pylist():
                found, now = [], DONE if backward else 0
                for step in reversed(row) if backward else row:
                    found.append(now)
                    if backward:
                        now = np.minimum(np.array(step["given"]).reshape(4, 4) + np.array(now), NEVER).min(axis=1).tolist()
                    else:
                        now = step["given"][now]
                out.append(found[::-1] if backward else found)
            blocks = [[s["block"] for s in row] for row in b.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(blocks, pa.list_(pa.int64())), pa.array(out, pa.list_(pa.list_(pa.int64()) if backward else pa.int64()))], ["conv", "blocks", "found"])

    steps = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "given"))).alias("steps"))
    rows = steps.mapInArrow(run, f"conv {parts.schema['conv'].dataType.simpleString()}, blocks array<bigint>, found array<{kind}>")
    each = rows.select("conv", F.posexplode(F.arrays_zip("blocks", "found")).alias("i", "x"), F.size("blocks").alias("n"))
    return each.select("conv", F.col("x.blocks").alias("block"), F.col("x.found").alias(value), (F.col("i") == F.col("n") - 1).alias("last"))


def _matrices(segs: DataFrame) -> DataFrame:
    """(conv, block, given): costs from each state to each state, 16 numbers."""

    def run(batches):
        for b in batches:
            given = np.empty((b.num_rows, 16), np.int64)
            for rows, codes in buckets(b.column("codes")):
                end = np.tile(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(rows), 1))  # one column for each state at the end
                cost = sweep(np.repeat(codes, 4, axis=1), end)[0].reshape(len(rows), 4, 4)
                given[rows] = cost.transpose(0, 2, 1).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(given.tolist(), pa.list_(pa.int64()))], ["conv", "block", "given"])

    return segs.mapInArrow(run, f"conv {segs.schema['conv'].dataType.simpleString()}, block bigint, given array<bigint>")


def _exits(segs: DataFrame) -> DataFrame:
    """(conv, block, given): the state that the best edits leave each stretch in, for each state at its start."""

    def run(batches):
        for b in batches:
            given, ends = np.empty((b.num_rows, 4), np.int64), np.array(b.column("end").to_pylist()).reshape(-1, 4)
            for rows, codes in buckets(b.column("codes")):
                four = np.repeat(codes, 4, axis=1)
                given[rows] = trace(four, sweep(four, np.repeat(ends[rows], 4, axis=0)), np.tile(np.arange(4), len(rows)))[-1].reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(given.tolist(), pa.list_(pa.int64()))], ["conv", "block", "given"])

    return segs.mapInArrow(run, f"conv {segs.schema['conv'].dataType.simpleString()}, block bigint, given array<bigint>")


def _edits(segs: DataFrame) -> DataFrame:
    """(at, part, edit, role, cost): inserts before a turn are its parts 0 and 1, the turn is 2, inserts at the end are 3 and 4."""
    roles = np.array(["", "", "user", "assistant"], object)

    def run(batches):
        for b in batches:
            ends, entry = np.array(b.column("end").to_pylist()).reshape(-1, 4), b.column("entry").to_numpy()
            first, last = b.column("first").to_numpy(), b.column("last").to_numpy(zero_copy_only=False)
            for rows, codes in buckets(b.column("codes")):
                came, inserts, edits, left = trace(codes, sweep(codes, ends[rows]), entry[rows])
                out = []
                at = first[rows] + np.arange(len(codes))[:, None]
                state = came.astype(np.int64)
                for k in range(2):
                    here = inserts > k
                    state = np.where(here, NEXT[state], state)
                    out.append((at[here], np.full(here.sum(), k), np.full(here.sum(), "I", object), roles[state[here]], np.full(here.sum(), INSERT)))
                here = codes != NO_ROW
                kind = edits[here]
                out.append((at[here], np.full(len(kind), 2), np.array(["D", "K", "R"], object)[kind], np.where(kind == 2, roles[NEXT[state[here]]], ""), np.where(kind == 0, DELETE, np.where(kind == 2, REROLE, 0) + ((codes[here] & CUT) > 0))))
                final = first[rows] + here.sum(axis=0) - 1
                for k in range(2):
                    more = last[rows] & ((left == 1) | (left == 2))
                    left = np.where(more, NEXT[left], left)
                    out.append((final[more], np.full(more.sum(), 3 + k), np.full(more.sum(), "I", object), roles[left[more]], np.full(more.sum(), INSERT)))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()))], ["at", "part", "edit", "role", "cost"])

    return segs.mapInArrow(run, "at bigint, part int, edit string, role string, cost bigint")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(edits, faults). edits(conv, at, part, edit, role, text, cost): the cheapest edits, in order of at and part within a conversation.

    edit is K keep (0), R rerole to user or assistant (2), D delete (3; what blank turns and duplicates need) or I insert a turn
    without text (2); an undeleted truncated turn costs 1 more. Of equally cheap edits those least in ASCII order are taken. The
    turns that are not D, in order, are the repaired conversation. faults(conv, gaps, blank, duplicate, truncated, illegal) counts what
    was found. A null role or text is one space; null turns come first; turns of equal number come by role, then text, so rows that
    are equal in all of these are interchangeable; null ids form a conversation of their own. Texts of any length, empty tables and
    further columns of any name need nothing special.
    """
    rows = numbered(turns, id_col, turn_col, role_col, text_col)
    coded = fault_codes(rows)
    segs = segments(coded)
    many = segs.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1")
    single = segs.join(many, _same(segs, many), "left_anti").select("first", "codes", F.array(*[F.lit(x).cast("long") for x in DONE]).alias("end"), F.lit(0).cast("long").alias("entry"), F.lit(True).alias("last"))
    several = stage(segs.join(many, _same(segs, many), "left_semi"), "several")
    ends = _chained(_matrices(several), True, "end", "array<bigint>")
    ended = stage(several.join(ends, _same(several, ends, "block")).select(several["conv"], several["block"], "first", "codes", "end", "last"), "ended")
    entries = _chained(_exits(ended), False, "entry", "bigint").drop("last")
    entered = ended.join(entries, _same(ended, entries, "block")).select("first", "codes", "end", "entry", "last")
    edits = _edits(single.unionByName(entered))
    texts = rows.select("conv", "at", F.col("role").alias("old"), "text")
    own = F.col("part") == 2
    full = edits.join(texts, "at").select("conv", "at", "part", "edit", F.when(F.col("role") == "", F.col("old")).otherwise(F.col("role")).alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"), "cost")
    return full, faults(coded, segs)


def faults(coded: DataFrame, segs: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal): turn numbers missing, first faults, neighbours that are not su, ua or au."""
    n = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = coded.groupBy("conv", "turn").agg(n("blank"), n("duplicate"), n("truncated")).groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("different"))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("high", "low", "different")]
    gaps = F.coalesce(wide[0] - wide[1] + 1 - wide[2], F.lit(0)).cast("long").alias("gaps")
    legal = lambda a, b: (((a == 0) | (a == 2)) & (b == 1)) | ((a == 1) & (b == 2))
    who = F.transform("codes", lambda c: c.bitwiseAND(F.lit(3).cast("byte")).cast("int"))
    inside = segs.select("conv", "block", who.alias("who")).select("conv", "block", F.size(F.filter(F.arrays_zip(F.expr("slice(who, 1, size(who) - 1)").alias("a"), F.expr("slice(who, 2, size(who) - 1)").alias("b")), lambda p: ~legal(p["a"], p["b"]))).alias("bad"), F.element_at("who", 1).alias("head"), F.element_at("who", -1).alias("tail"))
    before = F.lag("tail").over(Window.partitionBy("conv").orderBy("block"))
    across = inside.select("conv", "bad", "head", before.alias("was"))
    illegal = across.groupBy("conv").agg(F.sum(F.col("bad") + F.when(F.col("was").isNotNull() & ~legal(F.col("was"), F.col("head")), 1).otherwise(0)).alias("illegal"))
    return counts.join(illegal, _same(counts, illegal)).select(counts["conv"], gaps, "blank", "duplicate", "truncated", "illegal")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with one turn in four damaged, by crc32 of conv_id:turn; nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's edits and text meet in one row, since audit and hash are values of whole conversations."""
    turns = table(spark, sf_dir, "conversations")
    edits, found = repair(damaged(turns))
    steps = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("at", "part", "edit", F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).alias("line")))).alias("steps"))
    made = steps.select("conv", "cost", F.concat_ws("", "steps.edit").alias("audit"), F.sha2(F.concat_ws("\n", "steps.line"), 256).alias("repaired_sha256"))
    conversations = turns.select("conv_id").distinct()
    out = conversations.join(found, conversations["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv").join(made, F.col("conv_id").eqNullSafe(made["conv"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
