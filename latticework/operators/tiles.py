"""Radius joins of dense points: tiles of them meet in one task each, block against block, and only what is summed leaves it.

Where most points are near most others, pairs are many times the points: as rows they cost far more than the distances. So points are dealt by
grid cell, and crowded cells by hash, to groups of bounded size, and a kernel gets each group's left points and what may be near them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ["cell_x", "cell_y", "cell_z"]
#: Left and right points of a group, about; rows and columns of a block; counters of a block's rows, at most.
LEFT, RIGHT, ROWS, COLUMNS, COUNTERS = 1 << 12, 1 << 17, 32, 1024, 1 << 22
#: Most cells of one right key and one bin of distance that are counted by products of matrices, not one by one.
PRODUCTS = 256
#: Most cells of a left point that are counted in whole blocks, of all pairs at once.
WHOLE = 4096


def steps() -> Column:
    """One row for each of the 27 steps a, b, c to a cell and those around it."""
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))


def tiled(left: DataFrame, right: DataFrame, radius: float, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keys: list[str] | None = None) -> DataFrame:
    """kernel(left, right) of groups of points with x, y, z: each left point meets all right points of equal keys within radius, and others.

    A left point can be in several groups, with other right points in each. Points without a place are left out. Rows that are equal in all columns
    are in the same groups.
    """
    at = [*[f"key_{k}" for k in range(len(keys or []))], *CELLS]

    def placed(points: DataFrame, p: str) -> DataFrame:
        place = [F.col(k).alias(n) for k, n in zip(keys or [], at)] + [F.floor(F.col(v) / radius).cast("long").alias(c) for v, c in zip("xyz", CELLS)]
        return points.where("x is not null and y is not null and z is not null").select(*[F.col(c).alias(p + c) for c in points.columns], *place)

    mine, theirs = placed(left, "l_"), placed(right, "r_")
    crowd = theirs.groupBy(*at).agg(F.count("*").alias("n"))
    for c in CELLS:
        crowd = crowd.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    crowd = crowd.groupBy(*at).agg(F.ceil(F.sum("n") / RIGHT).alias("r_parts"))
    sizes = mine.groupBy(*at).agg(F.ceil(F.count("*") / LEFT).alias("l_parts")).join(crowd, at)

    def dealt(points: DataFrame, p: str, other: str) -> DataFrame:
        own = [c for c in points.columns if c.startswith(p)]
        part, each = F.pmod(F.xxhash64(*own), F.col(f"{p}parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}parts") - 1))
        return points.join(sizes, at).select(*own, *at, part.alias(f"{p}part"), each.alias(f"{other}part"))

    around = theirs.withColumn("step", steps()).withColumns({c: F.col(c) + F.col(f"step.{s}") for c, s in zip(CELLS, "abc")}).drop("step")
    both = dealt(mine, "l_", "r_").unionByName(dealt(around, "r_", "l_"), allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        is_left = pc.is_valid(group["l_x"])
        sides = []
        for p, points, own in (("l_", left_columns, is_left), ("r_", right_columns, pc.invert(is_left))):
            sides.append(group.filter(own).select([p + c for c in points]).rename_columns(points))
        return kernel(*map(in_order, sides))

    left_columns, right_columns = left.columns, right.columns
    width = radius / 2

    def in_order(points: pa.Table) -> pa.Table:
        place = [np.floor(numbers(points, v) / width) for v in "zyx"]
        return points.take(pa.array(np.lexsort(place)))

    return both.groupBy(*at, "l_part", "r_part").applyInArrow(run, schema)


def numbers(points: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return points[name].cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)


def coded(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Columns as numbers of their distinct values, -1 where they are null, and the values."""
    whole = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    values = pc.unique(whole.drop_null())
    number = pc.fill_null(pc.index_in(whole, values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(number, np.cumsum([len(x) for x in columns])[:-1]), values


def blocks(left: pa.Table, right: pa.Table, radius: float, rows: int = ROWS) -> Iterator[tuple[slice, Iterator[tuple[slice, np.ndarray]]]]:
    """Rows of left with blocks of right in which points may be within radius of them: (left rows, (right rows, squared distances) of each block).

    The distances' space is used again for the next block.
    """
    a, b = (np.array([numbers(t, v) for v in "xyz"]) for t in (left, right))
    starts = np.arange(0, b.shape[1], COLUMNS)
    low, high = (f.reduceat(b, starts, axis=1) if len(starts) else b for f in (np.minimum, np.maximum))
    far = radius * radius * (1 + 1e-9)
    space = np.empty((2, rows * COLUMNS))

    def met(part: slice) -> Iterator[tuple[slice, np.ndarray]]:
        own = a[:, part]
        gap = np.maximum(0.0, np.maximum(low - own.max(axis=1)[:, None], own.min(axis=1)[:, None] - high))
        for s in starts[~((gap * gap).sum(axis=0) > far)].tolist():
            there = slice(s, min(s + COLUMNS, b.shape[1]))
            shape = own.shape[1], there.stop - s
            d2, d = (x[: shape[0] * shape[1]].reshape(shape) for x in space)
            np.subtract(own[0][:, None], b[0, there], out=d2)
            d2 *= d2
            for k in (1, 2):
                np.subtract(own[k][:, None], b[k, there], out=d)
                d *= d
                d2 += d
            yield there, d2

    for s in range(0, a.shape[1], rows):
        part = slice(s, min(s + rows, a.shape[1]))
        yield part, met(part)


def row_sums(left: pa.Table, right: pa.Table, radius: float, values: Callable[[slice, slice, np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """For each left point the sums of values(left rows, right rows, squared distances), columns of them, over its blocks."""
    out = np.zeros((len(left), columns))
    for part, met in blocks(left, right, radius):
        for there, d2 in met:
            out[part] += values(part, there, d2)
    return out


def apart_test(left: pa.Table, right: pa.Table, chain: str, number: str, separation: int) -> Callable[[slice | np.ndarray, slice | np.ndarray], np.ndarray] | None:
    """Whether pairs are in different chains or so many numbers apart: of rows against rows for slices, else one by one; None if all are."""
    (lc, rc), _ = coded(left[chain], right[chain])
    ln, rn = numbers(left, number), numbers(right, number)
    if separation <= 0 and not (np.isnan(ln).any() or np.isnan(rn).any()):
        return None

    def test(i, j):
        if isinstance(i, slice):
            x, y, p, q = lc[i][:, None], rc[j][None], ln[i][:, None], rn[j][None]
        else:
            x, y, p, q = lc[i], rc[j], ln[i], rn[j]
        return (np.abs(p - q) >= separation) | ((x != y) & (x >= 0) & (y >= 0))

    return test


class Cells:
    """What a term counts in a tile: keys that left points have, keys of pairs by number, and roles(i, j, d2) that give (i, cell) of the pairs that hold.

    The last cell is that of pairs with a missing key or bin.
    """

    def __init__(self, own: dict[str, pa.ChunkedArray], keys: dict[str, pa.Array], sizes: dict[str, int], roles: list) -> None:
        self.own, self.keys, self.sizes, self.roles = own, keys, sizes, roles
        #: Of terms with one key, of right points, and bins of distance: (numbers of that key, edges of the bins in squared distance, pairs that hold by slices).
        self.plain: tuple[np.ndarray, np.ndarray, Callable] | None = None
        #: The roles once more, for whole blocks: (left rows, right rows, squared distances) to (cells of all pairs, count + 1 where none holds; pairs left to roles).
        self.whole: list[Callable[[slice, slice, np.ndarray], tuple[np.ndarray, np.ndarray]]] | None = None
        self.shape = [max(len(v), 1) for v in keys.values()] + list(sizes.values())
        self.count = int(np.prod(self.shape))

    def cell(self, parts: list[np.ndarray]) -> np.ndarray:
        """Cells of pairs with these numbers of keys and bins, -1 where one is missing."""
        out, missing = parts[0], parts[0] < 0
        for n, p in zip(self.shape[1:], parts[1:]):
            out, missing = out * n + p, missing | (p < 0)
        return np.where(missing, self.count, out)

    def named(self, cell: np.ndarray) -> dict[str, pa.Array]:
        known = cell < self.count
        at = np.unravel_index(np.where(known, cell, 0), self.shape)
        numbers_ = [pa.array(k.astype(np.int32), mask=~known) for k in at]
        return dict(zip(self.keys, [v.take(k) for v, k in zip(self.keys.values(), numbers_)])) | dict(zip(self.sizes, numbers_[len(self.keys) :]))


def bins_of(v: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """functions.scalars.bin_of, -1 for null."""
    inside = (v >= low) & (v < high)
    return np.where(inside, (np.where(inside, v, low) - low) * (bins / (high - low)), -1).astype(np.int64)


def edges(bins: Callable[[np.ndarray], np.ndarray], count: int, radius: float) -> np.ndarray:
    """The least squared distances of bins 0 to count, bins(d2) rising from -1 (too near) to count (too far), to the last bit."""
    out = []
    for m in range(count + 1):
        low, high = -1, struct.unpack("<q", struct.pack("<d", 4 * radius * radius + 1))[0]  # doubles above 0 are in the order of their bits
        while high - low > 1:
            mid = (low + high) // 2
            v = np.array([struct.unpack("<d", struct.pack("<q", mid))[0]])
            low, high = (low, mid) if bins(v)[0] >= m else (mid, high)
        out.append(struct.unpack("<d", struct.pack("<q", high))[0])
    return np.array(out)


def pair_counts(left: pa.Table, right: pa.Table, radius: float, cells: Cells, by: list[str]) -> pa.Table:
    """(by, keys, bins, times): how many pairs within radius are interactions in each cell, for each left point if by names columns of left, else in all."""
    width = cells.count + 1
    own, firsts = (np.zeros(len(left), np.int64), [0]) if by or not len(left) or not cells.own else _groups(list(cells.own.values()))
    shown = None
    if cells.plain is not None and cells.count <= PRODUCTS:
        shown = (cells.plain[0][:, None] == np.arange(cells.shape[0])).astype(np.float32)
    total = None if by else np.zeros((len(firsts), width), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part, met in blocks(left, right, radius, max(1, min(ROWS, COUNTERS // width))):
        rows, size = part.stop - part.start, (part.stop - part.start) * width
        counts, waiting = np.zeros(size, np.int64), []
        for there, d2 in met if shown is not None else ():
            holds = cells.plain[2](part, there)
            below = np.array([(d2 < t if holds is None else (d2 < t) & holds).astype(np.float32) @ shown[there] for t in cells.plain[1]])
            counts.reshape(rows, width)[:, :-1] += np.diff(below, axis=0).transpose(1, 2, 0).reshape(rows, -1).astype(np.int64)
        if cells.whole is not None and width < WHOLE:
            waiting = _whole_counts(part, met, cells, counts)
        for there, d2 in met:
            near = d2 <= radius * radius
            at = np.flatnonzero(near)
            i, j = np.divmod(at.astype(np.int32), there.stop - there.start)
            for role in cells.roles:
                held, cell = role(i + part.start, j + there.start, d2.ravel()[at])
                code = (held - part.start) * width + cell
                if size <= 4 * len(code):
                    counts += np.bincount(code, minlength=size)
                else:
                    waiting.append(code)
        if waiting:
            code, n = np.unique(np.concatenate(waiting), return_counts=True)
            counts[code] += n
        if by:
            at = np.flatnonzero(counts)
            i, cell = np.divmod(at, width)
            found.append((i + part.start, cell, counts[at]))
        else:
            np.add.at(total, own[part], counts.reshape(rows, width))
    if not by:
        i, cell = np.nonzero(total)
        found = [(np.array(firsts, np.int64)[i], cell, total[i, cell])]
    i, cell, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    names = {c: left[c].take(pa.array(i)) for c in by} | {c: v.take(pa.array(i)) for c, v in cells.own.items()}
    return pa.table(names | cells.named(cell) | {"times": pa.array(n, pa.int64())})


def _whole_counts(part: slice, met: Iterator[tuple[slice, np.ndarray]], cells: Cells, counts: np.ndarray) -> list[np.ndarray]:
    """Add to counts, those of a part's rows, what its blocks come to; the codes of pairs that were left to roles."""
    rows, width = part.stop - part.start, cells.count + 1
    begin = np.arange(rows)[:, None] * (width + 1)
    left: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in cells.roles]
    total = np.zeros(rows * (width + 1), np.int64)
    for there, d2 in met:
        for block, unsure in zip(cells.whole, left):
            cell, open_ = block(part, there, d2)
            at = np.flatnonzero(open_)
            if len(at):
                cell.ravel()[at] = width
                i, j = np.divmod(at, there.stop - there.start)
                unsure.append((i + part.start, j + there.start, d2.ravel()[at]))
            total += np.bincount((cell + begin).ravel(), minlength=len(total))
    counts += total.reshape(rows, width + 1)[:, :-1].ravel()
    codes = []
    for role, unsure in zip(cells.roles, left):
        if unsure:
            held, cell = role(*map(np.concatenate, zip(*unsure)))
            codes.append((held - part.start) * width + cell)
    return codes


def _groups(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, list[int]]:
    """A number for each row, by its values in all columns, and the first row of each number."""
    codes = np.array([coded(c)[0][0] for c in columns])
    _, firsts, number = np.unique(codes, axis=1, return_index=True, return_inverse=True)
    return number.ravel(), firsts.tolist()
