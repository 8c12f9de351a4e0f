"""Many terms in one pass over pairs: one radius join for all that atoms take part in, another for all that residues do.

Each pair becomes one row with the keys and bins of every term that it is an interaction of; energies are looked up there, and one grouping by
point sums them all. What counts pairs is looked up after the grouping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance2, vec
from ..functions.scalars import interpolated
from .environment import Environment, pairs_within
from .spatial import radius_join
from .terms import Term

#: Cells of an energy table that is sent to all tasks, some 32 bytes each; larger ones are joined by shuffling pairs.
SENT = 1 << 21


@dataclass(frozen=True)
class Part:
    """A term in a stream: its energies, where a point takes part (l_ and r_ columns), and between which places pairs are measured."""

    term: Term
    energies: DataFrame
    target: Column  # of the target's own columns: points that the term scores
    pair: Column  # of the pair's columns: points that it counts
    d2: Column
    kind: str | None = None  # of counted terms: the target's key column
    extra: tuple[str, ...] = ()  # further key columns of the energies, of which a target has its own values


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SENT + 1).count() <= SENT else table


def streamed(pairs: DataFrame, targets: DataFrame, parts: dict[str, Part], sums: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, means: dict[str, Column] | None = None) -> DataFrame:
    """(model, res, <part>, <part>_count, <sum>, <count>, <mean>) of every residue of targets(model, res, id, ...).

    pairs are those of all parts, at the largest reach; sums, counts and means are further values of pairs by residue: sums 0 and
    means null without any.
    """
    rows = pairs
    aggregates = [F.sum(v).alias(n) for n, v in (sums or {}).items()] + [F.count_if(v).alias(n) for n, v in (counts or {}).items()]
    for n, v in (means or {}).items():
        aggregates += [F.sum(v).alias(f"{n}_sum_"), F.count(v).alias(f"{n}_n_")]
    for k, (name, part) in enumerate(parts.items()):
        term = part.term
        here = [F.coalesce(part.pair & r.holds(part.d2), F.lit(False)) for r in term.roles]
        if term.counted:
            aggregates.append(F.count_if(here[0]).alias(f"{name}_n_"))
            continue
        table, energy, number = _small(part.energies.select(*term.keys, *part.extra, *term.sizes, "e")), F.lit(0.0), F.lit(0)
        for j, (role, holds) in enumerate(zip(term.roles, here)):
            own = {c: f"p{k}_{j}_{c}" for c in (*term.keys, *term.sizes)}
            rows = rows.withColumns({own[c]: F.when(holds, v) for c, v in role.columns(part.d2).items()})
            own |= {c: f"l_{c}" for c in part.extra}
            found = table.select(*[F.col(c).alias(f"e{k}_{j}_{c}") for c in own], F.col("e").alias(f"e{k}_{j}"))
            rows = rows.join(found, reduce(lambda a, b: a & b, [F.col(o) == F.col(f"e{k}_{j}_{c}") for c, o in own.items()]), "left")
            energy, number = energy + F.coalesce(F.col(f"e{k}_{j}"), F.lit(0.0)), number + F.col(f"e{k}_{j}").isNotNull().cast("int")
        aggregates += [F.sum(energy).alias(f"{name}_sum_"), F.sum(number).alias(f"{name}_n_")]
    grouped = rows.groupBy(F.col("l_model").alias("model"), F.col("l_id").alias("id")).agg(*(aggregates or [F.count("*").alias("pairs_")]))
    points = targets.join(grouped, ["model", "id"], "left")
    by_residue = [F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in sums or {}] + [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts or {}]
    by_residue += [F.try_divide(F.sum(f"{n}_sum_"), F.sum(f"{n}_n_")).alias(n) for n in means or {}]
    for k, (name, part) in enumerate(parts.items()):
        term = part.term
        if term.counted:
            most = term.sizes["n"] - 1
            points = points.withColumns({f"a{k}_": F.when(part.target, F.col(part.kind)), f"n{k}_": F.least(F.coalesce(f"{name}_n_", F.lit(0)), F.lit(most)).cast("int")})
            table = _small(part.energies.select(F.col("a").alias(f"a{k}_"), F.col("n").alias(f"n{k}_"), F.col("e").alias(f"e{k}_"), *part.extra))
            points = points.join(table, [f"a{k}_", f"n{k}_", *part.extra], "left")
            by_residue += [F.avg(f"e{k}_").alias(name), F.count(f"e{k}_").alias(f"{name}_count")]
        else:
            total, number = F.sum(F.when(part.target, F.col(f"{name}_sum_"))), F.coalesce(F.sum(F.when(part.target, F.col(f"{name}_n_"))), F.lit(0))
            mean = F.when(F.bool_or(part.target), F.coalesce(total, F.lit(0.0))) if term.sums else F.try_divide(total, number)
            by_residue += [mean.alias(name), number.alias(f"{name}_count")]
    return points.groupBy("model", "res").agg(*by_residue)


def atom_stream(atoms: DataFrame, around: DataFrame | Environment, parts: dict[str, Part], reach: float = 0.0, **more) -> DataFrame:
    """streamed over atoms(model, res, id, ...) and what is around them, out to the largest of the parts' reaches and reach."""
    far = max([p.term.reach for p in parts.values()] + [reach])
    return streamed(pairs_within(atoms, around, far), atoms, parts, **more)


def residue_stream(residues: DataFrame, parts: dict[str, Part], reach: float = 0.0, constraints: DataFrame | None = None, **more) -> DataFrame:
    """streamed over residues(model, chain, rnum, res, id, x, y, z, cbx, cby, cbz, ...), which are met by x, y, z.

    Parts may measure between CB places; since pairs are found by x, y, z, each model is searched out to the largest reach and twice the
    greatest distance of a CB from there, so that no pair of any part is missed. With constraints(chain, i, j, ...), i < j, a pair within a chain has the columns of its own.
    """
    far = max([p.term.reach for p in parts.values()] + [reach])
    off = F.coalesce(F.sqrt(distance2(vec(""), vec("cb"))), F.lit(0.0))
    rows = residues.withColumn("reach_", F.lit(far) + 2 * F.max(off).over(Window.partitionBy("model")) + 1e-9)
    pairs = radius_join(rows, rows, "reach_", ["model"])
    if constraints is not None:
        own = F.when(F.col("l_chain") == F.col("r_chain"), F.col("l_chain"))
        pairs = pairs.withColumns({"chain_": own, "i_": F.least("l_rnum", "r_rnum"), "j_": F.greatest("l_rnum", "r_rnum")})
        pairs = pairs.join(constraints.withColumnsRenamed({"chain": "chain_", "i": "i_", "j": "j_"}), ["chain_", "i_", "j_"], "left")
    return streamed(pairs, residues, parts, **more)


def constraint_value(step: float, cutoff: float, d2: Column) -> Column:
    """Of a pair with constraint, an array by steps of distance: its value at the pair's distance below cutoff."""
    d = F.sqrt(d2)
    return F.when(d < cutoff, interpolated(F.col("constraint"), d, step))
