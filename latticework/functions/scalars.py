"""Scalar helpers: missing values, clamps, binning, interpolation, sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def missing_to_null(v: Column) -> Column:
    return F.nanvl(v, F.lit(None).cast("double"))


def mean_of_known(v: Column) -> Column:
    """Mean without NaN and null; null if nothing is left."""
    return F.avg(missing_to_null(v))


def clamp01(v: Column, missing: float | None = None) -> Column:
    """Into [0, 1]; a missing value becomes `missing`."""
    v = missing_to_null(v)
    held = F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return held if missing is None else F.coalesce(held, F.lit(float(missing)))


def round_or_null(v: Column, digits: int = 3) -> Column:
    return F.round(missing_to_null(v), digits)


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a value in [low, high), else null."""
    return F.when((v >= low) & (v < high), F.floor((v - low) * (bins / (high - low))).cast("int"))


def interpolated(values: Column, x: Column, step: float) -> Column:
    """Linear interpolation in values at 0, step, 2 step, ...; null outside."""
    at = F.floor(x / step).cast("int")
    part = x / step - at
    return F.get(values, at) * (1 - part) + F.get(values, at + 1) * part


def one_hot(code: Column, alphabet: str = AMINO_ACIDS) -> Column:
    return F.array(*[F.when(code == a, 1.0).otherwise(0.0) for a in alphabet])


def without_gaps(s: Column) -> Column:
    return F.regexp_replace(s, "-", "")


def inner_gap_runs(s: Column) -> Column:
    """Runs of gaps between the first and the last letter."""
    return F.regexp_count(F.btrim(s, F.lit("-")), F.lit("-+"))


def sequence_key(s: Column) -> Column:
    return F.md5(s)


def class_of(code: Column, classes: dict[str, str]) -> Column:
    """A letter's class by the string of letters that it stands in."""
    out = F.lit(None).cast("string")
    for name, letters in classes.items():
        out = F.when(code.isin(*letters), F.lit(name)).otherwise(out)
    return out
