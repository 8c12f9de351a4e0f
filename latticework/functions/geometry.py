"""Vector geometry as column expressions. A vector is a triple of double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return tuple(F.try_divide(p, n) for p in a)


def distance2(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(distance2(a, b))


def clamped(value: Column, low=None, high=None) -> Column:
    """value, kept between low and high where they are given; null stays null (greatest and least alone would pass over it)."""
    out = value if high is None else F.least(F.lit(high), value)
    out = out if low is None else F.greatest(F.lit(low), out)
    return F.when(value.isNotNull(), out)


def angle(a: Vec, b: Vec) -> Column:
    """Between two vectors, in radians; null if either has no length."""
    return F.acos(clamped(F.try_divide(dot(a, b), norm(a) * norm(b)), -1.0, 1.0))


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Of four points, in radians, by the arc tangent of cross products."""
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    return F.atan2(norm(v) * dot(u, n2), dot(n1, n2))


def wrap(angle_: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle_ + math.pi, F.lit(2 * math.pi)) - math.pi


def place_atom(bond: float, theta: float, phi: Column | float, a: Vec, b: Vec, c: Vec) -> Vec:
    """The point at `bond` from c, with angle theta at c to b and dihedral phi over a, b, c."""
    bc = unit(sub(c, b))
    n = unit(cross(sub(b, a), bc))
    m = cross(n, bc)
    phi = F.lit(phi) if isinstance(phi, (int, float)) else phi
    along = scale(bc, -bond * math.cos(theta))
    return add(c, add(along, add(scale(m, bond * math.sin(theta) * F.cos(phi)), scale(n, bond * math.sin(theta) * F.sin(phi)))))


def rebuilt_cb(n: Vec, ca: Vec, c: Vec) -> Vec:
    """A side chain's first carbon from the backbone, by ideal tetrahedral geometry."""
    b, e = sub(ca, n), sub(c, ca)
    normal = cross(b, e)
    return add(ca, add(scale(normal, -0.58273431), add(scale(b, 0.56802827), scale(e, -0.54067466))))


def box_state(phi: Column, psi: Column, boxes) -> Column:
    """The number of the first (low phi, high phi, low psi, high psi, state) that holds the angles, bounds left out, else 0."""
    out = F.lit(0)
    for a, b, c, d, state in reversed(list(boxes)):
        out = F.when((phi > a) & (phi < b) & (psi > c) & (psi < d), F.lit(state)).otherwise(out)
    return out
