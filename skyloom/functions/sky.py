"""Geometry on the sphere as Spark columns: everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def xyz(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a position in radians."""
    return F.cos(ra) * F.cos(dec), F.sin(ra) * F.cos(dec), F.sin(dec)


def with_xyz(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    x, y, z = xyz(F.col(ra), F.col(dec))
    return df.withColumns({"x": x, "y": y, "z3": z})


def ra_dec(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Position in radians of a vector of any length; ra is in [0, 2 pi), 0 at the poles."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.atan2(y, x), F.lit(TWO_PI)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r)))


def chord2(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared chord between unit vectors."""
    d = [p - q for p, q in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def chord_to_angle(chord: Column) -> Column:
    """Angle of a chord; a chord over 2 raises."""
    return F.when(chord > 2.0, F.raise_error(F.lit("chord distance exceeds 2")).cast("double")).otherwise(2.0 * F.asin(chord / 2.0))


def angle_to_chord(angle: Column) -> Column:
    return 2.0 * F.sin(angle / 2.0)


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Angle between unit vectors, in radians."""
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(chord2(a, b)) / 2.0))


def to_cylinder(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Equal-area coordinates: (ra, sin dec)."""
    return ra, F.sin(dec)


def from_cylinder(x: Column, y: Column) -> tuple[Column, Column]:
    return x, F.asin(y)


def mean_direction(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(Weighted) mean position by the Euclidean mean of the unit vectors; ``df`` has x, y, z3."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*by).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("x", "y", "z3")])
    ra, dec = ra_dec(F.col("x"), F.col("y"), F.col("z3"))
    return means.select(*by, ra.alias("ra"), dec.alias("dec"))
