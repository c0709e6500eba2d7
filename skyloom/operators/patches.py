"""Spatial patches: assignment, metadata, linkage and consistency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky

MAX_PATCH_ID = 32767


class InconsistentPatchesError(Exception):
    """Catalogs whose patches do not match."""


#: Up to so many centres distances can be columns of their own.
FEW = 16


def nearest(x: str, y: str, z: str, centers: list[tuple[float, float]], direct: bool = False) -> Column:
    """Index of the nearest centre (ra, dec in radians); the first wins ties.

    The centres are one literal of the plan, and the expression is as long for many patches as for few: however
    many patches there are, the generated code stays small where filters are pushed below it.

    ``direct`` makes a column of each distance to at most ``FEW`` centres, which is six times as fast; the code of
    a filter by patch, pushed below it, grows too long.
    """
    units = [(math.cos(ra) * math.cos(dec), math.sin(ra) * math.cos(dec), math.sin(dec)) for ra, dec in centers]

    if direct and 2 <= len(units) <= FEW:  # as text, because building hundreds of columns takes longer than parsing them
        d = ", ".join(" + ".join(f"({c} - ({v!r}D)) * ({c} - ({v!r}D))" for c, v in zip((x, y, z), u)) for u in units)
        return F.expr(f"coalesce(CAST(array_position(array({d}), least({d})) - 1 AS INT), 0)")

    def chord2(c: list[Column]) -> Column:
        dx, dy, dz = (F.col(v) - w for v, w in zip((x, y, z), c))
        return dx * dx + dy * dy + dz * dz

    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(u, "xyz")], F.lit(k).alias("k")) for k, u in enumerate(units)]
    far = lambda c: F.struct(chord2([c[n] for n in "xyz"]).alias("d"), c["k"].alias("k"))
    return F.array_min(F.transform(F.array(*rows), far))["k"]


def assign(df: DataFrame, centers: list[tuple[float, float]], direct: bool = False) -> DataFrame:
    """``df`` (with x, y, z3) with its patch id."""
    return df.withColumn("patch", nearest("x", "y", "z3", centers, direct))


def divided(df: DataFrame, column: str) -> DataFrame:
    """Patch ids from a column, checked for their range."""
    c = F.col(column).cast("int")
    bad = c.isNull() | (c < 0) | (c > MAX_PATCH_ID)
    return df.withColumn("patch", F.when(bad, F.raise_error(F.lit("patch IDs out of range [0, 32767]")).cast("int")).otherwise(c))


def kmeans_centers(df: DataFrame, k: int, seed: int = 12345, probe: int | None = None) -> list[tuple[float, float]]:
    """Centres by k-means on the unit vectors of a probe of about 100 000 sqrt(k) rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    size = probe if probe and probe >= 10 * k else int(100_000 * math.sqrt(k))
    n = df.count()
    part = df.sample(fraction=min(1.0, size / n), seed=seed) if n > size else df
    points = VectorAssembler(inputCols=["x", "y", "z3"], outputCol="features").transform(part)
    model = KMeans(k=k, seed=seed, weightCol="w" if "w" in df.columns else None).fit(points) if "w" in df.columns else KMeans(k=k, seed=seed).fit(points)
    out = []
    for c in model.clusterCenters():
        r = math.sqrt(float((c * c).sum()))
        out.append((math.atan2(c[1], c[0]) % sky.TWO_PI, math.asin(c[2] / r)))
    return out


def metadata(df: DataFrame, weight: str | None = None) -> DataFrame:
    """patch, num_records, sum_weights, ra, dec (weighted mean direction) and radius of each patch.

    The first aggregate has one row per patch, so joining it back moves no points.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    first = df.groupBy("patch").agg(
        F.count("*").alias("num_records"), F.sum(w).alias("sum_weights"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in ("x", "y", "z3")])
    ra, dec = sky.ra_dec(F.col("mx"), F.col("my"), F.col("mz3"))
    first = first.select("patch", "num_records", "sum_weights", ra.alias("ra"), dec.alias("dec"))
    x, y, z = sky.xyz(F.col("ra"), F.col("dec"))
    centers = first.select("patch", x.alias("cx"), y.alias("cy"), z.alias("cz"))
    far = df.join(F.broadcast(centers), "patch").groupBy("patch").agg(  # at most 32 768 patches
        F.max(sky.distance((F.col("x"), F.col("y"), F.col("z3")), (F.col("cx"), F.col("cy"), F.col("cz")))).alias("radius"))
    return first.join(far, "patch")


def linkage(meta: DataFrame, max_angle: float) -> DataFrame:
    """Pairs of patches (p1, p2) that points within ``max_angle`` can link."""
    x, y, z = sky.xyz(F.col("ra"), F.col("dec"))
    m = meta.select("patch", "radius", x.alias("x"), y.alias("y"), z.alias("z"))
    a, b = m.alias("a"), F.broadcast(m).alias("b")  # at most 32 768 patches
    d = sky.distance(tuple(F.col(f"a.{c}") for c in "xyz"), tuple(F.col(f"b.{c}") for c in "xyz"))
    return a.join(b, d < F.col("a.radius") + F.col("b.radius") + max_angle).select(F.col("a.patch").alias("p1"), F.col("b.patch").alias("p2"))
