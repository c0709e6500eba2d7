"""Random catalogs: uniform in a box on the sphere, reproducible whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.results import ranked


def uniform(seed: int, stream: int) -> Column:
    """A number in [0, 1) from the row's id: no state, so lost partitions come back alike."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), F.col("id").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def box(spark: SparkSession, n: int, ra_min: float, ra_max: float, dec_min: float, dec_max: float, seed: int = 12345, observed: DataFrame | None = None) -> DataFrame:
    """``n`` points: id, ra, dec in radians, uniform in area; with the attributes of rows drawn
    (jointly, with replacement) from ``observed``."""
    low, high = math.sin(dec_min), math.sin(dec_max)
    out = spark.range(n).select(
        "id", (F.lit(ra_min) + uniform(seed, 0) * (ra_max - ra_min)).alias("ra"), F.asin(F.lit(low) + uniform(seed, 1) * (high - low)).alias("dec"), uniform(seed, 2).alias("_u"))
    if observed is None:
        return out.drop("_u")
    size = observed.count()
    # ranges of a hash of the rows are ranked side by side; equal rows may take each other's place
    rows = ranked(observed.withColumn("_h", F.xxhash64(*observed.columns)), "_h").drop("_h").withColumnRenamed("_rank", "_k")
    return out.withColumn("_k", F.floor(F.col("_u") * size)).join(rows, "_k").drop("_u", "_k")


def healpix(spark: SparkSession, mask: DataFrame, order: int, n: int, seed: int = 12345) -> DataFrame:
    """``n`` points: id, ra, dec in radians, on the nested pixels of ``mask`` (pixel, weight) with
    probabilities by weight, each at the centre of one of its finest pixels.

    A draw finds its pixel in the cumulative weights: both go to equal cells of [0, 1), so this is an
    equi-join and no side is sent to all tasks.  Pixels without positive weight are never drawn; a
    mask without any raises.
    """
    from .functions import healpix as hp

    if not 0 <= order <= hp.FINEST:
        raise ValueError(f"order out of range [0, {hp.FINEST}]")
    width = max(1, min(1 << 20, n // 64))
    pixels = mask.where("weight > 0").select(F.col("pixel").cast("long").alias("pixel"), F.col("weight").cast("double").alias("weight"), F.shiftright(F.col("pixel").cast("long"), 12).alias("g"))
    groups = pixels.groupBy("g").agg(F.sum("weight").alias("gw"))  # one row for 4096 pixels
    groups = groups.select("g", (F.sum("gw").over(W.orderBy("g")) - F.col("gw")).alias("before"))
    total = pixels.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("the mask has no pixel of positive weight")
    upto = F.col("before") + F.sum("weight").over(W.partitionBy("g").orderBy("pixel"))
    spans = pixels.join(groups, "g").select("pixel", (upto / total).alias("hi"))
    # neighbours share their edge exactly, so every draw has one pixel
    spans = _edges(spans)
    last = F.lit(width - 1)
    cells = spans.withColumn("c", F.explode(F.sequence(F.least(F.floor(F.col("lo") * width), last), F.least(F.floor(F.col("hi") * width), last))))
    draws = spark.range(n).withColumn("u", uniform(seed, 0)).withColumn("c", F.floor(F.col("u") * width))
    top = cells.agg(F.max("hi")).first()[0]
    draws = draws.withColumn("u", F.least(F.col("u"), F.lit(math.nextafter(top, 0.0))))
    got = draws.join(cells, "c").where("u >= lo and u < hi")
    depth = 2 * (hp.FINEST - order)
    sub = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(1), F.col("id")), 64 - depth) if depth else F.lit(0).cast("long")
    ra, dec = hp.center(F.shiftleft(F.col("pixel"), depth) + sub, hp.FINEST)
    return got.select("id", ra.alias("ra"), dec.alias("dec"))


def _edges(spans: DataFrame) -> DataFrame:
    """``lo`` of each span, the end of the one before, by groups of pixels and the groups' ends."""
    g = F.shiftright("pixel", 12)
    ends = spans.groupBy(g.alias("g")).agg(F.max("hi").alias("end"))
    ends = ends.select("g", F.coalesce(F.lag("end").over(W.orderBy("g")), F.lit(0.0)).alias("start"))
    inner = spans.withColumn("g", g).withColumn("prev", F.lag("hi").over(W.partitionBy("g").orderBy("pixel")))
    return inner.join(ends, "g").select("pixel", "hi", F.coalesce("prev", "start").alias("lo"))


def frame(points: DataFrame, degrees: bool = True):
    """Randoms as a pandas frame on the driver, without their ids; ra and dec in degrees unless told otherwise."""
    unit = F.degrees if degrees else F.col
    return points.withColumns({c: unit(c) for c in ("ra", "dec")}).drop("id").toPandas()
