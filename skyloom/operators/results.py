"""Operations on results and catalogs beside the main chain: slices, comparisons, covariance over sets, probes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sky
from .resample import paired, sampled_covariance


def patch_slice(counts: DataFrame, first: int, end: int) -> DataFrame:
    """Counts between patches first ... end - 1, renumbered from 0."""
    inside = F.col("p1").between(first, end - 1) & F.col("p2").between(first, end - 1)
    return counts.where(inside).withColumns({"p1": F.col("p1") - first, "p2": F.col("p2") - first})


def bin_slice(data: DataFrame, first: int, end: int) -> DataFrame:
    """Rows of bins first ... end - 1, renumbered from 0."""
    return data.where(F.col("zbin").between(first, end - 1)).withColumn("zbin", F.col("zbin") - first)


def sparse(counts: DataFrame) -> DataFrame:
    """What is stored of counts: groups that aren't 0."""
    return counts.where("value <> 0")


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, repeats counted; NaN equals NaN."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def shape(data: DataFrame) -> tuple[int, int]:
    """Numbers of bins and samples of (zbin, sample, value)."""
    r = data.agg(F.countDistinct("zbin").alias("b"), F.countDistinct(F.when(F.col("sample") >= 0, F.col("sample"))).alias("s")).first()
    return r.b, r.s


def check_compatible(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have equally many bins and samples."""
    for what, x, y in zip(("bins", "samples"), shape(a), shape(b)):
        if x != y:
            raise ValueError(f"number of {what} does not agree")


def combined(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b, or a - b with ``sign`` -1, by bin and sample."""
    other = b.select("zbin", "sample", (F.col("value") * sign).alias("other"))
    return a.join(other, ["zbin", "sample"]).select("zbin", "sample", (F.col("value") + F.col("other")).alias("value"))


def covariance(samples: DataFrame, kind: str = "full") -> DataFrame:
    """(set_i, zbin_i, set_j, zbin_j, cov) of (set, zbin, sample, value).

    ``full``: all; ``var``: the variances alone; ``diag``: those, and the same bin of different sets.
    Other entries are 0.
    """
    if kind not in ("full", "var", "diag"):
        raise ValueError(f"invalid covariance kind: {kind}")
    cov = paired(samples, ["set", "zbin"]).groupBy("set_i", "zbin_i", "set_j", "zbin_j").agg(sampled_covariance("vi", "vj").alias("cov"))
    keep = F.lit(True) if kind == "full" else F.col("zbin_i") == F.col("zbin_j")
    if kind == "var":
        keep = keep & (F.col("set_i") == F.col("set_j"))
    return cov.withColumn("cov", F.when(keep, F.col("cov")).otherwise(0.0))


def linkage_statistics(links: DataFrame, patches: int) -> DataFrame:
    """num_total (pairs of patches), num_links and density of links (p1, p2)."""
    total = patches * patches
    return links.agg(F.lit(total).cast("long").alias("num_total"), F.count("*").alias("num_links")).withColumn("density", F.col("num_links") / F.lit(float(max(1, total))))


def distance_range(df: DataFrame, ra: float, dec: float) -> DataFrame:
    """Least and greatest angle between the points (x, y, z3) and a position in radians."""
    c = tuple(F.lit(v) for v in (math.cos(ra) * math.cos(dec), math.sin(ra) * math.cos(dec), math.sin(dec)))
    d = sky.distance((F.col("x"), F.col("y"), F.col("z3")), c)
    return df.agg(F.min(d).alias("nearest"), F.max(d).alias("farthest"))


def scalar_norm(points: DataFrame, by: Column | None = None) -> DataFrame:
    """Sums of kappa * w and w by (zbin, patch)."""
    return points.groupBy("zbin", "patch").agg(F.sum(F.col("kappa") * F.col("w")).alias("kw"), F.sum("w").alias("sw"))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Adds ``_rank``, the row's place in the order of a unique key, from 0.

    Ranges of the key are ranked side by side, and each begins at the sum of those before: no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo_hi = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    cuts = sorted(set(lo_hi.cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return inside.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_part", "_before", "_in")


def probe(df: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows at nearly regular places in the order of ``key``: the whole parts of size steps from the first row to the last.

    A row is kept if a step falls on it, which its own rank tells: no list of places is sent.
    """
    n = df.count()
    if size > n:
        raise ValueError("the probe is larger than the data")
    if size < 2:
        return ranked(df, key).where(F.col("_rank") < size).drop("_rank")
    # step k is at floor(k * (n - 1) / (size - 1)): rank r has one iff the first k at or beyond r is below r + 1
    k = F.expr(f"(_rank * {size - 1}L + {n - 2}L) div {n - 1}L") if n > 1 else F.lit(0)
    return ranked(df, key).where((k * (n - 1) < (F.col("_rank") + 1) * (size - 1)) & (k < size)).drop("_rank")
