"""Measurements: pair counts of all kinds, correlation functions and n(z) as plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import Binning
from ..operators import pairs, resample, results


@dataclass(frozen=True)
class Sample:
    """A catalog ready for counting: id, patch, x, y, z3, w, and z, kappa where it has them."""

    df: DataFrame

    def binned(self, binning: Binning) -> DataFrame:
        return self.df.withColumn("zbin", binning.assign(F.col("z"))).where("zbin is not null")


def weighted(df: DataFrame, mode: str = "n") -> DataFrame:
    """``v`` for pair counts: the weight, or kappa times the weight for mode k."""
    if mode == "k":
        if "kappa" not in df.columns:
            raise ValueError("kappa is required for scalar pair counts")
        return df.withColumn("v", F.col("kappa") * F.col("w"))
    return df.withColumn("v", F.col("w"))


def kind_counts(first: DataFrame, second: DataFrame, limits: pairs.Limits, kind: str, auto: bool = False, modes: str = "nn") -> DataFrame:
    """(kind, scale, zbin, p1, p2, value, pairs)."""
    return pairs.count(weighted(first, modes[0]), weighted(second, modes[1]), limits, auto).select(F.lit(kind).alias("kind"), "scale", "zbin", "p1", "p2", "value", "pairs")


def kind_sums(sides: list[tuple[str, pairs.Index, pairs.Index, bool]], limits: pairs.Limits, fine: pairs.Fine | None = None) -> DataFrame:
    """As ``kind_counts`` for several kinds; a sample's blocks are made once for all of them."""
    parts = [pairs.named(pairs.counted(a.first, b.second, limits, a.values, auto, fine)).withColumn("kind", F.lit(k)) for k, a, b, auto in sides]
    return union(parts)


def indexed(df: DataFrame, limits: pairs.Limits, aligned: bool) -> pairs.Index:
    return pairs.Index(weighted(df), limits, aligned, ["v"])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def normalised(counts: DataFrame, weights: DataFrame, kinds: list[str], binning: Binning, patches: int) -> DataFrame:
    """(kind, zbin, sample, value): ratio of resampled counts to resampled weights."""
    spark = counts.sparkSession
    groups = binning.frame(spark).select("zbin", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    num = resample.jackknife(counts, ["kind", "zbin"], groups, patches)
    den = resample.jackknife(weights, ["kind", "zbin"], groups, patches).withColumnRenamed("value", "weight")
    return num.join(den, ["kind", "zbin", "sample"]).select("kind", "zbin", "sample", resample.ratio(F.col("value"), F.col("weight")).alias("value"))


def crosscorrelate(binning: Binning, limits: pairs.Limits, patches: int, reference: Sample, unknown: Sample, ref_rand: Sample | None = None, unk_rand: Sample | None = None, fine: pairs.Fine | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Counts and normalisation of DD, DR, RD and RR as far as there are randoms; the unknown side has no redshift bins."""
    if ref_rand is None and unk_rand is None:
        raise ValueError("at least one random dataset must be provided")
    n = len(binning)
    data, unk = reference.binned(binning), unknown.df.drop("zbin")
    sides = [("dd", data, unk)]
    if unk_rand is not None:
        random = unk_rand.df.drop("zbin")
        sides.append(("dr", data, random))
    if ref_rand is not None:
        binned = ref_rand.binned(binning)
        sides.append(("rd", binned, unk))
    if unk_rand is not None and ref_rand is not None:
        sides.append(("rr", binned, random))
    own = {id(df): indexed(df, limits, False) for _, *both in sides for df in both}
    counts = kind_sums([(k, own[id(a)], own[id(b)], False) for k, a, b in sides], limits, fine)
    weights = union([resample.products(resample.sum_weights(a, n, patches), resample.sum_weights(b, n, patches)).withColumn("kind", F.lit(k)) for k, a, b in sides])
    return counts, weights, [k for k, _, _ in sides]


def autocorrelate(binning: Binning, limits: pairs.Limits, patches: int, data: Sample, random: Sample, count_rr: bool = True, fine: pairs.Fine | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Counts and normalisation of DD, DR and RR; both sides have redshift bins."""
    n = len(binning)
    d, r = data.binned(binning), random.binned(binning)
    sides = [("dd", d, d, True), ("dr", d, r, False)] + ([("rr", r, r, True)] if count_rr else [])
    own = {id(df): indexed(df, limits, True) for df in (d, r)}
    counts = kind_sums([(k, own[id(a)], own[id(b)], auto) for k, a, b, auto in sides], limits, fine)
    weights = union([resample.products(resample.sum_weights(a, n, patches), resample.sum_weights(b, n, patches), auto).withColumn("kind", F.lit(k)) for k, a, b, auto in sides])
    return counts, weights, [k for k, *_ in sides]


def scalar_counts(binning: Binning, limits: pairs.Limits, first: DataFrame, second: DataFrame, modes: str, auto: bool = False, fine: pairs.Fine | None = None) -> DataFrame:
    """Scalar pair counts over number counts: ``value`` and ``number`` by (scale, zbin, p1, p2)."""
    sides = [weighted(df, m).withColumn("n", F.col("w")) for df, m in zip((first, second), modes)]
    return pairs.count(*sides, limits, auto, fine).select("scale", "zbin", "p1", "p2", "value", "number")


def correlation(counts: DataFrame, weights: DataFrame, kinds: list[str], binning: Binning, patches: int, scale: int = 0) -> DataFrame:
    """(zbin, sample, value) of the correlation function at a scale."""
    return resample.correlation(normalised(counts.where(F.col("scale") == scale), weights, kinds, binning, patches), set(kinds))


def scalar_parts(binning: Binning, patches: int, kind: str, counts: DataFrame) -> DataFrame:
    """(kind, zbin, sample, value): resampled scalar counts over resampled number counts, of one scale."""
    groups = binning.frame(counts.sparkSession).select("zbin")
    num = resample.jackknife(counts.select("zbin", "p1", "p2", "value"), ["zbin"], groups, patches)
    den = resample.jackknife(counts.select("zbin", "p1", "p2", F.col("number").alias("value")), ["zbin"], groups, patches).withColumnRenamed("value", "number")
    return num.join(den, ["zbin", "sample"]).select(F.lit(kind).alias("kind"), "zbin", "sample", resample.ratio(F.col("value"), F.col("number")).alias("value"))


def mean_kappa(binning: Binning, patches: int, points: DataFrame) -> DataFrame:
    """As ``scalar_parts``, the mean kappa by bin: what stands for DR without randoms."""
    own = results.scalar_norm(points).select("zbin", F.col("patch").alias("p1"), F.col("patch").alias("p2"), F.col("kw").alias("value"), F.col("sw").alias("number"))
    return scalar_parts(binning, patches, "dr", own)


def autocorrelate_scalar(binning: Binning, limits: pairs.Limits, patches: int, data: Sample, scale: int = 0) -> DataFrame:
    """(zbin, sample, value) of kappa with itself."""
    d = data.binned(binning)
    dd = scalar_counts(binning, limits, d, d, "kk", True).where(F.col("scale") == scale)
    return resample.correlation(scalar_parts(binning, patches, "dd", dd), {"dd"}, is_scalar=True)


def crosscorrelate_scalar(binning: Binning, limits: pairs.Limits, patches: int, reference: Sample, unknown: Sample, unk_rand: Sample | None = None, scale: int = 0) -> DataFrame:
    """(zbin, sample, value) of the reference's kappa with the unknown sample, less that with its randoms or the mean kappa."""
    ref = reference.binned(binning)
    dd = scalar_parts(binning, patches, "dd", scalar_counts(binning, limits, ref, unknown.df.drop("zbin"), "kn").where(F.col("scale") == scale))
    if unk_rand is None:
        dr = mean_kappa(binning, patches, ref)
    else:
        dr = scalar_parts(binning, patches, "dr", scalar_counts(binning, limits, ref, unk_rand.df.drop("zbin"), "kn").where(F.col("scale") == scale))
    return resample.correlation(dd.unionByName(dr), {"dd", "dr"}, is_scalar=True)
