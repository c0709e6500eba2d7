"""Measurements from a configuration: correlation functions of all its scales, histograms and n(z).

A correlation function is its counts, a long table (kind, zbin, p1, p2,
value), and the table of the same form that normalises them: products of
sums of weights, or number counts for scalar fields.  All scales are counted
in one pass.  Counts are kept in memory (``released`` lets them go); they are
as many as linked pairs of patches and bins, whatever the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cosmology as cosmo
from .catalog import Catalog
from .config import Configuration
from .functions.bins import Binning
from .operators import pairs, patches, resample, results
from .plans import measure
from .sources import textio

VERSION = 1
#: The least redshift at which a scale's largest angle is taken.
NEAR = 0.05
KINDS = ("dd", "dr", "rd", "rr")


@dataclass(frozen=True)
class CorrData:
    """Values by bin and jackknife sample: (zbin, sample, value), sample -1 the whole."""

    binning: Binning
    df: DataFrame
    KIND = "corr"

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Data, and samples by (sample, bin); NaN where a value is undefined."""
        rows = self.df.collect()
        n = max((r.sample for r in rows), default=-1) + 1
        out = np.full((n + 1, len(self.binning)), np.nan)
        for r in rows:
            out[r.sample + 1, r.zbin] = np.nan if r.value is None else r.value
        return out[0], out[1:]

    data = property(lambda self: self.arrays()[0])
    samples = property(lambda self: self.arrays()[1])

    @property
    def covariance(self) -> DataFrame:
        return resample.covariance(self.df)

    @property
    def error(self) -> DataFrame:
        return resample.errors(self.covariance)

    @property
    def correlation(self) -> DataFrame:
        return resample.correlation_matrix(self.covariance)

    def bins(self, first: int, end: int) -> CorrData:
        return replace(self, binning=self.binning[first:end], df=results.bin_slice(self.df, first, end))

    def require_compatible(self, other: CorrData) -> None:
        if type(self) is not type(other):
            raise TypeError(f"{type(other).__name__} is no {type(self).__name__}")
        if self.binning != other.binning:
            raise ValueError("binning does not agree")
        results.check_compatible(self.df, other.df)

    def __add__(self, other: CorrData) -> CorrData:
        self.require_compatible(other)
        return replace(self, df=results.combined(self.df, other.df))

    def __sub__(self, other: CorrData) -> CorrData:
        self.require_compatible(other)
        return replace(self, df=results.combined(self.df, other.df, -1))

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.binning == other.binning and results.same(self.df, other.df)

    __hash__ = None

    def to_files(self, path: str) -> None:
        textio.write(self.df, self.binning, path, self.KIND)

    @classmethod
    def from_files(cls, spark: SparkSession, path: str) -> CorrData:
        return cls(*textio.read(spark, path))


class RedshiftData(CorrData):
    KIND = "nz"

    @classmethod
    def from_corrdata(cls, cross: CorrData, ref: CorrData | None = None, unk: CorrData | None = None) -> RedshiftData:
        """n(z) from the cross-correlation, with its bias mitigated by the autocorrelations that are given."""
        for auto in (ref, unk):
            if auto is not None:
                cross.require_compatible(auto)
        spark = cross.df.sparkSession
        return cls(cross.binning, resample.redshifts(cross.df, cross.binning.frame(spark), *[None if a is None else a.df for a in (ref, unk)]))

    @classmethod
    def from_corrfuncs(cls, cross: CorrFunc, ref: CorrFunc | None = None, unk: CorrFunc | None = None) -> RedshiftData:
        return cls.from_corrdata(cross.sample(), *[None if a is None else a.sample() for a in (ref, unk)])

    def normalised(self, target: CorrData | None = None) -> RedshiftData:
        frame = self.binning.frame(self.df.sparkSession)
        if target is None:
            return replace(self, df=resample.normalised(self.df, frame))
        return replace(self, df=resample.normalised_to(self.df, target.df.where("sample = -1")))


class HistData(CorrData):
    KIND = "hist"

    @classmethod
    def from_catalog(cls, catalog: Catalog, config: Configuration) -> HistData:
        binning = config.binning.binning
        return cls(binning, resample.histogram(catalog.df, binning, catalog.num_patches))

    def normalised(self) -> HistData:
        """Density of unit integral."""
        frame = self.binning.frame(self.df.sparkSession)
        per = self.df.join(F.broadcast(frame), "zbin").select("zbin", "sample", (F.col("value") / F.col("dz")).alias("value"))
        return replace(self, df=resample.normalised(per, frame))


@dataclass(frozen=True)
class CorrFunc:
    """Counts and their normalisation; ``auto`` counts each pair of one sample once, ``scalar`` is a field's mean over pairs."""

    binning: Binning
    patches: int
    kinds: tuple[str, ...]
    counts: DataFrame
    norm: DataFrame
    auto: bool = False
    scalar: bool = False

    def __post_init__(self):
        if "dd" not in self.kinds or not set(self.kinds) <= set(KINDS):
            raise ValueError("counts need 'dd' and may have 'dr', 'rd' and 'rr'")
        if not self.scalar and not {"dr", "rd", "rr"} & set(self.kinds):
            raise resample.EstimatorError("either 'dr', 'rd' or 'rr' are required")

    def sample(self) -> CorrData:
        value = measure.normalised(self.counts, self.norm, list(self.kinds), self.binning, self.patches)
        return CorrData(self.binning, resample.correlation(value, set(self.kinds), self.scalar))

    def dense(self, kind: str) -> np.ndarray:
        """Counts by (bin, patch, patch) on the driver."""
        out = np.zeros((len(self.binning), self.patches, self.patches))
        for r in self.counts.where(F.col("kind") == kind).collect():
            out[r.zbin, r.p1, r.p2] = r.value
        return out

    def is_compatible(self, other: CorrFunc, require: bool = False) -> bool:
        for what in ("binning", "patches", "auto", "scalar"):
            if getattr(self, what) != getattr(other, what):
                if require:
                    raise ValueError(f"{what} does not agree")
                return False
        return True

    def __add__(self, other: CorrFunc) -> CorrFunc:
        """Counts and normalisation of both, where both have the same kinds."""
        self.is_compatible(other, require=True)
        if set(self.kinds) != set(other.kinds):
            raise ValueError("kinds does not agree")
        total = lambda a, b: a.unionByName(b).groupBy("kind", "zbin", "p1", "p2").agg(F.sum("value").alias("value"))
        return replace(self, counts=total(self.counts, other.counts), norm=total(self.norm, other.norm))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, CorrFunc) and self.is_compatible(other) and set(self.kinds) == set(other.kinds) and all(
            results.same(results.sparse(a), results.sparse(b)) for a, b in ((self.counts, other.counts), (self.norm, other.norm)))

    __hash__ = None

    def bins(self, first: int, end: int) -> CorrFunc:
        return replace(self, binning=self.binning[first:end], counts=results.bin_slice(self.counts, first, end), norm=results.bin_slice(self.norm, first, end))

    def patch_slice(self, first: int, end: int) -> CorrFunc:
        return replace(self, patches=end - first, counts=results.patch_slice(self.counts, first, end), norm=results.patch_slice(self.norm, first, end))

    def to_file(self, path: str, overwrite: bool = False) -> None:
        """A folder: ``counts`` and ``norm`` as Parquet by kind, without groups that are 0, and ``about``."""
        mode = "overwrite" if overwrite else "errorifexists"
        for name, df in (("counts", self.counts), ("norm", self.norm)):
            results.sparse(df).select("kind", "zbin", "p1", "p2", "value").repartition(1, "kind").write.mode(mode).partitionBy("kind").parquet(f"{path}/{name}")
        about = (VERSION, list(self.binning.edges), self.binning.closed, self.patches, list(self.kinds), self.auto, self.scalar)
        spark = self.counts.sparkSession
        spark.createDataFrame([about], "version int, edges array<double>, closed string, patches int, kinds array<string>, auto boolean, scalar boolean").coalesce(1).write.mode(mode).json(f"{path}/about")

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> CorrFunc:
        r = spark.read.schema("version int, edges array<double>, closed string, patches int, kinds array<string>, auto boolean, scalar boolean").json(f"{path}/about").first()
        if r is None or r.version != VERSION:
            raise ValueError(f"not a correlation function of version {VERSION}: {path}")
        schema = "zbin int, p1 int, p2 int, value double, kind string"
        counts, norm = (spark.read.schema(schema).parquet(f"{path}/{name}").select("kind", "zbin", "p1", "p2", "value") for name in ("counts", "norm"))
        return cls(Binning(tuple(r.edges), r.closed), r.patches, tuple(r.kinds), counts, norm, r.auto, r.scalar)

    def released(self) -> None:
        self.counts.unpersist()
        self.norm.unpersist()


def max_angle(config: Configuration) -> float:
    """The largest angle to expect, at the least redshift of the bins or ``NEAR``."""
    s = config.scales
    z = max(config.binning.binning.edges[0], NEAR)
    return max(hi for _, hi in cosmo.angles(list(zip(s.rmin, s.rmax)), s.unit, z, config.model(config.cosmology)))


def linkage(config: Configuration, first: Catalog, *others: Catalog) -> DataFrame:
    """Pairs of patches (p1, p2) that can hold pairs of points, by the catalog with the most records.

    The join of cells meets such pairs only, so counts need no list of them.
    """
    first.check_consistent(*others)
    largest = max((first, *others), key=lambda c: sum(c.num_records))
    return patches.linkage(largest.frame(), max_angle(config))


def checked(*catalogs: Catalog | None) -> list[Catalog]:
    """The given catalogs, if their patches match and none is given twice."""
    some = [c for c in catalogs if c is not None]
    if len({id(c.df) for c in some}) < len(some):
        raise ValueError("the same catalog is given more than once")
    some[0].check_consistent(*some[1:])
    return some


def fine_of(config: Configuration) -> pairs.Fine | None:
    return None if config.scales.rweight is None else pairs.Fine(config.scales.rweight, config.scales.fine)


def by_scale(config: Configuration, patches_: int, counts: DataFrame, norm: DataFrame, kinds: Sequence[str], auto: bool, scalar: bool = False) -> list[CorrFunc]:
    """One container for each scale; all scales share one stored table of counts."""
    counts, out = counts.persist(), []
    for s in range(config.scales.num_scales):
        own = counts.where(F.col("scale") == s)
        norms = (own.select("kind", "zbin", "p1", "p2", F.col("number").alias("value")) if scalar else norm).select("kind", "zbin", "p1", "p2", "value")
        out.append(CorrFunc(config.binning.binning, patches_, tuple(kinds), own.select("kind", "zbin", "p1", "p2", "value"), norms, auto, scalar))
    return out


def autocorrelate(config: Configuration, data: Catalog, random: Catalog, *, count_rr: bool = True) -> list[CorrFunc]:
    """DD, DR and, unless told otherwise, RR; both catalogs need redshifts."""
    checked(data, random)
    b = config.binning.binning
    for c in (data, random):
        c.with_bins(b)
    counts, norm, kinds = measure.autocorrelate(b, config.limits, data.num_patches, measure.Sample(data.df), measure.Sample(random.df), count_rr, fine_of(config))
    return by_scale(config, data.num_patches, counts, norm, kinds, True)


def crosscorrelate(config: Configuration, reference: Catalog, unknown: Catalog, *, ref_rand: Catalog | None = None, unk_rand: Catalog | None = None) -> list[CorrFunc]:
    """DD and, as far as there are randoms, DR, RD and RR; the unknown side is never binned."""
    if ref_rand is None and unk_rand is None:
        raise ValueError("at least one random dataset must be provided")
    checked(reference, unknown, ref_rand, unk_rand)
    b = config.binning.binning
    for c in (reference, ref_rand):
        if c is not None:
            c.with_bins(b)
    sides = [None if c is None else measure.Sample(c.df) for c in (reference, unknown, ref_rand, unk_rand)]
    counts, norm, kinds = measure.crosscorrelate(b, config.limits, reference.num_patches, *sides, fine=fine_of(config))
    return by_scale(config, reference.num_patches, counts, norm, kinds, False)


def autocorrelate_scalar(config: Configuration, data: Catalog) -> list[CorrFunc]:
    """The scalar field with itself: sums of kappa's products over number counts."""
    d = data.with_bins(config.binning.binning)
    counts = measure.scalar_counts(config.binning.binning, config.limits, d, d, "kk", True, fine_of(config)).withColumn("kind", F.lit("dd"))
    return by_scale(config, data.num_patches, counts, counts, ["dd"], True, True)


def crosscorrelate_scalar(config: Configuration, reference: Catalog, unknown: Catalog, *, unk_rand: Catalog | None = None) -> list[CorrFunc]:
    """The reference's scalar field with the unknown sample, less that with its randoms or, without them, its mean."""
    checked(reference, unknown, unk_rand)
    b, fine = config.binning.binning, fine_of(config)
    ref = reference.with_bins(b)
    one = lambda c, kind: measure.scalar_counts(b, config.limits, ref, c.df.drop("zbin"), "kn", fine=fine).withColumn("kind", F.lit(kind))
    if unk_rand is not None:
        counts = one(unknown, "dd").unionByName(one(unk_rand, "dr"))
    else:
        scales = F.explode(F.sequence(F.lit(0), F.lit(config.scales.num_scales - 1))).alias("scale")
        mean = results.scalar_norm(ref).select(scales, "zbin", F.col("patch").alias("p1"), F.col("patch").alias("p2"), F.col("kw").alias("value"), F.col("sw").alias("number"), F.lit("dr").alias("kind"))
        counts = one(unknown, "dd").unionByName(mean)
    return by_scale(config, reference.num_patches, counts, counts, ["dd", "dr"], False, True)
