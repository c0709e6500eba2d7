"""Catalogs of points in patches: what measurements take.

A ``Catalog`` is a DataFrame of points (see ``sources.catalogs``) and its
metadata by patch, which is collected once: at most 32 768 rows.  Patch ids
are 0 to K - 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import randoms
from .operators import patches
from .operators.patches import InconsistentPatchesError
from .sources import catalogs

COLUMNS = {"weights": "w", "redshifts": "z", "kappa": "kappa"}


@dataclass(frozen=True)
class PatchMeta:
    """Number of records, sum of weights, centre (ra, dec) and radius in radians."""

    num_records: int
    sum_weights: float
    ra: float
    dec: float
    radius: float

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict) -> PatchMeta:
        return cls(**given)


@dataclass(frozen=True)
class Patch:
    """One patch of a catalog; columns are None where the catalog lacks them."""

    df: DataFrame
    meta: PatchMeta
    present: frozenset[str]

    @property
    def coords(self) -> DataFrame:
        return self.df.select("ra", "dec")

    def _column(self, name: str) -> DataFrame | None:
        return self.df.select(COLUMNS[name]) if name in self.present else None

    weights = property(lambda self: self._column("weights"))
    redshifts = property(lambda self: self._column("redshifts"))
    kappa = property(lambda self: self._column("kappa"))


class Catalog(Mapping):
    """Patches by id, in ascending order.

    ``weighted`` tells whether the weights were given; without them every point weighs 1.
    """

    __eq__, __hash__ = object.__eq__, object.__hash__

    def __init__(self, df: DataFrame, weighted: bool = True):
        self.df, self.weighted = df, weighted

    @classmethod
    def from_dataframe(cls, df, ra: str, dec: str, *, spark: SparkSession | None = None, path: str | None = None, overwrite: bool = False, weight: str | None = None, patch_centers=None, **options) -> Catalog:
        """Points of a Spark or pandas data frame; ``path`` stores them by patch first.  ``patch_centers`` may be a catalog, whose centres are taken."""
        if not isinstance(df, DataFrame):
            df = (spark or SparkSession.active()).createDataFrame(df)
        centers = patch_centers.centers if isinstance(patch_centers, Catalog) else patch_centers
        rows = catalogs.catalog(df, ra, dec, weight=weight, patch_centers=centers, **options)
        return cls(catalogs.written(rows, path, overwrite) if path else rows, weight is not None)

    @classmethod
    def from_file(cls, spark: SparkSession, source: str, ra: str, dec: str, *, hdu: int = 1, rows: int | None = None, **options) -> Catalog:
        """Points of a file, of which only the named columns are read."""
        names = [ra, dec, *(options.get(k) for k in ("weight", "redshift", "kappa", "patch_name"))]
        return cls.from_dataframe(catalogs.opened(spark, source, hdu, [n for n in names if n], rows), ra, dec, **options)

    @classmethod
    def from_random(cls, spark: SparkSession, num_randoms: int, *, box: tuple[float, float, float, float] | None = None, mask: DataFrame | None = None, order: int = 0, seed: int = 12345, observed: DataFrame | None = None, **options) -> Catalog:
        """Randoms in a box (ra and dec limits in degrees) or on the pixels of a mask; ``observed`` (w, z, kappa) gives them its attributes."""
        if (box is None) == (mask is None):
            raise ValueError("either a box or a mask is required")
        if mask is not None:
            if observed is not None:
                raise ValueError("attributes are for randoms in a box")
            rows = randoms.healpix(spark, mask, order, num_randoms, seed)
        else:
            rows = randoms.box(spark, num_randoms, *map(math.radians, box), seed=seed, observed=observed)
        names = {"weight": "w", "redshift": "z", "kappa": "kappa"}
        own = {k: v for k, v in names.items() if v in rows.columns}
        return cls.from_dataframe(rows, "ra", "dec", degrees=False, **own, **options)

    @classmethod
    def restored(cls, spark: SparkSession, path: str, weighted: bool = True) -> Catalog:
        return cls(catalogs.restored(spark, path), weighted)

    @cached_property
    def meta(self) -> dict[int, PatchMeta]:
        rows = patches.metadata(self.df, "w").orderBy("patch").collect()
        ids = [r.patch for r in rows]
        if ids != list(range(len(ids))):
            raise InconsistentPatchesError("patch IDs must be contiguous from 0")
        return {r.patch: PatchMeta(r.num_records, r.sum_weights, r.ra, r.dec, r.radius) for r in rows}

    def __getitem__(self, patch: int) -> Patch:
        flags = {"weights": self.has_weights, "redshifts": self.has_redshifts, "kappa": self.has_kappa}
        return Patch(self.df.where(F.col("patch") == patch), self.meta[patch], frozenset(k for k, v in flags.items() if v))

    def __iter__(self) -> Iterator[int]:
        return iter(self.meta)

    def __len__(self) -> int:
        return len(self.meta)

    num_patches = property(__len__)
    has_weights = property(lambda self: self.weighted)
    has_redshifts = property(lambda self: "z" in self.df.columns)
    has_kappa = property(lambda self: "kappa" in self.df.columns)

    @property
    def centers(self) -> list[tuple[float, float]]:
        return [(m.ra, m.dec) for m in self.meta.values()]

    @property
    def radii(self) -> list[float]:
        return [m.radius for m in self.meta.values()]

    @property
    def num_records(self) -> list[int]:
        return [m.num_records for m in self.meta.values()]

    @property
    def sum_weights(self) -> list[float]:
        return [m.sum_weights for m in self.meta.values()]

    def check_consistent(self, *others: Catalog, tolerance: float = 0.5) -> None:
        """Raises unless all have these patches, with centres within ``tolerance`` of this one's radii."""
        for other in others:
            if self.meta.keys() != other.meta.keys():
                raise InconsistentPatchesError("patch IDs do not match")
            for a, b in zip(self.meta.values(), other.meta.values()):
                if angle((a.ra, a.dec), (b.ra, b.dec)) > tolerance * a.radius:
                    raise InconsistentPatchesError("patch centers are not aligned")

    def frame(self) -> DataFrame:
        """Metadata as a table: patch, num_records, sum_weights, ra, dec and radius."""
        return self.df.sparkSession.createDataFrame(
            [(k, m.num_records, m.sum_weights, m.ra, m.dec, m.radius) for k, m in self.meta.items()],
            "patch int, num_records bigint, sum_weights double, ra double, dec double, radius double")

    def with_bins(self, binning) -> DataFrame:
        if not self.has_redshifts:
            raise ValueError("catalog has no redshifts")
        return self.df.withColumn("zbin", binning.assign(F.col("z"))).where("zbin is not null")


def angle(a: tuple[float, float], b: tuple[float, float]) -> float:
    unit = lambda p: (math.cos(p[0]) * math.cos(p[1]), math.sin(p[0]) * math.cos(p[1]), math.sin(p[1]))
    return 2 * math.asin(min(1.0, math.dist(unit(a), unit(b)) / 2))
