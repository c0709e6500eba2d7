"""Redshift bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSED = ("left", "right")


@dataclass(frozen=True)
class Binning:
    """Contiguous bins by their edges; ``closed`` is the side that belongs to a bin."""

    edges: tuple[float, ...]
    closed: str = "right"

    def __post_init__(self):
        if self.closed not in CLOSED:
            raise ValueError(f"invalid value for 'closed': {self.closed}")
        if len(self.edges) < 2:
            raise ValueError("at least two bin edges are required")
        if any(not a < b for a, b in zip(self.edges, self.edges[1:])):
            raise ValueError("each bin edge must be above the one before")

    def __len__(self) -> int:
        return len(self.edges) - 1

    @property
    def mids(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.edges, self.edges[1:])]

    @property
    def widths(self) -> list[float]:
        return [b - a for a, b in zip(self.edges, self.edges[1:])]

    def __getitem__(self, item: slice | int) -> Binning:
        """The chosen bins; they must be adjacent to keep their edges."""
        keep = range(len(self))[item]
        keep = [keep] if isinstance(keep, int) else list(keep)
        return Binning(tuple(self.edges[k] for k in keep) + (self.edges[keep[-1] + 1],), self.closed)

    def assign(self, z: Column) -> Column:
        """Index of the bin of ``z`` from 0; null outside."""
        n = len(self)
        if self.closed == "right":
            below = sum((F.when(z > e, 1).otherwise(0) for e in self.edges), F.lit(0)) - 1
        else:
            below = sum((F.when(z >= e, 1).otherwise(0) for e in self.edges), F.lit(0)) - 1
        return F.when((below >= 0) & (below < n) & ~F.isnan(z), below)

    def histogram(self, z: Column) -> Column:
        """As ``assign``, but the way histograms bin: interior edges belong to the right bin, and with
        ``closed`` right the last edge is inside and the first outside; null outside."""
        first, last = self.edges[0], self.edges[-1]
        inside = (z > first) & (z <= last) if self.closed == "right" else (z >= first) & (z < last)
        index = sum((F.when(z >= e, 1).otherwise(0) for e in self.edges[1:-1]), F.lit(0))
        return F.when(inside & ~F.isnan(z), index)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per bin: zbin, z_lo, z_hi, z_mid, dz."""
        rows = ", ".join(f"({k}, " + ", ".join(f"{float(v)!r}D" for v in (a, b, (a + b) / 2, b - a)) + ")" for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS bins(zbin, z_lo, z_hi, z_mid, dz)")
