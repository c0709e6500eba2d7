"""Catalog ingest: files or DataFrames to points with patches, stored by patch and read again.

A catalog has ra, dec (radians), x, y, z3, w (1 without weights), z and kappa
where they are given, and patch.  Empty input gives an empty catalog; a null,
NaN or infinite value fails the job that reads it.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..operators import patches
from . import fits

#: The suffixes of each format.
PARQUET = (".pq", ".pqt", ".parq", ".parquet")
FITS = (".fits", ".cat")
HDF = (".hdf5", ".hdf", ".h5")


def opened(spark: SparkSession, path: str, hdu: int = 1, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """The table at ``path``, by its suffix: ``columns`` of it, or all; ``hdu`` is for FITS, ``rows`` (of a task) for FITS and HDF5."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in PARQUET:
        df = spark.read.parquet(path)
        return df if columns is None else df.select(*[f"`{c}`" for c in columns if c in df.columns])
    if suffix not in FITS + HDF:
        raise ValueError(f"unsupported file format: '{suffix}'")
    fits.register(spark)
    options = {} if columns is None else {"columns": json.dumps(columns)}
    if rows is not None:
        options["rows"] = rows
    if suffix in HDF:
        return spark.read.format("skyhdf").options(**options).load(path)
    return spark.read.format("skyfits").options(hdu=hdu, **options).load(path)


def finite(df: DataFrame, name: str) -> Column:
    """The column as double; rows with a value that isn't finite raise."""
    c = F.col(f"`{name}`").cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"column '{name}' has values that are not finite")).cast("double")).otherwise(c)


def points(df: DataFrame, ra: str, dec: str, weight: str | None = None, redshift: str | None = None, kappa: str | None = None, patch: str | None = None, degrees: bool = True) -> DataFrame:
    """The configured columns only, checked and under the catalog's names; ``patch`` is kept as ``patch_id``."""
    named = {"ra": ra, "dec": dec, "w": weight, "z": redshift, "kappa": kappa, "patch_id": patch}
    missing = [v for v in named.values() if v is not None and v not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    out = []
    for name, source in named.items():
        if name == "patch_id" and source:
            out.append(F.col(f"`{source}`").alias(name))
        elif source:
            c = finite(df, source)
            out.append((F.radians(c) if degrees and name in ("ra", "dec") else c).alias(name))
    rows = df.select(*out)
    return sky.with_xyz(rows if weight else rows.withColumn("w", F.lit(1.0)), "ra", "dec")


def catalog(df: DataFrame, ra: str, dec: str, *, weight: str | None = None, redshift: str | None = None, kappa: str | None = None, degrees: bool = True,
            patch_centers: list[tuple[float, float]] | None = None, patch_name: str | None = None, patch_num: int | None = None, seed: int = 12345) -> DataFrame:
    """Points with patches: by the nearest of given centres, else by a column, else by k-means."""
    if patch_centers is None and patch_name is None and patch_num is None:
        raise ValueError("one of patch_centers, patch_name and patch_num is required")
    rows = points(df, ra, dec, weight, redshift, kappa, patch_name if patch_centers is None else None, degrees)
    if patch_centers is not None:
        return patches.assign(rows, patch_centers)
    if patch_name is not None:
        return patches.divided(rows, "patch_id").drop("patch_id")
    return patches.assign(rows, patches.kmeans_centers(rows, patch_num, seed))


def written(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Stores a catalog by patch and returns it as read back; an existing one is replaced only if told so.

    Rows aren't gathered by patch first: a patch may hold a third of them, and no task should.
    """
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("patch").parquet(path)
    return restored(df.sparkSession, path)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """A stored catalog; filters on ``patch`` read only its folders."""
    return spark.read.parquet(path)
