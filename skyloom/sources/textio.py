"""Results as text: ``.dat`` (values and errors), ``.smp`` (samples) and ``.cov`` (covariance).

Results have a row for each bin and patch at most, so they are collected and written by the driver.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.bins import Binning
from ..operators import resample

#: Fixed by the file format: characters of a number, decimals of a covariance.
WIDTH = 10
DECIMALS = 7
#: Fixed by the file format: first lines.
TITLES = {
    "nz": ("n(z) estimate with symmetric 68% percentile confidence", "n(z) jackknife samples", "n(z) estimate covariance matrix"),
    "hist": ("n(z) histogram with symmetric 68% percentile confidence", "n(z) histogram jackknife samples", "n(z) histogram covariance matrix"),
    "corr": ("correlation function with symmetric 68% percentile confidence", "correlation function jackknife samples", "correlation function covariance matrix"),
}


def number(value: float | None) -> str:
    """A sign or space and as many digits as fit the width; whole digits are never cut. Null is nan."""
    v = math.nan if value is None else float(value)
    if not math.isfinite(v):
        return str(v).rjust(WIDTH)
    text = f"{v: .{WIDTH}f}"
    return text[: max(WIDTH, text.index("."))]


def columns(names: list[str], closed: str) -> str:
    edges = ["[z_low", "z_high)"] if closed == "left" else ["(z_low", "z_high]"]
    return "#" + " ".join(n.rjust(WIDTH) for n in edges + names)[1:]


def dense(data: DataFrame, bins: int) -> tuple[list[float], dict[int, list[float]]]:
    """Whole values by bin, and those of each sample; what has no row is nan."""
    whole, samples = [math.nan] * bins, {}
    for r in data.select("zbin", "sample", "value").collect():
        own = whole if r["sample"] < 0 else samples.setdefault(r["sample"], [math.nan] * bins)
        own[r["zbin"]] = math.nan if r["value"] is None else r["value"]
    return whole, dict(sorted(samples.items()))


def write(data: DataFrame, binning: Binning, prefix: str, kind: str = "nz") -> None:
    """Writes ``prefix`` with the three suffixes from (zbin, sample, value)."""
    n, titles = len(binning), TITLES[kind]
    whole, samples = dense(data, n)
    cov = np.full((n, n), math.nan)
    for r in resample.covariance(data).collect():
        cov[r["zbin_i"], r["zbin_j"]] = math.nan if r["cov"] is None else r["cov"]
    with np.errstate(invalid="ignore"):
        errors = np.sqrt(np.diag(cov))
    edges = list(zip(binning.edges, binning.edges[1:]))
    tables = {
        "dat": (titles[0], ["nz", "nz_err"], [(*e, v, s) for e, v, s in zip(edges, whole, errors)]),
        "smp": (f"{len(samples)} {titles[1]}", [f"jack_{k}" for k in range(len(samples))], [(*e, *(s[b] for s in samples.values())) for b, e in enumerate(edges)]),
    }
    for suffix, (title, names, rows) in tables.items():
        body = [" ".join(map(number, r)) for r in rows]
        Path(f"{prefix}.{suffix}").write_text("\n".join([f"# {title}", columns(names, binning.closed), *body]) + "\n")
    rows = ["".join(f"{v: .{DECIMALS}e} " for v in row) for row in cov]
    Path(f"{prefix}.cov").write_text("\n".join([f"# {titles[2]} ({n}x{n})", *rows]) + "\n")


def read(spark: SparkSession, prefix: str) -> tuple[Binning, DataFrame]:
    """Bins and (zbin, sample, value) from ``.dat`` and ``.smp``; nan is null."""
    head = Path(f"{prefix}.dat").read_text().splitlines()[1]
    table = np.loadtxt(f"{prefix}.dat", ndmin=2)
    samples = np.loadtxt(f"{prefix}.smp", ndmin=2)[:, 2:]
    binning = Binning((*table[:, 0].tolist(), float(table[-1, 1])), "left" if "[z_low" in head else "right")
    value = lambda v: None if math.isnan(v) else float(v)
    rows = [(b, -1, value(v)) for b, v in enumerate(table[:, 2])]
    rows += [(b, k, value(v)) for b, own in enumerate(samples) for k, v in enumerate(own)]
    return binning, spark.createDataFrame(rows, "zbin int, sample int, value double")


def read_covariance(prefix: str) -> np.ndarray:
    return np.loadtxt(f"{prefix}.cov", ndmin=2)
