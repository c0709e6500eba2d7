"""Normalisation, leave-one-patch-out resampling, estimators and covariance, on long tables.

Counts are (kind, zbin, p1, p2, value); sample -1 is the whole, sample k leaves patch k out.
Grids of bins and patches are dense, so groups without pairs count as 0.

A chain names its input once at each step: a table that is joined with itself twice over is a plan of many copies of all counts,
and planning those takes longer than counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class EstimatorError(Exception):
    """Pair counts that an estimator needs are missing."""


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def grid(df: DataFrame, bins: int, patches: int) -> DataFrame:
    """All (zbin, patch)."""
    return df.sparkSession.range(bins * patches).select((F.col("id") / patches).cast("int").alias("zbin"), (F.col("id") % patches).cast("int").alias("patch"))


def sum_weights(points: DataFrame, bins: int, patches: int) -> DataFrame:
    """(zbin, patch, sw) with 0 for empty ones; points without zbin repeat their patch's sum in every bin."""
    by = ["zbin", "patch"] if "zbin" in points.columns else ["patch"]
    sums = points.groupBy(*by).agg(F.sum("w").alias("sw"))
    return grid(points, bins, patches).join(F.broadcast(sums), by, "left").select("zbin", "patch", F.coalesce("sw", F.lit(0.0)).alias("sw"))


def products(first: DataFrame, second: DataFrame, auto: bool = False) -> DataFrame:
    """Normalisation by patch pair: sw1 * sw2; ``auto`` keeps p1 <= p2 and halves the diagonal."""
    a = first.select("zbin", F.col("patch").alias("p1"), F.col("sw").alias("s1"))
    b = second.select("zbin", F.col("patch").alias("p2"), F.col("sw").alias("s2"))
    value = F.col("s1") * F.col("s2")
    both = a.join(b, "zbin")
    if auto:
        both = both.where("p1 <= p2")
        value = value * F.when(F.col("p1") == F.col("p2"), 0.5).otherwise(1.0)
    return both.select("zbin", "p1", "p2", value.alias("value"))


def jackknife(values: DataFrame, by: list[str], bins: DataFrame, patches: int) -> DataFrame:
    """Totals (sample -1) and leave-one-out sums: what touches the patch is taken off the total.

    ``values`` has ``by``, p1, p2 and value; ``bins`` the groups that must appear.
    """
    whole = F.lit(-1)
    touch = F.when(F.col("p1") == F.col("p2"), F.array(whole, "p1")).otherwise(F.array(whole, "p1", "p2"))
    own = values.withColumn("sample", F.explode(touch)).groupBy(*by, "sample").agg(F.sum("value").alias("own"))
    samples = bins.select(*by, F.explode(F.sequence(F.lit(-1), F.lit(patches - 1))).alias("sample"))
    out = samples.join(own, [*by, "sample"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    total = F.max(F.when(F.col("sample") == -1, F.col("own"))).over(W.partitionBy(*by))
    return out.select(*by, "sample", F.when(F.col("sample") == -1, F.col("own")).otherwise(total - F.col("own")).alias("value"))


def davis_peebles(dd: Column, mixed: Column) -> Column:
    return ratio(dd - mixed, mixed)


def landy_szalay(dd: Column, dr: Column, rd: Column, rr: Column) -> Column:
    return ratio((dd - dr) + (rr - rd), rr)


def scalar(dd: Column, dr: Column | None = None) -> Column:
    return dd if dr is None else dd - dr


def correlation(normalised: DataFrame, kinds: set[str], is_scalar: bool = False) -> DataFrame:
    """Estimator over (kind, zbin, sample, value): Landy-Szalay if RR is there, else Davis-Peebles."""
    if not is_scalar and not kinds & {"dr", "rd"}:
        raise EstimatorError("either 'dr' or 'rd' are required")
    wide = normalised.groupBy("zbin", "sample").pivot("kind", sorted(kinds)).agg(F.first("value"))
    c = {k: F.col(k) for k in kinds}
    if is_scalar:
        value = scalar(c["dd"], c.get("dr"))
    elif "rr" in kinds:
        dr = c.get("dr", c.get("rd"))
        value = landy_szalay(c["dd"], dr, c.get("rd", dr), c["rr"])
    else:
        value = davis_peebles(c["dd"], c.get("rd", c.get("dr")))
    return wide.select("zbin", "sample", value.alias("value"))


def covariance(samples: DataFrame) -> DataFrame:
    """Leave-one-out covariance (zbin_i, zbin_j, cov) of (zbin, sample, value), without sample -1; null where a sample of either bin is undefined."""
    return paired(samples, ["zbin"]).groupBy("zbin_i", "zbin_j").agg(sampled_covariance("vi", "vj").alias("cov"))


def paired(samples: DataFrame, by: list[str]) -> DataFrame:
    """Every two values of a sample: ``by`` with _i and _j, vi and vj, without sample -1.  A sample has one value for each bin, so it is one row on the way."""
    lists = samples.where("sample >= 0").groupBy("sample").agg(F.collect_list(F.struct(*by, "value")).alias("all"))
    both = lists.select(F.explode("all").alias("i"), "all").select("i", F.explode("all").alias("j"))
    keys = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ij" for c in by]
    return both.select(*keys, F.col("i.value").alias("vi"), F.col("j.value").alias("vj"))


def sampled_covariance(a: str, b: str) -> Column:
    whole = (F.count("*") > 1) & (F.count(a) == F.count("*")) & (F.count(b) == F.count("*"))
    return F.when(whole, F.covar_pop(a, b) * (F.count("*") - 1))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def errors(cov: DataFrame) -> DataFrame:
    return cov.where("zbin_i = zbin_j").select(F.col("zbin_i").alias("zbin"), F.sqrt("cov").alias("error"))


def correlation_matrix(cov: DataFrame) -> DataFrame:
    """cov over the product of errors, 0 where cov is 0."""
    own = F.when(F.col("zbin_i") == F.col("zbin_j"), F.struct(F.sqrt("cov").alias("error")))
    full = cov.withColumns({e: F.max(own).over(W.partitionBy(c)) for e, c in (("ei", "zbin_i"), ("ej", "zbin_j"))}).where("ei is not null and ej is not null")
    value = ratio(F.col("cov"), F.col("ei.error") * F.col("ej.error"))
    return full.select("zbin_i", "zbin_j", F.when(F.col("cov") == 0, 0.0).otherwise(value).alias("corr"))


def redshifts(cross: DataFrame, bins: DataFrame, ref: DataFrame | None = None, unk: DataFrame | None = None) -> DataFrame:
    """n = w_sp / sqrt(dz^2 w_ss w_pp) of (zbin, sample, value); a missing autocorrelation is 1, a negative product gives null."""
    out = cross.join(F.broadcast(bins.select("zbin", "dz")), "zbin")
    product = F.col("dz") * F.col("dz")
    for name, auto in (("ss", ref), ("pp", unk)):
        if auto is not None:
            out = out.join(auto.select("zbin", "sample", F.col("value").alias(name)), ["zbin", "sample"])
            product = product * F.col(name)
    return out.select("zbin", "sample", F.when(product > 0, F.col("value") / F.sqrt(product)).alias("value"))


def normalised(data: DataFrame, bins: DataFrame) -> DataFrame:
    """Unit integral of the whole data; samples share its factor."""
    d = data.join(F.broadcast(bins.select("zbin", "dz")), "zbin")
    norm = d.where("sample = -1").where(~F.isnan("value")).agg(F.sum(F.col("dz") * F.col("value")).alias("norm"))
    return d.crossJoin(F.broadcast(norm)).select("zbin", "sample", ratio(F.col("value"), F.col("norm")).alias("value"))  # norm is one row


def normalised_to(data: DataFrame, target: DataFrame) -> DataFrame:
    """Scaled to a target (zbin, value) by least squares with errors inverse to the target, over bins where both are finite and the target is positive."""
    t = target.select("zbin", F.col("value").alias("t"))
    both = data.where("sample = -1").join(t, "zbin").where(finite(F.col("value")) & finite(F.col("t")) & (F.col("t") > 0))
    norm = both.agg(ratio(F.sum(F.col("t") * F.col("t") * F.col("value") * F.col("value")), F.sum(F.col("t") * F.col("t") * F.col("t") * F.col("value"))).alias("norm"))
    return data.crossJoin(F.broadcast(norm)).select("zbin", "sample", ratio(F.col("value"), F.col("norm")).alias("value"))  # norm is one row


def histogram(points: DataFrame, binning, patches: int) -> DataFrame:
    """Weighted redshift histogram as (zbin, sample, value): whole and leave-one-patch-out."""
    rows = points.withColumn("zbin", binning.histogram(F.col("z"))).where("zbin is not null")
    own = rows.groupBy("zbin", "patch").agg(F.sum("w").alias("value")).select("zbin", F.col("patch").alias("p1"), F.col("patch").alias("p2"), "value")
    return jackknife(own, ["zbin"], binning.frame(points.sparkSession).select("zbin"), patches)
