"""Registered queries over four catalogs derived from the driver tables, with SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import measurements
from ..catalog import Catalog
from ..config import Configuration
from ..functions import sky
from ..functions.bins import Binning
from ..operators import pairs, patches, resample, results
from ..randoms import box, healpix
from . import measure

CENTERS = [(math.radians(10 + 5 * (i + 0.5) / 3), math.radians(-2.5 + 5 * (j + 0.5) / 3)) for i in range(3) for j in range(3)]
EDGES = (0.15, 0.26, 0.37, 0.48, 0.59, 0.70)
BINS = Binning(EDGES)
REACH = (0.30, 0.22, 0.18, 0.155, 0.14)
#: Two scales: the whole annulus, and its outer part.
LIMITS = pairs.Limits(tuple(((math.radians(t / 10), math.radians(t)), (math.radians(t / 3), math.radians(t))) for t in REACH))
ONE = pairs.Limits(tuple((s[0],) for s in LIMITS.by_bin))
K = len(CENTERS)

VIEWS = {
    "ref": ("part", "p_partkey", 40504, 65537, 17, 104730, 911, "1.5e-1 + 5.5e-1 * (p_retailprice - 9.0e2) / 1.0e2", "p_size / 2.5e1", "(p_size - 2.55e1) / 2.5e1"),
    "ref_rand": ("orders", "o_orderkey", 40505, 65537, 34, 104731, 1822, "1.5e-1 + 5.5e-1 * (o_totalprice - 1.0e3) / 4.99e5", "1.0e0 + (o_custkey % 5) / 1.0e1", "0.0e0"),
    "unk": ("customer", "c_custkey", 40506, 65537, 51, 104732, 2733, "1.5e-1 + 5.5e-1 * (c_acctbal + 1.0e3) / 1.1e4", "1.0e0 + c_nationkey / 2.5e1", "0.0e0"),
    "unk_rand": ("events", "event_id", 40507, 65537, 68, 104733, 3644, "1.5e-1 + 5.5e-1 * value / 5.0e2", "1.0e0", "0.0e0"),
}


def columns(name: str) -> list[str]:
    _, k, a, b, c, d, e, z, w, kappa = VIEWS[name]
    return [f"{k} AS id", f"radians(1.0e1 + 5.0e0 * (({k}*{k}*{a} + {k}*{b} + {c}) % 1000003) / 1000003.0e0) AS ra",
            f"radians(-2.5e0 + 5.0e0 * (({k}*{k}*30011 + {k}*{d} + {e}) % 1000003) / 1000003.0e0) AS de", f"{z} AS z", f"{w} AS w", f"{kappa} AS kappa"]


def points(spark: SparkSession, sf_dir: str, name: str, direct: bool = False) -> DataFrame:
    """``direct`` is for plans that don't filter by patch."""
    df = spark.read.parquet(f"{sf_dir}/{VIEWS[name][0]}.parquet").selectExpr(*columns(name))
    return patches.assign(sky.with_xyz(df, "ra", "de"), CENTERS, direct)


def num(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def sql_views(*names: str) -> str:
    """CTEs for the catalogs: <name> with x, y, z3 and patch, <name>_b with zbin as well."""
    out = []
    for n in names:
        dist = ", ".join(f"(x - {num(a)})*(x - {num(a)}) + (y - {num(b)})*(y - {num(b)}) + (z3 - {num(c)})*(z3 - {num(c)})" for a, b, c in (
            (math.cos(r) * math.cos(d), math.sin(r) * math.cos(d), math.sin(d)) for r, d in CENTERS))
        zbin = " ".join(f"WHEN z > {num(a)} AND z <= {num(b)} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
        out.append(f"""{n} AS (SELECT *, (list_position(l, list_min(l)) - 1)::INTEGER AS patch FROM (SELECT *, [{dist}] AS l FROM (
            SELECT *, cos(ra)*cos(de) AS x, sin(ra)*cos(de) AS y, sin(de) AS z3 FROM (SELECT {', '.join(columns(n))} FROM {VIEWS[n][0]})))),
        {n}_b AS (SELECT * FROM (SELECT *, CASE {zbin} END AS zbin FROM {n}) WHERE zbin IS NOT NULL)""")
    return ",\n".join(out)


def sql_limit(scale: int, side: int, zbin: str = "a.zbin", limits: pairs.Limits = LIMITS) -> str:
    return f"CASE {zbin} " + " ".join(f"WHEN {k} THEN {num(float((2 * math.sin(s[scale][side] / 2)) ** 2))}" for k, s in enumerate(limits.by_bin)) + " END"


D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z3-b.z3)*(a.z3-b.z3))"


def sql_counts(kind: str, a: str, b: str, scale: int = 0, auto: bool = False, same_bin: bool = False, v: tuple[str, str] = ("a.w", "b.w"), limits: pairs.Limits = LIMITS) -> str:
    half = " * CASE WHEN a.patch = b.patch THEN 0.5e0 ELSE 1e0 END" if auto else ""
    where = (" AND a.zbin = b.zbin" if same_bin or auto else "") + (" AND a.patch <= b.patch" if auto else "")
    return f"""SELECT '{kind}' AS kind, {scale} AS scale, a.zbin, a.patch AS p1, b.patch AS p2, sum({v[0]} * {v[1]}{half}) AS value, count(*)::BIGINT AS pairs
        FROM {a} AS a, {b} AS b WHERE {D2} > {sql_limit(scale, 0, limits=limits)} AND {D2} <= {sql_limit(scale, 1, limits=limits)}{where} GROUP BY a.zbin, a.patch, b.patch"""


ALL = "ref, ref_rand, unk, unk_rand".split(", ")
GRID = f"grid AS (SELECT zbin::INTEGER AS zbin, p::INTEGER AS patch FROM range({len(BINS)}) AS z(zbin), range({K}) AS p(p))"


def sql_weights(name: str, view: str, binned: bool) -> str:
    on = "s.patch = grid.patch" + (" AND s.zbin = grid.zbin" if binned else "")
    by = "zbin, patch" if binned else "patch"
    return f"{name} AS (SELECT grid.zbin, grid.patch, coalesce(s.sw, 0e0) AS sw FROM grid LEFT JOIN (SELECT {by}, sum(w) AS sw FROM {view} GROUP BY {by}) AS s ON {on})"


def sql_product(kind: str, a: str, b: str, auto: bool = False) -> str:
    half = " * CASE WHEN a.patch = b.patch THEN 0.5e0 ELSE 1e0 END" if auto else ""
    return f"SELECT '{kind}' AS kind, a.zbin, a.patch AS p1, b.patch AS p2, a.sw * b.sw{half} AS value FROM {a} AS a JOIN {b} AS b ON a.zbin = b.zbin" + (" WHERE a.patch <= b.patch" if auto else "")


def sql_jackknife(name: str, source: str, kinds: list[str]) -> str:
    return f"""{name} AS (SELECT k.kind, z.zbin::INTEGER AS zbin, s.sample::INTEGER AS sample, coalesce(sum(v.value) FILTER (WHERE s.sample NOT IN (v.p1, v.p2)), 0e0) AS value
        FROM (SELECT unnest({kinds}) AS kind) AS k CROSS JOIN range({len(BINS)}) AS z(zbin) CROSS JOIN range(-1, {K}) AS s(sample)
        LEFT JOIN {source} AS v ON v.kind = k.kind AND v.zbin = z.zbin GROUP BY ALL)"""


def sql_cross_parts(limits: pairs.Limits) -> str:
    """CTEs of the whole chain from the catalogs to the covariance."""
    return f"""{sql_views(*ALL)}, {GRID},
counts AS MATERIALIZED ({sql_counts('dd', 'ref_b', 'unk', limits=limits)} UNION ALL {sql_counts('dr', 'ref_b', 'unk_rand', limits=limits)} UNION ALL {sql_counts('rd', 'ref_rand_b', 'unk', limits=limits)} UNION ALL {sql_counts('rr', 'ref_rand_b', 'unk_rand', limits=limits)}),
{sql_weights('w1', 'ref_b', True)}, {sql_weights('w2', 'ref_rand_b', True)}, {sql_weights('w3', 'unk', False)}, {sql_weights('w4', 'unk_rand', False)},
weights AS ({sql_product('dd', 'w1', 'w3')} UNION ALL {sql_product('dr', 'w1', 'w4')} UNION ALL {sql_product('rd', 'w2', 'w3')} UNION ALL {sql_product('rr', 'w2', 'w4')}),
{sql_jackknife('num', 'counts', ['dd', 'dr', 'rd', 'rr'])}, {sql_jackknife('den', 'weights', ['dd', 'dr', 'rd', 'rr'])},
norm AS (SELECT kind, zbin, sample, num.value / nullif(den.value, 0) AS value FROM num JOIN den USING (kind, zbin, sample)),
wide AS (SELECT zbin, sample, max(value) FILTER (WHERE kind = 'dd') AS dd, max(value) FILTER (WHERE kind = 'dr') AS dr, max(value) FILTER (WHERE kind = 'rd') AS rd, max(value) FILTER (WHERE kind = 'rr') AS rr FROM norm GROUP BY ALL),
corr AS (SELECT zbin, sample, ((dd - dr) + (rr - rd)) / nullif(rr, 0) AS value FROM wide),
dz AS (SELECT * FROM (VALUES {', '.join(f'({k}, {num(w)})' for k, w in enumerate(BINS.widths))}) AS t(zbin, dz)),
nz AS (SELECT zbin, sample, value / sqrt(dz * dz) AS value FROM corr JOIN dz USING (zbin)),
cov AS (SELECT a.zbin AS zbin_i, b.zbin AS zbin_j, CASE WHEN count(a.value) = count(*) AND count(b.value) = count(*) THEN covar_pop(a.value, b.value) * (count(*) - 1) END AS cov FROM nz AS a JOIN nz AS b USING (sample) WHERE sample >= 0 GROUP BY ALL)"""


CROSS = sql_cross_parts(LIMITS)


def sample(s: SparkSession, d: str, name: str, direct: bool = False) -> measure.Sample:
    return measure.Sample(points(s, d, name, direct))


def binned(s: SparkSession, d: str, name: str) -> DataFrame:
    return sample(s, d, name).binned(BINS)


def cross(s: SparkSession, d: str):
    return measure.crosscorrelate(BINS, ONE, K, *[sample(s, d, n, True) for n in ("ref", "unk", "ref_rand", "unk_rand")])


def cross_corr(s: SparkSession, d: str) -> DataFrame:
    return measure.correlation(*cross(s, d), BINS, K)


def cross_nz(s: SparkSession, d: str) -> DataFrame:
    return resample.redshifts(cross_corr(s, d), BINS.frame(s))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names or ("value",)})


def _xyz(df: DataFrame) -> DataFrame:
    return rounded(df.select("id", "x", "y", "z3"), "x", "y", "z3", digits=9)


def _from_3d(df: DataFrame) -> DataFrame:
    ra, dec = sky.ra_dec(F.col("x") * 2, F.col("y") * 2, F.col("z3") * 2)
    return rounded(df.select("id", ra.alias("ra"), dec.alias("de")), "ra", "de", digits=9)


def _distance(df: DataFrame) -> DataFrame:
    c = [F.lit(v) for v in (math.cos(0.2), math.sin(0.2), 0.0)]
    d = sky.distance((F.col("x"), F.col("y"), F.col("z3")), tuple(c))
    return rounded(df.select("id", d.alias("angle"), sky.angle_to_chord(d).alias("chord"), sky.chord_to_angle(sky.angle_to_chord(d)).alias("again")), "angle", "chord", "again", digits=9)


def _linkage(s: SparkSession, d: str) -> DataFrame:
    return patches.linkage(patches.metadata(points(s, d, "ref"), "w"), math.radians(0.3))


def _multi(s: SparkSession, d: str) -> DataFrame:
    return rounded(measure.kind_counts(binned(s, d, "ref"), points(s, d, "unk"), LIMITS, "dd").drop("kind"))


def _kind(first: str, second: str, modes: str = "nn"):
    return lambda s, d: rounded(measure.kind_counts(binned(s, d, first), points(s, d, second), ONE, "dd", modes=modes).select("zbin", "p1", "p2", "value", "pairs"))


def _auto(s: SparkSession, d: str, modes: str = "nn") -> DataFrame:
    return rounded(measure.kind_counts(binned(s, d, "ref"), binned(s, d, "ref"), ONE, "dd", True, modes).select("zbin", "p1", "p2", "value", "pairs"))


def _equi(s: SparkSession, d: str) -> DataFrame:
    return rounded(measure.kind_counts(binned(s, d, "ref"), binned(s, d, "unk_rand"), ONE, "dr").select("zbin", "p1", "p2", "value", "pairs"))


def _rweight(s: SparkSession, d: str) -> DataFrame:
    v = lambda df: measure.weighted(df)
    return rounded(pairs.count_power(v(binned(s, d, "ref")), v(points(s, d, "unk")), ONE, -1.0, 4).select("zbin", "p1", "p2", "value"))


def sql_rweight() -> str:
    import numpy as np

    cases = []
    for k, s in enumerate(ONE.by_bin):
        lo, hi = s[0]
        edges = np.exp(np.linspace(np.log(lo), np.log(hi), 5))
        edges[0], edges[-1] = lo, hi
        mids = np.sqrt(edges[1:] * edges[:-1]) ** -1.0
        c = (2 * np.sin(edges / 2)) ** 2
        cases += [f"WHEN zbin = {k} AND d2 > {num(c[i])} AND d2 <= {num(c[i + 1])} THEN {num(m)}" for i, m in enumerate(mids / mids.sum())]
    return f"""WITH {sql_views('ref', 'unk')}, p AS (SELECT a.zbin, a.patch AS p1, b.patch AS p2, a.w * b.w AS v, {D2} AS d2 FROM ref_b AS a, unk AS b
        WHERE {D2} > {sql_limit(0, 0)} AND {D2} <= {sql_limit(0, 1)})
        SELECT zbin, p1, p2, round(sum(v * CASE {' '.join(cases)} END), 6) AS value FROM p GROUP BY ALL"""


def _scalar_norm(s: SparkSession, d: str) -> DataFrame:
    own = binned(s, d, "ref").groupBy("zbin", "patch").agg(F.sum(F.col("kappa") * F.col("w")).alias("kw"), F.sum("w").alias("sw"))
    full = resample.grid(own, len(BINS), K).join(own, ["zbin", "patch"], "left").na.fill(0.0)
    return rounded(full.select("zbin", "patch", "kw", "sw"), "kw", "sw")


def _norm_product(s: SparkSession, d: str) -> DataFrame:
    w = resample.sum_weights(binned(s, d, "ref"), len(BINS), K)
    return rounded(resample.products(w, w, True))


def _hist(s: SparkSession, d: str) -> DataFrame:
    return resample.histogram(points(s, d, "ref", True), BINS, K)


def _hist_norm(s: SparkSession, d: str) -> DataFrame:
    width = BINS.frame(s).select("zbin", "dz")
    per = _hist(s, d).join(F.broadcast(width), "zbin").select("zbin", "sample", (F.col("value") / F.col("dz")).alias("value"))
    return rounded(resample.normalised(per, BINS.frame(s)))


def _nz_to(s: SparkSession, d: str) -> DataFrame:
    target = _hist(s, d).where("sample = -1").select("zbin", "value")
    return rounded(resample.normalised_to(cross_nz(s, d), target), digits=5)


def _cov(s: SparkSession, d: str) -> DataFrame:
    return rounded(resample.covariance(cross_nz(s, d)), "cov")


def _box(s: SparkSession, d: str) -> DataFrame:
    return rounded(box(s, 10_000, math.radians(10), math.radians(15), math.radians(-2.5), math.radians(2.5), seed=12345).withColumnRenamed("dec", "de"), "ra", "de", digits=9)


def sql_uniform(stream: int) -> str:
    return f"(('0x' || substr(md5('12345:{stream}:' || id), 1, 13))::BIGINT::DOUBLE / {num(float(1 << 52))})"


def _randoms(s: SparkSession, d: str) -> DataFrame:
    return box(s, 10_000, math.radians(10), math.radians(15), math.radians(-2.5), math.radians(2.5), seed=12345, observed=points(s, d, "ref").select("z", "w"))


def _healpix(s: SparkSession, d: str) -> DataFrame:
    return healpix(s, s.range(12 * 4**3).selectExpr("id AS pixel", "CAST(id % 3 AS DOUBLE) AS weight"), 3, 10_000)


def _auto_corr(s: SparkSession, d: str) -> DataFrame:
    counts, weights, kinds = measure.autocorrelate(BINS, ONE, K, sample(s, d, "ref"), sample(s, d, "ref_rand"), count_rr=False)
    return rounded(measure.correlation(counts, weights, kinds, BINS, K))


def _auto_parts(s: SparkSession, d: str, data: str, random: str):
    return measure.autocorrelate(BINS, ONE, K, sample(s, d, data, True), sample(s, d, random, True))


def _auto_rr(s: SparkSession, d: str) -> DataFrame:
    return rounded(measure.correlation(*_auto_parts(s, d, "ref", "ref_rand"), BINS, K))


def _nz_bias(s: SparkSession, d: str) -> DataFrame:
    w = [measure.correlation(*_auto_parts(s, d, *names), BINS, K) for names in (("ref", "ref_rand"), ("unk", "unk_rand"))]
    return resample.redshifts(cross_corr(s, d), BINS.frame(s), *w)


def _rweight_multi(s: SparkSession, d: str) -> DataFrame:
    counted = pairs.count(measure.weighted(binned(s, d, "ref")), measure.weighted(points(s, d, "unk")), LIMITS, fine=pairs.Fine(-0.5))
    return rounded(counted)


def _undefined(s: SparkSession, d: str) -> DataFrame:
    """Samples with negative, undefined and missing values: the histogram less its mean, without one sample of one bin."""
    lost = F.when((F.col("zbin") == 1) & (F.col("sample") == 2), None).otherwise(F.col("value") - 500.0)
    return rounded(resample.covariance(_hist(s, d).withColumn("value", lost)), "cov", digits=4)


def _nz_to_negative(s: SparkSession, d: str) -> DataFrame:
    shifted = _hist(s, d).withColumn("value", F.when(F.col("zbin") == 3, float("inf")).when(F.col("zbin") == 2, None).otherwise(F.col("value") * (1 - F.col("zbin") * 3)))
    target = _hist(s, d).where("sample = -1").select("zbin", F.when(F.col("zbin") != 4, F.col("value")).otherwise(0.0).alias("value"))
    return rounded(resample.normalised_to(shifted, target), digits=5)


SQL_UNDEFINED = "h AS (SELECT zbin, sample, CASE WHEN zbin = 1 AND sample = 2 THEN NULL ELSE value - 5e2 END AS value FROM hist WHERE sample >= 0)"
SQL_NEGATIVE = """y AS (SELECT zbin, sample, CASE zbin WHEN 3 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value * (1 - zbin * 3) END AS value FROM hist),
    t AS (SELECT zbin, CASE WHEN zbin <> 4 THEN value ELSE 0e0 END AS t FROM hist WHERE sample = -1),
    f AS (SELECT sum(t*t*value*value) / sum(t*t*t*value) AS f FROM y JOIN t USING (zbin) WHERE sample = -1 AND isfinite(value) AND isfinite(t) AND t > 0)"""


def sql_auto_corr(tag: str, data: str, random: str) -> str:
    """CTEs up to <tag>: the Landy-Szalay autocorrelation."""
    return f"""{tag}c AS MATERIALIZED ({sql_counts('dd', data + '_b', data + '_b', auto=True)} UNION ALL {sql_counts('dr', data + '_b', random + '_b', same_bin=True)} UNION ALL {sql_counts('rr', random + '_b', random + '_b', auto=True)}),
        {sql_weights(tag + '1', data + '_b', True)}, {sql_weights(tag + '2', random + '_b', True)},
        {tag}w AS ({sql_product('dd', tag + '1', tag + '1', True)} UNION ALL {sql_product('dr', tag + '1', tag + '2')} UNION ALL {sql_product('rr', tag + '2', tag + '2', True)}),
        {sql_jackknife(tag + 'n', tag + 'c', ['dd', 'dr', 'rr'])}, {sql_jackknife(tag + 'd', tag + 'w', ['dd', 'dr', 'rr'])},
        {tag}v AS (SELECT zbin, sample, max(v) FILTER (WHERE kind = 'dd') AS dd, max(v) FILTER (WHERE kind = 'dr') AS dr, max(v) FILTER (WHERE kind = 'rr') AS rr FROM (
            SELECT kind, zbin, sample, n.value / nullif(d.value, 0) AS v FROM {tag}n AS n JOIN {tag}d AS d USING (kind, zbin, sample)) GROUP BY ALL),
        {tag} AS (SELECT zbin, sample, ((dd - dr) + (rr - dr)) / nullif(rr, 0) AS value FROM {tag}v)"""


def sql_rweight_multi() -> str:
    cases = []
    for (k, s), (edges, weights) in pairs.Fine(-0.5).tables(LIMITS).items():
        steps = " ".join(f"WHEN d2 <= {num(e)} THEN {num(w)}" for e, w in zip(edges[1:], weights[1:-1]))
        cases.append(f"WHEN zbin = {k} AND scale = {s} THEN CASE {steps} END")
    one = lambda s: f"SELECT {s} AS scale, a.zbin, a.patch AS p1, b.patch AS p2, a.w * b.w AS v, {D2} AS d2 FROM ref_b AS a, unk AS b WHERE {D2} > {sql_limit(s, 0)} AND {D2} <= {sql_limit(s, 1)}"
    return f"WITH {sql_views('ref', 'unk')}, p AS ({one(0)} UNION ALL {one(1)}) SELECT scale::INTEGER AS scale, zbin, p1, p2, round(sum(v * CASE {' '.join(cases)} END), 6) AS value, count(*)::BIGINT AS pairs FROM p GROUP BY ALL"


#: A configuration of one scale that is the same angle in all bins.
CONFIG = Configuration.create(rmin=0.6, rmax=9.0, unit="arcmin", edges=list(EDGES))


def _catalogs(s: SparkSession, d: str) -> dict[str, Catalog]:
    return {n: Catalog(points(s, d, n, True)) for n in ALL}


def _configured(s: SparkSession, d: str) -> DataFrame:
    c = _catalogs(s, d)
    (corr,) = measurements.crosscorrelate(CONFIG, c["ref"], c["unk"], ref_rand=c["ref_rand"], unk_rand=c["unk_rand"])
    return rounded(measurements.RedshiftData.from_corrfuncs(corr).df)


def _stored_counts(s: SparkSession, d: str) -> DataFrame:
    """What is kept of normalisation: groups that aren't 0."""
    w = resample.sum_weights(binned(s, d, "ref").where("patch <> 4"), len(BINS), K)
    return rounded(results.sparse(resample.products(w, w, True)))


def _sets(s: SparkSession, d: str, kind: str) -> DataFrame:
    corr, hist = cross_corr(s, d).withColumn("set", F.lit(0)), _hist(s, d).withColumn("set", F.lit(1))
    return rounded(results.covariance(corr.unionByName(hist), kind), "cov", digits=5)


def sql_sets(keep: str) -> str:
    return sql_cross(f""", {HIST}, joint AS (SELECT 0 AS set, zbin, sample, value FROM corr UNION ALL SELECT 1, zbin, sample, value FROM hist)
        SELECT a.set AS set_i, a.zbin AS zbin_i, b.set AS set_j, b.zbin AS zbin_j, round(CASE WHEN NOT ({keep}) THEN 0e0 WHEN count(a.value) = count(*) AND count(b.value) = count(*) THEN covar_pop(a.value, b.value) * (count(*) - 1) END, 5) AS cov
        FROM joint AS a JOIN joint AS b USING (sample) WHERE sample >= 0 GROUP BY a.set, a.zbin, b.set, b.zbin""")


def sql_scalar(kind: str, counts: str) -> str:
    """<kind>: resampled scalar counts over number counts; ``counts`` has zbin, p1, p2, k and n."""
    one = lambda c: f"coalesce(sum({c}) FILTER (WHERE s.sample NOT IN (v.p1, v.p2)), 0e0)"
    return f"""{kind}_v AS MATERIALIZED ({counts}),
        {kind} AS (SELECT z.zbin::INTEGER AS zbin, s.sample::INTEGER AS sample, {one('v.k')} / nullif({one('v.n')}, 0) AS value
        FROM range({len(BINS)}) AS z(zbin) CROSS JOIN range(-1, {K}) AS s(sample) LEFT JOIN {kind}_v AS v ON v.zbin = z.zbin GROUP BY z.zbin, s.sample)"""


def sql_scalar_counts(a: str, b: str, first: str, auto: bool = False) -> str:
    half = " * CASE WHEN a.patch = b.patch THEN 0.5e0 ELSE 1e0 END" if auto else ""
    where = " AND a.zbin = b.zbin AND a.patch <= b.patch" if auto else ""
    return f"""SELECT a.zbin, a.patch AS p1, b.patch AS p2, sum({first} * a.w * b.w{half}) AS k, sum(a.w * b.w{half}) AS n
        FROM {a} AS a, {b} AS b WHERE {D2} > {sql_limit(0, 0)} AND {D2} <= {sql_limit(0, 1)}{where} GROUP BY a.zbin, a.patch, b.patch"""


MEAN_KAPPA = "SELECT zbin, patch AS p1, patch AS p2, sum(kappa * w) AS k, sum(w) AS n FROM ref_b GROUP BY zbin, patch"
HIST = f"""hist0 AS (SELECT 'h' AS kind, CASE {' '.join(f'WHEN z < {num(e)} THEN {k}' for k, e in enumerate(EDGES[1:-1]))} ELSE {len(BINS) - 1} END AS zbin, patch AS p1, patch AS p2, sum(w) AS value
    FROM ref WHERE z > {num(EDGES[0])} AND z <= {num(EDGES[-1])} GROUP BY ALL), {sql_jackknife('hist', 'hist0', ['h'])}"""
HIST_LEFT = f"""hist0 AS (SELECT 'h' AS kind, CASE {' '.join(f'WHEN z < {num(e)} THEN {k}' for k, e in enumerate(EDGES[1:-1]))} ELSE {len(BINS) - 1} END AS zbin, patch AS p1, patch AS p2, sum(w) AS value
    FROM ref WHERE z >= {num(EDGES[0])} AND z < {num(EDGES[-1])} GROUP BY ALL), {sql_jackknife('hist', 'hist0', ['h'])}"""
WIDTHS = f"dz AS (SELECT * FROM (VALUES {', '.join(f'({k}, {num(w)})' for k, w in enumerate(BINS.widths))}) AS t(zbin, dz))"
META = """m AS (SELECT patch, count(*)::BIGINT AS num_records, sum(w) AS sum_weights, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*z3)/sum(w) AS mz FROM ref GROUP BY patch),
c AS (SELECT patch, num_records, sum_weights, atan2(my, mx) AS ra, asin(mz / sqrt(mx*mx+my*my+mz*mz)) AS de FROM m),
u AS (SELECT *, cos(ra)*cos(de) AS cx, sin(ra)*cos(de) AS cy, sin(de) AS cz FROM c),
meta AS (SELECT u.patch, any_value(num_records) AS num_records, any_value(sum_weights) AS sum_weights, any_value(u.ra) AS ra, any_value(u.de) AS de, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz,
  max(2*asin(least(1e0, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z3-cz)*(z3-cz))/2))) AS radius FROM u JOIN ref ON ref.patch = u.patch GROUP BY u.patch)"""


def sql(body: str, *names: str) -> str:
    return f"WITH {sql_views(*(names or ('ref',)))} {body}"


def sql_cross(body: str) -> str:
    return f"WITH {CROSS} {body}"


def plain(text: str) -> str:
    return f"SELECT zbin, p1, p2, round(value, 6) AS value, pairs FROM ({text})"


UNIT = {"ux": num(math.cos(0.2)), "uy": num(math.sin(0.2))}
ANGLE = f"2*asin(least(1e0, sqrt((x-{UNIT['ux']})*(x-{UNIT['ux']}) + (y-{UNIT['uy']})*(y-{UNIT['uy']}) + z3*z3)/2))"

#: name: (query, SQL or None)
TABLE = {
    "src_scan": (lambda s, d: rounded(points(s, d, "ref").select("id", "ra", "de", "z", "w", "kappa"), "ra", "de", "z", "w", "kappa", digits=9),
                 f"SELECT id, round(ra, 9) AS ra, round(de, 9) AS de, round(z, 9) AS z, round(w, 9) AS w, round(kappa, 9) AS kappa FROM (SELECT {', '.join(columns('ref'))} FROM part)"),
    "prj_to_3d": (lambda s, d: _xyz(points(s, d, "ref_rand")), sql("SELECT id, round(x, 9) AS x, round(y, 9) AS y, round(z3, 9) AS z3 FROM ref_rand", "ref_rand")),
    "prj_from_3d": (lambda s, d: _from_3d(points(s, d, "ref_rand")), f"SELECT id, round(ra, 9) AS ra, round(de, 9) AS de FROM (SELECT {', '.join(columns('ref_rand'))} FROM orders)"),
    "prj_distance": (lambda s, d: _distance(points(s, d, "unk")), sql(f"SELECT id, round({ANGLE}, 9) AS angle, round(2*sin({ANGLE}/2), 9) AS chord, round({ANGLE}, 9) AS again FROM unk", "unk")),
    "prj_cylinder": (lambda s, d: rounded(points(s, d, "unk").select("id", F.col("ra").alias("cx"), sky.to_cylinder(F.col("ra"), F.col("de"))[1].alias("cy")), "cx", "cy", digits=9),
                     sql("SELECT id, round(ra, 9) AS cx, round(sin(de), 9) AS cy FROM unk", "unk")),
    "prj_bins": (lambda s, d: rounded(BINS.frame(s), "z_lo", "z_hi", "z_mid", "dz", digits=9),
                 "SELECT * FROM (VALUES " + ", ".join(f"({k}, round({num(a)}, 9), round({num(b)}, 9), round({num((a + b) / 2)}, 9), round({num(b - a)}, 9))" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ") AS t(zbin, z_lo, z_hi, z_mid, dz)"),
    "flt_zbin_right": (lambda s, d: binned(s, d, "ref").select("id", "zbin"), sql("SELECT id, zbin FROM ref_b")),
    "flt_zbin_left": (lambda s, d: points(s, d, "ref").withColumn("zbin", Binning(EDGES, "left").assign(F.col("z"))).where("zbin is not null").select("id", "zbin"),
                      sql("SELECT id, CASE " + " ".join(f"WHEN z >= {num(a)} AND z < {num(b)} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + f" END AS zbin FROM ref WHERE z >= {num(EDGES[0])} AND z < {num(EDGES[-1])}")),
    "join_nearest_center": (lambda s, d: points(s, d, "ref_rand").select("id", "patch"), sql("SELECT id, patch FROM ref_rand", "ref_rand")),
    "join_patch_linkage": (_linkage, sql(f", {META} SELECT a.patch AS p1, b.patch AS p2 FROM meta a, meta b WHERE 2*asin(least(1e0, sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))/2)) < a.radius + b.radius + {num(math.radians(0.3))}")),
    "join_dist_cross": (lambda s, d: measure.kind_counts(binned(s, d, "ref"), points(s, d, "unk"), ONE, "dd").groupBy("zbin").agg(F.sum("pairs").alias("pairs")),
                        sql(f"SELECT zbin, sum(pairs)::BIGINT AS pairs FROM ({sql_counts('dd', 'ref_b', 'unk')}) GROUP BY zbin", "ref", "unk")),
    "join_dist_auto": (_auto, sql(plain(sql_counts("dd", "ref_b", "ref_b", auto=True)))),
    "join_zbin_equi": (_equi, sql(plain(sql_counts("dr", "ref_b", "unk_rand_b", same_bin=True)), "ref", "unk_rand")),
    "agg_patch_meta": (lambda s, d: rounded(patches.metadata(points(s, d, "ref"), "w").withColumnRenamed("dec", "de"), "sum_weights", "ra", "de", "radius", digits=8),
                       sql(f", {META} SELECT patch, num_records, round(sum_weights, 8) AS sum_weights, round(ra, 8) AS ra, round(de, 8) AS de, round(radius, 8) AS radius FROM meta")),
    "agg_sum_weights": (lambda s, d: rounded(resample.sum_weights(binned(s, d, "ref"), len(BINS), K), "sw"), sql(f", {GRID}, {sql_weights('q', 'ref_b', True)} SELECT zbin, patch, round(sw, 6) AS sw FROM q")),
    "agg_pairs_nn": (_kind("ref", "unk"), sql(plain(sql_counts("dd", "ref_b", "unk")), "ref", "unk")),
    "agg_pairs_kn": (_kind("ref", "unk", "kn"), sql(plain(sql_counts("dd", "ref_b", "unk", v=("a.kappa * a.w", "b.w"))), "ref", "unk")),
    "agg_pairs_kk": (lambda s, d: _auto(s, d, "kk"), sql(plain(sql_counts("dd", "ref_b", "ref_b", auto=True, v=("a.kappa * a.w", "(b.kappa * b.w)"))))),
    "agg_multi_scale": (_multi, sql(f"SELECT scale, zbin, p1, p2, round(value, 6) AS value, pairs FROM ({sql_counts('dd', 'ref_b', 'unk')} UNION ALL {sql_counts('dd', 'ref_b', 'unk', 1)})", "ref", "unk")),
    "agg_rweight": (_rweight, sql_rweight()),
    "agg_norm_product": (_norm_product, sql(f", {GRID}, {sql_weights('q', 'ref_b', True)} SELECT zbin, p1, p2, round(value, 6) AS value FROM ({sql_product('dd', 'q', 'q', True)})")),
    "agg_scalar_norm": (_scalar_norm, sql(f", {GRID} SELECT zbin, patch, round(coalesce(sum(kappa * w), 0), 6) AS kw, round(coalesce(sum(w), 0), 6) AS sw FROM grid LEFT JOIN ref_b USING (zbin, patch) GROUP BY zbin, patch")),
    "agg_histogram": (lambda s, d: rounded(_hist(s, d)), sql(f", {HIST} SELECT zbin, sample, round(value, 6) AS value FROM hist")),
    "hist_normalise": (_hist_norm, sql(f", {HIST}, {WIDTHS}, h AS (SELECT zbin, sample, value / dz AS value, dz FROM hist JOIN dz USING (zbin)) SELECT zbin, sample, round(value / (SELECT sum(value * dz) FROM h WHERE sample = -1), 6) AS value FROM h")),
    "agg_jackknife_pairs": (lambda s, d: rounded(resample.jackknife(cross(s, d)[0], ["kind", "zbin"], BINS.frame(s).select("zbin", F.explode(F.array(*map(F.lit, ("dd", "dr", "rd", "rr")))).alias("kind")), K), digits=4),
                            sql_cross("SELECT kind, zbin, sample, round(value, 4) AS value FROM num")),
    "agg_normalised": (lambda s, d: rounded(measure.normalised(*cross(s, d), BINS, K), digits=10), sql_cross("SELECT kind, zbin, sample, round(value, 10) AS value FROM norm")),
    "est_davis_peebles": (lambda s, d: rounded(resample.correlation(measure.normalised(*cross(s, d), BINS, K).where("kind in ('dd', 'rd')"), {"dd", "rd"})),
                          sql_cross("SELECT zbin, sample, round((dd - rd) / nullif(rd, 0), 6) AS value FROM wide")),
    "est_landy_szalay": (lambda s, d: rounded(cross_corr(s, d)), sql_cross("SELECT zbin, sample, round(value, 6) AS value FROM corr")),
    "nz_estimate": (lambda s, d: rounded(cross_nz(s, d)), sql_cross("SELECT zbin, sample, round(value, 6) AS value FROM nz")),
    "nz_normalise": (lambda s, d: rounded(resample.normalised(cross_nz(s, d), BINS.frame(s))), sql_cross("SELECT zbin, sample, round(value / (SELECT sum(dz * value) FROM nz JOIN dz USING (zbin) WHERE sample = -1), 6) AS value FROM nz")),
    "nz_normalise_to": (_nz_to, sql_cross(f", {HIST}, f AS (SELECT sum(h.value*h.value*n.value*n.value) / sum(h.value*h.value*h.value*n.value) AS f FROM nz AS n JOIN hist AS h ON n.zbin = h.zbin WHERE n.sample = -1 AND h.sample = -1 AND isfinite(n.value) AND h.value > 0) SELECT zbin, sample, round(value / f, 5) AS value FROM nz, f")),
    "agg_covariance": (_cov, sql_cross("SELECT zbin_i, zbin_j, round(cov, 6) AS cov FROM cov")),
    "agg_errors": (lambda s, d: rounded(resample.errors(resample.covariance(cross_nz(s, d))), "error"), sql_cross("SELECT zbin_i AS zbin, round(sqrt(cov), 6) AS error FROM cov WHERE zbin_i = zbin_j")),
    "agg_correlation": (lambda s, d: rounded(resample.correlation_matrix(resample.covariance(cross_nz(s, d))), "corr"),
                        sql_cross("SELECT c.zbin_i, c.zbin_j, round(c.cov / (sqrt(a.cov) * sqrt(b.cov)), 6) AS corr FROM cov c JOIN cov a ON a.zbin_i = c.zbin_i AND a.zbin_j = c.zbin_i JOIN cov b ON b.zbin_i = c.zbin_j AND b.zbin_j = c.zbin_j")),
    "agg_pairs_nk": (lambda s, d: rounded(measure.kind_counts(binned(s, d, "unk"), points(s, d, "ref"), ONE, "dd", modes="nk").select("zbin", "p1", "p2", "value", "pairs")),
                     sql(plain(sql_counts("dd", "unk_b", "ref", v=("a.w", "(b.kappa * b.w)"))), "ref", "unk")),
    "meas_autocorrelate": (_auto_corr, f"""WITH {sql_views('ref', 'ref_rand')}, {GRID}, counts AS MATERIALIZED ({sql_counts('dd', 'ref_b', 'ref_b', auto=True)} UNION ALL {sql_counts('dr', 'ref_b', 'ref_rand_b', same_bin=True)}),
        {sql_weights('w1', 'ref_b', True)}, {sql_weights('w2', 'ref_rand_b', True)}, weights AS ({sql_product('dd', 'w1', 'w1', True)} UNION ALL {sql_product('dr', 'w1', 'w2')}),
        {sql_jackknife('num', 'counts', ['dd', 'dr'])}, {sql_jackknife('den', 'weights', ['dd', 'dr'])},
        norm AS (SELECT kind, zbin, sample, num.value / nullif(den.value, 0) AS value FROM num JOIN den USING (kind, zbin, sample)),
        wide AS (SELECT zbin, sample, max(value) FILTER (WHERE kind = 'dd') AS dd, max(value) FILTER (WHERE kind = 'dr') AS dr FROM norm GROUP BY ALL)
        SELECT zbin, sample, round((dd - dr) / nullif(dr, 0), 6) AS value FROM wide"""),
    "meas_autocorrelate_rr": (_auto_rr, f"WITH {sql_views('ref', 'ref_rand')}, {GRID}, {sql_auto_corr('ss', 'ref', 'ref_rand')} SELECT zbin, sample, round(value, 6) AS value FROM ss"),
    "nz_estimate_bias": (lambda s, d: rounded(_nz_bias(s, d)), sql_cross(f""", {sql_auto_corr('ss', 'ref', 'ref_rand')}, {sql_auto_corr('pp', 'unk', 'unk_rand')}
        SELECT corr.zbin, corr.sample, round(CASE WHEN ss.value * pp.value > 0 THEN corr.value / sqrt(dz * dz * ss.value * pp.value) END, 6) AS value
        FROM corr JOIN dz USING (zbin) JOIN ss USING (zbin, sample) JOIN pp USING (zbin, sample)""")),
    "agg_rweight_multi": (_rweight_multi, sql_rweight_multi()),
    "agg_covariance_undefined": (_undefined, sql(f", {HIST}, {SQL_UNDEFINED} SELECT a.zbin AS zbin_i, b.zbin AS zbin_j, round(CASE WHEN count(a.value) = count(*) AND count(b.value) = count(*) THEN covar_pop(a.value, b.value) * (count(*) - 1) END, 4) AS cov FROM h AS a JOIN h AS b USING (sample) GROUP BY ALL")),
    "nz_normalise_to_negative": (_nz_to_negative, sql(f", {HIST}, {SQL_NEGATIVE} SELECT zbin, sample, round(value / f, 5) AS value FROM y, f")),
    "meas_autocorrelate_scalar": (lambda s, d: rounded(measure.autocorrelate_scalar(BINS, ONE, K, sample(s, d, "ref"))),
                                  sql(f", {sql_scalar('dd', sql_scalar_counts('ref_b', 'ref_b', '(a.kappa * b.kappa)', True))} SELECT zbin, sample, round(value, 6) AS value FROM dd")),
    "est_scalar": (lambda s, d: rounded(measure.crosscorrelate_scalar(BINS, ONE, K, sample(s, d, "ref"), sample(s, d, "unk"), sample(s, d, "unk_rand"))),
                   sql(f", {sql_scalar('dd', sql_scalar_counts('ref_b', 'unk', 'a.kappa'))}, {sql_scalar('dr', sql_scalar_counts('ref_b', 'unk_rand', 'a.kappa'))} SELECT zbin, sample, round(dd.value - dr.value, 6) AS value FROM dd JOIN dr USING (zbin, sample)", "ref", "unk", "unk_rand")),
    "meas_crosscorrelate_scalar": (lambda s, d: rounded(measure.crosscorrelate_scalar(BINS, ONE, K, sample(s, d, "ref"), sample(s, d, "unk"))),
                                   sql(f", {sql_scalar('dd', sql_scalar_counts('ref_b', 'unk', 'a.kappa'))}, {sql_scalar('dr', MEAN_KAPPA)} SELECT zbin, sample, round(dd.value - dr.value, 6) AS value FROM dd JOIN dr USING (zbin, sample)", "ref", "unk")),
    "agg_covariance_joint": (lambda s, d: _sets(s, d, "full"), sql_sets("true")),
    "agg_covariance_var": (lambda s, d: _sets(s, d, "var"), sql_sets("a.set = b.set AND a.zbin = b.zbin")),
    "agg_covariance_diag": (lambda s, d: _sets(s, d, "diag"), sql_sets("a.zbin = b.zbin")),
    "agg_mean_direction": (lambda s, d: rounded(sky.mean_direction(points(s, d, "ref"), ["patch"], "w").withColumnRenamed("dec", "de"), "ra", "de", digits=9),
                           sql(f", {META} SELECT patch, round(ra, 9) AS ra, round(de, 9) AS de FROM meta")),
    "agg_distance_range": (lambda s, d: rounded(results.distance_range(points(s, d, "unk"), 0.2, 0.0), "nearest", "farthest", digits=9),
                           sql(f"SELECT round(min({ANGLE}), 9) AS nearest, round(max({ANGLE}), 9) AS farthest FROM unk", "unk")),
    "join_linkage_statistics": (lambda s, d: rounded(results.linkage_statistics(_linkage(s, d), K), "density"),
                                sql(f", {META} SELECT {K * K}::BIGINT AS num_total, count(*)::BIGINT AS num_links, round(count(*) / {float(K * K)}e0, 6) AS density FROM meta a, meta b WHERE 2*asin(least(1e0, sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))/2)) < a.radius + b.radius + {num(math.radians(0.3))}")),
    "flt_patch_slice": (lambda s, d: results.patch_slice(_kind("ref", "unk")(s, d), 2, 6), sql("SELECT zbin, p1 - 2 AS p1, p2 - 2 AS p2, value, pairs FROM (" + plain(sql_counts("dd", "ref_b", "unk")) + ") WHERE p1 BETWEEN 2 AND 5 AND p2 BETWEEN 2 AND 5", "ref", "unk")),
    "flt_bin_slice": (lambda s, d: results.bin_slice(rounded(_hist(s, d)), 1, 4), sql(f", {HIST} SELECT zbin - 1 AS zbin, sample, round(value, 6) AS value FROM hist WHERE zbin BETWEEN 1 AND 3")),
    "src_probe": (lambda s, d: results.probe(points(s, d, "unk_rand"), "id", 173).select("id"),
                  "SELECT id FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r IN (SELECT (k * ((SELECT count(*) FROM events) - 1)) // 172 FROM range(173) AS t(k))"),
    "patch_divide": (lambda s, d: patches.divided(points(s, d, "ref").drop("patch").withColumn("part", F.col("id") % 7), "part").select("id", "patch"), "SELECT p_partkey AS id, (p_partkey % 7)::INTEGER AS patch FROM part"),
    "meas_configured": (_configured, f"WITH {sql_cross_parts(CONFIG.limits)} SELECT zbin, sample, round(value, 6) AS value FROM nz"),
    "est_combined": (lambda s, d: rounded(results.combined(_hist(s, d), results.combined(_hist(s, d), _hist(s, d)), -1)), sql(f", {HIST} SELECT zbin, sample, round(-value, 6) AS value FROM hist")),
    "snk_sparse_counts": (_stored_counts, sql(f", {GRID}, lost AS (SELECT * FROM ref_b WHERE patch <> 4), {sql_weights('q', 'lost', True)} SELECT zbin, p1, p2, round(value, 6) AS value FROM ({sql_product('dd', 'q', 'q', True)}) WHERE value <> 0")),
    "flt_binning_slice": (lambda s, d: rounded(BINS[1:4].frame(s), "z_lo", "z_hi", "z_mid", "dz", digits=9),
                          "SELECT * FROM (VALUES " + ", ".join(f"({k}, round({num(a)}, 9), round({num(b)}, 9), round({num((a + b) / 2)}, 9), round({num(b - a)}, 9))" for k, (a, b) in enumerate(zip(EDGES[1:4], EDGES[2:5]))) + ") AS t(zbin, z_lo, z_hi, z_mid, dz)"),
    "hist_left": (lambda s, d: rounded(resample.histogram(points(s, d, "ref"), Binning(EDGES, "left"), K)), sql(f", {HIST_LEFT} SELECT zbin, sample, round(value, 6) AS value FROM hist")),
    "random_healpix": (_healpix, None),
    "random_box": (_box, f"SELECT id, round({num(math.radians(10))} + {sql_uniform(0)} * {num(math.radians(15) - math.radians(10))}, 9) AS ra, round(asin({num(math.sin(math.radians(-2.5)))} + {sql_uniform(1)} * {num(math.sin(math.radians(2.5)) - math.sin(math.radians(-2.5)))}), 9) AS de FROM range(10000) AS t(id)"),
    "random_attributes": (_randoms, None),
}
QUERIES = {name: q for name, (q, _) in TABLE.items()}
ORACLE_SQL = {name: text for name, (_, text) in TABLE.items() if text}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_pairs_nn"](spark, sf_dir)
