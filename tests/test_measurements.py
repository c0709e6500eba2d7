import math

import numpy as np
import pytest

from skyloom import cosmology, measurements as m, plots
from skyloom.catalog import Catalog, InconsistentPatchesError, PatchMeta, angle
from skyloom.config import Configuration
from skyloom.functions.bins import Binning
from skyloom.operators import pairs, patches, resample
from skyloom.operators.resample import EstimatorError
from skyloom.plans import measure

CENTERS = [(math.radians(a), math.radians(d)) for a in (11, 13) for d in (-1, 1)]


def sky(spark, n, seed, kappa=False, centers=CENTERS):
    rng = np.random.default_rng(seed)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.uniform(10, 14, n), rng.uniform(-2, 2, n), rng.uniform(0.1, 0.9, n), rng.uniform(0.5, 2, n), rng.normal(size=n)])]
    names = "ra double, de double, z double, w double, k double"
    return Catalog.from_dataframe(spark.createDataFrame(rows, names), "ra", "de", redshift="z", weight="w", kappa="k" if kappa else None, patch_centers=centers)


@pytest.fixture(scope="module")
def samples(spark):
    return {name: sky(spark, n, seed, name == "ref") for seed, (name, n) in enumerate({"ref": 150, "unk": 200, "ref_rand": 300, "unk_rand": 250}.items())}


def config(**more):
    return Configuration.create(rmin=[5, 10], rmax=[30, 60], unit="arcmin", edges=[0.1, 0.4, 0.6, 0.9], **more)


def brute(a, b, c, auto=False, same_bin=False, first="w", second="w", power=None):
    """Sums by (scale, bin, p1, p2) over all pairs, one by one."""
    bins, out = c.binning.binning, {}
    limits = c.limits.by_bin
    zbin = lambda z: next((k for k, (lo, hi) in enumerate(zip(bins.edges, bins.edges[1:])) if lo < z <= hi), None)
    right = b.df.collect()
    for p in a.df.collect():
        k = zbin(p.z)
        if k is None:
            continue
        for q in right:
            if same_bin and zbin(q.z) != k or auto and p.patch > q.patch:
                continue
            d = 2 * math.asin(min(1, math.dist((p.x, p.y, p.z3), (q.x, q.y, q.z3)) / 2))
            for s, (lo, hi) in enumerate(limits[k]):
                if lo < d <= hi:
                    v = (p.w if first == "w" else p.kappa * p.w) * (q.w if second == "w" else q.kappa * q.w) * (0.5 if auto and p.patch == q.patch else 1)
                    if power is not None:
                        e = np.geomspace(lo, hi, c.scales.fine + 1)
                        mids = np.sqrt(e[1:] * e[:-1]) ** power
                        v *= mids[np.searchsorted(e[1:-1], d)] / mids.sum()
                    key = (s, k, p.patch, q.patch)
                    out[key] = out.get(key, 0.0) + v
    return out


def close(frames, want):
    got = {(s, r.zbin, r.p1, r.p2): r.value for s, f in enumerate(frames) for r in f.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_crosscorrelation_counts(samples):
    c = config()
    corr = m.crosscorrelate(c, samples["ref"], samples["unk"], ref_rand=samples["ref_rand"], unk_rand=samples["unk_rand"])
    for kind, a, b in (("dd", "ref", "unk"), ("dr", "ref", "unk_rand"), ("rd", "ref_rand", "unk"), ("rr", "ref_rand", "unk_rand")):
        close([f.counts.where(f"kind = '{kind}'") for f in corr], brute(samples[a], samples[b], c))
    assert len(corr) == 2 and corr[0].kinds == ("dd", "dr", "rd", "rr") and np.isfinite(corr[1].sample().data).all()
    nz = m.RedshiftData.from_corrfuncs(corr[0], *[m.autocorrelate(c, samples[a], samples[b])[0] for a, b in (("ref", "ref_rand"), ("unk", "unk_rand"))])
    assert nz.samples.shape == (4, 3) and math.isclose(float(np.nansum(nz.normalised().data * nz.binning.widths)), 1.0)


def test_autocorrelation_counts_with_separation_weights(samples):
    c = config(rweight=-1.0, resolution=7)
    corr = m.autocorrelate(c, samples["ref"], samples["ref_rand"])
    close([f.counts.where("kind = 'dd'") for f in corr], brute(samples["ref"], samples["ref"], c, True, True, power=-1.0))
    close([f.counts.where("kind = 'dr'") for f in corr], brute(samples["ref"], samples["ref_rand"], c, False, True, power=-1.0))
    close([f.counts.where("kind = 'rr'") for f in corr], brute(samples["ref_rand"], samples["ref_rand"], c, True, True, power=-1.0))


def test_scalar_counts(samples):
    c = config()
    auto = m.autocorrelate_scalar(c, samples["ref"])
    close([f.counts for f in auto], brute(samples["ref"], samples["ref"], c, True, True, "k", "k"))
    close([f.norm for f in auto], brute(samples["ref"], samples["ref"], c, True, True))
    cross = m.crosscorrelate_scalar(c, samples["ref"], samples["unk"])
    close([f.counts.where("kind = 'dd'") for f in cross], brute(samples["ref"], samples["unk"], c, first="k"))
    points = [r for r in samples["ref"].df.collect() if 0.1 < r.z <= 0.4]
    whole = next(r.value for r in measure.normalised(cross[1].counts, cross[1].norm, ["dr"], cross[1].binning, 4).where("zbin = 0 and sample = -1").collect())
    assert math.isclose(whole, sum(r.kappa * r.w for r in points) / sum(r.w for r in points))
    assert len(m.crosscorrelate_scalar(c, samples["ref"], samples["unk"], unk_rand=samples["unk_rand"])[0].sample().data) == 3


def test_analytic_counts(spark):
    """Three great circles with a point at each degree: a point at (0, 0) sees four on each ring of 1 degree."""
    spots = {(a % 360, 0) for a in range(360)} | {(0, d) for d in range(-89, 90)} | {(180, d) for d in range(-89, 90)} | {(90, d) for d in range(-89, 90)} | {(270, d) for d in range(-89, 90)} | {(0, 90), (0, -90)}
    rows = spark.createDataFrame([(float(a), float(d)) for a, d in spots], "ra double, de double").selectExpr("radians(ra) ra", "radians(de) de")
    xyz = lambda df: df.selectExpr("cos(ra)*cos(de) x", "sin(ra)*cos(de) y", "sin(de) z3", "0 patch", "2.0D v")
    one = xyz(spark.createDataFrame([(0.0, 0.0)], "ra double, de double")).selectExpr("*", "0 zbin")
    rings = tuple((math.radians(k + 0.5), math.radians(k + 1.5)) for k in range(10))
    got = {r.scale: (r.value, r.pairs) for r in pairs.count(one, xyz(rows), pairs.Limits((rings,))).collect()}
    assert got == {k: (16.0, 4) for k in range(10)}
    own = xyz(rows).selectExpr("*", "0 zbin")
    n, (r,) = len(spots), pairs.count(own, own, pairs.Limits((((math.radians(0.5), math.radians(1.2)),),)), auto=True).collect()
    # at the six crossings the points beside them are within reach of each other only by way of the crossing
    assert (r.pairs, r.value) == (2 * n + 12, 2.0 * r.pairs)


def test_hot_cells_and_wide_reach(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5000, 3))
    v[:3000] = [0.6, 0.0, 0.8]
    v[:3000] += rng.normal(scale=1e-5, size=(3000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(*map(float, p), int(k % 3), 0, 1.0) for k, p in enumerate(v)], "x double, y double, z3 double, patch int, zbin int, v double")
    for lo, hi in ((1e-6, 1e-5), (0.5, 2.0), (2.0, math.pi)):
        d = np.array([((v - p) ** 2).sum(1) for p in v])
        a, b = ((2 * math.sin(x / 2)) ** 2 for x in (lo, hi))
        assert sum(r.pairs for r in pairs.count(df, df.drop("zbin"), pairs.Limits((((lo, hi),),))).collect()) == int(((d > a) & (d <= b)).sum())
    limits = pairs.Limits((((0.1, 0.2),),))
    assert pairs.count(df.limit(0), df.drop("zbin"), limits).count() == 0 and pairs.count(df, df.drop("zbin").limit(0), limits).count() == 0


def test_containers(spark, samples, tmp_path):
    c = config()
    corr, wide = m.crosscorrelate(c, samples["ref"], samples["unk"], unk_rand=samples["unk_rand"])
    path = str(tmp_path / "corr")
    corr.to_file(path)
    again = m.CorrFunc.from_file(spark, path)
    assert again == corr and again != wide and np.allclose(again.sample().data, corr.sample().data) and np.allclose(again.sample().samples, corr.sample().samples)
    with pytest.raises(Exception, match="(?i)exists"):
        corr.to_file(path)
    corr.to_file(path, overwrite=True)
    part = corr.bins(1, 3)
    assert part.binning == Binning((0.4, 0.6, 0.9)) and np.allclose(part.dense("dd"), corr.dense("dd")[1:])
    cut = corr.patch_slice(1, 4)
    assert cut.patches == 3 and np.allclose(cut.dense("dr"), corr.dense("dr")[:, 1:, 1:])
    assert np.allclose((corr + corr).dense("dd"), 2 * corr.dense("dd")) and np.allclose((corr + corr).sample().data, corr.sample().data)
    assert corr.is_compatible(wide) and not corr.is_compatible(part)
    with pytest.raises(ValueError, match="binning"):
        corr + part
    with pytest.raises(EstimatorError):
        m.CorrFunc(corr.binning, 4, ("dd",), corr.counts, corr.norm)
    data = corr.sample()
    data.to_files(str(tmp_path / "w"))
    back = m.CorrData.from_files(spark, str(tmp_path / "w"))
    assert np.allclose(back.data, data.data, atol=1e-5) and np.allclose(back.samples, data.samples, atol=1e-5) and back.binning == data.binning
    assert np.allclose((data - data).data, 0) and data.bins(0, 2).data.shape == (2,)
    with pytest.raises(TypeError):
        data.require_compatible(m.HistData.from_catalog(samples["ref"], c))


def test_checks(spark, samples):
    c = config()
    with pytest.raises(ValueError, match="random"):
        m.crosscorrelate(c, samples["ref"], samples["unk"])
    with pytest.raises(ValueError, match="more than once"):
        m.crosscorrelate(c, samples["ref"], samples["ref"], unk_rand=samples["unk_rand"])
    with pytest.raises(InconsistentPatchesError, match="do not match"):
        m.autocorrelate(c, samples["ref"], sky(spark, 100, 9, centers=CENTERS[:3]))
    with pytest.raises(InconsistentPatchesError, match="aligned"):
        m.autocorrelate(c, samples["ref"], sky(spark, 100, 9, centers=CENTERS[::-1]))
    bare = Catalog(samples["unk"].df.drop("z"))
    with pytest.raises(ValueError, match="redshifts"):
        m.autocorrelate(c, bare, samples["ref_rand"])
    assert math.isclose(m.max_angle(c), math.radians(1))
    near = Configuration.create(rmin=100, rmax=1000, zmin=0.01, zmax=1, num_bins=3)
    assert math.isclose(m.max_angle(near), 1 / cosmology.named("Planck15").angular_diameter_distance(0.05))
    links = {(r.p1, r.p2) for r in m.linkage(c, samples["ref"], samples["unk_rand"]).collect()}
    assert links == {(a, b) for a in range(4) for b in range(4)}


def test_catalog(spark, samples, tmp_path):
    ref = samples["ref"]
    assert list(ref) == [0, 1, 2, 3] and ref.num_patches == len(ref) == 4 and sum(ref.num_records) == 150
    patch = ref[2]
    assert patch.meta == PatchMeta.from_dict(patch.meta.to_dict()) and patch.coords.count() == patch.meta.num_records == patch.kappa.count()
    assert samples["unk"][0].kappa is None and not samples["unk"].has_kappa and ref.has_weights and ref.has_redshifts
    far = max(angle((r.ra, r.dec), (patch.meta.ra, patch.meta.dec)) for r in patch.df.collect())
    assert math.isclose(far, patch.meta.radius, rel_tol=1e-9) and math.isclose(sum(r.w for r in patch.weights.collect()), patch.meta.sum_weights)
    path = str(tmp_path / "cat")
    made = Catalog.from_random(spark, 500, box=(10, 14, -2, 2), seed=3, observed=ref.df.select("z", "w"), patch_centers=ref, path=path)
    assert made.num_patches == 4 and made.has_redshifts and sum(made.num_records) == 500
    assert Catalog.restored(spark, path).meta == made.meta
    mask = spark.range(12).selectExpr("id AS pixel", "1.0D AS weight")
    assert sum(Catalog.from_random(spark, 200, mask=mask, patch_centers=CENTERS).df.groupBy("patch").count().toPandas()["count"]) == 200
    with pytest.raises(InconsistentPatchesError, match="contiguous"):
        Catalog(ref.df.where("patch <> 1")).meta  # noqa: B018
    with pytest.raises(ValueError, match="either"):
        Catalog.from_random(spark, 5, patch_centers=ref)


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    spots = [(0.2, 0.1), (1.5, -0.5), (6.2, 0.9)]
    rows = [(float(a + x), float(d + y)) for a, d in spots for x, y in rng.normal(scale=0.01, size=(50, 2))]
    df = spark.createDataFrame(rows, "ra double, de double").selectExpr("cos(ra)*cos(de) x", "sin(ra)*cos(de) y", "sin(de) z3", "1.0D w")
    got = patches.kmeans_centers(df, 3)
    assert sorted(min(range(3), key=lambda k: angle(c, spots[k])) for c in got) == [0, 1, 2] and all(min(angle(c, s) for s in spots) < 0.01 for c in got)


def test_cosmology_against_integrals():
    for name, model in cosmology.COSMOLOGIES.items():
        one = cosmology.named(name)
        h, om = one.h0, one.om0
        for z in (0.1, 1.0, 3.0):
            x = np.linspace(0, z, 200_001)
            f = 1 / np.sqrt(om * (1 + x) ** 3 + 1 - om)
            d = 299792.458 / h * float(((f[1:] + f[:-1]) / 2 * np.diff(x)).sum())
            assert math.isclose(float(one.comoving_distance(z)), d, rel_tol=2e-3), (name, z, model)
            assert math.isclose(float(one.angular_diameter_distance(z)), float(one.comoving_distance(z)) / (1 + z), rel_tol=1e-12)
    assert math.isclose(cosmology.angles([(60, 120)], "arcmin", 0.5)[0][1], math.radians(2))
    d = float(cosmology.named(None).comoving_distance(0.5))
    assert math.isclose(cosmology.angles([(1, 2)], "Mpc", 0.5)[0][0], 1.5 / d) and math.isclose(cosmology.angles([(100, 200)], "kpc", 0.5)[0][0], 0.15 / d)


def test_bin_methods():
    for method in ("linear", "logspace", "comoving"):
        b = cosmology.binning(0.1, 1.1, 5, method)
        assert len(b) == 5 and math.isclose(b.edges[0], 0.1, abs_tol=1e-9) and math.isclose(b.edges[-1], 1.1, abs_tol=1e-9)
        steps = {"linear": lambda z: z, "logspace": math.log1p, "comoving": lambda z: float(cosmology.named(None).comoving_distance(z))}[method]
        gaps = np.diff([steps(e) for e in b.edges])
        assert np.allclose(gaps, gaps[0], rtol=1e-5)


def test_plots_need_matplotlib(samples):
    edges, y, error = plots.values(m.HistData.from_catalog(samples["ref"], config()))
    assert len(edges) == 4 and len(y) == len(error) == 3
    with pytest.raises(ValueError, match="style"):
        plots.plot(None, None, "bars")


@pytest.mark.parametrize("name", ["agg_normalised", "agg_covariance", "agg_errors", "agg_correlation", "nz_estimate"])
def test_plans_name_counts_once(spark, name):
    """No step of the chain joins its input with itself: a matrix of correlations reads its catalogs as often as the counts and weights that it is made of."""
    from skyloom.plans import queries

    sf = "/root/testdata/sf0.001"
    reads = lambda df: df._jdf.queryExecution().analyzed().toString().count("parquet")
    counts, weights, _ = queries.cross(spark, sf)
    assert reads(queries.QUERIES[name](spark, sf)) == reads(counts) + reads(weights)


def test_correlation_matrix_without_errors(spark):
    """Bins without a variance have no row, undefined ones no value."""
    cov = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0), (0, 2, 1.0), (3, 3, None), (0, 3, 1.0), (3, 0, 0.0)], "zbin_i int, zbin_j int, cov double")
    got = {(r.zbin_i, r.zbin_j): r.corr for r in resample.correlation_matrix(cov).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 1.0, (3, 3): None, (0, 3): None, (3, 0): 0.0}
