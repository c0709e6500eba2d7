import math

import numpy as np
import pytest

from skyloom.config import ConfigError, Configuration
from skyloom.functions import healpix as hp
from skyloom.functions.bins import Binning
from skyloom.operators import results
from skyloom.randoms import box, frame, healpix
from skyloom.sources import catalogs, textio


def fits_file(path, n=2500):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    pad = lambda b, fill: b + fill * (-len(b) % 2880)
    head = lambda cards: pad("".join(cards + ["END".ljust(80)]).encode(), b" ")
    kind = np.dtype([("RA", ">f8"), ("n", ">i4"), ("name", "S5"), ("f", ">f4", 2), ("s", ">i2"), ("ok", "S1")])
    rows = np.zeros(n, kind)
    rows["RA"], rows["n"], rows["name"], rows["s"], rows["ok"] = np.arange(n) / 7, np.arange(n), b"ab", np.arange(n) % 5, b"T"
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", kind.itemsize), card("NAXIS2", n), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 6)]
    for k, (name, form) in enumerate([("RA", "D"), ("n", "1J"), ("name", "5A"), ("f", "2E"), ("s", "I"), ("ok", "L")], 1):
        cards += [card(f"TTYPE{k}", f"'{name}'"), card(f"TFORM{k}", f"'{form}'")]
    cards += [card("TSCAL5", 0.5), card("TZERO5", 10)]
    path.write_bytes(head([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + head(cards) + pad(rows.tobytes(), b"\0"))


@pytest.mark.parametrize("n", [0, 2500])
def test_fits(spark, tmp_path, n):
    path = tmp_path / "a.fits"
    fits_file(path, n)
    df = catalogs.opened(spark, str(path))
    assert df.dtypes == [("RA", "double"), ("n", "int"), ("name", "string"), ("s", "double"), ("ok", "boolean")]
    got = df.orderBy("n").collect()
    assert [tuple(r) for r in got] == [(k / 7, k, "ab", 10 + k % 5 / 2, True) for k in range(n)]
    assert catalogs.opened(spark, str(path), columns=["n", "RA"], rows=1000).dtypes == [("RA", "double"), ("n", "int")]
    split = spark.read.format("skyfits").option("rows", 1000).load(str(path))
    assert split.rdd.getNumPartitions() == max(1, -(-n // 1000)) and split.count() == n


def test_fits_integers():
    from skyloom.sources.fits import FitsReader, fields, spark_type

    head = {"XTENSION": "BINTABLE", "TFIELDS": 4, "TFORM1": "K", "TZERO1": 2**63, "TFORM2": "I", "TNULL2": -1, "TFORM3": "I", "TZERO3": 32768, "TNULL3": 7, "TFORM4": "J", "TSCAL4": 2.0, "TNULL4": 3}
    own = fields(head)
    assert [spark_type(f) for f in own] == ["decimal(20,0)", "short", "int", "double"] and [f[0] for f in fields(head, ["col2"])] == ["col2"]
    values = ([-(2**63), 2**63 - 1], [-1, 5], [7, 8], [3, 4])
    got = [FitsReader.column(np.array(v, ">i8" if k == 0 else ">i4" if k == 3 else ">i2"), f).to_pylist() for k, (v, f) in enumerate(zip(values, own))]
    assert got == [[0, 2**64 - 1], [None, 5], [None, 32776], [None, 8.0]]


def test_text_round_trip(spark, tmp_path):
    rows = [(b, s, float(b * 3 + s) ** 2 / 7 if (b, s) != (1, 2) else None) for b in range(3) for s in range(-1, 4)]
    data = spark.createDataFrame(rows, "zbin int, sample int, value double")
    for closed in ("left", "right"):
        textio.write(data, Binning((0.1, 0.2, 0.4, 0.9), closed), str(tmp_path / "r"))
        binning, again = textio.read(spark, str(tmp_path / "r"))
        assert binning == Binning((0.1, 0.2, 0.4, 0.9), closed)
        got = {(r.zbin, r.sample): r.value for r in again.collect()}
        assert all(got[b, s] is None if v is None else abs(got[b, s] - v) < 1e-5 for b, s, v in rows)
    assert textio.read_covariance(str(tmp_path / "r")).shape == (3, 3)


def test_numbers_as_text():
    assert [textio.number(v) for v in (0.15, -1.5, None, 123456789012.5)] == [" 0.1500000", "-1.5000000", "       nan", " 123456789012"]


def brute_center(pixel, order):
    """By walking down the quadrants: position in the base pixel, then the ring formulas."""
    side, x, y = 1 << order, 0, 0
    for k in range(order):
        q = pixel >> (2 * k) & 3
        x, y = x | (q & 1) << k, y | (q >> 1) << k
    face = pixel >> (2 * order)
    ring = hp.RING[face] * side - x - y - 1
    n = min(ring, 4 * side - ring, side)
    z = 1 - n * n / (3 * side**2) if n < side else 2 * (2 * side - ring) / (3 * side)
    z = -abs(z) if ring > 2 * side else z
    return (hp.LONGITUDE[face] * n + x - y) * math.pi / 4 / n % (2 * math.pi), math.asin(z)


@pytest.mark.parametrize("order", [0, 1, 4])
def test_healpix_centers(spark, order):
    n = 12 * 4**order
    got = spark.range(n).select("id", *[c.alias(k) for c, k in zip(hp.center(__import__("pyspark").sql.functions.col("id"), order), ("ra", "dec"))]).collect()
    for r in got:
        ra, dec = brute_center(r.id, order)
        assert math.isclose(r.ra, ra, abs_tol=1e-12) and math.isclose(r.dec, dec, abs_tol=1e-12)


def test_healpix_randoms(spark):
    mask = spark.createDataFrame([(0, 1.0), (5, 0.0), (7, 3.0)], "pixel long, weight double")
    rows = healpix(spark, mask, 0, 4000, 1).collect()
    assert sorted(r.id for r in rows) == list(range(4000))
    north = [r for r in rows if r.dec >= 0 and r.ra <= math.pi / 2 + 1e-9]
    assert 850 < len(north) < 1150
    assert all(abs(r.ra - 1.5 * math.pi) < math.pi / 4 + 1e-9 for r in rows if r not in north)
    with pytest.raises(ValueError, match="positive"):
        healpix(spark, mask.where("pixel = 5"), 0, 10)


def test_randoms_as_frame(spark):
    points = box(spark, 100, 0.1, 0.2, -0.3, 0.3, observed=spark.createDataFrame([(0.5, 2.0), (0.6, 3.0)], "z double, w double"))
    got, raw = frame(points), frame(points, degrees=False)
    assert list(got.columns) == ["ra", "dec", "z", "w"] and len(got) == 100 and got.ra.between(math.degrees(0.1), math.degrees(0.2)).all()
    assert np.allclose(sorted(np.radians(got.dec)), sorted(raw.dec)) and {(z, w) for z, w in zip(got.z, got.w)} == {(0.5, 2.0), (0.6, 3.0)}


def test_probe(spark):
    for n, m in ((1, 1), (10, 10), (10, 3), (1000, 37), (5, 2), (5, 0)):
        got = [r.id for r in results.probe(spark.range(n).repartition(5), "id", m).orderBy("id").collect()]
        assert got == [k * (n - 1) // max(1, m - 1) for k in range(m)]
    with pytest.raises(ValueError):
        results.probe(spark.range(3), "id", 4)


def test_comparisons(spark):
    a = spark.createDataFrame([(0, -1, math.nan), (0, 0, 1.0)], "zbin int, sample int, value double")
    assert results.same(a, a.repartition(2)) and not results.same(a, results.combined(a, a))
    results.check_compatible(a, a)
    with pytest.raises(ValueError, match="samples"):
        results.check_compatible(a, a.where("sample < 0"))
    assert [r.value for r in results.combined(a, a, -1).where("sample = 0").collect()] == [0.0]


def test_configuration(tmp_path):
    c = Configuration.create(rmin=[100, 500], rmax=[1000, 1500], zmin=0.15, zmax=0.7, num_bins=11)
    path = str(tmp_path / "c.yml")
    c.to_file(path)
    assert Configuration.from_file(path) == c
    assert len(c.limits.by_bin) == 11 and len(c.limits.by_bin[0]) == 2
    assert c.modify(num_bins=5, unit="Mpc", rmin=1, rmax=2).limits.by_bin[0][0][0] > c.limits.by_bin[0][0][0]
    assert c.modify(edges=[0.1, 0.2]).binning.method == "custom"
    for bad, path in (
        ({"scales": {"rmin": 1, "rmax": 2}}, "binning"), ({"scales": {"rmin": 1}, "binning": {}}, "scales.rmax"), ({"scales": {"rmin": 3, "rmax": 2}, "binning": {}}, "scales.rmin"),
        ({"scales": {"rmin": 1, "rmax": 2, "x": 0}, "binning": {}}, "scales.x"), ({"scales": {"rmin": 1, "rmax": 2}, "binning": {"zmin": 0.1}}, "binning.edges"),
        ({"scales": {"rmin": 1, "rmax": 2, "unit": "m"}, "binning": {"edges": [0, 1]}}, "scales.unit"), ({"scales": {"rmin": 1, "rmax": 2}, "binning": {"edges": [0, 1]}, "cosmology": "none"}, "cosmology"),
    ):
        with pytest.raises(ConfigError) as e:
            Configuration.from_dict(bad)
        assert e.value.path == path
