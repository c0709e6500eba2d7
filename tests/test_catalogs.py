import math

import pytest

from skyloom.sources import catalogs

ROWS = [(10.0, -1.0, 2.0, 0.3, 0), (11.0, 1.0, 1.0, 0.4, 5), (14.0, 0.0, 0.5, 0.5, 5)]
NAMES = "RA double, Dec double, wei double, red double, part int"


def test_suffix(spark):
    with pytest.raises(ValueError, match="unsupported"):
        catalogs.opened(spark, "a.txt")


def test_patches_from_column_round_trip(spark, tmp_path):
    path = str(tmp_path / "cat")
    made = catalogs.catalog(spark.createDataFrame(ROWS, NAMES), "RA", "Dec", weight="wei", redshift="red", patch_name="part")
    got = catalogs.written(made, path).orderBy("ra").collect()
    assert [r.patch for r in got] == [0, 5, 5]
    assert [r.w for r in got] == [2.0, 1.0, 0.5]
    assert all(math.isclose(r.ra, math.radians(s[0])) and math.isclose(r.z3, math.sin(math.radians(s[1])), abs_tol=1e-15) for r, s in zip(got, ROWS))
    with pytest.raises(Exception, match="(?i)exists"):
        catalogs.written(made, path)
    assert catalogs.written(made, path, overwrite=True).count() == 3


def test_centers_come_before_the_column(spark):
    centers = [(math.radians(14), 0.0), (math.radians(10), 0.0)]
    got = catalogs.catalog(spark.createDataFrame(ROWS, NAMES), "RA", "Dec", patch_centers=centers, patch_name="part").orderBy("ra").collect()
    assert [(r.patch, r.w) for r in got] == [(1, 1.0), (1, 1.0), (0, 1.0)]


def test_errors(spark):
    df = spark.createDataFrame(ROWS, NAMES)
    with pytest.raises(ValueError, match="required"):
        catalogs.catalog(df, "RA", "Dec")
    with pytest.raises(ValueError, match="not found: none"):
        catalogs.catalog(df, "RA", "none", patch_name="part")
    for bad in (None, math.nan, math.inf):
        with pytest.raises(Exception, match="not finite"):
            catalogs.points(spark.createDataFrame([(1.0, bad)], "a double, b double"), "a", "b").collect()
    for bad in (-1, 32768):
        with pytest.raises(Exception, match="out of range"):
            catalogs.catalog(spark.createDataFrame([(1.0, 1.0, bad)], "a double, b double, p int"), "a", "b", patch_name="p").collect()
    assert catalogs.catalog(df.limit(0), "RA", "Dec", patch_name="part").count() == 0
