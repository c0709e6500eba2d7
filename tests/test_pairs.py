import math

import numpy as np
import pytest

from skyloom.operators import pairs, patches

LIMITS = pairs.Limits((((0.002, 0.02), (0.01, 0.05)), ((0.001, 0.03), (0.02, 0.03))))


def points(n, seed, bins, patches, copies=1):
    """x, y, z3, zbin, patch, v and number of points in a small field, each as often as ``copies``."""
    rng = np.random.default_rng(seed)
    ra, de = rng.uniform(0.2, 0.26, n), rng.uniform(-0.03, 0.03, n)
    at = np.column_stack([np.cos(ra) * np.cos(de), np.sin(ra) * np.cos(de), np.sin(de), rng.integers(0, bins, n), rng.integers(0, patches, n)])
    at = np.repeat(at, copies, axis=0)
    return np.column_stack([at, rng.integers(1, 9, len(at)), np.ones(len(at))])


def all_pairs(a, b, power=None):
    """Every pair's distance is made."""
    d2 = sum((a[:, None, c] - b[None, :, c]) ** 2 for c in range(3))
    fine, out = pairs.Fine(power, 5).tables(LIMITS) if power else None, {}
    for (k, s), (lo, hi) in {(k, s): limits for k, x in enumerate(LIMITS.chords2) for s, limits in enumerate(x)}.items():
        hit = (d2 > lo) & (d2 <= hi) & (a[:, 3] == k)[:, None]
        w = fine[k, s][1][np.searchsorted(fine[k, s][0], d2)] * hit if fine else hit
        for i in np.unique(a[:, 4]):
            for j in np.unique(b[:, 4]):
                own = np.ix_(a[:, 4] == i, b[:, 4] == j)
                if hit[own].any():
                    v = a[a[:, 4] == i, 5] @ w[own] @ b[b[:, 4] == j, 5]
                    out[s, k, int(i), int(j)] = (float(v), int(hit[own].sum()))
    return out


def tallied(a, b, power=None):
    into = {}
    pairs.tally(*(pairs.tiled(pairs.merged(x)) for x in (a, b)), LIMITS.chords2, pairs.Fine(power, 5).tables(LIMITS) if power else None, into)
    return {k: (float(v[0]), int(v[1])) for k, v in into.items()}


@pytest.mark.parametrize("n, m, patches, copies", [(2000, 3000, 3, 1), (300, 200, 2, 7), (1, 1, 1, 1), (40, 500, 150, 2)])
def test_leaves_count_all_pairs(n, m, patches, copies):
    a, b = points(n, 1, 2, patches, copies), points(m, 2, 1, patches, copies)
    assert tallied(a, b) == all_pairs(a, b)
    got, want = tallied(a, b, -1.0), all_pairs(a, b, -1.0)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], rel_tol=1e-9) for k in want)


def test_limits_at_distances_of_points():
    """Distances that equal a limit are inside above and outside below, also where bounds of leaves equal it."""
    a, b = points(200, 1, 1, 1), points(300, 2, 1, 1)
    d2 = np.sort(sum((a[:, None, c] - b[None, :, c]) ** 2 for c in range(3)).ravel())
    one = pairs.tiled(a[:1])
    for lo, hi in ((d2[100], d2[50_000]), (d2[0], d2[-1])):
        into = {}
        pairs.tally(pairs.tiled(a), pairs.tiled(b), np.array([[[lo, hi]]]), None, into)
        assert int(into[0, 0, 0, 0][1]) == int(((d2 > lo) & (d2 <= hi)).sum())
    other = pairs.tiled(b[:1])
    (d,) = sum((one[:, c] - other[:, c]) ** 2 for c in range(3))
    for limits, n in (((0.0, d), 1), ((d, 1.0), 0)):
        into = {}
        pairs.tally(one, other, np.array([[limits]]), None, into)
        assert sum(v[1] for v in into.values()) == n


def test_most_pairs_are_not_compared(monkeypatch):
    """Large tables: leaves that lie wholly inside or outside an annulus compare no points, and copies of a point are one."""
    seen = []
    whole = pairs.compared
    monkeypatch.setattr(pairs, "compared", lambda left, right, i, *more: seen.append(len(i)) or whole(left, right, i, *more))
    a, b = points(4000, 1, 1, 1, 4), points(4000, 2, 1, 1, 4)
    into = {}
    pairs.tally(*(pairs.tiled(pairs.merged(x)) for x in (a, b)), pairs.Limits((((0.002, 0.02),),)).chords2, None, into)
    assert sum(seen) * pairs.LEAF**2 < len(a) * len(b) / 40
    assert sum(v[1] for v in into.values()) > len(a) * len(b) / 10


def test_distances_to_centers_as_columns(spark):
    """Both forms of the nearest centre agree, ties and undefined positions included; the one of columns is never null, so no join on patches filters by it."""
    centers = [(0.1 * (k % 3), 0.1 * (k // 3)) for k in range(9)]
    rows = [(math.cos(a) * math.cos(d), math.sin(a) * math.cos(d), math.sin(d)) for a, d in [*centers, *((0.013 * k, 0.05) for k in range(20)), (0.05, 0.0), (0.1, 0.05)]] + [(None, 0.0, 1.0), (math.nan, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z3 double").coalesce(1)
    slow, fast = (patches.assign(df, centers, direct) for direct in (False, True))
    assert [r.patch for r in slow.collect()] == [r.patch for r in fast.collect()]
    assert not fast.schema["patch"].nullable


def test_single_precision_decides_no_pair_near_a_limit():
    """Points far from the origin of their blocks, limits at distances that single precision can't tell apart, and copies of a point."""
    a, b = points(300, 1, 1, 1), points(400, 2, 1, 1)
    b[:50, :3] = a[:50, :3]
    d2 = sum((a[:, None, c] - b[None, :, c]) ** 2 for c in range(3))
    left, right = (pairs.Leaves(pairs.tiled(x)) for x in (a, b))
    rough = pairs.Rough(left, right)
    some = np.sort(d2.ravel())
    x, y = (v.ravel() for v in np.indices((len(left), len(right))))
    for limit in (0.0, some[0], some[60], some[1000], np.nextafter(some[1000], 0), some[50_000], np.nextafter(some[50_000], 1), some[-1]):
        inside = rough.within(x, y, *rough.distances(x, y), np.full(len(x), limit))
        hit = inside * left.values[x][:, :, None, -1] * right.values[y][:, None, :, -1]
        assert hit.sum() == (d2 <= limit).sum()


def test_few_distances_are_made_in_double_precision(monkeypatch):
    seen = []
    whole = pairs.squared
    monkeypatch.setattr(pairs, "squared", lambda a, b: seen.append(np.broadcast(a[0], b[0]).size) or whole(a, b))
    a, b = points(4000, 1, 1, 1), points(4000, 2, 1, 1)
    pairs.tally(*(pairs.tiled(x) for x in (a, b)), pairs.Limits((((0.002, 0.02),),)).chords2, None, {})
    assert sum(seen) < len(a) * len(b) / 100


@pytest.mark.parametrize("n, m, patches, copies", [(3000, 4000, 3, 1), (900, 2000, 2, 5), (5000, 150, 1, 1)])
def test_strips_count_all_pairs(n, m, patches, copies):
    """Also with points in clusters, at equal positions, and at limits that are distances."""
    a, b = points(n, 1, 2, patches, copies), points(m, 2, 1, patches, copies)
    k = min(len(a), len(b)) // 3
    b[:k, :3] = a[:k, :3]
    into = {}
    assert pairs.stripped(pairs.tiled(a), b, LIMITS.chords2, into)
    assert {k: (float(v[0]), int(v[1])) for k, v in into.items()} == all_pairs(a, b)
    d2 = np.sort(sum((a[:200, None, c] - b[None, :, c]) ** 2 for c in range(3)).ravel())
    for lo, hi in ((d2[50], d2[-1]), (0.0, d2[len(d2) // 2]), (np.nextafter(d2[1000], 0), d2[len(d2) // 3])):
        into, own = {}, a[(a[:, 3] == 0) & (a[:, 4] == 0)]
        assert pairs.stripped(pairs.tiled(own), b, np.array([[[lo, hi]]]), into)
        far = sum((own[:, None, c] - b[None, :, c]) ** 2 for c in range(3))
        assert sum(int(v[1]) for v in into.values()) == int(((far > lo) & (far <= hi)).sum())


def test_wide_fields_and_undefined_positions_are_counted_by_leaves():
    rng = np.random.default_rng(3)
    ra, z = rng.uniform(0, 2 * np.pi, 900), rng.uniform(-1, 1, 900)
    at = np.column_stack([np.sqrt(1 - z * z) * np.cos(ra), np.sqrt(1 - z * z) * np.sin(ra), z, np.zeros(900), np.zeros(900), rng.integers(1, 9, 900), np.ones(900)])
    limits, into = np.array([[[0.01, 1.5]]]), {}
    d2 = sum((at[:, None, c] - at[None, :, c]) ** 2 for c in range(3))
    assert not pairs.stripped(pairs.tiled(at), at, limits, {})
    lost = np.concatenate([at, at[:1]])
    lost[-1, 0] = np.nan
    pairs.tally(pairs.tiled(lost), pairs.tiled(at), limits, None, into)
    assert int(into[0, 0, 0, 0][1]) == int(((d2 > 0.01) & (d2 <= 1.5)).sum())


def test_a_block_meets_all_blocks_of_its_cell_at_once(monkeypatch):
    a, parts, seen, into = points(2000, 1, 2, 1), [points(1000, k, 1, 1) for k in (2, 3, 4)], [], {}
    whole = pairs.stripped
    monkeypatch.setattr(pairs, "stripped", lambda a, b, *more: seen.append(len(b)) or whole(a, b, *more))
    pairs.tallied(pairs.tiled(a), parts, LIMITS.chords2, None, into)
    assert seen == [3000]
    assert {k: (float(v[0]), int(v[1])) for k, v in into.items()} == all_pairs(a, np.concatenate(parts))


def test_points_are_sorted_by_one_number(spark):
    """Spark sorts rows by several columns by comparing rows, and by one number without."""
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0, 0, 1.0)], "x double, y double, z3 double, zbin int, patch int, v double")
    plan = pairs.blocks(df, LIMITS, True, ["v"], False)._jdf.queryExecution().executedPlan().toString()
    (keys,) = [line.split("Sort [")[1].split("]")[0] for line in plan.splitlines() if "Sort [" in line]
    assert "," not in keys


def test_points_and_rows_leave_few_pairs_to_compare(monkeypatch):
    """Leaves of neighbours that are as wide as a circle leave nearly all pairs near it; a point and a row leave few, whatever bins and patches."""
    seen, into = [], {}
    whole = pairs.Field.within
    monkeypatch.setattr(pairs.Field, "within", lambda self, u, v, at, i, j, *more: seen.append(len(j)) or whole(self, u, v, at, i, j, *more))
    a, b = points(3000, 1, 2, 2), points(30_000, 2, 1, 2)
    b[:, 4] = b[:, 4] * 7 - 3
    assert pairs.stripped(pairs.tiled(a), b, LIMITS.chords2, into)
    assert {k: (float(v[0]), int(v[1])) for k, v in into.items()} == all_pairs(a, b)
    assert sum(seen) < len(a) * len(b) / 25


def test_a_value_that_is_not_finite_stays_with_its_pairs():
    a, b = points(2000, 1, 1, 1), points(3000, 2, 1, 3)
    b[np.flatnonzero(b[:, 4] == 1)[0], 5] = np.inf
    into = {}
    pairs.tally(pairs.tiled(a), pairs.tiled(b), LIMITS.chords2, None, into)
    want = all_pairs(a, b[np.isfinite(b[:, 5])])
    assert {k: float(v[0]) for k, v in into.items() if k[3] != 1} == {k: v[0] for k, v in want.items() if k[3] != 1}


def test_blocks_and_centers_are_few_calls(spark, monkeypatch):
    """Expressions of many literals are parsed, not built call by call."""
    from pyspark.sql import functions as F

    made, whole = [], F.lit
    monkeypatch.setattr(F, "lit", lambda v: made.append(v) or whole(v))
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0, 1.0)], "x double, y double, z3 double, zbin int, v double")
    (row,) = pairs.blocks(patches.assign(df, [(0.1 * k, 0.0) for k in range(9)], True), LIMITS, True, ["v"], False).collect()
    assert np.frombuffer(row.pts).tolist() == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    assert len(made) < 9
