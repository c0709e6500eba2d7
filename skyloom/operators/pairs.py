"""Weighted pair counts by a distance join on cells.

Points are put into cubic cells of the unit sphere's space, as wide as the
reach of the annuli, and packed into blocks of at most ``BLOCK`` points of one
cell.  A block of the second side is repeated into the cells that its bounding
box and the reach touch (and that the sphere goes through), so every pair
within reach meets exactly once in an equi-join of blocks by cell, and the pole
and the wrap in ra need no care.  Where both sides have redshift bins, the bin
is part of the cell, and cells are as wide as that bin's own reach.

A block is made of leaves: at most ``LEAF`` neighbours of one bin and patch.
Two leaves whose bounding boxes lie wholly inside an annulus give the product
of their sums, two that lie wholly outside give nothing, and only between the
others are points compared.  Bounds are made of the same rounded operations in
the same order as distances, which are monotonic, so no bound contradicts a
distance.  Most points of such leaves are told apart by products of single
precision, with a bound of their error; the distance itself is made of those
that are too near to a limit for that.  Points of one bin and patch at the very same position are one point
with the sums of their values and their number.

Where the field of a block is nearly flat and groups of bin and patch are large
(``stripped``), a block meets all blocks of its cell at once, and their points
lie in rows of small pixels: a point and a row tell where pixels begin and end
to be inside a circle, all points between are met, and only points of the
pixels that it cuts are compared.  How often a point is met is summed up along
the rows, for all patches at once.  An annulus is one circle less another.

Rows of pairs never exist, in no shuffle and in no engine row.  A pair of
blocks gives sums by (zbin, p1, p2), and only those leave a task.  (The same
join as plain columns, one row for each candidate pair, took 15 times as long
for the four counts of the benchmark as whole matrices of distances did.)

A cell with very many points is many blocks: points are dealt to tasks by
ranges of (cell, place in it, hash), so such a cell is cut as well, its blocks
are compact, and its pairs of blocks are rows like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTION = 50
BLOCK = 16_384
LEAF = 32
#: Pairs of leaves whose bounds are made at once, and of which points are compared at once.
TILE, CHUNK = 500_000, 64
#: Error of a squared distance in single precision, as a part of the square of both points' sum of distances from the origin, and a least one.
ROUGH, LEAST = 2.0**-20, 1e-36
#: Patches of a block's second side whose sums are made at once.
WIDE = 64
#: Steps of a cell's side that order its points, and their numbers with the bits two apart.
STEPS = 64
SPREAD = [sum((i >> b & 1) << 3 * b for b in range(6)) for i in range(STEPS)]
KEY = ("kz", "cx", "cy", "cz")
SLACK = 1 + 1e-9
#: Points of the second side that a block meets at once.
MET = 8 * BLOCK
#: Points for each square of a row's height, and for each pixel; (point, row)s looked at at once; the most pixels in a row.
FILL, THIN, PIECE, WIDEST = 1.0, 0.25, 16_384, 2048
#: More than the error of a coordinate in another frame, and of a distance; the least extent of a field.
NEAR, TINY = 1e-13, 1e-12
#: The most that a field may bulge, as a part of the reach, and the least number of pairs for each two groups, for counts by strips.
FLAT, LARGE = 0.125, 16_384


@dataclass(frozen=True)
class Limits:
    """Annuli (min, max] in radians: ``by_bin[zbin][scale]``."""

    by_bin: tuple[tuple[tuple[float, float], ...], ...]

    def __post_init__(self):
        for scales in self.by_bin:
            for lo, hi in scales:
                if not 0 <= lo < hi <= np.pi:
                    raise ValueError("angular limits must be increasing and within [0, pi]")

    @property
    def reaches(self) -> list[float]:
        """Largest chord of each bin."""
        return [max(2 * np.sin(hi / 2) for _, hi in scales) for scales in self.by_bin]

    @property
    def reach(self) -> float:
        """Largest chord."""
        return max(self.reaches)

    @property
    def widest(self) -> float:
        """Largest angle."""
        return max(hi for scales in self.by_bin for _, hi in scales)

    @property
    def chords2(self) -> np.ndarray:
        """Squared chords by (zbin, scale, side)."""
        return np.array([[[(2 * np.sin(v / 2)) ** 2 for v in s] for s in scales] for scales in self.by_bin])

    @property
    def num_scales(self) -> int:
        return len(self.by_bin[0])


@dataclass(frozen=True)
class Fine:
    """Separation weights: within a scale, pairs in ``resolution`` logarithmic bins weigh the bin's logarithmic middle to ``power``, over the sum of all bins'."""

    power: float
    resolution: int = RESOLUTION

    def tables(self, limits: Limits) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Squared chords of the edges and weights by (zbin, scale); the first and the last weight are of what is outside."""
        out = {}
        for k, scales in enumerate(limits.by_bin):
            for s, (lo, hi) in enumerate(scales):
                if lo <= 0:
                    raise ValueError("a separation weight needs a minimum separation above 0")
                edges = np.exp(np.linspace(np.log(lo), np.log(hi), self.resolution + 1))
                edges[0], edges[-1] = lo, hi
                mids = np.sqrt(edges[1:] * edges[:-1]) ** self.power
                out[k, s] = (2 * np.sin(edges / 2)) ** 2, np.concatenate([[0.0], mids / mids.sum(), [0.0]])
        return out


def touched(low: np.ndarray, high: np.ndarray, width: float, reach: float) -> list[tuple[int, int, int]]:
    """Cells within reach of a box that the unit sphere goes through."""
    a, b = np.floor((low - reach * SLACK) / width).astype(int), np.floor((high + reach * SLACK) / width).astype(int)
    axes = [np.arange(x, y + 1) for x, y in zip(a, b)]
    near, far = [], []
    for x in axes:
        lo, hi = np.abs(x * width), np.abs((x + 1) * width)
        near.append(np.where((x < 0) == (x + 1 <= 0), np.minimum(lo, hi), 0.0) ** 2)
        far.append(np.maximum(lo, hi) ** 2)
    grid = lambda v: v[0][:, None, None] + v[1][None, :, None] + v[2][None, None, :]
    some = (grid(near) <= SLACK) & (grid(far) >= 2 - SLACK)
    return [(int(axes[0][i]), int(axes[1][j]), int(axes[2][k])) for i, j, k in np.argwhere(some)]


def merged(own: np.ndarray) -> np.ndarray:
    """Points (x, y, z3, zbin, patch, sums) with those of the same position, bin and patch as one."""
    own = own[np.argsort(own[:, 0], kind="stable")]
    if not (own[1:, 0] == own[:-1, 0]).any():
        return own
    own = own[np.lexsort(own[:, 4::-1].T)]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:, :5] != own[:-1, :5]).any(1)]))
    return np.hstack([own[starts, :5], np.add.reduceat(own[:, 5:], starts)])


def tiled(own: np.ndarray) -> np.ndarray:
    """Points by zbin and patch, and within those in tiles of ``LEAF`` neighbours: strips of the widest axis, cut along the second."""
    own = own[np.lexsort((own[:, 4], own[:, 3]))]
    out = []
    for part in np.split(own, np.flatnonzero((own[1:, 3:5] != own[:-1, 3:5]).any(1)) + 1):
        n = len(part)
        if n > LEAF:
            _, second, first = np.argsort(np.ptp(part[:, :3], axis=0))
            strips = int(np.ceil(np.sqrt(n / LEAF)))
            long = int(np.ceil(n / LEAF / strips)) * LEAF
            part = part[np.argsort(part[:, first])]
            part = part[np.lexsort((part[:, second], np.arange(n) // long))]
        out.append(part)
    return np.concatenate(out)


def blocks(points: DataFrame, limits: Limits, aligned: bool, values: list[str], second: bool) -> DataFrame:
    """kz, cx, cy, cz and ``pts`` of each block: x, y, z3, zbin, patch, ``values`` and number of its points, in the order of ``tiled``."""
    reaches = limits.reaches if aligned else [limits.reach]
    binned = "zbin" in points.columns
    kz = "zbin" if aligned else "0"
    # as text, because building hundreds of columns takes longer than parsing them
    width, spread = f"array({', '.join(f'{float(r)!r}D' for r in reaches)})[{kz}]", f"array({', '.join(map(str, SPREAD))})"
    cells = [f"CAST(floor({p} / {width}) AS BIGINT) AS {c}" for c, p in zip(KEY[1:], ("x", "y", "z3"))]
    place = " + ".join(f"{spread}[CAST(pmod(floor({p} / {width} * {STEPS}), {STEPS}) AS INT)] * {1 << k}" for k, p in enumerate(("x", "y", "z3")))
    columns = ["x", "y", "z3", "zbin", "patch", *values]
    rows = points if binned else points.withColumn("zbin", F.lit(0))
    rows = rows.selectExpr(f"CAST({kz} AS INT) AS kz", *cells, f"{place} AS place", *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns])
    # one number, which Spark sorts without comparing rows; should two cells share one, their blocks are smaller
    rows = rows.selectExpr(*KEY, *columns, f"(xxhash64({', '.join(KEY)}) & {-STEPS**3}) | CAST(place AS BIGINT) AS `order`")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "order", F.xxhash64("x", "y", "z3")).sortWithinPartitions("order").select(*KEY, *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            own = tiled(merged(np.concatenate(held)))
            cells = [key[1:]]
            if second:
                w = reaches[key[0]]
                cells = touched(own[:, :3].min(0), own[:, :3].max(0), w, w)
            data = own.tobytes()
            keys = [[key[0]] * len(cells), *zip(*cells)]
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), *[pa.array(k, pa.int64()) for k in keys[1:]], pa.array([data] * len(cells), pa.binary())], [*KEY, "pts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            own = np.stack([*[batch.column(4 + k).to_numpy(zero_copy_only=False) for k in range(len(columns))], np.ones(len(keys))], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, e in zip(cuts, cuts[1:]):
                now = tuple(keys[a].tolist())
                if held and now != key:
                    yield flush()
                    held, size = [], 0
                key = now
                while a < e:
                    part = own[a : min(e, a + BLOCK - size)]
                    held.append(part)
                    size += len(part)
                    a += len(part)
                    if size == BLOCK:
                        held = [merged(np.concatenate(held))]
                        size = len(held[0])
                        if size > BLOCK // 2:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(pack, "kz int, cx bigint, cy bigint, cz bigint, pts binary")


class Index:
    """Blocks of a sample, the same tables for all counts it takes part in: a plan with several counts makes and shuffles them once."""

    def __init__(self, points: DataFrame, limits: Limits, aligned: bool, values: list[str]):
        self.points, self.limits, self.aligned, self.values = points, limits, aligned, values

    @cached_property
    def first(self) -> DataFrame:
        return blocks(self.points, self.limits, self.aligned, self.values, False)

    @cached_property
    def second(self) -> DataFrame:
        return blocks(self.points, self.limits, self.aligned, self.values, True)


class Leaves:
    """Leaves of a block: positions by (axis, leaf, point), and values, bounds, sums, zbin and patch; short leaves repeat a point without value."""

    def __init__(self, own: np.ndarray):
        cuts = np.concatenate([[0], np.flatnonzero((own[1:, 3:5] != own[:-1, 3:5]).any(1)) + 1, [len(own)]])
        number = -(-np.diff(cuts) // LEAF)
        before = np.repeat(np.cumsum(number) - number, number)
        starts = np.repeat(cuts[:-1], number) + LEAF * (np.arange(number.sum()) - before)
        ends = np.minimum(starts + LEAF, np.repeat(cuts[1:], number))
        at = starts[:, None] + np.arange(LEAF)
        real = at < ends[:, None]
        full = own[np.minimum(at, ends[:, None] - 1)]
        self.at = np.ascontiguousarray(full[:, :, :3].transpose(2, 0, 1))
        self.values = np.where(real[:, :, None], full[:, :, 5:], 0.0)
        self.low, self.high, self.sums = self.at.min(2), self.at.max(2), self.values.sum(1)
        self.zbin, self.patch = own[starts, 3].astype(int), own[starts, 4].astype(int)

    def __len__(self) -> int:
        return len(self.zbin)


def bounds(a: Leaves, b: Leaves, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared chord that points of each two leaves can have."""
    near, far = 0.0, 0.0
    for c in range(3):
        up = np.subtract.outer(a.high[c, rows], b.low[c, columns])
        down = np.subtract.outer(a.low[c, rows], b.high[c, columns])
        gap = np.maximum(np.maximum(down, -up), 0.0)
        gap *= gap
        near = near + gap
        up *= up
        down *= down
        far = far + np.maximum(up, down)
    return near, far


class Rough:
    """Squared distances of the points of two blocks' leaves in single precision: one product of two small matrices for two leaves."""

    def __init__(self, left: Leaves, right: Leaves):
        self.left, self.right = left, right
        origin = ((left.low.min(1) + left.high.max(1)) / 2)[:, None, None]
        (a, a2), (b, b2) = ((p, (p * p).sum(0)) for p in (left.at - origin, right.at - origin))
        one = np.ones
        self.a = np.stack([*a, a2, one(a2.shape)], 2).astype(np.float32)
        self.b = np.stack([*(-2 * b), one(b2.shape), b2], 1).astype(np.float32)
        self.reach_a, self.reach_b = (np.sqrt(v.max(1)) for v in (a2, b2))

    def distances(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of leaves x and y: squared distances and a bound of their error."""
        return self.a[x] @ self.b[y], ROUGH * (self.reach_a[x] + self.reach_b[y]) ** 2 + LEAST

    def within(self, x: np.ndarray, y: np.ndarray, d2: np.ndarray, error: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether points are at most ``limit`` apart, as the rounded operations of ``squared`` say."""
        error = error + ROUGH * limit
        low, high = ((limit + v).astype(np.float32)[:, None, None] for v in (-error, error))
        inside, near = d2 <= low, d2 <= high
        near ^= inside
        at = np.flatnonzero(near)
        if len(at):
            k, p, q = np.unravel_index(at, near.shape)
            a, b = self.left.at[:, x[k], p], self.right.at[:, y[k], q]
            inside[k, p, q] = squared(a, b) <= limit[k]
        return inside


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared chord of positions (axis, ...)."""
    d2 = a[0] - b[0]
    d2 *= d2
    for k in (1, 2):
        d = a[k] - b[k]
        d *= d
        d2 += d
    return d2


def compared(left: Leaves, right: Leaves, i: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray, outer: np.ndarray, inner: np.ndarray, rough: Rough) -> np.ndarray:
    """Sums by value, the number last, of the pairs of points of leaves i and j within (lo, hi]; ``outer`` and ``inner`` tell which of the limits cuts them."""
    out = np.empty((len(i), left.values.shape[2]))
    for upper, lower in ((True, False), (False, True), (True, True)):
        own = np.flatnonzero((outer == upper) & (inner == lower))
        for c in range(0, len(own), CHUNK):
            at = own[c : c + CHUNK]
            x, y = i[at], j[at]
            distances = rough.distances(x, y)
            hit = rough.within(x, y, *distances, hi[at]) if upper else None
            if lower:
                beyond = ~rough.within(x, y, *distances, lo[at])
                hit = beyond if hit is None else hit & beyond
            out[at] = (left.values[x] * (hit.astype(np.float64) @ right.values[y])).sum(1)
    return out


def weighed(left: Leaves, right: Leaves, i: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray, tables: dict) -> np.ndarray:
    """As ``compared`` with weights by separation, which need all distances."""
    out = np.empty((len(i), left.values.shape[2]))
    for c in range(0, len(i), CHUNK):
        x, y = i[c : c + CHUNK], j[c : c + CHUNK]
        d2 = squared(left.at[:, x][:, :, :, None], right.at[:, y][:, :, None, :])
        inside = (d2 > lo[c : c + CHUNK, None, None]) & (d2 <= hi[c : c + CHUNK, None, None])
        first, second, hit = left.values[x], right.values[y], inside.astype(np.float64)
        w = np.zeros_like(d2)
        for k in np.unique(left.zbin[x]):
            edges, weights = tables[k]
            own = inside & (left.zbin[x] == k)[:, None, None]
            w[own] = weights[np.searchsorted(edges, d2[own])]
        out[c : c + CHUNK, :-1] = (first[:, :, :-1] * (w @ second[:, :, :-1])).sum(1)
        out[c : c + CHUNK, -1] = (first[:, :, -1] * (hit @ second[:, :, -1:])[:, :, 0]).sum(1)
    return out


class Field:
    """Points in pixels of a plane, between ``low`` and ``high``: rows of the second axis, and each row in pixels of the first.

    Sums are made by how often each point is met: a run of points adds a weight where it begins and takes it off where it ends.
    """

    def __init__(self, own: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray):
        wide, tall = high - low
        self.rows = max(1, int(np.sqrt(len(own) * tall / wide / FILL)))
        height = tall / self.rows
        self.width = max(wide * self.rows * THIN / len(own), wide / WIDEST)
        #: All below is in widths of a pixel, from a corner outside.
        self.corner, self.height = low - 2 * np.array([self.width, height]), height / self.width
        self.columns = int(wide / self.width) + 6
        u, v = self.places(places)
        pixel = (v / self.height).astype(np.int64) * self.columns + u.astype(np.int64)
        order = np.argsort(pixel, kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(pixel, minlength=(self.rows + 5) * self.columns))])
        own = own[order]
        self.at, self.values, (self.patches, self.patch) = np.ascontiguousarray(own[:, :3].T), np.ascontiguousarray(own[:, 5:].T), np.unique(own[:, 4], return_inverse=True)
        self.u, self.v = u[order].astype(np.float32), v[order].astype(np.float32)
        #: More than the error of a place in single precision.
        self.slack = (self.columns + (self.rows + 5) * self.height) * ROUGH + NEAR / self.width

    def __len__(self) -> int:
        return len(self.u)

    def places(self, c: np.ndarray) -> np.ndarray:
        return (c - self.corner[:, None]) / self.width

    def discs(self, at: np.ndarray, values: np.ndarray, places: np.ndarray, limit: float, bulge: float) -> np.ndarray:
        """Sums of products by patch of these and value, over the pairs of a group's points and these that are at most a limit (squared) apart; ``bulge``: how far apart they can be along the third axis."""
        u, v = places
        radius, flat = np.sqrt(limit) / self.width, (bulge / self.width) ** 2
        outer, inner = radius + self.slack, max(radius - self.slack, 0.0)
        error = 4 * (radius + self.slack) * self.slack
        surely, perhaps = np.float32(limit / self.width**2 - flat - error), np.float32(limit / self.width**2 + error)
        first = np.floor((v - outer) / self.height).astype(np.int64)
        number = int(2 * outer / self.height) + 2
        middle = (v / self.height).astype(np.int64) - first
        begin, steps = (first * self.height - v).astype(np.float32), (np.arange(number + 1) * self.height).astype(np.float32)
        u, v, rows = u.astype(np.float32), v.astype(np.float32), np.arange(number) * self.columns
        runs, single = np.zeros((len(values), len(self) + 1)), np.zeros((len(values), len(self)))
        step = max(1, PIECE // number)
        for c in range(0, len(u), step):
            own = slice(c, c + step)
            n, x = len(u[own]), u[own, None]
            y2 = np.add.outer(begin[own], steps)
            y2 *= y2
            reach, sure = rooted(np.float32(outer * outer) - y2), rooted(np.float32(inner * inner - flat) - y2)
            reach, sure = np.maximum(reach[:, 1:], reach[:, :-1]), np.minimum(sure[:, 1:], sure[:, :-1])
            reach[np.arange(n), middle[own]] = outer
            row = np.add.outer(first[own] * self.columns, rows)
            # a row's pixels between b and d are inside, those from a to b and from d to e are compared, and the others are outside
            a, b, d, e = (self.begin.take(p.astype(np.int64) + row) for p in (x - reach, (x + 1) - sure, x + sure, (x + 1) + reach))
            np.maximum(d, b, out=d)
            for k, w in enumerate(values[:, own]):
                w = np.repeat(w, number)
                np.add.at(runs[k], b.ravel(), w)
                np.subtract.at(runs[k], d.ravel(), w)
            starts, lengths = np.stack([a, d], 1), np.stack([b - a, e - d], 1)
            size, lengths = lengths.sum((1, 2)), lengths.ravel()
            j = np.repeat(starts.ravel() - (np.cumsum(lengths) - lengths), lengths)
            j += np.arange(len(j))
            i = np.repeat(np.arange(c, c + n), size)
            hit = np.flatnonzero(self.within(u, v, at, i, j, limit, surely, perhaps))
            i, j = i[hit], j[hit]
            for k, w in enumerate(values):
                np.add.at(single[k], j, w.take(i))
        single += np.cumsum(runs, 1)[:, :-1]
        return np.stack([np.bincount(self.patch, m * w) for m, w in zip(single, self.values)], 1)

    def within(self, u: np.ndarray, v: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, limit: float, surely: np.float32, perhaps: np.float32) -> np.ndarray:
        """Whether points i of a group and j of these are at most ``limit`` apart: told apart by places in single precision, and exactly between ``surely`` and ``perhaps``."""
        d2, dv = self.u.take(j), self.v.take(j)
        d2 -= u.take(i)
        dv -= v.take(i)
        d2 *= d2
        dv *= dv
        d2 += dv
        hit, near = d2 <= surely, d2 <= perhaps
        near ^= hit
        near = np.flatnonzero(near)
        if len(near):
            hit[near] = squared(at[:, i[near]], self.at[:, j[near]]) <= limit
        return hit


def rooted(c: np.ndarray) -> np.ndarray:
    """Square root, or 0 of what is below 0."""
    np.maximum(c, 0, out=c)
    return np.sqrt(c, out=c)


def stripped(a: np.ndarray, b: np.ndarray, limits: np.ndarray, into: dict[tuple, np.ndarray]) -> bool:
    """As ``tally`` without separation weights, if the points lie in a field that is nearly flat and groups of bin and patch are large."""
    top = (a[:, :3].min(0) + a[:, :3].max(0)) / 2
    long = np.sqrt(top @ top)
    # a sum by runs would carry what is not finite to points that are not met
    if not long > 0 or not np.isfinite(a[:, 5:]).all():
        return False
    side = np.eye(3)[np.argmin(np.abs(top))]
    axes = np.stack([e := np.cross(top, side), np.cross(top, e), top])
    axes /= np.sqrt((axes * axes).sum(1))[:, None]
    p, q = axes @ a[:, :3].T, axes @ b[:, :3].T
    reach = np.sqrt(limits[np.unique(a[:, 3]).astype(int), :, 1].max()) + NEAR
    low, high = p.min(1) - reach, p.max(1) + reach
    keep = np.flatnonzero(((q >= low[:, None]) & (q <= high[:, None])).all(0))
    if not len(keep):
        return True
    b, q = b[keep], q[:, keep]
    bulge = max(p[2].max() - q[2].min(), q[2].max() - p[2].min()) + NEAR
    cuts = np.flatnonzero(np.concatenate([[True], (a[1:, 3:5] != a[:-1, 3:5]).any(1), [True]])).tolist()
    if not bulge <= reach * FLAT or len(a) * len(b) < LARGE * (len(cuts) - 1) * len(np.unique(b[:, 4])) or not np.isfinite(b[:, 5:]).all():
        return False
    field = Field(b, q[:2], low[:2], high[:2])
    at, values, places = np.ascontiguousarray(a[:, :3].T), np.ascontiguousarray(a[:, 5:].T), field.places(p[:2])
    for s, e in zip(cuts, cuts[1:]):
        zbin, mine = int(a[s, 3]), int(a[s, 4])
        discs = {limit: field.discs(at[:, s:e], values[:, s:e], places[:, s:e], limit, bulge) for limit in np.unique(limits[zbin]).tolist()}
        for scale, (lo, hi) in enumerate(limits[zbin].tolist()):
            sums = discs[hi] - discs[lo]
            for k in np.flatnonzero(sums[:, -1] > 0):
                key = (scale, zbin, mine, int(field.patches[k]))
                into[key] = into.get(key, 0.0) + sums[k]
    return True


def tally(a: np.ndarray, b: np.ndarray, limits: np.ndarray, fine: dict | None, into: dict[tuple, np.ndarray]) -> None:
    """Adds the pairs of two blocks to ``into``: sums of products of each value, and their number, by (scale, zbin, p1, p2)."""
    tallied(a, [b], limits, fine, into)


def tallied(a: np.ndarray, parts: list[np.ndarray], limits: np.ndarray, fine: dict | None, into: dict[tuple, np.ndarray]) -> None:
    """As ``tally``, of a block with several."""
    whole = np.isfinite(a[:, :3]).all(1)
    if not whole.all():
        a = a[whole]
    if not len(a) or fine is None and stripped(a, np.concatenate(parts), limits, into):
        return
    for b in parts:
        leafed(a, b, limits, fine, into)


def leafed(a: np.ndarray, b: np.ndarray, limits: np.ndarray, fine: dict | None, into: dict[tuple, np.ndarray]) -> None:
    """As ``tally``, by leaves."""
    left, right = Leaves(a), Leaves(b)
    rough = Rough(left, right) if fine is None else None
    q = left.values.shape[2]
    patches, group = np.unique(right.patch, return_inverse=True)
    for g in range(0, len(patches), WIDE):
        columns = slice(*np.searchsorted(group, [g, g + WIDE]))
        own = group[columns] - g
        wide = int(own[-1]) + 1
        flat = np.zeros((len(own), q, wide))
        flat[np.arange(len(own)), :, own] = right.sums[columns]
        step = max(1, TILE // len(own))
        for r in range(0, len(left), step):
            rows = slice(r, r + step)
            near, far = bounds(left, right, rows, columns)
            zbin, patch = left.zbin[rows], left.patch[rows]
            starts = np.flatnonzero(np.concatenate([[True], (zbin[1:] != zbin[:-1]) | (patch[1:] != patch[:-1])]))
            for s in range(limits.shape[1]):
                lo, hi = limits[zbin, s].T
                part = (far > lo[:, None]) & (near <= hi[:, None])
                total = np.zeros((len(zbin), q, wide))
                if fine is None:
                    inside = part & (near > lo[:, None]) & (far <= hi[:, None])
                    part ^= inside
                    if inside.any():
                        total = (inside.astype(np.float64) @ flat.reshape(len(own), -1)).reshape(total.shape) * left.sums[rows, :, None]
                i, j = np.nonzero(part)
                if len(i):
                    cut = (left, right, i + r, j + columns.start, lo[i], hi[i])
                    if fine is None:
                        sums = compared(*cut, far[i, j] > hi[i], near[i, j] <= lo[i], rough)
                    else:
                        sums = weighed(*cut, {k: fine[k, s] for k in np.unique(zbin).tolist()})
                    at = i * wide + own[j]
                    for v in range(q):
                        total[:, v] += np.bincount(at, sums[:, v], len(zbin) * wide).reshape(-1, wide)
                by = np.add.reduceat(total, starts, axis=0)
                for x, y in np.argwhere(by[:, -1] > 0):
                    key = (s, int(zbin[starts[x]]), int(patch[starts[x]]), int(patches[g + y]))
                    into[key] = into.get(key, 0.0) + by[x, :, y]


def counted(first: DataFrame, second: DataFrame, limits: Limits, values: list[str], auto: bool = False, fine: Fine | None = None) -> DataFrame:
    """(scale, zbin, p1, p2, values, pairs) of two tables of ``blocks``."""
    n = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, name: df.withColumnRenamed("pts", name).repartition(n, *KEY)
    met = side(first, "a").join(side(second, "b"), list(KEY)).select("a", "b")
    chords, width, tables = limits.chords2, 6 + len(values), fine.tables(limits) if fine else None
    names = ["scale", "zbin", "p1", "p2", *values, "pairs"]
    types = [pa.int32()] * 4 + [pa.float64()] * len(values) + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in into.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.float64() if t == pa.int64() else t).cast(t) for c, t in enumerate(types)], names)

        def points(x: pa.Buffer) -> np.ndarray:
            return np.frombuffer(x, np.float64).reshape(-1, width)

        one, parts, size = None, [], 0
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                a, b = a.as_buffer(), points(b.as_buffer())
                if parts and (size + len(b) > MET or not a.equals(one)):
                    tallied(points(one), parts, chords, tables, into)
                    parts, size = [], 0
                    if len(into) > 500_000:
                        yield out()
                        into.clear()
                one = a
                parts.append(b)
                size += len(b)
        if parts:
            tallied(points(one), parts, chords, tables, into)
        if into:
            yield out()

    schema = "scale int, zbin int, p1 int, p2 int, " + "".join(f"{v} double, " for v in values) + "pairs bigint"
    sums = met.mapInArrow(run, schema).groupBy("scale", "zbin", "p1", "p2").agg(*[F.sum(c).alias(c) for c in [*values, "pairs"]])
    if auto:
        sums = sums.where("p1 <= p2").withColumns({v: F.col(v) * half() for v in values})
    return sums


def half() -> Column:
    """Within a patch each pair of one sample is met twice."""
    return F.when(F.col("p1") == F.col("p2"), 0.5).otherwise(1.0)


def count(left: DataFrame, right: DataFrame, limits: Limits, auto: bool = False, fine: Fine | None = None) -> DataFrame:
    """Sum of v1 * v2 over pairs as ``value`` and their number by (scale, zbin, p1, p2); groups without pairs are absent.

    ``left`` has patch, zbin, x, y, z3 and v (its weight); ``right`` the same, and is aligned by zbin
    only if it has that column.  Where both have ``n``, the sum of n1 * n2 comes along as ``number``.
    ``auto``: both sides are the same points; of two patches the pair p1 < p2 counts once, and pairs
    within a patch by half.  ``fine``: each pair is weighted by its separation.
    """
    values = ["v", "n"] if "n" in left.columns and "n" in right.columns else ["v"]
    aligned = "zbin" in right.columns
    sides = [blocks(df, limits, aligned, values, second) for df, second in ((left, False), (right, True))]
    return named(counted(*sides, limits, values, auto, fine))


def named(sums: DataFrame) -> DataFrame:
    return sums.withColumnsRenamed({"v": "value", "n": "number"})


def count_power(left: DataFrame, right: DataFrame, limits: Limits, power: float, resolution: int = RESOLUTION, auto: bool = False) -> DataFrame:
    """As ``count``, with separation weights."""
    return count(left, right, limits, auto, Fine(power, resolution))
