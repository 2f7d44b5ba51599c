"""Points near other points, and the regions that contain them.

Method: points are three-dimensional vectors (geographic positions become unit vectors, distances on the sphere become
chords). A k-d tree fitted to a bounded sample splits space, with the group (points of different groups never meet) as
a further axis. Each point goes to its leaf, and as a halo copy to each other leaf within the radius. In a leaf, a local k-d
tree is searched by the radius, and a sweep along the first coordinate passes points under the edges of the polygons.

The sample only balances the leaves; it decides no result. Where it is too small for the leaves that the points need, leaves that turn out too full are
cut again at quantiles of all their points. Every pair is found in exactly one leaf: the one that owns the
point with the smaller id.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.partitioning import cut_lineage, join_parts, linked, lookup_join

EARTH_RADIUS_M = 6_371_008.8
#: Sampled rows to which the splits are fitted, about, at most; a row takes 32 bytes on the driver. Sixteen of them make a leaf.
SAMPLE_ROWS = 1_000_000
#: Points in a leaf, about.
LEAF_ROWS = 60_000
BUCKET = 16
HALO, HOME, REGION = 0, 1, 2
SHARED = 2
AXES = ("grp", "x", "y", "z")

ROUTED = "leaf int, what byte, id long, grp long, x double, y double, z double, payload binary"
FOUND = "kind string, id_a long, id_b long"


class SplitTree:
    """k-d splits over (group, x, y, z); small: one entry for each split."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.split, self.left, self.right = [], [], [], []
        self.leaves = 0
        scale = np.ptp(sample, axis=0) if len(sample) else np.zeros(4)
        self._grow(sample, max(1, leaves), scale)
        self.axis, self.split, self.left, self.right = (np.array(v) for v in (self.axis, self.split, self.left, self.right))

    def _grow(self, rows: np.ndarray, leaves: int, scale: np.ndarray) -> int:
        node = len(self.axis)
        for v in (self.axis, self.split, self.left, self.right):
            v.append(-1)
        cut = None
        if leaves > 1 and len(rows) > 1:
            spread = np.subtract(*np.percentile(rows, (95, 5), axis=0))
            spread[0] = 0
            whole = np.ptp(rows, axis=0)
            axes = [0] if whole[0] > 0 else []
            axes += [a for a in np.argsort(-spread) if a and whole[a] > 0]
            for a in axes:  # a group that can be parted from the others needs no halo, so that is tried first
                at = float(np.median(rows[:, a]))
                side = rows[:, a] < at
                if not side.any():  # more than half of the rows have the least value
                    more = rows[:, a][rows[:, a] > at]
                    at = float(more.min()) if len(more) else at
                    side = rows[:, a] < at
                share = side.mean()
                if 0.2 <= share <= 0.8 or (a and 0 < share < 1):
                    cut = a, at, side
                    break
        if cut is None:
            self.left[node] = self.leaves
            self.leaves += 1
            return node
        a, at, side = cut
        first = min(leaves - 1, max(1, round(leaves * side.mean())))
        self.axis[node], self.split[node] = int(a), at
        self.left[node] = self._grow(rows[side], first, scale)
        self.right[node] = self._grow(rows[~side], leaves - first, scale)
        return node

    def subdivide(self, cuts: dict[int, tuple[int, list[float]]]) -> None:
        """Cut leaves further: for each leaf an axis and the places to cut it at."""
        node_of = {int(self.left[k]): k for k in np.flatnonzero(self.axis < 0)}
        lists = [list(v) for v in (self.axis, self.split, self.left, self.right)]

        def grow(node: int, axis: int, places: list[float], first_leaf: int | None) -> None:
            if not places:
                if first_leaf is None:
                    first_leaf, self.leaves = self.leaves, self.leaves + 1
                lists[0][node], lists[2][node] = -1, first_leaf
                return
            mid = len(places) // 2
            sides = len(lists[0]), len(lists[0]) + 1
            for v in lists:
                v += [-1, -1]
            lists[0][node], lists[1][node], lists[2][node], lists[3][node] = axis, places[mid], *sides
            grow(sides[0], axis, places[:mid], first_leaf)
            grow(sides[1], axis, places[mid + 1 :], None)

        for leaf, (axis, places) in cuts.items():
            grow(node_of[leaf], axis, sorted(set(places)), leaf)
        self.axis, self.split, self.left, self.right = (np.array(v) for v in lists)

    def route(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that the box low..high of a row touches."""
        rows, nodes = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        done_rows, done_leaves = [rows[:0]], [nodes[:0]]
        while len(rows):
            axis = self.axis[nodes]
            end = axis < 0
            done_rows.append(rows[end])
            done_leaves.append(self.left[nodes[end]])
            rows, nodes, axis = rows[~end], nodes[~end], axis[~end]
            at = self.split[nodes]
            to_left, to_right = low[rows, axis] < at, high[rows, axis] >= at
            rows, nodes = np.concatenate([rows[to_left], rows[to_right]]), np.concatenate([self.left[nodes[to_left]], self.right[nodes[to_right]]])
        return np.concatenate(done_rows), np.concatenate(done_leaves)


class LocalTree:
    """Balanced k-d tree over the rows of a leaf: ranges of one order, halved on each level, with tight boxes."""

    def __init__(self, rows: np.ndarray):
        n = len(rows)
        self.depth = max(0, math.ceil(math.log2(max(1, n / BUCKET))))
        order = np.arange(n)
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(self.depth + 1):
            bounds = self.bounds(n, d)
            now = rows[order]
            low, high = np.minimum.reduceat(now, bounds[:-1]), np.maximum.reduceat(now, bounds[:-1])
            self.boxes.append((low, high))
            if d < self.depth:
                spread = high - low
                spread[:, 0] = np.where(spread[:, 0] > 0, np.inf, 0)
                node = np.repeat(np.arange(len(low)), np.diff(bounds))
                key = now[np.arange(n), np.argmax(spread, axis=1)[node]]
                order = order[np.lexsort((key, node))]
        self.order, self.n = order, n

    @staticmethod
    def bounds(n: int, depth: int) -> np.ndarray:
        return np.arange(2**depth + 1) * n // 2**depth

    def close_buckets(self, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of buckets (a <= b) whose boxes come within the radius."""
        a = b = np.zeros(1, dtype=np.int64)
        r2 = radius[1] ** 2
        for d in range(self.depth + 1):
            if d:
                same = a == b
                a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a[~same] + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, 2 * b[~same]])
            low, high = self.boxes[d]
            apart = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
            keep = (apart[:, 0] == 0) & ((apart[:, 1:] ** 2).sum(axis=1) <= r2 * (1 + 1e-9))
            a, b = a[keep], b[keep]
        return a, b


def close_pairs(rows: np.ndarray, radius: float, step: int = 8_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows (group, x, y, z) of one group at most radius apart, each pair once, in slices."""
    if len(rows) < 2:
        return
    tree = LocalTree(rows)
    a, b = tree.close_buckets(np.array([0, radius, radius, radius]))
    bounds = tree.bounds(tree.n, tree.depth)
    width = int(np.diff(bounds).max())
    slot = np.arange(width)
    sorted_rows = np.ascontiguousarray(rows[tree.order])
    for s in range(0, len(a), step):
        x, y = a[s : s + step], b[s : s + step]
        i = bounds[x][:, None] + slot
        j = bounds[y][:, None] + slot
        i_ok, j_ok = i < bounds[x + 1][:, None], j < bounds[y + 1][:, None]
        i, j = np.minimum(i, tree.n - 1), np.minimum(j, tree.n - 1)
        p, q = sorted_rows[i], sorted_rows[j]
        d2 = np.zeros((len(x), width, width))
        for axis in (1, 2, 3):
            d = p[:, :, None, axis] - q[:, None, :, axis]
            d *= d
            d2 += d
        ok = d2 <= radius * radius
        ok &= i_ok[:, :, None] & j_ok[:, None, :]
        ok &= p[:, :, None, 0] == q[:, None, :, 0]
        ok &= (x != y)[:, None, None] | (slot[:, None] < slot[None, :])[None]
        k, u, v = np.nonzero(ok)
        yield tree.order[i[k, u]], tree.order[j[k, v]]


def under_edges(x: np.ndarray, y: np.ndarray, ring: list[tuple[float, float]]) -> np.ndarray:
    """Whether an odd number of a polygon's edges lies below each point; x is sorted.

    The sweep stops at the corners. Between two stops its status is the edges that it meets, in order of height, and points are placed among them
    by bisection. Should edges cross between two stops, as no polygon's should, points there are held against each edge.
    """
    ends = np.array([(*a, *b) if a[0] <= b[0] else (*b, *a) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[0] != b[0]])  # the line meets no inner part of an edge along itself
    odd = np.zeros(len(x), dtype=bool)
    if not len(ends):
        return odd
    stops = np.unique(ends[:, [0, 2]])
    slope = (ends[:, 3] - ends[:, 1]) / (ends[:, 2] - ends[:, 0])
    cuts = np.searchsorted(x, stops, "left")
    begins, closes = np.searchsorted(stops, ends[:, 0]), np.searchsorted(stops, ends[:, 2])
    by_begin = np.argsort(begins, kind="stable")
    status, nxt = np.zeros(0, dtype=np.int64), 0
    for k in range(len(stops) - 1):
        status = status[closes[status] > k]
        more = int(np.searchsorted(begins[by_begin], k, "right"))
        status, nxt = np.concatenate([status, by_begin[nxt:more]]), more
        s, e = cuts[k], cuts[k + 1]
        if s == e or not len(status):
            continue
        height = lambda edge, at: ends[edge, 1] + (at - ends[edge, 0]) * slope[edge]
        middle = (stops[k] + stops[k + 1]) / 2
        status = status[np.argsort(height(status, middle), kind="stable")]
        at_ends = [height(status, stops[k]), height(status, stops[k + 1])]
        px, py = x[s:e], y[s:e]
        if any((np.diff(h) < -1e-9 * (1 + np.abs(h).max())).any() for h in at_ends):
            odd[s:e] = (height(status[None, :], px[:, None]) < py[:, None]).sum(axis=1) % 2 == 1
            continue
        low, high = np.zeros(e - s, dtype=np.int64), np.full(e - s, len(status))
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(status) - 1)
            below = height(status[mid], px) < py
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        odd[s:e] = low % 2 == 1
    return odd


def inside(xyz: np.ndarray, regions: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(region id, positions of the rows inside), by a sweep along x."""
    if not len(xyz):
        return
    order = np.argsort(xyz[:, 0], kind="stable")
    x, y, z = (np.ascontiguousarray(xyz[order, k]) for k in range(3))
    for rid, shape, low, high, centre, radius, ring in regions:
        first, last = np.searchsorted(x, low[0], "left"), np.searchsorted(x, high[0], "right")
        if first >= last:
            continue
        part = slice(first, last)
        ok = (y[part] >= low[1]) & (y[part] <= high[1]) & (z[part] >= low[2]) & (z[part] <= high[2])
        if shape == "sphere":
            ok &= (x[part] - centre[0]) ** 2 + (y[part] - centre[1]) ** 2 + (z[part] - centre[2]) ** 2 <= radius * radius
        elif shape == "prism":
            ok &= under_edges(x[part], y[part], list(ring))
        if ok.any():
            yield rid, order[first + np.flatnonzero(ok)]


def to_unit_vectors(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add _x, _y, _z: the unit vector of a position in degrees; null where either is null."""
    a, o = F.radians(lat), F.radians(lon)
    return df.withColumns({"_x": F.cos(a) * F.cos(o), "_y": F.cos(a) * F.sin(o), "_z": F.sin(a)})


def chord(metres: float, sphere: float = EARTH_RADIUS_M) -> float:
    """The chord, on the unit sphere, of a distance along a great circle."""
    return 2 * math.sin(min(metres / sphere, math.pi) / 2)


def fit_splits(points: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> SplitTree:
    """Splits for points (id, grp, x, y, z) from a sample over all of them; about sixteen rows or more of it for each leaf.

    If that makes fewer leaves than the points need, the points are counted by leaf, and leaves with more than twice leaf_rows are cut at up to
    fifteen quantiles, again and again until none is left (or only points that coincide).
    """
    n = points.count()
    needed = max(1, math.ceil(n / leaf_rows))
    leaves = max(1, min(needed, sample_rows // 16))
    if needed == 1:
        return SplitTree(np.zeros((0, 4)), 1)
    want = min(sample_rows, max(20_000, 64 * leaves))
    got = points.select("grp", "x", "y", "z").sample(False, min(1.0, want / n), 7).toArrow()
    tree = SplitTree(np.column_stack([got.column(c).to_numpy().astype(float) for c in ("grp", "x", "y", "z")]), leaves)
    while tree.leaves < needed:
        cuts = _cuts(points, tree, leaf_rows)
        if not cuts:
            break
        tree.subdivide(cuts)
    return tree


def _cuts(points: DataFrame, tree: SplitTree, leaf_rows: int) -> dict[int, tuple[int, list[float]]]:
    """For each leaf with more than twice leaf_rows of all the points: an axis on which they differ, groups first, and quantiles on it."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in AXES])
            i, leaf = tree.route(rows, rows)
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), *[pa.array(rows[i, k]) for k in range(4)]], ["leaf", *AXES])

    shares = [k / 16 for k in range(1, 16)]
    placed = points.select(*AXES).mapInArrow(home, "leaf int, grp double, x double, y double, z double")
    stats = [f(c).alias(f"{c}_{name}") for c in AXES for name, f in (("low", F.min), ("high", F.max), ("at", lambda c: F.percentile_approx(c, shares, 1000)))]
    out = {}
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *stats).filter(F.col("n") > 2 * leaf_rows).toLocalIterator():
        spread = [np.inf if c == "grp" and r["grp_high"] > r["grp_low"] else r[f"{c}_high"] - r[f"{c}_low"] if c != "grp" else 0 for c in AXES]
        axis = int(np.argmax(spread))
        step = max(1, 16 // math.ceil(r["n"] / leaf_rows))
        places = [v for v in r[f"{AXES[axis]}_at"][step - 1 :: step] if v > r[f"{AXES[axis]}_low"]]
        if not places and spread[axis] > 0:  # more than fifteen sixteenths have the least value
            places = [r[f"{AXES[axis]}_high"]]
        if places:
            out[int(r["leaf"])] = axis, places
    return out


def _regions(rows: pa.Table) -> Iterator[tuple]:
    for r in rows.to_pylist():
        low, high = [r["c0_min"], r["c1_min"], r["c2_min"]], [r["c0_max"], r["c1_max"], r["c2_max"]]
        ring = [(float(p["c0"]), float(p["c1"])) for p in r["ring"] or [] if p and p["c0"] is not None and p["c1"] is not None]
        centre = [r["centre0"], r["centre1"], r["centre2"]]
        if r["region_id"] is None or any(v is None or v != v for v in low + high):
            continue
        if r["shape"] == "sphere" and (r["radius"] is None or any(v is None for v in centre)) or r["shape"] == "prism" and len(ring) < 3:
            continue
        yield r["region_id"], r["shape"], low, high, centre, r["radius"], ring


def near_and_inside(points: DataFrame, radius: float, regions: DataFrame | None = None, *, id: str = "point_id", group: str | None = "block", xyz: tuple[str, str, str] = ("c0", "c1", "c2"), leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Pairs of points of one group at most radius apart (kind near, id_a < id_b) and regions that contain points (kind inside, id_a the region).

    points: id and group are bigint; a null group is a group of its own. Rows with a null id, or a coordinate that is null, NaN or
    infinite, or with all three 0, take part in nothing. Repeated rows (same id, group and place) count once; an id must not stand
    at two places. A point is not near itself. At exactly the radius, a pair counts. regions: see TESTDATA.md; rows whose bounds are
    incomplete contain nothing, and so do rings of fewer than three corners. Empty tables give an empty result; further columns of
    either table are ignored, whatever their names.
    """
    x, y, z = (F.col(c).cast("double") for c in xyz)
    usable = points.select(F.col(id).cast("long").alias("id"), (F.coalesce(F.col(group).cast("long"), F.lit(-(2**52))) if group else F.lit(0).cast("long")).alias("grp"), x.alias("x"), y.alias("y"), z.alias("z"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    usable = usable.filter(F.col("id").isNotNull() & finite("x") & finite("y") & finite("z") & ~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))
    tree = fit_splits(usable, leaf_rows, sample_rows)
    reach = np.array([0, radius, radius, radius]) * (1 + 1e-9)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("grp", "x", "y", "z")])
            ids = b.column("id").to_numpy(zero_copy_only=False)
            keep = np.lexsort((rows[:, 1], rows[:, 0], ids))  # repeated rows that come together are dropped before the shuffle
            again = (np.diff(ids[keep]) == 0) & (np.diff(rows[keep], axis=0) == 0).all(axis=1)
            keep = keep[np.concatenate([[True], ~again])] if len(keep) else keep
            rows, ids = rows[keep], ids[keep]
            home_of = np.empty(len(rows), dtype=np.int64)
            r, home = tree.route(rows, rows)
            home_of[r] = home
            i, leaf = tree.route(rows - reach, rows + reach)
            got = rows[i]
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(np.where(home_of[i] == leaf, HOME, HALO).astype(np.int8)), pa.array(ids[i]), pa.array(got[:, 0].astype(np.int64)), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(got[:, 3]), pa.nulls(len(i), pa.binary())], ["leaf", "what", "id", "grp", "x", "y", "z", "payload"])

    def route_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_regions(pa.Table.from_batches([b])))
            if not got:
                continue
            low = np.array([[-np.inf, *g[2]] for g in got], dtype=float)
            high = np.array([[np.inf, *g[3]] for g in got], dtype=float)
            i, leaf = tree.route(low, high)
            n = len(i)
            none = pa.nulls(n, pa.float64())
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(np.full(n, REGION, np.int8)), pa.array([got[k][0] for k in i], pa.int64()), pa.nulls(n, pa.int64()), none, none, none, pa.array([pickle.dumps(got[k]) for k in i], pa.binary())], ["leaf", "what", "id", "grp", "x", "y", "z", "payload"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        what = table.column("what").to_numpy()
        shapes = [pickle.loads(p) for p in table.filter(pa.array(what == REGION)).column("payload").to_pylist()]
        table = table.filter(pa.array(what != REGION))
        ids, home = table.column("id").to_numpy(), table.column("what").to_numpy() == HOME
        rows = np.column_stack([table.column(c).to_numpy().astype(float) for c in ("grp", "x", "y", "z")])
        if not len(ids):
            return
        keep = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0], ids))
        again = (np.diff(ids[keep]) == 0) & (np.diff(rows[keep], axis=0) == 0).all(axis=1)
        keep = keep[np.concatenate([[True], ~again])]
        rows, ids, home = rows[keep], ids[keep], home[keep]
        for i, j in close_pairs(rows, radius):
            flip = ids[i] > ids[j]
            i, j = np.where(flip, j, i), np.where(flip, i, j)
            ok = home[i] & (ids[i] != ids[j])
            if ok.any():
                yield pa.record_batch([pa.array(["near"] * int(ok.sum())), pa.array(ids[i[ok]]), pa.array(ids[j[ok]])], ["kind", "id_a", "id_b"])
        mine = np.flatnonzero(home)
        for rid, hit in inside(rows[mine, 1:], sorted(set(shapes_key(s) for s in shapes))):
            yield pa.record_batch([pa.array(["inside"] * len(hit)), pa.array(np.full(len(hit), rid, np.int64)), pa.array(ids[mine[hit]])], ["kind", "id_a", "id_b"])

    routed = usable.mapInArrow(route, ROUTED)
    if regions is not None:
        wanted = regions.select("region_id", "shape", *[f"c{k}_{s}" for k in range(3) for s in ("min", "max")], *[f"centre{k}" for k in range(3)], "radius", "ring")
        routed = routed.unionByName(wanted.mapInArrow(route_regions, ROUTED))
    return routed.groupBy("leaf").applyInArrow(search, FOUND)


LEFT, RIGHT, BOTH = 0, 1, 2


def usable_rows(df: DataFrame, id: str, group: str | None, axes: Sequence[str], side: int, more: Sequence[str] = ()) -> DataFrame:
    """(what, id, grp, x, y, z, more) of rows without a null among them, whose coordinates are finite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    out = df.select(F.lit(side).cast("byte").alias("what"), F.col(id).cast("long").alias("id"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp"), *[F.col(a).cast("double").alias(c) for a, c in zip(axes, "xyz", strict=True)], *more)
    return out.filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & finite("x") & finite("y") & finite("z"))


def neighbours(left: DataFrame, right: DataFrame | None, radius: float, *, left_id: str = "id", right_id: str = "id", group: str | None = None, axes: tuple[str, str, str] = ("x", "y", "z"), k: int | None = 1, differ: bool = False, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(left_id, right_id, rank, distance2): the k nearest right rows of each left row within the radius (ties: the least right id), or with k null (left_id, n), how many there are.

    right null: the left rows themselves. differ: rows of equal ids don't meet. ids and group are integers; a null in them, or a coordinate that is null, NaN or
    infinite, takes part in nothing. Left rows without a neighbour are left out. Only ids and coordinates are shuffled: each left row once, each right
    row once and once more for each further leaf within the radius. A leaf keeps its best k for each row, so that dense places need no room for all pairs.
    """
    alone = right is None
    rows = usable_rows(left, left_id, group, axes, BOTH if alone else LEFT)
    if right is not None:
        rows = rows.unionByName(usable_rows(right, right_id, group, axes, RIGHT))
    tree = fit_splits(rows, leaf_rows, sample_rows)
    reach = np.array([0, radius, radius, radius]) * (1 + 1e-9)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in AXES])
            what = b.column("what").to_numpy(zero_copy_only=False)
            home_of = np.empty(len(at), dtype=np.int64)
            r, home = tree.route(at, at)
            home_of[r] = home
            far = np.flatnonzero(what != LEFT)
            i, leaf = tree.route((at - reach)[far], (at + reach)[far])
            i = far[i]
            away = home_of[i] != leaf
            i, leaf = np.concatenate([np.arange(len(at)), i[away]]), np.concatenate([home_of, leaf[away]])
            side = np.where(np.arange(len(i)) < len(at), what[i], RIGHT)
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(side.astype(np.int8)), *[b.column(c).take(pa.array(i)) for c in ("id", *AXES)]], ["leaf", "what", "id", *AXES])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, what, grp = (table.column(c).to_numpy() for c in ("id", "what", "grp"))
        at = np.column_stack([table.column(c).to_numpy().astype(float) for c in AXES])
        found = np.zeros(len(ids), dtype=np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for i, j in close_pairs(at, radius):
            d2 = ((at[i, 1:] - at[j, 1:]) ** 2).sum(axis=1)
            i, j, d2 = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d2, d2])
            ok = (what[i] != RIGHT) & (what[j] != LEFT) & (grp[i] == grp[j])
            if differ:
                ok &= ids[i] != ids[j]
            i, j, d2 = i[ok], j[ok], d2[ok]
            if k is None:
                found += np.bincount(i, minlength=len(ids))
                continue
            best = _nearest_k(*(np.concatenate(p) for p in zip(best, (i, ids[j], d2), strict=True)), k)
        if not differ and alone:  # a row meets itself
            own = np.flatnonzero(what == BOTH)
            found[own] += 1
            if k is not None:
                best = _nearest_k(*(np.concatenate(p) for p in zip(best, (own, ids[own], np.zeros(len(own))), strict=True)), k)
        if k is None:
            have = np.flatnonzero(found)
            yield pa.record_batch([pa.array(ids[have]), pa.array(found[have])], ["left_id", "n"])
            return
        i, other, d2 = best
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) + 1
            yield pa.record_batch([pa.array(ids[i]), pa.array(other), pa.array(rank.astype(np.int32)), pa.array(d2)], ["left_id", "right_id", "rank", "distance2"])

    routed = rows.mapInArrow(route, "leaf int, what byte, id long, grp long, x double, y double, z double")
    return routed.groupBy("leaf").applyInArrow(search, "left_id long, n long" if k is None else "left_id long, right_id long, rank int, distance2 double")


def _nearest_k(i: np.ndarray, other: np.ndarray, d2: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each i, in order, the k entries of least d2 (ties: the least other)."""
    order = np.lexsort((other, d2, i))
    i, other, d2 = i[order], other[order], d2[order]
    if not len(i):
        return [i, other, d2]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
    return [i[keep], other[keep], d2[keep]]


def connected(points: DataFrame, radius: float, *, id: str = "id", group: str | None = None, axes: tuple[str, str, str] = ("x", "y", "z"), angle: float | None = None, max_curvature: float = 1.0, min_neighbours: int = 3, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(node, component): points of one group that hang together by steps of at most radius, named by the least id of their part.

    angle: only points count that have a plane of at least min_neighbours points within the radius (themselves included) and at most max_curvature, and
    steps only between planes whose normals differ by less than angle (either sign). ids and group are integers, ids are unique; repeated rows count once; a null
    in them, or a coordinate that is null, NaN or infinite, takes part in nothing.
    A leaf joins what it holds, halo copies included, without a list of pairs; then only points that stand in several leaves link the leaves' parts. With angle the
    halo is twice as wide, so that a leaf knows all neighbours of its halo's inner half.
    """
    rows = usable_rows(points, id, group, axes, HOME)
    tree = fit_splits(rows, leaf_rows, sample_rows)
    reach = np.array([0, radius, radius, radius]) * (1 if angle is None else 2) * (1 + 1e-9)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in AXES])
            home_of = np.empty(len(at), dtype=np.int64)
            r, home = tree.route(at, at)
            home_of[r] = home
            i, leaf = tree.route(at - reach, at + reach)
            what = np.where(home_of[i] != leaf, HALO, np.where(np.bincount(i, minlength=len(at))[i] > 1, SHARED, HOME))
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(what.astype(np.int8)), *[b.column(c).take(pa.array(i)) for c in ("id", *AXES)]], ["leaf", "what", "id", *AXES])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        cols = [table.column(c).to_numpy() for c in ("z", "y", "x", "grp", "id")]
        order = np.lexsort(cols)
        order = order[np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)])]
        ids, what, grp = (table.column(c).to_numpy()[order] for c in ("id", "what", "grp"))
        at = np.column_stack([table.column(c).to_numpy()[order].astype(float) for c in AXES])
        node = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])])
        label = np.arange(node[-1] + 1)
        flat, normal = np.ones(len(ids), dtype=bool), None
        if angle is not None:
            flat, normal = _planes(at, grp, radius, max_curvature, min_neighbours)
        for i, j in close_pairs(at, radius):
            ok = grp[i] == grp[j]
            if normal is not None:
                ok &= flat[i] & flat[j] & ((what[i] != HALO) | (what[j] != HALO))
                i, j = i[ok], j[ok]
                ok = np.abs((normal[i] * normal[j]).sum(axis=1)) > math.cos(angle)
            label = join_parts(label, node[i[ok]], node[j[ok]])
        names = np.empty(len(label), dtype=np.int64)
        names[node] = ids
        keep = flat & ((what != HALO) | (np.bincount(label)[label] > 1)[node])
        yield pa.record_batch([pa.array(ids[keep]), pa.array(names[label[node[keep]]]), pa.array(what[keep].astype(np.int8))], ["node", "root", "what"])

    routed = rows.mapInArrow(route, "leaf int, what byte, id long, grp long, x double, y double, z double")
    found = cut_lineage(routed.groupBy("leaf").applyInArrow(search, "node long, root long, what byte"))
    parts = linked(found.filter((F.col("what") != HOME) & (F.col("node") != F.col("root"))), "node", "root").withColumnRenamed("node", "root")
    named = lookup_join(found.filter(F.col("what") != HALO), parts, "root", "node", "left")
    return named.select("node", F.coalesce("component", "root").alias("component"))


def _planes(at: np.ndarray, grp: np.ndarray, radius: float, max_curvature: float, min_neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row (group, x, y, z) has a plane of its neighbours, and the normal of it; sums are taken about the row itself."""
    n = len(at)
    sums = np.zeros((9, n))
    count = np.ones(n)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    for i, j in close_pairs(at, radius):
        ok = grp[i] == grp[j]
        i, j = i[ok], j[ok]
        d = at[j, 1:] - at[i, 1:]
        for ends, sign in ((i, 1), (j, -1)):
            count += np.bincount(ends, minlength=n)
            for k in range(3):
                sums[k] += np.bincount(ends, sign * d[:, k], minlength=n)
            for k, (u, v) in enumerate(pairs):
                sums[3 + k] += np.bincount(ends, d[:, u] * d[:, v], minlength=n)
    flat, normal = np.zeros(n, dtype=bool), np.zeros((n, 3))
    ok = np.flatnonzero(count >= min_neighbours)
    mean = (sums[:3] / count)[:, ok].T
    m = np.empty((len(ok), 3, 3))
    for k, (u, v) in enumerate(pairs):
        m[:, u, v] = m[:, v, u] = sums[3 + k][ok] - count[ok] * mean[:, u] * mean[:, v]
    values, vectors = np.linalg.eigh(m)
    normal[ok] = vectors[:, :, 0]
    flat[ok] = np.maximum(values[:, 0], 0) / np.maximum(values.sum(axis=1), 1e-300) <= max_curvature
    return flat, normal


def enclosed(query: DataFrame, reference: DataFrame | None, angle: float, *, id: str = "id", range_threshold: float | None = None, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, right_id, right_range) of spatial_join.changed, for integer ids and angles up to a quarter turn; reference null: the query itself.

    Only ids, directions and ranges are shuffled, references once more for each further leaf within the angle. In a leaf, boxes of a k-d tree that lie
    within a query's window count as a whole, by the nearest of their ranges, so that dense directions make no pairs. Repeated ids of queries count once.
    """

    def slim(df: DataFrame, side: int) -> DataFrame:
        out = usable_rows(df.withColumn("_none", F.lit(0.0)), id, None, ("bearing", "elevation", "_none"), side, [F.col("range").cast("double").alias("range")])
        return out.filter(F.col("range").isNotNull() & ~F.isnan("range"))

    alone = reference is None
    rows = slim(query, BOTH if alone else LEFT)
    if reference is not None:
        rows = rows.unionByName(slim(reference, RIGHT))
    turn = 2 * math.pi
    tree = fit_splits(rows.withColumn("x", F.pmod(F.col("x") + math.pi, F.lit(turn)) - math.pi), leaf_rows, sample_rows)
    reach = np.array([0, angle, angle, 0]) * (1 + 1e-9) + np.array([0, 1e-9, 1e-9, 0])
    names = ["leaf", "what", "id", "x", "y", "range"]
    shifts = np.array([0, 0, 0, turn, -turn])  # by LEFT, RIGHT, BOTH and copies of references across the border

    def wrapped(x: np.ndarray) -> np.ndarray:
        return (x + math.pi) % turn - math.pi

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in AXES])
            at[:, 1] = wrapped(at[:, 1])
            what = b.column("what").to_numpy(zero_copy_only=False)
            home_of = np.empty(len(at), dtype=np.int64)
            r, home = tree.route(at, at)
            home_of[r] = home
            out = [(np.arange(len(at)), home_of, what)]
            for code in (RIGHT, 3, 4):
                far = np.flatnonzero((what != LEFT) & ((code == RIGHT) | (shifts[code] * at[:, 1] < -abs(shifts[code]) * (math.pi - reach[1]))))
                place = at[far] + np.array([0, shifts[code], 0, 0])
                i, leaf = tree.route(place - reach, place + reach)
                i = far[i]
                new = (home_of[i] != leaf) | (code != RIGHT)
                out.append((i[new], leaf[new], np.full(int(new.sum()), code)))
            i, leaf, side = (np.concatenate(v) for v in zip(*out, strict=True))
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(side.astype(np.int8)), *[b.column(c).take(pa.array(i)) for c in names[2:]]], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        what, ids, b, e, far = (table.column(c).to_numpy() for c in names[1:])
        x = wrapped(b) + shifts[what]
        asks, refs = np.flatnonzero((what == LEFT) | (what == BOTH)), np.flatnonzero(what != LEFT)
        asks = asks[np.unique(ids[asks], return_index=True)[1]]
        if not len(asks) or not len(refs):
            return
        refs = refs[np.lexsort((ids[refs], far[refs]))]  # the best first
        best, sides = _windows(x[asks], b[asks], e[asks], x[refs], b[refs], e[refs], angle, what[asks] == BOTH)
        ok = (best < len(refs)) & (sides == 15)
        if range_threshold is not None:
            ok[ok] = far[refs[best[ok]]] >= far[asks[ok]] + range_threshold
        k = refs[best[ok]]
        yield pa.record_batch([pa.array(ids[asks[ok]]), pa.array(ids[k]), pa.array(far[k])], ["id", "right_id", "right_range"])

    routed = rows.mapInArrow(route, "leaf int, what byte, id long, x double, y double, range double")
    return routed.groupBy("leaf").applyInArrow(search, "id long, right_id long, right_range double")


def _windows(x: np.ndarray, b: np.ndarray, e: np.ndarray, rx: np.ndarray, rb: np.ndarray, re: np.ndarray, angle: float, own: np.ndarray, step: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """For each query the first reference less than angle away in bearing and elevation (len(rx): none), and on which sides there are any: 15 if on all.

    x: where bearings b lie in this leaf. own: queries that are references too, and so have one straight ahead.
    """
    n, tiny = len(rx), 1e-12
    best, sides = np.full(len(x), n), np.where(own, 15, 0)
    tree = LocalTree(np.column_stack([np.zeros(n), rx, re, np.zeros(n)]))
    first = [np.minimum.reduceat(tree.order, tree.bounds(n, d)[:-1]) for d in range(tree.depth + 1)]
    bounds = tree.bounds(n, tree.depth)
    slot = np.arange(int(np.diff(bounds).max()))
    for s in range(0, len(x), step):
        q = np.arange(s, min(len(x), s + step))
        node = np.zeros(len(q), dtype=np.int64)
        for d in range(tree.depth + 1):
            if d:
                q, node = np.concatenate([q, q]), np.concatenate([2 * node, 2 * node + 1])
            open_ = (first[d][node] < best[q]) | (sides[q] != 15)
            q, node = q[open_], node[open_]
            low, high = tree.boxes[d]
            edges = [low[node, 1] - x[q], high[node, 1] - x[q], low[node, 2] - e[q], high[node, 2] - e[q]]
            meets = (edges[0] < angle + tiny) & (edges[1] > -angle - tiny) & (edges[2] < angle + tiny) & (edges[3] > -angle - tiny)
            clear = (sides[q] == 15) | np.all([np.abs(v) > tiny for v in edges], axis=0)
            inside = clear & (edges[0] > -angle + tiny) & (edges[1] < angle - tiny) & (edges[2] > -angle + tiny) & (edges[3] < angle - tiny)
            np.minimum.at(best, q[inside], first[d][node[inside]])
            np.bitwise_or.at(sides, q[inside], (1 * (edges[0] <= 0) + 2 * (edges[1] >= 0) + 4 * (edges[2] <= 0) + 8 * (edges[3] >= 0))[inside])
            q, node = q[meets & ~inside], node[meets & ~inside]
        for t in range(0, len(q), 20_000):
            k, at = q[t : t + 20_000], node[t : t + 20_000]
            place = bounds[at][:, None] + slot
            there = place < bounds[at + 1][:, None]
            r, k = tree.order[np.minimum(place, n - 1)][there], np.broadcast_to(k[:, None], there.shape)[there]
            turn = np.fmod(rb[r] - b[k] + math.pi, 2 * math.pi)
            turn = np.where(turn < 0, np.fmod(turn + 2 * math.pi, 2 * math.pi), turn) - math.pi
            rise = re[r] - e[k]
            near = (np.abs(turn) < angle) & (np.abs(rise) < angle)
            k, r, turn, rise = k[near], r[near], turn[near], rise[near]
            np.minimum.at(best, k, r)
            np.bitwise_or.at(sides, k, 1 * (turn <= 0) + 2 * (turn >= 0) + 4 * (rise <= 0) + 8 * (rise >= 0))
    return best, sides


def shapes_key(s: tuple) -> tuple:
    """The region as nested tuples, so that repeated region rows count once."""
    rid, shape, low, high, centre, radius, ring = s
    return rid, shape, tuple(low), tuple(high), tuple(-np.inf if c is None else c for c in centre), radius or 0.0, ring if isinstance(ring, tuple) else tuple(ring)


def near_positions(positions: DataFrame, metres: float, *, id: str, lat: str, lon: str, group: str | None = None, sphere: float = EARTH_RADIUS_M) -> DataFrame:
    """Pairs of geographic positions (degrees) at most so far apart along the sphere; the poles and longitude 180 are nothing special."""
    ready = to_unit_vectors(positions.filter(F.abs(F.col(lat)) <= 90), lat, lon)
    return near_and_inside(ready, chord(metres, sphere), id=id, group=group, xyz=("_x", "_y", "_z")).filter("kind = 'near'")
