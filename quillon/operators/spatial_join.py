"""Joins of points by distance, of points with triangles, and of scans in polar coordinates.

A distance is no equality, so each side gets the cells of a grid twice as wide as the radius; a left row stands in its own cell, a right row in the 2^d
cells that its radius touches, and the join is on cells (and blocks). A pair of points meets in exactly one cell, so nothing is found twice. Cells
are equi-join keys, so hot ones are split by adaptive skew joins, or by salts here. The nearest rows, and their number, need no pairs at all: they are
found in the leaves of k-d splits (near.neighbours), by ids and coordinates only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIGHT = "right_"


def cell(c: str | Column, size: float, origin: float = 0.0) -> Column:
    """Index of the cell that holds a coordinate: floor, so that negative coordinates are right too."""
    return F.floor(((F.col(c) if isinstance(c, str) else c) - F.lit(float(origin))) / F.lit(float(size))).cast("long")


def with_cells(df: DataFrame, axes: Sequence[str], size: float, origin: Sequence[float] | None = None) -> DataFrame:
    """Add _i0, _i1, ...: the cell of each row."""
    return df.withColumns({f"_i{k}": cell(c, size, (origin or [0.0] * len(axes))[k]) for k, c in enumerate(axes)})


def with_neighbour_cells(df: DataFrame, axes: int, reach: int = 1) -> DataFrame:
    """Copy each row to the cells about its own (_i0, _i1, ...)."""
    steps = [F.struct(*[F.lit(s).cast("long").alias(f"s{k}") for k, s in enumerate(o)]) for o in itertools.product(range(-reach, reach + 1), repeat=axes)]
    out = df.withColumn("_step", F.explode(F.array(*steps)))
    return out.withColumns({f"_i{k}": F.col(f"_i{k}") + F.col(f"_step.s{k}") for k in range(axes)}).drop("_step")


def _finite(axes: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in axes:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return out


def _square(axes: Sequence[str]) -> Column:
    out = None
    for c in axes:
        d = F.col(c) - F.col(RIGHT + c)
        out = d * d if out is None else out + d * d
    return out


def pairs_within(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z"), *, keys: Sequence[str] = (), min_radius: float = 0.0, row_radius: str | None = None, ids: tuple[str, str] | None = None, normals: Sequence[str] | None = None, salts: int = 1, how: str = "inner") -> DataFrame:
    """Each left row with each right row at a distance from min_radius to radius; right columns are prefixed with right_, distance2 is added.

    axes: the coordinates, of the same names on both sides (two or three, or any number). keys: columns that must be equal, such as the block.
    row_radius: a left column that narrows the radius of its row (null: radius). ids: ("equal" or "differ", column). normals: three
    columns on both sides, of which the dot product must not be negative. Rows with a coordinate or key that is null, NaN or infinite
    pair with nothing. Both ends of the range count. how: inner, left_semi or left_anti (then only left columns come out).
    """
    r = right.filter(_finite(axes)).withColumnsRenamed({c: RIGHT + c for c in right.columns})
    side = 2 * radius
    for i, c in enumerate(axes):
        r = r.withColumn(f"_i{i}", F.explode(F.sequence(cell(F.col(RIGHT + c) - radius * (1 + 1e-9), side), cell(F.col(RIGHT + c) + radius * (1 + 1e-9), side))))
    lefts = with_cells(left if how == "left_anti" else left.filter(_finite(axes)), axes, side)
    d2 = _square(axes)
    limit = radius * radius
    near = d2 <= (F.least(F.coalesce(F.col(row_radius), F.lit(radius)), F.lit(radius)) ** 2 if row_radius else F.lit(limit))
    if min_radius > 0:
        near = near & (d2 >= min_radius * min_radius)
    if ids:
        near = near & (F.col(ids[1]) == F.col(RIGHT + ids[1]) if ids[0] == "equal" else F.col(ids[1]) != F.col(RIGHT + ids[1]))
    if normals:
        near = near & (sum((F.col(n) * F.col(RIGHT + n) for n in normals), F.lit(0.0)) >= 0)
    on = [lefts[f"_i{k}"] == r[f"_i{k}"] for k in range(len(axes))] + [lefts[k] == r[RIGHT + k] for k in keys]
    if salts > 1:
        lefts = lefts.withColumn("_salt", F.floor(F.rand(5) * salts).cast("int"))
        r = r.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        on.append(lefts["_salt"] == r["_salt"])
    cond = near
    for c in on:
        cond = c & cond
    joined = lefts.join(r, cond, how)
    names = left.columns + ([] if how in ("left_semi", "left_anti") else [RIGHT + c for c in right.columns])
    out = joined.select(*[lefts[c] for c in left.columns], *([] if len(names) == len(left.columns) else [r[RIGHT + c] for c in right.columns]))
    return out if how in ("left_semi", "left_anti") else out.withColumn("distance2", _square(axes))


def _in_leaves(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, k: int | None, options: dict) -> DataFrame | None:
    """near.neighbours, if the options, and the types of ids and keys, are such that it has them."""
    from quillon.operators.near import neighbours

    axes, keys, ids = tuple(options.get("axes", ("x", "y", "z"))), list(options.get("keys", ())), options.get("ids")
    whole = lambda df, c: df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")
    plain = set(options) <= {"axes", "keys", "ids"} and len(axes) == 3 and len(keys) <= 1 and (ids is None or ids == ("differ", left_id) and left_id == right_id)
    if not plain or not all(whole(df, c) for df, c in [(left, left_id), (right, right_id), *[(df, c) for c in keys for df in (left, right)]]):
        return None
    return neighbours(left, None if right is left else right, radius, left_id=left_id, right_id=right_id, group=keys[0] if keys else None, axes=axes, k=k, differ=ids is not None)


def nearest_ids(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, k: int = 1, **options) -> DataFrame:
    """(<left_id>, right_<right_id>, rank, distance): nearest_within without the other columns, for which nothing but ids and coordinates is shuffled."""
    found = _in_leaves(left, right, radius, left_id, right_id, k, options)
    if found is None:
        return _nearest_of_pairs(left, right, radius, left_id, right_id, k, **options).select(left_id, RIGHT + right_id, "rank", "distance")
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(RIGHT + right_id), "rank", F.sqrt("distance2").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, k: int = 1, **options) -> DataFrame:
    """The k nearest right rows of each left row within the radius, with distance; left rows without any are left out. Ties: the least right id.

    Ids are unique on their side. With options beyond axes, keys and different ids the pairs are made and the best of them taken.
    """
    found = _in_leaves(left, right, radius, left_id, right_id, k, options)
    if found is None:
        return _nearest_of_pairs(left, right, radius, left_id, right_id, k, **options)
    found = found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(RIGHT + right_id), "rank", F.sqrt("distance2").alias("distance"))
    if len(right.columns) > 1:
        found = found.join(right.withColumnsRenamed({c: RIGHT + c for c in right.columns}), RIGHT + right_id)
    return found.join(left, left_id).select(*left.columns, *[RIGHT + c for c in right.columns], "rank", "distance")


def _nearest_of_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, k: int, **options) -> DataFrame:
    pairs = pairs_within(left, right, radius, **options)
    order = F.struct(F.col("distance2"), F.col(RIGHT + right_id))
    if k == 1:
        whole = F.struct(*[F.col(c) for c in pairs.columns])
        best = pairs.groupBy(left_id).agg(F.min_by(whole, order).alias("_best")).select("_best.*").withColumn("rank", F.lit(1))
    else:
        w = Window.partitionBy(left_id).orderBy("distance2", RIGHT + right_id)
        best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.withColumn("distance", F.sqrt("distance2")).drop("distance2")


def count_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, **options) -> DataFrame:
    """Each left row with count, the number of right rows within the radius; 0 is kept. Ids are unique on their side; right rows need a column of left_id's name, or pairs are made."""
    found = _in_leaves(left, right, radius, left_id, left_id, None, options) if left_id in right.columns else None
    if found is not None:
        return left.join(found, left[left_id] == found["left_id"], "left").select(*[left[c] for c in left.columns], F.coalesce("n", F.lit(0)).alias("count"))
    counts = pairs_within(left.select(*dict.fromkeys([left_id, *options.get("axes", ("x", "y", "z")), *options.get("keys", ())])), right, radius, **options).groupBy(F.col(left_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(counts, left[left_id] == counts["_id"], "left").select(*[left[c] for c in left.columns], F.coalesce("_n", F.lit(0)).alias("count"))


def count_in_neighbour_cells(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = (), origin: Sequence[float] | None = None) -> DataFrame:
    """Each left row with count, the number of right rows in the 3^d cells about its own; no distances, so the grid's origin matters."""
    cells = [f"_i{k}" for k in range(len(axes))]
    sizes = with_cells(right.filter(_finite(axes)), axes, radius, origin).groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    about = with_neighbour_cells(sizes, len(axes)).groupBy(*keys, *cells).agg(F.sum("_n").alias("count"))
    out = with_cells(left, axes, radius, origin).join(about, [*keys, *cells], "left")
    return out.select(*left.columns, F.coalesce("count", F.lit(0)).alias("count"))


def matching(left: DataFrame, right: DataFrame, radius: float, negate: bool = False, **options) -> DataFrame:
    """Left rows that have a right row within the radius, or with negate those that have none (rows without a place or block included)."""
    return pairs_within(left, right, radius, how="left_anti" if negate else "left_semi", **options)


def same_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left, but the query fails on the first row whose block the right side doesn't have; without it such rows match nothing, as if blocks were ordered."""
    have = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_have", F.lit(True))
    joined = left.join(have, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    lost = F.raise_error(F.concat(F.lit("the right side has no block "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))).cast("boolean")
    return joined.filter(F.when(F.col("_have").isNull(), lost).otherwise(F.lit(True))).select(*[left[c] for c in left.columns])


def usable(points: DataFrame, axes: Sequence[str] = ("x", "y", "z"), permissive: bool = False) -> DataFrame:
    """Rows whose coordinates are finite; with permissive false the query fails on the first other row."""
    ok = F.coalesce(_finite(axes), F.lit(False))
    return points.filter(ok if permissive else F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a point has no finite coordinates")).cast("boolean")))


def strict(left: DataFrame, matched: DataFrame, id: str) -> DataFrame:
    """matched, but the query fails on the first left row that isn't in it."""
    wanted, marked = left.select(F.col(id).alias("_wanted")), matched.withColumn("_got", F.col(id))
    lost = F.raise_error(F.concat(F.lit("no match for "), F.coalesce(F.col("_wanted").cast("string"), F.lit("null")))).cast("boolean")
    joined = wanted.join(marked, F.col("_wanted").eqNullSafe(F.col("_got")), "left")
    return joined.filter(F.when(F.col("_got").isNull(), lost).otherwise(F.lit(True))).drop("_wanted", "_got")


# --- triangles ---------------------------------------------------------------------------------------------------------


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangles_near(points: DataFrame, triangles: DataFrame, radius: float, max_side: float, axes: Sequence[str] = ("x", "y", "z"), triangle_id: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Each point with each triangle whose plane is at most radius away and that holds the point's projection, border included.

    triangles(id, a_x, a_y, a_z, b_x, ..., c_z): the point must lie on or in front of the side to which the corners run anticlockwise.
    Adds right_<id>, near_x, near_y, near_z (the projection) and distance. A cell is 2 max(radius, max_side) wide and a triangle
    stands in the cells of its corners, each pair counts once. Degenerate triangles, and rows with a null or NaN coordinate, match nothing.
    """
    size = 2 * max(radius, max_side)
    corner = {c: [F.col(f"{c}_{a}") for a in "xyz"] for c in "abc"}
    cells = F.array_distinct(F.array(*[F.struct(*[cell(v, size).alias(f"_i{k}") for k, v in enumerate(corner[c])]) for c in "abc"]))
    t = triangles.select(F.col(triangle_id).alias(RIGHT + triangle_id), *[F.col(k).alias(RIGHT + k) for k in keys], *[f"{c}_{a}" for c in "abc" for a in "xyz"]).withColumn("_cell", F.explode(cells))
    t = with_neighbour_cells(t.select("*", "_cell.*").drop("_cell"), 3)
    t = t.dropDuplicates([RIGHT + triangle_id, *[RIGHT + k for k in keys], "_i0", "_i1", "_i2"])
    p = with_cells(points.filter(_finite(axes)), axes, size)
    on = [p[f"_i{k}"] == t[f"_i{k}"] for k in range(3)] + [p[k] == t[RIGHT + k] for k in keys]
    xyz = [F.col(a) for a in axes]
    n = _cross(_minus(corner["b"], corner["a"]), _minus(corner["c"], corner["a"]))
    n2 = _dot(n, n)
    height = _dot(n, _minus(xyz, corner["a"]))
    foot = [x - v * height / n2 for x, v in zip(xyz, n, strict=True)]
    inside = [_dot(n, _cross(_minus(corner[q], corner[o]), _minus(foot, corner[o]))) >= -1e-12 * n2 for o, q in (("a", "b"), ("b", "c"), ("c", "a"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = p.join(t, cond).filter((n2 > 0) & (height >= 0) & (height * height <= radius * radius * n2) & inside[0] & inside[1] & inside[2])
    near = {f"near_{a}": f for a, f in zip("xyz", foot, strict=True)}
    return joined.withColumns(near | {"distance": F.abs(height) / F.sqrt(n2)}).select(*[p[c] for c in points.columns], RIGHT + triangle_id, *near, "distance")


# --- scans in polar coordinates ------------------------------------------------------------------------------------------


def _bearing_cells(bearing: Column, size: float) -> Column:
    return F.floor((F.pmod(bearing + math.pi, F.lit(2 * math.pi))) / size).cast("long")


def changed_ids(reference: DataFrame, query: DataFrame, angle: float, id: str = "id", range_threshold: float | None = None) -> DataFrame:
    """(<id>, right_<id>, right_range): changed without the other columns, for which nothing but ids, directions and ranges is shuffled. Ids are integers."""
    from quillon.operators.near import enclosed

    found = enclosed(query, None if reference is query else reference, angle, id=id, range_threshold=range_threshold)
    return found.select(F.col("id").alias(id), F.col("right_id").alias(RIGHT + id), F.col("right_range").alias(RIGHT + "range"))


def changed(reference: DataFrame, query: DataFrame, angle: float, id: str = "id", range_threshold: float | None = None) -> DataFrame:
    """Query points (id, range, bearing, elevation; radians) that reference points enclose, with the reference point of the nearest range.

    Reference points count if they are less than angle away in bearing and elevation (bearing wraps at pi). A query point comes out if the
    bearings and the elevations of those lie on either side of its own; with range_threshold it is dropped if any of them is nearer
    than its range plus the threshold. Adds right_<columns>. Ties: the least reference id. Nulls match nothing.
    Pairs are made only for ids that are no integers, or angles of more than a quarter turn.
    """
    if angle <= math.pi / 2 and all(df.schema[id].dataType.typeName() in ("byte", "short", "integer", "long") for df in (reference, query)):
        found = changed_ids(reference, query, angle, id, range_threshold).select(F.col(id).alias("_q"), F.col(RIGHT + id).alias("_r"))
        used = ["range", "bearing", "elevation"]
        theirs = reference.dropna(subset=used).dropDuplicates([id]).withColumnsRenamed({c: RIGHT + c for c in reference.columns})
        out = found.join(theirs, F.col("_r") == F.col(RIGHT + id)).join(query.dropna(subset=used).dropDuplicates([id]), F.col("_q") == F.col(id))
        return out.select(*query.columns, *theirs.columns)
    count = max(1, int(math.floor(2 * math.pi / angle)))
    size = 2 * math.pi / count
    b_cell = F.pmod(_bearing_cells(F.col("bearing"), size), F.lit(count))
    q = query.dropna(subset=["range", "bearing", "elevation"]).withColumns({"_b": b_cell, "_e": cell("elevation", size)})
    r = reference.dropna(subset=["range", "bearing", "elevation"]).withColumns({"_b": b_cell, "_e": cell("elevation", size)})
    r = r.withColumn("_b", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_b") + s, F.lit(count)) for s in (-1, 0, 1)])))).withColumn("_e", F.explode(F.array(*[F.col("_e") + s for s in (-1, 0, 1)])))
    r = r.withColumnsRenamed({c: RIGHT + c for c in reference.columns})
    turn = F.pmod(F.col(RIGHT + "bearing") - F.col("bearing") + math.pi, F.lit(2 * math.pi)) - math.pi
    rise = F.col(RIGHT + "elevation") - F.col("elevation")
    near = q.join(r, ["_b", "_e"]).withColumns({"_turn": turn, "_rise": rise}).filter((F.abs("_turn") < angle) & (F.abs("_rise") < angle))
    best = F.min_by(F.struct(*[F.col(RIGHT + c) for c in reference.columns]), F.struct(RIGHT + "range", RIGHT + id))
    own = F.first(F.struct(*[F.col(c) for c in query.columns]))
    sums = near.groupBy(F.col(id).alias("_q")).agg(own.alias("_own"), best.alias("_best"), F.min("_turn").alias("_t0"), F.max("_turn").alias("_t1"), F.min("_rise").alias("_r0"), F.max("_rise").alias("_r1"), F.min(RIGHT + "range").alias("_near"))
    keep = sums.filter("_t0 <= 0 and _t1 >= 0 and _r0 <= 0 and _r1 >= 0")
    if range_threshold is not None:
        keep = keep.filter(F.col("_near") >= F.col("_own.range") + range_threshold)
    return keep.select("_own.*", "_best.*")


def first_on_ray(points: DataFrame, angle: float, id: str = "id", keys: Sequence[str] = ("block",)) -> DataFrame:
    """Each point (range, bearing, elevation) with right_<id> and right_range of the nearest-range point of its block on the same ray, itself if none.

    On the same ray: less than angle away along the great circle, and of smaller range. Ties: the least id. A null coordinate: itself.
    """
    cut = math.cos(angle)
    axes = ["_ux", "_uy", "_uz"]
    unit = points.withColumns({"_ux": F.cos("elevation") * F.cos("bearing"), "_uy": F.cos("elevation") * F.sin("bearing"), "_uz": F.sin("elevation")})
    chord = 2 * math.sin(min(angle, math.pi) / 2) * (1 + 1e-9)
    slim = unit.select(id, *keys, "range", *axes)
    pairs = pairs_within(slim, slim, chord, axes, keys=keys).filter((F.col(RIGHT + "range") < F.col("range")) & (sum((F.col(a) * F.col(RIGHT + a) for a in axes), F.lit(0.0)) > cut))
    best = pairs.groupBy(F.col(id).alias("_id")).agg(F.min_by(F.struct(F.col(RIGHT + id), F.col(RIGHT + "range")), F.struct(RIGHT + "range", RIGHT + id)).alias("_best"))
    out = points.join(best, points[id] == best["_id"], "left")
    return out.select(*[points[c] for c in points.columns], F.coalesce(F.col("_best")[RIGHT + id], points[id]).alias(RIGHT + id), F.coalesce(F.col("_best")[RIGHT + "range"], points["range"]).alias(RIGHT + "range"))
