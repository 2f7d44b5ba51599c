"""What a point's neighbourhood says about it: extrema, percentiles, outliers, thinning, region growing, automata.

points(id, block, x, y, z, scalar): names are parameters. Points of different blocks never meet. Rows with a coordinate that is null or
NaN have no neighbours. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import voxels
from quillon.operators.near import connected
from quillon.operators.spatial_join import RIGHT, _finite, nearest_ids, pairs_within, with_cells, with_neighbour_cells
from quillon.plans.partitioning import cut_lineage, discard, lookup_join

XYZ = ("x", "y", "z")


def _self_pairs(points: DataFrame, radius: float, id: str, keys: Sequence[str], axes: Sequence[str], more: Sequence[str] = (), **options) -> DataFrame:
    slim = points.select(*dict.fromkeys([id, *keys, *axes, *more]))
    return pairs_within(slim, slim, radius, axes, keys=keys, **options)


def _attach(points: DataFrame, found: DataFrame, id: str, columns: dict[str, Column]) -> DataFrame:
    joined = points.join(found.withColumnRenamed(id, "_id"), F.col(id) == F.col("_id"), "left")
    return joined.select(*[points[c] for c in points.columns], *[v.alias(k) for k, v in columns.items()])


def nearest_other(points: DataFrame, radius: float, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ) -> DataFrame:
    """Add reference_id and distance of the nearest other point within the radius; the point itself and 0 if there is none. Ties: the least id."""
    slim = points.select(*dict.fromkeys([id, *keys, *axes]))
    best = nearest_ids(slim, slim, radius, id, id, axes=axes, keys=keys, ids=("differ", id)).withColumnRenamed(RIGHT + id, "_ref")
    return _attach(points, best, id, {"reference_id": F.coalesce("_ref", points[id]), "distance": F.coalesce("distance", F.lit(0.0))})


def nearest_extremum(points: DataFrame, radius: float, scalar: str = "scalar", largest: bool = True, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ) -> DataFrame:
    """Add reference_id and distance of the point with the largest (or least) scalar within the radius, itself included.

    Equal scalars: the nearest, then the least id. Points without a scalar refer to nothing but may ask; without any answer they refer to themselves.
    """
    pairs = _self_pairs(points, radius, id, keys, axes, [scalar]).filter(F.col(RIGHT + scalar).isNotNull() & ~F.isnan(F.col(RIGHT + scalar).cast("double")))
    value = -F.col(RIGHT + scalar) if largest else F.col(RIGHT + scalar)
    best = pairs.groupBy(id).agg(F.min(F.struct(value.alias("_v"), F.col("distance2"), F.col(RIGHT + id).alias("_ref"))).alias("_best"))
    return _attach(points, best, id, {"reference_id": F.coalesce(F.col("_best._ref"), points[id]), "distance": F.coalesce(F.sqrt("_best.distance2"), F.lit(0.0))})


def cell_extremum(points: DataFrame, radius: float, scalar: str = "scalar", largest: bool = True, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ, origin: Sequence[float] | None = None) -> DataFrame:
    """The fast form: add reference_id of the extremum in the 3^d cells about the point's own, no distance looked at. Equal scalars: the least id."""
    cells = [f"_i{k}" for k in range(len(axes))]
    placed = with_cells(points, axes, radius, origin)
    value = -F.col(scalar) if largest else F.col(scalar)
    usable = placed.filter(F.col(scalar).isNotNull() & ~F.isnan(F.col(scalar).cast("double")))
    by_cell = usable.groupBy(*keys, *cells).agg(F.min(F.struct(value.alias("_v"), F.col(id).alias("_ref"))).alias("_best"))
    about = with_neighbour_cells(by_cell, len(axes)).groupBy(*keys, *cells).agg(F.min("_best").alias("_best"))
    return placed.join(about, [*keys, *cells], "left").select(*points.columns, F.coalesce("_best._ref", id).alias("reference_id"))


def extremum_records(found: DataFrame, points: DataFrame, id: str = "id") -> DataFrame:
    """The records that nearest_extremum refers to, each once."""
    return points.join(found.select(F.col("reference_id").alias(id)).distinct(), id, "left_semi")


def local_extrema(points: DataFrame, radius: float, scalar: str = "scalar", largest: bool = True, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ, trace: bool = False) -> DataFrame:
    """Add reference_id and distance of the nearest local extremum within the radius; null and 0 if there is none.

    A local extremum has no point within the radius that is larger (of equal ones, the one with the least id remains). trace: references are
    followed: a point that has none refers to the extremum of its nearest point that has one, as far as the radius leads.
    """
    pairs = _self_pairs(points, radius, id, keys, axes, [scalar], ids=("differ", id))
    mine, other = F.col(scalar), F.col(RIGHT + scalar)
    beaten = (other > mine if largest else other < mine) | ((other == mine) & (F.col(RIGHT + id) < F.col(id)))
    losers = pairs.filter(beaten).select(id).distinct()
    usable = points.filter(F.col(scalar).isNotNull())
    extrema = usable.join(losers, id, "left_anti").select(F.col(id), *keys, *axes)
    slim = usable.select(id, *keys, *axes)
    best = nearest_ids(slim, extrema, radius, id, id, axes=axes, keys=keys).select(id, F.col(RIGHT + id).alias("_ref"), "distance")
    if not trace:
        return _attach(points, best, id, {"reference_id": F.col("_ref"), "distance": F.coalesce("distance", F.lit(0.0))})
    known = cut_lineage(best.select(id, "_ref"))
    links = cut_lineage(pairs.select(F.col(id), F.col(RIGHT + id).alias("_by"), "distance2"))
    while True:
        asked = links.join(known.select(id), id, "left_anti").join(known.withColumnsRenamed({id: "_by"}), "_by")
        more = asked.groupBy(id).agg(F.min(F.struct("distance2", "_by", "_ref")).alias("_b")).select(id, F.col("_b._ref").alias("_ref"))
        more = cut_lineage(more)
        if more.isEmpty():
            break
        old, known = known, cut_lineage(known.unionByName(more))
        discard(old, more)
    discard(links)
    places = points.select(F.col(id).alias("_ref"), *[F.col(a).alias(f"_{a}") for a in axes])
    out = points.join(known.withColumnRenamed(id, "_id"), points[id] == F.col("_id"), "left").join(places, "_ref", "left")
    d = V.distance([F.col(a) for a in axes], [F.col(f"_{a}") for a in axes])
    return out.select(*points.columns, F.col("_ref").alias("reference_id"), F.coalesce(d, F.lit(0.0)).alias("distance"))


def percentile_within(points: DataFrame, radius: float, p: float, scalar: str = "scalar", id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ, min_count: int = 1) -> DataFrame:
    """Add percentile: of the scalars within the radius (itself included) that of rank ceil(p n), the least for p = 0; null below min_count."""
    pairs = _self_pairs(points, radius, id, keys, axes, [scalar]).filter(F.col(RIGHT + scalar).isNotNull() & ~F.isnan(F.col(RIGHT + scalar).cast("double")))
    found = pairs.groupBy(id).agg(F.expr(f"percentile_disc({p}) within group (order by {RIGHT + scalar})").alias("_p"), F.count(F.lit(1)).alias("_n"))
    return _attach(points, found, id, {"percentile": F.when(F.col("_n") >= min_count, F.col("_p"))})


def percentile_records(points: DataFrame, radius: float, p: float, scalar: str = "scalar", id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ, min_count: int = 1) -> DataFrame:
    """The ids that are some point's percentile record (of equal scalars the least id of that rank), each once, with flag 1; other points have 0."""
    pairs = _self_pairs(points, radius, id, keys, axes, [scalar]).filter(F.col(RIGHT + scalar).isNotNull())
    w = Window.partitionBy(id)
    ranked = pairs.withColumns({"_k": F.row_number().over(w.orderBy(RIGHT + scalar, RIGHT + id)), "_n": F.count(F.lit(1)).over(w)})
    records = ranked.filter((F.col("_n") >= min_count) & (F.col("_k") == F.greatest(F.lit(1), F.ceil(F.col("_n") * p)))).select(F.col(RIGHT + id).alias(id)).distinct().withColumn("_hit", F.lit(1))
    return _attach(points, records, id, {"flag": F.coalesce("_hit", F.lit(0))})


def dense(points: DataFrame, resolution: float, size: int, keys: Sequence[str] = (), axes: Sequence[str] = XYZ, antialiasing: bool = True, discard: bool = False, origin: Sequence[float] | None = None) -> DataFrame:
    """Add dense: 1 if the point's cell, or with antialiasing any of the 3^d about it, has at least size points, else 0 (an outlier); discard drops outliers."""
    cells = [f"_i{k}" for k in range(len(axes))]
    placed = with_cells(points, axes, resolution, origin)
    counts = placed.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= size)
    if antialiasing:
        counts = with_neighbour_cells(counts, len(axes))
    good = counts.select(*keys, *cells).distinct()
    if discard:
        return placed.join(good, [*keys, *cells], "left_semi").select(*points.columns)
    return placed.join(good.withColumn("_good", F.lit(1)), [*keys, *cells], "left").select(*points.columns, F.coalesce("_good", F.lit(0)).alias("dense"))


def nearest_to(points: DataFrame, place: Sequence[float], axes: Sequence[str] = XYZ, id: str = "id") -> DataFrame:
    """The one point nearest to a place, with distance. Ties: the least id."""
    d = V.distance([F.col(a) for a in axes], V.point(*place))
    return points.dropna(subset=list(axes)).withColumn("distance", d).filter(~F.isnan("distance")).orderBy("distance", id).limit(1)


def thin(points: DataFrame, resolution: float, order: Sequence[str], axes: Sequence[str] = XYZ, keys: Sequence[str] = (), per_voxel: int | None = None, rate: float | None = None, by_id: str | None = None, id_pass: str | None = None, block_pass: tuple[str, str] | None = None) -> DataFrame:
    """Keep some points of each voxel (and block), in order; one rule at a time.

    per_voxel: the first so many. rate: that share, evenly spaced. by_id: the first of each id in a voxel. id_pass: all points of the id that came
    first in the voxel. block_pass: (id, block) columns; of each id and voxel all points of the block that came first (keys without block).
    """
    cells = [f"_i{k}" for k in range(len(axes))]
    placed = with_cells(points, axes, resolution)
    w = Window.partitionBy(*keys, *cells).orderBy(*order)
    if per_voxel is not None:
        kept = placed.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_voxel)
    elif rate is not None:
        every = 1 / rate
        k = F.col("_k")
        kept = placed.withColumn("_k", F.row_number().over(w)).filter(F.floor((k + every / 2) / every) > F.floor((k - 1 + every / 2) / every))
    elif by_id is not None:
        first = Window.partitionBy(*keys, by_id, *cells).orderBy(*order)
        kept = placed.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") == 1)
    elif id_pass is not None:
        kept = placed.withColumn("_k", F.first(id_pass).over(w)).filter(F.col("_k").eqNullSafe(F.col(id_pass)))
    elif block_pass is not None:
        i, b = block_pass
        first = Window.partitionBy(i, *cells).orderBy(*order)
        kept = placed.withColumn("_k", F.first(b).over(first)).filter(F.col("_k").eqNullSafe(F.col(b)))
    else:
        raise ValueError("thin needs a rule")
    return kept.select(*points.columns)


def visit(points: DataFrame, seeds: DataFrame, resolution: float, radius: float | None = None, field_of_view: float | None = None, absolute: bool = True, same_id: str | None = None, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ, normals: Sequence[str] | None = None) -> DataFrame:
    """Grow a region from each seed (seed, id of a point): points with visited_by, the last seed in order that reached them, null for none.

    A region goes on to points within resolution; not further than radius from the seed; within a cone of field_of_view about the seed's normal
    (absolute), or about the normal of the point it comes from; with same_id only to points of the seed's value in that column.
    Without radius and cone, regions are the connected parts of the points (visit_parts, where ids and keys are integers). Else each round is one join of the frontier with the neighbours, and a row
    is kept for each seed and point; lineage is cut in the shared folder.
    """
    more = list(dict.fromkeys([*(normals or ()), *([same_id] if same_id else [])]))
    if radius is None and (field_of_view is None or not normals) and not same_id and len(axes) == 3 and len(keys) <= 1 and all(points.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in (id, *keys)):
        found = visit_parts(points, seeds, resolution, id, keys, axes)
        return points.join(found.withColumnRenamed(id, "_at"), F.col(id) == F.col("_at"), "left").select(*[points[c] for c in points.columns], "visited_by")
    links = _self_pairs(points, resolution, id, keys, axes, more, ids=("differ", id))
    step = V.subtract([F.col(RIGHT + a) for a in axes], [F.col(a) for a in axes])
    if normals and field_of_view is not None and not absolute:
        links = links.filter(V.dot(step, [F.col(n) for n in normals]) >= math.cos(field_of_view / 2) * V.norm(step))
    if same_id:
        links = links.filter(F.col(same_id) == F.col(RIGHT + same_id))
    place = [f"_t{k}" for k in range(len(axes))]
    links = cut_lineage(links.select(F.col(id).alias("_from"), F.col(RIGHT + id).alias("_to"), *[F.col(RIGHT + a).alias(t) for a, t in zip(axes, place, strict=True)]))
    if radius is None and (field_of_view is None or not normals):
        # Every seed of a connected part reaches all of it, so its last seed is what counts.
        part = voxels.components(points.select(F.col(id).alias("node")).filter("node is not null"), links.select(F.col("_from").alias("a"), F.col("_to").alias("b")))
        last = seeds.select("seed", F.col(id).alias("node")).join(part, "node").groupBy("component").agg(F.max("seed").alias("visited_by"))
        found = part.join(last, "component").select(F.col("node").alias("_at"), "visited_by")
        return points.join(found, points[id] == found["_at"], "left").select(*[points[c] for c in points.columns], "visited_by")
    start = seeds.select("seed", id).join(points.select(id, *axes, *more), id)
    own = [f"_s{k}" for k in range(len(axes))]
    start = start.select("seed", F.col(id).alias("_at"), *[F.col(a).alias(s) for a, s in zip(axes, own, strict=True)], *[F.col(n).alias(f"_n{k}") for k, n in enumerate(normals or ())])
    state = ["seed", *own, *[f"_n{k}" for k in range(len(normals or ()))]]
    seen = frontier = cut_lineage(start)
    while True:
        reached = frontier.join(links, frontier["_at"] == links["_from"]).select(*state, F.col("_to").alias("_at"), *place)
        off = V.subtract([F.col(t) for t in place], [F.col(s) for s in own])
        if radius is not None:
            reached = reached.filter(V.dot(off, off) <= radius * radius)
        if normals and field_of_view is not None and absolute:
            reached = reached.filter(V.dot(off, [F.col(f"_n{k}") for k in range(len(normals))]) >= math.cos(field_of_view / 2) * V.norm(off))
        frontier = cut_lineage(reached.select(*state, "_at").dropDuplicates(["seed", "_at"]).join(seen.select("seed", "_at"), ["seed", "_at"], "left_anti").select(*seen.columns))
        if frontier.isEmpty():
            break
        old, seen = seen, cut_lineage(seen.unionByName(frontier))
        discard(old)
    discard(links)
    last = seen.groupBy("_at").agg(F.max("seed").alias("visited_by"))
    return points.join(last, points[id] == last["_at"], "left").select(*[points[c] for c in points.columns], "visited_by")


def visit_parts(points: DataFrame, seeds: DataFrame, resolution: float, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = XYZ) -> DataFrame:
    """(id, visited_by) of the points that visit without radius, cone and same_id reaches, found in leaves of k-d splits; repeated rows count once.

    Every seed of a connected part reaches all of it, so its last seed is what counts. A seed at a point without finite coordinates reaches that point only.
    """
    part = connected(points, resolution, id=id, group=keys[0] if keys else None, axes=tuple(axes))
    given = seeds.select("seed", F.col(id).alias("node"))
    last = cut_lineage(given.join(part, "node").groupBy("component").agg(F.max("seed").alias("visited_by")))
    placed = _finite(axes)
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    apart = points.filter(~F.coalesce(placed, F.lit(False)))
    alone = given.join(apart.select(F.col(id).alias("node")), "node").groupBy("node").agg(F.max("seed").alias("visited_by"))
    return lookup_join(part, last, "component", "node").select("node", "visited_by").unionByName(alone).withColumnRenamed("node", id)


def life(cells: DataFrame, generations: int, procreation: int, stability: int, step: int = 1, max_vitality: int = 1, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """A cellular automaton on cells(axes, weight): all generations, as (generation, axes, weight), from 0; ends early when nothing lives.

    A cell loses step if the weights of its neighbours sum to less than procreation or more than stability; gains step if their sum is nearer to
    procreation; and else keeps its weight. Weights stay from 0 (dead) to max_vitality.
    """
    names = [f"_i{k}" for k in range(len(axes))]
    now = cells.groupBy(*[F.col(a).cast("long").alias(n) for a, n in zip(axes, names, strict=True)]).agg(F.max(F.col("weight").cast("long")).alias("w"))
    now = cut_lineage(now.filter("w > 0"))
    out = now.withColumn("generation", F.lit(0))
    for g in range(1, generations + 1):
        spread = with_neighbour_cells(now, len(axes))
        sums = spread.groupBy(*names).agg(F.sum("w").alias("_all"))
        joined = sums.join(now, names, "left").withColumn("w", F.coalesce("w", F.lit(0)))
        around = F.col("_all") - F.col("w")
        change = F.when((around < procreation) | (around > stability), -step).when(around - procreation < stability - around, step).otherwise(0)
        now = cut_lineage(joined.select(*names, F.least(F.lit(max_vitality), F.col("w") + change).cast("long").alias("w")).filter("w > 0"))
        if now.isEmpty():
            break
        out = out.unionByName(now.withColumn("generation", F.lit(g)))
    return out.select("generation", *[F.col(n).alias(a) for a, n in zip(axes, names, strict=True)], F.col("w").alias("weight"))
