"""Voxels: aggregation, indices, centroids, connected partitions and their tracking, grids and meshes.

points(block, id, x, y, z): names are parameters. Rows with a coordinate that is null, NaN or infinite are in no voxel and are left out where
points become voxels. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.near import connected
from quillon.operators.spatial_join import _finite, cell, with_cells, with_neighbour_cells
from quillon.plans.partitioning import chunked, cut_lineage, label_rounds, linked, lookup_join, ordered_scan, own, running

XYZ = ("x", "y", "z")


def to_voxels(points: DataFrame, resolution: float, axes: Sequence[str] = XYZ, keys: Sequence[str] = ("block",), origin: Sequence[float] | None = None, min_size: int = 1, centers: bool = False, reach: int = 0) -> DataFrame:
    """One row for each voxel of a block: keys, i0.. (its index), mean_<axis> (or, with centers, the voxel's centre), size >= min_size.

    reach: sizes and size-weighted means over the (2 reach + 1)^d voxels about each. Partial sums are made before the shuffle.
    """
    n = len(axes)
    cells = [f"_i{k}" for k in range(n)]
    placed = with_cells(points.filter(_finite(axes)), axes, resolution, origin)
    sums = placed.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col(a).cast("double")).alias(f"_s{k}") for k, a in enumerate(axes)])
    if reach:
        own = sums.select(*keys, *cells, F.col("size").alias("_own"))
        about = with_neighbour_cells(sums, n, reach).groupBy(*keys, *cells).agg(F.sum("size").alias("size"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(n)])
        sums = about.join(own, [*keys, *cells], "left_semi")
    o = origin or [0.0] * n
    middle = [(F.col(c) + 0.5) * resolution + o[k] if centers else F.col(f"_s{k}") / F.col("size") for k, c in enumerate(cells)]
    return sums.filter(F.col("size") >= min_size).select(*keys, *[F.col(c).alias(f"i{k}") for k, c in enumerate(cells)], *[v.alias(f"mean_{a}") for a, v in zip(axes, middle, strict=True)], "size")


def voxel_indices(points: DataFrame, resolution: float, axes: Sequence[str] = XYZ, origin: Sequence[float] | None = None, counts: Sequence[int] | None = None, discard: bool = False) -> DataFrame:
    """Add i0, i1, i2; with counts (voxels along each axis) also voxel, their number (k * sy + j) * sx + i. Points outside the counts are dropped with discard, else an error."""
    n = len(axes)
    out = points.withColumns({f"i{k}": cell(a, resolution, (origin or [0.0] * n)[k]) for k, a in enumerate(axes)})
    if counts is None:
        return out
    inside, number = F.lit(True), F.lit(0).cast("long")
    for k in reversed(range(n)):
        number = number * counts[k] + F.col(f"i{k}")
    for k in range(n):
        inside = inside & (F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < counts[k])
    inside = F.coalesce(inside, F.lit(False))
    if discard:
        return out.filter(inside).withColumn("voxel", number)
    return out.withColumn("voxel", F.when(inside, number).otherwise(F.raise_error(F.lit("a point lies outside the extents")).cast("long")))


def centroids(points: DataFrame, order: Sequence[str], axes: Sequence[str] = XYZ, keys: Sequence[str] = ("block", "id"), output_size: bool = False) -> DataFrame:
    """One row for each block and id: mean coordinates, other columns from its first row; output_size adds size, the largest extent along an axis."""
    rest = [c for c in points.columns if c not in (*axes, *keys)]
    placed = points.filter(_finite(axes))
    first = F.min_by(F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None), F.struct(*order)).alias("_first")
    extent = F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(0.0))
    out = placed.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in axes], first, extent.alias("size"))
    chosen = [F.col(c) for c in (*keys, *axes)] + [F.col("_first")[c].alias(c) for c in rest] + ([F.col("size")] if output_size else [])
    return out.select(*chosen)


def components(nodes: DataFrame, links: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components by the least node, for links(a, b) in either direction or one.

    Integer nodes are joined inside tasks (linked), others in rounds (label_rounds).
    """
    ends, between = nodes.select(F.col(node).alias("node")).distinct(), links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if any(df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long") for df, c in ((ends, "node"), (between, "a"), (between, "b"))):
        return label_rounds(ends, between).select(F.col("node").alias(node), "component")
    kind = ends.schema["node"].dataType
    found = ends.join(linked(between).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return found.select(F.col("node").alias(node), F.coalesce("component", "node").cast(kind).alias("component"))


def partitions(points: DataFrame, resolution: float, axes: Sequence[str] = XYZ, keys: Sequence[str] = ("block",), min_points_per_voxel: int = 1, min_voxels: int = 1, min_points: int = 1, min_density: float = 0.0, largest: int | None = None, min_id: int = 0, flag: str | None = None, output_all: bool = False) -> DataFrame:
    """Add partition: connected occupied voxels (touching by face, edge or corner), numbered from min_id in each block in order of their least voxel.

    A voxel is occupied with at least min_points_per_voxel points. Partitions need min_voxels, min_points, and points per voxel of at least
    min_density; with largest, only that many with the most points of a block stay (ties: the lower number). flag: a column; points where it is 0 or null belong to
    none. Points in no partition are dropped, or with output_all have a null partition.
    """
    n = len(axes)
    cells = [f"_i{k}" for k in range(n)]
    ok = _finite(axes) & (F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(True))
    placed = with_cells(points.filter(ok), axes, resolution)
    voxels = placed.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points_per_voxel)
    voxels = cut_lineage(voxels.withColumn("node", F.monotonically_increasing_id()))
    if n in (2, 3) and len(keys) <= 1 and all(voxels.schema[k].dataType.typeName() in ("byte", "short", "integer", "long") for k in keys):
        # Squares of the distances between touching voxels are 1 to 3, those of others at least 4.
        parts = connected(voxels.withColumn("_i2", F.lit(0)) if n == 2 else voxels, 1.8, id="node", group=keys[0] if keys else None, axes=("_i0", "_i1", "_i2"))
    else:
        mine = voxels.select(*keys, *cells, F.col("node").alias("a"))
        near = with_neighbour_cells(voxels.select(*keys, *cells, F.col("node").alias("b")), n)
        parts = components(voxels, mine.join(near, [*keys, *cells]).filter("a < b").select("a", "b"))
    labelled = parts.join(voxels.hint("merge"), "node")  # voxels take many times their compressed files in memory: the driver must not broadcast them
    sizes = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_v"), F.sum("_n").alias("_p"), F.min(F.struct(*cells)).alias("_first"))
    sizes = sizes.filter((F.col("_v") >= min_voxels) & (F.col("_p") >= min_points) & (F.col("_p") >= min_density * F.col("_v")))
    in_block = Window.partitionBy(*keys)
    if largest is not None:
        sizes = sizes.withColumn("_k", F.row_number().over(in_block.orderBy(F.desc("_p"), "_first"))).filter(F.col("_k") <= largest)
    numbered = sizes.withColumn("partition", F.row_number().over(in_block.orderBy("_first")).cast("long") - 1 + min_id)
    found = lookup_join(labelled.select("node", *keys, *cells, "component"), cut_lineage(numbered.select("component", "partition")), "component", "node").drop("component", "node")
    if output_all:
        return with_cells(points.withColumn("_ok", ok), axes, resolution).join(found, [*keys, *cells], "left").select(*points.columns, F.when(F.col("_ok"), F.col("partition")).alias("partition"))
    return placed.join(found, [*keys, *cells]).select(*points.columns, "partition")


def track_partitions(points: DataFrame, resolution: float, axes: Sequence[str] = XYZ, by: Sequence[str] = (), block: str = "block", partition: str = "partition") -> DataFrame:
    """Partitions of each block with tracked, an id carried on from the block before: (by, block, partition, tracked).

    A voxel belongs to the partition with the most points in it (ties: the least). A partition takes the id of that partition of the previous block
    with which it shares the most voxels (ties: the least id); if several want one id, the largest has it and the others get new ones.
    The votes are counted by joins; only they pass through the scan, in order of blocks.
    """
    cells = [f"_i{k}" for k in range(len(axes))]
    placed = with_cells(points.filter(_finite(axes) & F.col(partition).isNotNull()), axes, resolution)
    counts = placed.groupBy(*by, block, *cells, partition).agg(F.count(F.lit(1)).alias("_n"))
    voxels = counts.groupBy(*by, block, *cells).agg(F.min(F.struct((-F.col("_n")).alias("_k"), F.col(partition))).alias("_m")).select(*by, block, *cells, F.col("_m")[partition].alias(partition))
    blocks = voxels.select(*by, block).distinct().withColumn("_before", F.lag(block).over(Window.partitionBy(*by).orderBy(block)))
    now = voxels.join(blocks, [*by, block])
    old = voxels.withColumnsRenamed({block: "_before", partition: "_old"})
    votes = now.join(old, [*by, "_before", *cells]).groupBy(*by, block, partition, "_old").agg(F.count(F.lit(1)).alias("_votes"))
    sizes = counts.groupBy(*by, block, partition).agg(F.sum("_n").alias("_size"))
    per = sizes.join(votes, [*by, block, partition], "left").groupBy(*by, block, partition, "_size").agg(F.collect_list(F.when(F.col("_old").isNotNull(), F.struct(F.col("_votes").cast("long").alias("v"), F.col("_old").cast("long").alias("o")))).alias("_list"))
    rows = per.groupBy(*by, block).agg(F.collect_list(F.struct(F.col("_size").cast("long").alias("s"), F.col(partition).cast("long").alias("p"), F.col("_list").alias("l"))).alias("_parts"))
    schema = rows.drop("_parts").withColumns({"partition": F.lit(0).cast("long"), "tracked": F.lit(0).cast("long")}).schema

    def step(state, table: pa.Table):
        before, free = state or ({}, 0)
        heads = table.drop_columns(["_parts"])
        take, parts, ids = [], [], []
        for i, items in enumerate(table.column("_parts").to_pylist()):
            after: dict[int, int] = {}
            for item in sorted(items, key=lambda q: (-q["s"], q["p"])):
                best = max(((v["v"], -before[v["o"]]) for v in item["l"] if v["o"] in before), default=None)
                want = None if best is None else -best[1]
                if want is None or want in after.values():
                    want, free = free, free + 1
                after[item["p"]] = want
            before = after
            for p, t in sorted(after.items()):
                take.append(i)
                parts.append(p)
                ids.append(t)
        out = heads.take(pa.array(take, pa.int64())).append_column("partition", pa.array(parts, pa.int64())).append_column("tracked", pa.array(ids, pa.int64()))
        return (before, free), out

    if not by:
        rows = rows.withColumn("_all", F.lit(0))
        schema = rows.drop("_parts").withColumns({"partition": F.lit(0).cast("long"), "tracked": F.lit(0).cast("long")}).schema
        return ordered_scan(rows.select(block, "_all", "_parts"), ["_all"], [block], step, rows.select(block, "_all").withColumns({"partition": F.lit(0).cast("long"), "tracked": F.lit(0).cast("long")}).schema).drop("_all")
    return ordered_scan(rows, list(by), [block], step, schema)


def foreground(points: DataFrame, threshold: float, order: Sequence[str], keys: Sequence[str] = ("block",), range_: str = "range", min_points: int = 1) -> DataFrame:
    """Cut each block's scan at jumps in range: add segment (from 0) and kind: foreground, background, either or unknown.

    A jump up or down by more than threshold begins a segment. Between a rise and a fall lies background; between a fall and a rise foreground, if the segment has
    min_points, else either; between two rises or two falls either; before the first and after the last jump unknown.
    """
    laid, parts = chunked(points, keys, order)
    step = F.col(range_) - F.lag(range_).over(Window.partitionBy(*parts).orderBy(*order))
    jump = F.when(step > threshold, 1).when(step < -threshold, -1).otherwise(0)
    cut = running(own(laid.withColumn("_j", jump)), keys, order, F.abs("_j"), "segment").withColumn("segment", F.col("segment").cast("long")).drop("_chunk")
    rows = cut.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_j", F.abs("_j")).alias("_in"))
    rows = rows.withColumn("_out", F.lead("_in").over(Window.partitionBy(*keys).orderBy("segment")))
    kind = F.when((F.col("_in") == 0) | F.col("_out").isNull(), "unknown").when((F.col("_in") == 1) & (F.col("_out") == -1), "background").when((F.col("_in") == -1) & (F.col("_out") == 1) & (F.col("_n") >= min_points), "foreground").otherwise("either")
    kinds = rows.select(*keys, "segment", kind.alias("kind"))
    return cut.join(kinds, [*keys, "segment"]).select(*points.columns, "segment", "kind")


def spherical_cells(points: DataFrame, bearing_step: float, elevation_step: float, bearing: str = "bearing", elevation: str = "elevation") -> DataFrame:
    """Add bearing_cell (from -pi, wrapping) and elevation_cell (from -pi/2) of a spherical grid."""
    wrapped = F.pmod(F.col(bearing) + math.pi, F.lit(2 * math.pi))
    count = max(1, round(2 * math.pi / bearing_step))
    return points.withColumns({"bearing_cell": F.pmod(F.floor(wrapped / bearing_step), F.lit(count)).cast("long"), "elevation_cell": F.floor((F.col(elevation) + math.pi / 2) / elevation_step).cast("long")})


def grid_mesh(points: DataFrame, i: str = "i", j: str = "j", id: str = "id", keys: Sequence[str] = ("block",), permissive: bool = False) -> DataFrame:
    """Triangles (keys, a, b, c: ids) between points with neighbouring grid indices, two to a full square, one where a corner is missing.

    Two points at one index of a block are an error, or with permissive the one with the least id counts. Corners run anticlockwise. Each square
    is found by its corners' join on the square's index; nothing is compared with all.
    """
    grid = points.filter(F.col(i).isNotNull() & F.col(j).isNotNull()).groupBy(*keys, i, j).agg(F.min(id).alias("_id"), F.count(F.lit(1)).alias("_n"))
    if not permissive:
        grid = grid.withColumn("_id", F.when(F.col("_n") > 1, F.raise_error(F.lit("two points at one index")).cast("long")).otherwise(F.col("_id")))
    corners = F.array(*[F.struct((F.col(i) - di).alias("si"), (F.col(j) - dj).alias("sj"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    squares = grid.withColumn("_c", F.explode(corners)).groupBy(*keys, F.col("_c.si").alias("_si"), F.col("_c.sj").alias("_sj")).agg(*[F.max(F.when(F.col("_c.k") == k, F.col("_id"))).alias(f"_{k}") for k in range(4)])
    p = [F.col(f"_{k}") for k in range(4)]

    def triangle(*q: int) -> Column:
        return F.when(p[q[0]].isNotNull() & p[q[1]].isNotNull() & p[q[2]].isNotNull(), F.struct(p[q[0]].alias("a"), p[q[1]].alias("b"), p[q[2]].alias("c")))

    full = p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull() & p[3].isNotNull()
    made = F.when(full, F.array(triangle(0, 1, 2), triangle(0, 2, 3))).otherwise(F.array(triangle(0, 1, 2), triangle(0, 2, 3), triangle(0, 1, 3), triangle(1, 2, 3)))
    return squares.withColumn("_t", F.explode(F.array_compact(made))).select(*keys, "_t.a", "_t.b", "_t.c")
