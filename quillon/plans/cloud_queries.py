"""Queries of the point-cloud operators over the points table: joins, neighbourhoods, voxels, clusters, shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import algebra, neighbourhood, spatial_join, voxels
from quillon.plans.registry import Registry
from quillon.sources.messages import table

R = Registry()
XYZ = ("x", "y", "z")


def cloud(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """The usable points: id, block, x, y, z, scalar; each once, or as often as they are there, for what counts repeated rows once anyway."""
    p = table(spark, d, "points").select(F.col("point_id").alias("id"), "block", F.col("c0").alias("x"), F.col("c1").alias("y"), F.col("c2").alias("z"), F.col("scalar").cast("double").alias("scalar"))
    p = p.filter(spatial_join._finite(XYZ) & ~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))
    return p.distinct() if once else p


CLOUD = """cloud as (select distinct point_id as id, block, c0 as x, c1 as y, c2 as z, cast(scalar as double) as scalar from points
 where isfinite(c0) and isfinite(c1) and isfinite(c2) and not (c0 = 0 and c1 = 0 and c2 = 0))"""
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
STEPS = "(select unnest([-1, 0, 1]) di) s0, (select unnest([-1, 0, 1]) dj) s1, (select unnest([-1, 0, 1]) dk) s2"


def cells_sql(r: float, source: str = "cloud") -> str:
    return f"""e as (select *, cast(floor(x / {r}) as bigint) i, cast(floor(y / {r}) as bigint) j, cast(floor(z / {r}) as bigint) k from {source}),
w as (select e.*, i + di ni, j + dj nj, k + dk nk from e, {STEPS})"""


def pairs_sql(r: float, condition: str = "true", extra: str = "") -> str:
    """CTEs cloud, e, w and pairs(a_id, b_id, block, a_s, b_s, d2)."""
    return f"""{CLOUD}, {cells_sql(r)},
pairs as (select a.id a_id, b.id b_id, a.block, a.scalar a_s, b.scalar b_s, {D2} d2{extra} from w a join e b on a.block = b.block and a.ni = b.i and a.nj = b.j and a.nk = b.k
 where {D2} <= {r} * {r} and {condition})"""


#: Added before averages are rounded, whose exact values may lie half way.
OFF_TIES = 1.3e-9
NEAR = 0.5
SELF = {"axes": XYZ, "keys": ["block"]}


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# --- joins -------------------------------------------------------------------------------------------------------------


@R.add("j01_nearest", f"with {pairs_sql(NEAR, 'a.id <> b.id')} select a_id as id, arg_min(b_id, (d2, b_id)) as other, round(sqrt(min(d2)), 6) as distance from pairs group by 1")
def j01(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.nearest_ids(c, c, NEAR, "id", "id", ids=("differ", "id"), **SELF).select("id", F.col("right_id").alias("other"), rounded("distance").alias("distance"))


@R.add("j02_k_nearest", f"with {pairs_sql(NEAR, 'a.id <> b.id')}, n as (select a_id, b_id, d2, row_number() over (partition by a_id order by d2, b_id) rank from pairs) select a_id as id, b_id as other, cast(rank as integer) as rank, round(sqrt(d2), 6) as distance from n where rank <= 3")
def j02(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.nearest_ids(c, c, NEAR, "id", "id", k=3, ids=("differ", "id"), **SELF).select("id", F.col("right_id").alias("other"), "rank", rounded("distance").alias("distance"))


@R.add("j03_all_within", f"with {pairs_sql(NEAR, 'a.id < b.id')} select a_id as id, b_id as other, round(d2, 6) as distance2 from pairs")
def j03(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.pairs_within(c, c, NEAR, **SELF).filter("id < right_id").select("id", F.col("right_id").alias("other"), rounded("distance2").alias("distance2"))


@R.add("j04_count_within", f"with {pairs_sql(NEAR)} select id, coalesce(n, 0) as n from cloud left join (select a_id, count(*) n from pairs group by 1) on id = a_id")
def j04(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.count_within(c, c, NEAR, "id", **SELF).select("id", F.col("count").alias("n"))


@R.add("j05_count_cells", f"with {CLOUD}, {cells_sql(NEAR)}, s as (select block, i, j, k, count(*) n from e group by all), t as (select w.id, sum(s.n) n from w join s on w.block = s.block and w.ni = s.i and w.nj = s.j and w.nk = s.k group by 1) select id, cast(n as bigint) as n from t")
def j05(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.count_in_neighbour_cells(c, c, NEAR, XYZ, ["block"]).select("id", F.col("count").alias("n"))


@R.add("j06_matching", f"with {pairs_sql(NEAR, 'a.id <> b.id')} select distinct a_id as id from pairs")
def j06(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.matching(c, c, NEAR, ids=("differ", "id"), **SELF).select("id")


@R.add("j07_not_matching", f"with {pairs_sql(NEAR, 'a.id <> b.id')} select id from cloud where id not in (select a_id from pairs)")
def j07(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.matching(c, c, NEAR, negate=True, ids=("differ", "id"), **SELF).select("id")


@R.add("j08_row_radius", f"with {pairs_sql(NEAR, 'a.id <> b.id')} select a_id as id, count(*) as n from pairs where d2 <= (0.1 * (1 + a_id % 4)) * (0.1 * (1 + a_id % 4)) group by 1")
def j08(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("reach", 0.1 * (1 + F.col("id") % 4))
    return spatial_join.pairs_within(c, c, NEAR, row_radius="reach", ids=("differ", "id"), **SELF).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R.add("j09_min_radius", f"with {pairs_sql(NEAR)} select a_id as id, b_id as other from pairs where d2 >= 0.25 * 0.25")
def j09(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return spatial_join.pairs_within(c, c, NEAR, min_radius=0.25, **SELF).select("id", F.col("right_id").alias("other"))


@R.add("j10_same_class", f"with {pairs_sql(NEAR, 'a.id < b.id')} select a_id as id, b_id as other from pairs where a_id % 3 = b_id % 3")
def j10(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("class", F.col("id") % 3)
    return spatial_join.pairs_within(c, c, NEAR, ids=("equal", "class"), **SELF).filter("id < right_id").select("id", F.col("right_id").alias("other"))


@R.add("j11_facing_normals", f"with {pairs_sql(NEAR, 'a.id < b.id')} select a_id as id, b_id as other from pairs where (a_id % 7 - 3) * (b_id % 7 - 3) + (a_id % 5 - 2) * (b_id % 5 - 2) + 1 >= 0")
def j11(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumns({"nx": F.col("id") % 7 - 3, "ny": F.col("id") % 5 - 2, "nz": F.lit(1)})
    return spatial_join.pairs_within(c, c, NEAR, normals=["nx", "ny", "nz"], **SELF).filter("id < right_id").select("id", F.col("right_id").alias("other"))


@R.add("j12_across_blocks", f"with {CLOUD}, {cells_sql(0.2)} select a.id, b.id as other from w a join e b on a.ni = b.i and a.nj = b.j and a.nk = b.k where {D2} <= 0.2 * 0.2 and a.block < b.block")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Without blocks as keys: points of different blocks at one place."""
    c = cloud(spark, d)
    return spatial_join.pairs_within(c, c, 0.2, XYZ).filter("block < right_block").select("id", F.col("right_id").alias("other"))


TRIANGLES = "triangles as (select region_id as t, c0_min ax, c1_min ay, c2_min az, least(c0_max, c0_min + 100) bx, c1_min \"by\", c2_min bz, c0_min cx, least(c1_max, c1_min + 100) cy, least(c2_max, c2_min + 2) cz from regions)"


@R.add("j13_triangles", f"""with {CLOUD}, {TRIANGLES},
n as (select *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) nz from triangles),
h as (select id, n.*, x, y, z, nx * nx + ny * ny + nz * nz n2, nx * (x - ax) + ny * (y - ay) + nz * (z - az) hh from cloud, n where x between cx - 5 and bx + 5 and y between ay - 5 and cy + 5),
f as (select *, x - nx * hh / n2 fx, y - ny * hh / n2 fy, z - nz * hh / n2 fz from h where hh >= 0 and hh * hh <= 4 * n2),
s as (select *, nx * (("by" - ay) * (fz - az) - (bz - az) * (fy - ay)) + ny * ((bz - az) * (fx - ax) - (bx - ax) * (fz - az)) + nz * ((bx - ax) * (fy - ay) - ("by" - ay) * (fx - ax)) s1,
 nx * ((cy - "by") * (fz - bz) - (cz - bz) * (fy - "by")) + ny * ((cz - bz) * (fx - bx) - (cx - bx) * (fz - bz)) + nz * ((cx - bx) * (fy - "by") - (cy - "by") * (fx - bx)) s2,
 nx * ((ay - cy) * (fz - cz) - (az - cz) * (fy - cy)) + ny * ((az - cz) * (fx - cx) - (ax - cx) * (fz - cz)) + nz * ((ax - cx) * (fy - cy) - (ay - cy) * (fx - cx)) s3 from f)
select id, t as triangle, round(hh / sqrt(n2), 6) as distance from s where s1 >= -1e-12 * n2 and s2 >= -1e-12 * n2 and s3 >= -1e-12 * n2""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "regions")
    t = r.select(F.col("region_id").alias("t"), F.col("c0_min").alias("a_x"), F.col("c1_min").alias("a_y"), F.col("c2_min").alias("a_z"), F.least("c0_max", F.col("c0_min") + 100).alias("b_x"), F.col("c1_min").alias("b_y"), F.col("c2_min").alias("b_z"), F.col("c0_min").alias("c_x"), F.least("c1_max", F.col("c1_min") + 100).alias("c_y"), F.least("c2_max", F.col("c2_min") + 2).alias("c_z"))
    found = spatial_join.triangles_near(cloud(spark, d), t, 2.0, 145.0, XYZ, "t")
    return found.select("id", F.col("right_t").alias("triangle"), rounded("distance").alias("distance"))


@R.add("j14_strict", f"with {pairs_sql(NEAR)} select a_id as id, count(*) as n from pairs group by 1")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Every point matches itself at least, so the strict join passes."""
    c = cloud(spark, d)
    counted = spatial_join.pairs_within(c, c, NEAR, **SELF).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return spatial_join.strict(c, counted, "id").select("id", "n")


POLAR = f"""{CLOUD}, polar as (select id, block, round(sqrt(x * x + y * y + z * z), 6) r, round(atan2(y, x), 9) b, round(asin(z / sqrt(x * x + y * y + z * z)), 9) e from cloud)"""


def polar(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return cloud(spark, d, once).select("id", "block", F.round(r, 6).alias("range"), F.round(F.atan2("y", "x"), 9).alias("bearing"), F.round(F.asin(F.col("z") / r), 9).alias("elevation"))


@R.add("j17_changed")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Points enclosed, in bearing and elevation, by points of the whole cloud within half a thousandth of a radian."""
    p = polar(spark, d, once=False)
    return spatial_join.changed_ids(p, p, 0.0005).select("id", F.col("right_id").alias("reference"), F.col("right_range").alias("reference_range"))


@R.add("j18_rays", f"""with {POLAR}, u as (select *, cos(e) * cos(b) ux, cos(e) * sin(b) uy, sin(e) uz from polar),
c as (select *, cast(floor(ux / 0.004) as bigint) i, cast(floor(uy / 0.004) as bigint) j, cast(floor(uz / 0.004) as bigint) k from u), w as (select c.*, i + di ni, j + dj nj, k + dk nk from c, {STEPS}),
n as (select q.id, arg_min(p.id, (p.r, p.id)) pid, min(p.r) pr from w q join c p on q.block = p.block and q.ni = p.i and q.nj = p.j and q.nk = p.k where p.r < q.r and q.ux * p.ux + q.uy * p.uy + q.uz * p.uz > cos(0.002) group by 1)
select polar.id, coalesce(pid, polar.id) as first_id, coalesce(pr, r) as first_range from polar left join n on polar.id = n.id""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.first_on_ray(polar(spark, d), 0.002).select("id", F.col("right_id").alias("first_id"), F.col("right_range").alias("first_range"))


# --- neighbourhoods ------------------------------------------------------------------------------------------------------


@R.add("l01_nearest_other", f"with {pairs_sql(NEAR, 'a.id <> b.id')}, n as (select a_id, arg_min(b_id, (d2, b_id)) o, min(d2) d2 from pairs group by 1) select id, coalesce(o, id) as reference_id, coalesce(round(sqrt(d2), 6), 0.0) as distance from cloud left join n on id = a_id")
def l01(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.nearest_other(cloud(spark, d), NEAR, keys=["block"]).select("id", "reference_id", rounded("distance").alias("distance"))


def _extremum_sql(sign: str) -> str:
    return f"with {pairs_sql(NEAR, 'b.scalar is not null and not isnan(b.scalar)')}, n as (select a_id, min(({sign} b_s, d2, b_id)) m from pairs group by 1) select id, coalesce(m[3], id) as reference_id, coalesce(round(sqrt(m[2]), 6), 0.0) as distance from cloud left join n on id = a_id"


@R.add("l02_nearest_max", _extremum_sql("-"))
def l02(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.nearest_extremum(cloud(spark, d), NEAR, keys=["block"]).select("id", "reference_id", rounded("distance").alias("distance"))


@R.add("l03_nearest_min", _extremum_sql(""))
def l03(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.nearest_extremum(cloud(spark, d), NEAR, largest=False, keys=["block"]).select("id", "reference_id", rounded("distance").alias("distance"))


@R.add("l04_cell_max", f"with {CLOUD}, {cells_sql(NEAR)}, m as (select block, i, j, k, min((-scalar, id)) m from e where scalar is not null and not isnan(scalar) group by all), n as (select w.id, min(m.m) m from w join m on w.block = m.block and w.ni = m.i and w.nj = m.j and w.nk = m.k group by 1) select cloud.id, coalesce(n.m[2], cloud.id) as reference_id from cloud left join n on cloud.id = n.id")
def l04(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.cell_extremum(cloud(spark, d), NEAR, keys=["block"]).select("id", "reference_id")


@R.add("l05_extremum_records", f"with {pairs_sql(NEAR, 'b.scalar is not null and not isnan(b.scalar)')}, n as (select a_id, min((- b_s, d2, b_id)) m from pairs group by 1) select distinct coalesce(m[3], id) as id from cloud left join n on id = a_id")
def l05(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return neighbourhood.extremum_records(neighbourhood.nearest_extremum(c, NEAR, keys=["block"]), c).select("id")


@R.add("l06_local_max", f"""with {pairs_sql(NEAR)}, lose as (select distinct a_id from pairs where a_id <> b_id and (b_s > a_s or (b_s = a_s and b_id < a_id))),
n as (select a_id, arg_min(b_id, (d2, b_id)) o, min(d2) d2 from pairs where a_s is not null and b_s is not null and b_id not in (select a_id from lose) group by 1) select id, o as reference_id, coalesce(round(sqrt(d2), 6), 0.0) as distance from cloud left join n on id = a_id""")
def l06(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.local_extrema(cloud(spark, d), NEAR, keys=["block"]).select("id", "reference_id", rounded("distance").alias("distance"))


@R.add("l06_local_max_traced")
def l06t(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.local_extrema(cloud(spark, d), NEAR, keys=["block"], trace=True).select("id", "reference_id", rounded("distance").alias("distance"))


@R.add("l07_percentile", f"with {pairs_sql(NEAR, 'b.scalar is not null and not isnan(b.scalar)')}, r as (select a_id, b_s, row_number() over (partition by a_id order by b_s) k, count(*) over (partition by a_id) n from pairs) select id, b_s as percentile from cloud left join (select a_id, b_s from r where k = ceil(n * 0.75) and n >= 2) on id = a_id")
def l07(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.percentile_within(cloud(spark, d), NEAR, 0.75, keys=["block"], min_count=2).select("id", "percentile")


@R.add("l07_percentile_records", f"with {pairs_sql(NEAR, 'b.scalar is not null')}, r as (select a_id, b_id, row_number() over (partition by a_id order by b_s, b_id) k, count(*) over (partition by a_id) n from pairs) select id, case when id in (select b_id from r where k = ceil(n * 0.75)) then 1 else 0 end as flag from cloud")
def l07r(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.percentile_records(cloud(spark, d), NEAR, 0.75, keys=["block"]).select("id", "flag")


@R.add("l08_outliers", f"with {CLOUD}, {cells_sql(1.0)}, s as (select block, i, j, k from e group by all having count(*) >= 3) select id, case when exists (select 1 from w, s where w.id = cloud.id and w.block = s.block and w.ni = s.i and w.nj = s.j and w.nk = s.k) then 1 else 0 end as dense from cloud")
def l08(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.dense(cloud(spark, d), 1.0, 3, keys=["block"]).select("id", "dense")


@R.add("l09_nearest_to", f"with {CLOUD} select id, round(sqrt((x - 100.0) * (x - 100.0) + (y - 50.0) * (y - 50.0) + z * z), 6) as distance from cloud order by (x - 100.0) * (x - 100.0) + (y - 50.0) * (y - 50.0) + z * z, id limit 1")
def l09(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.nearest_to(cloud(spark, d), (100, 50, 0)).select("id", rounded("distance").alias("distance"))


@R.add("l10_thin", f"with {CLOUD}, {cells_sql(2.0)} select id from e qualify row_number() over (partition by block, i, j, k order by id) <= 2")
def l10(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.thin(cloud(spark, d), 2.0, ["id"], keys=["block"], per_voxel=2).select("id")


@R.add("l10_thin_rate", f"with {CLOUD}, {cells_sql(20.0)}, r as (select id, row_number() over (partition by block, i, j, k order by id) n from e) select id from r where floor((n + 2.0) / 4.0) > floor((n - 1 + 2.0) / 4.0)")
def l10r(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.thin(cloud(spark, d), 20.0, ["id"], keys=["block"], rate=0.25).select("id")


@R.add("l10_thin_id", f"with {CLOUD}, {cells_sql(20.0)} select id from e qualify row_number() over (partition by block, id % 5, i, j, k order by id) = 1")
def l10i(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.thin(cloud(spark, d).withColumn("class", F.col("id") % 5), 20.0, ["id"], keys=["block"], by_id="class").select("id")


@R.add("l10_thin_id_pass", f"with {CLOUD}, {cells_sql(20.0)} select id from e qualify first(id % 5) over (partition by block, i, j, k order by id) = id % 5")
def l10p(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.thin(cloud(spark, d).withColumn("class", F.col("id") % 5), 20.0, ["id"], keys=["block"], id_pass="class").select("id")


@R.add("l10_thin_block_pass", f"with {CLOUD}, {cells_sql(20.0)} select id from e qualify first(block) over (partition by id % 5, i, j, k order by id) = block")
def l10b(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.thin(cloud(spark, d).withColumn("class", F.col("id") % 5), 20.0, ["id"], block_pass=("class", "block")).select("id")


@R.add("l11_visit")
def l11(spark: SparkSession, d: str) -> DataFrame:
    """Regions of at most 5 m about the first point of each block, grown in steps of 1 m."""
    c = cloud(spark, d)
    seeds = c.groupBy("block").agg(F.min("id").alias("id")).select(F.col("block").alias("seed"), "id")
    return neighbourhood.visit(c, seeds, 1.0, radius=5.0, keys=["block"]).select("id", "visited_by")


@R.add("l11_visit_whole")
def l11_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole block, however far from the first point."""
    c = cloud(spark, d, once=False)
    seeds = c.groupBy("block").agg(F.min("id").alias("id")).select(F.col("block").alias("seed"), "id")
    return cloud(spark, d).select("id").join(neighbourhood.visit_parts(c, seeds, 1.0, keys=["block"]), "id", "left")


@R.add("l12_life")
def l12(spark: SparkSession, d: str) -> DataFrame:
    cells = spatial_join.with_cells(cloud(spark, d), XYZ, 4.0).select(F.col("_i0").alias("i"), F.col("_i1").alias("j"), F.col("_i2").alias("k"), F.lit(1).alias("weight"))
    return neighbourhood.life(cells, 2, 4, 6)


# --- voxels ------------------------------------------------------------------------------------------------------------


@R.add("v01_voxels", f"with {CLOUD}, {cells_sql(5.0)} select block, i as i0, j as i1, k as i2, round(avg(x) + 1.3e-9, 6) as mean_x, round(avg(y) + 1.3e-9, 6) as mean_y, round(avg(z) + 1.3e-9, 6) as mean_z, count(*) as size from e group by all having count(*) >= 2")
def v01(spark: SparkSession, d: str) -> DataFrame:
    v = voxels.to_voxels(cloud(spark, d), 5.0, min_size=2)
    return v.select("block", "i0", "i1", "i2", *[rounded(F.col(f"mean_{a}") + OFF_TIES).alias(f"mean_{a}") for a in XYZ], "size")


@R.add("v02_voxel_neighbourhood", f"with {CLOUD}, {cells_sql(5.0)}, s as (select block, i, j, k, count(*) n, sum(x) sx from e group by all), t as (select block, i + di i, j + dj j, k + dk k, sum(n) n, sum(sx) sx from s, {STEPS} group by all) select t.block, t.i as i0, t.j as i1, t.k as i2, round(t.sx / t.n + 1.3e-9, 6) as mean_x, cast(t.n as bigint) as size from t semi join s on t.block = s.block and t.i = s.i and t.j = s.j and t.k = s.k")
def v02(spark: SparkSession, d: str) -> DataFrame:
    return voxels.to_voxels(cloud(spark, d), 5.0, reach=1).select("block", "i0", "i1", "i2", rounded(F.col("mean_x") + OFF_TIES).alias("mean_x"), "size")


@R.add("v03_voxel_indices", f"with {CLOUD}, {cells_sql(5.0)} select id, i + 200 as i0, j + 200 as i1, k + 10 as i2, ((k + 10) * 1000 + j + 200) * 1000 + i + 200 as voxel from e where i between -200 and 799 and j between -200 and 799 and k between -10 and 9")
def v03(spark: SparkSession, d: str) -> DataFrame:
    return voxels.voxel_indices(cloud(spark, d), 5.0, origin=(-1000, -1000, -50), counts=(1000, 1000, 20), discard=True).select("id", "i0", "i1", "i2", "voxel")


@R.add("v03_voxel_indices_all", f"with {CLOUD}, {cells_sql(5.0)} select id, i as i0, j as i1, k as i2 from e")
def v03a(spark: SparkSession, d: str) -> DataFrame:
    """Of every point, wherever it lies."""
    return voxels.voxel_indices(cloud(spark, d), 5.0).select("id", "i0", "i1", "i2")


@R.add("v04_centroids", f"with {CLOUD} select block, id % 4 as class, round(avg(x) + 1.3e-9, 6) as x, round(avg(y) + 1.3e-9, 6) as y, round(avg(z) + 1.3e-9, 6) as z, min(id) as id, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) as size from cloud group by 1, 2")
def v04(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("class", F.col("id") % 4).drop("scalar")
    return voxels.centroids(c, ["id"], keys=("block", "class"), output_size=True).select("block", "class", *[rounded(F.col(a) + OFF_TIES).alias(a) for a in XYZ], "id", rounded("size").alias("size"))


@R.add("v05_partitions")
def v05(spark: SparkSession, d: str) -> DataFrame:
    return voxels.partitions(cloud(spark, d), 2.0, min_points=3).select("id", "block", "partition")


@R.add("v06_tracked_partitions")
def v06(spark: SparkSession, d: str) -> DataFrame:
    p = voxels.partitions(cloud(spark, d), 4.0, min_points=3).select("id", "block", *XYZ, "partition")
    return voxels.track_partitions(p, 4.0)


@R.add("v07_foreground", f"""with {POLAR}, j as (select *, r - lag(r) over (partition by block order by b, id) st from polar), c as (select *, case when st > 5 then 1 when st < -5 then -1 else 0 end ju from j), s as (select *, sum(abs(ju)) over (partition by block order by b, id rows unbounded preceding) seg from c),
g as (select block, seg, count(*) n, arg_max(ju, abs(ju)) din from s group by 1, 2), h as (select *, lead(din) over (partition by block order by seg) dout from g)
select s.id, cast(s.seg as bigint) as segment, case when din = 0 or dout is null then 'unknown' when din = 1 and dout = -1 then 'background' when din = -1 and dout = 1 and n >= 2 then 'foreground' else 'either' end as kind from s join h on s.block = h.block and s.seg = h.seg""")
def v07(spark: SparkSession, d: str) -> DataFrame:
    return voxels.foreground(polar(spark, d), 5.0, ["bearing", "id"], min_points=2).select("id", "segment", "kind")


@R.add("v08_k_means")
def v08(spark: SparkSession, d: str) -> DataFrame:
    """Four clusters of each block, from its first points."""
    c = cloud(spark, d).select("id", "block", *XYZ)
    from pyspark.sql import Window

    first = c.withColumn("cluster", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).filter("cluster < 4")
    return algebra.k_means(c, XYZ, first.select("block", "cluster", *XYZ), ["block"]).select("id", "cluster")


@R.add("v08_k_means_runs")
def v08r(spark: SparkSession, d: str) -> DataFrame:
    """Four clusters of each block, the best of ten random starts."""
    c = cloud(spark, d).select("id", "block", *XYZ)
    return algebra.k_means(c, XYZ, algebra.random_starts(c, XYZ, 4, ["block"]), ["block"]).select("id", "cluster")


@R.add("v10_normals")
def v10(spark: SparkSession, d: str) -> DataFrame:
    n = algebra.normals(cloud(spark, d), 1.0, keys=["block"])
    return n.select("id", *[rounded(c).alias(c) for c in ("normal_x", "normal_y", "normal_z", "curvature")])


@R.add("v10_regions")
def v10r(spark: SparkSession, d: str) -> DataFrame:
    return algebra.grow_regions(cloud(spark, d, once=False), None, 1.0, 0.2, keys=["block"])


@R.add("v10_statistical_outliers", f"""with {pairs_sql(1.0, 'a.id <> b.id')}, k as (select a_id, d2, row_number() over (partition by a_id order by d2, b_id) n from pairs), m as (select a_id, avg(sqrt(d2)) m from k where n <= 4 group by 1), l as (select avg(m) + stddev_samp(m) lim from m)
select id, round(m, 6) as mean_distance, coalesce(m > lim, true) as outlier from cloud cross join l left join m on id = a_id""")
def v10o(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("whole", F.lit(1))
    found = algebra.far_from_neighbours(c, 1.0, 4, 1.0, keys=["block"], over=["whole"])
    return found.select("id", rounded("mean_distance").alias("mean_distance"), "outlier")


@R.add("v11_spherical_grid", f"with {POLAR} select id, cast(floor((b + pi()) / (2 * pi() / 360)) % 360 as bigint) as bearing_cell, cast(floor((e + pi() / 2) / 0.02) as bigint) as elevation_cell from polar")
def v11(spark: SparkSession, d: str) -> DataFrame:
    return voxels.spherical_cells(polar(spark, d), 2 * math.pi / 360, 0.02).select("id", "bearing_cell", "elevation_cell")


@R.add("v12_grid_mesh", f"""with {CLOUD}, g as (select block, cast(floor(x / 5.0) as bigint) i, cast(floor(y / 5.0) as bigint) j, min(id) id from cloud group by all),
q as (select distinct block, i - di i, j - dj j from g, (select unnest([0, 1]) di) s0, (select unnest([0, 1]) dj) s1),
c as (select q.block, q.i, q.j, a.id p0, b.id p1, c.id p2, d.id p3 from q left join g a on a.block = q.block and a.i = q.i and a.j = q.j left join g b on b.block = q.block and b.i = q.i + 1 and b.j = q.j left join g c on c.block = q.block and c.i = q.i + 1 and c.j = q.j + 1 left join g d on d.block = q.block and d.i = q.i and d.j = q.j + 1)
select block, p0 as a, p1 as b, p2 as c from c where p0 is not null and p1 is not null and p2 is not null union all select block, p0, p2, p3 from c where p0 is not null and p2 is not null and p3 is not null
union all select block, p0, p1, p3 from c where p2 is null and p0 is not null and p1 is not null and p3 is not null union all select block, p1, p2, p3 from c where p0 is null and p1 is not null and p2 is not null and p3 is not null""")
def v12(spark: SparkSession, d: str) -> DataFrame:
    g = cloud(spark, d).withColumns({"i": spatial_join.cell("x", 5.0), "j": spatial_join.cell("y", 5.0)})
    return voxels.grid_mesh(g, permissive=True)


# --- shapes ------------------------------------------------------------------------------------------------------------

@R.add("f01_box", f"with {CLOUD} select id from cloud where x between 9.5 and 110.5 and y between -0.5 and 50.5 and z between -5.5 and 5.5")
def f01(spark: SparkSession, d: str) -> DataFrame:
    low, high = V.box_from(begin=(10, 0, -5), size=(100, 50, 10))
    return cloud(spark, d).filter(V.in_box(V.vec(""), low, high, inflate=0.5)).select("id")


@R.add("f02_planes", f"with {CLOUD} select id from cloud where x <= 100 and -x <= 0 and 0.6 * x + 0.8 * y <= 60 and -y <= 10 and z <= 3")
def f02(spark: SparkSession, d: str) -> DataFrame:
    planes = [((1, 0, 0), 100), ((-1, 0, 0), 0), ((0.6, 0.8, 0), 60), ((0, -2, 0), 20), ((0, 0, 1), 3)]
    return cloud(spark, d).filter(V.in_planes(V.vec(""), planes)).select("id")


@R.add("f03_prism", f"with {CLOUD} select id from cloud where z between -1 and 4 and y >= 0 and x + y <= 100 and x >= 0")
def f03(spark: SparkSession, d: str) -> DataFrame:
    planes = V.prism_planes([(0, 0, -1), (100, 0, -1), (0, 100, -1)], (0, 0, 5))
    return cloud(spark, d).filter(V.in_planes(V.vec(""), planes, inflate=1e-9)).select("id")


RING = [(0.0, 0.0), (120.0, 10.0), (60.0, 40.0), (110.0, 100.0), (-20.0, 80.0)]


def _ring_sql() -> str:
    out = []
    for (a, b), (c, e) in zip(RING, [*RING[1:], RING[0]], strict=True):
        out.append(f"(case when ({b} > y) <> ({e} > y) and x < ({c} - {a}) * (y - {b}) / ({e} - {b}) + {a} then 1 else 0 end)")
    return " + ".join(out)


@R.add("f04_polygon", f"with {CLOUD} select id, ({_ring_sql()}) % 2 = 1 as inside from cloud")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).select("id", V.in_polygon(F.col("x"), F.col("y"), RING).alias("inside"))


@R.add("f05_spheres", f"with {CLOUD} select id, (x - 50) * (x - 50) + (y - 20) * (y - 20) + z * z <= 400 or x * x + y * y + z * z <= 900 as inside from cloud")
def f05(spark: SparkSession, d: str) -> DataFrame:
    flags = V.in_spheres(V.vec(""), [((50, 20, 0), 20), ((0, 0, 0), 30)])
    return cloud(spark, d).select("id", V.all_or_any(flags, any_=True).alias("inside"))


@R.add("f06_box_flags", f"with {CLOUD} select id, case when x between 0 and 50 and y between 0 and 50 and z between -10 and 10 then 0 else 1 end as outside from cloud")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).select("id", (~V.in_box(V.vec(""), (0, 0, -10), (50, 50, 10))).cast("int").alias("outside"))


# --- groups of points ------------------------------------------------------------------------------------------------------


@R.add("m11_principal_axes")
def m11(spark: SparkSession, d: str) -> DataFrame:
    e = algebra.principal_axes(cloud(spark, d), XYZ, ["block"])
    return e.select("block", "rank", F.round("value", 4).alias("value"), F.transform("vector", lambda v: F.round(v, 4) + 0.0).alias("vector"))


@R.add("m12_planes")
def m12(spark: SparkSession, d: str) -> DataFrame:
    p = algebra.fit_plane(cloud(spark, d), XYZ, ["block"])
    return p.select("block", F.transform("normal", lambda v: F.round(v, 4) + 0.0).alias("normal"), F.round("rms", 4).alias("rms"))


@R.add("m13_align", f"with {CLOUD}, n as (select block from cloud group by 1 having count(*) > 2) select block, cast(5.0 as double) as tx, cast(-3.0 as double) as ty, cast(2.0 as double) as tz, cast(1.0 as double) as scale from n")
def m13(spark: SparkSession, d: str) -> DataFrame:
    """Each block against itself, shifted: the shift comes back."""
    c = cloud(spark, d).select("block", *XYZ, (F.col("x") + 5).alias("u"), (F.col("y") - 3).alias("v"), (F.col("z") + 2).alias("w"))
    a = algebra.align(c, XYZ, ["u", "v", "w"], ["block"], scaled=True)
    r, t, k = F.col("rotation"), F.col("translation"), F.col("scale")
    centre = c.groupBy("block").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(XYZ)])
    a = a.join(centre, "block")
    moved = [k * (r[3 * i] * F.col("m0") + r[3 * i + 1] * F.col("m1") + r[3 * i + 2] * F.col("m2")) + t[i] - F.col(f"m{i}") for i in range(3)]
    return a.select("block", *[rounded(v, 3).alias(n) for v, n in zip(moved, ("tx", "ty", "tz"), strict=True)], F.round(k, 6).alias("scale"))
