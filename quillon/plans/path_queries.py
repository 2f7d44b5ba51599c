"""Queries of the ordered, scalar, geodetic and graph operators over events, gps messages, embeddings and orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import geodesy as G
from quillon.functions import vectors as V
from quillon.operators import algebra, graph, time_align, trajectory
from quillon.plans.cloud_queries import CLOUD, POLAR, XYZ, cloud, polar, rounded
from quillon.plans.registry import Registry
from quillon.sources.messages import positioned, table, timed

R = Registry()
BY, ORDER = ["user_id"], ["ts", "event_id"]


def path(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as a path: x the value, y and z minute and second."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.col("value").alias("x"), F.minute("ts").cast("double").alias("y"), F.second("ts").cast("double").alias("z"))


PATH = "p as (select event_id, user_id, ts, value x, cast(minute(ts) as double) y, cast(second(ts) as double) z from events)"
OVER = "(partition by user_id order by ts, event_id)"
LAGS = f"{PATH}, l as (select *, lag(x) over w px, lag(y) over w py, lag(z) over w pz, lead(x) over w nx, lead(y) over w ny, lead(z) over w nz from p window w as {OVER})"
STEP = "sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz))"
AHEAD = "sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz))"


def out(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select("event_id", *[rounded(c).alias(k) for k, c in columns.items()])


@R.add("r01_distance", f"with {LAGS} select event_id, round(coalesce({STEP}, 0.0), 6) as distance from l")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.step_distance(path(spark, d), BY, ORDER), distance="distance")


@R.add("r02_distance_next", f"with {LAGS} select event_id, round(coalesce({AHEAD}, 0.0), 6) as distance from l")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.step_distance(path(spark, d), BY, ORDER, following=True), distance="distance")


@R.add("r03_distance_propagated", f"with {PATH}, l as (select *, abs(floor(x / 100) - lag(floor(x / 100)) over {OVER}) st from p) select event_id, coalesce(last_value(case when st > 0 then st end ignore nulls) over {OVER}, 0.0) as distance from l")
def r03(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).withColumn("c", F.floor(F.col("x") / 100).cast("double"))
    return out(trajectory.step_distance(p, BY, ORDER, ["c"], propagate=True), distance="distance")


@R.add("r04_distance_pairs", f"with {LAGS} select event_id, round({STEP}, 6) as distance from l where px is not null")
def r04(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy(*ORDER)
    p = path(spark, d).withColumns({f"p{a}": F.lag(a).over(w) for a in XYZ}).filter("px is not null")
    return out(p, distance=V.distance(V.vec("p", sep=""), V.vec("")))


@R.add("r05_path_length", f"with {LAGS} select event_id, round(sum(coalesce({STEP}, 0.0)) over {OVER} + 1.3e-9, 6) as distance from l")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.path_length(path(spark, d), BY, ORDER), distance=F.col("distance") + 1.3e-9)


@R.add("r06_angle_axis", f"""with {LAGS}, c as (select *, py * z - pz * y cx, pz * x - px * z cy, px * y - py * x cz, px * x + py * y + pz * z dt from l), s as (select *, sqrt(cx * cx + cy * cy + cz * cz) n from c)
select event_id, coalesce(round(case when n > 0 then atan2(n, dt) when dt < 0 then pi() else 0 end, 6), 0.0) as angle, coalesce(round(case when n > 0 then cx / n else 0 end, 6), 0.0) + 0.0 as axis_x from s""")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.turn_angle_axis(path(spark, d), BY, ORDER), angle="angle", axis_x="axis_x")


@R.add("r07_heading_change", f"""with {LAGS}, v as (select *, x - px ax, y - py ay, z - pz az, nx - x bx, ny - y b_y, nz - z bz from l), n as (select *, sqrt(ax * ax + ay * ay + az * az) na, sqrt(bx * bx + b_y * b_y + bz * bz) nb from v)
select event_id, round(coalesce(case when na > 1e-6 and nb > 1e-6 then acos(greatest(-1.0, least(1.0, (ax * bx + ay * b_y + az * bz) / (na * nb)))) end, 0.0), 6) as angle from n""")
def r07(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.heading_change(path(spark, d), BY, ORDER), angle="angle")


@R.add("r07_heading_no_repeats")
def r07n(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).withColumns({"c": F.floor(F.col("x") / 100).cast("double"), "e": F.floor(F.col("y") / 20).cast("double")})
    return out(trajectory.heading_change(p, BY, ORDER, ["c", "e"], reverse=True, ignore_repeats=True), angle="angle")


@R.add("r08_discretise", f"""with {PATH}, l as (select *, lead(x) over {OVER} nx from p), k as (select *, abs(nx - x) len, unnest(range(0, cast(greatest(0, coalesce(ceil((abs(nx - x) - 1e-9) / 40.0) - 1, 0)) as bigint) + 1)) k from l)
select event_id, round(case when k = 0 then x else x + (nx - x) * (k * 40.0 / len) end, 6) as at_x from k""")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.discretise(path(spark, d), BY, ORDER, ["x"], 40.0), at_x="at_x")


@R.add("r09_sample_path")
def r09(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.sample_path(path(spark, d), BY, ORDER, XYZ, 200.0), along="along", at_x="at_x", at_y="at_y", at_z="at_z")


@R.add("r10_thin_path")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.thin_path(path(spark, d), BY, ORDER, XYZ, 500.0).select("event_id")


@R.add("r11_chords", f"""with {LAGS}, c as (select *, row_number() over {OVER} rn, sum(coalesce({STEP}, 0.0)) over {OVER} s from l),
j as (select a.user_id, a.rn, b.rn r2, b.s - a.s arc, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) ch from c a join c b on a.user_id = b.user_id and b.rn > a.rn and b.s - a.s <= 600),
m as (select user_id, rn, max(r2) r2 from j where ch > 0 and arc <= 1.5 * ch group by 1, 2)
select event_id, coalesce(m.r2, c.rn) - c.rn as ahead from c left join m on c.user_id = m.user_id and c.rn = m.rn""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.chords(path(spark, d), BY, ORDER, XYZ, 1.5, 600.0).select("event_id", (F.col("to_row") - F.col("row")).cast("long").alias("ahead"))


@R.add("r11_chord_chain")
def r11c(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.chord_chain(trajectory.chords(path(spark, d), BY, ORDER, XYZ, 1.5, 600.0), BY).select("event_id", "row", "to_row")


@R.add("r12_direction_partitions")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.direction_partitions(path(spark, d), BY, ORDER, XYZ, math.pi / 2, 50.0).select("event_id", "partition")


@R.add("r13_plane_crossings", f"with {LAGS}, d as (select *, x - 250.0 d1, px - 250.0 d0 from l) select event_id, round(py + (y - py) * case when d0 = d1 then 1 else d0 / (d0 - d1) end, 6) as at_y, cast(sign(d1 - d0) as integer) as direction from d where d1 * d0 <= 0 and not (d0 = 0 and d1 <> 0)")
def r13(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.plane_crossings(path(spark, d), BY, ORDER, XYZ, (250, 0, 0), (1, 0, 0)).select("event_id", rounded("at_y").alias("at_y"), "direction")


@R.add("r14_integrate_frames")
def r14(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).select("event_id", "user_id", "ts", (F.col("x") / 100).alias("x"), (F.col("y") / 60).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("roll"), F.lit(0.01).alias("pitch"), (F.col("z") / 600).alias("yaw"))
    return out(trajectory.integrate_frames(p, BY, ORDER), x="x", y="y", z="z")


@R.add("r15_wayline_errors", f"""with {LAGS}, w as (select *, sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)) n from l where px is not null and nx is not null)
select event_id, round(((nx - px) * (y - py) - (ny - py) * (x - px)) / n, 6) as cross_track, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) <= 0.1 or ((nx - px) * (x - px) + (ny - py) * (y - py)) / n >= n as reached from w where n > 0""")
def r15(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy(*ORDER)
    p = path(spark, d).withColumns({"sx": F.lag("x").over(w), "sy": F.lag("y").over(w), "ex": F.lead("x").over(w), "ey": F.lead("y").over(w), "yaw": F.lit(0.0)}).filter("sx is not null and ex is not null and (sx <> ex or sy <> ey)")
    return trajectory.wayline_errors(p, ("sx", "sy"), ("ex", "ey")).select("event_id", rounded("cross_track").alias("cross_track"), "reached")


@R.add("r15_follow_waypoints")
def r15f(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).withColumn("yaw", F.lit(0.0))
    return trajectory.follow_waypoints(p, [(100, 10), (200, 30), (300, 50)], BY, ORDER, proximity=20.0).select("event_id", "target", rounded("cross_track").alias("cross_track"), "reached")


@R.add("r16_turn_speed")
def r16(spark: SparkSession, d: str) -> DataFrame:
    return out(trajectory.turn_speed(path(spark, d).withColumn("speed", F.lit(20.0)), BY, ORDER, "speed", 0.5, 1.0), speed="speed")


@R.add("r16_braking_speed", f"""with {LAGS}, s as (select *, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0)) over {OVER} dist from l)
select event_id, round(sqrt(greatest(0.0, min(z * z + 2 * 0.05 * dist) over (partition by user_id order by ts, event_id rows between current row and unbounded following) - 2 * 0.05 * dist)), 4) as speed from s""")
def r16b(spark: SparkSession, d: str) -> DataFrame:
    b = trajectory.braking_speed(path(spark, d).withColumn("speed", F.col("z")), BY, ORDER, "speed", 0.05)
    return b.select("event_id", F.round("speed", 4).alias("speed"))


@R.add("r17_pid")
def r17(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "error": (F.col("x") - 250) / 100})
    return out(trajectory.pid(p, BY, "t", "error", 1.0, 1e-4, 10.0, integral_limit=1e4), command="command")


@R.add("r18_carrots")
def r18(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d)
    feedback = p.select(F.col("event_id").alias("id"), "user_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))
    c = trajectory.carrots(feedback, p, BY, ORDER, 5.0, 1.5, 600.0)
    return c.select("id", "near_row", "carrot_row", rounded("carrot_x").alias("carrot_x"), rounded("carrot_y").alias("carrot_y"))


# --- time --------------------------------------------------------------------------------------------------------------


def _poses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """attitude messages as frames and optical_flow messages as points, by boot, in seconds."""
    boots = table(spark, d, "mavlink_boots")
    a = timed(table(spark, d, "mavlink_attitude_target_t").select("rec_id", "boot_id", "time_boot_ms", "q", "thrust"), boots, "time_boot_ms", milliseconds_from_boot=True).dropDuplicates(["boot_id", "rec_id"])
    a = a.filter(F.size("q") == 4)
    frames = a.select("boot_id", (F.col("moment") / 1e6).alias("t"), F.col("thrust").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), F.col("thrust").cast("double").alias("yaw")).dropna()
    f = timed(table(spark, d, "mavlink_optical_flow_t").select("rec_id", "boot_id", "time_usec"), boots).dropDuplicates(["boot_id", "rec_id"])
    return f.select("rec_id", "boot_id", (F.col("moment") / 1e6).alias("t")), frames


FRAMES = """a as (select distinct rec_id, boot_id, (boot_usec + 1000 * time_boot_ms) / 1e6 t, cast(thrust as double) x from mavlink_attitude_target_t join mavlink_boots using (boot_id) where boot_usec + 1000 * time_boot_ms between boot_usec and off_usec and len(q) = 4 and thrust is not null and not isnan(thrust)),
s as (select boot_id, t, max(x) x from a group by 1, 2), b as (select *, lead(t) over (partition by boot_id order by t) t2, lead(x) over (partition by boot_id order by t) x2 from s),
f as (select distinct rec_id, boot_id, time_usec / 1e6 t from mavlink_optical_flow_t join mavlink_boots using (boot_id) where time_usec <> 0 and time_usec between boot_usec and off_usec)"""


@R.add("t01_frame_interpolated", f"with {FRAMES} select rec_id, round(b.x + (coalesce(b.x2, b.x) - b.x) * case when b.t2 > b.t then (f.t - b.t) / (b.t2 - b.t) else 0 end, 5) as frame_x from f join b on f.boot_id = b.boot_id and f.t >= b.t and (f.t < b.t2 or f.t = b.t)")
def t01(spark: SparkSession, d: str) -> DataFrame:
    p, f = _poses(spark, d)
    return time_align.frame_at(p, f, ["boot_id"]).select("rec_id", rounded("frame_x", 5).alias("frame_x"))


@R.add("t02_frame_nearest", f"with {FRAMES} select rec_id, round(case when b.t2 > b.t and (f.t - b.t) / (b.t2 - b.t) > 0.5 then b.x2 else b.x end, 6) as frame_x from f join b on f.boot_id = b.boot_id and f.t >= b.t and (f.t < b.t2 or f.t = b.t)")
def t02(spark: SparkSession, d: str) -> DataFrame:
    p, f = _poses(spark, d)
    return time_align.frame_at(p, f, ["boot_id"], interpolate=False).select("rec_id", rounded("frame_x").alias("frame_x"))


@R.add("t03_frame_max_gap", f"with {FRAMES}, g as (select boot_id, t, x, case when t2 - t <= 8 then t2 end t2 from b) select rec_id from f join g on f.boot_id = g.boot_id and f.t >= g.t and (f.t < g.t2 or f.t = g.t)")
def t03(spark: SparkSession, d: str) -> DataFrame:
    p, f = _poses(spark, d)
    return time_align.frame_at(p, f, ["boot_id"], max_gap=8.0).select("rec_id")


@R.add("t04_out_of_order", f"with {FRAMES} select rec_id from f where not exists (select 1 from b where f.boot_id = b.boot_id and f.t >= b.t and (f.t < b.t2 or f.t = b.t))")
def t04(spark: SparkSession, d: str) -> DataFrame:
    p, f = _poses(spark, d)
    return p.join(time_align.frame_at(p, f, ["boot_id"]).select("rec_id"), "rec_id", "left_anti").select("rec_id")


@R.add("t05_points_in_frames")
def t05(spark: SparkSession, d: str) -> DataFrame:
    p, f = _poses(spark, d)
    framed = time_align.frame_at(p, f, ["boot_id"]).withColumns({"x": F.lit(2.0), "y": F.lit(1.0), "z": F.lit(0.5)})
    there = time_align.points_in_frames(framed)
    return there.select("rec_id", *[rounded(f"in_{a}", 5).alias(a) for a in XYZ])


@R.add("t06_frames_chained", f"with {FRAMES} select rec_id, cast(2.0 as double) as x, cast(1.0 as double) as y, cast(0.5 as double) as z from f join b on f.boot_id = b.boot_id and f.t >= b.t and (f.t < b.t2 or f.t = b.t)")
def t06(spark: SparkSession, d: str) -> DataFrame:
    """Into the frame's parent and back again."""
    p, f = _poses(spark, d)
    framed = time_align.frame_at(p, f, ["boot_id"]).withColumns({"x": F.lit(2.0), "y": F.lit(1.0), "z": F.lit(0.5)})
    there = time_align.points_in_frames(framed)
    back = time_align.points_in_frames(there.drop("x", "y", "z").withColumnsRenamed({f"in_{a}": a for a in XYZ}), inverse=True)
    return back.select("rec_id", *[rounded(f"in_{a}").alias(a) for a in XYZ])


SECONDS = f"p as (select event_id, user_id, ts, cast(epoch_us(ts) as double) / 1e6 t from events), e as (select *, coalesce(t - lag(t) over {OVER} - 3600, 0.0) e from p), s as (select *, sum(e) over {OVER} s from e)"


@R.add("t07_clocked", f"with {SECONDS} select event_id, round(t - (s - least(0.0, min(s) over (partition by user_id order by ts, event_id rows unbounded preceding))), 3) as adjusted from s")
def t07(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return time_align.clocked(p, BY, ORDER, "t", 3600.0).select("event_id", F.round("adjusted", 3).alias("adjusted"))


@R.add("t08_periodic")
def t08(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return time_align.periodic(p, BY, ORDER, "t", 3600.0, 1800.0).select("event_id", F.round("adjusted", 3).alias("adjusted"))


@R.add("t11_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def t11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


# --- vectors -----------------------------------------------------------------------------------------------------------

UVW = f"{CLOUD}, l as (select id, x ux, y uy, z uz, lag(x) over (partition by block order by id) vx, lag(y) over (partition by block order by id) vy, lag(z) over (partition by block order by id) vz, lead(x) over (partition by block order by id) wx, lead(y) over (partition by block order by id) wy, lead(z) over (partition by block order by id) wz from cloud), t as (select * from l where vx is not null and wx is not null)"


def uvw(spark: SparkSession, d: str) -> DataFrame:
    """Points with the one before and after in their block, by id."""
    w = Window.partitionBy("block").orderBy("id")
    c = cloud(spark, d)
    rows = c.select("id", *[F.col(a).alias(f"u{a}") for a in XYZ], *[F.lag(a).over(w).alias(f"v{a}") for a in XYZ], *[F.lead(a).over(w).alias(f"w{a}") for a in XYZ])
    return rows.filter("vx is not null and wx is not null")


U, W_, V_ = (lambda: V.vec("u", sep="")), (lambda: V.vec("w", sep="")), (lambda: V.vec("v", sep=""))


def vout(df: DataFrame, digits: int = 4, **columns: Column) -> DataFrame:
    return df.select("id", *[rounded(c, digits).alias(k) for k, c in columns.items()])


def xyz(values: list[Column]) -> dict[str, Column]:
    return dict(zip(("x", "y", "z"), values, strict=True))


@R.add("m01_rotate", f"with {CLOUD} select id, round(x * cos(0.3) - y * sin(0.3), 4) + 0.0 as x, round(x * sin(0.3) + y * cos(0.3), 4) + 0.0 as y, round(z, 4) + 0.0 as z from cloud")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return vout(cloud(spark, d), **xyz(V.rotate(V.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.3)), V.vec(""))))


@R.add("m02_rotation_convert", f"with {CLOUD} select id, cast(0.1 as double) as roll, cast(-0.2 as double) as pitch, round(atan2(sin(id / 1000.0), cos(id / 1000.0)), 6) as yaw from cloud")
def m02(spark: SparkSession, d: str) -> DataFrame:
    """euler to quaternion to axis-angle to scaled-axis-angle to matrix to euler."""
    df = cloud(spark, d).select("id", F.lit(0.1).alias("a0"), F.lit(-0.2).alias("a1"), (F.col("id") / 1000.0).alias("a2"))
    chain = ["euler", "quaternion", "axis-angle", "scaled-axis-angle", "matrix", "euler"]
    n = 3
    for source, target in zip(chain, chain[1:], strict=False):
        values = V.convert_rotation(source, target, [F.col(f"a{i}") for i in range(n)])
        n = len(values)
        df = df.select("id", F.array(*values).alias("v")).select("id", *[F.col("v")[i].alias(f"a{i}") for i in range(n)])
    return df.select("id", *[rounded(f"a{i}").alias(c) for i, c in enumerate(("roll", "pitch", "yaw"))])


VECTOR = f"""with {UVW}, c as (select *, uy * vz - uz * vy cx, uz * vx - ux * vz cy, ux * vy - uy * vx cz, sqrt(ux * ux + uy * uy + uz * uz) n from t)
select id, round(ux + vx, 4) as add_x, round(ux - vx, 4) + 0.0 as sub_x, round(vy * uz - vz * uy + 1.3e-7, 3) + 0.0 as cross_x, round(ux * vx + uy * vy + uz * vz + 1.3e-7, 3) + 0.0 as dot, round(n, 4) as norm, round(n * n + 1.3e-7, 3) as square, round(1 / n, 6) as inverse, round(3 * ux / n, 6) + 0.0 as unit_x, round(uy * 2.5, 4) + 0.0 as scale_y from c"""


@R.add("m03_vectors", VECTOR)
def m03(spark: SparkSession, d: str) -> DataFrame:
    u, v = U(), V_()
    return uvw(spark, d).select(
        "id", rounded(V.add(u, v)[0], 4).alias("add_x"), rounded(V.subtract(u, v)[0], 4).alias("sub_x"), rounded(V.cross(v, u)[0] + 1.3e-7, 3).alias("cross_x"), rounded(V.dot(u, v) + 1.3e-7, 3).alias("dot"), rounded(V.norm(u), 4).alias("norm"), rounded(V.norm(u, square=True) + 1.3e-7, 3).alias("square"),
        rounded(V.norm(u, invert=True)).alias("inverse"), rounded(V.normalize(u, 3.0)[0]).alias("unit_x"), rounded(V.scale(u, F.lit(2.5))[1], 4).alias("scale_y"),
    )


@R.add("m03_normals", f"""with {UVW}, a as (select *, ux - vx ax, uy - vy ay, uz - vz az, wx - vx bx, wy - vy b_y, wz - vz bz from t), n as (select *, ay * bz - az * b_y nx, az * bx - ax * bz ny, ax * b_y - ay * bx nz from a), s as (select *, sqrt(nx * nx + ny * ny + nz * nz) n from n)
select id, round(nx / n, 4) + 0.0 as x, round(ny / n, 4) + 0.0 as y, round(nz / n, 4) + 0.0 as z from s where n > 1e-3""")
def m03n(spark: SparkSession, d: str) -> DataFrame:
    u, v, w = U(), V_(), W_()
    flat = V.norm(V.cross(V.subtract(u, v), V.subtract(w, v)))
    return vout(uvw(spark, d).filter(flat > 1e-3), **xyz(V.normal(u, v, w)))


@R.add("m04_polar", f"with {CLOUD} select id, round(sqrt(x * x + y * y + z * z), 4) as r, round(atan2(y, x), 6) + 0.0 as b, round(pi() / 2 - acos(z / sqrt(x * x + y * y + z * z)), 6) + 0.0 as e from cloud")
def m04(spark: SparkSession, d: str) -> DataFrame:
    r, b, e = V.to_polar(V.vec(""))
    return cloud(spark, d).select("id", rounded(r, 4).alias("r"), rounded(b).alias("b"), rounded(e).alias("e"))


@R.add("m04_cartesian", f"with {POLAR} select id, round(r * cos(e) * cos(b), 3) + 0.0 as x, round(r * cos(e) * sin(b), 3) + 0.0 as y, round(r * sin(e), 3) + 0.0 as z from polar")
def m04c(spark: SparkSession, d: str) -> DataFrame:
    return vout(polar(spark, d), 3, **xyz(V.to_cartesian(F.col("range"), F.col("bearing"), F.col("elevation"))))


@R.add("m05_degrees", f"with {POLAR} select id, round(degrees(b), 6) as degrees, round(radians(r), 6) as radians from polar")
def m05(spark: SparkSession, d: str) -> DataFrame:
    return polar(spark, d).select("id", F.round(F.degrees("bearing"), 6).alias("degrees"), F.round(F.radians("range"), 6).alias("radians"))


@R.add("m06_project_plane", f"with {CLOUD} select id, round(x - 0.6 * (0.6 * (x - 1) + 0.8 * z), 4) + 0.0 as x, round(z - 0.8 * (0.6 * (x - 1) + 0.8 * z), 4) + 0.0 as z, round(0.6 * (x - 1) + 0.8 * z, 4) + 0.0 as distance from cloud")
def m06(spark: SparkSession, d: str) -> DataFrame:
    p = V.project_on_plane(V.vec(""), V.point(1, 0, 0), V.point(3, 0, 4))
    return vout(cloud(spark, d), x=p[0], z=p[2], distance=p[3])


@R.add("m06_project_line", f"with {CLOUD}, s as (select *, (x * 10 + y * 5) / 125.0 s from cloud) select id, round(s * 10, 4) + 0.0 as x, round(s * 5, 4) + 0.0 as y, round(sqrt((x - s * 10) * (x - s * 10) + (y - s * 5) * (y - s * 5) + z * z), 4) as distance, case when s < 0 then -1 when s > 1 then 1 else 0 end as \"where\" from s")
def m06l(spark: SparkSession, d: str) -> DataFrame:
    p = V.project_on_line(V.vec(""), V.point(0, 0, 0), V.point(10, 5, 0))
    return cloud(spark, d).select("id", rounded(p[0], 4).alias("x"), rounded(p[1], 4).alias("y"), rounded(p[3], 4).alias("distance"), p[4].alias("where"))


@R.add("m07_line_plane", f"with {UVW} select id, round(ux + (vx - ux) * (1 - uz) / (vz - uz) + 1.3e-7, 3) + 0.0 as x, round(uy + (vy - uy) * (1 - uz) / (vz - uz) + 1.3e-7, 3) + 0.0 as y from t where abs(vz - uz) > 0.01")
def m07(spark: SparkSession, d: str) -> DataFrame:
    p = V.line_meets_plane(U(), V_(), V.point(0, 0, 1), V.point(0, 0, 1))
    return vout(uvw(spark, d).filter("abs(vz - uz) > 0.01"), 3, x=p[0] + 1.3e-7, y=p[1] + 1.3e-7)


@R.add("m08_lines_nearest")
def m08(spark: SparkSession, d: str) -> DataFrame:
    p = V.nearest_of_lines(U(), V_(), W_(), V.point(0, 0, 0))
    return vout(uvw(spark, d), 3, ax=p[0], ay=p[1], az=p[2], bx=p[3], by=p[4], bz=p[5])


@R.add("m09_triangle_area", f"""with {UVW}, a as (select *, vx - ux ax, vy - uy ay, vz - uz az, wx - ux bx, wy - uy b_y, wz - uz bz from t)
select id, round(sqrt((ay * bz - az * b_y) * (ay * bz - az * b_y) + (az * bx - ax * bz) * (az * bx - ax * bz) + (ax * b_y - ay * bx) * (ax * b_y - ay * bx)) / 2, 3) as area from a""")
def m09(spark: SparkSession, d: str) -> DataFrame:
    return vout(uvw(spark, d), 3, area=V.triangle_area(U(), V_(), W_()))


@R.add("m10_discretise_triangles")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of regions as triangles, each as points 20 m apart at most."""
    from quillon.operators.triangles import discretise

    r = table(spark, d, "regions").select(F.col("region_id").alias("id"), F.col("c0_min").alias("a_x"), F.col("c1_min").alias("a_y"), F.col("c2_min").alias("a_z"), F.least("c0_max", F.col("c0_min") + 100).alias("b_x"), F.col("c1_min").alias("b_y"), F.col("c2_min").alias("b_z"), F.col("c0_min").alias("c_x"), F.least("c1_max", F.col("c1_min") + 100).alias("c_y"), F.col("c2_min").alias("c_z"))
    return discretise(r, 20.0).select("id", *[rounded(a, 4).alias(a) for a in XYZ], "internal")


@R.add("m14_spectrum")
def m14(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy(*ORDER)
    rows = path(spark, d).withColumn("row", F.row_number().over(w) - 1)
    s = algebra.spectrum(rows, "x", "row", BY, 32, 0.5)
    return s.select("user_id", "bin", F.transform("spectrum", lambda v: F.round(v, 5) + 0.0).alias("spectrum"))


@R.add("m15_array_split", "select vec_id, part, [cast(x as double) for x in list_slice(embedding, part * 16 + 1, part * 16 + 16)] as embedding from (select vec_id, embedding, cast(unnest(range(0, 4)) as integer) part from embeddings)")
def m15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return algebra.array_split(e, "embedding", 16).select("vec_id", "part", "embedding")


@R.add("m15_array_transpose", "select vec_id, [cast(embedding[(cast(i as integer) % 8) * 8 + i // 8 + 1] as double) for i in range(0, 64)] as embedding from embeddings")
def m15t(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return algebra.array_transpose(e, "embedding", 8, 8)


@R.add("m15_array_operate", "select vec_id, [round(list_sum([cast(embedding[(i // 8) * 8 + j + 1] as double) for j in range(0, 8) if j <= i % 8]), 6) + 0.0 for i in range(0, 64)] as embedding from embeddings")
def m15o(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 arrays, summed up along their rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return algebra.array_operate(e, "embedding", (8, 8), lambda x: x.cumsum(axis=2)).select("vec_id", F.transform("embedding", lambda v: F.round(v, 6) + 0.0).alias("embedding"))


@R.add("m15_array_norm", "select vec_id, round(sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])), 6) as reduced from embeddings")
def m15n(spark: SparkSession, d: str) -> DataFrame:
    return algebra.array_reduce(table(spark, d, "embeddings"), "embedding", "norm").select("vec_id", F.round("reduced", 6).alias("reduced"))


# --- the earth ---------------------------------------------------------------------------------------------------------


def places(spark: SparkSession, d: str) -> DataFrame:
    """Gps messages with a position, each once, with the boot's first position."""
    g = table(spark, d, "mavlink_gps2_raw_t").filter(positioned()).select("rec_id", "boot_id", (F.col("lat") / 1e7).alias("lat"), (F.col("lon") / 1e7).alias("lon")).distinct()
    first = g.groupBy("boot_id").agg(F.min_by(F.struct("lat", "lon"), F.col("rec_id")).alias("f"))
    return g.join(first, "boot_id").select("rec_id", "boot_id", "lat", "lon", F.col("f.lat").alias("lat0"), F.col("f.lon").alias("lon0"))


PLACES = "g as (select distinct rec_id, boot_id, lat / 1e7 lat, lon / 1e7 lon from mavlink_gps2_raw_t where fix_type >= 2 and lat is not null and lon is not null and not (lat = 0 and lon = 0)), p as (select g.*, f.lat0, f.lon0 from g join (select boot_id, arg_min(lat, rec_id) lat0, arg_min(lon, rec_id) lon0 from g group by 1) f using (boot_id))"


@R.add("m16_ellipsoid_distance")
def m16(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).select("rec_id", *[F.radians(c).alias(c) for c in ("lat0", "lon0", "lat", "lon")])
    return G.ellipsoid_distance(p, "lat0", "lon0", "lat", "lon").select("rec_id", F.round("distance", 3).alias("distance"))


@R.add("m17_ellipsoid_circles")
def m17(spark: SparkSession, d: str) -> DataFrame:
    b = places(spark, d).select("boot_id", F.radians("lat0").alias("lat"), F.radians("lon0").alias("lon")).distinct().withColumn("radius", F.lit(1000.0))
    return G.ellipsoid_circle(b, "lat", "lon", "radius", 8).select("boot_id", "step", F.round(F.degrees("at_lat"), 8).alias("at_lat"), F.round(F.degrees("at_lon"), 8).alias("at_lon"))


@R.add("m18_utm_round_trip", f"with {PLACES} select rec_id, cast(floor((((lon + 180) % 360)) / 6) as integer) + 1 as zone, round(lat, 7) as lat, round(lon, 7) as lon from p")
def m18(spark: SparkSession, d: str) -> DataFrame:
    u = places(spark, d).withColumns(G.to_utm(F.col("lat"), F.col("lon"))).select("rec_id", "zone", "south", "easting", "northing")
    b = u.withColumns(G.from_utm(F.col("zone"), F.col("south"), F.col("easting"), F.col("northing")))
    return b.select("rec_id", "zone", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@R.add("m18_ned")
def m18n(spark: SparkSession, d: str) -> DataFrame:
    n, e, down = G.to_ned(F.col("lat"), F.col("lon"), F.lit(100.0), (-35.0, 149.0, 0.0))
    return places(spark, d).select("rec_id", F.round(n, 2).alias("north"), F.round(e, 2).alias("east"), F.round(down, 2).alias("down"))


@R.add("m19_great_circle", f"""with {PLACES}, r as (select rec_id, radians(lat0) a, radians(lat) b, radians(lon - lon0) d from p)
select rec_id, round(atan2(sqrt(pow(cos(b) * sin(d), 2) + pow(cos(a) * sin(b) - sin(a) * cos(b) * cos(d), 2)), sin(a) * sin(b) + cos(a) * cos(b) * cos(d)) * 6371000, 3) as distance from r""")
def m19(spark: SparkSession, d: str) -> DataFrame:
    a = G.arc(F.radians("lat0"), F.radians("lon0"), F.radians("lat"), F.radians("lon"))
    return places(spark, d).select("rec_id", F.round(a * 6371000, 3).alias("distance"))


@R.add("m19_along", f"with {PLACES} select rec_id, round(lat, 7) as lat, round(lon, 7) as lon from p")
def m19a(spark: SparkSession, d: str) -> DataFrame:
    """From the first position along the bearing by the arc to each: the place itself."""
    a = [F.radians(c) for c in ("lat0", "lon0", "lat", "lon")]
    la, lo = G.along(a[0], a[1], G.initial_bearing(*a), G.arc(*a))
    return places(spark, d).select("rec_id", F.round(F.degrees(la), 7).alias("lat"), F.round(F.degrees(lo), 7).alias("lon"))


@R.add("m20_sun")
def m20(spark: SparkSession, d: str) -> DataFrame:
    gps = table(spark, d, "mavlink_gps2_raw_t").select("rec_id", "boot_id", "time_usec", "lat", "lon", "fix_type").filter(positioned())
    t = timed(gps, table(spark, d, "mavlink_boots")).dropDuplicates(["boot_id", "rec_id"])
    az, el = G.sun_position(F.col("moment"), F.col("lat") / 1e7, F.col("lon") / 1e7)
    return t.select("rec_id", F.round(az, 3).alias("azimuth"), F.round(el, 3).alias("elevation"))


@R.add("m21_kalman")
def m21(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return out(algebra.kalman(p, BY, "t", "x", 4.0, 100.0), filtered="filtered", variance="variance")


@R.add("m21_gaussian_process")
def m21g(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*BY).orderBy(*ORDER)
    p = path(spark, d).withColumn("row", F.row_number().over(w).cast("double"))
    asked = p.select("user_id", (F.col("row") + 0.5).alias("row"))
    g = algebra.gaussian_process(p, asked, BY, "row", "x", 3.0, 100.0, 20.0)
    return g.select("user_id", "row", rounded("mean", 4).alias("mean"), rounded("variance", 4).alias("variance"))


@R.add("m22_colours", f"""with {CLOUD}, c as (select id, id % 256 r, (id * 7) % 256 g, (id * 13) % 256 b from cloud), y as (select *, 0.299 * r / 255.0 + 0.587 * g / 255.0 + 0.114 * b / 255.0 y from c)
select id, round(y, 6) as y, round(16 + 219 * y, 4) as luma, round(128 + 224 * (b / 255.0 - y) / 1.772, 4) as cb, r as back from y""")
def m22(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).select("id", (F.col("id") % 256).alias("r"), (F.col("id") * 7 % 256).alias("g"), (F.col("id") * 13 % 256).alias("b"))
    rgb = [F.col("r"), F.col("g"), F.col("b")]
    y = V.rgb_to_ypbpr(*[v / 255 for v in rgb])
    ycc = V.rgb_to_ycbcr(*rgb)
    return c.select("id", F.round(y[0], 6).alias("y"), F.round(ycc[0], 4).alias("luma"), F.round(ycc[1], 4).alias("cb"), F.round(V.ycbcr_to_rgb(*ycc)[0]).cast("long").alias("back"))


@R.add("m23_undistort", f"with {CLOUD} select id, round((id % 640 - 320) / 500.0, 5) as x, round((id % 480 - 240) / 500.0, 5) as y from cloud")
def m23(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to the image plane, distorted and back."""
    c = cloud(spark, d).select("id", (F.col("id") % 640).alias("px"), (F.col("id") % 480).alias("py"))
    x, y, _ = V.pixel_to_cartesian(F.col("px"), F.col("py"), 500.0, (320, 240), 1 / 500)
    c = c.withColumns({"x": x, "y": y})
    u, v = V.distort(F.col("x"), F.col("y"), (-0.1, 0.01), (0.001, -0.001))
    c = c.withColumns({"u": u, "v": v})
    bx, by = V.undistort(F.col("u"), F.col("v"), (-0.1, 0.01), (0.001, -0.001), rounds=20)
    return c.select("id", rounded(bx, 5).alias("x"), rounded(by, 5).alias("y"))


# --- graphs ------------------------------------------------------------------------------------------------------------


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nations: from that of an order's customer to that of a supplier of one of its lines; cost 1000 / lines."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return li.join(o, "o_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("source", "target").agg((1000.0 / F.count(F.lit(1))).alias("cost"))


TRADE = "e as (select c_nationkey source, s_nationkey target, 1000.0 / count(*) cost from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"


@R.add("g01_graph", f"with {TRADE} select source, target, round(cost, 6) as cost from e")
def g01(spark: SparkSession, d: str) -> DataFrame:
    _, e = graph.graph(_trade(spark, d), cost="cost")
    return e.select("source", "target", F.round("cost", 6).alias("cost"))


@R.add("g02_shortest_paths", f"""with recursive {TRADE}, r as (select n_nationkey origin, n_nationkey id, cast(0.0 as double) cost, 0 depth from nation where n_nationkey in (select source from e)
 union all select origin, target, min(r.cost + e.cost), depth + 1 from r join e on r.id = e.source where depth < 5 group by all) select origin, id, round(min(cost), 6) as cost from r group by 1, 2""")
def g02(spark: SparkSession, d: str) -> DataFrame:
    nodes, e = graph.graph(_trade(spark, d), cost="cost")
    found = graph.shortest_paths(e, e.select(F.col("source").alias("id")).distinct())
    return found.select("origin", "id", F.round("cost", 6).alias("cost"))


@R.add("g02_paths")
def g02p(spark: SparkSession, d: str) -> DataFrame:
    _, e = graph.graph(_trade(spark, d), cost="cost")
    found = graph.shortest_paths(e, e.select(F.col("source").alias("id")).distinct())
    return graph.paths_to(found, found.select("origin", "id")).select("origin", "target", "step", "id", F.round("cost", 6).alias("cost"))
