"""Queries of sources, generators and writers: what was written as a format is read back, and held against SQL on the table it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import geodesy as G
from quillon.functions import vectors as V
from quillon.operators import spatial_join, trajectory
from quillon.plans.cloud_queries import CLOUD, NEAR, SELF, XYZ, cells_sql, cloud, rounded
from quillon.plans.partitioning import cut_lineage, shared_dir
from quillon.plans.path_queries import BY, LAGS, ORDER, OVER, PATH, PLACES, path, places
from quillon.plans.registry import Registry
from quillon.sources import formats
from quillon.sources.messages import table
from quillon.streaming import streams

R = Registry()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon-{name}"


@R.add("s01_binary_records", "select event_id, user_id, round(value, 6) as value, event_type from events")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """Events as fixed-size binary records and back."""
    at = _place(spark, "records")
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"), "event_type")
    formats.write_binary_records(e, at, "event_id,user_id,value,event_type", "2l,d,s[32]")
    back = formats.read_written_records(spark, at, "event_id,user_id,value,event_type", "2l,d,s[32]")
    return back.select("event_id", "user_id", F.round("value", 6).alias("value"), "event_type")


@R.add("s01_csv_records", "select event_id, round(value, 6) as value_x from events")
def s01c(spark: SparkSession, d: str) -> DataFrame:
    """Events as csv and back, one column skipped."""
    at = _place(spark, "csv")
    table(spark, d, "events").select("event_id", "event_type", "value").write.mode("overwrite").csv(at)
    return formats.read_csv_records(spark, at, "event_id,,value/x", "bigint,string,double").select("event_id", F.round("value_x", 6).alias("value_x"))


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).filter("abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6").select(*XYZ, (F.col("id") % 1000).alias("intensity"))


FAR = "abs(x) < 1e6 and abs(y) < 1e6 and abs(z) < 1e6"


@R.add("s02_las", f"with {CLOUD} select round(sum(x), 0) as x, round(sum(y), 0) as y, sum(id % 1000) as intensity, count(*) as n from cloud where {FAR}")
def s02(spark: SparkSession, d: str) -> DataFrame:
    """Points as LAS files in steps of a tenth of a millimetre and back."""
    p = formats.las_points(formats.las_files(_cloud(spark, d), 0.0001, 5000))
    return p.agg(F.round(F.sum("x"), 0).alias("x"), F.round(F.sum("y"), 0).alias("y"), F.sum("intensity").alias("intensity"), F.count(F.lit(1)).alias("n"))


@R.add("s07_pcd", f"with {CLOUD} select kind, x, y, z from cloud, (select unnest(['ascii', 'binary', 'binary_compressed']) as kind) where {FAR}")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """Points as PCD files of three kinds and back."""
    out = None
    for kind in ("ascii", "binary", "binary_compressed"):
        p = formats.pcd_points(formats.pcd_files(_cloud(spark, d), kind=kind, rows=5000)).select(F.lit(kind).alias("kind"), *XYZ)
        out = p if out is None else out.unionByName(p)
    return out


@R.add("s06_dem", "select x, y, cast(e as double) as z from (select vec_id, (k - 1) % 8 + vec_id * 10 + 0.5 as x, 8 - (k - 1) // 8 - 0.5 as y, floor(embedding[k] * 100) as e from embeddings, unnest(range(1, 65)) u(k)) where e <> 0")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as elevation grids of eight rows, in which 0 is no data, and back."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 100).cast("string")).alias("v"))
    rows = F.concat_ws("\n", *[F.concat_ws(" ", F.slice("v", 8 * k + 1, 8)) for k in range(8)])
    text = F.concat(F.lit("ncols 8\nnrows 8\nxllcorner "), (F.col("vec_id") * 10).cast("string"), F.lit("\nyllcorner 0\ncellsize 1\nNODATA_value 0\n"), rows)
    return formats.dem_cells(e.select(F.col("vec_id").cast("string").alias("path"), F.encode(text, "utf-8").alias("content"))).select("x", "y", "z")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Places as GGA sentences, every third with a wrong checksum."""
    p = places(spark, d).select("rec_id", "lat", "lon")
    part = lambda c, width, plus, minus: F.concat(F.lpad(F.floor(F.abs(c)).cast("string"), width, "0"), F.format_string("%010.7f", (F.abs(c) - F.floor(F.abs(c))) * 60), F.lit(","), F.when(F.col(c) < 0, minus).otherwise(plus))
    body = F.concat(F.lit("$GPGGA,120000,"), part("lat", 2, "N", "S"), F.lit(","), part("lon", 3, "E", "W"), F.lit(",1,8,1.0,"), (F.col("rec_id") % 500).cast("string"), F.lit(",M,,M,,"))
    right = F.concat(body, F.lit("*"), formats.nmea_checksum(F.concat(body, F.lit("*"))))
    return p.select("rec_id", F.when(F.col("rec_id") % 3 == 0, F.concat(body, F.lit("*0"))).otherwise(right).alias("value"))


@R.add("s04_nmea", f"with {PLACES} select rec_id, round(lat + 5e-8, 5) as lat, round(lon + 5e-8, 5) as lon, cast(rec_id % 500 as double) as altitude, 8 as satellites from p where rec_id % 3 <> 0")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with right checksums, parsed."""
    return formats.parse_nmea(_sentences(spark, d)).select("rec_id", F.round(F.col("lat") + 5e-8, 5).alias("lat"), F.round(F.col("lon") + 5e-8, 5).alias("lon"), "altitude", "satellites")


@R.add("s09_svg", f"with {PATH} select event_id, '<circle cx=\"' || y || '\" cy=\"' || z || '\" r=\"1.5\" fill=\"none\" stroke=\"red\" stroke-width=\"0.5\"/>' as value from p")
def s09(spark: SparkSession, d: str) -> DataFrame:
    p = path(spark, d).select(F.col("event_id").alias("k"), F.col("y").alias("x"), F.col("z").alias("y"), F.lit(1.5).alias("radius"))
    return formats.svg_elements(p, "circle", "red", 0.5, keep=["k"]).withColumnRenamed("k", "event_id")


@R.add("s09_kml", "select s_suppkey, '<Placemark><name>' || s_name || ' &amp; &lt;co></name><Point><coordinates>' || cast(s_nationkey as double) || ',' || -cast(s_nationkey as double) || '</coordinates></Point></Placemark>' as value from supplier where s_nationkey <> 0")
def s09k(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_nationkey <> 0").select("s_suppkey", F.concat("s_name", F.lit(" & <co>")).alias("name"), F.col("s_nationkey").cast("double").alias("lon"), (-F.col("s_nationkey").cast("double")).alias("lat"))
    return formats.kml_placemarks(s, "name", "lat", "lon", keep=["s_suppkey"])


@R.add("s13_line", "select k as id, cast(k * 0.5 * 0.6 as double) as x, 1.0::double as y, cast(k * 0.5 * 0.8 as double) as z from (select unnest(range(0, 2001)) k)")
def s13(spark: SparkSession, d: str) -> DataFrame:
    p = formats.make_line(spark, (0, 1, 0), (600, 1, 800), 0.5)
    return p.select("id", *[rounded(c, 9).alias(c) for c in XYZ])


@R.add("s13_box", "select i + 20 * j + 600 * k as id, i * 2.0::double - 5 as x, j * 2.0::double + 1 as y, k * 2.0::double as z from (select unnest(range(0, 20)) i), (select unnest(range(0, 30)) j), (select unnest(range(0, 10)) k) where i in (0, 19) or j in (0, 29) or k in (0, 9)")
def s13b(spark: SparkSession, d: str) -> DataFrame:
    return formats.make_box(spark, (-5, 1, 0), (20, 30, 10), 2.0)


@R.add("s13_sphere", "select count(*) as n, count(*) filter (abs(r - 3) < 1e-9) as on_it, count(*) filter (z > 0) as above from (select 3.0 r, 1 - 2 * (k + 0.5) / 5000 z from (select unnest(range(0, 5000)) k))")
def s13s(spark: SparkSession, d: str) -> DataFrame:
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return formats.make_sphere(spark, 5000, 3.0).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(r - 3) < 1e-9).alias("on_it"), F.count_if(F.col("z") > 0).alias("above"))


@R.add("s13_waves", "select k as id, round(2 * sin(2 * pi() * 5 * k / 1000.0) + 0.5 * sin(2 * pi() * 50 * k / 1000.0), 9) + 0.0 as value from (select unnest(range(0, 3000)) k)")
def s13w(spark: SparkSession, d: str) -> DataFrame:
    return formats.make_waves(spark, 3.0, 1000, [(5, 2), (50, 0.5)]).select("id", rounded("value", 9).alias("value"))


# --- streams, as tables ----------------------------------------------------------------------------------------------------


@R.add("t11_windowed", "select time_bucket(interval 1 hour, ts) as start, user_id, count(value) as count, round(sum(value), 6) as sum, min(value) as min, max(value) as max from events group by 1, 2")
def t11w(spark: SparkSession, d: str) -> DataFrame:
    w = streams.windowed(table(spark, d, "events"), "ts", ["user_id"], "value", "1 hour", "1 day")
    return w.select("start", "user_id", "count", F.round("sum", 6).alias("sum"), "min", "max")


@R.add("t11_sessions", f"""with g as (select *, coalesce(ts - lag(ts) over {OVER} >= interval 12 hour, true) as fresh from events), s as (select *, sum(fresh::int) over {OVER} as k from g)
select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as count from s group by user_id, k""")
def t11s(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "ts", ["user_id"], "12 hours", "1 day").select("user_id", "start", "end", "count")


# --- further options of joins, paths and places --------------------------------------------------------------------------------


@R.add("j12_blocks_not_matching", f"with {CLOUD}, {cells_sql(NEAR)} select id from cloud where id not in (select a.id from w a join e b on b.block % 2 = 0 and b.id % 2 = 1 and a.id <> b.id and a.block = b.block and a.ni = b.i and a.nj = b.j and a.nk = b.k where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {NEAR} * {NEAR})")
def j12b(spark: SparkSession, d: str) -> DataFrame:
    """Points without a partner in a filter that lacks every other block: all points of blocks that it lacks come out."""
    c = cloud(spark, d)
    return spatial_join.matching(c, c.filter("block % 2 = 0 and id % 2 = 1"), NEAR, negate=True, ids=("differ", "id"), **SELF).select("id")


@R.add("j12_same_blocks", f"with {CLOUD} select id from cloud where block is not null")
def j12s(spark: SparkSession, d: str) -> DataFrame:
    """Every block of the points is in the filter, so the check lets all pass."""
    c = cloud(spark, d).filter("block is not null")
    return spatial_join.same_blocks(c, c, ["block"]).select("id")


@R.add("j14_permissive", "select point_id as id from points where isfinite(c0) and isfinite(c1) and isfinite(c2)")
def j14p(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.usable(table(spark, d, "points"), ("c0", "c1", "c2"), permissive=True).select(F.col("point_id").alias("id"))


TURNS = f"""{LAGS}, d as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) ab, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) bc, (x - px) * (nx - x) + (y - py) * (ny - y) dt, (x - px) * (ny - y) - (y - py) * (nx - x) ct from l)"""


@R.add("r16_pivot", f"with {TURNS} select event_id, round(atan2(ct, dt), 6) + 0.0 as relative_heading from d where ab > 0 and bc > 0 and acos(greatest(-1.0, least(1.0, dt / (ab * bc)))) >= pi() / 2 union all select event_id, 0.0 from d")
def r16p(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory.turn_speed(path(spark, d).withColumn("speed", F.lit(20.0)), BY, ORDER, "speed", 0.5, 1.0, pivot=True)
    return t.select("event_id", rounded("relative_heading").alias("relative_heading"))


@R.add("r18_stuck")
def r18s(spark: SparkSession, d: str) -> DataFrame:
    """Carrots of feedback that is stuck for days: the near row goes on by one each day."""
    p = path(spark, d)
    feedback = p.select(F.col("event_id").alias("id"), "user_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return trajectory.carrots(feedback, p, BY, ORDER, 5.0, 1.5, 600.0, stuck_timeout=86_400.0).select("id", F.col("near_row").cast("long").alias("near_row"), "carrot_row")


@R.add("m19_arcs_meet", f"""with {PLACES}, u as (select rec_id, radians(lat0) a, radians(lon0) o, radians(lat) b from p where abs(lat0) < 80 and abs(lat) < 80),
v as (select rec_id, o, atan(tan(b) / cos(radians(1.0))) m, a, b from u) select rec_id, round(degrees(m), 6) as lat, round(degrees(o) + 3e-8, 6) as lon from v where abs(m - a) <= radians(1.0)""")
def m19m(spark: SparkSession, d: str) -> DataFrame:
    """Where the meridian of a boot's first position, a degree to either side, meets the great circle through two places a degree east and west at each message's latitude."""
    p = places(spark, d).filter("abs(lat0) < 80 and abs(lat) < 80")
    r = lambda c: F.radians(c)
    north, south = G.unit(r(F.col("lat0") + 1), r("lon0")), G.unit(r(F.col("lat0") - 1), r("lon0"))
    west, east = G.unit(r("lat"), r(F.col("lon0") - 1)), G.unit(r("lat"), r(F.col("lon0") + 1))
    met = p.withColumn("met", G.arcs_meet(south, north, west, east)).filter("met.lat is not null")
    return met.select("rec_id", F.round(F.degrees("met.lat"), 6).alias("lat"), F.round(F.degrees("met.lon") + 3e-8, 6).alias("lon"))


@R.add("m23_stereo", f"with {CLOUD}, s as (select id, id % 640 l, (id * 7) % 41 disparity, id % 480 v from cloud) select id, round((l - 320) * 0.2 / disparity, 6) + 0.0 as x, round((v - 240) * 0.2 / disparity, 6) + 0.0 as y, round(500 * 0.2 / disparity, 6) as z from s where disparity <> 0")
def m23s(spark: SparkSession, d: str) -> DataFrame:
    left, off = F.col("id") % 640, (F.col("id") * 7) % 41
    x, y, z = V.stereo_point(left, left - off, F.col("id") % 480, 500.0, 0.2, (320, 240))
    return cloud(spark, d).select("id", rounded(x).alias("x"), rounded(y).alias("y"), F.round(z, 6).alias("z")).filter("z is not null")


@R.add("v10_icp", "select 0.003::double as tx, -0.002::double as ty, 0.001::double as tz, true as settled")
def v10i(spark: SparkSession, d: str) -> DataFrame:
    """The cloud against itself, shifted a little: the shift comes back."""
    from quillon.operators import algebra

    c = cloud(spark, d).dropDuplicates(["x", "y", "z"]).filter("abs(x) < 1e5 and abs(y) < 1e5 and abs(z) < 1e5").select("id", *XYZ)
    moved = c.select("id", (F.col("x") + 0.003).alias("x"), (F.col("y") - 0.002).alias("y"), (F.col("z") + 0.001).alias("z"))
    _, t, error = algebra.iterative_closest_points(cut_lineage(c), cut_lineage(moved), 0.1)
    return spark.createDataFrame([(*[round(float(v), 4) + 0.0 for v in t], bool(error < 1e-3))], "tx double, ty double, tz double, settled boolean")


N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
KRUEGER = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
RADIUS = 0.9996 * 6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
EAST, NORTH = (" + ".join(["{0}", *[f"{k} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, k in enumerate(KRUEGER, 1)]]) for f, g in (("cos", "sinh"), ("sin", "cosh")))


@R.add("m18_utm", f"""with {PLACES}, w as (select rec_id, lat, lon - 360 * floor((lon + 180) / 360) lon from p), z as (select *, cast(floor((lon + 180) / 6) as integer) + 1 zone, sin(radians(lat)) s from w),
t as (select *, sinh(atanh(s) - {2 * N**0.5 / (1 + N)} * atanh({2 * N**0.5 / (1 + N)} * s)) t, radians(lon - (zone * 6 - 183)) lam from z), x as (select *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta from t)
select rec_id, zone, round(500000 + {RADIUS} * ({EAST.format('eta')}), 3) as easting, round(case when lat < 0 then 10000000 else 0 end + {RADIUS} * ({NORTH.format('xi')}), 3) as northing from x""")
def m18u(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).withColumns(G.to_utm(F.col("lat"), F.col("lon")))
    return p.select("rec_id", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))
