"""Queries p1, p2, p3 and p5 over the whole test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.near import near_and_inside, near_positions
from quillon.operators.regular_grid import READING, regular_grid
from quillon.operators.spikes import flag_readings
from quillon.operators.trips import stops_and_trips
from quillon.plans.partitioning import lookup_join
from quillon.sources.messages import positioned, table, timed

NEAR_M = 0.25
STEP_US = 10_000_000
#: Fields of problem 5, numbered by place.
FIELDS = [("mavlink_gps2_raw_t", "alt"), ("mavlink_gps2_raw_t", "eph"), ("mavlink_optical_flow_t", "ground_distance"), ("mavlink_adap_tuning_t", "error")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Points of one block within 0.25 m of each other, and regions that contain points."""
    return near_and_inside(table(spark, d, "points"), NEAR_M, table(spark, d, "regions"))


def p1_positions(spark: SparkSession, d: str) -> DataFrame:
    """Boots whose first positions (by rec_id) lie within 100 m of each other on the sphere: latitude and longitude as unit vectors, searched by the chord."""
    gps = table(spark, d, "mavlink_gps2_raw_t").select("rec_id", "boot_id", "lat", "lon", "fix_type").filter(positioned() & F.col("boot_id").isNotNull())
    first = gps.groupBy("boot_id").agg(F.min_by(F.struct((F.col("lat") / 1e7).alias("lat"), (F.col("lon") / 1e7).alias("lon")), F.col("rec_id")).alias("at")).select("boot_id", "at.lat", "at.lon")
    return near_positions(first, 100.0, id="boot_id", lat="lat", lon="lon").select("id_a", "id_b")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """lat and alt of each boot in slots of 10 s, gaps filled or marked."""
    gps = table(spark, d, "mavlink_gps2_raw_t").select("rec_id", "boot_id", "time_usec", "lat", "lon", "alt", "fix_type").filter(positioned() & F.col("alt").isNotNull())
    readings = timed(gps, table(spark, d, "mavlink_boots"))
    grid = regular_grid(readings, STEP_US, source="boot_id", moment="moment", id="rec_id", values=["lat", "alt"])
    return grid.withColumnRenamed("source", "boot_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The slots of p2_grid that have no reading."""
    return p2_grid(spark, d).filter(F.col("mark") != READING).select("boot_id", "slot")


def p3_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips of each boot, with start, end, duration and distance."""
    gps = table(spark, d, "mavlink_gps2_raw_t").select("rec_id", "boot_id", "time_usec", "lat", "lon", "vel", "fix_type").filter(positioned())
    pings = timed(gps, table(spark, d, "mavlink_boots")).select("rec_id", "boot_id", "moment", (F.col("lat") / 1e7).alias("lat"), (F.col("lon") / 1e7).alias("lon"), F.when((F.col("vel") >= 0) & (F.col("vel") != 65535), F.col("vel") / 100).alias("speed"))
    found = stops_and_trips(pings, source="boot_id", moment="moment", id="rec_id", lat="lat", lon="lon", speed="speed")
    return found.select(F.col("source").alias("boot_id"), "kind", "start", "end", ((F.col("end") - F.col("start")) / 1e6).alias("duration_s"), F.col("distance").alias("distance_m"), "lat", "lon")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The stops of p3_trips by minute."""
    minute = lambda c: F.floor(F.col(c) / 60_000_000)
    return p3_trips(spark, d).filter("kind = 'stop'").select("boot_id", minute("start").alias("start_minute"), minute("end").alias("end_minute")).distinct()


def _series(number: int, sub: Column) -> Column:
    """One bigint for (field, boot, sensor or axis): boot_id below 2^45, sub a smallint."""
    return (F.col("boot_id") * 2**18 + (F.coalesce(sub.cast("long"), F.lit(-32768)) + 32768) * 4 + number).alias("series")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings of alt, eph, ground_distance and error: (table_name, field, rec_id, flags)."""
    boots = table(spark, d, "mavlink_boots")
    gps = timed(table(spark, d, "mavlink_gps2_raw_t").select("rec_id", "boot_id", "time_usec", "alt", "eph", "fix_type"), boots).dropDuplicates(["boot_id", "rec_id"])
    alt = F.when(F.col("fix_type") >= 2, F.col("alt").cast("double"))
    eph = F.when(F.col("eph") != 65535, F.col("eph").cast("double"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("what"), alt.alias("value")), F.struct(F.lit(1).alias("what"), eph.alias("value"))))
    hour = F.floor(F.col("moment") / 3_600_000_000)
    gps = gps.select("boot_id", "rec_id", "moment", both.alias("r")).select(_series(0, F.lit(0)).alias("_s"), F.col("r.what").alias("what"), F.col("rec_id").alias("id"), F.col("moment").alias("ord"), hour.alias("part"), F.col("r.value").alias("value"))
    gps = gps.withColumn("series", F.col("_s") + F.col("what")).drop("_s")
    flow = timed(table(spark, d, "mavlink_optical_flow_t").select("rec_id", "boot_id", "time_usec", "ground_distance", "sensor_id"), boots).dropDuplicates(["boot_id", "rec_id"])
    flow = flow.filter(F.col("ground_distance") >= 0).select(_series(2, F.col("sensor_id")), F.lit(2).alias("what"), F.col("rec_id").alias("id"), F.col("moment").alias("ord"), hour.alias("part"), F.col("ground_distance").cast("double").alias("value"))
    tuning = table(spark, d, "mavlink_adap_tuning_t").select("rec_id", "boot_id", "msg_seq", "axis", "error").dropna(subset=["rec_id", "boot_id", "msg_seq", "error"]).dropDuplicates(["boot_id", "rec_id"])
    tuning = tuning.select(_series(3, F.col("axis")), F.lit(3).alias("what"), F.col("rec_id").alias("id"), F.col("msg_seq").alias("ord"), F.floor(F.col("msg_seq") / 4096).alias("part"), F.col("error").cast("double").alias("value"))
    readings = gps.unionByName(flow).unionByName(tuning).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    number = F.create_map(*[v for i, name in enumerate(FIELDS) for v in (F.lit("/".join(name)), F.lit(i))])
    limits = table(spark, d, "reading_limits").select(number[F.concat_ws("/", "table_name", "field")].alias("what"), "lowest", "highest").filter("what is not null")
    readings = lookup_join(readings, limits, "what", "id").withColumn("impossible", (F.col("value") < F.col("lowest")) | (F.col("value") > F.col("highest")) | (F.abs("value") == float("inf")))
    flagged = flag_readings(readings.select("series", "ord", "id", "value", "impossible", "part"), F.col("part"))
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in FIELDS])[F.pmod(F.col("series"), F.lit(4)).cast("int")]
    return flagged.select(names["t"].alias("table_name"), names["f"].alias("field"), F.col("id").alias("rec_id"), "flags")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The flagged readings, whatever the reason."""
    return p5_flags(spark, d).drop("flags")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_positions, p2_grid, p2_found, p3_trips, p3_found, p5_flags, p5_found)}


P1_SQL = """
with p as (select distinct point_id, block, c0, c1, c2 from points
           where isfinite(c0) and isfinite(c1) and isfinite(c2) and not (c0 = 0 and c1 = 0 and c2 = 0)),
e as (select *, cast(floor(c0 / 0.25) as bigint) i, cast(floor(c1 / 0.25) as bigint) j, cast(floor(c2 / 0.25) as bigint) k from p),
x as (select e.*, i + di ni, j + dj nj, k + dk nk from e, (select unnest([-1, 0, 1]) di), (select unnest([-1, 0, 1]) dj), (select unnest([-1, 0, 1]) dk)),
near as (select a.point_id id_a, b.point_id id_b from x a join e b
         on a.block = b.block and a.ni = b.i and a.nj = b.j and a.nk = b.k and a.point_id < b.point_id
         and (a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 <= 0.0625),
edges as (select region_id, c0_min, c0_max, c1_min, c1_max, c2_min, c2_max, ring[i] a, ring[i % len(ring) + 1] b
          from regions, unnest(range(1, len(ring) + 1)) u(i) where shape = 'prism'),
hits as (select region_id, point_id from regions, p where shape = 'box' and c0 between c0_min and c0_max and c1 between c1_min and c1_max and c2 between c2_min and c2_max
         union all
         select region_id, point_id from regions, p where shape = 'sphere' and (c0 - centre0) ** 2 + (c1 - centre1) ** 2 + (c2 - centre2) ** 2 <= radius * radius
         union all
         select region_id, point_id from edges, p
         where c0 between c0_min and c0_max and c1 between c1_min and c1_max and c2 between c2_min and c2_max and (a.c1 > c1) <> (b.c1 > c1) and c0 < (b.c0 - a.c0) * (c1 - a.c1) / (b.c1 - a.c1) + a.c0
         group by 1, 2 having count(*) % 2 = 1)
select 'near' as kind, id_a, id_b from near union all select 'inside', region_id, point_id from hits
"""


MESSAGES_SQL = """
gps as (select distinct on (m.rec_id) m.*, case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end as moment
        from mavlink_gps2_raw_t m join mavlink_boots b using (boot_id)
        where time_usec <> 0 and case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end between boot_usec and off_usec)
"""

POSITIONS_SQL = """
with f as (select boot_id, arg_min(lat, rec_id) / 1e7 lat, arg_min(lon, rec_id) / 1e7 lon from mavlink_gps2_raw_t where fix_type >= 2 and lat is not null and lon is not null and not (lat = 0 and lon = 0) and boot_id is not null group by 1),
n as (select *, radians(lat) a, radians(lon) o from f where abs(lat) <= 90)
select p.boot_id as id_a, q.boot_id as id_b from n p join n q on p.boot_id < q.boot_id and abs(p.lat - q.lat) < 0.001
where 2 * asin(least(1, sqrt(pow(sin((p.a - q.a) / 2), 2) + cos(p.a) * cos(q.a) * pow(sin((p.o - q.o) / 2), 2)))) <= 100 / 6371008.8
"""

P2_SQL = f"""
with {MESSAGES_SQL},
slots as (select distinct boot_id, moment // 10000000 as slot from gps where fix_type >= 2 and lat is not null and lon is not null and alt is not null and not (lat = 0 and lon = 0)),
spans as (select boot_id, min(slot) a, max(slot) b from slots group by 1)
select boot_id, slot from (select boot_id, unnest(range(a, b + 1)) as slot from spans) except select boot_id, slot from slots
"""

P5_SQL = f"""
with {MESSAGES_SQL},
flow as (select distinct on (m.rec_id) m.*, time_usec as moment from mavlink_optical_flow_t m join mavlink_boots using (boot_id) where time_usec <> 0 and time_usec between boot_usec and off_usec),
tuning as (select distinct on (rec_id) * from mavlink_adap_tuning_t where msg_seq is not null and boot_id is not null),
raw as (select 'mavlink_gps2_raw_t' as table_name, 'alt' as field, boot_id, 0 as sub, moment as ord, rec_id, cast(alt as double) as value from gps where fix_type >= 2
        union all select 'mavlink_gps2_raw_t', 'eph', boot_id, 0, moment, rec_id, eph from gps where eph <> 65535
        union all select 'mavlink_optical_flow_t', 'ground_distance', boot_id, sensor_id, moment, rec_id, ground_distance from flow where ground_distance >= 0
        union all select 'mavlink_adap_tuning_t', 'error', boot_id, axis, msg_seq, rec_id, error from tuning),
readings as (select r.*, row_number() over w as n, value is distinct from lag(value) over w as fresh, value < lowest or value > highest or isinf(value) as impossible
             from raw r join reading_limits using (table_name, field) where value is not null and not isnan(value) window w as (partition by table_name, field, boot_id, sub order by ord, rec_id)),
runs as (select *, sum(fresh::int) over (partition by table_name, field, boot_id, sub order by n) as run from readings),
marked as (select *, count(*) over (partition by table_name, field, boot_id, sub, run) >= 10 as stuck from runs),
good as (select table_name, field, boot_id, sub, rec_id, value, row_number() over (partition by table_name, field, boot_id, sub order by n) as n from marked where not stuck and not impossible),
leveled as (select *, abs(value - median(value) over (partition by table_name, field, boot_id, sub order by n rows between 7 preceding and 7 following)) as away from good),
scattered as (select *, 10 * 1.4826 * median(away) over (partition by table_name, field, boot_id, sub order by n rows between 56 preceding and 56 following) as most from leveled),
judged as (select *, away > most as odd, n - row_number() over (partition by table_name, field, boot_id, sub, away > most order by n) as island from scattered),
plain as (select *, median(value) over (partition by table_name, field, boot_id, sub order by n rows between 6 preceding and current row) as behind,
          median(value) over (partition by table_name, field, boot_id, sub order by n rows between current row and 6 following) as ahead from judged where not odd),
placed as (select j.*, last_value(p.behind ignore nulls) over (partition by j.table_name, j.field, j.boot_id, j.sub order by j.n rows between unbounded preceding and current row) as behind,
           first_value(p.ahead ignore nulls) over (partition by j.table_name, j.field, j.boot_id, j.sub order by j.n rows between current row and unbounded following) as ahead
           from judged j left join plain p using (table_name, field, rec_id)),
spikes as (select table_name, field, rec_id, count(*) over w <= 3 and bool_and(coalesce(abs(value - behind) > most and abs(value - ahead) > most, false)) over w as spike
           from placed where odd window w as (partition by table_name, field, boot_id, sub, island)),
flagged as (select table_name, field, rec_id, impossible::int + 2 * stuck::int + 4 * coalesce(spike, false)::int as flags from marked left join spikes using (table_name, field, rec_id))
select table_name, field, rec_id, cast(flags as integer) as flags from flagged where flags > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_positions": POSITIONS_SQL, "p2_found": P2_SQL, "p5_flags": P5_SQL, "p5_found": f"select table_name, field, rec_id from ({P5_SQL})"}
