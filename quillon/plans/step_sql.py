"""SQL of queries that go step by step, or grow from place to place: recursion over the rows of a path, or over links between points."""

from __future__ import annotations

from quillon.plans.cloud_queries import CLOUD, D2, NEAR, POLAR, STEPS, pairs_sql
from quillon.plans.path_queries import FRAMES, LAGS, OVER, PATH, PLACES, STEP, TRADE, UVW

SQL: dict[str, str] = {}

#: The rows of a path by number, with the length so far.
ROWS = f"{LAGS}, q as (select *, row_number() over {OVER} as n, coalesce({STEP}, 0.0) as st, sum(coalesce({STEP}, 0.0)) over {OVER} as s from l)"


def steps(first: str, step: str, chosen: str, where: str = "true", before: str = ROWS) -> str:
    """A recursion over q: columns of the first row, those of a later row q from the row r before it, and what comes out of all rows."""
    return f"with recursive {before}, r as (select q.*, {first} from q where n = 1 union all select q.*, {step} from r join q on q.user_id = r.user_id and q.n = r.n + 1) select {chosen} from r where {where}"


SQL["r07_heading_no_repeats"] = f"""with {PATH}, c as (select *, floor(x / 100) c, floor(y / 20) e from p),
m as (select *, coalesce(c <> lag(c) over w or e <> lag(e) over w, true) as fresh from c window w as {OVER}), k as (select *, sum(fresh::int) over {OVER} as place from m),
n as (select user_id, place, lag(c) over w pc, lag(e) over w pe, lead(c) over w nc, lead(e) over w ne from k where fresh window w as (partition by user_id order by place)),
v as (select event_id, c - pc ax, e - pe ay, nc - c bx, ne - e b_y from k join n using (user_id, place)), s as (select *, sqrt(ax * ax + ay * ay) na, sqrt(bx * bx + b_y * b_y) nb from v)
select event_id, round(coalesce(case when na > 1e-6 and nb > 1e-6 then pi() - acos(greatest(-1.0, least(1.0, (ax * bx + ay * b_y) / (na * nb)))) end, 0.0), 6) as angle from s"""

SQL["r09_sample_path"] = f"""with {ROWS}, g as (select *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) seg from q),
k as (select *, unnest(case when seg is null then [-1] else range(cast(ceil((s - 1e-9) / 200) as bigint), cast(ceil((s + seg - 1e-9) / 200) as bigint)) end) as k from g),
a as (select *, case when k < 0 then s else k * 200.0 end along, case when k < 0 then 0 else (k * 200.0 - s) / seg end w from k)
select event_id, round(along, 6) as along, round(case when w = 0 then x else x + (nx - x) * w end, 6) + 0.0 as at_x, round(case when w = 0 then y else y + (ny - y) * w end, 6) + 0.0 as at_y, round(case when w = 0 then z else z + (nz - z) * w end, 6) + 0.0 as at_z from a"""

SQL["r10_thin_path"] = steps("true as kept, 0.0::double as gone", "r.gone + q.st >= 500, case when r.gone + q.st >= 500 then 0 else r.gone + q.st end", "event_id", "kept")

CHORD = """j as (select a.user_id, a.n, b.n n2, b.s - a.s arc, sqrt({0}) ch from q a join q b on a.user_id = b.user_id and b.n > a.n and b.s - a.s <= 600),
m as (select user_id, n, max(n2) n2 from j where ch > 0 and arc <= 1.5 * ch group by 1, 2), c as (select q.*, coalesce(m.n2, q.n) as far from q left join m using (user_id, n))"""
CHORDS = f"{ROWS}, {CHORD.format('(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)')}"
SQL["r11_chord_chain"] = f"""with recursive {CHORDS}, r as (select user_id, event_id, n, far from c where n = 1 union all
select c.user_id, c.event_id, c.n, c.far from r join c on c.user_id = r.user_id and c.n = case when r.far > r.n then r.far else r.n + 1 end) select event_id, n as row, far as to_row from r"""

TURN = "q.st > 0 and r.fx is not null and acos(greatest(-1.0, least(1.0, (r.fx * (q.x - q.px) + r.fy * (q.y - q.py) + r.fz * (q.z - q.pz)) / q.st))) >= pi() / 2 and r.gone >= 50"
NEW = f"q.st > 0 and (r.fx is null or ({TURN}))"
SQL["r12_direction_partitions"] = steps(
    "0::bigint as part, null::double as fx, null::double as fy, null::double as fz, 0.0::double as gone",
    f"r.part + case when {TURN} then 1 else 0 end, " + ", ".join(f"case when {NEW} then (q.{a} - q.p{a}) / q.st else r.f{a} end" for a in "xyz") + f", case when {NEW} then q.st else r.gone + q.st end",
    "event_id, part as partition",
)

# Poses with the rotations 0, 0.01 and z / 600; the state is the rotation so far, by rows, and the place.
POSE = {"m00": "cos(q.z / 600) * cos(0.01)", "m01": "-sin(q.z / 600)", "m02": "cos(q.z / 600) * sin(0.01)", "m10": "sin(q.z / 600) * cos(0.01)", "m11": "cos(q.z / 600)", "m12": "sin(q.z / 600) * sin(0.01)", "m20": "-sin(0.01::double)", "m21": "0", "m22": "cos(0.01::double)"}
SQL["r14_integrate_frames"] = steps(
    ", ".join(f"({POSE[f'm{i}{j}']})::double as r{i}{j}" for i in range(3) for j in range(3)) + ", (q.x / 100)::double as tx, (q.y / 60)::double as ty, 0.0::double as tz",
    ", ".join(" + ".join(f"r.r{i}{k} * ({POSE[f'm{k}{j}']})" for k in range(3)) for i in range(3) for j in range(3)) + ", " + ", ".join(f"r.t{a} + r.r{i}0 * q.x / 100 + r.r{i}1 * q.y / 60" for i, a in enumerate("xyz")),
    "event_id, " + ", ".join(f"round(t{a}, 6) + 0.0 as {a}" for a in "xyz"),
)

# k and (sx, sy) are the target's number and the line's beginning before a row, kk, ux and uy those after it.
GOAL = "(case least({0}, 2) when 0 then 100.0 when 1 then 200.0 else 300.0 end)", "(case least({0}, 2) when 0 then 10.0 when 1 then 30.0 else 50.0 end)"


def _heading(k: str, sx: str, sy: str) -> tuple[str, str]:
    ex, ey = (g.format(k) for g in GOAL)
    size = f"coalesce(nullif(sqrt(({ex} - {sx}) * ({ex} - {sx}) + ({ey} - {sy}) * ({ey} - {sy})), 0), 1)"
    return f"(({ex} - {sx}) * (q.y - {sy}) - ({ey} - {sy}) * (q.x - {sx})) / {size}", f"(sqrt((q.x - {ex}) * (q.x - {ex}) + (q.y - {ey}) * (q.y - {ey})) <= 20 or (({ex} - {sx}) * (q.x - {sx}) + ({ey} - {sy}) * (q.y - {sy})) / {size} >= {size})"


def _follow(k: str, sx: str, sy: str) -> str:
    cross, there = _heading(k, sx, sy)
    ex, ey = (g.format(k) for g in GOAL)
    return f"least({k}, 2)::integer as target, ({cross})::double as cross_, {there} as reached, ({k} + case when {there} and {k} < 3 then 1 else 0 end)::integer as kk, (case when {there} and {k} < 3 then {ex} else {sx} end)::double as ux, (case when {there} and {k} < 3 then {ey} else {sy} end)::double as uy"


SQL["r15_follow_waypoints"] = steps(_follow("0", "q.x", "q.y"), _follow("r.kk", "r.ux", "r.uy"), "event_id, target, round(cross_, 6) + 0.0 as cross_track, reached")

SQL["r16_turn_speed"] = f"""with {LAGS}, d as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) ab, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) bc, sqrt((px - nx) * (px - nx) + (py - ny) * (py - ny)) ca from l),
a as (select *, sqrt(greatest(0.0, (ab + bc + ca) * (bc + ca - ab) * (ab + ca - bc) * (ab + bc - ca))) / 4 area, acos(greatest(-1.0, least(1.0, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (ab * bc)))) turn from d)
select event_id, round(case when ab > 0 and bc > 0 then least(20.0, case when turn >= pi() / 2 then 1.0 when area > 0 then greatest(1.0, sqrt(0.5 * ab * bc * ca / (4 * area))) else 20.0 end) else 20.0 end, 6) as speed from a"""

TIMED = f"{PATH}, q as (select *, epoch_us(ts) / 1e6 as t, (x - 250) / 100 as error, row_number() over (partition by user_id order by ts, event_id) as n from p)"
TOTAL, SLOPE = "greatest(-1e4, least(1e4, r.total + q.error * (q.t - r.t)))", "(q.error - r.error) / (q.t - r.t)"
SQL["r17_pid"] = steps(
    "0.0::double as total, 0.0::double as slope, error::double as command",
    f"case when q.t > r.t then {TOTAL} else r.total end, case when q.t > r.t then {SLOPE} else r.slope end, q.error + 1e-4 * case when q.t > r.t then {TOTAL} else r.total end + 10 * case when q.t > r.t then {SLOPE} else r.slope end",
    "event_id, round(command, 6) + 0.0 as command", before=TIMED,
)

FLAT = f"{PATH}, l as (select *, lag(x) over {OVER} px, lag(y) over {OVER} py from p), q as (select *, row_number() over {OVER} as n, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0)) over {OVER} as s from l)"
SQL["r18_carrots"] = f"""with {FLAT}, {CHORD.format('(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)')},
f as (select f.event_id id, f.user_id, c.n, c.far, row_number() over (partition by f.event_id order by (f.x + 1 - c.x) * (f.x + 1 - c.x) + (f.y + 1 - c.y) * (f.y + 1 - c.y), c.n) as k from c f join c on f.user_id = c.user_id and (f.x + 1 - c.x) * (f.x + 1 - c.x) + (f.y + 1 - c.y) * (f.y + 1 - c.y) <= 25)
select f.id, f.n as near_row, f.far as carrot_row, round(c.x, 6) as carrot_x, round(c.y, 6) as carrot_y from f join c on c.user_id = f.user_id and c.n = f.far where k = 1"""

SQL["r18_stuck"] = f"""with {FLAT}, {CHORD.format('(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)')},
f as (select f.event_id id, f.user_id, epoch_us(f.ts) / 1e6 t, c.n, row_number() over (partition by f.event_id order by (f.x + 1 - c.x) * (f.x + 1 - c.x) + (f.y + 1 - c.y) * (f.y + 1 - c.y), c.n) as k from c f join c on f.user_id = c.user_id and (f.x + 1 - c.x) * (f.x + 1 - c.x) + (f.y + 1 - c.y) * (f.y + 1 - c.y) <= 25),
g as (select *, max(n) over (partition by user_id order by t, id) as most from f where k = 1), h as (select *, coalesce(most > lag(most) over (partition by user_id order by t, id), true) as fresh from g),
i as (select *, last_value(case when fresh then t end ignore nulls) over (partition by user_id order by t, id) as since, (select max(n) from c where c.user_id = h.user_id) as last_ from h),
u as (select id, user_id, least(last_, n + floor((t - since) / 86400)) as pushed from i)
select u.id, cast(pushed as bigint) as near_row, c.far as carrot_row from u join c on c.user_id = u.user_id and c.n = pushed"""

SQL["t05_points_in_frames"] = f"""with {FRAMES}, i as (select rec_id, b.x + (coalesce(b.x2, b.x) - b.x) * case when b.t2 > b.t then (f.t - b.t) / (b.t2 - b.t) else 0 end as a from f join b on f.boot_id = b.boot_id and f.t >= b.t and (f.t < b.t2 or f.t = b.t))
select rec_id, round(a + 2 * cos(a) - sin(a), 5) + 0.0 as x, round(1 + 2 * sin(a) + cos(a), 5) + 0.0 as y, 0.5::double as z from i"""

ON_TIME = "q.t - r.adjusted > 3600 and q.t - r.adjusted < 5400"
SQL["t08_periodic"] = steps("q.t as adjusted", f"case when {ON_TIME} then r.adjusted + 3600 else q.t end", "event_id, round(adjusted, 3) as adjusted", before=TIMED)

SQL["m08_lines_nearest"] = f"""with {UVW}, d as (select *, vx - ux ax, vy - uy ay, vz - uz az, -wx bx, -wy b_y, -wz bz, ux - wx cx, uy - wy cy, uz - wz cz from t),
e as (select *, ax * ax + ay * ay + az * az aa, ax * bx + ay * b_y + az * bz ab, bx * bx + b_y * b_y + bz * bz bb, ax * cx + ay * cy + az * cz ac, bx * cx + b_y * cy + bz * cz bc from d),
s as (select *, case when abs(aa * bb - ab * ab) > 1e-12 * aa * bb then (ab * bc - bb * ac) / (aa * bb - ab * ab) end s, case when abs(aa * bb - ab * ab) > 1e-12 * aa * bb then (aa * bc - ab * ac) / (aa * bb - ab * ab) end t_ from e)
select id, round(ux + ax * s, 3) + 0.0 as ax, round(uy + ay * s, 3) + 0.0 as ay, round(uz + az * s, 3) + 0.0 as az, round(wx + bx * t_, 3) + 0.0 as bx, round(wy + b_y * t_, 3) + 0.0 as by, round(wz + bz * t_, 3) + 0.0 as bz from s"""

SQL["m10_discretise_triangles"] = """with t as (select region_id id, c0_min ax, c1_min ay, c2_min az, least(c0_max, c0_min + 100) bx, least(c1_max, c1_min + 100) cy from regions),
n as (select *, cast(greatest(1, ceil(sqrt((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)) / 20.0 - 1e-9)) as integer) n from t),
g as (select *, unnest(range(0, n + 1)) i from n), h as (select *, unnest(range(0, n - i + 1)) j from g)
select id, round(ax + (bx - ax) * (i / n), 4) + 0.0 as x, round(ay + (cy - ay) * (j / n), 4) + 0.0 as y, round(az, 4) + 0.0 as z, i > 0 and j > 0 and i + j < n as internal from h"""

# A Hann window over 32 values, of which bins begin every 16; the last bins are padded with zeros.
SQL["m14_spectrum"] = f"""with {PATH}, v as (select user_id, x, row_number() over {OVER} - 1 as n from p), b as (select *, unnest(range(cast(greatest(0, ceil((n - 31) / 16)) as bigint), n // 16 + 1)) as bin from v),
w as (select user_id, bin, f, sum(x * (0.5 - 0.5 * cos(2 * pi() * (n - bin * 16) / 31)) * cos(2 * pi() * f * (n - bin * 16) / 32)) re, sum(x * (0.5 - 0.5 * cos(2 * pi() * (n - bin * 16) / 31)) * sin(2 * pi() * f * (n - bin * 16) / 32)) im from b, (select unnest(range(0, 16)) f) group by all)
select user_id, bin, list(round(case when re * re + im * im > 0 then log10(sqrt(re * re + im * im)) else 0 end, 5) + 0.0 order by f) as spectrum from w group by 1, 2"""


def _geodesic(rounds: int) -> str:
    """CTEs of Vincenty's inverse method on WGS84, its iteration written out."""
    f = "(1 / 298.257223563::double)"
    out = [f"g0 as (select rec_id, atan((1 - {f}) * tan(radians(lat0))) u1, atan((1 - {f}) * tan(radians(lat))) u2, radians(lon - lon0) - 2 * pi() * floor((radians(lon - lon0) + pi()) / (2 * pi())) as gap from p), h0 as (select *, gap as lam from g0)"]
    for k in range(rounds):
        out.append(f"""a{k} as (select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs from h{k}),
b{k} as (select *, atan2(ss, cs) sigma, case when ss > 0 then cos(u1) * cos(u2) * sin(lam) / ss else 0 end sa from a{k}),
c{k} as (select *, case when 1 - sa * sa > 1e-15 then cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) else 0 end c2m, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) c from b{k}),
h{k + 1} as (select rec_id, u1, u2, gap, gap + (1 - c) * {f} * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) as lam from c{k})""")
    return ", ".join(out)


SQL["m16_ellipsoid_distance"] = f"""with {PLACES}, {_geodesic(7)},
k as (select *, (1 - sa * sa) * (pow(6378137.0, 2) / pow(6378137.0 * (1 - 1 / 298.257223563::double), 2) - 1) k2 from c6),
e as (select *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) a, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) b from k)
select rec_id, round(6378137.0 * (1 - 1 / 298.257223563::double) * a * (sigma - b * ss * (c2m + b / 4 * (cs * (2 * c2m * c2m - 1) - b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))), 3) as distance from e"""

def _direct(rounds: int) -> str:
    """CTEs of Vincenty's direct method on WGS84 for eight bearings and 1,000 m, its iteration written out."""
    f, a = "(1 / 298.257223563::double)", "6378137.0::double"
    out = [f"""q as (select distinct boot_id, radians(lat0) la, radians(lon0) lo from p), b as (select *, step * pi() / 4 as al from q, (select cast(unnest(range(0, 8)) as integer) step)),
c as (select *, atan((1 - {f}) * tan(la)) u, cos(atan((1 - {f}) * tan(la))) * sin(al) sa from b), k as (select *, atan2(tan(u), cos(al)) s1, (1 - sa * sa) * (1 / pow(1 - {f}, 2) - 1) k2 from c),
g0 as (select *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) ga, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) gb, 1000 / ({a} * (1 - {f}) * (1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))))) as sigma from k)"""]
    for n in range(rounds):
        out.append(f"g{n + 1} as (select * exclude (sigma), 1000 / ({a} * (1 - {f}) * ga) + gb * sin(sigma) * (cos(2 * s1 + sigma) + gb / 4 * (cos(sigma) * (2 * pow(cos(2 * s1 + sigma), 2) - 1) - gb / 6 * cos(2 * s1 + sigma) * (4 * pow(sin(sigma), 2) - 3) * (4 * pow(cos(2 * s1 + sigma), 2) - 3))) as sigma from g{n})")
    return ", ".join(out)


SQL["m17_ellipsoid_circles"] = f"""with {PLACES}, {_direct(6)},
z as (select *, sin(sigma) ss, cos(sigma) cs, cos(2 * s1 + sigma) c2m, sin(u) su, cos(u) cu, (1 / 298.257223563::double) / 16 * (1 - sa * sa) * (4 + (1 / 298.257223563::double) * (4 - 3 * (1 - sa * sa))) cc from g6),
y as (select boot_id, step, lo, atan2(su * cs + cu * ss * cos(al), (1 - 1 / 298.257223563::double) * sqrt(sa * sa + pow(su * ss - cu * cs * cos(al), 2))) at_la,
atan2(ss * sin(al), cu * cs - su * ss * cos(al)) - (1 - cc) * (1 / 298.257223563::double) * sa * (sigma + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))) gap from z)
select boot_id, step, round(degrees(at_la), 8) as at_lat, round(degrees(lo + gap - 2 * pi() * floor((lo + gap + pi()) / (2 * pi()))), 8) as at_lon from y"""

SQL["m18_ned"] = f"""with {PLACES}, c as (select rec_id, radians(lat) a, radians(lon) o, 6378137.0 va, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) e2 from p),
v as (select *, va / sqrt(1 - e2 * sin(a) * sin(a)) v, va / sqrt(1 - e2 * pow(sin(radians(-35.0)), 2)) v0 from c),
x as (select rec_id, (v + 100) * cos(a) * cos(o) - v0 * cos(radians(-35.0)) * cos(radians(149.0)) x, (v + 100) * cos(a) * sin(o) - v0 * cos(radians(-35.0)) * sin(radians(149.0)) y, (v * (1 - e2) + 100) * sin(a) - v0 * (1 - e2) * sin(radians(-35.0)) z from v)
select rec_id, round(-sin(radians(-35.0)) * cos(radians(149.0)) * x - sin(radians(-35.0)) * sin(radians(149.0)) * y + cos(radians(-35.0)) * z, 2) as north, round(-sin(radians(149.0)) * x + cos(radians(149.0)) * y, 2) as east,
round(-cos(radians(-35.0)) * cos(radians(149.0)) * x - cos(radians(-35.0)) * sin(radians(149.0)) * y - sin(radians(-35.0)) * z, 2) as down from x"""

SQL["m20_sun"] = """with m as (select distinct rec_id, lat / 1e7 lat, lon / 1e7 lon, case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end as moment from mavlink_gps2_raw_t join mavlink_boots using (boot_id)
 where time_usec <> 0 and case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end between boot_usec and off_usec and fix_type >= 2 and lat is not null and lon is not null and not (lat = 0 and lon = 0)),
d as (select *, moment / 86400000000.0::double - 10957.5 as d from m), e as (select *, radians(357.529 + 0.98560028 * d) g, radians(23.439 - 0.00000036 * d) tilt from d),
s as (select *, radians(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) ecl from e),
h as (select *, radians(280.46061837 + 360.98564736629 * d + lon - 360 * floor((280.46061837 + 360.98564736629 * d + lon) / 360)) - atan2(cos(tilt) * sin(ecl), cos(ecl)) as hour, asin(sin(tilt) * sin(ecl)) as decl, radians(lat) la from s),
a as (select rec_id, degrees(atan2(-sin(hour) * cos(decl), cos(la) * sin(decl) - sin(la) * cos(decl) * cos(hour))) az, degrees(asin(sin(la) * sin(decl) + cos(la) * cos(decl) * cos(hour))) el from h)
select rec_id, round(case when az < 0 then az + 360 else az end, 3) as azimuth, round(el, 3) as elevation from a"""

GROWN = "(r.variance + 4 * (q.t - r.t))"
SQL["m21_kalman"] = steps(
    "x::double as filtered, 100.0::double as variance", f"r.filtered + {GROWN} / ({GROWN} + 100) * (q.x - r.filtered), (1 - {GROWN} / ({GROWN} + 100)) * {GROWN}",
    "event_id, round(filtered, 6) + 0.0 as filtered, round(variance, 6) as variance", before=TIMED.replace("/ 1e6 as t", "/ 3.6e9 as t"),
)

# Least costs, the node before each on its path (the least of equal ones), and the way back from every node.
SQL["g02_paths"] = f"""with recursive {TRADE}, w as (select n_nationkey origin, n_nationkey id, cast(0.0 as double) cost, 0 depth from nation where n_nationkey in (select source from e)
 union all select origin, target, min(w.cost + e.cost), depth + 1 from w join e on w.id = e.source where depth < 5 group by all),
b as (select origin, id, min(cost) cost from w group by 1, 2), p as (select b.origin, b.id, min(c.id) as parent from b join e on e.target = b.id join b c on c.origin = b.origin and c.id = e.source and abs(c.cost + e.cost - b.cost) < 1e-9 where b.id <> b.origin group by 1, 2),
r as (select origin, id as target, id, 0 as back from b union all select r.origin, r.target, p.parent, back + 1 from r join p on p.origin = r.origin and p.id = r.id)
select r.origin, r.target, max(back) over (partition by r.origin, r.target) - back as step, r.id, round(b.cost, 6) as cost from r join b on b.origin = r.origin and b.id = r.id"""

#: Which point is reached from which: parts are named by their least point.
SQL["l11_visit_whole"] = f"""with recursive {pairs_sql(1.0, 'a.id <> b.id')}, s as (select block, min(id) as id from cloud group by 1),
r as (select block, id from s union select r.block, p.b_id from r join pairs p on p.a_id = r.id) select cloud.id, r.block as visited_by from cloud left join r on cloud.id = r.id"""

SQL["l11_visit"] = f"""with recursive {pairs_sql(1.0, 'a.id <> b.id')}, s as (select block, min(id) as id from cloud group by 1), near as (select c.id, c.block from cloud c join s using (block) join cloud o on o.id = s.id where (c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) + (c.z - o.z) * (c.z - o.z) <= 25),
r as (select block, id from s union select r.block, p.b_id from r join pairs p on p.a_id = r.id join near n on n.id = p.b_id) select cloud.id, r.block as visited_by from cloud left join r on cloud.id = r.id"""

#: Occupied voxels, numbered, with the least number of those they hang together with.
PARTS = f"""{CLOUD}, e as (select *, cast(floor(x / 2) as bigint) i, cast(floor(y / 2) as bigint) j, cast(floor(z / 2) as bigint) k from cloud),
v as (select *, row_number() over (order by block, i, j, k) as n from (select block, i, j, k, count(*) c from e group by all)),
w as (select a.n, b.n as other from v a cross join {STEPS} join v b on b.block = a.block and b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk where a.n <> b.n),
r(n, least) using key (n) as (select n, n from v union (select w.other, min(r.least) from r join w on w.n = r.n join recurring.r old on old.n = w.other where r.least < old.least group by 1))"""
SQL["v05_partitions"] = f"""with recursive {PARTS}, s as (select *, row_number() over (partition by block order by least) - 1 as partition from (select block, least from v join r using (n) group by 1, 2 having sum(c) >= 3))
select e.id, e.block, s.partition from e join v using (block, i, j, k) join r using (n) join s on s.block = e.block and s.least = r.least"""

# Lloyd's rounds: of each block that hasn't settled, the points go to their nearest centroids, whose means come next.
SQL["v08_k_means"] = f"""with recursive {CLOUD}, p as (select id, block, x, y, z from cloud),
s as (select block, row_number() over (partition by block order by id) - 1 as k, x, y, z from p qualify row_number() over (partition by block order by id) <= 4),
r as (select block, k, x, y, z, 0 as n, false as done from s union all
 (with a as (select p.block, p.id, arg_min(r.k, (pow(p.x - r.x, 2) + pow(p.y - r.y, 2) + pow(p.z - r.z, 2), r.k)) as k, any_value(p.x) x, any_value(p.y) y, any_value(p.z) z from p join r on r.block = p.block where not r.done and r.n < 300 group by 1, 2),
  m as (select block, k, avg(x) x, avg(y) y, avg(z) z from a group by 1, 2)
  select r.block, r.k, coalesce(m.x, 0), coalesce(m.y, 0), coalesce(m.z, 0), r.n + 1, sum(pow(coalesce(m.x, 0) - r.x, 2) + pow(coalesce(m.y, 0) - r.y, 2) + pow(coalesce(m.z, 0) - r.z, 2)) over (partition by r.block) < 1e-8
  from r left join m on m.block = r.block and m.k = r.k where not r.done and r.n < 300)),
c as (select * from r where (block, n) in (select (block, max(n)) from r group by block))
select p.id, arg_min(c.k, (pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2), c.k))::integer as cluster from p join c on c.block = p.block group by 1"""

SQL["l06_local_max_traced"] = f"""with recursive {pairs_sql(NEAR, 'a.id <> b.id')}, losers as (select distinct a_id from pairs where b_s > a_s or (b_s = a_s and b_id < a_id)),
best as (select id from cloud where scalar is not null and id not in (select a_id from losers)),
first as (select a.id, arg_min(b.id, ({D2}, b.id)) as ref from w a join e b on a.block = b.block and a.ni = b.i and a.nj = b.j and a.nk = b.k where {D2} <= {NEAR} * {NEAR} and a.scalar is not null and b.id in (select id from best) group by 1),
r(id, ref) using key (id) as (select id, ref from first union (select p.a_id, arg_min(k.ref, (p.d2, p.b_id)) from pairs p join recurring.r k on k.id = p.b_id where p.a_id not in (select id from recurring.r) and exists (select 1 from r) group by 1))
select c.id, r.ref as reference_id, round(coalesce(sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) + (c.z - o.z) * (c.z - o.z)), 0.0), 6) as distance from cloud c left join r on r.id = c.id left join cloud o on o.id = r.ref"""

BESIDE = "(select unnest(range(-1, 2)) di), (select unnest(range(-1, 2)) dj), (select unnest(range(-1, 2)) dk)"
CHANGE = "case when s - w < 4 or s - w > 6 then -1 when s - w - 4 < 6 - (s - w) then 1 else 0 end"
LIVING = "g{1} as (select i, j, k, least(1, w + {2}) w from (select n.i, n.j, n.k, n.s, coalesce(g.w, 0) w from (select i + di i, j + dj j, k + dk k, sum(w) s from g{0}, {3} group by all) n left join g{0} g on g.i = n.i and g.j = n.j and g.k = n.k) where least(1, w + {2}) > 0)"
SQL["l12_life"] = f"""with {CLOUD}, g0 as (select distinct cast(floor(x / 4) as bigint) i, cast(floor(y / 4) as bigint) j, cast(floor(z / 4) as bigint) k, 1 as w from cloud), {LIVING.format(0, 1, CHANGE, BESIDE)}, {LIVING.format(1, 2, CHANGE, BESIDE)}
{' union all '.join(f'select {g} as generation, i, j, k, cast(w as bigint) as weight from g{g}' for g in range(3))}"""

SQL["j17_changed"] = f"""with {POLAR}, w as (select q.id, q.r qr, p.id pid, p.r pr, p.b - q.b - 2 * pi() * floor((p.b - q.b + pi()) / (2 * pi())) turn, p.e - q.e rise from polar q join polar p on p.e > q.e - 0.0005 and p.e < q.e + 0.0005),
n as (select * from w where abs(turn) < 0.0005 and abs(rise) < 0.0005)
select id, arg_min(pid, (pr, pid)) as reference, min(pr) as reference_range from n group by 1 having min(turn) <= 0 and max(turn) >= 0 and min(rise) <= 0 and max(rise) >= 0"""


def queries() -> dict:
    return {}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
