"""Queries of the image operators. The embeddings serve as images: 8 x 8 grey values from 0 to 255, one frame each in order of vec_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import images as I
from quillon.plans.registry import Registry
from quillon.sources.messages import table

R = Registry()


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v.cast("double") * 400 + 128).cast("double")))).alias("v"))
    return I.from_arrays(e, "vec_id", "v", 8, 8)


def colours(spark: SparkSession, d: str) -> DataFrame:
    """Three channels: the frame, its rows mirrored, and half of it."""
    f = frames(spark, d)
    red = f.withColumns({"x": 7 - F.col("x"), "channel": F.lit(1)})
    half = f.withColumns({"value": F.floor(F.col("value") / 2).cast("double"), "channel": F.lit(2)})
    return f.unionByName(red).unionByName(half)


PX = """px as (select vec_id image, cast((k - 1) // 8 as integer) y, cast((k - 1) % 8 as integer) x, 0 channel, greatest(0.0::double, least(255.0::double, floor(cast(embedding[k] as double) * 400 + 128))) as value from embeddings, unnest(range(1, 65)) u(k))"""
C3 = f"{PX}, c as (from px union all select image, y, 7 - x, 1, value from px union all select image, y, x, 2, floor(value / 2) from px)"


def final(p: DataFrame, digits: int | None = None) -> DataFrame:
    v: Column = F.col("value").cast("double") if digits is None else F.round(F.col("value"), digits) + 0.0
    return p.select("image", *[F.col(c).cast("int").alias(c) for c in ("y", "x", "channel")], v.alias("value"))


def add(name: str, sql: str | None, make, digits: int | None = None, colour: bool = False) -> None:
    """A query of one operation on the frames (or the colour frames); sql is what follows the CTEs."""
    full = None if sql is None else f"with recursive {C3 if colour else PX} {sql}"

    def query(spark: SparkSession, d: str) -> DataFrame:
        return final(make(colours(spark, d) if colour else frames(spark, d)), digits)

    query.__name__ = name
    R.add(name, full)(query)


def px(value: str, y: str = "y", x: str = "x", where: str = "true", source: str = "px", channel: str = "channel") -> str:
    return f"select image, cast({y} as integer) as y, cast({x} as integer) as x, cast({channel} as integer) as channel, cast({value} as double) as value from {source} where {where}"


# single pixels
add("i_scale", px("value * 0.5 + 10"), lambda f: I.scale(f, 0.5, 10))
add("i_gamma", px("round(pow(value / 255, cast(0.5 as double)) * 255, 6)"), lambda f: I.gamma(f, 0.5), 6)
add("i_pow", px("value * value"), lambda f: I.power(f, 2.0))
add("i_invert", px("255 - value"), lambda f: I.invert(f))
add("i_threshold", px("case when value > 100 then 255 else 0 end"), lambda f: I.threshold(f, 100))
add("i_threshold_trunc", px("least(value, 100)"), lambda f: I.threshold(f, 100, "trunc"))
add("i_in_range", "select image, y, x, 0 as channel, case when bool_and(value between 20 and 200) then 255.0::double else 0.0::double end as value from c group by 1, 2, 3", lambda f: I.in_range(f, [20] * 3, [200] * 3), colour=True)
add("i_normalize_max", "select px.image, y, x, channel, round(value / m * 255, 6) as value from px join (select image, max(value) m from px group by 1) q on px.image = q.image", lambda f: I.normalize_max(f), 6)
add("i_normalize_sum", "select image, y, x, channel, round(case when s <> 0 then value / s else 0 end, 6) as value from (select *, sum(value) over (partition by image, y, x) s from c)", lambda f: I.normalize_sum(f), 6, True)
add("i_magnitude", "select image, y, x, 0 as channel, round(sqrt(sum(value * value)), 6) as value from c group by 1, 2, 3", lambda f: I.magnitude(f), 6, True)
add("i_shuffle", px("value", channel="(channel + 2) % 3", source="c"), lambda f: I.combine_channels(f, [[0, 1, 0], [0, 0, 1], [1, 0, 0]]), colour=True)
add("i_linear_combination", "select image, y, x, 0 as channel, round(sum(case channel when 0 then 0.5 when 1 then 0.25 else 2 end * value), 6) as value from c group by 1, 2, 3", lambda f: I.combine_channels(f, [[0.5, 0.25, 2]]), 6, True)
add("i_ratio", "select image, y, x, 0 as channel, round(case when sum(case channel when 1 then value else 0 end) <> 0 then sum(case channel when 0 then value else 0 end) / sum(case channel when 1 then value else 0 end) else 0 end, 6) as value from c group by 1, 2, 3", lambda f: I.combine_channels(f, [[1, 0, 0]], [[0, 1, 0]]), 6, True)
add("i_grey", "select image, y, x, 0 as channel, round(sum(case channel when 0 then 0.114 when 1 then 0.587 else 0.299 end * value), 6) as value from c group by 1, 2, 3", lambda f: I.to_grey(f), 6, True)
add("i_color_map", f"{px('round(value / 255 * 100, 6)')} union all {px('round(200 - value / 255 * 200, 6)', channel='1')}", lambda f: I.color_map(f, [0, 200], [100, 0]), 6)
add("i_pack", "select image, y, x, 0 as channel, cast(sum(value * case channel when 0 then 1 when 1 then 256 else 65536 end) as double) as value from c group by 1, 2, 3", lambda f: I.pack_bits(f, 8, 3), colour=True)
add("i_unpack", f"{px('cast(value as integer) % 16')} union all {px('cast(value as integer) // 16', channel='1')}", lambda f: I.unpack_bits(f, 4, 2))

add("i_threshold_otsu", """, h as (select image, value, count(*) n from px group by 1, 2), w as (select *, sum(n) over (partition by image) a, sum(n * value) over (partition by image) s, sum(n) over (partition by image order by value) c, sum(n * value) over (partition by image order by value) t from h),
b as (select image, arg_max(value, (case when c < a then (s * c - t * a) * (s * c - t * a) / (c * (a - c)) else 0 end, -value)) as at_ from w group by 1) select px.image, y, x, channel, case when value > at_ then 255.0::double else 0.0::double end as value from px join b using (image)""", lambda f: I.otsu(f))
add("i_convert_ub", px("greatest(0, least(255, round_even(value * 1.5 - 50, 0)))"), lambda f: I.convert_to(f, "ub", 1.5, -50))
add("i_convert_w", px("greatest(-32768, least(32767, round_even(value * 300.5 - 20000, 0)))"), lambda f: I.convert_to(f, "w", 300.5, -20000))
add("i_convert_f", px("cast(cast(value / 3 as float) as double)"), lambda f: I.convert_to(f, "f", 1 / 3))
RGB = "w as (select image, y, x, max(value) filter (channel = 0) r, max(value) filter (channel = 1) g, max(value) filter (channel = 2) b from c group by 1, 2, 3)"


def three(name: str, values: tuple[str, str, str], make, before: str = "") -> None:
    add(name, f", {RGB}{before} " + " union all ".join(px(f"round({v}, 6) + 0.0", source="w" if not before else "u", channel=str(k)) for k, v in enumerate(values)), make, 6, True)


SPAN = "(greatest(r, g, b) - least(r, g, b))"
HUE = f"(case when {SPAN} = 0 then 0 when greatest(r, g, b) = r then 60 * (g - b) / {SPAN} when greatest(r, g, b) = g then 120 + 60 * (b - r) / {SPAN} else 240 + 60 * (r - g) / {SPAN} end)"
three("i_hsv", (f"case when {HUE} < 0 then {HUE} + 360 else {HUE} end / 2", f"case when greatest(r, g, b) > 0 then 255 * {SPAN} / greatest(r, g, b) else 0 end", "greatest(r, g, b)"), lambda f: I.to_hsv(f))
three("i_hsv_and_back", ("r", "g", "b"), lambda f: I.from_hsv(I.to_hsv(f)))
LINEAR = ", u as (select *, r * 0.412453 + g * 0.357580 + b * 0.180423 ux, r * 0.212671 + g * 0.715160 + b * 0.072169 uy, r * 0.019334 + g * 0.119193 + b * 0.950227 uz from w)"
three("i_xyz", ("ux", "uy", "uz"), lambda f: I.to_xyz(f), LINEAR)
LAB = "(case when {0} > 0.008856 then cbrt({0}) else 7.787 * {0} + 16 / 116::double end)"
X, Y, Z = (LAB.format(v) for v in ("(ux / 255 / 0.950456)", "(uy / 255)", "(uz / 255 / 1.088754)"))
three("i_lab", ("case when uy / 255 > 0.008856 then 116 * cbrt(uy / 255) - 16 else 903.3 * uy / 255 end", f"500 * ({X} - {Y})", f"200 * ({Y} - {Z})"), lambda f: I.to_lab(f), LINEAR)
add("i_ndvi", f", {RGB} select image, y, x, 0 as channel, round(case when r + b <> 0 then (b - r) / (b + r) else 0 end, 6) + 0.0 as value from w", lambda f: I.ndvi(f, 0, 2), 6, True)
add("i_multiply_powers", f", {RGB} select image, y, x, 0 as channel, round(sqrt(r) * g * pow(b + 0.0, 2.0::double), 4) as value from w", lambda f: I.multiply_powers(f, [0.5, 1, 2]), 4, True)

# layout
add("i_crop", px("value", "y - 2", "x - 1", "x between 1 and 4 and y between 2 and 6"), lambda f: I.crop(f, 1, 2, 4, 5))
add("i_crop_cols", f"{px('value', x='x - 5', where='x >= 5')} union all {px('value', x='x + 3', where='x < 2')}", lambda f: I.crop_lines(f, [(5, 3), (0, 2)]))
add("i_crop_rows", px("value", y="y - 3", where="y between 3 and 5"), lambda f: I.crop_lines(f, [(3, 3)], "y"))
add("i_bands", "select image, y, cast(0 as integer) as x, channel, round(avg(value), 6) as value from px where x < 4 group by all union all select image, y, 1, channel, round(avg(value), 6) from px where x between 2 and 7 group by all", lambda f: I.bands(f, [(0, 4), (2, 6)]), 6)
add("i_untile_tile", px("value"), lambda f: I.tile(I.untile(f, 2, 4, 4, 2), 4, 4, 2))
add("i_cols_to_channels", px("value", x="x // 4", channel="x % 4"), lambda f: I.lines_to_channels(f, [0, 1, 2, 3], "x", 4))
add("i_channels_to_cols", px("value", x="x * 3 + channel", channel="0", source="c"), lambda f: I.channels_to_lines(f, 3), colour=True)
add("i_pad", f"{px('value', 'y + 1', 'x + 2')} union all select image, y, x, 0, 7.0::double from (select distinct image from px), (select cast(unnest(range(0, 10)) as integer) y), (select cast(unnest(range(0, 11)) as integer) x) where y < 1 or y > 8 or x < 2 or x > 9", lambda f: I.pad(f, 1, 1, 2, 1, 7.0))
add("i_resize", "select image, cast(ny as integer) as y, cast(nx as integer) as x, channel, value from px join (select unnest(range(0, 5)) ny) on y = ny * 8 // 5 join (select unnest(range(0, 12)) nx) on x = nx * 8 // 12", lambda f: I.resize(f, 5, 12))
#: Of an axis with n new places for 8 old ones: the two old ones beside each and the weight of the second.
BESIDE = "(select n, floor(p) lo, least(floor(p) + 1, 7) hi, p - floor(p) w from (select n, greatest(0, least(7, (n + 0.5) * 8 / {0} - 0.5)) p from (select unnest(range(0, {0})) n)))"
add("i_resize_linear", f""", ys as (select px.image, j.n y, x, sum(value * case when y = lo and y = hi then 1 when y = lo then 1 - w else w end) as v from px join {BESIDE.format(5)} j on y = lo or y = hi group by all)
select image, cast(y as integer) as y, cast(i.n as integer) as x, 0 as channel, round(sum(v * case when x = lo and x = hi then 1 when x = lo then 1 - w else w end), 6) as value from ys join {BESIDE.format(12)} i on x = lo or x = hi group by image, y, i.n""", lambda f: I.resize(f, 5, 12, linear=True), 6)
add("i_flip", px("value", "7 - y"), lambda f: I.flip(f))
add("i_flop", px("value", x="7 - x"), lambda f: I.flop(f))
add("i_transpose", px("value", "x", "y"), lambda f: I.transpose(f))
add("i_rotate90", px("value", "x", "7 - y"), lambda f: I.rotate90(f))
add("i_split", px("value", "y + channel * 8", channel="0", source="c"), lambda f: I.split(f), colour=True)
add("i_split_merge", px("value", source="c"), lambda f: I.merge(I.split(f), 3), colour=True)
add("i_clone_channels", f"{px('value')} union all {px('value', channel='1')}", lambda f: I.clone_channels(f, 2))


def _remap(f: DataFrame) -> DataFrame:
    return I.remap(f, I.equirectangular_table(f.sparkSession, 8, 8, 2.0, 4))


add("i_remap_equirectangular", """, v as (select y, x, x - 1.5 dx, y - 1.5 dy from (select unnest(range(0, 4)) y), (select unnest(range(0, 4)) x)),
t as (select y, x, least(7, floor((pi() / 2 - atan2(-dy, sqrt(dx * dx + 4))) / pi() * 8)) from_y, floor((atan2(dx, 2.0) + pi()) / (2 * pi()) * 8) % 8 from_x from v)
select image, cast(t.y as integer) as y, cast(t.x as integer) as x, channel, value from px join t on px.y = from_y and px.x = from_x""", _remap)

add("i_undistort", """, g as (select image, cast(ny as integer) ny, cast(nx as integer) nx, (nx - 3.5) / 6.0 u, (ny - 3.5) / 6.0 v from (select distinct image from px), (select unnest(range(0, 8)) ny), (select unnest(range(0, 8)) nx)),
d as (select *, 1 + (u * u + v * v) * (-0.2 + (u * u + v * v) * 0.05) f from g), t as (select image, ny, nx, floor((v * f + 0.01 * (u * u + 3 * v * v) - 0.02 * u * v) * 6 + 4.0) py, floor((u * f + 0.02 * u * v - 0.01 * (3 * u * u + v * v)) * 6 + 4.0) px_ from d)
select t.image, ny as y, nx as x, 0 as channel, coalesce(value, 0.0::double) as value from t left join px on px.image = t.image and px.y = py and px.x = px_""", lambda f: I.undistort(f, 8, 8, (6.0, 6.0), (3.5, 3.5), (-0.2, 0.05), (0.01, -0.01)))

# frames
OVER = "(partition by y, x, channel order by image rows between {} preceding and current row)"
add("i_average", px(f"round(avg(value) over {OVER.format('unbounded')} + 1.3e-9, 6)"), lambda f: I.scale(I.accumulate(f, "average"), 1.0, 1.3e-9), 6)
add("i_max", px(f"max(value) over {OVER.format('unbounded')}"), lambda f: I.accumulate(f, "max"))
add("i_min", px(f"min(value) over {OVER.format('unbounded')}"), lambda f: I.accumulate(f, "min"))
add("i_moving_average", px(f"round(avg(value) over {OVER.format(4)} + 1.3e-9, 6)"), lambda f: I.scale(I.accumulate(f, "average", size=5), 1.0, 1.3e-9), 6)
# From the fourth frame on, a frame counts 0.2 times 0.8 to the power of its age; those older than 150 frames no longer show.
add("i_ema", """, o as (select *, row_number() over (partition by y, x order by image) n, avg(value) over (partition by y, x order by image rows unbounded preceding) m from px),
e as (select a.image, a.y, a.x, a.n, sum(case when b.n >= 4 then 0.2 * pow(0.8, a.n - b.n) * b.value when b.n = 3 then pow(0.8, a.n - 3) * b.m else 0 end) s from o a join o b on a.y = b.y and a.x = b.x and b.n between a.n - 150 and a.n where a.n >= 4 group by all)
select image, y, x, 0 as channel, round(m, 6) as value from o where n < 4 union all select image, y, x, 0, round(s, 6) from e""", lambda f: I.moving_average(f, 0.2, 4), 6)
add("i_slide", "select 0 as image, cast(y + image * 8 as integer) as y, x, channel, value from px", lambda f: I.slide(f, 8))

# two branches
for _how, _sql in {"add": "p.value + q.value", "subtract": "p.value - q.value", "multiply": "p.value * q.value", "divide": "round(case when q.value <> 0 then p.value / q.value else 0 end, 6)", "absdiff": "abs(p.value - q.value)", "and": "cast(p.value as integer) & cast(q.value as integer)", "or": "cast(p.value as integer) | cast(q.value as integer)", "xor": "xor(cast(p.value as integer), cast(q.value as integer))"}.items():
    add(f"i_{_how}", f"select p.image, p.y, p.x, p.channel, cast({_sql} as double) as value from px p join px q on p.image = q.image and p.y = q.y and p.x = 7 - q.x", lambda f, how=_how: I.combine(f, I.flop(f), how), 6 if _how == "divide" else None)
add("i_bitwise", "select p.image, p.y, p.x, p.channel, cast((cast(p.value as integer) & (cast(q.value as integer) | (255 - cast(p.value as integer)))) | xor(cast(q.value as integer), 15) as double) as value from px p join px q on p.image = q.image and p.y = q.y and p.x = 7 - q.x", lambda f: I.bitwise({"a": f, "b": I.flop(f)}, "a & (b | ~a) | b ^ 15"))
add("i_mask", px("case when value > 100 then value else 0 end"), lambda f: I.mask(f, I.threshold(f, 100)))

# surroundings
NEAR = "n as (select a.image, a.y, a.x, b.value from px a join px b on a.image = b.image and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1)"
add("i_dilate", f", {NEAR} select image, y, x, 0 as channel, max(value) as value from n group by 1, 2, 3", lambda f: I.morphology(f, "dilate"))
add("i_erode", f", {NEAR} select image, y, x, 0 as channel, min(value) as value from n group by 1, 2, 3", lambda f: I.morphology(f, "erode"))
add("i_morphological_gradient", f", {NEAR} select image, y, x, 0 as channel, max(value) - min(value) as value from n group by 1, 2, 3", lambda f: I.morphology(f, "gradient"))


def around(name: str, source: str, value: str, outside: str = "none", where: str = "true") -> str:
    """A CTE name(image, y, x, value): value aggregates v over the nine pixels about each of source; dy and dx lead to them.

    outside: none (there are none), reflect (mirrored about the edge pixel), edge (the edge pixel again) or torus.
    """
    at = {"none": "{} + {}", "reflect": "case when {0} + {1} < 0 then 1 when {0} + {1} > 7 then 6 else {0} + {1} end", "torus": "({} + {} + 8) % 8", "edge": "greatest(0, least(7, {} + {}))"}[outside]
    return f"""{name} as (select a.image, a.y, a.x, {value} as value from {source} a cross join (select unnest([-1, 0, 1]) dy) cross join (select unnest([-1, 0, 1]) dx)
join (select image, y yy, x xx, value v from {source}) b on b.image = a.image and yy = {at.format('a.y', 'dy')} and xx = {at.format('a.x', 'dx')} where {where} group by a.image, a.y, a.x)"""


SELF_AGAIN = "any_value(a.value)"
ON = "b as (select image, y, x, case when value > {} then 255.0::double else 0.0::double end as value from px)"
MOST, LEAST = "max(v)", "min(v)"
OPENED, CLOSED = f", {around('e', 'px', LEAST)}, {around('o', 'e', MOST)}", f", {around('e', 'px', MOST)}, {around('o', 'e', LEAST)}"
add("i_open", f"{OPENED} {px('value', source='o', channel='0')}", lambda f: I.morphology(f, "open"))
add("i_close", f"{CLOSED} {px('value', source='o', channel='0')}", lambda f: I.morphology(f, "close"))
add("i_tophat", f"{OPENED} select p.image, p.y, p.x, 0 as channel, p.value - o.value as value from px p join o using (image, y, x)", lambda f: I.morphology(f, "tophat"))
add("i_blackhat", f"{CLOSED} select p.image, p.y, p.x, 0 as channel, o.value - p.value as value from px p join o using (image, y, x)", lambda f: I.morphology(f, "blackhat"))
# After four erosions nothing is left of 8 x 8 pixels.
SKELETON = "".join(f", {around(f's{k + 1}', f's{k}', 'case when count(*) = 9 then min(v) else 0.0::double end')}, {around(f'd{k}', f's{k + 1}', MOST)}, k{k} as (select a.image, a.y, a.x, a.value - least(a.value, d.value) as value from s{k} a join d{k} d using (image, y, x))" for k in range(4))
add("i_skeleton", f", {ON.format(100)}, s0 as (select * from b){SKELETON} select image, y, x, 0 as channel, max(value) as value from ({' union all '.join(f'select * from k{k}' for k in range(4))}) group by 1, 2, 3", lambda f: I.morphology(I.threshold(f, 100), "skeleton"))


def nine(name: str, value: str, make, outside: str = "reflect", digits: int = 6, before: str = "", source: str = "px", where: str = "true") -> None:
    add(name, f"{before}, {around('r', source, value, outside, where)} select image, y, x, 0 as channel, round(value, {digits}) + 0.0 as value from r", make, digits)


nine("i_convolution", "sum(v * case abs(dy) + abs(dx) when 0 then 5 when 1 then -1 else 0 end)", lambda f: I.convolve(f, [[0, -1, 0], [-1, 5, -1], [0, -1, 0]]))
nine("i_blur_box", "avg(v)", lambda f: I.blur(f, "box", 3))
nine("i_blur_gaussian", "sum(v * exp(-(dy * dy + dx * dx) / 2.0)) / pow(1 + 2 * exp(-0.5::double), 2)", lambda f: I.blur(f, "gaussian", 3))
nine("i_blur_median", "median(v)", lambda f: I.blur(f, "median", 3))
nine("i_contraharmonic", "case when sum(v + 1) <> 0 then sum((v + 1) * (v + 1)) / sum(v + 1) else 0 end", lambda f: I.contraharmonic(I.scale(f, 1.0, 1.0), 3, 1.0))
nine("i_remove_mean", f"{SELF_AGAIN} - avg(v)", lambda f: I.remove_mean(f, 3))
nine("i_hard_edge", f"case when {SELF_AGAIN} <> 0 and min(v) filter (abs(dy) + abs(dx) = 1) = 0 then {SELF_AGAIN} else 0.0::double end", lambda f: I.hard_edge(I.threshold(f, 100)), "none", before=f", {ON.format(100)}", source="b")
nine("i_remove_speckles", f"case when count(*) = 9 and max(v) filter (dy <> 0 or dx <> 0) = 0 then 0.0::double else {SELF_AGAIN} end", lambda f: I.remove_speckles(I.threshold(f, 170), 1), "none", before=f", {ON.format(170)}", source="b")
BESIDE_GRADIENT = "coalesce(sum(v) filter (dy = {0} * (dir in (1, 2, 3))::int and dx = {0} * case dir when 0 then 1 when 1 then 1 when 2 then 0 else -1 end), 0)"
add("i_canny", f""", {around('gx', 'px', 'sum(v * dx * (2 - abs(dy)))', 'edge')}, {around('gy', 'px', 'sum(v * dy * (2 - abs(dx)))', 'edge')},
g as (select image, y, x, abs(gx.value) + abs(gy.value) as value, (round(atan2(gy.value, gx.value) / (pi() / 4))::int + 8) % 4 as dir from gx join gy using (image, y, x)),
m as (select image, a.y, a.x, any_value(a.value) value, {BESIDE_GRADIENT.format(1)} ahead, {BESIDE_GRADIENT.format(-1)} behind from g a join (select image, y yy, x xx, value v from g) b using (image)
 cross join (select unnest([-1, 0, 1]) dy) cross join (select unnest([-1, 0, 1]) dx) where yy = a.y + dy and xx = a.x + dx group by image, a.y, a.x, dir),
k as (select image, y, x, value from m where value > 200 and value > behind and value >= ahead), r as (select image, y, x from k where value > 400 union select k.image, k.y, k.x from r join k on k.image = r.image and abs(k.y - r.y) <= 1 and abs(k.x - r.x) <= 1)
select p.image, p.y, p.x, 0 as channel, case when r.image is null then 0.0::double else 255.0::double end as value from px p left join r using (image, y, x)""", lambda f: I.edges(f, 200, 400))
# A tile has 16 pixels, and no bin keeps more than one of them; what is cut off is shared out over all 256 bins.
TILE_MAP = "(count(distinct t.value) filter (t.value <= p.value) + (p.value + 1) * (16 - count(distinct t.value)) / 256) / 16 * 255"
add("i_clahe", f""", p as (select *, greatest(0, least(1, (y + 0.5) / 4 - 0.5)) fy, greatest(0, least(1, (x + 0.5) / 4 - 0.5)) fx from px),
t as (select image, y // 4 j, x // 4 i, value from px), m as (select p.image, p.y, p.x, fy, fx, j, i, {TILE_MAP} as v from p join t on p.image = t.image group by p.image, p.y, p.x, p.value, fy, fx, j, i)
select image, y, x, 0 as channel, round(sum(v * case when j = floor(fy) then 1 - (fy - floor(fy)) when j = floor(fy) + 1 then fy - floor(fy) else 0 end * case when i = floor(fx) then 1 - (fx - floor(fx)) when i = floor(fx) + 1 then fx - floor(fx) else 0 end), 4) as value from m group by 1, 2, 3""", lambda f: I.equalize_locally(f, 4, 2.0), 4)
add("i_fft", """, w as (select image, fy, fx, sum(value * cos(2 * pi() * (fy * y + fx * x) / 8)) re, sum(value * sin(2 * pi() * (fy * y + fx * x) / 8)) im from px, (select cast(unnest(range(0, 8)) as integer) fy), (select cast(unnest(range(0, 8)) as integer) fx) group by all)
select image, fy as y, fx as x, 0 as channel, round(sqrt(re * re + im * im), 4) as value from w""", lambda f: I.transform_fft(f, magnitude_only=True), 4)
add("i_fft_inverse", px("round(value, 4) + 0.0"), lambda f: I.transform_fft(I.transform_fft(f), inverse=True), 4)
# The colour of a sample is that of its place: 0 red, 1 green, 2 blue.
BAYER = "case when yy % 2 = 0 and xx % 2 = 0 then 0 when yy % 2 = 1 and xx % 2 = 1 then 2 else 1 end"
add("i_bayer", f", {', '.join(around(f'c{k}', 'px', f'avg(v) filter ({BAYER} = {k})') for k in range(3))} {' union all '.join(px('round(value, 6)', source=f'c{k}', channel=str(k)) for k in range(3))}", lambda f: I.bayer(f), 6)
add("i_equalize_histogram", """, h as (select image, channel, value, count(*) n from px group by all), r as (select *, sum(n) over (partition by image, channel order by value) c, sum(n) over (partition by image, channel) a, first(n) over (partition by image, channel order by value) f from h)
select px.image, y, x, px.channel, round((c - f) / (a - f) * 255) as value from px join r on px.image = r.image and px.channel = r.channel and px.value = r.value""", lambda f: I.equalize(f))
add("i_balance_white", """, q as (select image, quantile_cont(value, 0.05) lo, quantile_cont(value, 0.95) hi from px group by 1) select px.image, y, x, channel, round(greatest(0, least(255, (value - lo) / (hi - lo) * 255)), 6) as value from px join q on px.image = q.image""", lambda f: I.balance_white(f), 6)
LIFE = "floor(greatest(0, least(255, any_value(a.value) + 255 * case when {0} < 3 or {0} > 4 then -1 when {0} - 3 < 4 - {0} then 1 else 0 end)))".format("(sum(v) filter (dy <> 0 or dx <> 0) / 255)")
add("c_life", f", {around('g1', 'px', LIFE, 'torus')}, {around('g2', 'g1', LIFE, 'torus')}, {around('g3', 'g2', LIFE, 'torus')} {px('value', source='g3', channel='0')}", lambda f: I.life(f, 3))
add("c_stride_unstride", "select image, y, x, channel, value from px where y < 7 and x < 8", lambda f: I.unstride(I.stride(f, 3, 4, 2, 2), 8, 4, 2, 2, "max"))
add("c_grep", px("value", where="image in (select image from px group by 1 having avg(case when value > 150 then 1.0 else 0.0 end) between 0.2 and 0.4)"), lambda f: I.grep(f, 0.2, 0.4, I.threshold(f, 150)))


@R.add("c_histogram", f"with {PX}, b as (select image, 0 channel, cast(unnest(range(0, 256)) as integer) bin from (select distinct image from px)) select b.image, b.channel, b.bin, count(px.value) as count from b left join px on px.image = b.image and cast(px.value as integer) = b.bin group by all")
def c_histogram(spark: SparkSession, d: str) -> DataFrame:
    return I.histogram(frames(spark, d))


@R.add("c_mean", f"with {PX} select image, channel, round(avg(value) filter (value > 100), 6) as mean, count(*) filter (value > 100) as count from px group by 1, 2")
def c_mean(spark: SparkSession, d: str) -> DataFrame:
    return I.mean(frames(spark, d), 100).select("image", "channel", F.round("mean", 6).alias("mean"), "count")


@R.add("c_header", f"with {PX} select image, cast(max(y) + 1 as integer) as rows, cast(max(x) + 1 as integer) as cols, cast(max(channel) + 1 as integer) as channels from px group by 1")
def c_header(spark: SparkSession, d: str) -> DataFrame:
    return I.sizes(frames(spark, d)).select("image", *[F.col(c).cast("int").alias(c) for c in ("rows", "cols", "channels")])


@R.add("c_stride_count", f"with {PX} select image, cast(unnest(range(0, 9)) as integer) as part, 12 as pixels from (select distinct image from px)")
def c_stride_count(spark: SparkSession, d: str) -> DataFrame:
    return I.stride(frames(spark, d), 3, 4, 2, 2).groupBy("image", "part").agg(F.count(F.lit(1)).cast("int").alias("pixels"))


@R.add("c_roi", f"with {PX} select image, y, x, channel, case when x >= 1 and x < 5 and y >= 2 and y < 2 + image % 5 then value else 0.0::double end as value from px")
def c_roi(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    boxes = f.select("image").distinct().select("image", F.lit(1).alias("min_x"), F.lit(2).alias("min_y"), F.lit(5).alias("max_x"), (2 + F.col("image") % 5).alias("max_y"))
    return final(I.region_of_interest(f, boxes))


@R.add("c_enumerate", f"with {PX} select image, row_number() over (order by image) - 1 as number from (select distinct image from px)")
def c_enumerate(spark: SparkSession, d: str) -> DataFrame:
    from quillon.plans.partitioning import row_blocks

    ids = frames(spark, d).select("image").distinct().withColumn("all", F.lit(0))
    numbered = row_blocks(ids, ["all"], [F.col("image")], F.floor(F.col("image") / 1024), 4096, 0)
    return numbered.select("image", F.col("_row").cast("long").alias("number"))


@R.add("c_thin")
def c_thin(spark: SparkSession, d: str) -> DataFrame:
    return final(I.thin_images(frames(spark, d), 0.5))


@R.add("c_crop_random")
def c_crop_random(spark: SparkSession, d: str) -> DataFrame:
    return final(I.crop_random(frames(spark, d), 4, 4, 7))


@R.add("c_unstride_positions", f"with {PX} select image, y, x, (y // 3) * 2 + x as image_y, (y % 3) * 2 + x as image_x from (select distinct image, y, x from px)")
def c_unstride_positions(spark: SparkSession, d: str) -> DataFrame:
    p = frames(spark, d).select("image", "y", "x").distinct()
    return I.unstride_positions(p, "y", "x", "x", 8, 4, 2, 2).select("image", "y", "x", F.col("image_y").cast("int").alias("image_y"), F.col("image_x").cast("int").alias("image_x"))


#: Which pixels above 140 are reached from which; those of one region have one least number.
def reach(steps: str) -> str:
    return f"""on_ as (select image, y, x from px where value > 140), r as (select image, y, x, y * 8 + x as n from on_ union
select o.image, o.y, o.x, r.n from r join on_ o on o.image = r.image and {steps}), f as (select image, y, x, min(n) least from r group by 1, 2, 3),
k as (select image, least, row_number() over (partition by image order by least) - 1 as region, c from (select image, least, count(*) c from f group by 1, 2 having count(*) >= 2))"""


@R.add("i_regions", f"with recursive {PX}, {reach('abs(o.y - r.y) + abs(o.x - r.x) = 1')} select image, y, x, region from f join k using (image, least)")
def i_regions(spark: SparkSession, d: str) -> DataFrame:
    return I.regions(I.threshold(frames(spark, d), 140), 2)


@R.add("i_blobs", f"with recursive {PX}, {reach('abs(o.y - r.y) <= 1 and abs(o.x - r.x) <= 1')} select image, region, round(avg(y), 6) as y, round(avg(x), 6) as x, count(*) as size from f join k using (image, least) group by 1, 2")
def i_blobs(spark: SparkSession, d: str) -> DataFrame:
    b = I.blobs(I.threshold(frames(spark, d), 140), 2)
    return b.select("image", "region", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "size")


@R.add("i_map", f"with {PX} select image, y, x, channel, floor(value / 16) as value from px")
def i_map(spark: SparkSession, d: str) -> DataFrame:
    t = spark.range(256).select(F.col("id").cast("double").alias("value"), F.floor(F.col("id") / 16).alias("to"))
    return final(I.map_values(frames(spark, d), t))
