"""Image operations.

An image is rows of a pixel table: (image, y, x, channel, value), from 0; frames of a stream also have an order column. What moves or maps single
pixels, or sums them, is an expression, a join on indices or an aggregation. What needs a pixel's surroundings gets one array per image
(image, rows, cols, channels, data) and runs in numpy on Arrow batches: an image is a bounded unit. Null values are no pixels.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.voxels import components
from quillon.plans.partitioning import chunked, extended, ordered_scan, own, running

PIXEL = ["image", "y", "x", "channel"]

# --- between arrays and pixels ------------------------------------------------------------------------------------------


def from_arrays(df: DataFrame, image: str, data: str, rows: int, cols: int, channels: int = 1) -> DataFrame:
    """Pixels of images whose values lie in an array by rows, channels innermost; arrays of another size give nothing."""
    flat = df.filter(F.size(data) == rows * cols * channels).select(F.col(image).alias("image"), F.posexplode(data).alias("_p", "value"))
    return flat.select("image", F.floor(F.col("_p") / (cols * channels)).cast("int").alias("y"), (F.floor(F.col("_p") / channels) % cols).cast("int").alias("x"), (F.col("_p") % channels).cast("int").alias("channel"), F.col("value").cast("double").alias("value"))


def to_arrays(pixels: DataFrame, background: float = 0.0) -> DataFrame:
    """(image, rows, cols, channels, data): one array by rows; pixels that are missing get the background."""
    size = pixels.groupBy("image").agg((F.max("y") + 1).cast("int").alias("rows"), (F.max("x") + 1).cast("int").alias("cols"), (F.max("channel") + 1).cast("int").alias("channels"), F.collect_list(F.struct("y", "x", "channel", F.col("value").cast("double").alias("value"))).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            v = b.column("_v")
            offsets, flat = v.offsets.to_numpy(), v.flatten()
            f = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "channel", "value")}
            base = offsets[0]
            for i, (r, c, k) in enumerate(zip(*(b.column(n).to_pylist() for n in ("rows", "cols", "channels")), strict=True)):
                s = slice(offsets[i] - base, offsets[i + 1] - base)
                a = np.full((r, c, k), background)
                a[f["y"][s], f["x"][s], f["channel"][s]] = f["value"][s]
                out.append(a.ravel())
            yield pa.record_batch([b.column("image"), b.column("rows"), b.column("cols"), b.column("channels"), pa.array(out, pa.list_(pa.float64()))], ["image", "rows", "cols", "channels", "data"])

    schema = extended(pixels.select("image").schema, "rows int, cols int, channels int, data array<double>")
    return size.mapInArrow(run, schema)


def to_pixels(arrays: DataFrame) -> DataFrame:
    """Pixels of (image, rows, cols, channels, data)."""
    flat = arrays.select("image", "cols", "channels", F.posexplode("data").alias("_p", "value"))
    return flat.select("image", F.floor(F.col("_p") / (F.col("cols") * F.col("channels"))).cast("int").alias("y"), (F.floor(F.col("_p") / F.col("channels")) % F.col("cols")).cast("int").alias("x"), (F.col("_p") % F.col("channels")).cast("int").alias("channel"), "value")


def on_arrays(pixels: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """function(rows x cols x channels) -> the like, image by image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, data = [], []
            for r, c, k, d in zip(*(b.column(n).to_pylist() for n in ("rows", "cols", "channels", "data")), strict=True):
                a = np.asarray(function(np.asarray(d).reshape(r, c, k)), dtype=float)
                sizes.append(a.shape)
                data.append(a.ravel())
            cols = [pa.array([s[i] for s in sizes], pa.int32()) for i in range(3)]
            yield pa.record_batch([b.column("image"), *cols, pa.array(data, pa.list_(pa.float64()))], ["image", "rows", "cols", "channels", "data"])

    arrays = to_arrays(pixels)
    return to_pixels(arrays.mapInArrow(run, arrays.schema))


def sizes(pixels: DataFrame) -> DataFrame:
    """(image, rows, cols, channels): the header."""
    return pixels.groupBy("image").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"), (F.max("channel") + 1).alias("channels"))


# --- single pixels -------------------------------------------------------------------------------------------------------


def each(pixels: DataFrame, value: Column) -> DataFrame:
    return pixels.withColumn("value", value)


def clip(value: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def scale(pixels: DataFrame, by: float, offset: float = 0.0) -> DataFrame:
    """Brightness, and conversion to another range."""
    return each(pixels, F.col("value") * by + offset)


def gamma(pixels: DataFrame, exponent: float, top: float = 255.0) -> DataFrame:
    return each(pixels, F.pow(clip(F.col("value"), 0.0, top) / top, F.lit(exponent)) * top)


def power(pixels: DataFrame, exponent: float) -> DataFrame:
    return each(pixels, F.pow("value", F.lit(exponent)))


def invert(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    return each(pixels, top - F.col("value"))


def threshold(pixels: DataFrame, at: float, kind: str = "binary", top: float = 255.0) -> DataFrame:
    """binary, binary_inv, trunc, tozero or tozero_inv; above means more than at."""
    above = F.col("value") > at
    v, zero = F.col("value"), F.lit(0.0)
    out = {"binary": F.when(above, F.lit(top)).otherwise(zero), "binary_inv": F.when(above, zero).otherwise(F.lit(top)), "trunc": F.when(above, F.lit(float(at))).otherwise(v), "tozero": F.when(above, v).otherwise(zero), "tozero_inv": F.when(above, zero).otherwise(v)}
    return each(pixels, out[kind])


def otsu(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    """binary threshold of each image and channel at the value that parts it best: the largest variance between the two classes (ties: the least value)."""
    counts = pixels.groupBy("image", "channel", "value").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("image", "channel")
    w = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_n, all_s, n, s = F.sum("_n").over(whole), F.sum(F.col("_n") * F.col("value")).over(whole), F.sum("_n").over(w), F.sum(F.col("_n") * F.col("value")).over(w)
    parted = counts.withColumns({"_d": all_s * n - s * all_n, "_w": n * (all_n - n)})
    best = parted.groupBy("image", "channel").agg(F.max_by("value", F.struct(F.when(F.col("_w") > 0, F.col("_d") * F.col("_d") / F.col("_w")).otherwise(F.lit(0.0)), -F.col("value"))).alias("_at"))
    return pixels.join(best, ["image", "channel"]).select(*PIXEL, F.when(F.col("value") > F.col("_at"), F.lit(top)).otherwise(F.lit(0.0)).alias("value"))


#: The ranges of whole-number pixel types, by their letters.
TYPES = {"ub": (0, 255), "b": (-128, 127), "uw": (0, 65535), "w": (-32768, 32767), "i": (-2147483648, 2147483647)}


def convert_to(pixels: DataFrame, kind: str, by: float = 1.0, offset: float = 0.0) -> DataFrame:
    """value * by + offset as a pixel type: ub, b, uw, w or i (rounded to even and saturated), f (single precision) or d."""
    v = F.col("value") * by + offset
    if kind in TYPES:
        return each(pixels, clip(F.bround(v, 0), *map(float, TYPES[kind])))
    if kind not in ("f", "d"):
        raise ValueError(f"no pixel type {kind}")
    return each(pixels, v.cast("float").cast("double") if kind == "f" else v)


def in_range(pixels: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """255 where all channels of a pixel lie from low to high, else 0; one channel comes out."""
    ok = F.lit(True)
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        ok = ok & ((F.col("channel") != k) | F.col("value").between(a, b))
    return pixels.groupBy("image", "y", "x").agg(F.bool_and(ok).alias("_ok")).select("image", "y", "x", F.lit(0).alias("channel"), F.when(F.col("_ok"), F.lit(255.0)).otherwise(F.lit(0.0)).alias("value"))


def normalize_max(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    """Each image by its largest value; images of nothing but 0 stay."""
    most = pixels.groupBy("image").agg(F.max("value").alias("_m"))
    return pixels.join(most, "image").withColumn("value", F.when(F.col("_m") > 0, F.col("value") / F.col("_m") * top).otherwise(F.col("value"))).drop("_m")


def normalize_sum(pixels: DataFrame) -> DataFrame:
    """Each pixel's channels by their sum."""
    w = Window.partitionBy("image", "y", "x")
    return each(pixels, F.when(F.sum("value").over(w) != 0, F.col("value") / F.sum("value").over(w)).otherwise(F.lit(0.0)))


def magnitude(pixels: DataFrame) -> DataFrame:
    """One channel: the root of the sum of squares of a pixel's channels."""
    return pixels.groupBy("image", "y", "x").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value")).select("image", "y", "x", F.lit(0).alias("channel"), "value")


def map_values(pixels: DataFrame, table: DataFrame, permissive: bool = False) -> DataFrame:
    """Values by a table(value, to); a value that isn't in it is an error, or with permissive stays."""
    joined = pixels.join(table.select("value", "to").dropDuplicates(["value"]), "value", "left")
    missing = F.col("value") if permissive else F.raise_error(F.concat(F.lit("no entry for "), F.col("value").cast("string"))).cast("double")
    return joined.withColumn("value", F.coalesce(F.col("to").cast("double"), missing)).select(*pixels.columns)


def combine_channels(pixels: DataFrame, weights: Sequence[Sequence[float]], denominators: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Output channel k is the sum of weights[k] times a pixel's channels, by the sum of denominators[k] times them if given (0 where that is 0).

    One row of the weights is a linear combination, rows of 0 and 1 a shuffle, and both together a ratio.
    """
    n = len(weights[0])
    wide = pixels.groupBy("image", "y", "x").agg(*[F.sum(F.when(F.col("channel") == k, F.col("value"))).alias(f"_c{k}") for k in range(n)])

    def total(row: Sequence[float]) -> Column:
        return sum((F.coalesce(f"_c{k}", F.lit(0.0)) * float(w) for k, w in enumerate(row)), F.lit(0.0))

    outs = []
    for k, row in enumerate(weights):
        v = total(row)
        if denominators is not None:
            d = total(denominators[k])
            v = F.when(d != 0, v / d).otherwise(F.lit(0.0))
        outs.append(F.struct(F.lit(k).alias("channel"), v.alias("value")))
    return wide.select("image", "y", "x", F.explode(F.array(*outs)).alias("_o")).select("image", "y", "x", "_o.channel", "_o.value")


#: Fixed values (ITU-R BT.601): weights of red, green and blue in grey.
GREY = [0.299, 0.587, 0.114]


def to_grey(pixels: DataFrame, bgr: bool = True) -> DataFrame:
    return combine_channels(pixels, [GREY[::-1] if bgr else GREY])


def _colours(pixels: DataFrame, function: Callable[[Column, Column, Column], Sequence[Column]], bgr: bool) -> DataFrame:
    """Three new channels from a pixel's red, green and blue (or whatever its three channels are)."""
    wide = pixels.groupBy("image", "y", "x").agg(*[F.max(F.when(F.col("channel") == k, F.col("value"))).alias(f"_c{k}") for k in range(3)])
    first = [F.col(f"_c{k}") for k in ((2, 1, 0) if bgr else (0, 1, 2))]
    outs = F.array(*[F.struct(F.lit(k).alias("channel"), v.alias("value")) for k, v in enumerate(function(*first))])
    return wide.select("image", "y", "x", F.explode(outs).alias("_o")).select("image", "y", "x", "_o.channel", "_o.value")


def to_hsv(pixels: DataFrame, bgr: bool = False) -> DataFrame:
    """8-bit colours as hue (degrees / 2), saturation and value (0 to 255)."""

    def run(r: Column, g: Column, b: Column) -> list[Column]:
        most, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
        hue = F.when(span == 0, F.lit(0.0)).when(most == r, 60 * (g - b) / span).when(most == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
        return [F.when(hue < 0, hue + 360).otherwise(hue) / 2, F.when(most > 0, 255 * span / most).otherwise(F.lit(0.0)), most]

    return _colours(pixels, run, bgr)


def from_hsv(pixels: DataFrame) -> DataFrame:
    """to_hsv back: red, green, blue."""

    def run(h: Column, s: Column, v: Column) -> list[Column]:
        def one(n: int) -> Column:
            k = F.pmod(F.lit(float(n)) + h / 30, F.lit(6.0))
            return v - v * s / 255 * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

        return [one(5), one(3), one(1)]

    return _colours(pixels, run, False)


#: Fixed values (CIE 1931, D65): red, green and blue in X, Y and Z; and the white point.
XYZ_OF_RGB = [[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]
WHITE = (0.950456, 1.0, 1.088754)


def to_xyz(pixels: DataFrame, bgr: bool = False) -> DataFrame:
    """Linear colours as X, Y, Z of the same range."""
    return _colours(pixels, lambda r, g, b: [r * m[0] + g * m[1] + b * m[2] for m in XYZ_OF_RGB], bgr)


def to_lab(pixels: DataFrame, bgr: bool = False, top: float = 255.0) -> DataFrame:
    """Linear colours (0 to top) as L (0 to 100), a and b."""

    def run(r: Column, g: Column, b: Column) -> list[Column]:
        x, y, z = ((r * m[0] + g * m[1] + b * m[2]) / top / w for m, w in zip(XYZ_OF_RGB, WHITE, strict=True))
        f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
        return [F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y), 500 * (f(x) - f(y)), 200 * (f(y) - f(z))]

    return _colours(pixels, run, bgr)


def ndvi(pixels: DataFrame, red: int = 2, near_infrared: int = 3) -> DataFrame:
    """One channel: the vegetation index (near infrared - red) / (near infrared + red), 0 where the sum is 0."""
    of = lambda k: F.max(F.when(F.col("channel") == k, F.col("value")))
    both = pixels.groupBy("image", "y", "x").agg(of(red).alias("_r"), of(near_infrared).alias("_n"))
    total = F.col("_n") + F.col("_r")
    return both.select("image", "y", "x", F.lit(0).alias("channel"), F.when(total != 0, (F.col("_n") - F.col("_r")) / total).otherwise(F.lit(0.0)).alias("value"))


def multiply_powers(pixels: DataFrame, powers: Sequence[float]) -> DataFrame:
    """One channel: the product of a pixel's channels, each to its power."""
    parts = [F.max(F.when(F.col("channel") == k, F.pow("value", F.lit(float(p))))) for k, p in enumerate(powers)]
    out = parts[0]
    for v in parts[1:]:
        out = out * v
    return pixels.groupBy("image", "y", "x").agg(out.alias("value")).select("image", "y", "x", F.lit(0).alias("channel"), "value")


def color_map(pixels: DataFrame, low: Sequence[float], high: Sequence[float], at: tuple[float, float] = (0.0, 255.0)) -> DataFrame:
    """Grey to colour, linearly from low to high over the range at."""
    share = clip((F.col("value") - at[0]) / (at[1] - at[0]), 0.0, 1.0)
    outs = [F.struct(F.lit(k).alias("channel"), (F.lit(float(a)) + share * (b - a)).alias("value")) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    return pixels.filter("channel = 0").select("image", "y", "x", F.explode(F.array(*outs)).alias("_o")).select("image", "y", "x", "_o.channel", "_o.value")


def pack_bits(pixels: DataFrame, bits: int, channels: int) -> DataFrame:
    """Channels of a pixel into one number, the first lowest."""
    v = F.shiftleft(F.col("value").cast("long"), 0)
    parts = [F.sum(F.when(F.col("channel") == k, v * 2 ** (bits * k)).otherwise(0)) for k in range(channels)]
    return pixels.groupBy("image", "y", "x").agg(sum(parts[1:], parts[0]).cast("double").alias("value")).select("image", "y", "x", F.lit(0).alias("channel"), "value")


def unpack_bits(pixels: DataFrame, bits: int, channels: int) -> DataFrame:
    """Each value as channels of so many bits, the lowest first; unpacking 12-bit pairs is bits = 12, channels = 2."""
    v = F.col("value").cast("long")
    outs = [F.struct(F.lit(k).alias("channel"), F.shiftright(v, bits * k).bitwiseAND(2**bits - 1).cast("double").alias("value")) for k in range(channels)]
    return pixels.filter("channel = 0").select("image", "y", "x", F.explode(F.array(*outs)).alias("_o")).select("image", "y", "x", "_o.channel", "_o.value")


# --- layout ------------------------------------------------------------------------------------------------------------


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    return pixels.filter((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def crop_lines(pixels: DataFrame, ranges: Sequence[tuple[int, int]], axis: str = "x") -> DataFrame:
    """Some columns (or rows, axis y): ranges (first, count), put side by side."""
    out, at = None, 0
    for first, count in ranges:
        hit = (F.col(axis) >= first) & (F.col(axis) < first + count)
        new = F.col(axis) - first + at
        out = F.when(hit, new) if out is None else out.when(hit, new)
        at += count
    return pixels.withColumn(axis, out).filter(F.col(axis).isNotNull())


def bands(pixels: DataFrame, ranges: Sequence[tuple[int, int]], axis: str = "x") -> DataFrame:
    """Bands (first, count) of columns (or rows) averaged to one column (row) each; a band may overlap others."""
    marks = F.array(*[F.when((F.col(axis) >= a) & (F.col(axis) < a + n), F.lit(k)) for k, (a, n) in enumerate(ranges)])
    other = "y" if axis == "x" else "x"
    return pixels.withColumn("_b", F.explode(F.array_compact(marks))).groupBy("image", other, F.col("_b").alias(axis), "channel").agg(F.avg("value").alias("value")).select(*PIXEL, "value")


def untile(pixels: DataFrame, down: int, across: int, height: int, width: int) -> DataFrame:
    """An image of down x across tiles as images (image, tile): tile is added."""
    tile = F.floor(F.col("y") / height) * across + F.floor(F.col("x") / width)
    return pixels.filter((F.col("y") < down * height) & (F.col("x") < across * width)).withColumns({"tile": tile.cast("int"), "y": (F.col("y") % height), "x": (F.col("x") % width)})


def tile(pixels: DataFrame, across: int, height: int, width: int) -> DataFrame:
    """Tiles (image, tile) put back into one image, by rows of across tiles."""
    return pixels.withColumns({"y": (F.col("y") + F.floor(F.col("tile") / across) * height).cast("int"), "x": (F.col("x") + (F.col("tile") % across) * width).cast("int")}).drop("tile")


def lines_to_channels(pixels: DataFrame, chosen: Sequence[int], axis: str = "x", repeat: int | None = None) -> DataFrame:
    """Columns (or rows) become channels of one column; with repeat every so many lines again, one column for each group."""
    line = F.col(axis) % repeat if repeat else F.col(axis)
    place = F.array_position(F.array(*[F.lit(c) for c in chosen]), line.cast("int")) - 1
    return pixels.filter("channel = 0").withColumn("channel", place.cast("int")).filter("channel >= 0").withColumn(axis, F.floor(F.col(axis) / repeat).cast("int") if repeat else F.lit(0))


def channels_to_lines(pixels: DataFrame, channels: int, axis: str = "x") -> DataFrame:
    """Each column (or row) as so many lines, one of each channel."""
    return pixels.withColumns({axis: F.col(axis) * channels + F.col("channel"), "channel": F.lit(0)})


def pad(pixels: DataFrame, top: int, bottom: int, left: int, right: int, value: float = 0.0) -> DataFrame:
    """A border of a value; the frame of each image is written from its size."""
    frame = sizes(pixels).withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("rows") + top + bottom - 1).cast("int")))).withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("cols") + left + right - 1).cast("int"))))
    frame = frame.filter((F.col("y") < top) | (F.col("y") >= F.col("rows") + top) | (F.col("x") < left) | (F.col("x") >= F.col("cols") + left)).withColumn("channel", F.explode(F.sequence(F.lit(0), (F.col("channels") - 1).cast("int"))))
    moved = pixels.withColumns({"y": F.col("y") + top, "x": F.col("x") + left})
    return moved.select(*PIXEL, "value").unionByName(frame.select(*PIXEL, F.lit(value).alias("value")))


def _turn(pixels: DataFrame, y: Callable, x: Callable) -> DataFrame:
    joined = pixels.join(sizes(pixels).select("image", "rows", "cols"), "image")
    return joined.withColumns({"y": y(), "x": x()}).select(*PIXEL, "value")


def flip(pixels: DataFrame) -> DataFrame:
    """Upside down."""
    return _turn(pixels, lambda: F.col("rows") - 1 - F.col("y"), lambda: F.col("x"))


def flop(pixels: DataFrame) -> DataFrame:
    """Left to right."""
    return _turn(pixels, lambda: F.col("y"), lambda: F.col("cols") - 1 - F.col("x"))


def transpose(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"y": F.col("x"), "x": F.col("y")})


def rotate90(pixels: DataFrame, times: int = 1) -> DataFrame:
    """Clockwise."""
    r, c, y, x = (F.col(n) for n in ("rows", "cols", "y", "x"))
    turns = [(y, x), (x, r - 1 - y), (r - 1 - y, c - 1 - x), (c - 1 - x, y)][times % 4]
    return _turn(pixels, lambda: turns[0], lambda: turns[1])


def split(pixels: DataFrame) -> DataFrame:
    """Channels below each other, as one channel."""
    return _turn(pixels.withColumn("_k", F.col("channel")).drop("_k"), lambda: F.col("y") + F.col("channel") * F.col("rows"), lambda: F.col("x")).withColumn("channel", F.lit(0))


def merge(pixels: DataFrame, channels: int) -> DataFrame:
    """The reverse of split: bands of rows become channels."""
    joined = pixels.filter("channel = 0").join(sizes(pixels).select("image", F.floor(F.col("rows") / channels).alias("_h")), "image")
    return joined.withColumns({"channel": F.floor(F.col("y") / F.col("_h")).cast("int"), "y": (F.col("y") % F.col("_h")).cast("int")}).filter(F.col("channel") < channels).select(*PIXEL, "value")


def clone_channels(pixels: DataFrame, channels: int) -> DataFrame:
    return pixels.filter("channel = 0").withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))


def resize(pixels: DataFrame, height: int, width: int, linear: bool = False) -> DataFrame:
    """To a size, by the nearest pixel or linearly between pixel centres; bilinear weights are summed, so that nothing but pixels is shuffled."""
    if not linear:
        grid = sizes(pixels).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        grid = grid.select("image", F.floor(F.col("y") * F.col("rows") / height).cast("int").alias("_y"), F.floor(F.col("x") * F.col("cols") / width).cast("int").alias("_x"), F.col("y").alias("_ny"), F.col("x").alias("_nx"))
        return pixels.withColumnsRenamed({"y": "_y", "x": "_x"}).join(grid, ["image", "_y", "_x"]).select("image", F.col("_ny").alias("y"), F.col("_nx").alias("x"), "channel", "value")

    def run(a: np.ndarray) -> np.ndarray:
        for axis, n in ((0, height), (1, width)):
            at = np.clip((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0, a.shape[axis] - 1)
            lo = np.floor(at).astype(int)
            hi = np.minimum(lo + 1, a.shape[axis] - 1)
            w = (at - lo).reshape([-1 if k == axis else 1 for k in range(3)])
            a = np.take(a, lo, axis) * (1 - w) + np.take(a, hi, axis) * w
        return a

    return on_arrays(pixels, run)


def remap(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """table(y, x, from_y, from_x): where each pixel of the result comes from; undistortion and projections are such tables."""
    at = table.select(F.col("y").alias("_ny"), F.col("x").alias("_nx"), F.col("from_y").cast("int").alias("y"), F.col("from_x").cast("int").alias("x"))
    return pixels.join(at, ["y", "x"]).select("image", F.col("_ny").alias("y"), F.col("_nx").alias("x"), "channel", "value")


def equirectangular_table(spark: SparkSession, height: int, width: int, focal: float, out: int, heading: float = 0.0) -> DataFrame:
    """remap's table for a camera's view of out x out pixels, of a focal length in pixels, out of an equirectangular panorama."""
    grid = spark.range(out * out).select(F.floor(F.col("id") / out).cast("int").alias("y"), (F.col("id") % out).cast("int").alias("x"))
    dx, dy = F.col("x") - (out - 1) / 2, F.col("y") - (out - 1) / 2
    b, e = heading + F.atan2(dx, F.lit(focal)), F.atan2(-dy, F.sqrt(dx * dx + focal * focal))
    from_y = F.least(F.lit(height - 1), F.floor((math.pi / 2 - e) / math.pi * height))
    return grid.withColumns({"from_y": from_y.cast("int"), "from_x": (F.floor(F.pmod(b + math.pi, F.lit(2 * math.pi)) / (2 * math.pi) * width) % width).cast("int")})


def undistort(pixels: DataFrame, height: int, width: int, focal: tuple[float, float], centre: tuple[float, float], radial: Sequence[float], tangential: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Images of a camera with lens distortion as those of one without: each pixel from the nearest one at its distorted place; 0 where that lies outside."""
    from quillon.functions import vectors as V

    grid = pixels.select("image", "channel").distinct().withColumn("_ny", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("_nx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    u, v = V.distort((F.col("_nx") - centre[0]) / focal[0], (F.col("_ny") - centre[1]) / focal[1], radial, tangential)
    wanted = grid.withColumns({"_y": F.floor(v * focal[1] + centre[1] + 0.5).cast("int"), "_x": F.floor(u * focal[0] + centre[0] + 0.5).cast("int")})
    found = pixels.withColumnsRenamed({"y": "_y", "x": "_x"})
    return wanted.join(found, ["image", "channel", "_y", "_x"], "left").select("image", F.col("_ny").alias("y"), F.col("_nx").alias("x"), "channel", F.coalesce("value", F.lit(0.0)).alias("value"))


# --- over frames -------------------------------------------------------------------------------------------------------


def accumulate(frames: DataFrame, how: str, order: str = "image", size: int | None = None) -> DataFrame:
    """Each pixel over the frames so far (or the last size frames): average, max, min or sum."""
    by = ["y", "x", "channel"]
    if size is not None:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, Window.currentRow)
        return each(frames, {"average": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]("value").over(w))
    laid, _ = chunked(frames, by, [order])
    rows = own(laid)
    if how == "average":
        rows = running(running(rows, by, [order], F.col("value"), "_s"), by, [order], F.when(F.col("value").isNotNull(), 1).otherwise(0), "_n")
        return rows.withColumn("value", F.try_divide("_s", "_n")).drop("_s", "_n", "_chunk")
    return running(rows.withColumnRenamed("value", "_v"), by, [order], F.col("_v"), "value", how).select(*frames.columns)


def moving_average(frames: DataFrame, alpha: float, spin_up: int = 1, order: str = "image") -> DataFrame:
    """Exponential: new = old + (value - old) * alpha; an ordinary average over the first spin_up frames."""
    if not 0 < alpha < 1 or spin_up < 1:
        raise ValueError("alpha must lie between 0 and 1, spin_up be positive")

    def step(state, rows: pa.Table):
        count, mean = state or (0, 0.0)
        v = rows.column("value").to_numpy(zero_copy_only=False).astype(float)
        out = np.empty(len(v))
        for i, x in enumerate(v):
            count += 1
            mean = x if count == 1 else mean + (x - mean) * (1 / count if count < spin_up else alpha)
            out[i] = mean
        return (count, mean), rows.set_column(rows.schema.get_field_index("value"), "value", pa.array(out))

    ready = frames.filter(F.col("value").isNotNull())
    return ordered_scan(ready, ["y", "x", "channel"], [order], step, ready.schema)


def slide(frames: DataFrame, height: int) -> DataFrame:
    """Line scans into one image: the rows of frame k, of height rows each, begin at row k * height."""
    return frames.withColumns({"y": F.col("y") + F.col("image") * height, "image": F.lit(0)})


# --- two branches ------------------------------------------------------------------------------------------------------


def combine(first: DataFrame, second: DataFrame, how: str) -> DataFrame:
    """add, subtract, multiply, divide (0 by 0 where the divisor is), absdiff, and, or, xor; pixels that both have."""
    b = second.select(*PIXEL, F.col("value").alias("_b"))
    x, y = F.col("value"), F.col("_b")
    ix, iy = x.cast("long"), y.cast("long")
    out = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.when(y != 0, x / y).otherwise(F.lit(0.0)), "absdiff": F.abs(x - y), "and": ix.bitwiseAND(iy).cast("double"), "or": ix.bitwiseOR(iy).cast("double"), "xor": ix.bitwiseXOR(iy).cast("double")}
    return first.join(b, PIXEL).select(*PIXEL, out[how].alias("value"))


def bitwise(images: dict[str, DataFrame], expression: str, bits: int = 8) -> DataFrame:
    """An expression over named images, such as "a & (b | ~c) ^ 15"; operators by falling precedence: ~, &, ^, |. Pixels that all images have."""
    tree = ast.parse(expression, mode="eval").body
    names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)})
    if not names or any(n not in images for n in names):
        raise ValueError(f"the expression must name some of {sorted(images)}")

    def value(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return F.col(f"_{node.id}").cast("long")
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return F.lit(node.value).cast("long")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return F.lit(2**bits - 1).cast("long").bitwiseXOR(value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in (ast.BitAnd, ast.BitOr, ast.BitXor):
            a, b = value(node.left), value(node.right)
            return {ast.BitAnd: a.bitwiseAND, ast.BitOr: a.bitwiseOR, ast.BitXor: a.bitwiseXOR}[type(node.op)](b)
        raise ValueError(f"not part of a bitwise expression: {ast.unparse(node)}")

    joined = None
    for n in names:
        part = images[n].select(*PIXEL, F.col("value").alias(f"_{n}"))
        joined = part if joined is None else joined.join(part, PIXEL)
    return joined.select(*PIXEL, value(tree).cast("double").alias("value"))


def mask(pixels: DataFrame, by: DataFrame) -> DataFrame:
    """Pixels where another image's first channel isn't 0; the others become 0."""
    m = by.filter("channel = 0").select("image", "y", "x", F.col("value").alias("_m"))
    return pixels.join(m, ["image", "y", "x"], "left").select(*PIXEL, F.when(F.coalesce("_m", F.lit(0.0)) != 0, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


# --- surroundings ------------------------------------------------------------------------------------------------------


def _windows(a: np.ndarray, height: int, width: int, mode: str = "reflect") -> np.ndarray:
    top, left = (height - 1) // 2, (width - 1) // 2
    pads = ((top, height - 1 - top), (left, width - 1 - left), (0, 0))
    small = mode == "reflect" and (a.shape[0] <= max(pads[0]) or a.shape[1] <= max(pads[1]))
    p = np.pad(a, pads, mode="edge" if small else mode)
    return np.lib.stride_tricks.sliding_window_view(p, (height, width), axis=(0, 1))


def convolve(pixels: DataFrame, kernel: Sequence[Sequence[float]]) -> DataFrame:
    """Correlation with a kernel, borders reflected about the edge pixel."""
    k = np.asarray(kernel, dtype=float)
    return on_arrays(pixels, lambda a: np.einsum("yxcij,ij->yxc", _windows(a, *k.shape), k))


def blur(pixels: DataFrame, kind: str, size: int, sigma: float = 1.0) -> DataFrame:
    """box, gaussian or median over size x size."""
    if kind == "median":
        return on_arrays(pixels, lambda a: np.median(_windows(a, size, size), axis=(3, 4)))
    if kind == "gaussian":
        d = np.arange(size) - (size - 1) / 2
        g = np.exp(-(d**2) / (2 * sigma**2))
        return convolve(pixels, (np.outer(g, g) / g.sum() ** 2).tolist())
    return convolve(pixels, np.full((size, size), 1 / size**2).tolist())


def morphology(pixels: DataFrame, how: str, size: int = 3, rounds: int = 1) -> DataFrame:
    """erode, dilate, open, close, gradient, tophat, blackhat, over a square of size; or skeleton (thinning by openings, of 0 and 255)."""

    def erode(a: np.ndarray) -> np.ndarray:
        return _windows(a, size, size, "edge").min(axis=(3, 4))

    def dilate(a: np.ndarray) -> np.ndarray:
        return _windows(a, size, size, "edge").max(axis=(3, 4))

    def times(f: Callable, a: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            a = f(a)
        return a

    def skeleton(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for _ in range(max(a.shape)):
            if not a.any():
                break
            small = _windows(np.pad(a, ((size, size), (size, size), (0, 0))), size, size, "edge").min(axis=(3, 4))[size:-size, size:-size]
            out = np.maximum(out, a - np.minimum(a, dilate(small)))
            a = small
        return out

    functions = {
        "erode": lambda a: times(erode, a), "dilate": lambda a: times(dilate, a), "open": lambda a: times(dilate, times(erode, a)), "close": lambda a: times(erode, times(dilate, a)), "gradient": lambda a: dilate(a) - erode(a),
        "tophat": lambda a: a - times(dilate, times(erode, a)), "blackhat": lambda a: times(erode, times(dilate, a)) - a, "skeleton": skeleton,
    }
    return on_arrays(pixels, functions[how])


def contraharmonic(pixels: DataFrame, size: int, order: float) -> DataFrame:
    """Sum of v^(order + 1) by sum of v^order over a square; 0 where that is 0."""

    def run(a: np.ndarray) -> np.ndarray:
        w = _windows(a, size, size)
        low = (w**order).sum(axis=(3, 4))
        return np.where(low != 0, (w ** (order + 1)).sum(axis=(3, 4)) / np.where(low != 0, low, 1), 0)

    return on_arrays(pixels, run)


def remove_mean(pixels: DataFrame, size: int, ratio: float = 1.0) -> DataFrame:
    """Less ratio times the mean of a square about the pixel."""
    return on_arrays(pixels, lambda a: a - ratio * _windows(a, size, size).mean(axis=(3, 4)))


def hard_edge(pixels: DataFrame, background: float = 0.0) -> DataFrame:
    """Keep pixels that aren't background and have a background pixel among the four next to them; others become background."""

    def run(a: np.ndarray) -> np.ndarray:
        w = _windows(a, 3, 3, "edge") == background
        near = w[..., 0, 1] | w[..., 2, 1] | w[..., 1, 0] | w[..., 1, 2]
        return np.where((a != background) & near, a, background)

    return on_arrays(pixels, run)


def remove_speckles(pixels: DataFrame, size: int) -> DataFrame:
    """A square of size whose border is all 0 becomes 0."""

    def run(a: np.ndarray) -> np.ndarray:
        out = a.copy()
        w = np.lib.stride_tricks.sliding_window_view(a, (size + 2, size + 2), axis=(0, 1))
        edge = np.ones((size + 2, size + 2), dtype=bool)
        edge[1:-1, 1:-1] = False
        for y, x, c in zip(*np.nonzero(~(w[..., edge] != 0).any(axis=-1)), strict=True):
            out[y + 1 : y + 1 + size, x + 1 : x + 1 + size, c] = 0
        return out

    return on_arrays(pixels, lambda a: run(a) if min(a.shape[:2]) >= size + 2 else a)


def edges(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Canny's: Sobel gradients, thinned across, kept above high and where they are above low and connected to such; 255 or 0."""

    def one(g: np.ndarray) -> np.ndarray:
        w = _windows(g[:, :, None], 3, 3, "edge")[:, :, 0]
        gx = w[..., 0, 2] + 2 * w[..., 1, 2] + w[..., 2, 2] - w[..., 0, 0] - 2 * w[..., 1, 0] - w[..., 2, 0]
        gy = w[..., 2, 0] + 2 * w[..., 2, 1] + w[..., 2, 2] - w[..., 0, 0] - 2 * w[..., 0, 1] - w[..., 0, 2]
        m = np.abs(gx) + np.abs(gy)
        n = _windows(m[:, :, None], 3, 3, "constant")[:, :, 0]
        d = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
        ahead = np.choose(d, [n[..., 1, 2], n[..., 2, 2], n[..., 2, 1], n[..., 2, 0]])
        behind = np.choose(d, [n[..., 1, 0], n[..., 0, 0], n[..., 0, 1], n[..., 0, 2]])
        peak = (m > behind) & (m >= ahead)
        strong, weak = peak & (m > high), peak & (m > low)
        while True:
            grown = weak & _windows(strong[:, :, None], 3, 3, "constant")[:, :, 0].any(axis=(2, 3))
            if (grown == strong).all():
                return np.where(strong, 255.0, 0.0)
            strong = grown | strong

    return on_arrays(pixels, lambda a: np.stack([one(a[:, :, c]) for c in range(a.shape[2])], axis=2))


def equalize(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation of 8-bit values, channel by channel; a channel of one value stays."""
    counts = pixels.groupBy("image", "channel", "value").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("image", "channel")
    w = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_c": F.sum("_n").over(w), "_all": F.sum("_n").over(whole), "_first": F.min(F.struct("value", "_n")).over(whole)["_n"]})
    to = F.when(F.col("_all") > F.col("_first"), F.round((F.col("_c") - F.col("_first")) / (F.col("_all") - F.col("_first")) * 255)).otherwise(F.col("value"))
    return pixels.join(ranked.select("image", "channel", "value", to.alias("_to")), ["image", "channel", "value"]).select(*PIXEL, F.col("_to").alias("value"))


def equalize_locally(pixels: DataFrame, tile_size: int, limit: float) -> DataFrame:
    """Equalisation in tiles with a clipped histogram, linear between tile centres (CLAHE)."""

    def one(a: np.ndarray) -> np.ndarray:
        a = np.clip(a, 0, 255).astype(int)
        ny, nx = -(-a.shape[0] // tile_size), -(-a.shape[1] // tile_size)
        maps = np.empty((ny, nx, 256))
        for j in range(ny):
            for i in range(nx):
                t = a[j * tile_size : (j + 1) * tile_size, i * tile_size : (i + 1) * tile_size]
                h = np.bincount(t.ravel(), minlength=256).astype(float)
                top = max(1.0, limit * t.size / 256)
                h = np.minimum(h, top) + np.maximum(h - top, 0).sum() / 256
                maps[j, i] = np.cumsum(h) / h.sum() * 255
        y, x = np.indices(a.shape)
        fy, fx = np.clip((y + 0.5) / tile_size - 0.5, 0, ny - 1), np.clip((x + 0.5) / tile_size - 0.5, 0, nx - 1)
        y0, x0 = fy.astype(int), fx.astype(int)
        y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
        wy, wx = fy - y0, fx - x0
        return (maps[y0, x0, a] * (1 - wx) + maps[y0, x1, a] * wx) * (1 - wy) + (maps[y1, x0, a] * (1 - wx) + maps[y1, x1, a] * wx) * wy

    return on_arrays(pixels, lambda a: np.stack([one(a[:, :, c]) for c in range(a.shape[2])], axis=2))


def balance_white(pixels: DataFrame, share: float = 0.05) -> DataFrame:
    """Stretch each channel so that its share lowest and highest values become 0 and 255."""
    ends = pixels.groupBy("image", "channel").agg(F.percentile("value", share).alias("_lo"), F.percentile("value", 1 - share).alias("_hi"))
    v = F.when(F.col("_hi") > F.col("_lo"), clip((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(F.col("value"))
    return pixels.join(ends, ["image", "channel"]).select(*PIXEL, v.alias("value"))


def transform_fft(pixels: DataFrame, inverse: bool = False, magnitude_only: bool = False) -> DataFrame:
    """Two-dimensional FFT of the first channel: channels real and imaginary, or the magnitude; inverse takes those two channels."""

    def run(a: np.ndarray) -> np.ndarray:
        if inverse:
            return np.fft.ifft2(a[:, :, 0] + 1j * (a[:, :, 1] if a.shape[2] > 1 else 0)).real[:, :, None]
        f = np.fft.fft2(a[:, :, 0])
        return np.abs(f)[:, :, None] if magnitude_only else np.stack([f.real, f.imag], axis=2)

    return on_arrays(pixels, run)


def bayer(pixels: DataFrame, pattern: str = "rggb") -> DataFrame:
    """Colours (red, green, blue) from a sensor's mosaic: each is the mean of its samples among the nine pixels about."""
    at = {"r": 0, "g": 1, "b": 2}

    def run(a: np.ndarray) -> np.ndarray:
        y, x = np.indices(a.shape[:2])
        colour = np.array([at[c] for c in pattern])[(y % 2) * 2 + x % 2]
        out = np.empty((*a.shape[:2], 3))
        for k in range(3):
            m = (colour == k)[:, :, None]
            n = _windows(m.astype(float), 3, 3, "constant").sum(axis=(3, 4))[..., 0]
            out[:, :, k] = _windows(a[:, :, :1] * m, 3, 3, "constant").sum(axis=(3, 4))[..., 0] / np.maximum(n, 1)
        return out

    return on_arrays(pixels, run)


# --- segments ----------------------------------------------------------------------------------------------------------


def regions(pixels: DataFrame, min_size: int = 1, diagonal: bool = False) -> DataFrame:
    """(image, y, x, region): connected pixels whose first channel isn't 0, numbered from 0 in each image by their first pixel."""
    on = pixels.filter("channel = 0 and value != 0").select("image", "y", "x", F.struct("image", "y", "x").alias("node"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    near = on.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])))
    near = near.select("image", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("node").alias("a"))
    links = near.join(on.select("image", "y", "x", F.col("node").alias("b")), ["image", "y", "x"]).select("a", "b")
    found = components(on, links)
    kept = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    numbered = kept.withColumn("region", F.row_number().over(Window.partitionBy("component.image").orderBy("component")) - 1)
    return found.join(numbered, "component").select("node.image", "node.y", "node.x", "region")


def blobs(pixels: DataFrame, min_size: int = 1) -> DataFrame:
    """(image, region, y, x, size): the middle and size of each region."""
    return regions(pixels, min_size, diagonal=True).groupBy("image", "region").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("size"))


# --- sums over images -----------------------------------------------------------------------------------------------------


def histogram(pixels: DataFrame) -> DataFrame:
    """(image, channel, bin, count): 256 bins of 8-bit values, those of no pixel with 0."""
    counts = pixels.groupBy("image", "channel", F.col("value").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = counts.select("image", "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return bins.join(counts, ["image", "channel", "bin"], "left").select("image", "channel", "bin", F.coalesce("count", F.lit(0)).alias("count"))


def mean(pixels: DataFrame, above: float | None = None) -> DataFrame:
    """(image, channel, mean, count), of all pixels or of those above a threshold (mean null and count 0 if there are none)."""
    v = F.col("value") if above is None else F.when(F.col("value") > above, F.col("value"))
    return pixels.groupBy("image", "channel").agg(F.avg(v).alias("mean"), F.count(v).alias("count"))


def grep(pixels: DataFrame, min_ratio: float = 0.0, max_ratio: float = 1.0, judged: DataFrame | None = None) -> DataFrame:
    """Images whose share of pixels that aren't 0 lies from min_ratio to max_ratio; judged: other versions of the images to count in."""
    look = (judged if judged is not None else pixels).groupBy("image", "y", "x").agg(F.max(F.when(F.col("value") != 0, 1).otherwise(0)).alias("_on"))
    ok = look.groupBy("image").agg(F.avg("_on").alias("_r")).filter((F.col("_r") >= min_ratio) & (F.col("_r") <= max_ratio))
    return pixels.join(ok.select("image"), "image", "left_semi")


def stride(pixels: DataFrame, height: int, width: int, step_y: int = 1, step_x: int = 1) -> DataFrame:
    """Every height x width part of an image, step by step, whole parts only: (image, part, y, x, ...), parts numbered by rows."""
    s = sizes(pixels).select("image", F.floor((F.col("rows") - height) / step_y).alias("_ny"), F.floor((F.col("cols") - width) / step_x).alias("_nx")).filter("_ny >= 0 and _nx >= 0")
    joined = pixels.join(s, "image")

    def parts(c: str, size: int, step: int, most: str) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step)).cast("int"), F.least(F.col(most), F.floor(F.col(c) / step)).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    rows = joined.withColumn("_j", F.explode(parts("y", height, step_y, "_ny"))).withColumn("_i", F.explode(parts("x", width, step_x, "_nx")))
    return rows.select("image", (F.col("_j") * (F.col("_nx") + 1) + F.col("_i")).cast("int").alias("part"), (F.col("y") - F.col("_j") * step_y).alias("y"), (F.col("x") - F.col("_i") * step_x).alias("x"), "channel", "value")


def unstride_positions(df: DataFrame, index: str, y: str, x: str, cols: int, width: int, step_y: int, step_x: int) -> DataFrame:
    """Positions in parts of stride(), as positions in the image of cols columns: image_y, image_x."""
    across = (cols - width) // step_x + 1
    return df.withColumns({"image_y": F.floor(F.col(index) / across) * step_y + F.col(y), "image_x": (F.col(index) % across) * step_x + F.col(x)})


def unstride(parts: DataFrame, cols: int, width: int, step_y: int, step_x: int, how: str = "average") -> DataFrame:
    """Parts put together again; where they overlap: average, max, min, first or last part."""
    placed = unstride_positions(parts, "part", "y", "x", cols, width, step_y, step_x)
    agg = {"average": F.avg("value"), "max": F.max("value"), "min": F.min("value"), "first": F.min_by("value", "part"), "last": F.max_by("value", "part")}[how]
    return placed.groupBy("image", F.col("image_y").cast("int").alias("y"), F.col("image_x").cast("int").alias("x"), "channel").agg(agg.alias("value"))


def thin_images(pixels: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """A share of the images, chosen by a hash of their number."""
    return pixels.filter(F.pmod(F.xxhash64(F.col("image"), F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))


def crop_random(pixels: DataFrame, height: int, width: int, seed: int = 0) -> DataFrame:
    """A part of each image, at a place chosen by a hash of its number; smaller images are left out."""
    s = sizes(pixels).filter((F.col("rows") >= height) & (F.col("cols") >= width))
    at = lambda n, most, k: F.pmod(F.xxhash64(F.col("image"), F.lit(seed), F.lit(k)), (F.col(n) - most + 1).cast("long")).cast("int")
    j = pixels.join(s.select("image", at("rows", height, 0).alias("_y"), at("cols", width, 1).alias("_x")), "image")
    j = j.withColumns({"y": F.col("y") - F.col("_y"), "x": F.col("x") - F.col("_x")})
    return j.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*PIXEL, "value")


def region_of_interest(pixels: DataFrame, boxes: DataFrame, show_partial: bool = False) -> DataFrame:
    """Pixels outside an image's box(image, min_x, min_y, max_x, max_y: exclusive) become 0; images without a box, or with one that they don't hold unless show_partial, are left out."""
    s = sizes(pixels).join(boxes, "image")
    if not show_partial:
        s = s.filter((F.col("min_x") >= 0) & (F.col("min_y") >= 0) & (F.col("max_x") <= F.col("cols")) & (F.col("max_y") <= F.col("rows")))
    j = pixels.join(s.select("image", "min_x", "min_y", "max_x", "max_y"), "image")
    inside = (F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("y") >= F.col("min_y")) & (F.col("y") < F.col("max_y"))
    return j.select(*PIXEL, F.when(inside, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def life(pixels: DataFrame, rounds: int, procreation: float = 3.0, stability: float = 4.0, step: float = 1.0) -> DataFrame:
    """A cellular automaton on a torus of 8-bit pixels: a pixel loses 255 step if its eight neighbours, by 255, sum to less than procreation or more than stability,
    gains it if the sum is nearer to procreation, and else stays."""

    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            around = sum(np.roll(a, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx) / 255
            change = np.where((around < procreation) | (around > stability), -step, np.where(around - procreation < stability - around, step, 0))
            a = np.floor(np.clip(a + change * 255, 0, 255))
        return a

    return on_arrays(pixels, run)
