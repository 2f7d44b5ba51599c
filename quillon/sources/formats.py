"""Readers, writers and generators of record and point formats.

Readers of binary files read each file in one task, or fixed-size records split over tasks; text is split by lines. Broken records are dropped
or null, as each says.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- records ---------------------------------------------------------------------------------------------------------------

#: Codes of binary fields: Spark type and numpy type; t is microseconds since the UNIX epoch, s[n] a string of n bytes.
CODES = {"b": ("tinyint", "<i1"), "ub": ("smallint", "<u1"), "w": ("smallint", "<i2"), "uw": ("int", "<u2"), "i": ("int", "<i4"), "ui": ("bigint", "<u4"), "l": ("bigint", "<i8"), "ul": ("decimal(20,0)", "<u8"), "f": ("float", "<f4"), "d": ("double", "<f8"), "t": ("timestamp_ntz", "<i8")}


def record_layout(fields: str, format: str) -> tuple[np.dtype, list[tuple[str, str, str]]]:
    """numpy layout and (name, code, Spark type) of a record; format such as "t,3d,ui,s[8]"; empty field names are payload, named _0, _1, ..."""
    codes = []
    for part in format.split(","):
        digits = len(part) - len(part.lstrip("0123456789"))
        codes += [part[digits:]] * int(part[:digits] or 1)
    names = fields.split(",") + [""] * (len(codes) - len(fields.split(",")))
    out, layout = [], []
    for k, (name, code) in enumerate(zip(names, codes, strict=True)):
        name = name.replace("/", "_") or f"_{k}"
        if code.startswith("s["):
            out.append((name, code, "string"))
            layout.append((name, f"S{int(code[2:-1])}"))
        else:
            out.append((name, code, CODES[code][0]))
            layout.append((name, CODES[code][1]))
    return np.dtype(layout), out


def read_binary_records(spark: SparkSession, path: str, fields: str, format: str) -> DataFrame:
    """Fixed-size binary records; a file is split between tasks at record borders. A cut-off last record is an error of the reader."""
    layout, columns = record_layout(fields, format)
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, layout.itemsize).map(lambda b: (bytearray(b),)), "rec binary")
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, _, k in columns])
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=layout)
            cols = []
            for n, code, kind in columns:
                v = a[n]
                if kind == "string":
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in v], pa.string()))
                elif code == "t":
                    cols.append(pa.array(v.astype("datetime64[us]"), pa.timestamp("us")))
                elif kind.startswith("decimal"):
                    cols.append(pa.array([int(x) for x in v], pa.decimal128(20, 0)))
                else:
                    cols.append(pa.array(v.astype(arrow[kind].to_pandas_dtype())))
            yield pa.record_batch(cols, [n for n, _, _ in columns])

    return raw.mapInArrow(run, schema)


def write_binary_records(df: DataFrame, path: str, fields: str, format: str) -> None:
    """One file of records for each partition, as <path>/part-<k>.bin, through Spark's own text-free writer of single binary columns."""
    layout, columns = record_layout(fields, format)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.zeros(b.num_rows, dtype=layout)
            for n, code, _ in columns:
                c = b.column(n)
                if code == "t":
                    a[n] = np.array(c.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0))
                elif code.startswith("s["):
                    a[n] = [x.encode() if x else b"" for x in c.to_pylist()]
                else:
                    a[n] = c.fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([r.tobytes() for r in a], pa.binary())], ["rec"])

    packed = df.select(*[n for n, _, _ in columns]).mapInArrow(run, "rec binary")
    packed.select(F.base64("rec").alias("value")).write.mode("overwrite").text(path)


def read_written_records(spark: SparkSession, path: str, fields: str, format: str) -> DataFrame:
    """What write_binary_records wrote (records in base64 lines, so that a cluster's file system can split them)."""
    layout, columns = record_layout(fields, format)
    raw = spark.read.text(path).select(F.unbase64("value").alias("rec"))
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, _, k in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=layout)
            cols = []
            for n, code, kind in columns:
                if kind == "string":
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in a[n]], pa.string()))
                elif code == "t":
                    cols.append(pa.array(a[n].astype("datetime64[us]"), pa.timestamp("us")))
                elif kind.startswith("decimal"):
                    cols.append(pa.array([int(x) for x in a[n]], pa.decimal128(20, 0)))
                else:
                    cols.append(pa.array(a[n]).cast({"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind]))
            yield pa.record_batch(cols, [n for n, _, _ in columns])

    return raw.mapInArrow(run, schema)


def read_csv_records(spark: SparkSession, path: str, fields: str, types: str) -> DataFrame:
    """Comma-separated records without a header: fields and types in one order; x/y becomes x_y, an empty field is skipped; what doesn't parse is null."""
    names = [f.replace("/", "_") for f in fields.split(",")]
    schema = ", ".join(f"`{n or f'_{k}'}` {t}" for k, (n, t) in enumerate(zip(names, types.split(","), strict=True)))
    return spark.read.schema(schema).csv(path).select(*[n for n in names if n])


# --- lidar and cloud files -------------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files; each is read as a whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(content: DataFrame, parse, schema: str) -> DataFrame:
    """parse(path, bytes) -> tables, file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for out in parse(name, data):
                    yield from out.to_batches(max_chunksize=50_000)

    return content.select("path", "content").mapInArrow(run, schema)


def _encoded(df: DataFrame, columns: Sequence[str], encode, extension: str, rows: int) -> DataFrame:
    """(path, content): files of up to so many rows each, numbered by task; encode(arrays by column) -> bytes. They are content only: to store them is the caller's."""
    task = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, name = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            data = encode({c: t.column(c).to_numpy() for c in columns})
            return pa.record_batch([pa.array([f"part-{name}-{number}.{extension}"]), pa.array([data], pa.binary())], ["path", "content"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n, name = n + b.num_rows, b.column("_task")[0].as_py()
            if n >= rows:
                yield flush()
                held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return task.mapInArrow(run, "path string, content binary")


LAS = "path string, x double, y double, z double, intensity int, return_number int, classification int, gps_time double"


def read_las(spark: SparkSession, path: str) -> DataFrame:
    return las_points(files(spark, path))


def las_files(df: DataFrame, resolution: float = 0.001, rows: int = 1_000_000) -> DataFrame:
    """(path, content): LAS 1.2 files, point format 0, of points (x, y, z, intensity); coordinates in steps of resolution. Nulls are not allowed."""

    def encode(v: dict[str, np.ndarray]) -> bytes:
        at = np.column_stack([v[c] for c in "xyz"])
        offset = np.floor(at.min(axis=0))
        a = np.zeros(len(at), np.dtype({"names": ["p", "i"], "formats": [("<i4", (3,)), "<u2"], "offsets": [0, 12], "itemsize": 20}))
        a["p"], a["i"] = np.round((at - offset) / resolution), v["intensity"]
        head = bytearray(227)
        head[:4] = b"LASF"
        struct.pack_into("<BB", head, 24, 1, 2)
        struct.pack_into("<HII", head, 94, 227, 227, 0)
        struct.pack_into("<BHI", head, 104, 0, 20, len(a))
        struct.pack_into("<6d", head, 131, *[resolution] * 3, *offset)
        struct.pack_into("<6d", head, 179, *np.column_stack([at.max(axis=0), at.min(axis=0)]).ravel())
        return bytes(head) + a.tobytes()

    return _encoded(df, ["x", "y", "z", "intensity"], encode, "las", rows)


def las_points(content: DataFrame) -> DataFrame:
    """Points of LAS files (path, content) of formats 0 to 10; gps_time is null where the format has none."""

    def parse(name: str, c: bytes) -> Iterator[pa.Table]:
        if c[:4] != b"LASF":
            raise ValueError(f"{name} is no LAS file")
        minor = c[25]
        start, kind, size = struct.unpack_from("<I", c, 96)[0], c[104] & 0x3F, struct.unpack_from("<H", c, 105)[0]
        count = struct.unpack_from("<Q", c, 247)[0] if minor >= 4 else struct.unpack_from("<I", c, 107)[0]
        scale, offset = np.frombuffer(c, "<f8", 3, 131), np.frombuffer(c, "<f8", 3, 155)
        new = kind >= 6
        at = {"x": 0, "y": 4, "z": 8, "intensity": 12, "ret": 14, "cls": 16 if new else 15}
        names, kinds, offsets = list(at), ["<i4", "<i4", "<i4", "<u2", "u1", "u1"], list(at.values())
        if new or kind in (1, 3, 4, 5):
            names, kinds, offsets = [*names, "t"], [*kinds, "<f8"], [*offsets, 22 if new else 20]
        a = np.frombuffer(c, np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": size}), count, start)
        n = len(a)
        cols = [pa.array([name] * n, pa.string()), *[pa.array(a[k] * scale[i] + offset[i]) for i, k in enumerate("xyz")], pa.array(a["intensity"].astype(np.int32))]
        cols += [pa.array((a["ret"] & (15 if new else 7)).astype(np.int32)), pa.array((a["cls"] if new else a["cls"] & 31).astype(np.int32)), pa.array(a["t"]) if "t" in names else pa.nulls(n, pa.float64())]
        yield pa.table(cols, names=["path", "x", "y", "z", "intensity", "return_number", "classification", "gps_time"])

    return _parsed(content, parse, LAS)


def lzf_expand(data: bytes, size: int) -> bytes:
    """LZF: runs of literal bytes, and copies of what came before."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        start = len(out) - ((control & 31) << 8) - data[at] - 1
        at += 1
        for k in range(length + 2):  # a copy may run into itself
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError("compressed data of another size than it says")
    return bytes(out)


def lzf_literal(data: bytes) -> bytes:
    """Data as an LZF stream of literal runs only."""
    return b"".join(bytes([len(p) - 1]) + p for p in (data[k : k + 32] for k in range(0, len(data), 32)))


def pcd_files(df: DataFrame, fields: Sequence[str] = ("x", "y", "z"), kind: str = "binary", rows: int = 1_000_000) -> DataFrame:
    """(path, content): PCD files of doubles; kind ascii, binary or binary_compressed (by fields, and for readers' sake only: nothing is made smaller)."""

    def encode(v: dict[str, np.ndarray]) -> bytes:
        n, k = len(v[fields[0]]), len(fields)
        head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(fields), "SIZE" + " 8" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {kind}", ""]
        if kind == "ascii":
            body = "".join(" ".join(map(repr, r)) + "\n" for r in np.column_stack([v[f] for f in fields]).tolist()).encode()
        elif kind == "binary":
            body = np.ascontiguousarray(np.column_stack([v[f] for f in fields])).astype("<f8").tobytes()
        else:
            flat = b"".join(v[f].astype("<f8").tobytes() for f in fields)
            packed = lzf_literal(flat)
            body = struct.pack("<II", len(packed), len(flat)) + packed
        return "\n".join(head).encode() + body

    return _encoded(df, list(fields), encode, "pcd", rows)


def read_pcd(spark: SparkSession, path: str, fields: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return pcd_points(files(spark, path), fields)


def pcd_points(content: DataFrame, fields: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Fields of PCD files (path, content), ascii, binary or compressed, as doubles; a field that a file doesn't have is null."""

    def parse(name: str, c: bytes) -> Iterator[pa.Table]:
        head, at = {}, 0
        while "DATA" not in head:
            end = c.index(b"\n", at)
            words = c[at:end].decode().split()
            at = end + 1
            if words and not words[0].startswith("#"):
                head[words[0]] = words[1:]
        count = [int(v) for v in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
        n = int(head["POINTS"][0])
        if head["DATA"][0] == "ascii":
            data = np.array(c[at:].split(), dtype=float).reshape(n, sum(count))
            starts = np.cumsum([0, *count[:-1]])
            got = {f: data[:, s] for f, s in zip(head["FIELDS"], starts, strict=True)}
        elif head["DATA"][0] == "binary":
            kinds = [f"<{t.lower()}{s}" for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
            layout = np.dtype([(f"{f}_{k}", t, (m,)) for k, (f, t, m) in enumerate(zip(head["FIELDS"], kinds, count, strict=True))])
            a = np.frombuffer(c, layout, n, at)
            got = {f: a[f"{f}_{k}"][:, 0].astype(float) for k, f in enumerate(head["FIELDS"])}
        else:
            packed, size = struct.unpack_from("<II", c, at)
            flat, got, begin = lzf_expand(c[at + 8 : at + 8 + packed], size), {}, 0
            for f, t, width, m in zip(head["FIELDS"], head["TYPE"], map(int, head["SIZE"]), count, strict=True):
                got[f] = np.frombuffer(flat, f"<{t.lower()}{width}", n * m, begin).reshape(n, m)[:, 0].astype(float)
                begin += n * m * width
        yield pa.table([pa.array([name] * n, pa.string()), *[pa.array(got[f]) if f in got else pa.nulls(n, pa.float64()) for f in fields]], names=["path", *fields])

    return _parsed(content, parse, ", ".join(["path string", *[f"`{f}` double" for f in fields]]))


def pcd_lines(df: DataFrame, fields: Sequence[str] = ("x", "y", "z")) -> tuple[list[str], DataFrame]:
    """Header lines and a DataFrame of data lines of an ascii PCD file."""
    n = df.count()
    k = len(fields)
    header = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(fields), "SIZE" + " 8" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    return header, df.select(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("double").cast("string"), F.lit("nan")) for f in fields]).alias("value"))


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    return dem_cells(files(spark, path))


def dem_cells(content: DataFrame) -> DataFrame:
    """Cell centres (path, x, y, z) of ESRI ascii grids (path, content); cells without data are left out."""

    def parse(name: str, c: bytes) -> Iterator[pa.Table]:
        words = c.split()
        head, at = {}, 0
        while words[at][:1].isalpha():
            head[words[at].decode().lower()] = float(words[at + 1])
            at += 2
        rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
        z = np.array(words[at : at + rows * cols], dtype=float)
        half = size / 2 if "xllcorner" in head else 0.0
        x0, y0 = head.get("xllcorner", head.get("xllcenter", 0.0)) + half, head.get("yllcorner", head.get("yllcenter", 0.0)) + half
        ok = z != head.get("nodata_value", -9999.0)
        x, y = np.tile(x0 + np.arange(cols) * size, rows), np.repeat(y0 + np.arange(rows)[::-1] * size, cols)
        yield pa.table([pa.array([name] * int(ok.sum()), pa.string()), pa.array(x[ok]), pa.array(y[ok]), pa.array(z[ok])], names=["path", "x", "y", "z"])

    return _parsed(content, parse, "path string, x double, y double, z double")


# --- navigation ------------------------------------------------------------------------------------------------------------


def nmea_checksum(sentence: Column) -> Column:
    """XOR of the characters between $ and *, as two hexadecimal digits."""
    body = F.regexp_extract(sentence, r"^\$([^*]*)", 1)
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b))), 2, "0")


def _degrees(value: Column, hemisphere: Column) -> Column:
    v = value.try_cast("double")
    whole = F.floor(v / 100)
    return (whole + (v - whole * 100) / 60) * F.when(hemisphere.isin("S", "W"), -1).otherwise(1)


def parse_nmea(lines: DataFrame, column: str = "value", permissive: bool = False) -> DataFrame:
    """Add talker, sentence, utc, lat, lon (degrees), altitude, quality, satellites, speed_knots, course, heading and day of GGA, RMC, GLL, VTG, HDT and ZDA sentences.

    Other sentences have those fields null. Lines whose checksum is wrong or missing are dropped, unless permissive.
    """
    f = F.split(F.regexp_extract(F.trim(column), r"^\$([^*]*)", 1), ",")
    got = lines.filter(F.trim(column).startswith("$")).withColumn("_f", f)
    if not permissive:
        got = got.filter(F.upper(F.regexp_extract(F.trim(column), r"\*([0-9A-Fa-f]{2})\s*$", 1)) == nmea_checksum(F.trim(column)))
    part = lambda i: F.nullif(F.get("_f", F.lit(i)), F.lit(""))
    kind = F.substring(F.element_at("_f", 1), 3, 3)
    gga, rmc, gll, vtg, hdt, zda = (kind == k for k in ("GGA", "RMC", "GLL", "VTG", "HDT", "ZDA"))
    on = F.when(rmc, F.try_to_date(part(9), "ddMMyy")).when(zda, F.try_to_date(F.concat_ws("-", part(4), part(3), part(2)), "yyyy-MM-dd"))
    number = lambda i, t: part(i).try_cast(t)
    return got.withColumns({
        "talker": F.substring(F.element_at("_f", 1), 1, 2), "sentence": kind, "utc": F.when(gga | rmc | zda, part(1)).when(gll, part(5)),
        "lat": F.when(gga, _degrees(part(2), part(3))).when(rmc, _degrees(part(3), part(4))).when(gll, _degrees(part(1), part(2))), "lon": F.when(gga, _degrees(part(4), part(5))).when(rmc, _degrees(part(5), part(6))).when(gll, _degrees(part(3), part(4))),
        "altitude": F.when(gga, number(9, "double")), "quality": F.when(gga, number(6, "int")), "satellites": F.when(gga, number(7, "int")),
        "speed_knots": F.when(rmc, number(7, "double")).when(vtg, number(5, "double")), "course": F.when(rmc, number(8, "double")).when(vtg, number(1, "double")), "heading": F.when(hdt, number(1, "double")), "day": on,
    }).drop("_f")


# --- drawings ----------------------------------------------------------------------------------------------------------------


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def svg_elements(df: DataFrame, kind: str, colour: str = "black", width: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """One SVG element (value) for each row: circle (x, y, radius), line (x1, y1, x2, y2) or text (x, y, text); columns to keep come before it."""
    s = lambda c: F.col(c).cast("double").cast("string")
    if kind == "circle":
        v = F.concat(F.lit('<circle cx="'), s("x"), F.lit('" cy="'), s("y"), F.lit('" r="'), s("radius"), F.lit(f'" fill="none" stroke="{colour}" stroke-width="{width}"/>'))
    elif kind == "line":
        v = F.concat(F.lit('<line x1="'), s("x1"), F.lit('" y1="'), s("y1"), F.lit('" x2="'), s("x2"), F.lit('" y2="'), s("y2"), F.lit(f'" stroke="{colour}" stroke-width="{width}"/>'))
    elif kind == "text":
        v = F.concat(F.lit('<text x="'), s("x"), F.lit('" y="'), s("y"), F.lit(f'" fill="{colour}">'), _xml(F.col("text")), F.lit("</text>"))
    else:
        raise ValueError(f"no such element: {kind}")
    return df.select(*keep, v.alias("value"))


def kml_placemarks(df: DataFrame, name: str, lat: str, lon: str, height: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One KML placemark (value) for each row; null without a place; columns to keep come before it."""
    z = F.concat(F.lit(","), F.col(height).cast("double").cast("string")) if height else F.lit("")
    at = F.concat(F.col(lon).cast("double").cast("string"), F.lit(","), F.col(lat).cast("double").cast("string"), z)
    return df.select(*keep, F.concat(F.lit("<Placemark><name>"), _xml(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit("</name><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>")).alias("value"))


# --- made data ---------------------------------------------------------------------------------------------------------------


def make_line(spark: SparkSession, begin: Sequence[float], end: Sequence[float], step: float) -> DataFrame:
    """Points (id, x, y, z) from begin, each step, to end."""
    size = math.dist(begin, end)
    n = math.floor(size / step + 1e-9) + 1 if size else 1
    t = F.col("id") * (step / size if size else 0.0)
    return spark.range(n).select("id", *[(F.lit(float(a)) + t * (b - a)).alias(c) for c, a, b in zip("xyz", begin, end, strict=True)])


def make_grid(spark: SparkSession, corner: Sequence[float], counts: Sequence[int], step: float) -> DataFrame:
    """Points (id, x, y, z) of a grid of counts points along each axis: a plane if one count is 1, a filled box else."""
    n = math.prod(counts)
    at = [F.col("id") % counts[0], F.floor(F.col("id") / counts[0]) % counts[1], F.floor(F.col("id") / (counts[0] * counts[1]))]
    return spark.range(n).select("id", *[(F.lit(float(o)) + i * step).alias(c) for c, o, i in zip("xyz", corner, at, strict=True)])


def make_box(spark: SparkSession, corner: Sequence[float], counts: Sequence[int], step: float) -> DataFrame:
    """The points of a grid that lie on its faces."""
    grid = make_grid(spark, corner, counts, step)
    face = F.lit(False)
    at = [F.col("id") % counts[0], F.floor(F.col("id") / counts[0]) % counts[1], F.floor(F.col("id") / (counts[0] * counts[1]))]
    for i, c in zip(at, counts, strict=True):
        face = face | (i == 0) | (i == c - 1)
    return grid.filter(face)


def make_sphere(spark: SparkSession, count: int, radius: float = 1.0) -> DataFrame:
    """Evenly spread points (id, x, y, z) on a sphere, along a spiral of the golden angle."""
    z = 1 - 2 * (F.col("id") + 0.5) / count
    r = F.sqrt(1 - z * z)
    turn = F.col("id") * (math.pi * (3 - math.sqrt(5)))
    return spark.range(count).select("id", (radius * r * F.cos(turn)).alias("x"), (radius * r * F.sin(turn)).alias("y"), (radius * z).alias("z"))


def make_random(spark: SparkSession, count: int, low: Sequence[float], high: Sequence[float], seed: int = 0) -> DataFrame:
    """Points (id, x, y, z) spread at random in a box; the same for the same seed, however the range is split."""
    unit = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(2**52)) / float(2**52)
    return spark.range(count).select("id", *[(F.lit(float(a)) + unit(k) * (b - a)).alias(c) for k, (c, a, b) in enumerate(zip("xyz", low, high, strict=True))])


def make_waves(spark: SparkSession, seconds: float, rate: int, tones: Sequence[tuple[float, float]]) -> DataFrame:
    """Samples (id, t, value) of a sum of tones (frequency, amplitude)."""
    t = F.col("id") / float(rate)
    v = sum((F.lit(float(a)) * F.sin(2 * math.pi * f * t) for f, a in tones), F.lit(0.0))
    return spark.range(int(seconds * rate)).select("id", t.alias("t"), v.alias("value"))
