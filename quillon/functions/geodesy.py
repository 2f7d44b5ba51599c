"""Distances, circles and projections on the sphere and the ellipsoid, and the sun's place. Angles are radians unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V

#: Semi-major axis (m) and flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, 1 / 298.257222101), "AGD84": (6378160.0, 1 / 298.25)}


def vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, ellipsoid: str = "WGS84", rounds: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Distance (m) and initial bearing of the geodesic, all pairs together; NaN where the iteration does not settle (nearly antipodal points)."""
    a, f = ELLIPSOIDS[ellipsoid]
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    gap = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = gap.copy()
    settled = np.zeros(lam.shape, dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1), 0)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 > 1e-15, cs - 2 * su1 * su2 / np.where(ca2 > 1e-15, ca2, 1), 0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = gap + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            again, settled = settled, np.abs(new - lam) < tolerance
            lam = new
            if (again & settled).all():  # one round more than the tolerance asks for
                break
        k2 = ca2 * (a * a - b * b) / (b * b)
        big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        d = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        bearing = np.arctan2(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        return np.where(settled, b * big_a * (sigma - d), np.nan), np.where(settled, bearing, np.nan)


def direct(lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, distance: np.ndarray, ellipsoid: str = "WGS84") -> tuple[np.ndarray, np.ndarray]:
    """The place at a distance and bearing from another along the geodesic."""
    a, f = ELLIPSOIDS[ellipsoid]
    b = a * (1 - f)
    u1 = np.arctan((1 - f) * np.tan(lat))
    s1 = np.arctan2(np.tan(u1), np.cos(bearing))
    sa = np.cos(u1) * np.sin(bearing)
    ca2 = 1 - sa**2
    k2 = ca2 * (a * a - b * b) / (b * b)
    big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    sigma = distance / (b * big_a)
    for _ in range(100):
        c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
        d = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        new = distance / (b * big_a) + d
        if np.all(np.abs(new - sigma) < 1e-13):
            break
        sigma = new
    ss, cs, c2m = np.sin(sigma), np.cos(sigma), np.cos(2 * s1 + sigma)
    su, cu = np.sin(u1), np.cos(u1)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(bearing), (1 - f) * np.hypot(sa, su * ss - cu * cs * np.cos(bearing)))
    lam = np.arctan2(ss * np.sin(bearing), cu * cs - su * ss * np.cos(bearing))
    c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
    gap = lam - (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return lat2, (lon + gap + np.pi) % (2 * np.pi) - np.pi


def _pair(function, names: tuple[str, str]):
    @F.pandas_udf(f"{names[0]} double, {names[1]} double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        x, y = function(*(v.to_numpy(dtype=float, na_value=np.nan) for v in (a, b, c, d)))
        return pd.DataFrame({names[0]: x, names[1]: y}).astype(object).where(lambda q: q.notna(), None).astype("Float64")

    return run


def ellipsoid_distance(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, ellipsoid: str = "WGS84") -> DataFrame:
    """Add distance (m) and bearing of the geodesic between two places; null where a coordinate is null or the places are nearly antipodal."""
    run = _pair(lambda a, b, c, d: vincenty(a, b, c, d, ellipsoid), ("distance", "bearing"))
    return df.withColumn("_g", run(lat1, lon1, lat2, lon2)).select(*df.columns, "_g.distance", "_g.bearing")


def ellipsoid_circle(df: DataFrame, lat: str, lon: str, radius: str, size: int, begin: float = 0.0, end: float = 2 * math.pi, ellipsoid: str = "WGS84") -> DataFrame:
    """Each row as size places on its circle or arc (begin to end, an arc's end included): step, at_lat, at_lon."""
    run = _pair(lambda a, b, c, d: direct(a, b, c, d, ellipsoid), ("at_lat", "at_lon"))
    whole = abs(end - begin - 2 * math.pi) < 1e-12
    rows = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    bearing = F.lit(begin) + F.col("step") * ((end - begin) / (size if whole else max(1, size - 1)))
    return rows.withColumn("_g", run(F.col(lat), F.col(lon), bearing, F.col(radius))).select(*rows.columns, "_g.at_lat", "_g.at_lon")


def ellipsoid_circle_by_step(df: DataFrame, lat: str, lon: str, radius: str, resolution: float, ellipsoid: str = "WGS84") -> DataFrame:
    """Each row as the places on its circle, at most resolution metres apart along it."""
    run = _pair(lambda a, b, c, d: direct(a, b, c, d, ellipsoid), ("at_lat", "at_lon"))
    rows = df.withColumn("_n", F.greatest(F.lit(3), F.ceil(2 * math.pi * F.col(radius) / resolution)).cast("int")).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("_g", run(F.col(lat), F.col(lon), F.col("step") * (2 * math.pi) / F.col("_n"), F.col(radius))).select(*df.columns, "step", "_g.at_lat", "_g.at_lon")


# --- projections: the transverse Mercator series of Krueger to n^4 ---------------------------------------------------------


def to_utm(lat: Column, lon: Column, ellipsoid: str = "WGS84") -> dict[str, Column]:
    """zone, south (boolean), easting, northing of a place in degrees; plain expressions."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    scale = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = 2 * math.sqrt(n) / (1 + n)
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    zone = F.floor((wrapped + 180) / 6).cast("int") + 1
    phi, lam = F.radians(lat), F.radians(wrapped - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alpha, 1):
        x = x + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = lat < 0
    return {"zone": zone, "south": south, "easting": 500_000 + scale * x, "northing": F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0)) + scale * y}


def from_utm(zone: Column, south: Column, easting: Column, northing: Column, ellipsoid: str = "WGS84") -> dict[str, Column]:
    """lat and lon in degrees."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    scale = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = (northing - F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0))) / scale, (easting - 500_000) / scale
    x, y = xi, eta
    for j, be in enumerate(beta, 1):
        x = x - be * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - be * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, de in enumerate(delta, 1):
        phi = phi + de * F.sin(2 * j * chi)
    return {"lat": F.degrees(phi), "lon": F.pmod(zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))) + 180, F.lit(360.0)) - 180}


def to_ned(lat: Column, lon: Column, height: Column, origin: tuple[float, float, float], ellipsoid: str = "WGS84") -> list[Column]:
    """north, east, down (m) of a place in degrees about an origin."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2 - f)

    def earth(la: Column, lo: Column, h: Column) -> list[Column]:
        v = a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
        return [(v + h) * F.cos(la) * F.cos(lo), (v + h) * F.cos(la) * F.sin(lo), (v * (1 - e2) + h) * F.sin(la)]

    la0, lo0 = math.radians(origin[0]), math.radians(origin[1])
    d = V.subtract(earth(F.radians(lat), F.radians(lon), height), earth(F.lit(la0), F.lit(lo0), F.lit(float(origin[2]))))
    rows = [[-math.sin(la0) * math.cos(lo0), -math.sin(la0) * math.sin(lo0), math.cos(la0)], [-math.sin(lo0), math.cos(lo0), 0.0], [-math.cos(la0) * math.cos(lo0), -math.cos(la0) * math.sin(lo0), -math.sin(la0)]]
    return [V.dot(d, V.point(*r)) for r in rows]


# --- great circles -----------------------------------------------------------------------------------------------------


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two places on the sphere, exact for small and for nearly antipodal ones."""
    d = lon2 - lon1
    return F.atan2(F.sqrt((F.cos(lat2) * F.sin(d)) ** 2 + (F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)) ** 2), F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(d))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = lon2 - lon1
    return F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))


def along(lat: Column, lon: Column, bearing: Column, angle: Column) -> list[Column]:
    """The place at an angle from another along a bearing."""
    la = F.asin(F.sin(lat) * F.cos(angle) + F.cos(lat) * F.sin(angle) * F.cos(bearing))
    return [la, V.wrap(lon + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(lat), F.cos(angle) - F.sin(lat) * F.sin(la)))]


def unit(lat: Column, lon: Column) -> list[Column]:
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def between(a: V.Vec, b: V.Vec, c: V.Vec) -> Column:
    """Whether the unit vector c, on the great circle of a and b, lies on the arc between them."""
    n = V.cross(a, b)
    return (V.dot(V.cross(a, c), n) >= -1e-12) & (V.dot(V.cross(c, b), n) >= -1e-12)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _vec(name: str, v: V.Vec) -> list[Column]:
    return [c.alias(f"{name}{i}") for i, c in enumerate(v)]


def arcs_meet(a: V.Vec, b: V.Vec, c: V.Vec, d: V.Vec) -> Column:
    """struct(lat, lon) of the place where two arcs (unit vectors a to b, c to d) cross; nulls if they don't."""
    of = lambda s, k: [s[f"{k}{i}"] for i in range(3)]

    def place(s: Column, n: Column) -> Column:
        size = V.norm(of(n, "n"))
        p = [x / size for x in of(n, "n")]
        m = [-x for x in p]
        ways = [between(of(s, "a"), of(s, "b"), q) & between(of(s, "c"), of(s, "d"), q) for q in (p, m)]
        way = F.when(size <= 1e-12, F.lit(None)).when(ways[0], F.lit(1.0)).when(ways[1], F.lit(-1.0))
        return _let(F.struct(way.alias("w"), *_vec("p", p)), lambda r: F.struct(F.asin(r["w"] * r["p2"]).alias("lat"), F.when(r["w"].isNotNull(), F.atan2(r["w"] * r["p1"], r["w"] * r["p0"])).alias("lon")))

    ends = F.struct(*_vec("a", a), *_vec("b", b), *_vec("c", c), *_vec("d", d))
    return _let(ends, lambda s: _let(F.struct(*_vec("n", V.cross(V.cross(of(s, "a"), of(s, "b")), V.cross(of(s, "c"), of(s, "d"))))), lambda n: place(s, n)))


# --- the sun -----------------------------------------------------------------------------------------------------------


def sun_position(moment_us: Column, lat: Column, lon: Column) -> list[Column]:
    """azimuth (from north, eastward) and elevation of the sun in degrees; place in degrees, moment in microseconds since the UNIX epoch (UTC). Good to about 0.01 degrees."""
    days = moment_us / 86_400_000_000 - 10957.5
    g, q = F.radians(F.lit(357.529) + 0.98560028 * days), 280.459 + 0.98564736 * days
    ecliptic = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * days)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    decl = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * days + lon, F.lit(360.0)))
    hour = sidereal - right
    la = F.radians(lat)
    elevation = F.asin(F.sin(la) * F.sin(decl) + F.cos(la) * F.cos(decl) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour) * F.cos(decl), F.cos(la) * F.sin(decl) - F.sin(la) * F.cos(decl) * F.cos(hour))
    return [F.pmod(F.degrees(azimuth), F.lit(360.0)), F.degrees(elevation)]
