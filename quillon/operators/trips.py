"""Stops and trips from the pings of moving devices.

Method: a device's pings, parted into sessions at gaps, are simplified by time-synchronised Douglas-Peucker; simplified segments of low
speed become stops, the retained moving segments give trips and their distances. All sessions of a batch are simplified at once,
level by level. A device's time is cut into long spans, so that a hot device is shared out. A span also sees the pings of an hour to
either side, and the first ping of each hour is retained, so that both sides of a cut see the same path there: what they find is clipped at the cut
and joined again, on the few rows of stops and trips, with nothing lost or counted twice. A gap longer than that parts a device's pings into runs;
the way across it is added as a leg.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.partitioning import map_groups

METRES_PER_DEGREE = 111_194.93
HOUR = 3_600_000_000


@dataclass(frozen=True)
class Rules:
    """What counts as a stop; metres, seconds, metres a second."""

    place: float = 20.0
    rest: float = 120.0
    absence: float = 60.0
    gap: float = 60.0
    error: float = 9.0
    slow: float = 0.5
    jump: float = 25.0


def simplify(t: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray, error: float, fixed: np.ndarray | None = None) -> np.ndarray:
    """Which points time-synchronised Douglas-Peucker retains, for all paths (that begin at starts) together; fixed ones are retained anyway."""
    n = len(t)
    keep = np.zeros(n, dtype=bool)
    keep[starts] = True
    if fixed is not None:
        keep[fixed] = True
    keep[np.append(starts[1:], n) - 1] = True
    rank = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    corners = np.flatnonzero(keep)
    a, b = corners[:-1], corners[1:]
    live = (rank[a] == rank[b]) & (b - a > 1)
    a, b = a[live], b[live]
    while len(a):
        size = b - a - 1
        seg = np.repeat(np.arange(len(a)), size)
        head = np.cumsum(size) - size
        i = np.arange(size.sum()) - head[seg] + a[seg] + 1
        s, e = a[seg], b[seg]
        f = (t[i] - t[s]) / np.maximum(t[e] - t[s], 1e-9)
        d = (x[i] - x[s] - f * (x[e] - x[s])) ** 2 + (y[i] - y[s] - f * (y[e] - y[s])) ** 2
        most = np.maximum.reduceat(d, head)
        at = np.flatnonzero(d == most[seg])
        _, first = np.unique(seg[at], return_index=True)
        split = i[at[first]]
        far = most > error * error
        keep[split[far]] = True
        a, b = np.concatenate([a[far], split[far]]), np.concatenate([split[far], b[far]])
        live = b - a > 1
        a, b = a[live], b[live]
    return keep


def plausible(t: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, r: Rules, hour: np.ndarray | None = None) -> np.ndarray:
    """Which pings of one device remain when jumps away and back are left out. An unknown speed is taken from the pings of its hour."""
    n = len(t)
    if n < 3:
        return np.ones(n, dtype=bool)
    speed = v.copy()
    unknown = np.isnan(v)
    hour = np.zeros(n, dtype=np.int64) if hour is None else hour
    for h in np.unique(hour[unknown]):
        known = v[(hour == h) & ~unknown]
        speed[unknown & (hour == h)] = np.percentile(known, 90) if len(known) else 15.0

    def joined(i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        return np.hypot(x[j] - x[i], y[j] - y[i]) <= r.jump + 2.5 * np.maximum(speed[i], speed[j]) * (t[j] - t[i])

    k = np.arange(n - 1)
    cuts = np.flatnonzero(~joined(k, k + 1)) + 1
    if not len(cuts):
        return np.ones(n, dtype=bool)
    first, last = np.concatenate([[0], cuts]), np.append(cuts, n) - 1
    keep = np.ones(n, dtype=bool)
    begins = t[first]
    p = 0
    while p < len(first) - 1:
        # However many displaced runs lie in between, as long as the absence is short.
        back = first[p + 2 : np.searchsorted(begins, t[last[p]] + r.absence)]
        home = np.flatnonzero(joined(last[p], back))
        if len(home):
            q = p + 2 + home[0]
            keep[first[p + 1] : first[q]] = False
            p = q - 1
        p += 1
    if last[0] < 3 and last[0] * 3 < n:
        keep[: last[0] + 1] = False
    if n - first[-1] <= 3 and len(first) > 1 and n > 9:
        keep[first[-1] :] = False
    return keep


def _join(rests: list[list], t: np.ndarray, r: Rules) -> list[list]:
    """Join rests at one place: after a gap without pings, or after an absence that is short, whatever lies in between."""
    out: list[list] = []
    for o in rests:
        for k in range(len(out) - 1, -1, -1):
            q = out[k]
            away = t[o[0]] - t[q[1]]
            if away >= r.absence and o[0] > q[1] + 1:
                break
            if np.hypot(o[2] - q[2], o[3] - q[3]) <= r.place:
                w, u = t[q[1]] - t[q[0]] + 1, t[o[1]] - t[o[0]] + 1
                q[1], q[2], q[3] = max(o[1], q[1]), (q[2] * w + o[2] * u) / (w + u), (q[3] * w + o[3] * u) / (w + u)
                del out[k + 1 :]
                break
        else:
            k = -1
        if not out or k < 0 or out[-1][1] < o[1]:
            out.append(o)
    return out


def _rests(t: np.ndarray, x: np.ndarray, y: np.ndarray, corners: np.ndarray, session: np.ndarray, r: Rules) -> list[list]:
    """[first, last, x, y] of each rest of one device: indexes of pings and the place."""
    out: list[list] = []
    close = r.place * 0.4
    for a, b in zip(corners[:-1], corners[1:], strict=True):
        if session[a] != session[b]:
            continue
        span = t[b] - t[a]
        if span <= 0 or np.hypot(x[b] - x[a], y[b] - y[a]) > r.slow * span + 2 * r.error * (span > r.absence / 2):
            continue
        px, py = np.median(x[a : b + 1]), np.median(y[a : b + 1])
        good = np.hypot(x[a : b + 1] - px, y[a : b + 1] - py) <= close
        if good.any():
            out.append([a + int(np.argmax(good)), b - int(np.argmax(good[::-1])), px, py])
    out = _join(out, t, r)
    for o in out:  # pings at the place that simplification gave to the neighbouring segments
        px, py = o[2], o[3] = np.median(x[o[0] : o[1] + 1]), np.median(y[o[0] : o[1] + 1])
        i, j = o[0], o[1]
        while i > 0 and np.hypot(x[i - 1] - px, y[i - 1] - py) <= close and t[i] - t[i - 1] < r.gap:
            i -= 1
        while j < len(t) - 1 and np.hypot(x[j + 1] - px, y[j + 1] - py) <= close and t[j + 1] - t[j] < r.gap:
            j += 1
        o[0], o[1] = i, j
    return _join(out, t, r)


def _speed(t: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, i: int, j: int) -> float:
    """Speed of a moving ping i whose neighbour on the path is j: as reported, unless that is missing or does not fit the path."""
    path = np.hypot(x[i] - x[j], y[i] - y[j]) / max(abs(t[i] - t[j]), 1e-9)
    return float(v[i]) if v[i] > 0.5 and path / 3 <= v[i] <= 3 * path + 1 else max(path, 0.05)


def _bounds(t: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, o: list) -> tuple[float, float]:
    """When the device came to rest and left: the neighbouring moving ping's distance from the place, at its speed."""
    i, j, px, py = o
    start, end = t[i], t[j]
    n = len(t)
    if i:
        d = np.hypot(x[i - 1] - px, y[i - 1] - py)
        start = t[i - 1] + d / _speed(t, x, y, v, i - 1, i - 2 if i > 1 and t[i - 1] - t[i - 2] < 60 else i)
        start = min(start, t[min(i + 1, j)] if t[min(i + 1, j)] - t[i] < 10 else t[i])
    if j < n - 1:
        d = np.hypot(x[j + 1] - px, y[j + 1] - py)
        end = t[j + 1] - d / _speed(t, x, y, v, j + 1, j + 2 if j + 2 < n and t[j + 2] - t[j + 1] < 60 else j)
        end = max(end, t[max(j - 1, i)] if t[j] - t[max(j - 1, i)] < 10 else t[j])
    return start, end


PIECES = "source long, kind string, start long, end long, lat double, lon double, distance double, cut_start boolean, cut_end boolean, opens boolean, closes boolean, from_lat double, from_lon double, to_lat double, to_lon double"


def _apart(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Metres between near positions in degrees; longitude 180 is nothing special."""
    across = ((lon_b - lon_a + 180) % 360 - 180) * np.cos(np.radians((lat_a + lat_b) / 2))
    return np.hypot(lat_b - lat_a, across) * METRES_PER_DEGREE


def _pieces(table: pa.Table, starts: np.ndarray, r: Rules, span: int) -> pa.Table | None:
    """Stops and trips of each span, clipped to it; a run begins at each group and after each gap of more than an hour."""
    n = table.num_rows
    source, moment, which = (table.column(c).to_numpy() for c in ("source", "moment", "span"))
    lat, lon, v = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon", "speed"))
    begins = np.zeros(n, dtype=bool)
    begins[starts] = True
    begins[1:] |= np.diff(moment) > HOUR
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    t = (moment - moment[starts][group]) / 1e6
    y = (lat - lat[starts][group]) * METRES_PER_DEGREE
    x = ((lon - lon[starts][group] + 180) % 360 - 180) * METRES_PER_DEGREE * np.cos(np.radians(lat[starts]))[group]
    hour = moment // HOUR
    keep = np.concatenate([plausible(t[s:e], x[s:e], y[s:e], v[s:e], r, hour[s:e]) for s, e in zip(starts, ends, strict=True)])
    source, moment, which, lat, lon, v, t, x, y, group, hour = (q[keep] for q in (source, moment, which, lat, lon, v, t, x, y, group, hour))
    if not len(t):
        return None
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_session = new_group.copy()
    new_session[1:] |= np.diff(t) > r.gap
    new_hour = np.concatenate([[True], hour[1:] != hour[:-1]])
    session = np.cumsum(new_session) - 1
    retained = simplify(t, x, y, np.flatnonzero(new_session), r.error, np.flatnonzero(new_hour))
    first = np.flatnonzero(new_group)
    rows: list[tuple] = []
    for s, e in zip(first, np.append(first[1:], len(t)), strict=True):
        low, high = int(which[s]) * span, (int(which[s]) + 1) * span
        if moment[e - 1] < low or moment[s] >= high:
            continue  # a run that only the neighbouring span owns
        tt, xx, yy, vv = t[s:e], x[s:e], y[s:e], v[s:e]
        own = np.flatnonzero(retained[s:e])
        path = np.concatenate([[0], np.cumsum(_apart(lat[s:e][own[:-1]], lon[s:e][own[:-1]], lat[s:e][own[1:]], lon[s:e][own[1:]]))])
        base = int(moment[s]) - int(round(tt[0] * 1e6))
        way = lambda q: float(np.interp(q, tt[own], path))  # noqa: B023, E731
        stamp = lambda q: base + int(round(q * 1e6))  # noqa: B023, E731
        ends_of_run = float(lat[s]), float(lon[s]), float(lat[e - 1]), float(lon[e - 1])
        starts_here, ends_here = moment[s] >= low, moment[e - 1] < high

        def add(kind: str, begin: float, end: float, from_ping: float, to_ping: float, place: tuple) -> None:  # noqa: B023
            a, b = stamp(begin), stamp(end)  # noqa: B023
            if b < low or a >= high or (b == low and a < low):  # noqa: B023
                return
            far = 0.0 if kind == "stop" else (way((high - base) / 1e6) if b > high else way(to_ping)) - (way((low - base) / 1e6) if a < low else way(from_ping))  # noqa: B023
            opens, closes = begin <= tt[0] and starts_here, end >= tt[-1] and ends_here  # noqa: B023
            rows.append((int(source[s]), kind, max(a, low), min(b, high), *place, far, a < low, b > high, bool(opens), bool(closes), *ends_of_run))  # noqa: B023

        at, here = tt[0], tt[0]
        found: list[tuple[list, float, float]] = []
        for o in _rests(tt, xx, yy, own, session[s:e], r):
            begin, end = _bounds(tt, xx, yy, vv, o)
            if end - begin < r.rest and o[0] != 0 and o[1] != len(tt) - 1:
                continue
            if found and begin - found[-1][2] < r.absence and np.hypot(o[2] - found[-1][0][2], o[3] - found[-1][0][3]) <= r.place:
                last, since, _ = found.pop()  # as it turns out, the device was away for less than it seemed
                o, begin = [last[0], o[1], last[2], last[3]], since
            found.append((o, begin, end))
        for o, begin, end in found:
            if begin > here or tt[o[0]] > at:
                add("trip", here, begin, at, tt[o[0]], (None, None))
            k = s + o[0] + (o[1] - o[0]) // 2
            mid_lat = float(lat[k] + (o[3] - y[k]) / METRES_PER_DEGREE)
            mid_lon = float((lon[k] + (o[2] - x[k]) / (METRES_PER_DEGREE * max(np.cos(np.radians(lat[k])), 1e-6)) + 180) % 360 - 180)
            add("stop", begin, end, 0, 0, (mid_lat, mid_lon))
            at, here = tt[o[1]], end
        if at < tt[-1] or here == tt[0]:
            add("trip", here, tt[-1], at, tt[-1], (None, None))
    if not rows:
        return None
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 3, *[pa.bool_()] * 4, *[pa.float64()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def stops_and_trips(pings: DataFrame, *, source: str, moment: str, id: str, lat: str, lon: str, speed: str, rules: Rules | None = None, span: int = 24 * HOUR) -> DataFrame:
    """(source, kind, start, end, lat, lon, distance): the stops and trips of each source in order; times in microseconds, metres.

    lat and lon are degrees, speed metres a second (null or NaN if unknown). Pings with a null in source, moment, id, lat or lon are left out;
    pings of one id count once; one ping alone makes neither stop nor trip. A stop is a rest of at least rules.rest seconds at one
    place; short absences and gaps with the same place before and after belong to it. Whatever lies between stops is a trip. A source that
    begins or ends at rest has a stop from its first or to its last ping. lat and lon of a trip are null. Longitude 180 is nothing special.
    span, in microseconds, is a whole number of hours; results don't depend on it, but for the place of a stop (a median of what one span sees). Empty
    tables give no rows.
    """
    if span % HOUR or span <= 0:
        raise ValueError("span must be a whole number of hours")
    r = rules or Rules()
    usable = pings.select(F.col(source).cast("long").alias("source"), F.col(moment).cast("long").alias("moment"), F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(speed).cast("double").alias("speed"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("moment").isNotNull() & (F.abs("lat") <= 90) & (F.abs("lon") <= 360) & ~F.isnan("lat") & ~F.isnan("lon"))
    seen = F.sequence(F.floor((F.col("moment") - HOUR) / span), F.floor((F.col("moment") + HOUR) / span))
    once = usable.dropDuplicates(["source", "moment", "id"]).withColumn("span", F.explode(seen))
    pieces = map_groups(once, ["source", "span"], ["moment", "id"], lambda t, s: _pieces(t, s, r, span), PIECES)
    in_order = Window.partitionBy("source").orderBy("start", "end", "kind")
    before = lambda c: F.lag(c).over(in_order)
    metres = lambda a, b, c, d: F.hypot(F.col(c) - before(a), (F.pmod(F.col(d) - before(b) + 180, F.lit(360.0)) - 180) * F.cos(F.radians((F.col(c) + before(a)) / 2))) * METRES_PER_DEGREE
    across = F.col("opens") & before("closes")
    halves = (F.col("kind") == "stop") & (before("kind") == "stop") & ((F.col("cut_start") & before("cut_end") & (F.col("start") == before("end"))) | (across & (metres("lat", "lon", "lat", "lon") <= r.place)))
    joined = pieces.withColumn("_go", F.coalesce(halves, F.lit(False))).withColumn("_across", F.when(across & ~F.col("_go"), metres("to_lat", "to_lon", "from_lat", "from_lon"))).withColumn("_since", before("end"))
    nth = lambda first: F.sum(F.when(first, 1).otherwise(0)).over(in_order)
    numbered = joined.withColumn("_stop", nth((F.col("kind") == "stop") & ~F.col("_go")))
    # A piece, and the leg that leads to it across a gap; that belongs to what follows the stop before.
    own = F.struct("_stop", "kind", "start", "end", "lat", "lon", "distance")
    none = F.lit(None).cast("double")
    leg = F.struct((F.col("_stop") - F.when(F.col("kind") == "stop", 1).otherwise(0)).alias("_stop"), F.lit("trip").alias("kind"), F.col("_since").alias("start"), F.col("start").alias("end"), none.alias("lat"), none.alias("lon"), F.col("_across").alias("distance"))
    rows = numbered.select("source", F.explode(F.when(F.col("_across").isNull(), F.array(own)).otherwise(F.array(own, leg))).alias("_r")).select("source", "_r.*")
    merge = [F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("lat", "start").alias("lat"), F.min_by("lon", "start").alias("lon"), F.sum("distance").alias("distance")]
    merged = rows.groupBy("source", "kind", "_stop").agg(*merge).withColumn("_long", (F.col("kind") == "stop") & (F.col("end") - F.col("start") >= r.rest * 1e6))
    kept = merged.withColumn("_leg", nth(F.col("_long"))).filter((F.col("kind") == "trip") | F.col("_long"))
    return kept.groupBy("source", "kind", "_leg").agg(*merge).drop("_leg").filter("end > start").select("source", "kind", "start", "end", "lat", "lon", "distance")
