"""Calculations along ordered paths.

by: the columns of a path (rows of different paths don't meet), order: the columns that order it; they should order it fully, else ties
are taken in any order. Coordinates that are null give nulls where they are needed. Empty tables give empty results; other columns are kept.
What is a window or a prefix sum stays in the JVM, and is shared out over tasks where a path is very long (chunked); greedy scans stream
through ordered_scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.plans.partitioning import chunked, ordered_scan, own, running

XYZ = ("x", "y", "z")


def _window(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def _lag(axes: Sequence[str], w: Window, n: int = 1) -> list[Column]:
    return [F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w) for c in axes]


def _cols(axes: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in axes]


def step_distance(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str] = XYZ, following: bool = False, propagate: bool = False) -> DataFrame:
    """Add distance from the previous row, or with following to the next; 0 where there is none. propagate: a step of 0 repeats the last that isn't 0."""
    laid, parts = chunked(df, by, order)
    return _steps(laid, parts, by, order, axes, following, propagate).drop("_chunk")


def _steps(laid: DataFrame, parts: Sequence[str], by: Sequence[str], order: Sequence[str], axes: Sequence[str], following: bool = False, propagate: bool = False) -> DataFrame:
    d = F.coalesce(V.distance(_cols(axes), _lag(axes, _window(parts, order), -1 if following else 1)), F.lit(0.0))
    out = own(laid.withColumn("distance", d))
    if propagate:
        out = running(out, by, order, F.when(F.col("distance") > 0, F.col("distance")), "_last", "last").withColumn("distance", F.coalesce("_last", F.lit(0.0))).drop("_last")
    return out


def path_length(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str] = XYZ, differential: bool = False) -> DataFrame:
    """Add distance so far along the path, 0 at its first row; differential: rows are steps, and each adds its own length."""
    laid, parts = chunked(df, by, order)
    step = own(laid).withColumn("distance", V.norm(_cols(axes))) if differential else _steps(laid, parts, by, order, axes)
    return running(step.withColumnRenamed("distance", "_step"), by, order, F.col("_step"), "distance").drop("_step", "_chunk")


def turn_angle_axis(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str] = XYZ, following: bool = False) -> DataFrame:
    """Add axis_x, axis_y, axis_z, angle of the shortest turn from the previous position vector to this one (following: from this to the next); 0s at the end."""
    laid, parts = chunked(df, by, order)
    near = _lag(axes, _window(parts, order), -1 if following else 1)
    turn = V.angle_axis(_cols(axes), near) if following else V.angle_axis(near, _cols(axes))
    return own(laid.withColumns(dict(zip(("axis_x", "axis_y", "axis_z", "angle"), turn, strict=True)))).drop("_chunk")


def heading_change(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str] = XYZ, reverse: bool = False, ignore_repeats: bool = False) -> DataFrame:
    """Add angle between the incoming and the outgoing step; 0 at either end and where a step is shorter than 1e-6. reverse: pi less the angle.

    ignore_repeats: steps lead from and to the nearest rows at another place.
    """
    laid, parts = chunked(df, by, order)
    w = _window(parts, order)
    at = {f"_p{i}": v for i, v in enumerate(_lag(axes, w))} | {f"_q{i}": v for i, v in enumerate(_lag(axes, w, -1))}
    if ignore_repeats:
        moved = own(laid.withColumn("_new", F.coalesce(V.distance(_cols(axes), _lag(axes, w)) > 1e-6, F.lit(True))))
        moved = running(moved, by, order, F.col("_new").cast("int"), "_place").drop("_chunk")
        places, parts = chunked(moved.filter("_new").select(*by, "_place", *axes), by, ["_place"])
        wp = _window(parts, ["_place"])
        near = own(places.withColumns({f"_p{i}": v for i, v in enumerate(_lag(axes, wp))} | {f"_q{i}": v for i, v in enumerate(_lag(axes, wp, -1))}))
        ready = moved.join(near.select(*by, "_place", *at), [*by, "_place"]).drop("_new", "_place")
    else:
        ready = own(laid.withColumns(at))
    before, after = [F.col(f"_p{i}") for i in range(len(axes))], [F.col(f"_q{i}") for i in range(len(axes))]
    a, b = V.subtract(_cols(axes), before), V.subtract(after, _cols(axes))
    na, nb = V.norm(a), V.norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(a, b) / (na * nb)))
    angle = math.pi - F.acos(cosine) if reverse else F.acos(cosine)
    out = ready.withColumn("angle", F.when((na > 1e-6) & (nb > 1e-6), angle).otherwise(F.lit(0.0)))
    return out.drop("_chunk", *at).select(*df.columns, "angle")


def discretise(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], step: float, tolerance: float = 1e-9) -> DataFrame:
    """Each row at its place and at each step along the segment to the next (while short of its end by more than tolerance): at_<axis>."""
    laid, parts = chunked(df, by, order)
    nxt = own(laid.withColumns({f"_n{i}": v for i, v in enumerate(_lag(axes, _window(parts, order), -1))})).drop("_chunk")
    size = V.distance(_cols(axes), [F.col(f"_n{i}") for i in range(len(axes))])
    count = F.greatest(F.lit(0), F.ceil((size - tolerance) / step) - 1)
    nxt = nxt.withColumn("_len", size).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(count, F.lit(0)).cast("long"))))
    at = {f"at_{c}": F.when(F.col("_k") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n{i}") - F.col(c)) * (F.col("_k") * step / F.col("_len"))) for i, c in enumerate(axes)}
    return nxt.withColumns(at).drop("_k", "_len", *[f"_n{i}" for i in range(len(axes))])


def sample_path(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], step: float, tolerance: float = 1e-9) -> DataFrame:
    """Points at each multiple of step along the whole path, and its last point: at_<axis> and along, added to the row whose segment holds them."""
    laid, parts = chunked(df, by, order)
    moved = _steps(laid.withColumns({f"_n{i}": v for i, v in enumerate(_lag(axes, _window(parts, order), -1))}), parts, by, order, axes)
    so_far = running(moved.withColumnRenamed("distance", "_step"), by, order, F.col("_step"), "_at").drop("_step", "_chunk")
    seg = V.distance(_cols(axes), [F.col(f"_n{i}") for i in range(len(axes))])
    first = F.ceil((F.col("_at") - tolerance) / step)
    last = F.ceil((F.col("_at") + F.col("_seg") - tolerance) / step) - 1
    ks = F.when(F.col("_seg").isNull(), F.array(F.lit(-1).cast("long"))).when(last >= first, F.sequence(first.cast("long"), last.cast("long")))
    rows = so_far.withColumn("_seg", seg).withColumn("_k", F.explode(ks))
    along = F.when(F.col("_k") < 0, F.col("_at")).otherwise(F.col("_k") * step)
    share = F.when(F.col("_k") < 0, F.lit(0.0)).otherwise((along - F.col("_at")) / F.col("_seg"))
    at = {f"at_{c}": F.when(F.col("_k") < 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n{i}") - F.col(c)) * share) for i, c in enumerate(axes)}
    return rows.withColumns(at | {"along": along}).drop("_k", "_seg", "_at", *[f"_n{i}" for i in range(len(axes))])


def _numpy(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


def thin_path(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], resolution: float, accumulate: bool = True) -> DataFrame:
    """Keep a row when the distance since the last kept one reaches resolution: along the path, or straight if accumulate is false. The first is kept."""

    def step(state, rows: pa.Table):
        p = _numpy(rows, axes)
        last, prev, gone = state or (None, p[0], 0.0)
        keep = np.zeros(len(p), dtype=bool)
        if not accumulate:
            for i, q in enumerate(p):
                if last is None or float(np.linalg.norm(q - last)) >= resolution:
                    keep[i], last = True, q
            return (last, p[-1], 0.0), rows.filter(pa.array(keep))
        # From kept row to kept row along the length of the path.
        along = gone + np.cumsum(np.linalg.norm(np.diff(p, axis=0, prepend=prev[None]), axis=1))
        base, at = 0.0, 0
        if last is None:
            keep[0], last, base, at = True, p[0], along[0], 1
        while (at := max(at, int(np.searchsorted(along, base + resolution)))) < len(p):
            keep[at], base = True, along[at]
            at += 1
        return (p[0] if last is None else last, p[-1], float(along[-1] - base)), rows.filter(pa.array(keep))

    return ordered_scan(df.dropna(subset=list(axes)), list(by), list(order), step, df.schema)


def chords(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], max_ratio: float, max_arc: float) -> DataFrame:
    """Each row with the row number, arc and chord of the furthest later row with arc / chord <= max_ratio and arc <= max_arc (none: itself).

    Adds row, to_row, arc, chord. The rows that a row may reach lie within max_arc of path, so the self-join is on slices of path length.
    """
    laid, parts = chunked(df, by, order)
    step = _steps(laid, parts, by, order, axes).withColumnRenamed("distance", "_step")
    p = running(running(step, by, order, F.col("_step"), "_at"), by, order, F.lit(1), "row").drop("_step", "_chunk")
    p = p.withColumns({"row": F.col("row").cast("int"), "_s": F.floor(F.col("_at") / max_arc)})
    slim = p.select(*by, "row", "_at", "_s", *axes)
    ahead = slim.withColumn("_s", F.explode(F.array(F.col("_s"), F.col("_s") - 1))).withColumnsRenamed({"row": "_r", "_at": "_b", **{c: f"_{c}" for c in axes}})
    chord = V.distance(_cols(axes), [F.col(f"_{c}") for c in axes])
    pairs = slim.join(ahead, [*by, "_s"]).withColumns({"_arc": F.col("_b") - F.col("_at"), "_chord": chord})
    pairs = pairs.filter((F.col("_r") > F.col("row")) & (F.col("_arc") <= max_arc) & (F.col("_chord") > 0) & (F.col("_arc") <= max_ratio * F.col("_chord")))
    best = pairs.groupBy(*by, "row").agg(F.max_by(F.struct("_r", "_arc", "_chord"), "_r").alias("_best"))
    out = p.join(best, [*by, "row"], "left")
    return out.select(*df.columns, "row", F.coalesce("_best._r", "row").alias("to_row"), F.coalesce("_best._arc", F.lit(0.0)).alias("arc"), F.coalesce("_best._chord", F.lit(0.0)).alias("chord"))


def chord_chain(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the rows of chords(), those met when each goes on to its to_row, or to the next row if that is itself; begins with the first."""

    def step(state, rows: pa.Table):
        row, to = rows.column("row").to_numpy(), rows.column("to_row").to_numpy()
        keep = np.zeros(len(row), dtype=bool)
        for i in range(len(row)):
            if state is None or row[i] == state:
                keep[i] = True
                state = int(to[i]) if to[i] > row[i] else int(row[i]) + 1
        return state, rows.filter(pa.array(keep))

    return ordered_scan(found, list(by), ["row"], step, found.schema)


def direction_partitions(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], threshold: float = math.pi / 2, hysteresis: float = 0.0) -> DataFrame:
    """Add partition (from 0): a new one begins where the direction is threshold or more off the partition's first, and its length exceeds hysteresis."""

    def step(state, rows: pa.Table):
        p = _numpy(rows, axes)
        part, prev, first, gone = state or (0, None, None, 0.0)
        out = np.empty(len(p), dtype=np.int64)
        for i, q in enumerate(p):
            if prev is not None:
                d = q - prev
                n = float(np.linalg.norm(d))
                if n > 0:
                    if first is None:
                        first, gone = d / n, n
                    elif math.acos(max(-1.0, min(1.0, float(first @ d) / n))) >= threshold and gone >= hysteresis:
                        part, first, gone = part + 1, d / n, n
                    else:
                        gone += n
            out[i], prev = part, q
        return (part, prev, first, gone), rows.append_column("partition", pa.array(out))

    clean = df.dropna(subset=list(axes))
    return ordered_scan(clean, list(by), list(order), step, clean.withColumn("partition", F.lit(0).cast("long")).schema)


def plane_crossings(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], origin: Sequence[float], plane_normal: Sequence[float], max_gap: float | None = None) -> DataFrame:
    """Rows at whose step the path crosses a plane: at_<axis>, and direction 1 along the normal, -1 against it, 0 for a step within the plane.

    max_gap: steps longer than this are gaps and cross nothing.
    """
    laid, parts = chunked(df, by, order)
    w = _window(parts, order)
    d = V.dot(V.subtract(_cols(axes), V.point(*origin)), V.point(*plane_normal))
    stepped = own(laid.withColumn("_d", d).withColumns({"_e": F.lag("_d").over(w)} | {f"_p{i}": v for i, v in enumerate(_lag(axes, w))})).drop("_chunk")
    before = [F.col(f"_p{i}") for i in range(len(axes))]
    hit = stepped.filter((F.col("_d") * F.col("_e") <= 0) & ~((F.col("_e") == 0) & (F.col("_d") != 0)))
    if max_gap is not None:
        hit = hit.filter(V.distance(_cols(axes), before) <= max_gap)
    share = F.when(F.col("_e") == F.col("_d"), F.lit(1.0)).otherwise(F.col("_e") / (F.col("_e") - F.col("_d")))
    at = {f"at_{c}": b + (F.col(c) - b) * share for c, b in zip(axes, before, strict=True)}
    return hit.withColumns(at | {"direction": F.signum(F.col("_d") - F.col("_e")).cast("int")}).drop("_d", "_e", *[f"_p{i}" for i in range(len(axes))])


def integrate_frames(df: DataFrame, by: Sequence[str], order: Sequence[str], inverse: bool = False) -> DataFrame:
    """Replace each pose (x, y, z, roll, pitch, yaw), given in the frame of the row before, by the pose in the frame of the first.

    inverse: poses are those of the row before in the frame of the row. Poses with a null are left out.
    """
    names = ["x", "y", "z", "roll", "pitch", "yaw"]

    def matrices(r: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        cr, sr, cp, sp, cy, sy = np.cos(r), np.sin(r), np.cos(p), np.sin(p), np.cos(y), np.sin(y)
        rows = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
        return np.array(rows).transpose(2, 0, 1)

    def step(state, rows: pa.Table):
        poses = _numpy(rows, names)
        m, d = matrices(*poses[:, 3:].T), poses[:, :3].copy()
        if inverse:
            m = m.transpose(0, 2, 1)
            d = -np.einsum("nij,nj->ni", m, d)
        if state is not None:
            d[0], m[0] = state[1] + state[0] @ d[0], state[0] @ m[0]
        reach = 1
        while reach < len(m):  # poses compose associatively: each round doubles the rows that a row has taken in
            d[reach:] = d[:-reach] + np.einsum("nij,nj->ni", m[:-reach], d[reach:])
            m[reach:] = m[:-reach] @ m[reach:]
            reach *= 2
        out = np.column_stack([d, np.arctan2(m[:, 2, 1], m[:, 2, 2]), np.arcsin(np.clip(-m[:, 2, 0], -1, 1)), np.arctan2(m[:, 1, 0], m[:, 0, 0])])
        for k, c in enumerate(names):
            rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(out[:, k]))
        return (m[-1], d[-1]), rows

    ready = df.dropna(subset=names).withColumns({c: F.col(c).cast("double") for c in names})
    return ordered_scan(ready, list(by), list(order), step, ready.schema)


def wayline_errors(df: DataFrame, start: tuple[str, str], end: tuple[str, str], at: tuple[str, str] = ("x", "y"), heading: str = "yaw", proximity: float = 0.1) -> DataFrame:
    """Add cross_track (positive to the left of the line from start to end), heading_error (wrapped) and reached: near the end, or past it."""
    sx, sy, ex, ey, x, y = (F.col(c) for c in (*start, *end, *at))
    dx, dy = ex - sx, ey - sy
    size = F.hypot(dx, dy)
    cross = (dx * (y - sy) - dy * (x - sx)) / size
    along = (dx * (x - sx) + dy * (y - sy)) / size
    return df.withColumns({"cross_track": cross, "heading_error": V.wrap(F.atan2(dy, dx) - F.col(heading)), "reached": (F.hypot(x - ex, y - ey) <= proximity) | (along >= size)})


def follow_waypoints(feedback: DataFrame, waypoints: Sequence[tuple[float, float]], by: Sequence[str], order: Sequence[str], proximity: float = 0.1, dynamic: bool = False) -> DataFrame:
    """Feedback rows (x, y, yaw) with the waypoint they head for: target, cross_track, heading_error, reached.

    waypoints is a short route. fixed: lines lead from waypoint to waypoint, the first from the first feedback; dynamic: each line begins where the
    vehicle was when it took up the target. After the last waypoint, target stays there.
    """
    route = [tuple(map(float, p)) for p in waypoints]

    def step(state, rows: pa.Table):
        p = _numpy(rows, ["x", "y", "yaw"])
        k, start = state or (0, tuple(p[0, :2]))
        out = np.empty((len(p), 4))
        for i, (x, y, yaw) in enumerate(p):
            ex, ey = route[min(k, len(route) - 1)]
            dx, dy = ex - start[0], ey - start[1]
            size = math.hypot(dx, dy) or 1.0
            reached = math.hypot(x - ex, y - ey) <= proximity or (dx * (x - start[0]) + dy * (y - start[1])) / size >= size
            off = (math.atan2(dy, dx) - yaw + math.pi) % (2 * math.pi) - math.pi
            out[i] = (min(k, len(route) - 1), (dx * (y - start[1]) - dy * (x - start[0])) / size, off, reached)
            if reached and k < len(route):
                start, k = ((x, y) if dynamic else (ex, ey)), k + 1
        rows = rows.append_column("target", pa.array(out[:, 0].astype(np.int32))).append_column("cross_track", pa.array(out[:, 1]))
        return (k, start), rows.append_column("heading_error", pa.array(out[:, 2])).append_column("reached", pa.array(out[:, 3] > 0))

    ready = feedback.dropna(subset=["x", "y", "yaw"])
    schema = ready.withColumns({"target": F.lit(0), "cross_track": F.lit(0.0), "heading_error": F.lit(0.0), "reached": F.lit(True)}).schema
    return ordered_scan(ready, list(by), list(order), step, schema)


def turn_speed(df: DataFrame, by: Sequence[str], order: Sequence[str], speed: str, max_acceleration: float, approach_speed: float, sharp_angle: float = math.pi / 2, axes: Sequence[str] = ("x", "y"), pivot: bool = False) -> DataFrame:
    """Lower speed to what the turn at each row allows: sqrt(max_acceleration * circumradius), no less than approach_speed; sharp turns get approach_speed.

    pivot: adds relative_heading, 0, and after each sharp turn a further row with speed 0 and the turn's angle (positive anticlockwise).
    """
    laid, parts = chunked(df, by, order)
    w = _window(parts, order)
    beside = {f"_p{i}": v for i, v in enumerate(_lag(axes, w))} | {f"_q{i}": v for i, v in enumerate(_lag(axes, w, -1))}
    df = own(laid.withColumns(beside)).drop("_chunk")
    a, b, c = [F.col(f"_p{i}") for i in range(len(axes))], _cols(axes), [F.col(f"_q{i}") for i in range(len(axes))]
    ab, bc, ca = V.distance(a, b), V.distance(b, c), V.distance(c, a)
    area = F.sqrt(F.greatest(F.lit(0.0), (ab + bc + ca) * (bc + ca - ab) * (ab + ca - bc) * (ab + bc - ca))) / 4
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(V.subtract(b, a), V.subtract(c, b)) / (ab * bc))))
    limit = F.when(angle >= sharp_angle, F.lit(approach_speed)).when(area > 0, F.greatest(F.lit(approach_speed), F.sqrt(max_acceleration * ab * bc * ca / (4 * area))))
    slowed = F.when((ab > 0) & (bc > 0), F.least(F.col(speed), F.coalesce(limit, F.col(speed)))).otherwise(F.col(speed))
    if not pivot:
        return df.withColumn(speed, slowed).drop(*beside)
    (ax, ay), (bx, by_) = V.subtract(b, a)[:2], V.subtract(c, b)[:2]
    turn = F.atan2(ax * by_ - ay * bx, ax * bx + ay * by_)
    out = df.withColumns({"_v": slowed, "_turn": F.when((ab > 0) & (bc > 0) & (angle >= sharp_angle), turn)})
    moving = F.struct(F.col("_v").alias("v"), F.lit(0.0).alias("h"))
    both = F.when(F.col("_turn").isNull(), F.array(moving)).otherwise(F.array(moving, F.struct(F.lit(0.0).alias("v"), F.col("_turn").alias("h"))))
    return out.withColumn("_b", F.explode(both)).withColumns({speed: F.col("_b.v"), "relative_heading": F.col("_b.h")}).drop("_v", "_b", "_turn", *beside)


def braking_speed(df: DataFrame, by: Sequence[str], order: Sequence[str], speed: str, deceleration: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Lower speed so that every later one can be met at this deceleration: sqrt(min over later rows of v^2 + 2 a D, less 2 a D here), D along the path."""
    laid, parts = chunked(df, by, order)
    step = _steps(laid, parts, by, order, axes).withColumnRenamed("distance", "_step")
    at = running(step, by, order, F.col("_step"), "_at")
    least = running(at, by, order, F.col(speed) * F.col(speed) + 2 * deceleration * F.col("_at"), "_least", "min", following=True)
    return least.withColumn(speed, F.sqrt(F.greatest(F.lit(0.0), F.col("_least") - 2 * deceleration * F.col("_at")))).drop("_step", "_at", "_least", "_chunk")


def pid(df: DataFrame, by: Sequence[str], order: str, error: str, p: float, i: float, d: float, integral_limit: float | None = None, angular: bool = False) -> DataFrame:
    """Add command = p e + i integral(e dt) + d de/dt; order is the time in seconds. The integral is clipped at +- integral_limit; angular errors wrap.

    The first row of a group has neither integral nor derivative; a row at the same time as the last keeps both.
    """

    def step(state, rows: pa.Table):
        v = _numpy(rows, [order, error])
        out = np.empty(len(v))
        total, last_t, last_e, slope = state or (0.0, None, None, 0.0)
        for k, (t, e) in enumerate(v):
            if angular:
                e = (e + math.pi) % (2 * math.pi) - math.pi
            if last_t is not None and t > last_t:
                dt, change = t - last_t, e - last_e
                if angular:
                    change = (change + math.pi) % (2 * math.pi) - math.pi
                total, slope = total + e * dt, change / dt
                if integral_limit is not None:
                    total = max(-integral_limit, min(integral_limit, total))
            out[k], last_t, last_e = p * e + i * total + d * slope, t, e
        return (total, last_t, last_e, slope), rows.append_column("command", pa.array(out))

    ready = df.dropna(subset=[order, error])
    return ordered_scan(ready, list(by), [order], step, ready.withColumn("command", F.lit(0.0)).schema)


def carrots(feedback: DataFrame, path: DataFrame, by: Sequence[str], order: Sequence[str], search: float, max_ratio: float, max_arc: float, axes: Sequence[str] = ("x", "y"), stuck_timeout: float | None = None, time: str = "t") -> DataFrame:
    """Each feedback row (id, axes) with the path row it is nearest to (within search) and that row's furthest fair look-ahead: near_row, carrot_row, carrot_<axis>.

    stuck_timeout: while the furthest near row so far has not advanced, near_row is pushed forward by one row, up to the last, for each such time (column
    time, of the unit of stuck_timeout; feedback rows are ordered by it and id).
    """
    from quillon.operators.spatial_join import RIGHT, nearest_within

    found = chords(path, by, order, axes, max_ratio, max_arc)
    near = nearest_within(feedback, found.select(*by, *axes, "row", "to_row"), search, "id", "row", axes=axes, keys=by)
    target = found.select(*by, F.col("row").alias("carrot_row"), *[F.col(c).alias(f"carrot_{c}") for c in axes])
    near = near.select(*feedback.columns, F.col(RIGHT + "row").alias("near_row"), F.col(RIGHT + "to_row").alias("carrot_row"))
    if stuck_timeout is not None:
        w = _window(by, [time, "id"])
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        furthest = near.withColumn("_far", F.max("near_row").over(so_far))
        moved = furthest.withColumn("_new", F.coalesce(F.col("_far") > F.lag("_far").over(w), F.lit(True))).withColumn("_since", F.last(F.when(F.col("_new"), F.col(time)), ignorenulls=True).over(so_far))
        last = found.groupBy(*by).agg(F.max("row").alias("_last"))
        pushed = moved.join(last, list(by)).withColumn("near_row", F.least(F.col("_last").cast("long"), F.col("near_row") + F.floor((F.col(time) - F.col("_since")) / stuck_timeout)))
        near = pushed.drop("carrot_row", "_far", "_new", "_since", "_last").join(found.select(*by, F.col("row").cast("long").alias("near_row"), F.col("to_row").alias("carrot_row")), [*by, "near_row"])
    return near.join(target, [*by, "carrot_row"])
