"""Joins and corrections in time: poses by time, clocks.

Prefix sums and as-of windows stay in the JVM; the periodic correction depends on its own results and streams through ordered_scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.plans.partitioning import chunked, ordered_scan, own, running

POSE = ("x", "y", "z", "roll", "pitch", "yaw")


def brackets(frames: DataFrame, by: list[str], time: str = "t") -> DataFrame:
    """Each frame with the next: first_<column>, second_<column>. Of frames at one time the last in value order is taken."""
    cols = [c for c in frames.columns if c not in by]
    whole = F.struct(*[F.col(c) for c in [time, *[c for c in cols if c != time]]])
    single = frames.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_t")).agg(F.max(whole).alias("first"))
    laid, parts = chunked(single, by, ["_t"])
    return own(laid.withColumn("second", F.lead("first").over(Window.partitionBy(*parts).orderBy("_t")))).drop("_t", "_chunk")


def frame_at(points: DataFrame, frames: DataFrame, by: list[str], time: str = "t", interpolate: bool = True, max_gap: float | None = None, discard_out_of_order: bool = True, slice_width: float | None = None) -> DataFrame:
    """Each point with the frame (x, y, z, roll, pitch, yaw: frame_<...>) at its time.

    Between two frames the position is interpolated linearly and the orientation along the arc; without interpolate the nearer frame is
    taken, the first at half way. time is a number. A point before the first or after the last frame, or in a bracket wider than max_gap,
    is out of order: discarded, or with discard_out_of_order false an error. At the time of a frame, that frame counts.
    The join is on slices of time: a bracket is copied to the slices it covers, so slice_width should be of the order of a bracket.
    """
    b = brackets(frames.select(*by, time, *POSE), by, time)
    if max_gap is not None:
        b = b.withColumn("second", F.when(F.col("second")[time] - F.col("first")[time] <= max_gap, F.col("second")))
    width = slice_width or max_gap or 60.0
    end = F.coalesce(F.col("second")[time], F.col("first")[time])
    cells = b.withColumn("_s", F.explode(F.sequence(F.floor(F.col("first")[time] / width).cast("long"), F.floor(end / width).cast("long"))))
    p = points.filter(F.col(time).isNotNull()).withColumn("_s", F.floor(F.col(time) / width))
    inside = (F.col(time) >= F.col("first")[time]) & ((F.col(time) < F.col("second")[time]) | (F.col(time) == F.col("first")[time]))
    renamed = cells.withColumnsRenamed({k: f"_{k}" for k in by})
    cond = p["_s"] == renamed["_s"]
    for k in by:
        cond = cond & (p[k] == renamed[f"_{k}"])
    joined = p.join(renamed, cond & inside, "inner" if discard_out_of_order else "left")
    if not discard_out_of_order:
        lost = F.raise_error(F.concat(F.lit("out of order at "), F.col(time).cast("string"))).cast("boolean")
        joined = joined.filter(F.when(F.col("first").isNull(), lost).otherwise(F.lit(True)))
    t0, t1 = F.col("first")[time], F.col("second")[time]
    share = F.when(t1 > t0, (F.col(time) - t0) / (t1 - t0)).otherwise(F.lit(0.0))
    if not interpolate:
        share = F.when(share > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    a, c = [F.col("first")[k] for k in POSE], [F.coalesce(F.col("second")[k], F.col("first")[k]) for k in POSE]
    joined = joined.withColumn("_share", share)
    s = F.col("_share")
    place = [x + (y - x) * s for x, y in zip(a[:3], c[:3], strict=True)]
    joined = joined.withColumn("_q", F.array(*V.slerp(V.quaternion(*a[3:]), V.quaternion(*c[3:]), s)))
    turned = V.euler(V.quaternion_matrix([F.col("_q")[i] for i in range(4)]))
    angles = [F.when(s == 0, x).when(s == 1, y).otherwise(z) for x, y, z in zip(a[3:], c[3:], turned, strict=True)]
    return joined.select(*[p[k] for k in points.columns], *[v.alias(f"frame_{k}") for k, v in zip(POSE, [*place, *angles], strict=True)])


def points_in_frames(framed: DataFrame, inverse: bool = False, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Rows with a frame (frame_x, ...) and a point: the point in the frame's parent (in_x, in_y, in_z), or with inverse the parent's point in the frame."""
    p, t, r = [F.col(c) for c in axes], [F.col(f"frame_{c}") for c in POSE[:3]], [F.col(f"frame_{c}") for c in POSE[3:]]
    got = V.to_frame(p, t, r) if inverse else V.from_frame(p, t, r)
    return framed.withColumns({f"in_{c}": v for c, v in zip("xyz", got, strict=True)})


def clocked(df: DataFrame, by: list[str], order: list[str], time: str, period: float) -> DataFrame:
    """Take delays out of times that a steady clock gave: add adjusted.

    A row's deviation grows by what its step exceeds the period, and never falls below 0; adjusted is its time less the deviation. As a
    clamped sum that is the prefix sum less the least one so far.
    """
    laid, parts = chunked(df, by, order)
    step = F.coalesce(F.col(time) - F.lag(time).over(Window.partitionBy(*parts).orderBy(*order)) - period, F.lit(0.0))
    summed = running(own(laid.withColumn("_e", step)), by, order, F.col("_e"), "_s")
    least = running(summed, by, order, F.col("_s"), "_least", "min")
    return least.withColumn("adjusted", F.col(time) - (F.col("_s") - F.least(F.lit(0.0), F.col("_least")))).drop("_e", "_s", "_least", "_chunk")


def periodic(df: DataFrame, by: list[str], order: list[str], time: str, period: float, threshold: float, reset: float | None = None) -> DataFrame:
    """Snap times to a period: add adjusted = last adjusted + period if the step from that lies between period and period + threshold, else the time itself.

    After reset seconds without a fresh start the time itself counts again. Rows with a null time are left out.
    """

    def step(state, rows: pa.Table):
        t = rows.column(time).to_numpy(zero_copy_only=False).astype(float)
        out = np.empty(len(t))
        last, since = state or (None, None)
        for i, v in enumerate(t):
            delta = None if last is None else v - last
            if delta is not None and period < delta < period + threshold and not (reset is not None and v - since > reset):
                last = last + period
            else:
                last = since = v
            out[i] = last
        return (last, since), rows.append_column("adjusted", pa.array(out))

    ready = df.filter(F.col(time).isNotNull())
    return ordered_scan(ready, by, order, step, ready.withColumn("adjusted", F.lit(0.0)).schema)
