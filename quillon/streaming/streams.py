"""Streaming twins of the ordered operators, and event-time windows.

Event time and watermarks are an extension here; with them state stays bounded. State is kept by key, so a stream scales with its keys.
"""

from __future__ import annotations

import time as clock
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """count, sum, min and max of value in tumbling (or sliding) windows of event time; rows later than late behind the newest are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    got = stream.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "count", "sum", "min", "max")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys, count): sessions that end when nothing came for gap."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "count")


def distinct_once(stream: DataFrame, time: str, id: str, late: str) -> DataFrame:
    """Rows whose id hasn't come before within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


def _stateful(stream: DataFrame, key: str, order: str, added: list[tuple[str, str]], state: str, step, late: str | None = None, time: str | None = None) -> DataFrame:
    """step(state or None, row) -> (state, added values) over each key's rows; rows of a micro-batch are taken in order."""
    schema = stream.schema
    for name, kind in added:
        schema = T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(group.get) if group.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out: list[tuple] = []
        for row in rows.itertuples(index=False):
            now, values = step(now, row)
            out.append(values)
        for i, (name, _) in enumerate(added):
            rows[name] = [v[i] for v in out]
        if now is not None:
            group.update(now)
        yield rows

    return stream.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def step_distance(stream: DataFrame, key: str, order: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Add distance from the key's previous row, 0 for its first."""
    names = list(axes)

    def step(state, row):
        at = tuple(float(getattr(row, a)) for a in names)
        d = 0.0 if state is None else sum((p - q) ** 2 for p, q in zip(at, state, strict=True)) ** 0.5
        return at, (d,)

    return _stateful(stream, key, order, [("distance", "double")], ", ".join(f"_{i} double" for i in range(len(names))), step)


def clocked(stream: DataFrame, key: str, time: str, period: float) -> DataFrame:
    """Add adjusted: times with the delays beyond a steady clock's period taken out."""

    def step(state, row):
        t = float(getattr(row, time))
        last, off = state if state is not None else (t - period, 0.0)
        off = max(0.0, off + t - last - period)
        return (t, off), (t - off,)

    return _stateful(stream, key, time, [("adjusted", "double")], "last double, off double", step)


def thinned(stream: DataFrame, key: str, order: str, resolution: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Rows at which the distance along the path since the last such row reaches resolution; a key's first row is one."""
    names = list(axes)

    def step(state, row):
        at = tuple(float(getattr(row, a)) for a in names)
        if state is None:
            return (*at, 0.0), (True,)
        gone = state[-1] + sum((p - q) ** 2 for p, q in zip(at, state[:-1], strict=True)) ** 0.5
        keep = gone >= resolution
        return (*at, 0.0 if keep else gone), (keep,)

    out = _stateful(stream, key, order, [("_keep", "boolean")], ", ".join([*[f"_{i} double" for i in range(len(names))], "gone double"]), step)
    return out.filter("_keep").drop("_keep")


def paced(spark, df: DataFrame, time: str, folder: str, files: int = 10) -> DataFrame:
    """A table as a stream in order of a numeric time: cut at quantiles, each slice written to folder after the one before, one file a trigger."""
    cuts = df.approxQuantile(time, [k / files for k in range(1, files)], 0.01)
    low = None
    for high in [*dict.fromkeys(cuts), None]:
        part = df.filter((F.lit(True) if low is None else F.col(time) > low) & (F.lit(True) if high is None else F.col(time) <= high))
        part.coalesce(1).sortWithinPartitions(time).write.mode("append").parquet(folder)
        clock.sleep(1.1)  # the source takes files by the second of their modification
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
