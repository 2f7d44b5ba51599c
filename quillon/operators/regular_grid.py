"""Irregular readings onto a regular grid, with gaps imputed by iterative singular-spectrum analysis.

Method: readings are averaged by slot before any series is gathered. Series are bucketed: the gaps of a bucket of slots are filled from that bucket and
as many slots on either side, whatever else lies in a task. In these, runs of slots without a long gap are embedded as Hankel trajectories; their leading
singular vectors give a reconstruction that replaces the missing entries, again and again until they settle. Filled slots are
marked, gaps too long to fill are marked and stay empty. Should a series not settle within ROUNDS, its slots are marked unsettled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.partitioning import map_groups

READING, FILLED, GAP, UNSETTLED = "reading", "filled", "gap", "unsettled"
#: Rounds after which a series counts as one that doesn't settle.
ROUNDS = 10_000


def ssa_impute(series: np.ndarray, missing: np.ndarray, lengths: np.ndarray, window: int, rank: int, rounds: int = ROUNDS, tolerance: float = 1e-3) -> np.ndarray:
    """The filled series of ssa_settle."""
    return ssa_settle(series, missing, lengths, window, rank, rounds, tolerance)[0]


def ssa_settle(series: np.ndarray, missing: np.ndarray, lengths: np.ndarray, window: int, rank: int, rounds: int = ROUNDS, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Fill missing entries of many series at once (rows of series, each of its own length, the rest is padding); also whether each series settled.

    Starts from linear interpolation, which is left as it is with rank 0. A series is settled when no filled value moves by more than tolerance times its deviation.
    """
    b, n = series.shape
    out = series.copy()
    at = np.arange(n)
    for i in range(b):
        known = ~missing[i, : lengths[i]]
        if not known.all() and known.any():
            out[i, : lengths[i]] = np.interp(at[: lengths[i]], at[: lengths[i]][known], series[i, : lengths[i]][known])
    valid = at < lengths[:, None]
    count = np.maximum(valid.sum(axis=1), 1)
    mean = np.where(valid, out, 0).sum(axis=1) / count
    out = np.where(valid, out - mean[:, None], 0)
    scale = np.sqrt((out**2).sum(axis=1) / count)
    scale[scale == 0] = 1
    k = n - window + 1
    columns = np.arange(k) < (lengths - window + 1)[:, None]
    shares = np.zeros((b, n))
    for i in range(window):
        shares[:, i : i + k] += columns
    shares = np.maximum(shares, 1)
    active = np.flatnonzero(missing.any(axis=1) & (lengths >= window + 1) & (rank > 0))
    for _ in range(rounds):
        if not len(active):
            break
        y, cols = out[active], columns[active]
        x = np.lib.stride_tricks.sliding_window_view(y, k, axis=1)[:, :window] * cols[:, None, :]
        _, vectors = np.linalg.eigh(x @ x.transpose(0, 2, 1))
        u = vectors[:, :, -rank:]
        low = u @ (u.transpose(0, 2, 1) @ x)
        again = np.zeros_like(y)
        for i in range(window):
            again[:, i : i + k] += low[:, i]
        again /= shares[active]
        new = np.where(missing[active], again, y)
        moved = np.abs(new - y).max(axis=1) / scale[active]
        out[active] = new
        active = active[moved > tolerance]
    settled = np.ones(b, dtype=bool)
    settled[active] = False
    return out + mean[:, None], settled


def _fill_batch(table: pa.Table, starts: np.ndarray, values: list[str], max_fill: int, window: int, rank: int, rounds: int, bucket: int, reach: int) -> pa.Table:
    n = table.num_rows
    source, slot = table.column("source").to_numpy(), table.column("slot").to_numpy()
    own, readings = table.column("own").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
    data = [table.column(v).to_numpy(zero_copy_only=False).astype(float) for v in values]
    last = np.zeros(n, dtype=bool)
    last[starts[1:] - 1] = True
    last[-1] = True
    gap = np.zeros(n, dtype=np.int64)
    gap[:-1] = slot[1:] - slot[:-1] - 1
    gap[last] = 0
    long_gap = gap > max_fill
    segment = np.concatenate([[0], np.cumsum(last | long_gap)[:-1]])
    edges = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [n]])
    fill_here = own & (gap > 0) & ~long_gap
    of = slot // bucket
    at_gap = np.flatnonzero(fill_here)
    at_gap = at_gap[np.concatenate([[True], (np.diff(segment[at_gap]) != 0) | (np.diff(of[at_gap]) != 0)])] if len(at_gap) else at_gap
    wanted = np.arange(len(at_gap))  # the parts of segments in which a bucket's gaps are filled: rows from low to high
    low, high = edges[segment[at_gap]].copy(), edges[segment[at_gap] + 1].copy()
    for i, row in enumerate(at_gap):
        here = slot[low[i] : high[i]]
        a, b = np.searchsorted(here, (of[row] * bucket - reach, (of[row] + 1) * bucket + reach))
        low[i], high[i] = low[i] + a, low[i] + b
    out_source, out_slot, out_mark, out_n = [source[own]], [slot[own]], [np.zeros(int(own.sum()), np.int8)], [readings[own]]
    out_values = [[v[own]] for v in data]

    def emit(rows: np.ndarray, mark: int) -> np.ndarray:
        """Slots of the gaps that follow these rows; also the place of each among the rows."""
        sizes = gap[rows]
        k = np.repeat(np.arange(len(rows)), sizes)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        out_source.append(source[rows][k])
        out_slot.append(slot[rows][k] + step)
        out_mark.append(np.full(len(k), mark, np.int8))
        out_n.append(np.zeros(len(k), np.int64))
        return k

    marked = np.flatnonzero(own & long_gap)
    if len(marked):
        k = emit(marked, 2)
        for o in out_values:
            o.append(np.full(len(k), np.nan))
    lengths = slot[high - 1] - slot[low] + 1
    windows = np.minimum(window, lengths // 2)
    order = np.argsort(lengths, kind="stable")
    batch: list[int] = []

    def flush() -> None:
        if not batch:
            return
        segs = wanted[batch]
        size = lengths[segs]
        width = int(size.max())
        w = windows[batch[0]]
        first = slot[low[segs]]
        rows = np.concatenate([np.arange(low[s], high[s]) for s in segs])
        who = np.repeat(np.arange(len(segs)), high[segs] - low[segs])
        at = slot[rows] - first[who]
        missing = np.arange(width) < size[:, None]
        missing[who, at] = False
        gaps = np.flatnonzero(fill_here[rows] & (of[rows] == of[at_gap[segs]][who]))
        k = emit(rows[gaps], 1)
        g_who = who[gaps][k]
        g_at = out_slot[-1] - first[g_who]
        for o, v in zip(out_values, data, strict=True):
            grid = np.zeros((len(segs), width))
            grid[who, at] = v[rows]
            filled, settled = ssa_settle(grid, missing, size, max(w, 2), min(rank, w - 1) if w > 2 else 0, rounds)
            o.append(filled[g_who, g_at])
            out_mark[-1][~settled[g_who]] = 3

    for i in order:
        if batch and (windows[i] != windows[batch[0]] or lengths[i] > 1.15 * lengths[batch[0]] + 8 or (len(batch) + 1) * lengths[i] > 40_000):
            flush()
            batch = []
        batch.append(int(i))
    flush()
    names = np.array([READING, FILLED, GAP, UNSETTLED], dtype=object)
    columns = [pa.array(np.concatenate(out_source)), pa.array(np.concatenate(out_slot))]
    columns += [pa.array(v, from_pandas=True) for v in (np.concatenate(o) for o in out_values)]
    columns += [pa.array(np.concatenate(out_n)), pa.array(names[np.concatenate(out_mark)], pa.string())]
    return pa.table(columns, names=["source", "slot", *values, "n", "mark"])


def regular_grid(readings: DataFrame, step: int, *, source: str, moment: str, id: str, values: list[str], max_fill: int = 60, window: int = 16, rank: int = 3, bucket: int = 512, chunk: int = 8192, rounds: int = ROUNDS) -> DataFrame:
    """One row for each slot from a source's first reading to its last: (source, slot, values..., n, mark).

    slot is floor(moment / step); a slot with readings has their averages and number and the mark reading. Slots without one have n = 0: in
    gaps of up to max_fill slots they are imputed (mark filled, or unsettled if a value of theirs hasn't settled within rounds), in longer gaps
    their values are null (mark gap). Readings with a null
    source, moment or id are left out, and so are those with a null or NaN value; rows of one id count once. Empty tables give no rows.
    A segment (slots without a longer gap) has a window of at most half its slots and a rank below the window, whatever else is in its batch. Segments of
    fewer than 6 slots, too short for a window of 3, get linear interpolation, marked filled too.
    Gaps that begin in a bucket (slots of one floor(slot / bucket)) are filled from that bucket and bucket or max_fill + 4 slots, whichever is more, on
    either side. chunk, a multiple of bucket, only says how a long source is cut into tasks; results don't depend on it.
    """
    if chunk % bucket:
        raise ValueError("chunk must be a multiple of bucket")
    halo = max(max_fill + 4, window, bucket)
    usable = readings.select(F.col(source).cast("long").alias("source"), F.floor(F.col(moment) / step).alias("slot"), F.col(id).alias("id"), *[F.col(v).cast("double").alias(v) for v in values])
    usable = usable.dropna(subset=["source", "slot", "id", *values])
    once = usable.dropDuplicates(["source", "slot", "id"])
    slots = once.groupBy("source", "slot").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))
    home = F.floor(F.col("slot") / chunk)
    spread = slots.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("slot") - halo) / chunk), F.floor((F.col("slot") + halo) / chunk)))).withColumn("own", F.col("chunk") == home)
    schema = ", ".join(["source long", "slot long", *[f"{v} double" for v in values], "n long", "mark string"])
    filled = map_groups(spread, ["source", "chunk"], ["slot"], lambda t, s: _fill_batch(t, s, values, max_fill, window, rank, rounds, bucket, halo), schema)
    # Gaps that begin in one chunk and end beyond its halo; the chunks' ends are few. The structs hold all columns of slots, so that its shuffle serves both.
    cells = F.struct("slot", *values, "n")
    ends = slots.groupBy("source", home.alias("chunk")).agg(F.min(cells).alias("first"), F.max(cells).alias("last"))
    after = F.lead("first").over(Window.partitionBy("source").orderBy("chunk"))["slot"]
    ends = ends.select("source", "chunk", F.col("last")["slot"].alias("from"), after.alias("to")).filter(F.col("to") >= (F.col("chunk") + 1) * chunk + halo)
    far = ends.select("source", F.explode(F.sequence(F.col("from") + 1, F.col("to") - 1)).alias("slot"), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(0).cast("long").alias("n"), F.lit(GAP).alias("mark"))
    return filled.unionByName(far)
