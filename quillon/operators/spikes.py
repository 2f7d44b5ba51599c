"""Implausible readings: impossible values, stuck values and spikes, each against its own series.

Method: Hampel filter for spikes, run lengths for stuck values, physical bounds for impossible ones. The filter's level is the rolling median of
15 readings, its scatter 1.4826 times the median absolute deviation of 113 readings about their rolling medians; both windows end where the
series does. Impossible and stuck readings say nothing about a series' usual scatter, so the filter leaves them out. Series are cut into blocks of
rows with a halo, so that a hot series is shared out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.partitioning import map_groups, row_blocks

IMPOSSIBLE, STUCK, SPIKE = 1, 2, 4
#: Readings to either side of which the median is the level, and over which the scatter is taken.
LEVEL_HALF, SCATTER_HALF = 7, 56
#: Standard deviation of a normal distribution in median absolute deviations.
SIGMA = 1.4826
#: Rows beside a block: what both windows reach, and as much again for readings that they leave out.
HALO = 4 * (LEVEL_HALF + SCATTER_HALF)


def rolling_median(values: np.ndarray, starts: np.ndarray, half: int, step: int = 20_000) -> np.ndarray:
    """Median of the 2 half + 1 values about each, of fewer at the ends of its group; groups begin at starts."""
    n, width = len(values), 2 * half + 1
    out = np.empty(n)
    if n >= width:
        windows = np.lib.stride_tricks.sliding_window_view(values, width)
        for s in range(0, len(windows), step):
            out[half + s : half + s + len(windows[s : s + step])] = np.partition(windows[s : s + step], half, axis=1)[:, half]
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    at = np.arange(n)
    first, end = np.repeat(starts, sizes), np.repeat(ends, sizes)
    edge = np.flatnonzero((at - first < half) | (end - at <= half))
    for s in range(0, len(edge), step):
        e = edge[s : s + step]
        j = e[:, None] + np.arange(-half, half + 1)
        have = (j >= first[e][:, None]) & (j < end[e][:, None])
        w = np.sort(np.where(have, values[np.clip(j, 0, n - 1)], np.inf), axis=1)
        k, rows = have.sum(axis=1), np.arange(len(e))
        out[e] = (w[rows, (k - 1) // 2] + w[rows, k // 2]) / 2
    return out


def find_spikes(values: np.ndarray, starts: np.ndarray, times: float, longest: int) -> np.ndarray:
    """Positions of spikes in ordered series that begin at starts; values are finite."""
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], n)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    away = np.abs(values - rolling_median(values, starts, LEVEL_HALF))
    limit = times * SIGMA * rolling_median(away, starts, SCATTER_HALF)
    odd = away > limit
    hits = np.flatnonzero(odd)
    if not len(hits):
        return hits
    breaks = np.concatenate([[True], (np.diff(hits) > 1) | (group[hits[1:]] != group[hits[:-1]])])
    firsts, lasts = hits[breaks], np.append(hits[np.flatnonzero(breaks)[1:] - 1], hits[-1])
    plain = np.flatnonzero(~odd)
    out = []
    for a, b in zip(firsts, lasts, strict=True):
        if b - a + 1 > longest:
            continue
        g = group[a]
        k = np.searchsorted(plain, a)
        before, after = plain[max(0, k - LEVEL_HALF) : k], plain[k : k + LEVEL_HALF]
        before, after = before[before >= starts[g]], after[after < ends[g]]
        if len(before) and len(after):
            x = values[a : b + 1]
            if (np.abs(x - np.median(values[before])) > limit[a : b + 1]).all() and (np.abs(x - np.median(values[after])) > limit[a : b + 1]).all():
                out.append(np.arange(a, b + 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def stuck_runs(values: np.ndarray, starts: np.ndarray, shortest: int) -> np.ndarray:
    """Which readings stand in a run of at least so many equal ones."""
    n = len(values)
    new = np.ones(n, dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[starts] = True
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= shortest


def _flag_batch(table: pa.Table, starts: np.ndarray, times: float, longest: int, shortest: int) -> pa.Table:
    values = table.column("value").to_numpy(zero_copy_only=False).astype(float)
    impossible = table.column("impossible").to_numpy(zero_copy_only=False)
    stuck = stuck_runs(values, starts, shortest)
    flags = np.where(impossible, IMPOSSIBLE, 0) | np.where(stuck, STUCK, 0)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    keep = np.flatnonzero(~impossible & ~stuck & np.isfinite(values))
    _, first = np.unique(group[keep], return_index=True)
    flags[keep[find_spikes(values[keep], first, times, longest)]] |= SPIKE
    hit = pa.array((flags > 0) & table.column("_own").to_numpy(zero_copy_only=False))
    return pa.table([table.column("series").filter(hit), table.column("id").filter(hit), pa.array(flags.astype(np.int32)).filter(hit)], names=["series", "id", "flags"])


def flag_readings(readings: DataFrame, chunk: Column, *, times: float = 10.0, longest: int = 3, shortest: int = 10, block: int = 4096) -> DataFrame:
    """Flag readings(series bigint, ord bigint, id bigint, value double, impossible boolean): (series, id, flags), flagged rows only.

    flags is a sum of IMPOSSIBLE (as given), STUCK (in a run of at least shortest equal values) and SPIKE (at most longest readings in a
    row that are more than times the scatter away from their rolling median, and from the medians of the seven other readings before and after; a
    lasting change of level is none, nor is what begins or ends a series). Impossible, infinite and stuck values count for runs, but for no level and no
    scatter; next to a border of blocks, windows see up to HALO rows beyond it. Rows with a null in series, ord, id or value, or NaN,
    must have been left out, and repeated rows dropped; readings at one ord are taken by id. chunk is a coarse part of ord (row_blocks).
    """
    placed = row_blocks(readings, ["series"], [F.col("ord"), F.col("id")], chunk, block, HALO).select("series", "_block", "_row", "_own", "id", "value", "impossible")
    return map_groups(placed, ["series", "_block"], ["_row"], lambda t, s: _flag_batch(t, s, times, longest, shortest), "series long, id long, flags int")
