"""Sums over groups that end in small linear algebra: principal axes, planes, alignment, clusters, spectra, filters.

Groups of any size are reduced to moments by partial aggregation in the JVM; only the moments, one row for each group, go to numpy.
Rows with a null or NaN in a used column are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.near import connected
from quillon.operators.spatial_join import RIGHT, _finite, pairs_within
from quillon.operators.voxels import components
from quillon.plans.partitioning import at_most, cut_lineage, discard, extended, join_groups, lookup_join, map_groups, ordered_scan


def _moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, s0.. (sums) and p0_0.. (sums of products) by group; the products are about the group's means, so that they don't cancel."""
    clean = df.filter(_finite(columns))
    means = clean.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    joined = join_groups(clean, means, keys)
    d = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)]
    products = [F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    return joined.groupBy(*keys, *[f"_m{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"), *products)


def _arrays(t: pa.Table | pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = t.column("n").to_numpy(zero_copy_only=False).astype(float)
    m = np.column_stack([t.column(f"_m{i}").to_numpy(zero_copy_only=False) for i in range(k)]).reshape(len(n), k)
    p = np.zeros((len(n), k, k))
    for i in range(k):
        for j in range(i, k):
            p[:, i, j] = p[:, j, i] = t.column(f"p{i}_{j}").to_numpy(zero_copy_only=False)
    return n, m, p


def _signed(vectors: np.ndarray) -> np.ndarray:
    """The sign of each vector (last axis) such that its largest entry is positive."""
    at = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=-1, keepdims=True) - 1e-9, axis=-1)
    s = np.sign(np.take_along_axis(vectors, at[..., None], axis=-1))
    return vectors * np.where(s == 0, 1, s)


def principal_axes(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centred: bool = False, normalize: bool = False) -> DataFrame:
    """(keys, rank, value, vector): eigenvalues, largest first, and unit vectors of X'X / (n - 1), about 0 or with centred about the mean.

    normalize: values as shares of their sum. Signs: the largest entry is positive. Groups of fewer than two rows give nothing.
    """
    k = len(columns)
    kept = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, p = _arrays(b, k)
            if not centred:
                p = p + n[:, None, None] * m[:, :, None] * m[:, None, :]
            ok = np.flatnonzero(n > 1)
            values, vectors = np.linalg.eigh(p[ok] / (n[ok] - 1)[:, None, None])
            values, vectors = values[:, ::-1], _signed(vectors.transpose(0, 2, 1)[:, ::-1])
            if normalize:
                values = values / np.maximum(values.sum(axis=1, keepdims=True), 1e-300)
            who = pa.array(np.repeat(ok, k))
            cols = [b.column(c).take(who) for c in keys]
            cols += [pa.array(np.tile(np.arange(1, k + 1), len(ok)).astype(np.int32)), pa.array(values.ravel()), pa.array(list(vectors.reshape(-1, k)), pa.list_(pa.float64()))]
            yield pa.record_batch(cols, [*keys, "rank", "value", "vector"])

    return _moments(df, keys, columns).mapInArrow(run, extended(kept, "rank int, value double, vector array<double>"))


def fit_plane(df: DataFrame, columns: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean, normal, rms): the plane of least squares; the normal's largest entry is positive. Fewer than three rows give nothing."""
    kept = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, p = _arrays(b, len(columns))
            ok = np.flatnonzero(n > 2)
            values, vectors = np.linalg.eigh(p[ok])
            who = pa.array(ok)
            rms = np.sqrt(np.maximum(values[:, 0], 0) / n[ok])
            yield pa.record_batch([*[b.column(c).take(who) for c in keys], pa.array(list(m[ok]), pa.list_(pa.float64())), pa.array(list(_signed(vectors[:, :, 0])), pa.list_(pa.float64())), pa.array(rms)], [*keys, "mean", "normal", "rms"])

    return _moments(df, keys, columns).mapInArrow(run, extended(kept, "mean array<double>, normal array<double>, rms double"))


def align(df: DataFrame, first: Sequence[str], second: Sequence[str], keys: Sequence[str] = (), scaled: bool = False) -> DataFrame:
    """(keys, rotation (9 by rows), translation, scale, error): second = scale * R first + t by least squares, without reflection; error is the rms left.

    Groups of fewer than three pairs give nothing.
    """
    kept = df.select(*keys).schema
    names = [*first, *second]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, p = _arrays(b, 6)
            ok = np.flatnonzero(n > 2)
            a, c = m[ok, :3], m[ok, 3:]
            cov = p[ok, 3:, :3]
            u, s, vt = np.linalg.svd(cov)
            d = np.ones((len(ok), 3))
            d[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            r = (u * d[:, None, :]) @ vt
            spread, spread2 = np.trace(p[ok, :3, :3], axis1=1, axis2=2), np.trace(p[ok, 3:, 3:], axis1=1, axis2=2)
            fit = (s * d).sum(axis=1)
            k = np.where(spread > 0, fit / np.where(spread > 0, spread, 1), 1.0) if scaled else np.ones(len(ok))
            t = c - k[:, None] * np.einsum("nij,nj->ni", r, a)
            error = np.sqrt(np.maximum(0, spread2 - 2 * k * fit + k * k * spread) / n[ok])
            who = pa.array(ok)
            lists = lambda v: pa.array(list(v), pa.list_(pa.float64()))
            yield pa.record_batch([*[b.column(q).take(who) for q in keys], lists(r.reshape(-1, 9)), lists(t), pa.array(k), pa.array(error)], [*keys, "rotation", "translation", "scale", "error"])

    return _moments(df, keys, names).mapInArrow(run, extended(kept, "rotation array<double>, translation array<double>, scale double, error double"))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the least) of each column of x, and the squared distance to it."""
    who, best = np.zeros(x.shape[1], dtype=np.int64), np.full(x.shape[1], np.inf)
    for k, c in enumerate(centroids):
        d = sum((v - m) ** 2 for v, m in zip(x, c, strict=True))
        closer = d < best
        who[closer], best[closer] = k, d[closer]
    return who, best


def _lloyd(x: np.ndarray, centroids: np.ndarray, max_rounds: int, tolerance: float) -> np.ndarray:
    k = len(centroids)
    for _ in range(max_rounds):
        who, _ = _nearest(x, centroids)
        sizes = np.maximum(np.bincount(who, minlength=k), 1)
        moved = np.column_stack([np.bincount(who, weights=v, minlength=k) / sizes for v in x])
        shift = ((moved - centroids) ** 2).sum()
        centroids = moved
        if shift < tolerance**2:
            break
    return centroids


def random_starts(df: DataFrame, columns: Sequence[str], clusters: int, keys: Sequence[str] = (), runs: int = 10, seed: int = 0) -> DataFrame:
    """(keys, run, cluster, columns): rows of each group drawn by a hash with the seed, as initial for k_means; a group of fewer rows repeats them."""
    wanted = runs * clusters
    by = [*keys] or [F.lit(1)]
    rows = df.filter(_finite(columns)).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *columns), *columns)
    drawn = rows.withColumn("_at", F.row_number().over(order) - 1).filter(F.col("_at") < wanted)
    drawn = drawn.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    each = drawn.withColumn("_at", F.explode(F.sequence("_at", F.lit(wanted - 1), F.col("_n").cast("int"))))
    return each.select(*keys, F.floor(F.col("_at") / clusters).cast("int").alias("run"), (F.col("_at") % clusters).alias("cluster"), *columns)


def k_means(df: DataFrame, columns: Sequence[str], initial: DataFrame, keys: Sequence[str] = (), max_rounds: int = 300, tolerance: float = 1e-4, local_rows: int = 1_000_000) -> DataFrame:
    """Lloyd's algorithm: each row with cluster, its nearest centroid's number; from initial(keys, cluster, columns).

    A group stops when its centroids' squared moves sum to less than tolerance^2, or after max_rounds. An empty cluster's centroid goes to 0. Ties: the
    least number. Rows with a null or NaN have a null cluster. If initial has a column run (random_starts), each run of a group starts from its own
    centroids, and the one with the least sum of distances (not squared) is kept; ties: the least run. Groups of up to local_rows rows are settled in
    one task each, longer ones by one aggregation a round over all tasks.
    """
    if not keys:
        whole = [d.withColumn("_one", F.lit(1)) for d in (df, initial)]
        return k_means(whole[0], columns, whole[1], ["_one"], max_rounds, tolerance, local_rows).drop("_one")
    keys, runs = list(keys), "run" in initial.columns
    numbers = lambda d: [F.col(c).cast("double").alias(c) for c in columns]
    run = F.col("run").cast("int") if runs else F.lit(0)
    starts = cut_lineage(initial.select(*keys, run.alias("_run"), F.col("cluster").cast("int").alias("cluster"), *numbers(initial)))
    usable = df.filter(_finite(columns))
    rows = usable.select(*keys, *numbers(usable))
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > local_rows).select(*keys))
    any_large = not large.isEmpty()
    # The groups beyond local_rows are few for any size of table that has room for their rows.
    small = rows.join(F.broadcast(large), keys, "left_anti") if any_large else rows
    first = starts.join(F.broadcast(large), keys, "left_anti") if any_large else starts
    both = small.select(*keys, F.lit(None).cast("int").alias("_run"), F.lit(None).cast("int").alias("cluster"), *columns).unionByName(first)

    def settle(table: pa.Table, begins: np.ndarray) -> pa.Table | None:
        x = np.array([table.column(c).to_numpy() for c in columns])
        free = table.column("_run").is_null().to_numpy()
        number, of = table.column("cluster").fill_null(-1).to_numpy(), table.column("_run").fill_null(-1).to_numpy()
        at, names, centroids = [], [], []
        for s, e in zip(begins, [*begins[1:], table.num_rows], strict=True):
            data, rest = x[:, s:e][:, free[s:e]], np.flatnonzero(~free[s:e]) + s
            if not len(rest) or not data.shape[1]:
                continue
            best = None
            for r in np.unique(of[rest]):
                mine = rest[of[rest] == r]
                c = _lloyd(data, x[:, mine].T, max_rounds, tolerance)
                score = np.sqrt(_nearest(data, c)[1]).sum() if runs else 0.0
                if best is None or score < best[0]:
                    best = (score, number[mine], c)
            at += [s] * len(best[1])
            names.append(best[1])
            centroids.append(best[2])
        if not at:
            return None
        out = np.concatenate(centroids)
        return pa.table([*[table.column(k).take(pa.array(at)) for k in keys], pa.array(np.concatenate(names), pa.int32()), *[pa.array(v) for v in out.T]], [*keys, "cluster", *columns])

    # Rows before starts (nulls first), starts by number.
    schema = extended(starts.select(*keys).schema, ", ".join(["cluster int", *[f"`{c}` double" for c in columns]]))
    centroids = map_groups(both, keys, ["_run", "cluster"], settle, schema)
    if any_large:
        far = _rounds(rows.join(F.broadcast(large), keys, "left_semi"), starts.join(F.broadcast(large), keys, "left_semi"), columns, keys, max_rounds, tolerance, runs)
        centroids = centroids.unionByName(far)
    out = _assign(usable, cut_lineage(centroids), columns, keys)
    rest = df.filter(~F.coalesce(_finite(columns), F.lit(False))).withColumn("cluster", F.lit(None).cast("int"))
    return out.unionByName(rest)


def _rounds(rows: DataFrame, starts: DataFrame, columns: Sequence[str], keys: list[str], max_rounds: int, tolerance: float, runs: bool) -> DataFrame:
    """k_means for groups that no task should hold: (keys, cluster, columns). A round places the rows of the groups that haven't settled."""
    own = [*keys, "_run"]
    rows = cut_lineage(rows.join(F.broadcast(starts.select(*own).distinct()), keys))
    state = cut_lineage(starts.withColumn("_done", F.lit(False)))
    for _ in range(max_rounds):
        active = state.filter(~F.col("_done"))
        sums = _assign(rows, active, columns, own).groupBy(*own, "cluster").agg(*[F.avg(c).alias(f"_a{i}") for i, c in enumerate(columns)])
        shift = sum(((F.coalesce(f"_a{i}", F.lit(0.0)) - F.col(c)) ** 2 for i, c in enumerate(columns)), F.lit(0.0))
        moved = active.join(sums, [*own, "cluster"], "left").withColumn("_done", F.sum(shift).over(Window.partitionBy(*own)) < tolerance**2)
        moved = moved.select(*own, "cluster", *[F.coalesce(f"_a{i}", F.lit(0.0)).alias(c) for i, c in enumerate(columns)], "_done")
        old, state = state, cut_lineage(moved.unionByName(state.filter("_done")))
        discard(old)
        if state.filter(~F.col("_done")).isEmpty():
            break
    if runs:
        placed = _assign(rows, state, columns, own).join(F.broadcast(state.select(*own, "cluster", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])), [*own, "cluster"])
        d2 = sum(((F.col(c) - F.col(f"_c{i}")) ** 2 for i, c in enumerate(columns)), F.lit(0.0))
        scores = placed.groupBy(*own).agg(F.sum(F.sqrt(d2)).alias("_score"))
        state = state.join(scores.groupBy(*keys).agg(F.min(F.struct("_score", "_run"))["_run"].alias("_run")), own)
    return state.select(*keys, "cluster", *columns)


def _assign(df: DataFrame, centroids: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    packed = centroids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", F.array(*columns).alias("at")))).alias("_c"))
    joined = join_groups(df, F.broadcast(packed) if at_most(packed, 10_000) else packed, keys)
    here = F.array(*[F.col(c).cast("double") for c in columns])
    d2 = lambda c: F.aggregate(F.zip_with(here, c["at"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("_c", lambda c: F.struct(d2(c).alias("d"), c["cluster"].alias("k"))))
    return joined.withColumn("cluster", best["k"]).drop("_c")


def spectrum(df: DataFrame, value: str, row: str, keys: Sequence[str] = (), bin_size: int = 256, overlap: float = 0.0, output: str = "magnitude", logarithm: bool = True, window: bool = True) -> DataFrame:
    """(keys, bin, spectrum): FFT of each bin of bin_size values; row numbers the values of a group from 0.

    Bins begin every bin_size (1 - overlap) values; the last, if shorter, is padded with 0. output: magnitude, real (half of bin_size numbers) or split (reals,
    then imaginaries). window: a Hann window first. logarithm: log10 of magnitude or real, 0 for what isn't positive.
    """
    stride = max(1, round(bin_size * (1 - overlap)))
    kept = df.select(*keys).schema
    first = F.greatest(F.lit(0), F.ceil((F.col(row) - bin_size + 1) / stride))
    bins = df.dropna(subset=[value, row]).withColumn("bin", F.explode(F.sequence(first.cast("long"), F.floor(F.col(row) / stride).cast("long"))))
    packed = bins.groupBy(*keys, "bin").agg(F.collect_list(F.struct((F.col(row) - F.col("bin") * stride).cast("int").alias("i"), F.col(value).cast("double").alias("v"))).alias("_v"))
    shape = np.hanning(bin_size) if window else np.ones(bin_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, bin_size))
            v = b.column("_v")
            who = np.repeat(np.arange(b.num_rows), np.diff(v.offsets.to_numpy()))
            x[who, v.flatten().field("i").to_numpy()] = v.flatten().field("v").to_numpy()
            f = np.fft.rfft(x * shape, axis=1)[:, : bin_size // 2]
            if output == "split":
                out = np.concatenate([f.real, f.imag], axis=1)
            else:
                out = np.abs(f) if output == "magnitude" else f.real
                if logarithm:
                    out = np.where(out > 0, np.log10(np.where(out > 0, out, 1)), 0)
            yield pa.record_batch([*[b.column(k) for k in keys], b.column("bin"), pa.array(list(out), pa.list_(pa.float64()))], [*keys, "bin", "spectrum"])

    return packed.mapInArrow(run, extended(kept, "bin bigint, spectrum array<double>"))


def array_split(df: DataFrame, column: str, size: int) -> DataFrame:
    """An array column as arrays of size entries; the last may be shorter; an empty or null array stays one row."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(column) / size).cast("int") - 1))
    parts = F.transform(starts, lambda i: F.slice(F.col(column), i * size + 1, F.lit(size)))
    return df.withColumn("part", F.explode(F.when(F.size(column) > 0, starts).otherwise(F.array(F.lit(0))))).withColumn(column, F.when(F.size(column) > 0, F.element_at(parts, F.col("part") + 1)).otherwise(F.col(column)))


def array_transpose(df: DataFrame, column: str, rows: int, cols: int) -> DataFrame:
    """An array of rows x cols entries by rows, transposed; null if it has another size."""
    at = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    moved = F.transform(at, lambda i: F.element_at(F.col(column), ((i % rows) * cols + F.floor(i / rows)).cast("int") + 1))
    return df.withColumn(column, F.when(F.size(column) == rows * cols, moved))


def array_operate(df: DataFrame, column: str, shape: Sequence[int], function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """An array column of rows of this shape (last index fastest) as function(arrays of shape n x shape) -> n x anything, flattened again; null if it has another size or a null in it.

    function gets many rows at a time, so that a whole numpy operation costs one call a batch.
    """
    size, at = math.prod(shape), df.columns.index(column)
    ready = df.withColumn(column, F.when((F.size(column) == size) & ~F.exists(column, lambda v: v.isNull()), F.col(column).cast("array<double>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(at)
            have = v.is_valid().to_numpy(zero_copy_only=False)
            out: list = [None] * len(v)
            if have.any():
                x = v.drop_null().flatten().to_numpy().reshape(-1, *shape)
                for i, row in zip(np.flatnonzero(have), np.asarray(function(x), dtype=float).reshape(len(x), -1), strict=True):
                    out[i] = row
            yield b.set_column(at, column, pa.array(out, pa.list_(pa.float64())))

    return ready.mapInArrow(run, ready.schema)


def array_reduce(df: DataFrame, column: str, how: str) -> DataFrame:
    """Add reduced: sum, mean, min, max or norm of an array column; null for an empty one."""
    total = lambda f: F.aggregate(F.transform(F.col(column), f), F.lit(0.0), lambda s, v: s + v)
    n = F.size(column)
    out = {"sum": total(lambda v: v.cast("double")), "mean": total(lambda v: v.cast("double")) / n, "min": F.array_min(column).cast("double"), "max": F.array_max(column).cast("double"), "norm": F.sqrt(total(lambda v: v.cast("double") * v.cast("double")))}[how]
    return df.withColumn("reduced", F.when(n > 0, out))


# --- point clouds ------------------------------------------------------------------------------------------------------


def normals(points: DataFrame, radius: float, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), min_neighbours: int = 3) -> DataFrame:
    """(id, normal_x, normal_y, normal_z, curvature): the plane of each point's neighbours within the radius, itself included."""
    slim = points.select(id, *keys, *axes)
    pairs = pairs_within(slim, slim, radius, axes, keys=keys)
    near = pairs.select(id, *[(F.col(RIGHT + a) - F.col(a)).alias(a) for a in axes])
    m = near.groupBy(id).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"_m{i}") for i, a in enumerate(axes)], *[F.sum(F.col(axes[i]) * F.col(axes[j])).alias(f"p{i}_{j}") for i in range(3) for j in range(i, 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, mean, p = _arrays(b, 3)
            ok = np.flatnonzero(n >= min_neighbours)
            values, vectors = np.linalg.eigh(p[ok] - n[ok, None, None] * mean[ok, :, None] * mean[ok, None, :])
            v = _signed(vectors[:, :, 0])
            total = np.maximum(values.sum(axis=1), 1e-300)
            yield pa.record_batch([b.column(id).take(pa.array(ok)), *[pa.array(v[:, i]) for i in range(3)], pa.array(np.maximum(values[:, 0], 0) / total)], [id, "normal_x", "normal_y", "normal_z", "curvature"])

    schema = points.select(id).schema
    for c in ("normal_x", "normal_y", "normal_z", "curvature"):
        schema = schema.add(c, "double")
    return m.mapInArrow(run, schema)


def grow_regions(points: DataFrame, normals_: DataFrame | None, radius: float, angle: float, max_curvature: float = 1.0, min_size: int = 1, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(id, component): points within the radius whose normals differ by less than angle (either sign) and whose curvature is at most max_curvature, connected.

    normals_ null: those of normals() with the same radius; they are then found in the leaves of k-d splits together with the regions (ids and key are integers,
    ids are unique, repeated rows count once), and neither pairs nor normals are written.
    """
    if normals_ is None:
        found = connected(points, radius, id=id, group=keys[0] if keys else None, axes=tuple(axes), angle=angle, max_curvature=max_curvature)
        if min_size > 1:
            found = lookup_join(found, found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).select("component"), "component", "node")
        return found.select(F.col("node").alias(id), "component")
    flat = cut_lineage(points.select(id, *keys, *axes).join(normals_.filter(F.col("curvature") <= max_curvature), id))
    slim = flat.select(id, *keys, *axes, "normal_x", "normal_y", "normal_z")
    pairs = pairs_within(slim, slim, radius, axes, keys=keys).filter(F.col(id) < F.col(RIGHT + id))
    alike = F.abs(sum((F.col(f"normal_{a}") * F.col(f"{RIGHT}normal_{a}") for a in "xyz"), F.lit(0.0))) > math.cos(angle)
    found = components(flat.select(F.col(id).alias("node")), pairs.filter(alike).select(F.col(id).alias("a"), F.col(RIGHT + id).alias("b")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    return found.join(sizes, "component", "left_semi").select(F.col("node").alias(id), "component")


def far_from_neighbours(points: DataFrame, radius: float, k: int, deviations: float, id: str = "id", keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), over: Sequence[str] | None = None) -> DataFrame:
    """Add mean_distance to the k nearest others within the radius and outlier: above mean + deviations * standard deviation of all points with equal over (default: keys), or without any other."""
    from quillon.operators.spatial_join import nearest_ids

    slim = points.select(id, *keys, *axes)
    near = nearest_ids(slim, slim, radius, id, id, k=max(2, k), axes=axes, keys=keys, ids=("differ", id)).filter(F.col("rank") <= k)
    means = near.groupBy(id).agg(F.avg("distance").alias("mean_distance"))
    joined = points.join(means.withColumnRenamed(id, "_id"), F.col(id) == F.col("_id"), "left").drop("_id")
    over = list(keys if over is None else over)
    stats = joined.groupBy(*over).agg((F.avg("mean_distance") + deviations * F.coalesce(F.stddev_samp("mean_distance"), F.lit(0.0))).alias("_limit"))
    out = join_groups(joined, stats, over)
    return out.withColumn("outlier", F.coalesce(F.col("mean_distance") > F.col("_limit"), F.lit(True))).drop("_limit")


def iterative_closest_points(first: DataFrame, second: DataFrame, radius: float, rounds: int = 20, tolerance: float = 1e-6, id: str = "id", axes: Sequence[str] = ("x", "y", "z")) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and rms by which first comes to lie on second: nearest points within the radius are aligned until that changes little."""
    from quillon.operators.spatial_join import nearest_within

    rotation, translation, error = np.eye(3), np.zeros(3), math.inf
    for _ in range(rounds):
        x = [F.col(a) for a in axes]
        moved = first.select(id, *[(sum((F.lit(float(rotation[i, j])) * x[j] for j in range(3)), F.lit(0.0)) + float(translation[i])).alias(a) for i, a in enumerate(axes)])
        near = nearest_within(moved, second.select(id, *axes), radius, id, id, axes=axes)
        got = align(near, list(axes), [RIGHT + a for a in axes]).collect()  # one row
        if not got:
            break
        r, t = np.array(got[0]["rotation"]).reshape(3, 3), np.array(got[0]["translation"])
        rotation, translation = r @ rotation, r @ translation + t
        if abs(error - got[0]["error"]) < tolerance:
            error = got[0]["error"]
            break
        error = got[0]["error"]
    return rotation, translation, error


# --- filters ---------------------------------------------------------------------------------------------------------------


def kalman(df: DataFrame, by: Sequence[str], order: str, value: str, process: float, measurement: float) -> DataFrame:
    """Add filtered and variance: a one-dimensional Kalman filter of a random walk, whose variance grows by process for each unit of order.

    A null value is only predicted. The first value of a group is taken as it is, with variance measurement.
    """

    def step(state, rows: pa.Table):
        t = rows.column(order).to_numpy(zero_copy_only=False).astype(float)
        z = rows.column(value).to_numpy(zero_copy_only=False).astype(float)
        out = np.full((len(t), 2), np.nan)
        for i in range(len(t)):
            if state is None:
                if np.isnan(z[i]):
                    continue
                state = (t[i], z[i], measurement)
            else:
                last, x, p = state
                p += process * (t[i] - last)
                if not np.isnan(z[i]):
                    gain = p / (p + measurement)
                    x, p = x + gain * (z[i] - x), (1 - gain) * p
                state = (t[i], x, p)
            out[i] = state[1:]
        return state, rows.append_column("filtered", pa.array(out[:, 0], from_pandas=True)).append_column("variance", pa.array(out[:, 1], from_pandas=True))

    ready = df.filter(F.col(order).isNotNull())
    return ordered_scan(ready, list(by), [order], step, ready.withColumns({"filtered": F.lit(0.0), "variance": F.lit(0.0)}).schema)


def _halo(density: float, signal: float, noise: float, error: float) -> float:
    """Kernel lengths beyond which a training row counts for less than error in a prediction, with up to density rows a length.

    The weights of a Gaussian process on dense rows fall as exp(-c d / length), where c is the imaginary part of the pole of its equivalent kernel.
    """
    level = np.log(max(density, 1.0) * np.sqrt(2 * np.pi) * signal**2 / noise**2)
    return float(np.log(1 / error) / np.sqrt(2 * level + 2j * np.pi).imag) + 9


def gaussian_process(train: DataFrame, query: DataFrame, keys: Sequence[str], x: str, y: str, length: float, signal: float, noise: float, max_train: int = 2000, error: float = 1e-9) -> DataFrame:
    """(keys, x, mean, variance): Gaussian-process regression by group with a squared-exponential covariance.

    A group of up to max_train training rows is solved together. A longer one is cut into blocks of x with a halo on either side, so wide that the rows
    left out have weights of about error at most relative to those at hand (_halo: by the densest kernel length of any such group, for rows as dense as
    that all along; sparser rows weigh less far off). A block of more than max_train rows is reduced to moments of Fourier features, whose covariance differs by less than 1e-15 signal^2; a
    block's rows are held in one task. Longer groups need a noise above 0. Queries of a group without
    training rows have mean 0 and variance signal^2. Rows with a null are left out.
    """
    if not keys:
        return gaussian_process(train.withColumn("_one", F.lit(1)), query.withColumn("_one", F.lit(1)), ["_one"], x, y, length, signal, noise, max_train, error).drop("_one")
    keys = list(keys)
    ts = train.dropna(subset=[*keys, x, y]).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    qs = query.dropna(subset=[*keys, x]).select(*keys, F.col(x).cast("double").alias(x))
    schema = extended(query.select(*keys).schema, f"`{x}` double, mean double, variance double")
    large = cut_lineage(ts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_train).select(*keys))
    any_large, few = not large.isEmpty(), at_most(large, 100_000)
    pick = lambda d, how: d.join(F.broadcast(large) if few else large, keys, how) if any_large else d
    xs = pick(ts, "left_anti").groupBy(*keys).agg(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("_t"))
    joined = pick(qs, "left_anti").groupBy(*keys, F.pmod(F.xxhash64(x), F.lit(64)).alias("_salt")).agg(F.collect_list(x).alias("_q")).join(xs, keys, "left")

    def cover(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return signal**2 * np.exp(-0.5 * ((a[:, None] - b[None, :]) / length) ** 2)

    def together(tx: np.ndarray, ty: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chol = np.linalg.cholesky(cover(tx, tx) + noise**2 * np.eye(len(tx)))
        half = np.linalg.solve(chol, cover(q, tx).T)
        return half.T @ np.linalg.solve(chol, ty), signal**2 - (half**2).sum(axis=0)

    def by_moments(tx: np.ndarray, ty: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = min(tx.min(), q.min()), max(tx.max(), q.max())
        period = (high - low) / length + 9
        w = 2 * np.pi / period * np.arange(int(np.ceil(8.5 * period / (2 * np.pi))) + 1)
        size = signal * np.sqrt(np.sqrt(2 * np.pi) / period * np.exp(-0.5 * w**2) * np.where(w > 0, 2, 1))

        def features(v: np.ndarray) -> np.ndarray:
            angle = (v[:, None] - low) / length * w
            return np.hstack([np.cos(angle) * size, np.sin(angle[:, 1:]) * size[1:]])

        products, sums = noise**2 * np.eye(2 * len(w) - 1), np.zeros(2 * len(w) - 1)
        for i in range(0, len(tx), 4096):
            f = features(tx[i : i + 4096])
            products += f.T @ f
            sums += f.T @ ty[i : i + 4096]
        chol = np.linalg.cholesky(products)
        weights = np.linalg.solve(chol.T, np.linalg.solve(chol, sums))
        mean, var = np.empty(len(q)), np.empty(len(q))
        for i in range(0, len(q), 4096):
            f = features(q[i : i + 4096])
            mean[i : i + 4096] = f @ weights
            var[i : i + 4096] = noise**2 * (np.linalg.solve(chol, f.T) ** 2).sum(axis=0)
        return mean, var

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q = np.array(b.column("_q")[i].as_py(), dtype=float)
                t = b.column("_t")[i].as_py() or []
                mean, var = np.zeros(len(q)), np.full(len(q), signal**2)
                if t:
                    mean, var = together(np.array([v["x"] for v in t]), np.array([v["y"] for v in t]), q)
                who = pa.array(np.full(len(q), i))
                yield pa.record_batch([*[b.column(c).take(who) for c in keys], pa.array(q), pa.array(mean), pa.array(var)], [*keys, x, "mean", "variance"])

    out = joined.mapInArrow(run, schema)
    if not any_large:
        return out
    if not noise > 0:
        raise ValueError(f"groups of more than {max_train} training rows need a noise above 0")
    long_ts = pick(ts, "left_semi")
    density = long_ts.groupBy(*keys, F.floor(F.col("_x") / length).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    halo = _halo(2.0 * density, signal, noise, error) * length
    block = 2 * halo
    copies = F.sequence(F.floor((F.col("_x") - halo) / block), F.floor((F.col("_x") + halo) / block))
    asked = pick(qs, "left_semi").select(*keys, F.floor(F.col(x) / block).alias("_block"), F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"))
    both = long_ts.select(*keys, F.explode(copies).alias("_block"), "_x", "_y").unionByName(asked)

    def blocks(table: pa.Table, begins: np.ndarray) -> pa.Table | None:
        at, ask, values = table.column("_x").to_numpy(), table.column("_y").is_null().to_numpy(), table.column("_y").to_numpy()
        mean, var = np.zeros(len(at)), np.full(len(at), signal**2)
        for s, e in zip(begins, [*begins[1:], len(at)], strict=True):
            q = np.flatnonzero(ask[s:e]) + s
            t = np.flatnonzero(~ask[s:e]) + s
            if len(q) and len(t):
                mean[q], var[q] = (together if len(t) <= max_train else by_moments)(at[t], values[t], at[q])
        kept = table.filter(pa.array(ask))
        return pa.table([*[kept.column(c) for c in keys], kept.column("_x"), pa.array(mean[ask]), pa.array(var[ask])], [*keys, x, "mean", "variance"])

    return out.unionByName(map_groups(both, [*keys, "_block"], [], blocks, schema))
