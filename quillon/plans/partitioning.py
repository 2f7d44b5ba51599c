"""How rows are laid out over tasks: size-checked joins, salted joins, complete groups in batches, row blocks with halos.

Every helper here holds for a key that owns a third of all rows: hot keys are salted or cut into blocks, and nothing
whose size follows the data is sent to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a side of a join is broadcast (a row of three longs is about 24 bytes, the hashed relation about thrice that).
BROADCAST_ROWS = 1_000_000
#: Copies of the small side in a salted join: a key with a third of all rows is spread over so many tasks.
SALTS = 16


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; never reads more of it than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join with a table that has one row for each key.

    right is broadcast if it is counted and has at most broadcast_rows rows. Beyond that both sides are shuffled by the key
    and a salt: left rows take theirs from salt_by, right rows are copied to each salt, so that a hot key is shared out.
    Null keys match nothing (they stay, with nulls, for how="left"). Beyond broadcast_rows nothing is broadcast, however small right's files
    are: Spark would go by their compressed size, which says nothing of the copies.
    """
    if at_most(right.select(key), broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group begins, in rows sorted by keys; nulls and NaNs are equal to themselves."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(col.type):
            differ &= ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
        nulls = col.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table | None], rows: int) -> Iterator[pa.RecordBatch]:
    """Hand fn tables of whole groups (of about so many rows) with the positions at which groups begin."""
    held: list[pa.RecordBatch] = []
    n = 0

    def ready(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if table.num_rows and (out := fn(table, starts)) is not None and out.num_rows:
            yield from out.to_batches(max_chunksize=20_000)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _changes(table, keys)
            cut = int(starts[-1])
            if cut:
                yield from ready(table.slice(0, cut), starts[:-1])
                held, n = table.slice(cut).to_batches(), n - cut
            else:
                rows *= 2  # one group is longer than expected: look again when twice as much is there
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from ready(table, _changes(table, keys))


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, rows: int = 50_000, by: list[str] | None = None) -> DataFrame:
    """One shuffle by the keys, rows sorted within, and fn called with many whole groups at a time.

    For very many small groups: a call of applyInArrow for each would cost more than its work. A group must fit in a
    task, so callers bound it (row_blocks, time chunks). by: the keys to shuffle by, if not all of them.
    """
    laid = df.repartition(*[F.col(k) for k in by or keys]).sortWithinPartitions(*keys, *order)
    return laid.mapInArrow(lambda it: complete_groups(it, keys, fn, rows), schema)


def row_blocks(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, block: int, halo: int) -> DataFrame:
    """Cut each ordered series into blocks of exactly so many rows, with halo rows of the neighbours on either side.

    Adds _block (bigint), _own (boolean: false for halo copies) and _row (index in the series). chunk must grow with the
    order (a coarse part of it); it splits hot series, so that no task sorts a whole one. Rows of one chunk are ranked in
    their chunk, and the chunks' counts, which are few, give the offsets.
    """
    marked = df.withColumn("_chunk", chunk)
    laid = marked.repartition(*[F.col(k) for k in keys], F.col("_chunk"))
    ranked = laid.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1)
    counts = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = ranked.join(offsets, [*keys, "_chunk"]).withColumn("_row", F.col("_row") + F.col("_offset")).drop("_offset", "_chunk")
    home, within = F.floor(F.col("_row") / block), F.pmod(F.col("_row"), F.lit(block))
    copies = F.array_compact(F.array(home, F.when((within < halo) & (home > 0), home - 1), F.when(within >= block - halo, home + 1)))
    return placed.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == home)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, one is made in local mode, and a cluster is refused."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        have = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(have)
    return have


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back: the copy outlives any executor.

    A table rather than checkpoint(): its sizes are known, while a checkpoint keeps the estimates of the plan it cut, which multiply from
    round to round of an iteration. Each copy has a folder of its own; an iteration discards those it has replaced, the last one lies there until
    the shared folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy._quillon_path = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Delete tables of cut_lineage that nothing reads any more."""
    for copy in copies:
        if path := getattr(copy, "_quillon_path", None):
            spark = copy.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            copy._quillon_path = None


#: Links up to which one task joins them to parts; it holds two or three lists of so many nodes.
FOREST_LINKS = 4_000_000


def join_parts(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, by which each node has the least node of its part, after the links (a, b) are joined."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each linked node of a task but the least of its part, with that; no more than that is held."""
    at, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def settled() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(v) for v in zip((at, root), *held, strict=True))
        names, k = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = join_parts(np.arange(len(names)), k[: len(a)], k[len(a) :])
        keep = label != np.arange(len(names))
        return names[keep], names[label[keep]]

    for b in batches:
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
        n += b.num_rows
        if n > max(500_000, len(at)):
            (at, root), held, n = settled(), [], 0
    at, root = settled()
    for s in range(0, len(at), 100_000):
        yield pa.record_batch([pa.array(at[s : s + 100_000]), pa.array(root[s : s + 100_000])], ["node", "component"])


def linked(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, component): each node with a link, by the least node of its connected part; nodes are integers, and links to null count for nothing.

    Tasks join what they hold, so that a task keeps a link for each node at most. What is left is joined in one task, or if it has more than
    most (FOREST_LINKS) links, in rounds.
    """
    whole = links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("component")).filter("node is not null and component is not null")
    forest = cut_lineage(whole.mapInArrow(_forest, "node long, component long"))
    if at_most(forest, FOREST_LINKS if most is None else most):
        parts = cut_lineage(forest.repartition(1).mapInArrow(_forest, "node long, component long"))
        discard(forest)
    else:
        parts = label_rounds(forest.select("node").union(forest.select("component")), forest.select(F.col("node").alias("a"), F.col("component").alias("b")))
        discard(forest)
    return parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()).distinct()


def label_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of nodes(node) by links(a, b), in rounds.

    Each round every node takes the least label among its own, its neighbours' and its label's label, so that chains shrink by halves; lineage
    is cut in the shared folder. A hub's neighbours are aggregated before the shuffle.
    """
    both = links.select(F.col("a").alias("_u"), F.col("b").alias("_v")).unionByName(links.select(F.col("b").alias("_u"), F.col("a").alias("_v"))).distinct()
    both = cut_lineage(both)
    labels = held = cut_lineage(nodes.select(F.col("node").alias("_n"), F.col("node").alias("_l")).distinct())
    while True:
        near = both.join(labels, both["_v"] == labels["_n"]).groupBy("_u").agg(F.min("_l").alias("_m"))
        up = labels.select(F.col("_n").alias("_k"), F.col("_l").alias("_up"))
        step = labels.join(near, labels["_n"] == near["_u"], "left").select("_n", "_l", F.least("_l", F.coalesce("_m", "_l")).alias("_t"))
        new = step.join(up, step["_t"] == up["_k"], "left").select("_n", F.least("_t", F.coalesce("_up", "_t")).alias("_new"), "_l")
        new = cut_lineage(new)
        changed = not new.filter("_new < _l").isEmpty()
        discard(held)
        held, labels = new, new.select("_n", F.col("_new").alias("_l"))
        if not changed:
            discard(both)
            return labels.select(F.col("_n").alias("node"), F.col("_l").alias("component"))


#: Rows up to which a series is ordered in one task (a window spills, but isn't shared out); longer ones are cut into chunks.
HOT_ROWS = 10_000_000
CHUNK_ROWS = 1_000_000


def chunked(df: DataFrame, by: Sequence[str], order: Sequence[str], hot_rows: int | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """df, and the columns by which windows over its ordered series partition it.

    If no series (of equal by) has more than hot_rows rows, that is df and by. Else the rows are laid out by ranges of (by, order), of about chunk_rows, in a table
    of the shared folder, so that a series that holds a third of all rows is shared out: windows go by _chunk too, and each chunk has copies (_own is
    false) of the row before and the row after it. own() takes them out again; running() carries sums and the like from chunk to chunk.
    """
    by, order = list(by), list(order)
    hot_rows, chunk_rows = HOT_ROWS if hot_rows is None else hot_rows, CHUNK_ROWS if chunk_rows is None else chunk_rows
    longest, total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (longest or 0) <= hot_rows:
        return df, by
    laid = cut_lineage(df.repartitionByRange(max(2, -(-total // chunk_rows)), *by, *order).withColumn("_chunk", F.spark_partition_id()))
    whole, place = F.struct(*df.columns), F.struct(*order)
    w = Window.partitionBy(*by).orderBy("_chunk")
    ends = laid.groupBy(*by, "_chunk").agg(F.min_by(whole, place).alias("_first"), F.max_by(whole, place).alias("_last"))
    ends = ends.withColumns({"_before": F.lag("_chunk").over(w), "_after": F.lead("_chunk").over(w)})
    copies = ends.filter("_after is not null").select("_last.*", F.col("_after").alias("_chunk")).unionByName(ends.filter("_before is not null").select("_first.*", F.col("_before").alias("_chunk")))
    return laid.withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False))), [*by, "_chunk"]


def own(df: DataFrame) -> DataFrame:
    """Rows of chunked() without the copies."""
    return df.filter("_own").drop("_own") if "_own" in df.columns else df


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, how: str = "sum", following: bool = False) -> DataFrame:
    """Add the sum, min, max or last (that isn't null) of value over a series' rows so far, or with following over the rows from here on; df is as own() left it."""
    aggregate = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    parts = [*by, "_chunk"] if "_chunk" in df.columns else list(by)
    ends = (Window.currentRow, Window.unboundedFollowing) if following else (Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, aggregate(value).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(*ends)))
    if "_chunk" not in df.columns:
        return out
    of_chunk = F.max_by(value, F.when(value.isNotNull(), F.struct(*order))) if how == "last" else aggregate(value)
    others = (1, Window.unboundedFollowing) if following else (Window.unboundedPreceding, -1)
    totals = df.groupBy(*parts).agg(of_chunk.alias("_t")).withColumn("_t", aggregate(F.col("_t")).over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*others)))
    totals = totals.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(parts)})
    same = F.lit(True)
    for i, c in enumerate(parts):
        same = same & out[c].eqNullSafe(totals[f"_j{i}"])
    both = {"sum": F.coalesce(F.col(name) + F.col("_t"), F.col(name), F.col("_t")), "min": F.least(name, "_t"), "max": F.greatest(name, "_t"), "last": F.coalesce(name, "_t")}[how]
    return out.join(totals, same).withColumn(name, both).drop("_t", *[f"_j{i}" for i in range(len(parts))])


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """A scan with a state over each group's rows in order, for what depends on its own earlier results.

    step(state, rows) is called with the consecutive rows (pa.Table) of one group that a batch holds and returns (state, pa.Table or
    None); state is None where a group begins. Rows stream through, so a group of any length needs no more memory than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            starts = _changes(table, keys)
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                rows = table.slice(int(s), int(e - s))
                now = tuple(repr(rows.column(k)[0].as_py()) for k in keys)
                state, out = step(state if now == key else None, rows)
                key = now
                if out is not None and out.num_rows:
                    yield from out.combine_chunks().to_batches()

    laid = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return laid.mapInArrow(run, schema)


def join_groups(df: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give each row the columns of its group's one row; without keys all rows are one group."""
    if keys:
        return df.join(per_group, list(keys))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(per_group.limit(1).withColumn("_one", F.lit(1))), "_one").drop("_one")


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with further columns, given as in DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
