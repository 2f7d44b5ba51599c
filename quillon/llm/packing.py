"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

A container has limits on tokens, on segments and on loss-bearing tokens at once. It is filled by that item, of those that still fit,
whose vector of needs has the largest dot product with the vector of what is left, both in shares of the limits. Among items of one number of
tokens that is the one with most loss-bearing tokens that fits, so a choice looks at the different numbers of tokens only. Items are packed in
shards of bounded size; a shard leaves about one container that isn't full.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.partitioning import at_most, map_groups

SHARD_ITEMS = 40_000
#: Tokens of capacity for each segment that a container may hold.
SEGMENT_TOKENS = 64
PACKED = "container_kind string, container_id long, id long, part int, first_token long, n_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int
    segments: int
    loss: int


def cut(tokens: int, loss: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(first token, tokens, loss-bearing tokens) of the parts of an item: full containers and a rest; one part unless it exceeds the capacity."""
    out, borne = [], 0
    for done in range(0, max(tokens, 1), limits.tokens):
        n = min(limits.tokens, tokens - done)
        share = round(loss * (done + n) / tokens) if tokens else 0
        out.append((done, n, share - borne))
        borne = share
    return out


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The container of each item (numbers from 0); no item may have more tokens than a container. Of equal items the first comes first.

    An item that bears more loss than a container should begins one of its own, to which only items that bear none are added.
    """
    over = np.flatnonzero(loss > limits.loss)
    out = np.empty(len(tokens), dtype=np.int64)
    rest = np.flatnonzero(loss <= limits.loss)
    out[over] = np.arange(len(over))
    out[rest] = _fill(tokens[rest], loss[rest], limits, tokens[over])
    return out


def _fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits, begun: np.ndarray) -> np.ndarray:
    """pack, with first containers that hold an item of so many tokens each and may bear no more loss."""
    order = np.lexsort((-np.arange(len(tokens)), loss, tokens))
    sizes, heads = np.unique(tokens[order], return_index=True)
    bounds = np.append(heads, len(order))
    waiting = [list(order[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]  # of each size, by loss
    bears = [list(loss[w]) for w in waiting]
    t, most = sizes.astype(np.int64), np.array([b[-1] for b in bears], dtype=np.int64)
    out = np.empty(len(order), dtype=np.int64)
    container, todo = 0, len(order)
    shorter = bool((loss <= tokens).all())  # then room for tokens is room for loss
    # Shares of both limits, times the squares of both: whole numbers, in which equal products are equal.
    scale_t, scale_v = limits.loss**2, limits.tokens**2
    if limits.tokens * limits.loss >= 2**31:
        scale_t, scale_v = 1 / limits.tokens**2, 1 / limits.loss**2
    while todo:
        room_t, room_v, room_s = limits.tokens, limits.loss, limits.segments
        if container < len(begun):
            room_t, room_v, room_s = room_t - int(begun[container]), 0, room_s - 1
        while room_s and todo:
            n = int(np.searchsorted(t, room_t, "right"))
            if not n:
                break
            most_of_all = int(most[:n].max()) if room_v < room_t or not shorter else 0
            w_t, w_v = room_t * scale_t, room_v * scale_v  # an item's one segment adds the same to each product
            if room_v >= most_of_all:  # whatever fits by its tokens, fits by its loss
                k, at = int(np.argmax(t[:n] * w_t + most[:n] * w_v)), -1
            else:
                score = t[:n] * w_t + np.minimum(most[:n], room_v) * w_v
                best = most[:n].copy()
                while True:  # scores are bounds until the loss that fits is looked up
                    k = int(np.argmax(score))
                    if score[k] < 0 or best[k] <= room_v:
                        break
                    at = bisect_right(bears[k], room_v) - 1
                    best[k] = bears[k][at] if at >= 0 else 0
                    score[k] = t[k] * w_t + best[k] * w_v if at >= 0 else -1
                if score[k] < 0:
                    break
                at = bisect_right(bears[k], best[k]) - 1
            out[waiting[k].pop(at)] = container
            room_t, room_v, room_s = room_t - int(t[k]), room_v - int(bears[k].pop(at)), room_s - 1
            todo -= 1
            if bears[k]:
                most[k] = bears[k][-1]
            else:
                del waiting[k], bears[k]
                t, most = np.delete(t, k), np.delete(most, k)
        container += 1
    return out


def pack_items(items: DataFrame, containers: DataFrame, *, id: str = "doc_id", tokens: str = "n_tokens", loss: str | None = None, loss_share: float = 1.0, segment_tokens: int = SEGMENT_TOKENS, n_items: int | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Put each item into a container of each kind: (container_kind, container_id, id, part, first_token, n_tokens).

    containers(container_kind, capacity) has at most a thousand rows. A container holds at most capacity tokens, loss_share * capacity loss-bearing
    tokens and capacity / segment_tokens segments; one item that alone bears more loss has a container of its own, shared only with items that bear
    none. Only an item with more tokens than the capacity is divided, into whole containers and a rest that is packed as an item. loss names the number of an item's tokens that bear loss (default: all). n_items: how many items there are, about, if that is known;
    else they are counted, which computes them twice. Items without tokens (null or 0) need no
    container: one row with a null container_id. Items with a null id are left out; repeated items are packed repeatedly. Kinds that are null or
    have no capacity hold nothing. Container ids are unique in their kind.
    """
    if not at_most(containers, 1000):
        raise ValueError("containers must be a short list")
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity").distinct().collect() if r[0] is not None and r[1] and r[1] > 0]
    needs = items.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col(loss or tokens), F.lit(0)).cast("long").alias("loss")).filter("id is not null")
    shards = max(1, math.ceil((items.select(id).count() if n_items is None else n_items) / shard_items))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, need, bears = (table.column(c).to_numpy() for c in ("id", "tokens", "loss"))
        shard = table.column("shard").to_numpy()
        ends = np.append(starts[1:], len(ids))
        cols: list[list] = [[] for _ in range(6)]

        def add(kind: str, where: pa.Array, *values: np.ndarray) -> None:
            cols[0].append(pa.array([kind] * len(where), pa.string()))
            cols[1].append(where)
            for c, x in zip(cols[2:], values, strict=True):
                c.append(x)

        for s, e in zip(starts, ends, strict=True):
            for kind, capacity in kinds:
                limits = Limits(capacity, max(1, capacity // segment_tokens), max(1, int(capacity * loss_share)))
                i, n, w = ids[s:e], need[s:e], bears[s:e]
                none = n <= 0
                zeros = np.zeros(int(none.sum()), np.int64)
                add(kind, pa.nulls(len(zeros), pa.int64()), i[none], zeros, zeros, zeros)
                big = np.flatnonzero(n > limits.tokens)
                plain = np.flatnonzero(~none & (n <= limits.tokens))
                parts = [(i[k], p, *c) for k in big for p, c in enumerate(cut(int(n[k]), int(w[k]), limits))]
                more = np.array(parts, dtype=np.int64).reshape(-1, 5)
                all_ids = np.concatenate([i[plain], more[:, 0]])
                part = np.concatenate([np.zeros(len(plain), np.int64), more[:, 1]])
                first = np.concatenate([np.zeros(len(plain), np.int64), more[:, 2]])
                size = np.concatenate([n[plain], more[:, 3]])
                loads = np.concatenate([w[plain], more[:, 4]])
                where = pack(size, loads, limits) + int(shard[s]) * 2**36
                add(kind, pa.array(where, pa.int64()), all_ids, part, first, size)
        arrays = [pa.chunked_array(cols[0], pa.string()), pa.chunked_array(cols[1], pa.int64())]
        arrays += [pa.array(np.concatenate(cols[2]), pa.int64()), pa.array(np.concatenate(cols[3]), pa.int32()), pa.array(np.concatenate(cols[4]), pa.int64()), pa.array(np.concatenate(cols[5]), pa.int64())]
        return pa.table(arrays, names=[f.split()[0] for f in PACKED.split(", ")])

    # Copies of an item are counted and numbered, so that those of one id are spread over the shards too.
    counted = needs.groupBy("id", "tokens", "loss").agg(F.count(F.lit(1)).alias("copies"))
    thousands = counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    copies = thousands.withColumn("copy", F.explode(F.sequence(F.col("_k") * 1000, F.least(F.col("copies") - 1, F.col("_k") * 1000 + 999))))
    placed = copies.select("id", "tokens", "loss", F.pmod(F.xxhash64("id", "copy"), F.lit(shards)).cast("long").alias("shard"))
    return map_groups(placed, ["shard"], ["id", "tokens", "loss"], run, PACKED, rows=1).withColumnRenamed("id", id)
