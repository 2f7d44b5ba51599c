"""Shortest paths over edges held in a DataFrame, by rounds of relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.plans.partitioning import cut_lineage, discard


def graph(edges: DataFrame, nodes: DataFrame | None = None, source: str = "source", target: str = "target", cost: str | None = None, axes: tuple[str, ...] | None = None, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(source, target, cost). Without nodes they are the edges' ends. cost: a column, else the distance of nodes with axes, else 1.

    Of parallel edges the cheapest stays. Edges with a null end or a null, NaN or negative cost are left out.
    """
    e = edges.select(F.col(source).alias("source"), F.col(target).alias("target"), (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("cost"))
    if axes and not cost:
        at = lambda end: nodes.select(F.col("id").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in axes])
        e = e.join(at("source"), "source").join(at("target"), "target")
        e = e.withColumn("cost", V.distance([F.col(f"source_{a}") for a in axes], [F.col(f"target_{a}") for a in axes]))
    e = e.select("source", "target", "cost").filter("source is not null and target is not null and cost >= 0 and not isnan(cost)")
    if not directed:
        e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost"))
    e = e.groupBy("source", "target").agg(F.min("cost").alias("cost"))
    if nodes is None:
        nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return nodes, e


def shortest_paths(edges: DataFrame, sources: DataFrame, max_cost: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(origin, id, cost, parent): the least cost from each source to every node that it reaches; parent is null at the origin. Ties: the least parent.

    A round joins the nodes whose cost just fell with their edges and aggregates before the shuffle; it ends when no cost falls.
    """
    edges = cut_lineage(edges)
    best = cut_lineage(sources.select(F.col("id").alias("origin"), "id").filter("id is not null").distinct().withColumns({"cost": F.lit(0.0), "parent": F.lit(None).cast(sources.schema["id"].dataType)}))
    front = best
    for _ in range(max_rounds):
        reached = front.select("origin", F.col("id").alias("source"), F.col("cost").alias("_c")).join(edges, "source")
        reached = reached.select("origin", F.col("target").alias("id"), (F.col("_c") + F.col("cost")).alias("cost"), F.col("source").alias("parent"))
        if max_cost is not None:
            reached = reached.filter(F.col("cost") <= max_cost)
        offers = reached.groupBy("origin", "id").agg(F.min(F.struct("cost", "parent")).alias("_o")).select("origin", "id", "_o.cost", "_o.parent")
        known = best.select("origin", "id", F.col("cost").alias("_old"), F.col("parent").alias("_by"))
        better = offers.join(known, ["origin", "id"], "left").filter(F.col("_old").isNull() | (F.col("cost") < F.col("_old")) | ((F.col("cost") == F.col("_old")) & F.col("_by").isNotNull() & (F.col("parent") < F.col("_by"))))
        old = front
        front = cut_lineage(better.select("origin", "id", "cost", "parent"))
        if old is not best:
            discard(old)
        if front.isEmpty():
            discard(front, edges)
            return best
        old = best
        best = cut_lineage(best.join(front.select("origin", "id"), ["origin", "id"], "left_anti").unionByName(front))
        discard(old)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def paths_to(found: DataFrame, targets: DataFrame, permissive: bool = False) -> DataFrame:
    """(origin, target, step, id, cost): the nodes of the path from each origin to each target(origin, id), from step 0. All paths are walked together.

    A target that isn't reached is an error, or with permissive left out.
    """
    want = targets.select("origin", F.col("id").alias("target")).distinct()
    ends = want.join(found.withColumnRenamed("id", "target"), ["origin", "target"], "left")
    if not permissive:
        ends = ends.filter(F.when(F.col("cost").isNull(), F.raise_error(F.concat(F.lit("no path to "), F.col("target").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    at = cut_lineage(ends.filter("cost is not null").select("origin", "target", F.col("target").alias("id"), "cost", "parent", F.lit(0).alias("_back")))
    out = at
    back = 0
    while True:
        back += 1
        step = at.filter("parent is not null").select("origin", "target", F.col("parent").alias("id")).join(found, ["origin", "id"]).select("origin", "target", "id", "cost", "parent", F.lit(back).alias("_back"))
        at = cut_lineage(step)
        if at.isEmpty():
            break
        out = out.unionByName(at)
    most = out.groupBy("origin", "target").agg(F.max("_back").alias("_most"))
    return out.join(most, ["origin", "target"]).select("origin", "target", (F.col("_most") - F.col("_back")).alias("step"), "id", "cost")
