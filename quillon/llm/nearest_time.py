"""Matching records by nearest time.

Method: the right side's moments become intervals, each bounded by the midpoints to its neighbours and by the tolerance, so that a left
moment lies in at most one of a kind. The intervals are kept by entity and time slice and in order of their lower bounds, which is the index of
the range join: a sweep over a slice carries the last interval of each kind along to the left moments, so that the work of a
slice grows with its rows and not with their pairs, however dense an entity is. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, slice_width: int | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """Pair each left(entity, moment, id) with the nearest right(kind, entity, moment, id) of the same entity, for each kind, at most tolerance away.

    Gives (left_id, kind, right_id), distinct rows; left rows without a partner are left out. moment is bigint in any unit, tolerance in the
    same unit; exactly the tolerance still counts. Of two equally near records the earlier is taken, of several at one moment that with the
    least id. Nulls in kind, entity, moment or id take part in nothing. Repeated rows count once. Empty tables give no rows. Further columns are
    ignored. A kind stands for a table; kinds names those wanted (default: all that right has, which are listed first).
    """
    slice_width = slice_width or max(1, 40 * tolerance)
    names = list(kinds) if kinds is not None else sorted(r[0] for r in right.select("kind").distinct().collect() if r[0] is not None)
    whole = lambda df, kind, key: df.select(kind.alias("kind"), "entity", "moment", "id", key.alias("key")).dropna(subset=["entity", "moment", "id"])
    no_kind, no_key = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = whole(right.filter(F.col("kind").isin(names)), F.col("kind"), no_key).unionByName(whole(left, no_kind, F.col("id").cast("long")))
    # One row for each left id, and for each moment of a kind; both sides go through one shuffle.
    single = rows.groupBy("kind", "entity", "moment", "key").agg(F.min("id").alias("id"))
    reach = F.when(F.col("kind").isNull(), 0).otherwise(tolerance)
    slices = F.sequence(F.floor((F.col("moment") - reach) / slice_width), F.floor((F.col("moment") + reach) / slice_width))
    placed = single.withColumn("slice", F.explode(slices)).repartition("entity", "slice")
    # Bounds are doubled, so that midpoints stay whole numbers: id is nearest to 2 * moment in (low, high]. Beyond a slice's reach no neighbour matters.
    beside = Window.partitionBy("entity", "slice", "kind").orderBy("moment")
    doubled = 2 * F.col("moment")
    low = F.greatest(doubled - 2 * tolerance - 1, F.col("moment") + F.lag("moment").over(beside))
    high = F.least(doubled + 2 * tolerance, F.col("moment") + F.lead("moment").over(beside))
    is_left = F.col("kind").isNull()
    index = placed.select("kind", "entity", "slice", "id", F.when(is_left, doubled).otherwise(low + 1).alias("at"), F.when(~is_left, high).alias("high"), is_left.alias("left"))
    sweep = Window.partitionBy("entity", "slice").orderBy("at", "left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [F.last(F.when(F.col("kind") == k, F.struct("high", "id")), ignorenulls=True).over(sweep) for k in names]
    found = F.array(*[F.struct(F.lit(k).alias("kind"), h["high"].alias("high"), h["id"].alias("right_id")) for k, h in zip(names, held, strict=True)])
    if not names:
        return left.select(F.col("id").alias("left_id"), no_kind.alias("kind"), F.col("id").alias("right_id")).limit(0)
    swept = index.select(F.col("id").alias("left_id"), "at", "left", found.alias("found")).filter("left")
    return swept.select("left_id", "at", F.explode("found").alias("f")).filter("f.high >= at").select("left_id", "f.kind", "f.right_id")
