"""Triangles as points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def discretise(triangles: DataFrame, step: float, id: str = "id") -> DataFrame:
    """(id, x, y, z, internal) of triangles(id, a_x, ..., c_z): points of a lattice along the sides a-b and a-c, at most step apart along either and along b-c.

    internal is false on the sides. Corners are among the points; a degenerate triangle gives the points of its sides; a null coordinate gives none.
    """
    a, b, c = (V.vec(k) for k in "abc")
    longest = F.greatest(V.distance(a, b), V.distance(b, c), V.distance(c, a))
    n = F.greatest(F.lit(1), F.ceil(longest / step - 1e-9)).cast("int")
    rows = triangles.withColumn("_n", n).filter("_n is not null and _n < 46340").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_i"))))
    i, j = F.col("_i") / F.col("_n"), F.col("_j") / F.col("_n")
    at = [x + (y - x) * i + (z - x) * j for x, y, z in zip(a, b, c, strict=True)]
    inside = (F.col("_i") > 0) & (F.col("_j") > 0) & (F.col("_i") + F.col("_j") < F.col("_n"))
    return rows.select(id, *[v.alias(k) for k, v in zip("xyz", at, strict=True)], inside.alias("internal"))
