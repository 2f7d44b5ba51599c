"""Message tables: the moment of a message, and which messages are timed (definitions in TESTDATA.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.partitioning import lookup_join

#: Values of time_usec below this count from boot.
FROM_BOOT_BELOW = 10**13


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timed(messages: DataFrame, boots: DataFrame, time: str = "time_usec", milliseconds_from_boot: bool = False) -> DataFrame:
    """Add moment (bigint, microseconds since the UNIX epoch), keep the timed messages only.

    A message is dropped if its time or boot is null, if time_usec is 0, or if the moment lies outside its boot. Repeated
    messages stay: the caller drops them in the shuffle it needs anyway. If boot_id occurs repeatedly in boots, one row counts.
    """
    spans = boots.groupBy("boot_id").agg(F.min("boot_usec").alias("_on"), F.max("off_usec").alias("_off")).filter("boot_id is not null")
    joined = lookup_join(messages.filter(F.col(time).isNotNull() & F.col("boot_id").isNotNull()), spans, "boot_id", "rec_id")
    if milliseconds_from_boot:
        moment = F.col("_on") + F.col(time) * 1000
    else:
        joined = joined.filter(F.col(time) != 0)
        moment = F.when(F.col(time) < FROM_BOOT_BELOW, F.col(time) + F.col("_on")).otherwise(F.col(time))
    return joined.withColumn("moment", moment).filter((F.col("moment") >= F.col("_on")) & (F.col("moment") <= F.col("_off"))).drop("_on", "_off", time)


def positioned(latitude: str = "lat", longitude: str = "lon") -> Column:
    """Whether a gps message has a fix and a position."""
    return (F.col("fix_type") >= 2) & F.col(latitude).isNotNull() & F.col(longitude).isNotNull() & ~((F.col(latitude) == 0) & (F.col(longitude) == 0))
