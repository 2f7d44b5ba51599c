"""Queries p4 and p6 to p8 over the whole test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.nearest_time import nearest_in_time
from quillon.llm.packing import pack_items
from quillon.llm.pii import find_personal, replace_personal
from quillon.llm.tokens import count_tokens, encode_texts
from quillon.sources.messages import table, timed

TOLERANCE_US = 400_000
KEY = "key of the test queries"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each optical_flow message with the nearest attitude_target and gps2_raw messages of its boot, up to 400 ms away."""
    boots = table(spark, d, "mavlink_boots")
    head = ["rec_id", "boot_id"]
    flow = timed(table(spark, d, "mavlink_optical_flow_t").select(*head, "time_usec"), boots)
    attitude = timed(table(spark, d, "mavlink_attitude_target_t").select(*head, "time_boot_ms"), boots, "time_boot_ms", milliseconds_from_boot=True)
    gps = timed(table(spark, d, "mavlink_gps2_raw_t").select(*head, "time_usec"), boots)
    as_kind = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("boot_id").alias("entity"), "moment", F.col("rec_id").alias("id"))
    right = as_kind(attitude, "attitude_target").unionByName(as_kind(gps, "gps2_raw"))
    paired = nearest_in_time(as_kind(flow, "flow").drop("kind"), right, TOLERANCE_US, kinds=["attitude_target", "gps2_raw"])
    return paired.select(F.col("left_id").alias("flow_id"), F.col("kind").alias("other"), F.col("right_id").alias("other_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str, **limits: float) -> DataFrame:
    documents = table(spark, d, "documents")
    return pack_items(count_tokens(documents), table(spark, d, "containers"), loss="n_prose", n_items=documents.count(), **limits)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each kind, of which tokens and segments are limited; its tokens in lines of prose bear loss, up to all of a container."""
    return _packed(spark, d)


def p7_instruction(spark: SparkSession, d: str) -> DataFrame:
    """The same under narrow limits, as for instruction data: loss on at most three quarters of a container, a segment for each 128 tokens of it."""
    return _packed(spark, d, loss_share=0.75, segment_tokens=128)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each different string of a document that is personal information."""
    return find_personal(table(spark, d, "documents"), table(spark, d, "known_names"))


def p8_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders in place of personal information; the key of a real run comes from its owner."""
    return replace_personal(table(spark, d, "documents"), table(spark, d, "known_names"), KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p4_found, p6_ids, p7_packed, p7_instruction, p8_found, p8_replaced)}


P4_SQL = """
with gps as (select distinct on (m.rec_id) m.rec_id, m.boot_id, case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end as moment
        from mavlink_gps2_raw_t m join mavlink_boots b using (boot_id)
        where time_usec <> 0 and case when time_usec < 10000000000000 then time_usec + boot_usec else time_usec end between boot_usec and off_usec),
flow as (select distinct rec_id, boot_id, time_usec as moment from mavlink_optical_flow_t join mavlink_boots using (boot_id) where time_usec <> 0 and time_usec between boot_usec and off_usec),
attitude as (select distinct rec_id, boot_id, boot_usec + 1000 * time_boot_ms as moment from mavlink_attitude_target_t join mavlink_boots using (boot_id) where boot_usec + 1000 * time_boot_ms between boot_usec and off_usec),
other as (select 'attitude_target' as other, boot_id, moment, rec_id from attitude union all select 'gps2_raw', boot_id, moment, rec_id from gps)
select f.rec_id as flow_id, other, arg_min(o.rec_id, abs(o.moment - f.moment)) as other_id
from flow f join other o on f.boot_id = o.boot_id and o.moment between f.moment - 400000 and f.moment + 400000
group by 1, 2
"""


def oracle_sql() -> dict[str, str]:
    """Encoding, packing and personal information can't be put in SQL; the tests hold them against other implementations."""
    return {"p4_found": P4_SQL}
