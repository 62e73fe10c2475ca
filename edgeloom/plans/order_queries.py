"""Operators that depend on order, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import ordering
from edgeloom.plans.registry import query, table


@query("select doc_id, source, running::bigint running, running > 20000 deferred from (select doc_id, source, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) running from documents)")
def budget_defer(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.running_budget(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20_000).drop("n_chars")


@query("select doc_id, place, place > 300 deferred from (select doc_id, row_number() over (order by n_chars, doc_id) place from documents)")
def budget_position(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.within_budget(table(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 300 * 15_000 + 1, 15_000).drop("n_chars")


@query("select conv_id, turn, nearest from (select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) nearest from conversations) where role = 'assistant'")
def nearest_guard(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return ordering.nearest_before(c, ["conv_id"], "turn", F.col("role") == "user", F.col("turn")).where("role = 'assistant'").select("conv_id", "turn", "nearest")


@query("select conv_id, turn, md5(concat_ws(' ', text, lead(text, 1) over w, lead(text, 2) over w)) joined from conversations window w as (partition by conv_id order by turn)")
def sliding_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.sliding_join(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", F.md5("joined").alias("joined"))


@query("select event_type, event_id, turn::int turn from (select event_type, event_id, row_number() over (partition by event_type order by event_id) turn from events) order by turn, event_type limit 23")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.round_robin(table(spark, sf, "events").select("event_type", "event_id"), "event_type", ["event_id"], 23)


@query("select user_id, arg_max(value, event_id) filter (event_type = 'purchase') as value, arg_max(event_type, event_id) event_type, arg_min(props, event_id) props from events group by 1")
def node_upsert_last_nonnull(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "props", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return ordering.last_non_null(e, ["user_id"], "event_id", ["value", "event_type"], ["props"])


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def last_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return ordering.last_per_key(e, ["user_id", "event_type"], "event_id")


@query("select name, min(seq) owner_seq, count(*) n from (select split_part(p_name, ' ', 1) as name, p_partkey seq from part) group by 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("key"), F.col("p_partkey").alias("rel"), F.lit(0).alias("rank"), F.col("p_partkey").alias("walk_no"))
    return ordering.key_collisions(p).select(F.col("key").alias("name"), F.col("owner").alias("owner_seq"), "n")
