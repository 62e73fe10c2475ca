"""Two environments compared: what only one has, and which attributes differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators.ordering import numbered
from edgeloom.operators.reconcile import _sides, edge_key, node_key

# Attributes that differ between environments by nature.
IGNORED = ("provenance", "url")


def compare_nodes(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """name, kind, status (only_in_a, only_in_b, differs, identical) and deltas: attr -> struct(a, b).

    Attributes of either side count, missing ones as null; self links are compared by their last segment.
    """
    both = _sides(a, b, node_key()).withColumnRenamed("d", "a").withColumnRenamed("l", "b")
    empty = F.expr("cast(map() as map<string,string>)")

    def attrs(side: str):
        return F.transform_values(F.coalesce(F.col(f"{side}.attrs"), empty), lambda k, v: T.self_link_tail(v))

    zipped = F.map_zip_with(attrs("a"), attrs("b"), lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))
    deltas = F.map_filter(zipped, lambda k, v: ~k.isin(list(ignored)) & ~v["a"].eqNullSafe(v["b"]))
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    one = F.coalesce("a", "b")
    out = both.select(one["name"].alias("name"), one["kind"].alias("kind"), F.when(two, deltas).alias("deltas"), F.col("a").isNull().alias("_no_a"), F.col("b").isNull().alias("_no_b"))
    status = F.when(F.col("_no_b"), "only_in_a").when(F.col("_no_a"), "only_in_b").when(F.size("deltas") > 0, "differs").otherwise("identical")
    return out.withColumn("status", status).drop("_no_a", "_no_b")


def attr_deltas(compared: DataFrame) -> DataFrame:
    rows = compared.where("status = 'differs'").select("name", "kind", F.explode("deltas").alias("attr", "v"))
    return rows.select("name", "kind", "attr", F.col("v.a").alias("a"), F.col("v.b").alias("b"))


def compare_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """src, dst, type and status of the edges that only one side has: anti-joins both ways."""
    names = [k.alias(f"_k{i}") for i, k in enumerate(edge_key())]
    keys = [f"_k{i}" for i in range(len(names))]

    def last(df: DataFrame) -> DataFrame:
        return df.select("seq", "src", "dst", "type", *names).groupBy(*keys).agg(F.max_by(F.struct("src", "dst", "type"), "seq").alias("e"))

    x, y = last(a), last(b)
    only_a = x.join(y, keys, "left_anti").select("e.*", F.lit("only_in_a").alias("status"))
    return only_a.unionByName(y.join(x, keys, "left_anti").select("e.*", F.lit("only_in_b").alias("status")))


def summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status", T.kind_family("kind").alias("family")).agg(F.count("*").alias("n"))


def ordered(compared: DataFrame) -> DataFrame:
    """What differs, with its place in the report: what only a has, what only b has, then what differs, each by kind and
    name, whatever the order of the input."""
    part = F.when(F.col("status") == "only_in_a", 0).when(F.col("status") == "only_in_b", 1).otherwise(2)
    rows = compared.where("status <> 'identical'").withColumn("_part", part).withColumn("_kind", F.coalesce("kind", F.lit(""))).withColumn("_name", F.coalesce("name", F.lit("")))
    return numbered(rows.withColumnRenamed("_part", "_order"), ["_order", "_kind", "_name"], "place").drop("_order", "_kind", "_name")
