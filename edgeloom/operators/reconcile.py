"""Declared against live: full outer joins of canonical nodes and edges, with drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators.ordering import last_per_key

# The node attributes that reconciling carries.
PASS_ATTRS = (
    "ingress", "service_account", "image", "vpc_egress", "url", "schedule", "dns_name", "record_type", "rrdatas", "region", "ip_cidr_range", "network",
    "direction", "ip_address", "port_range", "database_version", "location", "secret_id", "store", "staged_collection", "external",
)


def node_key() -> list[Column]:
    return [T.kind_family("kind"), T.norm_id("name")]


def edge_key() -> list[Column]:
    return [F.col("type"), T.norm_id("src"), T.norm_id("dst")]


def principal(name: Column | str) -> Column:
    """SA:x, serviceAccount:x and x alike, for callers who want invocations of both sides to meet."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, "^(SA|serviceAccount):", "")


def _sides(declared: DataFrame, live: DataFrame, key: list[Column]) -> DataFrame:
    """k, d and l (the last row of each side with that key): one shuffle a side, by the key."""
    names = [f"k{i}" for i in range(len(key))]

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(F.struct(*df.columns).alias("_r"), F.col("seq").alias("_s"), *(k.alias(n) for k, n in zip(key, names, strict=True)))
        return keyed.groupBy(*names).agg(F.max_by("_r", "_s").alias(name))

    return side(declared, "d").join(side(live, "l"), names, "full_outer")


def tag(d: Column, l: Column) -> Column:  # noqa: E741
    return F.when(d.isNotNull() & l.isNotNull(), F.lit("both")).when(l.isNotNull(), F.lit("live")).otherwise(F.lit("declared"))


def reconcile_nodes(declared: DataFrame, live: DataFrame) -> DataFrame:
    """name, kind, source (both, live, declared), attrs, live_attrs, provenance. Keys are (kind family, normalised name);
    of duplicates on a side the last counts. A node on both sides is described by the declared one."""
    both = _sides(declared, live, node_key())
    one = F.coalesce("d", "l")
    return both.select(
        one["name"].alias("name"), one["kind"].alias("kind"), tag(F.col("d"), F.col("l")).alias("source"), one["attrs"].alias("attrs"),
        F.when(F.col("d").isNotNull() & F.col("l").isNotNull(), F.col("l.attrs")).alias("live_attrs"), one["provenance"].alias("provenance"),
    )


def reconcile_edges(declared: DataFrame, live: DataFrame) -> DataFrame:
    both = _sides(declared, live, edge_key())
    one = F.coalesce("d", "l")
    columns = [c for c in declared.columns if c not in ("seq", "source")]
    return both.select(*(one[c].alias(c) for c in columns), tag(F.col("d"), F.col("l")).alias("source"))


def drift(reconciled: DataFrame) -> DataFrame:
    """node, attr, declared, live: attributes that both sides give, neither empty, and that differ as strings."""
    rows = reconciled.where("source = 'both'").select(F.col("name").alias("node"), "attrs", F.explode("live_attrs").alias("attr", "live"))
    rows = rows.select("node", "attr", F.try_element_at("attrs", F.col("attr")).alias("declared"), "live")
    return rows.where("declared is not null and declared <> '' and live is not null and live <> '' and declared <> live")


def report(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("source") == "both").alias("both"), F.count_if(F.col("source") == "live").alias("deployed_not_in_iac"), F.count_if(F.col("source") == "declared").alias("declared_not_live"),
    )


def key_collisions(nodes: DataFrame) -> DataFrame:
    """Keys under which several different nodes of one side meet, as only the family of the kind is in the key."""
    family, name = node_key()
    return nodes.groupBy(family.alias("family"), name.alias("id")).agg(F.count_distinct("kind", "name").alias("n")).where("n > 1")


__all__ = ["PASS_ATTRS", "drift", "edge_key", "key_collisions", "last_per_key", "node_key", "principal", "reconcile_edges", "reconcile_nodes", "report", "tag"]
