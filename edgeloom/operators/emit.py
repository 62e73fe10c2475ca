"""Edges of the three families as patches for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATCH = ("page", "target", "type", "endpoint", "condition", "provenance", "confidence", "grounded", "owner", "owner_basis", "store", "collections", "role", "schedule", "via", "value", "source", "endpoint_expr", "extracted_from", "home_unmapped")


def home_page(edges: DataFrame, pages: DataFrame, repo: str = "src_repo", fanout_page: str = "Gateway") -> DataFrame:
    """edges with the page of their repo by pages(repo, title); without one the repo's name, marked home_unmapped. Fan-out
    edges live on a page of their own."""
    p = pages.select(F.col("repo").alias("_repo"), F.col("title").alias("_title"))
    out = edges.join(p, F.col(repo) == F.col("_repo"), "left")
    fan = F.col("kind") == "mcp-fanout" if "kind" in edges.columns else F.lit(False)
    return out.withColumn("page", F.when(fan, F.lit(fanout_page)).otherwise(F.coalesce("_title", repo))).withColumn("home_unmapped", ~fan & F.col("_title").isNull()).drop("_repo", "_title")


def unmapped_homes(homed: DataFrame, repo: str = "src_repo") -> DataFrame:
    """repo, n: how many edges have no page to live on."""
    return homed.where("home_unmapped").groupBy(repo).agg(F.count("*").alias("n"))


def _link(c):
    return F.concat(F.lit("[["), c, F.lit("]]"))


def _patch(df: DataFrame) -> DataFrame:
    kinds = {"grounded": "boolean", "home_unmapped": "boolean", "collections": "array<string>", "extracted_from": "struct<repo:string,sha:string,at:string>"}
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in PATCH))


def logical_patches(edges: DataFrame, pages: DataFrame, services: DataFrame) -> DataFrame:
    """Logical edges (grounded, from grounding_gate) as patches; services(service, title) name the target's page."""
    e = home_page(edges, pages).join(services.select(F.col("service").alias("_s"), F.col("title").alias("_t")), F.col("target_service") == F.col("_s"), "left")
    condition = F.array_join("conditions", " AND ")
    e = e.withColumn("target", _link(F.coalesce("_t", "target_service"))).withColumn("type", F.col("kind")).withColumn("endpoint", F.col("endpoint_family")).withColumn("condition", F.when(condition != "", condition))
    return _patch(e.withColumn("provenance", F.get("call_sites", F.lit(0))).withColumn("confidence", F.col("confidence_summary")))


def datastore_patches(edges: DataFrame, pages: DataFrame) -> DataFrame:
    e = home_page(edges, pages)
    t = pages.select(F.col("repo").alias("_r"), F.col("title").alias("_t"))
    e = e.join(t, F.col("target_repo") == F.col("_r"), "left").withColumn("target", _link(F.coalesce("_t", "target_repo"))).drop("_r", "_t")
    e = e.join(t, F.col("owner") == F.col("_r"), "left").withColumn("owner", F.when(F.col("owner").isNotNull(), _link(F.coalesce("_t", "owner")))).drop("_r", "_t")
    return _patch(e.withColumn("type", F.lit("shares-datastore")).withColumn("endpoint", F.concat(F.col("store"), F.lit(":"), F.array_join("collections", ","))))


def physical_patches(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Physical edges live on their source node's page, and are marked unless a page has just that title."""
    titles = pages.select(F.col("title").alias("_t")).distinct()
    e = edges.join(titles, F.col("src") == F.col("_t"), "left").withColumn("home_unmapped", F.col("_t").isNull()).withColumn("page", F.col("src"))
    return _patch(e.withColumn("target", _link(F.col("dst"))))


def nested(patches: DataFrame) -> DataFrame:
    """page, edges: one row a page, for a JSON sink."""
    return patches.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*(c for c in PATCH if c != "page")))).alias("edges"))
