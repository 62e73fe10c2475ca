"""From a workspace to patches for its page store: all stages as one lazy plan, written once at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.extract import javascript_source, python_source, terraform
from edgeloom.operators import coupling, edges, emit, reconcile
from edgeloom.operators.ordering import numbered
from edgeloom.sources import workspace as ws


@dataclass
class Map:
    sites: DataFrame
    logical: DataFrame
    nodes: DataFrame
    physical: DataFrame
    access: DataFrame
    shared: DataFrame
    patches: DataFrame


def build(spark: SparkSession, config: ws.Config, now: str, env: str | None = None, facts: DataFrame | None = None, live: tuple[DataFrame, DataFrame] | None = None, heads: DataFrame | None = None) -> Map:
    """facts: grounding facts by id (src_repo, target_service and endpoint family joined by |). live: nodes and edges of a
    snapshot to reconcile with. heads: repo, head (else read from the work trees)."""
    files = ws.source_files(spark, config.workspace, config.repos, named=tuple(config.registry))
    heads = ws.heads(spark, config.workspace, config.repos) if heads is None else heads
    registry = files.where(F.col("rel").isin([f"{r}" for r in config.registry])) if config.registry else files.limit(0)
    services = ws.registry_services(registry)
    found = [ws.fanout_sites(services)]
    found += [python_source.scan_calls(files, config.services)] if "python" in config.languages else []
    found += [javascript_source.scan_calls(files, config.services)] if "javascript" in config.languages else []
    sites = found[0]
    for f in found[1:]:
        sites = sites.unionByName(f, allowMissingColumns=True)
    for name, kind in (("prov_rank", "int"), ("lang", "string"), ("endpoint_expr", "string"), ("unresolved_expr", "string"), ("resolved_via", "string")):
        sites = sites if name in sites.columns else sites.withColumn(name, F.lit(None).cast(kind))
    sites = numbered(ws.stamp(sites, heads, now), ["src_repo", "src_file", "src_line", "target_service", "target_endpoint", "condition"], "seq")
    logical = edges.logical_edges(sites).withColumn("id", F.concat_ws("|", "src_repo", "target_service", "endpoint_family"))
    logical = edges.grounding_gate(logical, facts) if facts is not None else logical.withColumn("grounded", F.lit(False))

    scanned = terraform.scan(files, config.services, config.tfvars(env))
    declared = terraform.nodes(scanned)
    nodes = terraform.upserted(declared.select("seq", "name", "kind", "provider", "source", "repo", "attrs", "provenance").unionByName(ws.registry_nodes(services).withColumn("repo", F.lit("(config)"))))
    physical = terraform.edges(scanned)
    if live is not None:
        nodes = reconcile.reconcile_nodes(nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: k.isin(*reconcile.PASS_ATTRS))), live[0])
        physical = reconcile.reconcile_edges(physical, live[1].select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in physical.schema if f.name not in live[1].columns)))
    access = python_source.scan_access(files).unionByName(javascript_source.scan_models(files)).unionByName(ws.staged_reads(declared))
    access = numbered(access, ["repo", "provenance", "collection", "mode"], "seq")
    shared = ws.stamp(coupling.stitch(access), heads, now)

    pages = spark.createDataFrame(list(config.pages.items()) or [("", "")], "repo string, title string")
    targets = spark.createDataFrame(list(config.service_pages.items()) or [("", "")], "service string, title string")
    stamped = ws.stamp(physical, heads, now, "repo") if "repo" in physical.columns else physical
    patches = emit.logical_patches(logical, pages, targets).unionByName(emit.datastore_patches(shared, pages)).unionByName(emit.physical_patches(stamped, pages))
    return Map(sites, logical, nodes, physical, access, shared, patches)
