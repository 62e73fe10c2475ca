"""Snapshots of environments as canonical nodes and edges; JSON that stages hand on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.functions import text as T

NODE = "seq bigint, name string, kind string, provider string, source string, attrs map<string,string>, provenance string"
EDGE = "seq bigint, src string, dst string, type string, source string, condition string, provenance string"

# Section, list, node kind, name paths in order, attributes (name: path), edge (type, target path).
SECTIONS = (
    ("compute", "services", "cloud-run-service", ("metadata.name", "name"), {"url": "status.url", "ingress": "metadata.annotations.run.googleapis.com/ingress"}, None),
    ("compute", "jobs", "cloud-run-job", ("metadata.name", "name"), {}, None),
    ("identity_invoke", "service_accounts", "service-account", ("email", "name"), {}, None),
    ("networking", "vpcs", "network-vpc", ("name",), {}, None),
    ("networking", "subnets", "network-subnet", ("name",), {"region": "region", "ip_cidr_range": "ipCidrRange", "network": "network"}, ("part-of-network", ("network",))),
    ("networking", "connectors", "network-connector", ("name",), {"region": "region", "network": "network"}, None),
    ("networking", "firewalls", "firewall-rule", ("name",), {"direction": "direction", "network": "network"}, ("firewall-allows", ("network",))),
    ("networking", "routers", "network-nat", ("name",), {"region": "region"}, None),
    ("networking", "addresses", "address", ("name",), {"region": "region"}, None),
    ("dns_domains", "zones", "dns-zone", ("name", "dnsName"), {"dns_name": "dnsName"}, None),
    ("dns_domains", "domain_mappings", "dns-domain", ("metadata.name",), {}, ("domain-maps-to", ("spec.routeName",))),
    ("load_balancing", "url_maps", "lb-url-map", ("name",), {}, ("routes-to", ("defaultService",))),
    ("load_balancing", "backend_services", "lb-backend", ("name",), {}, None),
    ("load_balancing", "forwarding_rules", "lb-forwarding-rule", ("name",), {"ip_address": "IPAddress", "port_range": "portRange"}, ("fronted-by", ("target",))),
    ("load_balancing", "api_gateways", "api-gateway", ("name", "displayName"), {}, None),
    ("certs", "ssl_certificates", "cert", ("name",), {}, None),
    ("messaging", "topics", "pubsub-topic", ("name",), {}, None),
    ("messaging", "subscriptions", None, ("name",), {}, ("subscribes-to", ("topic",))),
    ("messaging", "eventarc", "eventarc-trigger", ("name",), {}, ("triggers", ("destination.cloudRun.service", "destination"))),
    ("datastores", "sql", "datastore-sql", ("name",), {"database_version": "databaseVersion", "region": "region"}, None),
    ("datastores", "redis", "datastore-redis", ("name",), {"region": "region"}, None),
    ("datastores", "buckets", "datastore-bucket", ("name", "id"), {}, None),
    (None, "secrets_refs", "secret-ref", ("name", "displayName"), {}, None),
    ("scheduling", "scheduler", "cloud-scheduler", ("name",), {}, None),
    ("scheduling", "workflows", "workflow", ("name",), {"region": "region"}, None),
)


def _path(path: str) -> str:
    """A JSON path; what follows `annotations` is one key, dots and all."""
    head, mid, tail = path.partition(".annotations.")
    return "$." + (f"{head}.annotations['{tail}']" if mid else path)


def _get(item: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(item, _path(p)), F.lit("")) for p in paths))


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, doc, doc_no: whole JSON files as strings, numbered in the order of their paths."""
    read = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
    names = read.select("path").distinct()  # a row a file
    numbered = names.select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("bigint").alias("doc_no"))
    return read.join(F.broadcast(numbered), "path")


def _items(docs: DataFrame, section: str | None, name: str, no: int) -> DataFrame:
    found = F.from_json(F.get_json_object("doc", f"$.{section}.{name}" if section else f"$.{name}"), "array<string>")
    return docs.select(_number(docs), F.posexplode(found).alias("at", "item")).withColumn("seq", F.shiftleft(F.col("_doc"), 44) + F.lit(no << 33) + F.col("at")).drop("_doc")


def _number(docs: DataFrame) -> Column:
    """The number of a document, so that sequence numbers of several do not meet: 19 bits, before 11 for the section and 33
    for the place in it."""
    return (F.col("doc_no") if "doc_no" in docs.columns else F.lit(0)).cast("bigint").alias("_doc")


def live_nodes(docs: DataFrame) -> DataFrame:
    """Nodes of live snapshots (docs with a JSON string `doc`), section by section. Functions and instances are not nodes."""
    parts = []
    for no, (section, name, kind, names, attrs, _) in enumerate(SECTIONS):
        if kind is None:
            continue
        items = _items(docs, section, name, no).withColumn("name", _get(F.col("item"), *names)).where("name is not null")
        own = {k: _get(F.col("item"), p) for k, p in attrs.items()} | ({"store": F.lit("gcs")} if kind == "datastore-bucket" else {})
        bag = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()) if own else F.expr("cast(map() as map<string,string>)")
        shown = F.col("name") if kind == "cloud-run-service" else T.norm_id("name")
        parts.append(items.select("seq", shown.alias("name"), F.lit(kind).alias("kind"), F.lit("gcp").alias("provider"), F.lit("live").alias("source"), bag.alias("attrs"), F.lit("live:gcloud").alias("provenance")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def live_edges(docs: DataFrame) -> DataFrame:
    """Edges of live snapshots: by section, and who may invoke what."""
    parts = []
    for no, (section, name, _, names, _, edge) in enumerate(SECTIONS):
        if edge is None:
            continue
        items = _items(docs, section, name, no).select("seq", _get(F.col("item"), *names).alias("a"), _get(F.col("item"), *edge[1]).alias("b"))
        items = items.where("a is not null and b is not null and not startswith(b, '{')")
        parts.append(items.select("seq", T.norm_id("a").alias("src"), T.norm_id("b").alias("dst"), F.lit(edge[0]).alias("type"), F.lit(None).cast("string").alias("condition")))
    policies = _items(docs, "identity_invoke", "invoke_policies", 900)
    bindings = policies.select("seq", _get(F.col("item"), "service").alias("dst"), F.explode(F.from_json(F.get_json_object("item", "$.policy.bindings"), "array<struct<role:string,members:array<string>>>")).alias("b"))
    parts.append(bindings.where(F.col("b.role").contains("invoker")).select("seq", F.explode("b.members").alias("src"), "dst", F.lit("invokes").alias("type"), F.col("b.role").alias("condition")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("seq", "src", "dst", "type", F.lit("live").alias("source"), "condition", F.lit("live:gcloud").alias("provenance"))


def is_canonical(doc: Column | str = "doc") -> Column:
    """A document with a list of nodes is canonical already; others are live snapshots."""
    return F.coalesce(F.get_json_object(doc, "$.nodes").startswith("["), F.lit(False))


def canonical(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents of either shape."""
    ready = docs.where(is_canonical())
    nodes = ready.select(_number(docs), F.posexplode(F.from_json(F.get_json_object("doc", "$.nodes"), "array<struct<name:string,kind:string,provider:string,source:string,attrs:map<string,string>,provenance:string>>")).alias("seq", "n"))
    edges = ready.select(_number(docs), F.posexplode(F.from_json(F.get_json_object("doc", "$.edges"), "array<map<string,string>>")).alias("seq", "e"))
    get = lambda k: F.try_element_at("e", F.lit(k))
    seq = (F.shiftleft(F.col("_doc"), 44) + F.col("seq")).alias("seq")
    flat = edges.select(seq, get("from").alias("src"), get("to").alias("dst"), *(get(k).alias(k) for k in ("type", "source", "condition", "provenance")))
    live = docs.where(~is_canonical())
    return nodes.select(seq, "n.*").unionByName(live_nodes(live)), flat.unionByName(live_edges(live))


def grounding_facts(docs: DataFrame) -> DataFrame:
    """id, resolves, callers, guard_hints from files of either schema: a bare mapping, or one below `facts`."""
    facts = F.coalesce(F.get_json_object("doc", "$.facts"), F.col("doc"))
    rows = docs.select(F.explode(F.from_json(facts, "map<string,struct<resolves:boolean,callers:array<string>,guard_hints:array<string>>>")).alias("id", "f"))
    return rows.where("id <> '_meta'").select("id", "f.*")


def patches(docs: DataFrame) -> DataFrame:
    """page, seq and edge fields of {title: [edge]} files."""
    from edgeloom.sources.vault import _EDGES

    rows = docs.select(F.explode(F.from_json("doc", f"map<string,{_EDGES}>")).alias("page", "v"))
    return rows.select("page", F.posexplode("v").alias("seq", "e")).select("page", F.col("seq").cast("bigint").alias("seq"), "e.*")
