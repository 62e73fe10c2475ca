"""A survey of repositories: which pages a workspace needs, under a budget that defers and never drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.ordering import within_budget

# Root files and words in sources that tell what a repository is.
CONTAINER_MARKERS = ("Dockerfile", "cloudbuild.yaml")
DEPENDENCY_MARKERS = ("pyproject.toml", "package.json", "Makefile")
API_MARKERS = ("@mcp.tool", "FastMCP", "mcp_server", "FastAPI", "flask", "express")
DATASTORE_MARKERS = ("mongodb", "MongoClient", "pymongo", "motor", "bigquery", "BigQuery", "google.cloud.bigquery")
# Page types in order, their folders.
FOLDERS = {"service": "services", "component": "components", "api": "apis", "data-store": "data-stores", "infrastructure": "infrastructure"}
COST_PER_PAGE = 15_000


def survey(files: DataFrame) -> DataFrame:
    """repo, type, signals, type_no: the pages that files(repo, rel, text) call for. A repository without a marker at its
    root is none. Flags combine before the shuffle by repo."""
    root = F.instr("rel", "/") == 0

    tests = {m: root & (F.col("rel") == m) for m in CONTAINER_MARKERS + DEPENDENCY_MARKERS}
    tests |= {m: F.coalesce(F.col("text"), F.lit("")).contains(m) for m in API_MARKERS + DATASTORE_MARKERS}
    flag = {m: f"f{i}" for i, m in enumerate(tests)}  # markers differ in case only, columns must not
    flags = files.groupBy("repo").agg(*(F.bool_or(test).alias(flag[m]) for m, test in tests.items()))

    def present(markers):
        return F.filter(F.array(*(F.when(F.col(flag[m]), F.lit(m)) for m in markers)), lambda v: v.isNotNull())

    own = flags.select("repo", present(CONTAINER_MARKERS).alias("c"), present(DEPENDENCY_MARKERS).alias("d"), F.array_sort(present(API_MARKERS)).alias("a"), F.array_sort(present(DATASTORE_MARKERS)).alias("s")).where("size(c) + size(d) > 0")
    primary = F.struct(F.when(F.size("c") > 0, "service").otherwise("component").alias("type"), F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("d")).alias("signals"), F.lit(0).alias("type_no"))
    api = F.struct(F.lit("api").alias("type"), F.col("a").alias("signals"), F.lit(1).alias("type_no"))
    store = F.struct(F.lit("data-store").alias("type"), F.col("s").alias("signals"), F.lit(2).alias("type_no"))
    return own.select("repo", F.explode(F.array(primary, api, store)).alias("p")).where("size(p.signals) > 0").select("repo", "p.type", "p.signals", "p.type_no")


def page_inventory(surveyed: DataFrame, budget: int | None = None, cost: int = COST_PER_PAGE) -> DataFrame:
    """id, type, repo, title, path, signals, deferred, defer_reason for each surveyed page, in order of repo and type."""
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    title = F.when(F.col("type") == "api", F.concat("repo", F.lit(" API"))).when(F.col("type") == "data-store", F.concat("repo", F.lit(" data stores"))).otherwise(F.col("repo"))
    p = surveyed.select(F.concat_ws("/", "repo", "type").alias("id"), "type", "repo", title.alias("title"), F.concat(F.try_element_at(folder, F.col("type")), F.lit("/"), F.col("repo"), F.lit(".md")).alias("path"), "signals", "type_no")
    if budget is None:
        return p.withColumn("deferred", F.lit(False)).withColumn("defer_reason", F.lit(None).cast("string")).drop("type_no")
    p = within_budget(p, ["repo", "type_no"], budget, cost)
    return p.withColumn("defer_reason", F.when(F.col("deferred"), F.lit(f"budget of {budget} exceeded at {cost} a page"))).drop("type_no", "place")


def coverage(detected: DataFrame, covered: DataFrame) -> DataFrame:
    """repo, detected, covered, gaps: what was seen of a repository and has no page."""
    d = detected.groupBy("repo").agg(F.array_sort(F.collect_set("type")).alias("detected"))
    c = covered.groupBy("repo").agg(F.array_sort(F.collect_set("type")).alias("covered"))
    both = d.join(c, "repo", "full_outer")
    none = F.array().cast("array<string>")
    both = both.select("repo", F.coalesce("detected", none).alias("detected"), F.coalesce("covered", none).alias("covered"))
    return both.withColumn("gaps", F.array_except("detected", "covered"))
