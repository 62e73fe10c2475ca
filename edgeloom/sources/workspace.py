"""A workspace: its configuration, source files, service registry and repository heads."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Endings of files that a survey reads, and the largest that it reads.
SCANNED = (".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".go", ".rb", ".java", ".kt", ".rs", ".yaml", ".yml", ".toml", ".json", ".txt", ".md", ".tf", ".tfvars")
LARGEST = 1_000_000
# Endings of files that an extractor reads, wherever they are and of any size; each skips folders of its own.
EXTRACTED = (".py", ".js", ".ts", ".tf", ".tfvars")


@dataclass
class Config:
    workspace: str
    repos: dict[str, str]
    services: dict[str, str] = field(default_factory=dict)
    pages: dict[str, str] = field(default_factory=dict)
    service_pages: dict[str, str] = field(default_factory=dict)
    fanout_page: str = "Gateway"
    registry: list[str] = field(default_factory=list)
    environments: dict[str, dict] = field(default_factory=dict)
    languages: tuple[str, ...] = ("python", "javascript")
    ground: bool = False

    def tfvars(self, env: str | None) -> dict[str, list[str]]:
        """repository -> variable files of an environment; an environment that is not configured is an error."""
        if env is None:
            return {}
        if env not in self.environments:
            raise KeyError(f"no environment {env!r}; there are {sorted(self.environments)}")
        spec = self.environments[env].get("tfvars", {})
        return {repo: [f"{repo}/{p}" for p in ([files] if isinstance(files, str) else files)] for repo, files in spec.items()}


def read_config(text: str) -> Config:
    import tomllib

    c = tomllib.loads(text)
    emit = c.get("emit", {})
    sections = [v for v in c.values() if isinstance(v, dict)]
    base = next((s for s in sections if "workspace" in s), None)
    if base is None:
        raise KeyError("no section names a workspace")
    stages = next((s for s in sections if "languages" in s or "ground" in s), {})
    return Config(
        workspace=base["workspace"], repos=c.get("repos", {}), services=c.get("services", {}), pages=emit.get("pages", {}), service_pages=emit.get("service_pages", {}), fanout_page=emit.get("fanout_page", "Gateway"),
        registry=c.get("registry", {}).get("service_config", []), environments=c.get("cloud", {}).get("environments", {}), languages=tuple(stages.get("languages", ("python", "javascript"))), ground=bool(stages.get("ground", False)),
    )


def listed(root: str, suffixes: tuple[str, ...] = SCANNED, largest: int = LARGEST) -> list[tuple[str, bool, bool]]:
    """(relative path, surveyed, extracted) of the files below root, in order. A survey leaves out oversized files and
    folders that are hidden, begin with _ or are node_modules; names without an ending (Dockerfile, Makefile) are in it."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for folder, _, names in os.walk(root):
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        parts = [] if inner == "." else inner.split("/")
        pruned = any(p.startswith((".", "_")) or p == "node_modules" for p in parts)
        for name in names:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                surveyed = not pruned and ("." not in name or name.endswith(suffixes)) and os.path.getsize(path) <= largest
                extracted = name.endswith(EXTRACTED) or (len(parts) < 2 and name.startswith("cloudbuild") and name.endswith(".yaml"))
                out.append(("/".join([*parts, name]), surveyed, extracted))
    return sorted(out)


def source_files(spark: SparkSession, workspace: str, repos: dict[str, str], suffixes: tuple[str, ...] = SCANNED, largest: int = LARGEST, named: tuple[str, ...] = ()) -> DataFrame:
    """repo, rel (repository/path), text, surveyed: each file that a survey or an extractor reads, or that `named` holds
    by its rel, is one row. surveyed: whether the survey's rules keep it.

    Spark's own readers never list names that begin with _ or ., so the driver walks the folders; they must be such that
    every executor can open them.
    """
    rows = []
    for repo, folder in sorted(repos.items()):
        root = f"{workspace.rstrip('/')}/{folder.strip('/')}"
        rows += [(repo, f"{repo}/{rel}", f"{root}/{rel}", surveyed) for rel, surveyed, extracted in listed(root, suffixes, largest) if surveyed or extracted or f"{repo}/{rel}" in named]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                with open(r["path"], "rb") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"repo": [r["repo"]], "rel": [r["rel"]], "text": [text], "surveyed": [r["surveyed"]]})

    paths = spark.createDataFrame(rows, "repo string, rel string, path string, surveyed boolean")
    return paths.repartition(max(1, -(-len(rows) // 500))).mapInArrow(read, "repo string, rel string, text string, surveyed boolean")


def registry_services(files: DataFrame) -> DataFrame:
    """name, url, rel: in service registries(rel, text), each two-space-indented `name:` with the first `url:` after it."""
    lines = files.select("rel", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    name = F.regexp_extract("line", r"^  ([A-Za-z][\w-]*):\s*$", 1)
    url = F.regexp_extract("line", r"""^\s*url:\s*["']?([^"'\s]+)""", 1)
    marked = lines.select("rel", "n", F.when(name != "", F.struct("n", name.alias("name"))).alias("m"), F.when(url != "", url).alias("url"))
    w = W.partitionBy("rel").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    owned = marked.withColumn("m", F.last("m", ignorenulls=True).over(w)).where("url is not null and m is not null")
    return owned.groupBy("rel", F.col("m.n").alias("at")).agg(F.min_by(F.struct(F.col("m.name").alias("name"), "url"), "n").alias("r")).select("r.name", "r.url", "rel", "at")


def fanout_sites(services: DataFrame) -> DataFrame:
    """Call sites of the configured fan-out: one for each registered service."""
    return services.select(
        F.lit("mcp-fanout").alias("kind"), F.lit("(config)").alias("src_repo"), F.lit("service-registry").alias("src_symbol"), F.lit("(config)").alias("src_file"), F.lit(0).alias("src_line"), F.concat(F.lit("svc:"), "name").alias("target_service"), F.col("url").alias("target_endpoint"),
        F.lit("present in active instance config").alias("condition"), F.lit("high").alias("confidence"),
    )


def registry_nodes(services: DataFrame) -> DataFrame:
    return services.select(F.col("at").cast("bigint").alias("seq"), "name", F.lit("mcp-server").alias("kind"), F.lit("static").alias("provider"), F.lit("config registry (no local source)").alias("source"), F.create_map(F.lit("url"), "url").alias("attrs"), F.col("rel").alias("provenance"))


def staged_reads(nodes: DataFrame) -> DataFrame:
    """Reads by external warehouse tables of the collections staged for them."""
    staged = F.try_element_at("attrs", F.lit("staged_collection"))
    external = F.try_element_at("attrs", F.lit("external")) == "true"
    rows = nodes.where((F.col("kind") == "datastore-bq-table") & external & staged.isNotNull())
    return rows.select("repo", F.lit("mongo").alias("store"), staged.alias("collection"), F.lit("read").alias("mode"), F.concat("provenance", F.lit(" (bq external table)")).alias("provenance"), F.lit(None).cast("string").alias("model"))


def repo_head(path: str) -> tuple[str | None, str | None]:
    """(sha, error) of a work tree; what does not look like a revision is none."""
    try:
        run = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired) as e:
        return None, str(e)
    sha = run.stdout.strip()
    return (sha, None) if run.returncode == 0 and re.fullmatch(r"[0-9a-f]{7,64}", sha) else (None, run.stderr.strip() or f"no revision: {sha!r}")


def heads(spark: SparkSession, workspace: str, repos: dict[str, str], head=repo_head) -> DataFrame:
    """repo, head, error: one row for each configured repository."""
    rows = [(r, *head(os.path.join(workspace, p))) for r, p in sorted(repos.items())]
    return spark.createDataFrame(rows, "repo string, head string, error string")


def stamp(frame: DataFrame, heads_: DataFrame, now: str, repo: str = "src_repo") -> DataFrame:
    """frame with extracted_from: the head of its repository, "unknown" where none can be read."""
    joined = frame.join(heads_.select(F.col("repo").alias("_r"), F.col("head").alias("_h")), F.col(repo) == F.col("_r"), "left")
    return joined.withColumn("extracted_from", F.struct(F.col(repo).alias("repo"), F.coalesce("_h", F.lit("unknown")).alias("sha"), F.lit(now).alias("at"))).drop("_r", "_h")
