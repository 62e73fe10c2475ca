"""Freshness in three values: current, stale, unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T

RANK = {"current": 0, "unknown": 1, "stale": 2}


def assess(records: DataFrame, heads: DataFrame, now: str | None = None, max_age_days: float | None = None) -> DataFrame:
    """records(page, repo, sha, at, ...) with status and reason, by heads(repo, head).

    A record without repo or sha, with the sha "unknown", or whose repo has no readable head, is unknown: none of those
    is current, and nothing says that its source moved. Shas match if one begins with the other.
    """
    r = records.join(heads.select("repo", "head"), "repo", "left")
    bare = F.coalesce(F.col("repo"), F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(F.col("sha"), F.lit("")).eqNullSafe(F.lit(""))
    moved = ~(F.col("head").startswith(F.col("sha")) | F.col("sha").startswith(F.col("head")))
    old = F.lit(False)
    if max_age_days is not None:
        old = F.coalesce(T.age_days("at", F.lit(now)) > max_age_days, F.lit(False))
    reason = (
        F.when(bare, "no stamp")
        .when((F.col("sha") == "unknown") & (F.col("repo") == "(config)"), "from configuration")
        .when(F.col("sha") == "unknown", "revision was not readable")
        .when(F.col("head").isNull(), "head is not readable")
        .when(moved, "source moved")
        .when(old, "too old")
        .otherwise("matches head")
    )
    status = F.when(reason.isin("source moved", "too old"), "stale").when(reason == "matches head", "current").otherwise("unknown")
    return r.withColumn("reason", reason).withColumn("status", status)


def _rank():
    return F.when(F.col("status") == "stale", 2).when(F.col("status") == "unknown", 1).otherwise(0)


def worst_per_page(assessed: DataFrame, page: str = "page") -> DataFrame:
    return assessed.groupBy(page).agg(F.max_by("status", _rank()).alias("status"), F.count("*").alias("n_edges"))


def summary(assessed: DataFrame) -> DataFrame:
    return assessed.agg(F.count("*").alias("edges"), *(F.count_if(F.col("status") == s).alias(s) for s in RANK))


def exit_code(edges: int, stale: int, unknown: int, parse_errors: int = 0) -> int:
    """2: something could not be read or assessed; 3: nothing to assess; 1: stale; 0: all current."""
    return 2 if parse_errors else 3 if not edges else 1 if stale else 2 if unknown else 0


def backfill(records: DataFrame, directories: DataFrame, now: str) -> DataFrame:
    """Patches for records(page, target, type, endpoint, provenance, repo, sha) without a stamp: their repo is read off the
    provenance's first segment by directories(dir, repo), and their sha is "unknown", never today's."""
    bare = records.where("repo is null or sha is null or sha = ''").drop("repo", "sha", "at")
    head = F.substring_index("provenance", "/", 1)
    found = bare.withColumn("_dir", head).join(directories.select(F.col("dir").alias("_dir"), F.col("repo").alias("_repo")), "_dir", "left")
    return found.withColumn("repo", F.coalesce("_repo", F.when(F.col("_dir") != "", F.col("_dir")), F.lit("unknown"))).withColumn("sha", F.lit("unknown")).withColumn("at", F.lit(now)).withColumn("backfilled", F.lit(True)).drop("_dir", "_repo")
