"""The write door: idempotent upserts of edge patches into pages, aliases and the sync manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T

KEY = ("target", "type", "endpoint")


def edge_key(target: str = "target", kind: str = "type", endpoint: str = "endpoint") -> list[Column]:
    return [T.normalize_title(T.strip_wikilink(target)), F.col(kind), F.col(endpoint)]


def upsert(stored: DataFrame, incoming: DataFrame, page: str = "page", key: list[Column] | None = None, fresh: tuple[str, ...] = ("extracted_from",), seq: str = "seq") -> DataFrame:
    """The stored edges, their nulls filled from the incoming edge with their key (`fresh` columns: the incoming one wins),
    and the incoming edges whose key is new. Doing it twice changes nothing.

    Of stored duplicates the first owns the key, the others stay as they are; of incoming ones the last counts.
    Both sides shuffle once by (page, key).
    """
    key = key or edge_key()
    names = [f"_k{i}" for i in range(len(key))]
    keyed = [F.col(page).alias("_page"), *(F.coalesce(k.cast("string"), F.lit("")).alias(n) for k, n in zip(key, names, strict=True))]
    columns = [c for c in stored.columns if c not in (page, seq)]
    s = stored.select(page, seq, *columns, *keyed)
    owner = s.groupBy("_page", *names).agg(F.min(seq).alias("_own"))
    last = incoming.select(*keyed, F.struct(*columns).alias("_r"), F.col(seq).alias("_s")).groupBy("_page", *names).agg(F.max_by("_r", "_s").alias("_in"))
    both = s.join(owner, ["_page", *names]).withColumn("_mine", F.col(seq) == F.col("_own")).join(last.withColumn("_mine", F.lit(True)), ["_page", *names, "_mine"], "full_outer")
    return both.select(
        F.coalesce(page, "_page").alias(page), F.col(seq), *((F.coalesce(F.col(f"_in.{c}"), F.col(c)) if c in fresh else F.coalesce(F.col(c), F.col(f"_in.{c}"))).alias(c) for c in columns),
        F.when(F.col(seq).isNull(), "added").when(F.col("_in").isNotNull(), "merged").otherwise("kept").alias("outcome"),
    )


def select_patches(patches: DataFrame, exclude_types: list[str] = (), only_pages: list[str] = ()) -> DataFrame:
    out = patches.where(~F.col("type").isin(list(exclude_types))) if exclude_types else patches
    return out.where(F.col("page").isin(list(only_pages))) if only_pages else out


def fail_on_unreadable(pages: DataFrame) -> DataFrame:
    """pages as they are; reading a row whose earlier block could not be parsed fails the job."""
    ok = F.when(F.col("parse_error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable block on "), F.col("rel")))).otherwise(F.lit(True))
    return pages.where(ok)


def populate_aliases(pages: DataFrame) -> DataFrame:
    """pages whose title has typographic dashes or spaces, with its plain spelling among the aliases unless an equal one is."""
    alias = T.ascii_alias("title")
    have = F.coalesce("aliases", F.array().cast("array<string>"))
    missing = T.has_punctuation("title") & ~F.exists(have, lambda a: T.normalize_title(a) == T.normalize_title(alias)) & (alias != F.col("title"))
    return pages.withColumn("aliases", F.when(F.coalesce(missing, F.lit(False)), F.array_append(have, alias)).otherwise(F.col("aliases")))


def upsert_manifest(manifest: DataFrame, run: DataFrame, now: str) -> DataFrame:
    """repo, last_commit, last_sync, sync_count, pages: repos are matched by normalised name, pages united, counts raised."""
    m = manifest.withColumn("_k", T.normalize_title("repo"))
    r = run.groupBy(T.normalize_title("repo").alias("_k")).agg(F.min("repo").alias("_repo"), F.max("last_commit").alias("_commit"), F.array_distinct(F.flatten(F.collect_list("pages"))).alias("_pages"))
    none = F.array().cast("array<string>")
    both = m.join(r, "_k", "full_outer")
    hit = F.col("_repo").isNotNull()
    return both.select(
        F.coalesce("repo", "_repo").alias("repo"), F.coalesce("_commit", "last_commit").alias("last_commit"), F.when(hit, F.lit(now)).otherwise(F.col("last_sync")).alias("last_sync"),
        (F.coalesce("sync_count", F.lit(0)) + hit.cast("int")).alias("sync_count"), F.array_sort(F.array_union(F.coalesce("pages", none), F.coalesce("_pages", none))).alias("pages"),
    )
