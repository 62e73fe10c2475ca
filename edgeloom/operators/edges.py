"""Call sites to logical edges: hints, the resolution ladder, merging, the grounding gate, edge classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T

#: most literals that one template is expanded to
MAX_VARIANTS = 4


def resolve_hints(sites: DataFrame, hints: DataFrame, expr: str = "base_expr", generic: str = "base_url") -> DataFrame:
    """sites with service, via and confidence of the longest hint that the lower-cased expression ends with, else nulls.

    hints: suffix, service, seq. Not a theta join: the endings of each distinct expression, of the lengths that hints
    have, are joined by equality, and the expression's hint is joined back to its sites. Nothing identifies a site, so
    it does not matter how sites are partitioned. Hints of equal length: the earlier in the table.
    """
    table = hints.select(F.lower("suffix").alias("_ending"), F.col("suffix").alias("_suffix"), F.col("service").alias("_service"), F.col("seq").alias("_seq")).where("_ending <> ''")
    lengths = table.agg(F.collect_set(F.length("_ending")).alias("_lengths"))  # one row; not more numbers than the longest hint has characters
    low = F.lower(F.coalesce(F.col(expr), F.lit("")))
    distinct = sites.select(low.alias("_low")).distinct().crossJoin(F.broadcast(lengths))
    endings = distinct.select("_low", F.explode(F.filter("_lengths", lambda n: n <= F.length("_low"))).alias("_n")).select("_low", F.expr("right(_low, _n)").alias("_ending"))
    best = endings.join(table, "_ending").groupBy("_low").agg(F.max_by(F.struct("_service", "_suffix"), F.struct(F.length("_ending"), -F.col("_seq"))).alias("_h"))
    found = sites.withColumn("_low", low).join(best, "_low", "left")
    return found.select(
        *sites.columns, F.col("_h._service").alias("service"), F.when(F.col("_h").isNotNull(), F.concat(F.lit("config-var "), F.col("_h._suffix"))).alias("via"),
        F.when(F.col("_h").isNotNull(), F.when(F.lower("_h._suffix") == generic, "med").otherwise("high")).alias("confidence"),
    )


def ladder(*rungs: tuple[Column, Column, Column]) -> Column:
    """struct(service, via, confidence) of the first rung whose service is not null."""
    return F.coalesce(*(F.when(s.isNotNull(), F.struct(s.alias("service"), v.alias("via"), c.alias("confidence"))) for s, v, c in rungs))


def logical_edges(sites: DataFrame) -> DataFrame:
    """Call sites merged by (src_repo, target_service, endpoint family); the weakest confidence stands for the edge.

    Kind and stamp are the first site's; call sites are ordered by provenance rank, then as they came; sets are sorted.
    """
    s = sites.withColumn("endpoint_family", T.endpoint_family("target_endpoint"))
    rank = F.coalesce("prov_rank", F.lit(5))
    site = F.concat(F.col("src_file"), F.lit(":"), F.col("src_line").cast("string"))
    return s.groupBy("src_repo", "target_service", "endpoint_family").agg(
        F.min("seq").alias("seq"),
        F.min_by("kind", "seq").alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("seq").alias("s"), site.alias("v")))), lambda x: x["v"]).alias("call_sites"),
        F.array_sort(F.collect_set(F.when(F.col("condition") != "", F.col("condition")))).alias("conditions"),
        F.array_sort(F.collect_set("src_symbol")).alias("symbols"),
        F.array_sort(F.collect_set("confidence")).alias("confidences"),
        F.min_by("confidence", T.confidence_rank("confidence")).alias("confidence_summary"),
        F.min_by("endpoint_expr", F.when(F.col("endpoint_expr").isNotNull(), F.col("seq"))).alias("endpoint_expr"),
        F.array_sort(F.collect_set("unresolved_expr")).alias("unresolved_exprs"),
        F.array_sort(F.collect_set("lang")).alias("langs"),
        F.min_by("extracted_from", "seq").alias("extracted_from"),
        F.count("*").alias("n_call_sites"),
    )


def logical_edge_summary(sites: DataFrame) -> DataFrame:
    """As logical_edges, in scalars only, which all combine before the shuffle: no list grows with a hot target."""
    s = sites.withColumn("endpoint_family", T.endpoint_family("target_endpoint"))
    site = F.concat(F.col("src_file"), F.lit(":"), F.col("src_line").cast("string"))
    return s.groupBy("src_repo", "target_service", "endpoint_family").agg(
        F.min_by("kind", "seq").alias("kind"),
        F.min_by(site, F.struct(F.coalesce("prov_rank", F.lit(5)), F.col("seq"))).alias("provenance"),
        F.min_by("confidence", T.confidence_rank("confidence")).alias("confidence_summary"),
        F.count("*").alias("n_call_sites"),
    )


def grounding_gate(edges: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """edges with `grounded`; those whose fact says that they do not resolve are dropped, those without a fact stay.

    facts: key, resolves.
    """
    joined = edges.join(facts.select(key, F.col("resolves").alias("_r"), F.lit(True).alias("_known")), key, "left")
    kept = joined.where(~F.coalesce(F.col("_r") == F.lit(False), F.lit(False)))
    return kept.withColumn("grounded", F.coalesce("_r", F.lit(False))).drop("_r", "_known")


def check_grounding(meta: dict | None, required: bool, allow_ungrounded: bool = False) -> str:
    """The gate's state; raises if grounding is required and did not succeed or grounded nothing."""
    if required and not allow_ungrounded:
        if meta is None:
            raise ValueError("grounding is required, but its file says nothing about how it was made")
        if not meta.get("ok") or not meta.get("edges_grounded", 1):
            raise ValueError(f"grounding is required, but did not succeed: {meta}")
        return "enforced"
    return "bypassed" if required else "off"


def edge_class(kind: str | Column = "kind") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "dynamic", F.lit("dynamic")).otherwise(F.lit("resolved"))


def of_class(edges: DataFrame, wanted: str = "all", kind: str = "kind") -> DataFrame:
    """Edges of a class: all, resolved or dynamic; any other name is an error."""
    if wanted not in ("all", "resolved", "dynamic"):
        raise ValueError(f"no edge class {wanted!r}")
    return edges if wanted == "all" else edges.where(edge_class(kind) == wanted)


def touching(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def expand_variants(sites: DataFrame, values: DataFrame, most: int = MAX_VARIANTS) -> DataFrame:
    """sites(site, endpoint) with one placeholder {name} replaced by each of its values(name, value, condition); more than
    `most` values leave the template as it is."""
    own = sites.withColumn("_name", F.regexp_extract("endpoint", r"\{self\.(\w+)\}", 1))
    known = values.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("value", "condition"))).alias("_v"))
    found = own.join(known.withColumnRenamed("name", "_name"), "_name", "left")
    keep = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("condition")))
    few = F.col("_v").isNotNull() & (F.size("_v") <= most)
    each = found.withColumn("_x", F.explode(F.when(few, F.col("_v")).otherwise(keep)))
    return each.select(
        *[c for c in sites.columns if c != "endpoint"], F.when(F.col("_x.value").isNull(), F.col("endpoint")).otherwise(F.replace(F.col("endpoint"), F.concat(F.lit("{self."), F.col("_name"), F.lit("}")), F.col("_x.value"))).alias("endpoint"), F.col("_x.condition").alias("condition"),
    )


def coverage(edges: DataFrame) -> DataFrame:
    """One row: how many edges there are, are resolved, have a condition, have an owner."""
    return edges.agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("kind") != "dynamic").alias("n_resolved"), F.count_if(F.col("condition").isNotNull()).alias("n_conditioned"), F.count_if(F.col("confidence") == "high").alias("n_high"),
    )


def histogram(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by).agg(F.count("*").alias("n"))


def family_alarm(edges: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """One row: for each family of edge types the number of edges; a family at zero is what the alarm is for."""
    return edges.agg(*(F.count_if(F.col("kind").isin(types)).alias(name) for name, types in families.items()))
