"""Checks of a page store: each is a frame of findings (check, severity, page, message, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import graph

SEVERITIES = ("error", "warn", "info")
# Checks, in their order; page types that folders imply; fields required of all pages and of each type where
# the store has no schemas of its own.
CHECKS = ("schema", "links", "orphans", "staleness", "types", "sections")
FOLDER_TYPES = {
    "services": "service", "apis": "api", "components": "component", "data-stores": "data-store", "infrastructure": "infrastructure", "runbooks": "runbook",
    "external": "external-service", "touch-points": "touch-points", "deployed": "deployed-node",
}
REQUIRED_OF_ALL = ("title", "type", "status", "summary", "updated")
REQUIRED_OF_TYPE = {
    "service": ("repo", "depends_on", "part_of"), "api": ("part_of",), "component": ("part_of",), "data-store": (), "infrastructure": (), "runbook": (), "external-service": ("status",), "touch-points": ("part_of",),
    "deployed-node": ("node_kind", "declaration_source"),
}
# Exit codes.
PASSED, FAILED, NOTHING_ASSESSED, MISUSED = 0, 1, 3, 4
# Fields that hold coarse links.
LINK_FIELDS = ("depends_on", "part_of", "related_to", "documented_by", "supersedes", "owner")


def finding(df: DataFrame, check: str, severity: str | Column, message: Column, line: Column | None = None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(check).alias("check"), severity.alias("severity"), F.col("rel").alias("page"), message.alias("message"), (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"))


def required_fields(spark: SparkSession, declared: DataFrame | None = None) -> DataFrame:
    """type, field: what a store's own schemas declare(type, field); types without one have the fallback sets."""
    fallback = spark.createDataFrame([(t, f) for t, own in REQUIRED_OF_TYPE.items() for f in dict.fromkeys((*REQUIRED_OF_ALL, *own))], "type string, field string")
    if declared is None:
        return fallback
    return declared.select("type", "field").unionByName(fallback.join(declared.select("type").distinct(), "type", "left_anti"))


def check_schema(pages: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Missing frontmatter, title or type, types that are template tokens, and required(type, field) that are missing;
    without `required` the fallback sets are.

    Pages have fm map<string,string>; a field that is there but empty counts as missing.
    """
    required = required_fields(pages.sparkSession) if required is None else required
    fm = pages.where("fm_present and parse_error is null")
    none = finding(pages.where("not fm_present"), "schema", "error", F.lit("no frontmatter"))
    unreadable = finding(pages.where("parse_error is not null"), "schema", "error", F.concat(F.lit("unreadable frontmatter: "), F.col("parse_error")))
    basic = fm.select("rel", "fm", F.explode(F.array(F.lit("title"), F.lit("type"))).alias("field")).where(F.coalesce(F.try_element_at("fm", F.col("field")), F.lit("")) == "")
    token = finding(fm.where(T.has_template_token("type")), "schema", "error", F.concat(F.lit("type is a template token: "), F.col("type")))
    asked = fm.join(required.withColumnRenamed("field", "_field"), "type").where(~F.col("_field").isin("title", "type")).where(F.coalesce(F.try_element_at("fm", F.col("_field")), F.lit("")) == "")
    parts = [none, unreadable, token, finding(basic, "schema", "error", F.concat(F.lit("missing "), F.col("field"))), finding(asked, "schema", "error", F.concat(F.lit("missing required field "), F.col("_field")))]
    return _all(parts)


def check_links(coarse: DataFrame, runtime: DataFrame, names: DataFrame) -> DataFrame:
    """Coarse and runtime links to no page, and names that several pages claim. Links have rel, dst."""
    c = finding(graph.broken(coarse, names), "links", "error", F.concat(F.lit("broken link to "), F.col("dst")))
    r = finding(graph.broken(runtime, names), "links", "error", F.concat(F.lit("broken runtime target "), F.col("dst")))
    owned = names.groupBy("key").agg(F.min_by("rel", F.struct("rank", "walk_no")).alias("_owner"), F.count_distinct("rel").alias("_n")).where("_n > 1")
    clash = names.where("rank = 0").join(owned, "key").where("rel <> _owner").select("rel", "key", "_owner").distinct()
    return _all([c, r, finding(clash, "links", "error", F.concat(F.lit("title collides with "), F.col("_owner")))])


def check_orphans(pages: DataFrame, coarse: DataFrame, runtime: DataFrame) -> DataFrame:
    """Pages that nothing links to: a warning, or only a note if runtime edges reach them.

    coarse(src_rel, page, direction) and runtime(src_rel, page) are resolved; links to oneself do not count, and a
    bidirectional field counts for its source too.
    """
    c = coarse.where("page is not null and page <> src_rel")
    inbound = c.select(F.col("page").alias("rel")).union(c.where("direction = 'bidirectional'").select(F.col("src_rel").alias("rel"))).distinct()
    run = runtime.where("page is not null and page <> src_rel").select(F.col("page").alias("rel")).distinct().withColumn("_run", F.lit(True))
    lone = pages.join(inbound, "rel", "left_anti").join(run, "rel", "left")
    reached = F.col("_run").isNotNull()
    return finding(lone, "orphans", F.when(reached, "info").otherwise("warn"), F.when(reached, F.lit("only runtime edges lead here")).otherwise(F.lit("no link leads here")))


def check_staleness(pages: DataFrame, edges: DataFrame, now: str, max_age_days: float | None = None) -> DataFrame:
    """Edges without a stamp, pages without a date of update or with one that cannot be read, and those older than a
    budget, if one is given. edges have rel, extracted_from."""
    bare = finding(edges.where("extracted_from is null").groupBy("rel").agg(F.count("*").alias("_n")), "staleness", "warn", F.concat(F.col("_n").cast("string"), F.lit(" edges without a freshness stamp")))
    p = pages.withColumn("_at", F.try_to_timestamp("updated"))
    undated = finding(p.where("updated is null or updated = ''"), "staleness", "warn", F.lit("no date of update"))
    odd = finding(p.where("updated <> '' and _at is null"), "staleness", "warn", F.concat(F.lit("date cannot be read: "), F.col("updated")))
    parts = [bare, undated, odd]
    if max_age_days is not None:
        old = p.withColumn("_age", T.age_days("updated", F.lit(now))).where(F.col("_age") > max_age_days)
        parts.append(finding(old, "staleness", "warn", F.format_string("updated %d days ago", F.floor("_age"))))
    return _all(parts)


def check_types(pages: DataFrame, folders: dict[str, str] | None = None) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in (folders or FOLDER_TYPES).items() for x in kv])
    wrong = pages.withColumn("_want", F.try_element_at(table, F.substring_index("rel", "/", 1))).where("_want is not null and type is not null and type <> _want and instr(rel, '/') > 0")
    return finding(wrong, "types", "warn", F.concat(F.lit("type is "), F.col("type"), F.lit(", the folder implies "), F.col("_want")))


def lines_of(pages: DataFrame) -> DataFrame:
    """rel, line, text, fenced, level (of a heading, else null): bodies line by line; code fences are not text."""
    rows = pages.select("rel", "curation", F.posexplode(F.split("body", "\n")).alias("_i", "text")).withColumn("line", F.col("_i") + 1)
    fence = F.trim("text").startswith("```")
    w = W.partitionBy("rel").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_f", F.sum(fence.cast("int")).over(w)).withColumn("fenced", fence | (F.col("_f") % 2 == 1))
    mark = F.regexp_extract("text", r"^(#{1,6})\s+\S", 1)
    return rows.withColumn("level", F.when(~F.col("fenced") & (mark != ""), F.length(mark))).drop("_i", "_f")


def check_sections(pages: DataFrame) -> DataFrame:
    """Headings with nothing below (but for a deeper heading, and on skeleton pages); each placeholder, in code fences too;
    each template token outside them."""
    lines = lines_of(pages)
    text = lines.where("level is null").where(F.trim("text") != "")
    heads = lines.where("level is not null")
    w = W.partitionBy("rel").orderBy("line")
    marks = heads.select("rel", "line", "level", "text", "curation", F.lit(True).alias("h")).unionByName(text.select("rel", "line", F.lit(None).cast("int").alias("level"), "text", "curation", F.lit(False).alias("h")))
    after = marks.withColumn("_next_h", F.lead("h").over(w)).withColumn("_next_level", F.lead("level").over(w))
    bare = after.where("h and coalesce(curation, '') <> 'skeleton' and (_next_h is null or (_next_h and _next_level <= level))")
    left = lines.select("rel", "line", F.explode(T.placeholders_in("text")).alias("found"))
    tokens = lines.where(~F.col("fenced")).select("rel", "line", F.explode(T.template_tokens_in("text")).alias("found"))
    parts = [
        finding(bare, "sections", "error", F.concat(F.lit("empty section: "), F.trim("text")), F.col("line")),
        finding(left, "sections", "error", F.concat(F.lit("placeholder "), F.col("found")), F.col("line")),
        finding(tokens, "sections", "error", F.concat(F.lit("template token "), F.col("found")), F.col("line")),
    ]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pivot(findings: DataFrame) -> DataFrame:
    """check, error, warn, info: counts, 0 where there is none."""
    return findings.groupBy("check").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def outcome(findings: DataFrame, assessed: DataFrame) -> DataFrame:
    """One row: status red, green or nothing-assessed; no page assessed is never green."""
    n = assessed.agg(F.count("*").alias("assessed"))
    bad = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"))
    return n.join(bad, how="cross").withColumn("status", F.when(F.col("assessed") == 0, "nothing-assessed").when(F.col("errors") > 0, "red").otherwise("green"))  # one row each


def selected(check: str = "all") -> tuple[str, ...]:
    """The checks that a comma-separated list names; an unknown name is an error."""
    wanted = CHECKS if check == "all" else tuple(c.strip() for c in check.split(","))
    if unknown := [c for c in wanted if c not in CHECKS]:
        raise ValueError(f"no such check: {', '.join(unknown)} (there are {', '.join(CHECKS)})")
    return wanted


def lint(findings: dict[str, DataFrame], check: str = "all") -> DataFrame:
    """The findings of the selected checks, of those given by name."""
    chosen = [findings[c] for c in selected(check) if c in findings]
    if not chosen:
        raise ValueError("none of the selected checks was run")
    return _all(chosen)


def exit_code(findings: DataFrame, assessed: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: assessed, errors, warnings, infos, code. No page assessed is never a pass; errors fail, warnings do if
    fail_on is warn, notes never do."""
    if fail_on not in ("error", "warn"):
        raise ValueError(f"fail_on is error or warn, not {fail_on!r}")
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(n) for s, n in zip(SEVERITIES, ("errors", "warnings", "infos"), strict=True)))
    bad = (F.col("errors") > 0) | ((F.col("warnings") > 0) if fail_on == "warn" else F.lit(False))
    one = assessed.agg(F.count("*").alias("assessed")).join(counts, how="cross")  # one row each
    return one.withColumn("code", F.when(F.col("assessed") == 0, NOTHING_ASSESSED).when(bad, FAILED).otherwise(PASSED))


# Known edge types.
EDGE_TYPES = (
    "http-call", "mcp-fanout", "dynamic", "shares-datastore", "data-store", "invokes", "subscribes-to", "publishes-to", "deploy-env", "runs-as", "in-dataset", "reads-from",
    "triggers", "routes-to", "reads-secret", "part-of-network", "fronted-by", "firewall-allows", "domain-maps-to", "dns-resolves-to",
)


def edge_problems(edges: DataFrame) -> DataFrame:
    """edges(target, type, provenance, extracted_from) with `problems`: everything wrong with each, not only the first."""
    link = F.col("target")
    tests = [
        (link.isNull() | (F.trim(link) == ""), "no target"),
        (link.isNotNull() & ~link.rlike(r"^\s*\[\[.+\]\]\s*$"), "target is not a link"),
        (F.col("type").isNull(), "no type"),
        (F.col("type").isNotNull() & ~F.col("type").isin(*EDGE_TYPES), "unknown type"),
        (F.coalesce(F.col("provenance"), F.lit("")) == "", "no provenance"),
        (F.col("extracted_from").isNull(), "no freshness stamp"),
        (F.col("extracted_from").isNotNull() & F.col("extracted_from.repo").isNull(), "stamp without repo"),
        (F.col("extracted_from").isNotNull() & F.col("extracted_from.sha").isNull(), "stamp without sha"),
        (F.col("extracted_from").isNotNull() & F.col("extracted_from.at").isNull(), "stamp without time"),
    ]
    return edges.withColumn("problems", F.filter(F.array(*(F.when(t, F.lit(m)) for t, m in tests)), lambda p: p.isNotNull()))


def strict_pages(checked: DataFrame) -> DataFrame:
    """page, accepted: a page with any rejected edge is skipped as a whole."""
    return checked.groupBy("page").agg(F.bool_and(F.size("problems") == 0).alias("accepted"), F.sum(F.size("problems")).alias("n_problems"))
