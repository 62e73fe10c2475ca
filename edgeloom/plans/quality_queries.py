"""Checks, freshness, upserts, surveys and questions bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import drift, evaluation, graph, inventory, merge, quality
from edgeloom.plans.graph_queries import _LINKS, part_links, part_pages
from edgeloom.plans.registry import query, table


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages with planted defects."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    title = F.when(k % 11 != 0, F.concat(F.lit("Doc "), k))
    kind = F.when(k % 13 == 0, "<page type>").when(k % 7 != 0, "service")
    fm = F.map_filter(F.create_map(F.lit("title"), title, F.lit("type"), kind, F.lit("summary"), F.when(k % 3 == 0, F.col("source")), F.lit("status"), F.lit("active")), lambda n, v: v.isNotNull())
    body = F.concat(F.lit("# Head\n"), F.when(k % 2 == 0, F.lit("text\n")).otherwise(F.lit("")), F.lit("## One\n"), F.when(k % 3 == 0, F.lit("TODO later, coming soon\n")).otherwise(F.lit("see https://<service>.run\n")), F.lit("```\nTODO <token two>\n```\n"), F.when(k % 5 == 0, F.lit("## Two\n")).otherwise(F.lit("a <token here> <A|b> <ab>\n")))
    return d.select(
        F.concat(F.when(k % 4 == 0, "apis/").when(k % 9 == 0, "deployed/").otherwise("services/"), F.col("source"), F.lit("/"), k, F.lit(".md")).alias("rel"), k.alias("walk_no"), title.alias("title"), kind.alias("type"), fm.alias("fm"), (k % 17 != 0).alias("fm_present"),
        F.when(k % 19 == 0, "line 3").alias("parse_error"), F.when(k % 23 == 0, F.lit("soon")).when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("updated"),
        body.alias("body"), F.when(k % 29 == 0, "skeleton").alias("curation"),
    )


_DOCS = """
    with p as (select doc_id k, case when doc_id % 4 = 0 then 'apis/' when doc_id % 9 = 0 then 'deployed/' else 'services/' end || source || '/' || doc_id || '.md' page, case when doc_id % 11 <> 0 then 'Doc ' || doc_id end title,
        case when doc_id % 13 = 0 then '<page type>' when doc_id % 7 <> 0 then 'service' end as type, doc_id % 17 <> 0 fm, case when doc_id % 19 = 0 then 'line 3' end err,
        case when doc_id % 23 = 0 then 'soon' when doc_id % 5 <> 0 then '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') end updated, case when doc_id % 3 = 0 then source end summary from documents)
"""


@query(_DOCS + """
    select 'schema' as "check", 'error' severity, page, 'no frontmatter' message from p where not fm
    union all select 'schema', 'error', page, 'unreadable frontmatter: ' || err from p where err is not null
    union all select 'schema', 'error', page, 'missing title' from p where fm and err is null and title is null
    union all select 'schema', 'error', page, 'missing type' from p where fm and err is null and type is null
    union all select 'schema', 'error', page, 'type is a template token: <page type>' from p where fm and err is null and type = '<page type>'
    union all select 'schema', 'error', page, 'missing required field summary' from p where fm and err is null and type = 'service' and summary is null""")
def lint_schema(spark: SparkSession, sf: str) -> DataFrame:
    required = spark.createDataFrame([("service", "title"), ("service", "summary"), ("service", "status"), ("api", "owner")], "type string, field string")
    return quality.check_schema(document_pages(spark, sf), required).drop("line")


@query(_DOCS + """
    select 'staleness' as "check", 'warn' severity, page, 'no date of update' message from p where updated is null
    union all select 'staleness', 'warn', page, 'date cannot be read: soon' from p where updated = 'soon'
    union all select 'staleness', 'warn', page, 'updated ' || date_diff('day', updated::date, date '2024-02-01') || ' days ago' from p where updated <> 'soon' and date_diff('day', updated::date, date '2024-02-01') > 20""")
def lint_staleness(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "rel string, extracted_from struct<repo:string,sha:string,at:string>")
    return quality.check_staleness(document_pages(spark, sf), none, "2024-02-01T00:00:00", 20).drop("line")


@query(_DOCS + """select 'types' as "check", 'warn' severity, page, 'type is ' || type || ', the folder implies ' || case when k % 4 = 0 then 'api' when k % 9 = 0 then 'deployed-node' else 'service' end message from p where type is not null and type <> case when k % 4 = 0 then 'api' when k % 9 = 0 then 'deployed-node' else 'service' end""")
def lint_types(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_types(document_pages(spark, sf)).drop("line")


_SECTIONS = """, b as (select k, page, case when k % 2 = 0 then 1 else 0 end t from p)
    select 'sections' as "check", 'error' severity, page, 'empty section: ## Two' message, 7 + t line from b where k % 5 = 0 and k % 29 <> 0
    union all select 'sections', 'error', page, 'placeholder TODO', 3 + t from b where k % 3 = 0
    union all select 'sections', 'error', page, 'placeholder coming soon', 3 + t from b where k % 3 = 0
    union all select 'sections', 'error', page, 'placeholder TODO', 5 + t from b
    union all select 'sections', 'error', page, 'template token <token here>', 7 + t from b where k % 5 <> 0
    union all select 'sections', 'error', page, 'template token <A|b>', 7 + t from b where k % 5 <> 0"""


@query(_DOCS + _SECTIONS)
def lint_sections(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_sections(document_pages(spark, sf))


@query(_DOCS + """, q as (select k, page, unnest(['status', 'summary', 'updated', 'repo', 'depends_on', 'part_of']) field, summary from p where fm and err is null and type = 'service')
    select 'schema' as "check", 'error' severity, page, 'missing required field ' || field message from q where field not in ('status', 'summary') or (field = 'summary' and summary is null)""")
def lint_schema_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_schema(document_pages(spark, sf)).where("message like 'missing required field %'").drop("line")


@query(_DOCS + """, f as (select 'error' s from p where not fm union all select 'warn' from p where type is not null and type <> case when k % 4 = 0 then 'api' when k % 9 = 0 then 'deployed-node' else 'service' end)
    select (select count(*) from p) assessed, count(*) filter (s = 'error') errors, count(*) filter (s = 'warn') warnings, 0::bigint infos, case when (select count(*) from p) = 0 then 3 when count(*) filter (s in ('error', 'warn')) > 0 then 1 else 0 end code from f""")
def lint_exit_code(spark: SparkSession, sf: str) -> DataFrame:
    pages = document_pages(spark, sf)
    found = {"schema": quality.finding(pages.where("not fm_present"), "schema", "error", F.lit("no frontmatter")), "types": quality.check_types(pages), "sections": quality.check_sections(pages)}
    return quality.exit_code(quality.lint(found, "types, schema"), pages, "warn")


@query(_DOCS + """, f as (select 'types' c, 'warn' s from p where type is not null and type <> case when k % 4 = 0 then 'api' when k % 9 = 0 then 'deployed-node' else 'service' end union all
    select 'schema', 'error' from p where not fm union all select 'schema', 'error' from p where err is not null union all select 'schema', 'error' from p where fm and err is null and title is null
    union all select 'schema', 'error' from p where fm and err is null and (type is null or type = '<page type>') union all
    select 'staleness', 'warn' from p where updated is null or updated = 'soon')
    select c as "check", count(*) filter (s = 'error') error, count(*) filter (s = 'warn') warn, count(*) filter (s = 'info') info from f group by 1""")
def findings_pivot(spark: SparkSession, sf: str) -> DataFrame:
    pages = document_pages(spark, sf)
    none = spark.createDataFrame([], "rel string, extracted_from struct<repo:string,sha:string,at:string>")
    found = quality.check_schema(pages, spark.createDataFrame([], "type string, field string"))
    return quality.pivot(found.unionByName(quality.check_types(pages)).unionByName(quality.check_staleness(pages, none, "2024-02-01T00:00:00")))


@query(_DOCS + "select (select count(*) from p) assessed, (select count(*) from p where not fm) errors, case when (select count(*) from p where not fm) > 0 then 'red' else 'green' end status")
def lint_outcome(spark: SparkSession, sf: str) -> DataFrame:
    pages = document_pages(spark, sf)
    return quality.outcome(quality.finding(pages.where("not fm_present"), "schema", "error", F.lit("no frontmatter")), pages)


@query(_LINKS + """select 'links' as "check", 'error' severity, page, 'broken runtime target [[' || target || ']]' message from links where k not in (select k from small)""")
def lint_links(spark: SparkSession, sf: str) -> DataFrame:
    links = part_links(spark, sf).withColumnRenamed("page", "rel")
    return quality.check_links(links.limit(0), links, graph.page_names(part_pages(spark, sf)).drop("rank").withColumn("rank", F.lit(1))).drop("line")


@query("""with pages as (select 'p' || p_partkey rel from part), c as (select 'p' || l_partkey t, 'p' || l_suppkey s, l_linenumber = 2 bi from lineitem where l_quantity >= 49 and l_linenumber <= 2), r as (select 'p' || l_partkey t from lineitem where l_quantity >= 46 and l_linenumber > 2)
    select 'orphans' as "check", case when rel in (select t from r) then 'info' else 'warn' end severity, rel page, case when rel in (select t from r) then 'only runtime edges lead here' else 'no link leads here' end message
    from pages where rel not in (select t from c where t <> s) and rel not in (select s from c where bi and t <> s)""")
def lint_orphans(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("rel"))
    li = table(spark, sf, "lineitem")  # large items are links, as otherwise no part would be an orphan
    ends = [F.concat(F.lit("p"), "l_suppkey").alias("src_rel"), F.concat(F.lit("p"), "l_partkey").alias("page")]
    coarse = li.where("l_quantity >= 49 and l_linenumber <= 2").select(*ends, F.when(F.col("l_linenumber") == 2, "bidirectional").otherwise("up").alias("direction"))
    runtime = li.where("l_quantity >= 46 and l_linenumber > 2").select(F.lit("x").alias("src_rel"), ends[1])
    return quality.check_orphans(pages, coarse, runtime).drop("line")


_CHECKED = """
    with e as (select o_orderkey k, 'p' || o_custkey page, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'plain' else '[[c]]' end target, case when o_orderkey % 3 = 0 then 'publishes-to' when o_orderkey % 11 = 0 then 'odd' else 'invokes' end as type,
        case when o_orderkey % 13 <> 0 then 'f' end prov, o_orderkey % 17 <> 0 stamp, case when o_orderkey % 19 <> 0 then 'sha' end sha from orders),
    c as (select k, page, concat_ws('|', case when target is null then 'no target' end, case when target = 'plain' then 'target is not a link' end, case when type = 'odd' then 'unknown type' end, case when prov is null then 'no provenance' end,
        case when not stamp then 'no freshness stamp' end, case when stamp and sha is null then 'stamp without sha' end) problems from e)
"""


def checked_edges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("p"), "o_custkey").alias("page"), F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, "plain").otherwise("[[c]]").alias("target"), F.when(k % 3 == 0, "publishes-to").when(k % 11 == 0, "odd").otherwise("invokes").alias("type"),
        F.when(k % 13 != 0, "f").alias("provenance"), F.when(k % 17 != 0, F.struct(F.lit("r").alias("repo"), F.when(k % 19 != 0, "sha").alias("sha"), F.lit("t").alias("at"))).alias("extracted_from"),
    )
    return quality.edge_problems(e)


@query(_CHECKED + "select k, problems from c where problems <> ''")
def strict_validation(spark: SparkSession, sf: str) -> DataFrame:
    return checked_edges(spark, sf).where(F.size("problems") > 0).select("k", F.array_join("problems", "|").alias("problems"))


@query(_CHECKED + "select page, bool_and(problems = '') accepted, sum(case when problems = '' then 0 else len(string_split(problems, '|')) end)::bigint n_problems from c group by 1")
def strict_pages(spark: SparkSession, sf: str) -> DataFrame:
    return quality.strict_pages(checked_edges(spark, sf))


_RECORDS = """
    with r as (select event_id, 'p' || event_id % 200 page, case when event_type <> 'view' then 'u' || user_id end repo, case when event_type = 'error' then 'unknown' else 'ab' || event_id % 3 end sha, ts from events),
    h as (select 'u' || user_id repo, arg_max('ab' || event_id % 3 || 'cdef', event_id) head from events where event_type = 'purchase' and value > 20 group by 1),
    a as (select r.*, case when repo is null then 'no stamp' when sha = 'unknown' then 'revision was not readable' when head is null then 'head is not readable' when not starts_with(head, sha) then 'source moved'
        when epoch(timestamp '2024-02-01') - epoch(date_trunc('second', ts)) > 20 * 86400 then 'too old' else 'matches head' end reason from r left join h using (repo)),
    s as (select *, case when reason in ('source moved', 'too old') then 'stale' when reason = 'matches head' then 'current' else 'unknown' end status from a)
"""


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    records = e.select("event_id", F.concat(F.lit("p"), F.col("event_id") % 200).alias("page"), F.when(F.col("event_type") != "view", F.concat(F.lit("u"), "user_id")).alias("repo"), F.when(F.col("event_type") == "error", "unknown").otherwise(F.concat(F.lit("ab"), F.col("event_id") % 3)).alias("sha"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    heads = e.where("event_type = 'purchase' and value > 20").groupBy(F.concat(F.lit("u"), "user_id").alias("repo")).agg(F.max_by(F.concat(F.lit("ab"), F.col("event_id") % 3, F.lit("cdef")), "event_id").alias("head"))
    return drift.assess(records, heads, "2024-02-01T00:00:00", 20)


@query(_RECORDS + "select event_id, status, reason from s")
def drift_status(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("event_id", "status", "reason")


@query(_RECORDS + "select page, case max(case status when 'stale' then 2 when 'unknown' then 1 else 0 end) when 2 then 'stale' when 1 then 'unknown' else 'current' end status, count(*) n_edges from s group by 1")
def drift_worst_per_page(spark: SparkSession, sf: str) -> DataFrame:
    return drift.worst_per_page(assessed(spark, sf))


@query(_RECORDS + "select count(*) edges, count(*) filter (status = 'current') current, count(*) filter (status = 'unknown') unknown, count(*) filter (status = 'stale') stale from s")
def drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.summary(assessed(spark, sf))


@query("select event_id, case event_type when 'click' then 'clicks' else event_type end repo, 'unknown' sha, '2024-02-01' as at, true backfilled from events where user_id % 2 = 0")
def freshness_backfill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    records = e.select("event_id", F.concat(F.col("event_type"), F.lit("/main.py:1")).alias("provenance"), F.when(F.col("user_id") % 2 != 0, "r").alias("repo"), F.when(F.col("user_id") % 2 != 0, "s").alias("sha"), F.lit(None).cast("string").alias("at"))
    directories = spark.createDataFrame([("click", "clicks")], "dir string, repo string")
    return drift.backfill(records, directories, "2024-02-01").drop("provenance")


@query("""
    with o as (select o_orderkey k, 'p' || o_custkey % 100 page, o_orderpriority as type, '[[c' || o_custkey || ']]' target, case when o_orderkey % 4 <> 0 then 'x' || o_orderkey end condition, case when o_orderkey % 3 <> 0 then 'y' || o_orderkey end stamp from orders),
    st as (select * from o where k % 2 = 0), own as (select page, target, type, min(k) k from st group by 1, 2, 3),
    inc as (select page, target, type, max(k) k, arg_max(coalesce(condition, '~'), k) condition, arg_max(coalesce(stamp, '~'), k) stamp from o where k % 3 <> 0 group by 1, 2, 3)
    select s.page, s.k seq, s.target, s.type, coalesce(s.condition, nullif(case when w.k is not null then i.condition end, '~')) condition, coalesce(nullif(case when w.k is not null then i.stamp end, '~'), s.stamp) stamp,
        case when w.k is not null and i.k is not null then 'merged' else 'kept' end outcome
    from st s left join own w on w.page = s.page and w.target = s.target and w.type = s.type and w.k = s.k left join inc i on i.page = s.page and i.target = s.target and i.type = s.type
    union all select i.page, null, i.target, i.type, nullif(i.condition, '~'), nullif(i.stamp, '~'), 'added' from inc i where not exists (select 1 from own w where w.page = i.page and w.target = i.target and w.type = i.type)""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("seq"), F.concat(F.lit("p"), F.col("o_custkey") % 100).alias("page"), F.col("o_orderpriority").alias("type"), F.concat(F.lit("[[c"), "o_custkey", F.lit("]]")).alias("target"), F.lit(None).cast("string").alias("endpoint"), F.when(k % 4 != 0, F.concat(F.lit("x"), k)).alias("condition"), F.when(k % 3 != 0, F.concat(F.lit("y"), k)).alias("stamp"))
    return merge.upsert(o.where("seq % 2 = 0"), o.where("seq % 3 <> 0"), fresh=("stamp",)).drop("endpoint")


@query("select 'p' || o_custkey % 100 page, o_orderpriority as type, count(*) n from orders where o_orderpriority not in ('1-URGENT', '5-LOW') and o_custkey % 100 in (1, 2) group by 1, 2")
def patch_filters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 100).alias("page"), F.col("o_orderpriority").alias("type"))
    return merge.select_patches(p, ["1-URGENT", "5-LOW"], ["p1", "p2"]).groupBy("page", "type").agg(F.count("*").alias("n"))


@query("select p_partkey, case p_partkey % 3 when 0 then p_name || ' - x' when 1 then p_brand || ',' || 'part - x' else '' end aliases from part")
def alias_population(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    p = table(spark, sf, "part").select("p_partkey", F.when(k == 0, F.concat("p_name", F.lit(" – x"))).when(k == 1, F.lit("part – x")).otherwise(F.lit("plain - title")).alias("title"), F.when(k == 1, F.array("p_brand")).alias("aliases"))
    return merge.populate_aliases(p).select("p_partkey", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"))


@query("""with m as (select 'Nation-' || n_nationkey repo, n_regionkey::int c from nation where n_nationkey % 2 = 0), r as (select s_nationkey n, max('c' || s_suppkey) commit, string_agg('s' || s_suppkey, ',' order by 's' || s_suppkey) p from supplier where s_nationkey % 3 <> 0 group by 1)
    select coalesce(repo, 'nation-' || n) repo, coalesce(commit, 'old') last_commit, case when n is not null then '2024-02-01' else '2023' end last_sync, coalesce(c, 0) + (n is not null)::int sync_count,
        case when repo is null then p when n is null then 'zero' else p || ',zero' end pages from m full join r on lower(repo) = 'nation-' || n""")
def manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Nation-"), "n_nationkey").alias("repo"), F.lit("old").alias("last_commit"), F.lit("2023").alias("last_sync"), F.col("n_regionkey").cast("int").alias("sync_count"), F.array(F.lit("zero")).alias("pages"))
    r = table(spark, sf, "supplier").where("s_nationkey % 3 <> 0").select(F.concat(F.lit("nation-"), "s_nationkey").alias("repo"), F.concat(F.lit("c"), "s_suppkey").alias("last_commit"), F.array(F.concat(F.lit("s"), "s_suppkey")).alias("pages"))
    return merge.upsert_manifest(m, r, "2024-02-01").withColumn("pages", F.array_join("pages", ","))


_SURVEY = """
    with f as (select source repo, doc_id, case doc_id % 7 when 0 then 'Dockerfile' when 1 then 'package.json' when 2 then 'src/Makefile' else 'src/' || doc_id end rel, text from documents where source not in ('src0', 'src1') or doc_id % 7 > 1),
    g as (select repo, bool_or(rel = 'Dockerfile') c, bool_or(rel = 'package.json') d, bool_or(contains(text, 'express') or contains(text, 'flask')) a, bool_or(contains(text, 'motor') or contains(text, 'bigquery')) s from f group by 1),
    p as (select repo, case when c then 'service' else 'component' end as type, case when c then 'Dockerfile' else 'package.json' end signals, 0 n from g where c or d
        union all select repo, 'api', null, 1 from g where (c or d) and a union all select repo, 'data-store', null, 2 from g where (c or d) and s)
"""


def surveyed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 7
    d = table(spark, sf, "documents").where("source not in ('src0', 'src1') or doc_id % 7 > 1")  # two sources without signals of a service
    return inventory.survey(d.select(F.col("source").alias("repo"), F.when(k == 0, "Dockerfile").when(k == 1, "package.json").when(k == 2, "src/Makefile").otherwise(F.concat(F.lit("src/"), "doc_id")).alias("rel"), "text"))


@query(_SURVEY + "select repo || '/' || type id, type, repo, case type when 'service' then 'services/' when 'component' then 'components/' when 'api' then 'apis/' else 'data-stores/' end || repo || '.md' path, row_number() over (order by repo, n) > 10 deferred from p")
def page_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.page_inventory(surveyed(spark, sf), budget=155_000).select("id", "type", "repo", "path", "deferred")


@query(_SURVEY + "select repo, string_agg(type, ',' order by type) detected, coalesce(string_agg(type, ',' order by type) filter (type <> 'service'), '') covered, coalesce(string_agg(type, ',' order by type) filter (type = 'service'), '') gaps from p group by 1")
def inventory_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = surveyed(spark, sf)
    return inventory.coverage(s, s.where("type <> 'service'")).select("repo", *(F.array_join(c, ",").alias(c) for c in ("detected", "covered", "gaps")))


@query("""with e as (select distinct 's' || l_suppkey src, 'p' || l_partkey dst, l_returnflag as type, l_linestatus endpoint from lineitem),
    q(question, f, t, ty, ep, neg) as (values ('hit', 's1', null, 'R', 'F', false), ('miss', 's1', 'p-none', 'R', null, false), ('absent', 's-none', null, null, null, true)),
    m as (select question, neg, (f is not null and src = f)::int + (t is not null and dst = t)::int + (ty is not null and type = ty)::int same,
            (f is not null and src <> f)::int + (t is not null and dst <> t)::int + (ty is not null and type <> ty)::int + (ep is not null and endpoint <> ep)::int fails, src || ' ' || type || ' ' || dst edge from e, q)
    select question, case when neg then count(*) filter (fails = 0) = 0 else count(*) filter (fails = 0) > 0 end ok, count(*) filter (fails = 0) matches, first(fails order by -same, fails, edge) nearest_fails, first(edge order by -same, fails, edge) nearest from m group by question, neg""")
def question_match(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("endpoint")).distinct()
    return evaluation.evaluate(e, [{"id": "hit", "expect": {"from": "s1", "type": "R", "endpoint": "F"}}, {"id": "miss", "expect": {"from": "s1", "to": "p-none", "type": "R"}}, {"id": "absent", "expect_absent": {"from": "s-none"}}])


@query("""select page_id, 'ext:' || regexp_extract(url, '^https?://([^/]+)', 1) service, regexp_replace(lower(split_part(url, '/', -1)), '-(prod|dev|test|[0-9]{6,})$', '') norm_id,
    regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug, contains(url, '?') has_query, len(string_split(url, '/'))::int n_segments from pages""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.host_to_service("url").alias("service"), T.norm_id("url").alias("norm_id"), T.slugify("url").alias("slug"), F.col("url").contains("?").alias("has_query"), F.size(F.split("url", "/")).alias("n_segments"))


@query("""with w as (select p_partkey, lower(split_part(p_name, ' ', 2)) w, upper(replace(p_name, ' ', '_')) v from part)
    select p_partkey, case when regexp_matches(w, '[^aeiou]y$') then left(w, len(w) - 1) || 'ies' when regexp_matches(w, '(s|x|z|ch|sh)$') then w || 'es' else w || 's' end as collection, lower(replace(v, '_', '-')) service from w""")
def naming_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.pluralize(F.element_at(F.split("p_name", " "), 2)).alias("collection"), T.service_of_variable(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_BASE_URL"))).alias("service"))


@query("select url, regexp_matches(url, '/(de|es)/') or regexp_matches(url, '/[^/]*\\.html(/|$)') as excluded from pages")
def path_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", T.path_excluded("url", ["d[e]", "es", "*.html"]).alias("excluded"))
