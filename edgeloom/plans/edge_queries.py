"""Edge operators bound to the driver's tables: pages as call sites, orders and line items as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import coupling, edges, emit, envdiff, ordering, reconcile
from edgeloom.plans.registry import query, table

HINTS = [("example.com", "generic-com"), ("example.net", "generic-net"), ("blog.tionsh.example.net", "blog"), ("pills.example.com", "pharma"), ("base_url", "base")]

_SERVICE = """
    case when host = '' then null
         when contains(host, 'oauth2.googleapis.com') or contains(host, 'accounts.google.com') then 'GCP-OAuth'
         when contains(host, 'run.googleapis.com') then 'GCP-Run-Admin-API'
         when contains(host, 'googleapis.com') then 'GCP-API'
         when contains(host, 'bitbucket.org') then 'Bitbucket'
         when contains(host, 'run.app') then 'cloudrun:' || split_part(host, '.', 1)
         else 'ext:' || host end"""
_SITES = f"""
    with base as (
        select page_id seq, url, regexp_extract(url, '^https?://([^/]+)', 1) host,
               regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') path,
               case when contains(url, '#') then 'low' when url like 'http:%' then 'med' else 'high' end confidence,
               case when contains(url, '.html') then 0 when contains(url, '?') then 3 end prov_rank from pages),
    fam as (
        select *, list_filter(string_split(regexp_replace(path, '/[0-9]+', '/{{id}}', 'g'), '/'), lambda s: s <> '' and not starts_with(s, '{{') and not contains(s, ':')) segs from base),
    sites as (
        select seq, url, host, regexp_extract(path, '^/([a-z]+)', 1) src_repo, {_SERVICE} target_service, confidence, prov_rank,
               case when ends_with(host, '.org') then 'dynamic' else 'http-call' end kind, case when contains(url, 'utm_source') then 'use_campaign' end condition,
               split_part(url, '://', 1) src_symbol, 'pages.tsv:' || seq site,
               '/' || array_to_string(segs[1:3], '/') endpoint_family from fam)
"""


def sites_of(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    host = T.host_of("url")
    return p.select(
        F.col("page_id").alias("seq"), "url", F.when(host.endswith(".org"), "dynamic").otherwise("http-call").alias("kind"), F.regexp_extract(path, "^/([a-z]+)", 1).alias("src_repo"), F.substring_index("url", "://", 1).alias("src_symbol"),
        F.lit("pages.tsv").alias("src_file"), F.col("page_id").cast("int").alias("src_line"), T.host_to_service("url").alias("target_service"), F.regexp_replace(path, "/[0-9]+", "/{id}").alias("target_endpoint"),
        F.when(F.col("url").contains("utm_source"), "use_campaign").alias("condition"), F.when(F.col("url").contains("#"), "low").when(F.col("url").startswith("http:"), "med").otherwise("high").alias("confidence"),
        F.when(F.col("url").contains(".html"), 0).when(F.col("url").contains("?"), 3).alias("prov_rank"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("endpoint_expr"), F.lit(None).cast("string").alias("unresolved_expr"),
        F.struct(F.lit("pages").alias("repo"), F.lit("unknown").alias("sha"), F.lit("2024-01-01T00:00:00Z").alias("at")).alias("extracted_from"), host.alias("host"),
    )


@query(_SITES + """
    select src_repo, target_service, endpoint_family, arg_min(kind, seq) kind, arg_min(site, coalesce(prov_rank, 5)::bigint * 1000000000 + seq) provenance,
           case min(case confidence when 'low' then 0 when 'med' then 1 else 2 end) when 0 then 'low' when 1 then 'med' else 'high' end confidence_summary, count(*) n_call_sites
    from sites group by 1, 2, 3""")
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return edges.logical_edge_summary(sites_of(spark, sf))


@query(_SITES + """
    select src_repo, target_service, endpoint_family, string_agg(site, ',' order by coalesce(prov_rank, 5), seq) call_sites, coalesce(string_agg(distinct condition, ','), '') conditions,
           string_agg(distinct src_symbol, ',' order by src_symbol) symbols, string_agg(distinct confidence, ',' order by confidence) confidences, count(*) n_call_sites
    from sites group by 1, 2, 3""")
def edge_dedup_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = edges.logical_edges(sites_of(spark, sf))
    return e.select("src_repo", "target_service", "endpoint_family", *(F.array_join(c, ",").alias(c) for c in ("call_sites", "conditions", "symbols", "confidences")), "n_call_sites")


@query(f"""
    with hints(suffix, service, seq) as (values {", ".join(f"('{s}', '{v}', {i})" for i, (s, v) in enumerate(HINTS))}),
    best as (select page_id, first(service order by length(suffix) desc, seq) service, first(suffix order by length(suffix) desc, seq) suffix
             from pages join hints on ends_with(lower(regexp_extract(url, '^https?://([^/]+)', 1)), suffix) group by 1)
    select page_id, service, 'config-var ' || suffix via, case when suffix is null then null when suffix = 'base_url' then 'med' else 'high' end confidence from pages left join best using (page_id)""")
def hint_longest_suffix(spark: SparkSession, sf: str) -> DataFrame:
    hints = spark.createDataFrame([(s, v, i) for i, (s, v) in enumerate(HINTS)], "suffix string, service string, seq int")
    return edges.resolve_hints(table(spark, sf, "pages").select("page_id", T.host_of("url").alias("base_expr")), hints).drop("base_expr")


@query(f"""
    with b as (select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) host from pages)
    select page_id, case when starts_with(host, 'www.') then 'web' when ends_with(host, 'example.com') then 'generic-com' when contains(url, 'utm_source') then 'campaign' else {_SERVICE} end service,
           case when starts_with(host, 'www.') then 'local-URL www' when ends_with(host, 'example.com') then 'config-var example.com' when contains(url, 'utm_source') then 'local config-var utm' else 'literal host' end via,
           case when not starts_with(host, 'www.') and not ends_with(host, 'example.com') and contains(url, 'utm_source') then 'med' else 'high' end confidence from b""")
def resolution_ladder(spark: SparkSession, sf: str) -> DataFrame:
    hints = spark.createDataFrame([("example.com", "generic-com", 0)], "suffix string, service string, seq int")
    s = edges.resolve_hints(table(spark, sf, "pages").select("page_id", "url", T.host_of("url").alias("base_expr")), hints)
    rungs = [
        (F.when(F.col("base_expr").startswith("www."), F.lit("web")), F.lit("local-URL www"), F.lit("high")),
        (F.col("service"), F.col("via"), F.col("confidence")),
        (F.when(F.col("url").contains("utm_source"), F.lit("campaign")), F.lit("local config-var utm"), F.lit("med")),
        (T.host_to_service("url"), F.lit("literal host"), F.lit("high")),
    ]
    return s.select("page_id", edges.ladder(*rungs).alias("r")).select("page_id", "r.*")


@query("select d.doc_id id, d.source, coalesce(l.quality = 1, false) grounded from documents d left join labels l using (doc_id) where l.quality is distinct from 0")
def grounding_gate(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("resolves"))
    return edges.grounding_gate(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), facts)


@query(_SITES + """, e as (select case when arg_min(kind, seq) = 'dynamic' then 'dynamic' else 'resolved' end c from sites group by src_repo, target_service, endpoint_family)
    select c as edge_class, count(*) n from e group by 1 union all select 'all', count(*) from e""")
def edge_class_partition(spark: SparkSession, sf: str) -> DataFrame:
    e = edges.logical_edge_summary(sites_of(spark, sf))
    parts = [edges.of_class(e, c).agg(F.count("*").alias("n")).select(F.lit(c).alias("edge_class"), "n") for c in ("resolved", "dynamic", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_SITES + "select count(*) n_edges, count(*) filter (kind <> 'dynamic') n_resolved, count(condition) n_conditioned, count(*) filter (confidence = 'high') n_high from sites")
def coverage_facts(spark: SparkSession, sf: str) -> DataFrame:
    return edges.coverage(sites_of(spark, sf))


@query(_SITES + "select kind, confidence, count(*) n from sites group by 1, 2")
def edge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return edges.histogram(sites_of(spark, sf), "kind", "confidence")


@query(_SITES + "select count(*) filter (kind = 'http-call') logical, count(*) filter (kind = 'dynamic') unresolved, 0::bigint datastore from sites")
def family_alarm(spark: SparkSession, sf: str) -> DataFrame:
    return edges.family_alarm(sites_of(spark, sf), {"logical": ["http-call"], "unresolved": ["dynamic"], "datastore": ["shares-datastore"]})


@query("""
    with v(name, value, condition) as (values ('a', 'x', 'use_x'), ('a', 'y', null), ('b', '1', null), ('b', '2', null), ('b', '3', null), ('b', '4', null), ('b', '5', null)),
    s as (select page_id, '/' || case page_id % 3 when 0 then '{self.a}' when 1 then '{self.b}' else 'plain' end || '/z' endpoint, case page_id % 3 when 0 then 'a' end name from pages)
    select page_id, case when value is null then endpoint else replace(endpoint, '{self.a}', value) end endpoint, condition from s left join v using (name)""")
def variant_expansion(spark: SparkSession, sf: str) -> DataFrame:
    values = spark.createDataFrame([("a", "x", "use_x"), ("a", "y", None), *(("b", str(i), None) for i in range(1, 6))], "name string, value string, condition string")
    m = F.col("page_id") % 3
    s = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.when(m == 0, "{self.a}").when(m == 1, "{self.b}").otherwise("plain"), F.lit("/z")).alias("endpoint"))
    return edges.expand_variants(s, values)


_CENTS = "cast(round({} * 100) as bigint)"
_DECLARED = f"select 'orders/' || o_orderkey as name, 'order-declared' as kind, {_CENTS.format('o_totalprice')} as cents, o_orderstatus as status, o_orderkey as k from orders where o_orderstatus <> 'P'"
_LIVE = f"select 'live/' || l_orderkey as name, 'order-live' as kind, sum({_CENTS.format('l_extendedprice')})::bigint as cents, max(l_linestatus) as status, l_orderkey as k from lineitem group by l_orderkey"


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def graph_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as declared nodes, sums of line items as live ones. Pending orders are not declared: nodes of one side only."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("cents"), F.max("l_linestatus").alias("status"))

    def node(df: DataFrame, prefix: str, key: str, kind: str, cents, status: str) -> DataFrame:
        attrs = F.create_map(F.lit("cents"), cents.cast("string"), F.lit("status"), F.col(status))
        return df.select(F.col(key).alias("seq"), F.concat(F.lit(prefix), F.col(key)).alias("name"), F.lit(kind).alias("kind"), attrs.alias("attrs"), F.lit(prefix).alias("provenance"))

    return node(o, "orders/", "o_orderkey", "order-declared", _cents("o_totalprice"), "o_orderstatus"), node(li, "live/", "l_orderkey", "order-live", F.col("cents"), "status")


_RECON = f"with d as ({_DECLARED}), l as ({_LIVE}) "


@query(_RECON + """select coalesce(d.name, l.name) as name, coalesce(d.kind, l.kind) as kind, case when d.k is not null and l.k is not null then 'both' when l.k is not null then 'live' else 'declared' end as source,
    coalesce(d.cents, l.cents)::varchar as cents, case when d.k is not null and l.k is not null then l.cents::varchar end as live_cents from d full join l on d.k = l.k""")
def reconcile_nodes(spark: SparkSession, sf: str) -> DataFrame:
    r = reconcile.reconcile_nodes(*graph_nodes(spark, sf))
    return r.select("name", "kind", "source", F.try_element_at("attrs", F.lit("cents")).alias("cents"), F.try_element_at("live_attrs", F.lit("cents")).alias("live_cents"))


@query(_RECON + """, b as (select d.name as node, d.cents::varchar as dc, l.cents::varchar as lc, d.status as ds, l.status as ls from d join l on d.k = l.k)
    select node, 'cents' as attr, dc as declared, lc as live from b where dc <> lc union all select node, 'status', ds, ls from b where ds <> ls""")
def reconcile_drift(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.drift(reconcile.reconcile_nodes(*graph_nodes(spark, sf)))


@query(_RECON + """select count(*) nodes, count(*) filter (d.k is not null and l.k is not null) "both", count(*) filter (d.k is null) deployed_not_in_iac, count(*) filter (l.k is null) declared_not_live from d full join l on d.k = l.k""")
def reconcile_report(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.report(reconcile.reconcile_nodes(*graph_nodes(spark, sf)))


def graph_edges(spark: SparkSession, sf: str, status: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == status)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("supplier/s"), "l_suppkey").alias("src"), F.concat(F.lit("part/p"), "l_partkey", F.lit("-prod")).alias("dst"), F.lit("supplies").alias("type"))


_EDGES = "with o as (select distinct l_suppkey s, l_partkey p from lineitem where l_linestatus = 'O'), f as (select distinct l_suppkey s, l_partkey p from lineitem where l_linestatus = 'F') "


@query(_EDGES + """select 'supplier/s' || coalesce(o.s, f.s) src, 'part/p' || coalesce(o.p, f.p) || '-prod' dst, 'supplies' as type,
    case when o.s is not null and f.s is not null then 'both' when f.s is not null then 'live' else 'declared' end as source from o full join f on o.s = f.s and o.p = f.p""")
def reconcile_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.reconcile_edges(graph_edges(spark, sf, "O"), graph_edges(spark, sf, "F"))


@query("select 'order' as family, lower(o_orderstatus) as id, count(distinct o_orderpriority)::bigint as n from orders group by 2 having count(distinct o_orderpriority) > 1")
def reconcile_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return reconcile.key_collisions(o.select(F.concat(F.lit("order-"), "o_orderpriority").alias("kind"), F.concat(F.lit("x/"), "o_orderstatus").alias("name")))


def environment(spark: SparkSession, sf: str, status: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == status).where("l_quantity >= 45")
    # large line items only: each environment then lacks parts that the other has
    p = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.max("l_returnflag").alias("flag"), F.count("*").alias("n"))
    attrs = F.map_filter(F.create_map(F.lit("qty"), F.col("q").cast("string"), F.lit("flag"), F.concat(F.lit(f"https://x.googleapis.com/projects/{status}/flags/"), "flag"), F.lit("many"), F.when(F.col("n") > 1, "yes"), F.lit("url"), F.lit(status)), lambda k, v: v.isNotNull())
    return p.select(F.col("l_partkey").alias("seq"), F.concat(F.lit(f"env-{status}/part"), "l_partkey").alias("name"), F.lit("part-x").alias("kind"), attrs.alias("attrs"), F.lit(None).cast("string").alias("provenance"))


_ENV = "with e as (select l_linestatus st, l_partkey k, sum(l_quantity::bigint)::bigint q, max(l_returnflag) flag, case when count(*) > 1 then 'yes' end many from lineitem where l_quantity >= 45 group by 1, 2), a as (select * from e where st = 'F'), b as (select * from e where st = 'O') "


@query(_ENV + """select 'env-' || case when a.k is null then 'O' else 'F' end || '/part' || coalesce(a.k, b.k) as name, 'part-x' as kind,
    case when b.k is null then 'only_in_a' when a.k is null then 'only_in_b' when a.q <> b.q or a.flag <> b.flag or a.many is distinct from b.many then 'differs' else 'identical' end as status from a full join b on a.k = b.k""")
def envdiff_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return envdiff.compare_nodes(environment(spark, sf, "F"), environment(spark, sf, "O")).drop("deltas")


@query(_ENV + """, m as (select 'env-F/part' || a.k as name, 'part-x' as kind, a.q::varchar aq, b.q::varchar bq, a.flag af, b.flag bf, a.many am, b.many bm from a join b on a.k = b.k)
    select name, kind, 'qty' as attr, aq as a, bq as b from m where aq <> bq union all select name, kind, 'flag', af, bf from m where af <> bf union all select name, kind, 'many', am, bm from m where am is distinct from bm""")
def envdiff_attr_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return envdiff.attr_deltas(envdiff.compare_nodes(environment(spark, sf, "F"), environment(spark, sf, "O")))


@query(_ENV + """, m as (select case when b.k is null then 'only_in_a' when a.k is null then 'only_in_b' when a.q <> b.q or a.flag <> b.flag or a.many is distinct from b.many then 'differs' else 'identical' end as status from a full join b on a.k = b.k)
    select status, 'part' as family, count(*) n from m group by 1""")
def envdiff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return envdiff.summary(envdiff.compare_nodes(environment(spark, sf, "F"), environment(spark, sf, "O")))


@query(_EDGES + """select 'supplier/s' || s src, 'part/p' || p || '-prod' dst, 'supplies' as type, 'only_in_a' as status from o where not exists (select 1 from f where f.s = o.s and f.p = o.p)
    union all select 'supplier/s' || s, 'part/p' || p || '-prod', 'supplies', 'only_in_b' from f where not exists (select 1 from o where f.s = o.s and f.p = o.p)""")
def envdiff_edges(spark: SparkSession, sf: str) -> DataFrame:
    return envdiff.compare_edges(graph_edges(spark, sf, "O"), graph_edges(spark, sf, "F"))


def access_of(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    model = F.when((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "N"), F.lit("Model"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("s"), "l_suppkey").alias("repo"), F.lit("parts").alias("store"), F.concat(F.lit("p"), "l_partkey").alias("collection"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40), "write").otherwise("read").alias("mode"), F.lit("x").alias("provenance"), model.alias("model"),
    )


_ACCESS = """
    with acc as (select l_orderkey * 10 + l_linenumber seq, 's' || l_suppkey repo, 'p' || l_partkey coll, l_returnflag = 'R' and l_quantity >= 40 w, l_quantity >= 50 and l_returnflag = 'N' m from lineitem),
    modes as (select coll, repo, bool_or(not w) reads, bool_or(w) writes, max(case when m then seq end) declares from acc group by 1, 2),
    own as (select coll, count(*) n_repos, count(*) filter (writes) n_writers, arg_max(repo, declares) declared, max(case when writes then repo end) writer from modes group by 1),
    owners as (select coll, n_repos, n_writers, case when declared is not null then declared when n_repos >= 2 and n_writers = 1 then writer end owner,
                      case when declared is not null then 'declared-schema' when n_repos >= 2 and n_writers = 1 then 'sole-writer' end basis from own)
"""


@query(_ACCESS + "select 'parts' store, coll collection, repo, reads, writes from modes")
def access_modes(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.access_modes(access_of(spark, sf)).select("store", "collection", "repo", "reads", "writes")


@query(_ACCESS + "select coll collection, owner, basis owner_basis, n_repos, n_writers from owners")
def sole_writer(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.owners(coupling.access_modes(access_of(spark, sf))).drop("store")


_PAIRS = _ACCESS + """,
    links as (
        select m.coll, least(m.repo, o.owner) a, greatest(m.repo, o.owner) b, o.owner, o.basis,
               case when m.repo < o.owner then m.reads else x.reads end ar, case when m.repo < o.owner then m.writes else x.writes end aw,
               case when m.repo < o.owner then x.reads else m.reads end br, case when m.repo < o.owner then x.writes else m.writes end bw
        from modes m join owners o using (coll) join modes x on x.coll = m.coll and x.repo = o.owner where o.n_repos >= 2 and m.repo <> o.owner
        union all
        select m.coll, m.repo, x.repo, null, null, m.reads, m.writes, x.reads, x.writes from modes m join owners o using (coll) join modes x on x.coll = m.coll and m.repo < x.repo
        where o.n_repos >= 2 and o.owner is null and o.n_writers > 0),
    p as (select a, b, count(distinct coll) n, min(coll) first_coll, bool_or(ar) ar, bool_or(aw) aw, bool_or(br) br, bool_or(bw) bw, min(owner) lo, max(owner) hi, min(basis) basis from links group by 1, 2),
    q as (select *, case when lo = hi then lo = a else coalesce(aw and not bw, false) end swap from p)
"""


@query(_PAIRS + """select case when swap then b else a end src_repo, case when swap then a else b end target_repo, n n_collections, first_coll, case when lo = hi then lo end as owner, case when lo = hi then basis end owner_basis,
    concat_ws(',', case when case when swap then br else ar end then 'read' end, case when case when swap then bw else aw end then 'write' end) src_modes,
    concat_ws(',', case when case when swap then ar else br end then 'read' end, case when case when swap then aw else bw end then 'write' end) target_modes, aw and bw and lo is null bidirectional from q""")
def shared_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = coupling.stitch_summary(access_of(spark, sf))
    return e.select("src_repo", "target_repo", "n_collections", F.col("first_collection").alias("first_coll"), "owner", "owner_basis", F.array_join("src_modes", ",").alias("src_modes"), F.array_join("target_modes", ",").alias("target_modes"), "bidirectional")


@query(_PAIRS + "select case when lo = hi then basis else '(several or none)' end as basis, count(*) n from q group by 1")
def shared_direction(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.stitch_summary(access_of(spark, sf), collections="none").groupBy(F.coalesce("owner_basis", F.lit("(several or none)")).alias("basis")).agg(F.count("*").alias("n"))


@query(_ACCESS + "select repo, 'parts' store, coll collection, o.n_writers - 1 n_others from modes join owners o using (coll) where writes and o.n_writers > 1")
def co_writers(spark: SparkSession, sf: str) -> DataFrame:
    return coupling.co_writers(coupling.access_modes(access_of(spark, sf)))


_STORE = "with e as (select 's' || l_suppkey page, 'o' || l_orderkey dst, 'c' || l_partkey % 50 coll, l_returnflag f, case when l_linenumber = 1 then 's' || l_suppkey end as owner from lineitem) "


def store_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    modes = F.when(F.col("l_returnflag") == "R", F.array(F.lit("r"), F.lit("w"))).when(F.col("l_returnflag") == "A", F.array(F.lit("write"))).otherwise(F.array(F.lit("read")))
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("page"), F.concat(F.lit("o"), "l_orderkey").alias("dst"), F.lit("mongo").alias("store"), F.array(F.concat(F.lit("c"), F.col("l_partkey") % 50)).alias("collections"), modes.alias("this_modes"), F.array(F.lit("read")).alias("target_modes"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("s"), "l_suppkey")).alias("owner"))


@query(_STORE + """, s as (select coll, page who, f in ('R', 'N') r, f in ('R', 'A') w, owner from e union all select coll, dst, true, false, owner from e)
    select 'mongo' store, coll collection, count(distinct case when r then who end) n_readers, count(distinct case when w then who end) n_writers, count(distinct owner) n_owners, min(case when w then who end) first_writer from s group by 2""")
def store_access(spark: SparkSession, sf: str) -> DataFrame:
    a = coupling.store_access(store_edges(spark, sf))
    return a.select("store", "collection", F.size("readers").cast("bigint").alias("n_readers"), F.size("writers").cast("bigint").alias("n_writers"), F.size("owners").cast("bigint").alias("n_owners"), F.array_min("writers").alias("first_writer"))


@query(_STORE + "select page subsystem, count(*) store_edges, count(distinct coll) n_collections, 'mongo' stores from e group by 1")
def touch_points(spark: SparkSession, sf: str) -> DataFrame:
    from edgeloom.operators import generated

    return generated.touch_points(store_edges(spark, sf)).select("subsystem", "store_edges", F.col("n_collections").cast("bigint").alias("n_collections"), F.array_join("stores", ",").alias("stores"))


@query(_SITES + """, l as (select src_repo, target_service, endpoint_family, arg_min(kind, seq) kind, arg_min(site, coalesce(prov_rank, 5)::bigint * 1000000000 + seq) provenance, bool_or(condition is not null) c from sites group by 1, 2, 3)
    select case src_repo when 'en' then 'English' when 'de' then 'Deutsch' else src_repo end page, '[[' || case target_service when 'ext:blog.tionsh.example.net' then 'Blog' else target_service end || ']]' target, kind as type, endpoint_family endpoint,
           case when c then 'use_campaign' end condition, provenance, src_repo not in ('en', 'de') home_unmapped from l""")
def emit_patches(spark: SparkSession, sf: str) -> DataFrame:
    e = edges.logical_edges(sites_of(spark, sf)).withColumn("grounded", F.lit(False))
    pages = spark.createDataFrame([("en", "English"), ("de", "Deutsch")], "repo string, title string")
    services = spark.createDataFrame([("ext:blog.tionsh.example.net", "Blog")], "service string, title string")
    return emit.logical_patches(e, pages, services).select("page", "target", "type", "endpoint", "condition", "provenance", "home_unmapped")


@query(_SITES + "select src_repo, count(distinct target_service || endpoint_family) n from sites where src_repo not in ('en', 'de') group by 1")
def unmapped_homes(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.createDataFrame([("en", "English"), ("de", "Deutsch")], "repo string, title string")
    return emit.unmapped_homes(emit.home_page(edges.logical_edge_summary(sites_of(spark, sf)), pages))


@query("select 'E' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end id, o_orderkey from (select o_orderkey, row_number() over (order by o_custkey, o_orderkey) n from orders)")
def sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.sequential_ids(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "E").select("id", "o_orderkey")
