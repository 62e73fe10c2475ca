"""Graph operators bound to the driver's tables: the tree of regions, nations, suppliers and customers, and parts as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import generated, graph, ordering
from edgeloom.plans.registry import query, table

_TREE = """
    with recursive tree as (
        select 'n' || n_nationkey src, 'part_of' field, 'r' || n_regionkey dst from nation
        union all select 's' || s_suppkey, 'part_of', 'n' || s_nationkey from supplier
        union all select 'c' || c_custkey, 'owner', 'n' || c_nationkey from customer where c_acctbal >= 0),
    both_ways as (select src, dst from tree union all select dst, src from tree),
    titles as (select 'r' || r_regionkey title from region union all select 'n' || n_nationkey from nation union all select 's' || s_suppkey from supplier union all select 'c' || c_custkey from customer)
"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nations, suppliers and customers below their parents; customers in debt have no link, so that there are orphans."""

    def edge(df: DataFrame, a: str, key: str, field: str, b: str, up: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), key).alias("src"), F.lit(field).alias("field"), F.concat(F.lit(b), up).alias("dst"))

    n = edge(table(spark, sf, "nation"), "n", "n_nationkey", "part_of", "r", "n_regionkey")
    s = edge(table(spark, sf, "supplier"), "s", "s_suppkey", "part_of", "n", "s_nationkey")
    return n.unionByName(s).unionByName(edge(table(spark, sf, "customer").where("c_acctbal >= 0"), "c", "c_custkey", "owner", "n", "c_nationkey"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey")]
    frames = [table(spark, sf, t).select(F.concat(F.lit(p), k).alias("title")) for t, p, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def root(spark: SparkSession, title: str = "s0") -> DataFrame:
    return spark.createDataFrame([(title,)], "title string")


_WALK = ", walk(title, hop) as (select 's0', 0 union select w.dst, hop + 1 from walk join {} w on w.src = title where hop < {}) "


@query(_TREE + _WALK.format("both_ways", 4) + "select title, min(hop) hop from walk group by 1")
def graph_query(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(tree(spark, sf), root(spark), depth=4)


@query(_TREE + _WALK.format("tree", 10) + "select title, min(hop) hop from walk group by 1")
def graph_query_up(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(tree(spark, sf), root(spark), depth=10, direction="up")


@query(_TREE + ", walk(title, hop) as (select 'r0', 0 union select w.src, hop + 1 from walk join tree w on w.dst = title and w.field = 'part_of' where hop < 2) select title, min(hop) hop from walk group by 1")
def graph_query_fields(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(graph.of_fields(tree(spark, sf), ["part_of"]), root(spark, "r0"), depth=2, direction="down")


@query(_TREE + """, walk(title, path) as (select 's0', ['s0'] union all select w.dst, list_append(path, w.dst) from walk join both_ways w on w.src = title where not list_contains(path, w.dst) and len(path) < 9),
    best as (select path from walk where title = 's1' order by len(path) limit 1)
    select i::int hop, path[i] src, path[i + 1] dst from best, unnest(range(1, len(path))) t(i)""")
def graph_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bridge(tree(spark, sf), "s0", "s1")


_DEGREES = ", d as (select title, sum(i)::bigint inbound, sum(o)::bigint outbound, sum(i + o)::bigint degree from (select src title, 0 i, 1 o from tree where src <> dst union all select dst, 1, 0 from tree where src <> dst) group by 1) "


@query(_TREE + _DEGREES + "select * from d order by degree desc, title limit 10")
def centrality(spark: SparkSession, sf: str) -> DataFrame:
    return graph.centrality(tree(spark, sf), 10)


@query(_TREE + _DEGREES + "select * from d")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(tree(spark, sf))


@query(_TREE + "select title from titles where title not in (select src from tree union select dst from tree)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return graph.orphans(titles(spark, sf), tree(spark, sf))


@query(_TREE + _WALK.format("both_ways", 2) + "select src, field, dst from tree where src in (select title from walk) and dst in (select title from walk)")
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subgraph(tree(spark, sf), root(spark), depth=2)


@query(_TREE + """select (select count(*) from titles where title not like 'r%') total_pages, (select count(*) from (select title from titles union select src from tree union select dst from tree)) total_nodes,
    (select count(*) from tree) total_links, (select count(distinct field) from tree) fields, (select count(*) from tree where dst like 'r%') broken_links""")
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return graph.describe(titles(spark, sf).where("title not like 'r%'"), tree(spark, sf))


@query(_TREE + "select '  ' || src || ' -->|' || field || '| ' || dst as line from tree")
def mermaid(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mermaid(tree(spark, sf))


@query(_TREE + "select src, field, dst from tree where src = 'n1' or dst = 'n1'")
def edges_of_node(spark: SparkSession, sf: str) -> DataFrame:
    from edgeloom.operators.edges import touching

    return touching(tree(spark, sf), "n1")


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Small parts as pages, titled with a typographic dash; links to the others are broken."""
    p = table(spark, sf, "part").where("p_size <= 25")
    return p.select(F.concat(F.lit("parts/p"), "p_partkey", F.lit(".md")).alias("rel"), F.col("p_partkey").alias("walk_no"), F.concat(F.lit("Part – "), "p_partkey").alias("title"), F.array(F.concat(F.col("p_brand"), F.lit(" "), "p_partkey")).alias("aliases"), F.concat(F.lit("p"), "p_partkey").alias("stem"), "p_name")


def part_links(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    target = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("[[PART-"), "l_partkey", F.lit("]]"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("[[P"), "l_partkey", F.lit("]]"))).otherwise(F.concat(F.lit("[[Part  ‐ "), "l_partkey", F.lit("]]")))
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("page"), target.alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("endpoint"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("provenance"))


_LINKS = """
    with small as (select p_partkey k from part where p_size <= 25),
    links as (select 's' || l_suppkey page, case l_linenumber when 1 then 'PART-' || l_partkey when 2 then 'P' || l_partkey else 'Part  ‐ ' || l_partkey end target, l_partkey k, l_returnflag as type, l_linestatus endpoint, 'f' || l_linenumber provenance
              from lineitem)
"""


@query(_LINKS + "select page, '[[' || target || ']]' dst, type, endpoint, provenance from links where k not in (select k from small)")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.broken(part_links(spark, sf), graph.page_names(part_pages(spark, sf)))


@query(_LINKS + """select target, count(distinct (page, type, endpoint, provenance)) n_edges, count(distinct page) n_sources, string_agg(distinct type, ',' order by type) types, string_agg(distinct endpoint, ',' order by endpoint) endpoints
    from links where k not in (select k from small) group by 1""")
def dead_ends(spark: SparkSession, sf: str) -> DataFrame:
    d = graph.dead_ends(part_links(spark, sf), graph.page_names(part_pages(spark, sf)))
    return d.select("target", "n_edges", F.size("sources").cast("bigint").alias("n_sources"), F.array_join("types", ",").alias("types"), F.array_join("endpoints", ",").alias("endpoints"))


@query(_LINKS + "select page, type, case when s.k is null then target else 'Part – ' || s.k end dst, s.k is null external_target from links l left join small s using (k)")
def served_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = part_pages(spark, sf)
    return graph.served_edges(part_links(spark, sf), graph.page_names(p), p).select("page", "type", "dst", "external_target")


@query("select replace(p_name, ' ', ' ') as key, min(p_partkey) n_first, count(*) n from part where p_size <= 25 group by 1 having count(*) > 1")
def title_collisions(spark: SparkSession, sf: str) -> DataFrame:
    p = part_pages(spark, sf).select(T.normalize_title("p_name").alias("key"), "rel", F.lit(0).alias("rank"), "walk_no")
    c = ordering.key_collisions(p)
    return c.select("key", F.regexp_extract("owner", "p([0-9]+)", 1).cast("bigint").alias("n_first"), "n")


@query("select regexp_replace(h, '[?#].*$', '') as target, count(*) as n_links, count(distinct page_id) as n_pages from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) h from pages) group by 1")
def page_link_targets(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)).alias("h"))
    return links.groupBy(F.regexp_replace("h", "[?#].*$", "").alias("target")).agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


@query("select 's' || s_suppkey src, 'link' field, t as dst from supplier, unnest(['n' || s_nationkey, 'r1']) x(t)")
def body_links(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return graph.body_links(s.select(F.concat(F.lit("s"), "s_suppkey").alias("title"), F.concat(F.lit("see [[n"), "s_nationkey", F.lit("|its nation]] and [[ r1#top ]], not [x]")).alias("body")))


_NODES = """
    with nodes as (select p_partkey seq, case p_partkey % 5 when 0 then replace(p_name, ' ', '_') || '-' || p_size when 1 then p_name when 2 then 'var.' || replace(p_name, ' ', '_') when 3 then replace(p_name, ' ', '-') || '-' || p_size else '(unset:var.x)-' || p_size end as name, lower(p_type) kind from part),
    c as (select *, case when name like '(unset:%' or name like 'var.%' then 'unresolved' when contains(name, ' ') then 'not-a-name' else 'publishable' end class from nodes),
    f as (select *, row_number() over (partition by class, name order by seq) rn from c),
    w as (select *, replace(name, '_', '-') slug from f where class = 'publishable' and rn = 1),
    s as (select *, row_number() over (partition by slug order by seq) a from w),
    m as (select *, sum(case when a > 1 then 1 else 0 end) over (partition by slug, kind order by seq) b from s)
"""


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    value = F.when(k == 0, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("-"), "p_size")).when(k == 1, name).when(k == 2, F.concat(F.lit("var."), F.replace(name, F.lit(" "), F.lit("_"))))
    value = value.when(k == 3, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), "p_size")).otherwise(F.concat(F.lit("(unset:var.x)-"), "p_size"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), value.alias("name"), F.lower("p_type").alias("kind"))


def no_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string")


@query(_NODES + """select seq, name, class, case when class <> 'publishable' then 'deferred' when rn > 1 then 'repeated' else 'written' end status,
    case when class = 'publishable' and rn = 1 then 'deployed/' || case when m.a = 1 then m.slug when m.b = 1 then m.slug || '--' || kind else m.slug || '--' || kind || '-' || m.b end || '.md' end as path
    from f left join (select seq, slug, a, b from m) m using (seq)""")
def slug_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return generated.node_pages(part_nodes(spark, sf), no_names(spark)).select("seq", "name", "class", "status", "path")


@query(_NODES + "select count(*) filter (class = 'publishable') publishable, count(*) filter (class = 'unresolved') unresolved, count(*) filter (class = 'not-a-name') not_a_name from c")
def deferred_counts(spark: SparkSession, sf: str) -> DataFrame:
    return generated.deferred_counts(generated.node_pages(part_nodes(spark, sf), no_names(spark)))


@query("select 'external/' || regexp_replace(regexp_replace(lower(replace(target, '  ‐ ', '-')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' as path, target, n_edges from (" + _LINKS + "select target, count(distinct (page, type, endpoint, provenance)) n_edges from links where k not in (select k from small) group by 1)")
def stub_pages(spark: SparkSession, sf: str) -> DataFrame:
    dead = graph.dead_ends(part_links(spark, sf), graph.page_names(part_pages(spark, sf)), rows=generated.edge_row())
    return generated.stub_pages(dead, None, "2024-01-01").select("path", "target", "n_edges")


@query("""with n as (select 's' || s_suppkey as name from supplier), p as (select 's' || l_suppkey page, 's' || (l_partkey % 100) target, l_returnflag as type, 'f' || l_linenumber provenance from lineitem)
    select name, target peer, 'out' direction, type, '-' endpoint, provenance from p join n on name = page union all select name, page, 'in', type, '-', provenance from p join n on name = target where page <> target""")
def edges_touching(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"))
    li = table(spark, sf, "lineitem")
    p = li.select(F.concat(F.lit("s"), "l_suppkey").alias("page"), F.concat(F.lit("[[S"), F.col("l_partkey") % 100, F.lit("]]")).alias("target"), F.col("l_returnflag").alias("type"), F.lit("-").alias("endpoint"), F.concat(F.lit("f"), "l_linenumber").alias("provenance"))
    return generated.edges_touching(nodes, p).withColumn("peer", F.lower("peer"))
