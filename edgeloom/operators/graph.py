"""Graph questions over edge frames (src, dst): neighbourhoods, paths, hubs, orphans, broken links, served edges.

Traversals are loops over frontiers: each hop joins only the frontier with the edges and anti-joins what was seen, and
its result is written to the checkpoint folder, so neither the plan nor a recomputation grows with the hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators.shared import cut

MAX_DEPTH = 10


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(src, dst) to walk along: up (what a node depends on), down (its dependants) or both."""
    forward = edges.select("src", "dst")
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("up", "down", "both"):
        raise ValueError(f"no direction {direction!r}")
    return {"up": forward, "down": backward}.get(direction) or forward.unionByName(backward)


def of_fields(edges: DataFrame, fields: list[str] | None) -> DataFrame:
    return edges if fields is None else edges.where(F.col("field").isin(fields))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """title, hop: nodes within `depth` hops (at most 10) of the roots(title), with the least number of hops."""
    step = cut(directed(edges, direction).where("src <> dst").distinct())
    seen = cut(roots.select("title").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, min(depth, MAX_DEPTH) + 1):
        reached = frontier.select(F.col("title").alias("src")).join(step, "src").select(F.col("dst").alias("title")).distinct()
        frontier = cut(reached.join(seen, "title", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bridge(edges: DataFrame, start: str, end: str, depth: int = MAX_DEPTH, direction: str = "both") -> DataFrame:
    """hop, src, dst of a shortest path from start to end; empty if there is none within `depth`.

    Of several the one whose nodes come first in order, seen from the end: each node keeps its smallest parent.
    """
    spark = edges.sparkSession
    step = cut(directed(edges, direction).where("src <> dst").distinct())
    layers = [cut(spark.createDataFrame([(start, None)], "title string, parent string"))]
    seen = layers[0].select("title")
    found = start == end
    while not found and len(layers) <= depth:
        reached = layers[-1].select(F.col("title").alias("src")).join(step, "src").groupBy(F.col("dst").alias("title")).agg(F.min("src").alias("parent"))
        layer = cut(reached.join(seen, "title", "left_anti"))
        if layer.isEmpty():
            break
        layers.append(layer)
        seen = seen.unionByName(layer.select("title"))
        found = not layer.where(F.col("title") == end).isEmpty()
    path, node = [], end
    if found:
        for layer in reversed(layers[1:]):  # one row a hop
            parent = layer.where(F.col("title") == node).first()["parent"]
            path.append((parent, node))
            node = parent
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(reversed(path))], "hop int, src string, dst string")


def vertices(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages and whatever links name."""
    return pages.select("title").union(edges.select("src")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """title, inbound, outbound, degree; links of a node to itself do not count."""
    e = edges.where("src <> dst")
    ends = e.select(F.col("src").alias("title"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("title"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("title").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound")).withColumn("degree", F.col("inbound") + F.col("outbound"))


def centrality(edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """The nodes of the largest degree, ties by title. The limit is the question's."""
    d = degrees(edges).orderBy(F.desc("degree"), "title")
    return d if limit is None else d.limit(limit)


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without a link in or out."""
    linked = edges.select(F.col("src").alias("title")).union(edges.select(F.col("dst").alias("title"))).distinct()
    return pages.join(linked, "title", "left_anti")


def page_names(pages: DataFrame) -> DataFrame:
    """key, rel, rank, walk_no: every name a page answers to. Titles come before aliases, and those before file stems."""
    titles = pages.select(T.normalize_title("title").alias("key"), "rel", F.lit(0).alias("rank"), "walk_no").where("key is not null")
    aliases = pages.select(F.explode("aliases").alias("a"), "rel", "walk_no").select(T.normalize_title("a").alias("key"), "rel", F.lit(1).alias("rank"), "walk_no")
    stems = pages.select(T.normalize_title("stem").alias("key"), "rel", F.lit(2).alias("rank"), "walk_no")
    return titles.unionByName(aliases).unionByName(stems).where("key <> ''")


def exact_names(pages: DataFrame) -> DataFrame:
    """name, rel, rank, walk_no: titles and aliases as they are written."""
    titles = pages.select(F.col("title").alias("name"), "rel", F.lit(0).alias("rank"), "walk_no")
    aliases = pages.select(F.explode("aliases").alias("name"), "rel", F.lit(1).alias("rank"), "walk_no")
    return titles.unionByName(aliases).where("name is not null and name <> ''")


def resolve_titles(links: DataFrame, names: DataFrame, target: str = "dst", out: str = "page", exact: DataFrame | None = None) -> DataFrame:
    """links with the page that owns their target's name: as it is written, if exact names are given, else normalised;
    null if none does."""
    owner = names.groupBy(F.col("key").alias("_key")).agg(F.min_by("rel", F.struct("rank", "walk_no")).alias("_normal"))
    found = links.withColumn("_name", T.strip_wikilink(target)).withColumn("_key", T.normalize_title("_name")).join(owner, "_key", "left")
    if exact is None:
        return found.withColumnRenamed("_normal", out).drop("_key", "_name")
    same = exact.groupBy(F.col("name").alias("_name")).agg(F.min_by("rel", F.struct("rank", "walk_no")).alias("_same"))
    return found.join(same, "_name", "left").withColumn(out, F.coalesce("_same", "_normal")).drop("_key", "_name", "_same", "_normal")


def broken(links: DataFrame, names: DataFrame, target: str = "dst") -> DataFrame:
    """Links whose target no page answers to."""
    keyed = links.withColumn("_key", T.normalize_title(T.strip_wikilink(target)))
    return keyed.join(names.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def dead_ends(edges: DataFrame, names: DataFrame, **lists: Column) -> DataFrame:
    """target, n_edges, sources, types, endpoints, provenance: what no page answers to, from distinct edges(page, dst,
    type, endpoint, provenance). Sets are sorted. lists: further sorted sets, of expressions over an edge(target, source,
    type, endpoint, provenance). Edges are counted by target first, as names are compared once a target then."""
    e = edges.select(T.strip_wikilink("dst").alias("target"), F.col("page").alias("source"), "type", "endpoint", "provenance").where("target <> ''").distinct()

    def values(c: str):
        return F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))

    sets = (values(c).alias(n) for c, n in (("source", "sources"), ("type", "types"), ("endpoint", "endpoints"), ("provenance", "provenance")))
    counted = e.groupBy("target").agg(F.count("*").alias("n_edges"), *sets, *(F.array_sort(F.collect_set(c)).alias(n) for n, c in lists.items()))
    return broken(counted, names, "target")


def served_edges(edges: DataFrame, names: DataFrame, titles: DataFrame) -> DataFrame:
    """Typed edges with their target's title where a page answers to it, and external_target where none does."""
    found = resolve_titles(edges, names, "dst", "_rel")
    found = found.join(titles.select(F.col("rel").alias("_rel"), F.col("title").alias("_title")), "_rel", "left")
    return found.withColumn("external_target", F.col("_rel").isNull()).withColumn("dst", F.coalesce("_title", T.strip_wikilink("dst"))).drop("_rel", "_title")


def lookup(pages: DataFrame, name: str) -> str:
    """The title meant by `name`: exact, else without case, else the only one that contains it; raises if none or several."""
    low = name.lower()
    t = pages.select("title").where(F.lower("title").contains(low)).distinct()
    rank = F.when(F.col("title") == name, 0).when(F.lower("title") == low, 1).otherwise(2)
    best = [r["title"] for r in t.orderBy(rank, "title").limit(6).collect()]
    if not best:
        raise LookupError(f"no page for {name!r}")
    if best[0] == name or best[0].lower() == low or len(best) == 1:
        return best[0]
    raise LookupError(f"{name!r} may be any of {best}")


def body_links(pages: DataFrame) -> DataFrame:
    """src, field, dst of the wiki links in page bodies."""
    found = F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), 1)
    return pages.select(F.col("title").alias("src"), F.lit("link").alias("field"), F.explode(found).alias("dst")).withColumn("dst", F.trim("dst"))


def subgraph(edges: DataFrame, roots: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """The edges between the nodes of a neighbourhood."""
    nodes = neighbourhood(edges, roots, depth, direction).select("title")
    inside = edges.join(nodes.select(F.col("title").alias("src")), "src", "left_semi")
    return inside.join(nodes.select(F.col("title").alias("dst")), "dst", "left_semi").select(edges.columns)


def describe(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages, nodes, links, linked fields and links to no page."""
    titles = pages.select(F.col("title").alias("dst")).distinct()
    nodes = vertices(pages, edges).agg(F.count("*").alias("total_nodes"))
    counts = edges.agg(F.count("*").alias("total_links"), F.count_distinct("field").alias("fields"))
    lost = edges.join(titles, "dst", "left_anti").agg(F.count("*").alias("broken_links"))
    return pages.agg(F.count("*").alias("total_pages")).join(nodes, how="cross").join(counts, how="cross").join(lost, how="cross")  # of one row each


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a diagram: one for each edge."""
    return edges.select(F.format_string("  %s -->|%s| %s", T.slugify("src"), F.coalesce(F.col("field"), F.lit("link")), T.slugify("dst")).alias("line"))


def text_line() -> Column:
    """An edge as a line of text."""
    return F.concat(F.lit("  "), F.col("src"), F.lit(" --"), F.coalesce("field", F.lit("link")), F.lit("--> "), F.col("dst"))


def path_line(*nodes: str) -> Column:
    """Nodes of a path, in order."""
    return F.array_join(F.filter(F.array(*nodes), lambda n: n.isNotNull()), " -> ")


def json_line() -> Column:
    """An edge as a JSON object."""
    return F.to_json(F.struct("src", "field", "dst"))


def write_json(frame: DataFrame, path: str) -> None:
    """A result as lines of JSON, a file a partition; the folder must not be there."""
    frame.write.json(path)
