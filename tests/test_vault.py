"""Pages on disk: reading, checking, merging, writing."""

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import drift, generated, graph, merge, quality
from edgeloom.sources import frontmatter as fm
from edgeloom.sources import snapshots, vault

GATEWAY = """---
title: Gateway – Main
type: service
updated: 2024-01-02
aliases: [gw, "the gateway"]
depends_on:
  - "[[Store]]"
  - '[[Missing]]'
cross_service:
  - target: "[[Store]]"
    type: shares-datastore
    store: mongo
    collections: [users, orders]
    access: {this: [read], target: [read, write]}
    owner: "[[Store]]"
    provenance: app/x.py:3
    extracted_from:
      repo: app
      sha: abc1234
      at: 2024-01-01T00:00:00Z
  - target: "[[ext:host]]"
    type: http-call
    endpoint: /v1
    extracted_from: {repo: app, sha: x}
---
# Gateway

See [[Store|the store]].

## Empty

## Notes
TODO write
```
<token> TODO
```
"""
STORE = "---\ntitle: Store\ntype: component\nsummary: |\n  two\n  lines\n---\n# Store\ntext\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    for rel, text in {"services/gateway.md": GATEWAY, "services/store.md": STORE, "odd.md": "---\na: [1\n---\nx", "bare.md": "no head\n", "_schema/service.md": "## Required Frontmatter\n```yaml\ntitle: x\nsummary: x\n```\n", ".hidden/x.md": "x"}.items():
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def pages(spark, root):
    return vault.parse_pages(vault.texts(spark, root)).cache()


def test_scan(spark, root, pages):
    assert [r["rel"] for r in pages.orderBy("walk_no").collect()] == ["bare.md", "odd.md", "services/gateway.md", "services/store.md"]
    assert vault.walk(root, ()) == [".hidden/x.md", "_schema/service.md", "bare.md", "odd.md", "services/gateway.md", "services/store.md"]
    rows = {r["rel"]: r for r in pages.collect()}
    assert rows["odd.md"]["parse_error"] and not rows["bare.md"]["fm_present"]
    assert rows["services/gateway.md"]["updated"] == "2024-01-02" and rows["services/gateway.md"]["aliases"] == ["gw", "the gateway"]
    assert rows["services/store.md"]["fm"]["summary"] == "two\nlines\n"


def test_links_and_edges(pages):
    names = graph.page_names(pages)
    links = vault.coarse_links(pages)
    assert [(r["src"], r["dst"]) for r in graph.broken(links, names).collect()] == [("Gateway – Main", "Missing")]
    assert [r["dst"] for r in graph.body_links(pages).collect()] == ["Store"]
    edges = vault.runtime_edges(pages)
    served = {r["dst"]: r["external_target"] for r in graph.served_edges(edges, names, pages).collect()}
    assert served == {"Store": False, "ext:host": True}
    stamps = {r["type"]: r["extracted_from"] for r in edges.collect()}
    assert stamps["http-call"] is None and stamps["shares-datastore"]["sha"] == "abc1234"


def test_checks(spark, root, pages):
    required = vault.required_fields(spark, root)
    assert {(r["type"], r["field"]) for r in required.collect()} == {("service", "title"), ("service", "summary")}
    schema = {(r["page"], r["message"]) for r in quality.check_schema(pages, required).collect()}
    assert ("services/gateway.md", "missing required field summary") in schema and ("bare.md", "no frontmatter") in schema and len(schema) == 3
    sections = {(r["message"], r["line"]) for r in quality.check_sections(pages.where("rel = 'services/gateway.md'")).collect()}
    assert sections == {("empty section: ## Empty", 5), ("placeholder TODO", 8), ("placeholder TODO", 10)}
    assert [r["message"] for r in quality.check_types(pages).collect()] == ["type is component, the folder implies service"]
    edges = vault.runtime_edges(pages)
    stale = {r["message"] for r in quality.check_staleness(pages, edges, "2024-03-01", 30).collect()}
    assert "1 edges without a freshness stamp" in stale and "updated 59 days ago" in stale
    assert quality.outcome(quality.check_types(pages), pages.limit(0)).first()["status"] == "nothing-assessed"
    found = {"types": quality.check_types(pages), "sections": quality.check_sections(pages)}
    codes = [quality.exit_code(quality.lint(found, c), p, f).first()["code"] for c, p, f in (("types", pages, "error"), ("types", pages, "warn"), ("all", pages, "error"), ("all", pages.limit(0), "error"))]
    assert codes == [quality.PASSED, quality.FAILED, quality.FAILED, quality.NOTHING_ASSESSED]
    with pytest.raises(ValueError, match="no such check"):
        quality.selected("types,spelling")
    fallback = {r["message"] for r in quality.check_schema(pages).where("page = 'services/gateway.md'").collect()}
    assert {"missing required field status", "missing required field summary"} <= fallback


def test_generated(spark, root, pages):
    names = graph.page_names(pages)
    edges = vault.runtime_edges(pages)
    dead = graph.dead_ends(edges, names)
    e = graph.broken(edges, names).select(T.strip_wikilink("dst").alias("target"), F.col("page").alias("source"), "type", "endpoint", "provenance")
    (stub,) = generated.stub_pages(dead, e, "2024-01-01").collect()
    assert stub["path"] == "external/ext-host.md" and fm.parse(fm.split(stub["text"])[0])["related_to"] == ["[[Gateway – Main]]"]
    assert vault.write_pages(spark.createDataFrame([stub]), root) == 1 and vault.write_pages(spark.createDataFrame([stub]), root) == 0
    nodes = spark.createDataFrame([(1, "a_b", "x"), (2, "a-b", "job"), (3, "var.x", "x"), (4, "two words", "x"), (5, "a.b", "job"), (6, "a+b", "job"), (7, "a_b", "x")], "seq int, name string, kind string")
    got = {r["name"]: (r["status"], r["path"]) for r in generated.node_pages(nodes, names).orderBy(F.desc("seq")).collect()}
    assert got == {"a_b": ("written", "deployed/a-b.md"), "a-b": ("written", "deployed/a-b--job.md"), "a.b": ("written", "deployed/a-b--job-2.md"), "var.x": ("deferred", None), "two words": ("deferred", None), "a+b": ("deferred", None)}


def test_upsert_is_idempotent(spark):
    schema = "page string, seq bigint, target string, type string, endpoint string, condition string, extracted_from string"
    stored = spark.createDataFrame([("p", 0, "[[A – b]]", "x", None, None, "old"), ("p", 1, "[[a-b]]", "x", None, "c", "dup")], schema)
    incoming = spark.createDataFrame([("p", 0, "[[a - B]]", "x", None, "new", "fresh"), ("p", 1, "[[z]]", "x", "/e", None, "fresh")], schema)
    once = merge.upsert(stored, incoming)
    got = sorted(((r["target"], r["condition"], r["extracted_from"], r["outcome"]) for r in once.collect()), key=str)
    assert got == [("[[A – b]]", "new", "fresh", "merged"), ("[[a-b]]", "c", "dup", "kept"), ("[[z]]", None, "fresh", "added")]
    twice = merge.upsert(once.drop("outcome").withColumn("seq", F.coalesce("seq", F.lit(9))), incoming)
    assert sorted((r["target"], str(r["condition"]), r["extracted_from"]) for r in twice.collect()) == sorted((t, str(c), s) for t, c, s, _ in got)


def test_frontmatter_round_trip():
    value = {"title": "a: b", "n": 3, "f": 1.5, "t": True, "none": None, "date": "2024-01-02", "list": ["x", {"a": 1, "b": ["c", "- d"]}], "map": {"k": "v", "e": []}, "text": "two\nlines", "word": "true", "hash": "a # b"}
    text = "\n".join(fm.emit(k, v) for k, v in value.items())
    assert fm.parse(text) == value
    assert fm.parse(fm.replace_key(text, "list", ["y"])) == value | {"list": ["y"]}
    for wrong in ("a: [1", "a: 1\na: 2", "\ta: 1", "- x", 'a: "x'):
        with pytest.raises(fm.ParseError):
            fm.parse(wrong)


def test_names(spark):
    row = spark.range(1).select(
        T.normalize_title(F.lit("A –  B ‑ c")).alias("t"), T.norm_id(F.lit("x/y/Foo-prod")).alias("i"), T.slugify(F.lit("É!!")).alias("s"), T.slugify(F.lit("--")).alias("u"), T.strip_wikilink(F.lit(" [[a]] ")).alias("w"),
        T.endpoint_family(F.lit("/a/{x}/b:c/d/e/f")).alias("e"), T.endpoint_family(F.lit(None).cast("string")).alias("n"), T.host_to_service(F.lit("https://a.b.run.app:1/x")).alias("h"), T.unset_refs(F.lit("a-(unset:var.x)-(unset:local.y)")).alias("r"), T.self_link_tail(F.lit("https://c.googleapis.com/v1/projects/p/z/default")).alias("l"),
    ).first()
    assert tuple(row) == ("a-b-c", "foo", "unnamed", "unnamed", "a", "/a/d/e", "(none)", "cloudrun:a", ["var.x", "local.y"], "default")
    assert T.glob_to_regex("[!a]*?[") == "^(?:[^a].*.\\[)\\z"


def test_drift(spark):
    rows = [("p", "r", "abc", "2024-01-01"), ("p", "r", "zzz", None), ("q", None, None, None), ("q", "r", "unknown", None), ("s", "none", "abc", None), ("t", "r", "abc123", "2020-01-01")]
    records = spark.createDataFrame(rows, "page string, repo string, sha string, at string")
    heads = spark.createDataFrame([("r", "abc123")], "repo string, head string")
    got = drift.assess(records, heads, "2024-01-02", 100)
    assert sorted(r["status"] for r in got.collect()) == ["current", "stale", "stale", "unknown", "unknown", "unknown"]
    assert {r["page"]: r["status"] for r in drift.worst_per_page(got).collect()} == {"p": "stale", "q": "unknown", "s": "unknown", "t": "stale"}
    assert [drift.exit_code(*x) for x in ((0, 0, 0), (3, 1, 1), (3, 0, 1), (3, 0, 0), (3, 0, 0, 1))] == [3, 1, 2, 0, 2]


def test_snapshots(spark):
    live = '{"compute":{"services":[{"metadata":{"name":"Api","annotations":{"run.googleapis.com/ingress":"all"}},"status":{"url":"u"}}]},"networking":{"subnets":[{"name":"sub-prod","network":"x/net","region":"eu"}]},"messaging":{"subscriptions":[{"name":"s","topic":"t"}]},"identity_invoke":{"invoke_policies":[{"service":"Api","policy":{"bindings":[{"role":"roles/run.invoker","members":["serviceAccount:a"]},{"role":"viewer","members":["b"]}]}}]}}'
    ready = '{"nodes":[{"name":"n","kind":"k","attrs":{"a":"1"}}],"edges":[{"from":"a","to":"b","type":"x"}]}'
    docs = spark.createDataFrame([(live,), (ready,)], "doc string")
    nodes, edges = snapshots.canonical(docs)
    assert {(r["name"], r["kind"], r["attrs"].get("ingress")) for r in nodes.collect()} == {("Api", "cloud-run-service", "all"), ("sub", "network-subnet", None), ("n", "k", None)}
    assert {(r["src"], r["type"], r["dst"]) for r in edges.collect()} == {("sub", "part-of-network", "net"), ("s", "subscribes-to", "t"), ("serviceAccount:a", "invokes", "Api"), ("a", "x", "b")}
    facts = spark.createDataFrame([('{"_meta":{"ok":true},"facts":{"e1":{"resolves":true}}}',), ('{"e2":{"resolves":false}}',)], "doc string")
    assert {(r["id"], r["resolves"]) for r in snapshots.grounding_facts(facts).collect()} == {("e1", True), ("e2", False)}


def test_stream(spark, tmp_path):
    from edgeloom import streaming

    schema = "page string, seq bigint, target string, type string, endpoint string, condition string, extracted_from string"
    source, state = str(tmp_path / "in"), {"rows": spark.createDataFrame([], schema)}
    spark.createDataFrame([("p", 0, "[[a]]", "x", None, "c", "f")], schema).write.parquet(source)

    def write(rows, number):
        path = str(tmp_path / f"out{number}")
        rows.write.mode("overwrite").parquet(path)
        state["rows"] = spark.read.parquet(path)

    for _ in range(2):
        streaming.upsert_stream(spark.readStream.schema(schema).parquet(source), lambda: state["rows"], write, str(tmp_path / "cp")).awaitTermination()
    assert [(r["target"], r["condition"]) for r in state["rows"].collect()] == [("[[a]]", "c")]
