"""A small workspace from sources to patches."""

import textwrap

import pytest
from pyspark.sql import functions as F

from edgeloom.extract import hcl, javascript_source, python_source, terraform
from edgeloom.operators import coupling, edges, evaluation, graph, inventory
from edgeloom.plans import workspace_map
from edgeloom.sources import workspace as ws

CLIENT = '''
import httpx, redis
class Client:
    def __init__(self, stream):
        if stream:
            self.endpoint = "/chat/stream"
        else:
            self.endpoint = "/chat"
    def ask(self, session, settings):
        if settings.use_cache:
            return session.post(f"{settings.backend_base_url}{self.endpoint}")
    def put(self, client, key):
        url = f"{self.backend_base_url}/api/items/{key}"
        return client.put(url)
    def raw(self, client, where):
        client.request("GET", "https://oauth2.googleapis.com/token")
        client.get(where)
        return redis.Redis()
def local(http):
    base = "https://x.run.app/v1"
    http.get(f"{base}/users")
'''

SCRIPT = '''
const BASE = process.env.BACKEND_BASE_URL; // not http://here
/* axios.get("/commented")
   out */
axios.get(`${BASE}/v1/users/${id}`);
fetch("https://bitbucket.org/x");
client.get(key);
const client = new Redis(opts);
api.post(
  "/relative/path");
'''

MODELS = "export const User = mongoose.model<IUser>('User', s); mongoose.model('Category', c); mongoose.model('TestThing', t)"
STORE = '''
class Repo:
    def __init__(self, db):
        self.users = db.users
    def go(self):
        self.users.find_one({})
        self.db["categories"].insert_one({})
'''

TF = '''
variable "name" { default = "api" }
variable "sa" { default = "" }
variable "bucket" {}
locals {
  sa_email = var.sa != "" ? var.sa : data.google_account.default.email
  prefix   = "x-${var.name}"
}
# resource "google_pubsub_topic" "gone" { name = "gone" }
resource "google_cloud_run_v2_service" "svc" {
  name = "${var.name}-svc"
  service_account = local.sa_email
  template {
    env {
      name = "BACKEND_BASE_URL"
      value = "http://b"
    }
    env {
      name = "COLOUR"
      value = "red"
    }
  }
}
resource "google_pubsub_topic" "t" { name = local.prefix }
resource "google_pubsub_subscription" "s" {
  name  = "sub"
  topic = google_pubsub_topic.t.name
}
resource "google_cloud_run_service_iam_member" "i" {
  service = google_cloud_run_v2_service.svc.name
  role    = "roles/run.invoker"
  member  = "serviceAccount:bot@x"
}
resource "google_cloud_run_service_iam_member" "no" {
  service = "x"
  role    = "roles/viewer"
  member  = "serviceAccount:bot@x"
}
resource "google_bigquery_table" "tab" {
  table_id   = "tab"
  dataset_id = "ds"
  external_data_configuration {
    source_uris = ["gs://staging/users/*"]
  }
}
resource "google_storage_bucket" "b" { name = var.bucket }
resource "google_secret_manager_secret" "k" {
  secret_id = "key"
  value     = "hunter2"
}
resource "google_dns_record_set" "r" {
  name    = "app.example.com."
  type    = "A"
  rrdatas = ["203.0.113.10", "203.0.113.11"]
}
resource "google_unknown_thing" "u" { name = "nothing" }
'''

REGISTRY = "services:\n  alpha:\n    url: http://alpha:1\n    url: http://second\n  beta:\n    other: 1\n"


def by_line(rows):
    return {(r["src_line"], r["target_endpoint"]): r for r in rows}


def test_python_calls():
    rows = python_source.call_sites("app", "app/c.py", CLIENT, {"backend_base_url": "backend"})
    found = {(r["kind"], r["target_service"], r["target_endpoint"], r.get("condition"), r["confidence"]) for r in rows}
    assert ("http-call", "backend", "/chat/stream", "use_cache AND stream", "high") in found
    assert ("http-call", "backend", "/chat", "use_cache AND not (stream)", "high") in found
    assert ("http-call", "backend", "/api/items/{key}", None, "med") in found
    assert ("http-call", "GCP-OAuth", "https://oauth2.googleapis.com/token", None, "high") in found
    assert ("dynamic", "(dynamic)", "(var)", None, "low") in found
    assert ("data-store", "Redis", "(tcp)", None, "high") in found
    assert ("http-call", "cloudrun:x", "/users", None, "high") in found
    assert python_source.call_sites("app", "x.py", "def (", {}) == []


def test_javascript_calls():
    rows = javascript_source.call_sites("web", "web/src/a.js", SCRIPT, {"backend_base_url": "backend"})
    found = {(r["src_line"], r["kind"], r["target_service"], r["target_endpoint"], r["confidence"]) for r in rows}
    assert (5, "http-call", "backend", "/v1/users/{id}", "med") in found
    assert (6, "http-call", "Bitbucket", "https://bitbucket.org/x", "high") in found
    assert (9, "dynamic", "(dynamic)", "/relative/path", "low") in found
    assert (8, "data-store", "Redis", "(tcp; ioredis)", "high") in found
    assert not any("commented" in r["target_endpoint"] for r in rows) and not any(r["src_line"] == 7 for r in rows)


FORMS = """
import x from "y"; // axios.get("/gone")
const HOST: string = "https://api.bitbucket.org/2.0";
const PATH = `${HOST}/repos`;
await this.client.get<Row[]>(PATH);
got.post('/a');  https.request("https://github.com/x");
foo().fetch("/no");  myclient.get("/no");
fetch(
  `/v1/${a.b({ c: 1 })}/x`);
/* fetch("/gone") */ axios("/yes");
const s = "fetch('/string')"; // fetch("/gone")
"""


def test_javascript_forms():
    rows = javascript_source.call_sites("web", "web/tests/b.ts", FORMS, {})
    found = [(r["src_line"], r["kind"], r["target_service"], r["target_endpoint"]) for r in rows]
    assert [f for f in found if f[0] == 5] == [(5, "http-call", "Bitbucket", "/repos")] and (6, "dynamic", "(dynamic)", "/a") in found
    assert (8, "dynamic", "(dynamic)", "/v1/{a.b({ c: 1 })}/x") in found and (10, "dynamic", "(dynamic)", "/yes") in found
    assert {f[0] for f in found} == {5, 6, 8, 10} and all(r.get("prov_rank", 2) == 2 for r in rows)


def test_blocks():
    tree = hcl.parse('a = "x-${var.n}" # c\nb "l" {\n c = [1, "}", var.q[0].z] /* } */\n d { e = var.x == "y" ? "p" : q.r\n }\n f = <<T\n}\nT\n g = 2\n}\n}\nz = 1\n')
    (block,) = tree.blocks
    assert tree.attributes["a"].value == ("text", ["x-", ("ref", "var.n")]) and tree.attributes["z"].line == 12
    assert block.attributes["c"].value == ("list", [("plain", "1"), ("text", ["}"]), ("ref", "var.q[0].z")]) and block.attributes["g"].line == 9
    assert block.find("e") == ("if", ("op", "==", ("ref", "var.x"), ("text", ["y"])), ("text", ["p"]), ("ref", "q.r")) and block.find("none") is None
    for source in ("", "a", "a =", "a = [", "b {", '"', "x = ${", "a = <<E\n", "}" * 5, "b = {{{", "f = g(", "a = 1 ? 2"):
        hcl.parse(source)


def test_nested_locals():
    source = 'variable "e" { default = "dev" }\nlocals {\n a = "x-${var.e}"\n b = "${local.a}-y"\n c = local.d\n d = local.c\n}\nresource "google_pubsub_topic" "t" { name = local.b }\nresource "google_pubsub_topic" "u" { name = local.c }\nresource "google_pubsub_topic" "v" { name = var.e == "dev" ? "yes" : "no" }\n'
    found = terraform.Repository("r", {"r/m.tf": hcl.parse(source)}, {}).nodes
    assert [n["name"] for n in found] == ["x-dev-y", "(unset:local.c)", "yes"]


def test_collections(spark):
    files = spark.createDataFrame([("a", "a/m.ts", MODELS), ("b", "b/s.py", STORE), ("b", "b/tests/s.py", STORE), ("a", "a/m.test.ts", MODELS)], "repo string, rel string, text string")
    access = python_source.scan_access(files).unionByName(javascript_source.scan_models(files)).withColumn("seq", F.monotonically_increasing_id())
    got = {(r["repo"], r["collection"], r["mode"], r["model"]) for r in access.collect()}
    assert got == {("a", "users", "write", "User"), ("a", "categories", "write", "Category"), ("b", "users", "read", None), ("b", "categories", "write", None)}
    (edge,) = coupling.stitch(access).collect()
    assert (edge["src_repo"], edge["target_repo"], edge["owner"], edge["owner_basis"], edge["collections"], edge["bidirectional"]) == ("b", "a", "a", "declared-schema", ["categories", "users"], False)


def test_two_writers_own_nothing(spark):
    rows = [(i, r, "mongo", "c", m, "p", None) for i, (r, m) in enumerate([("a", "write"), ("b", "write"), ("c", "read")])]
    access = spark.createDataFrame(rows, "seq int, repo string, store string, collection string, mode string, provenance string, model string")
    got = {(r["src_repo"], r["target_repo"], r["owner"], r["bidirectional"]) for r in coupling.stitch(access).collect()}
    assert got == {("a", "b", None, True), ("c", "a", None, False), ("c", "b", None, False)}
    assert coupling.stitch(access.where("mode = 'read'")).count() == 0


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([("infra", "infra/main.tf", TF), ("infra", "infra/prod.tfvars", 'bucket = "real" # x\nn = 3\n'), ("infra", "infra/cloudbuild.yaml", "gcr.io/proj/worker:latest")], "repo string, rel string, text string")
    return files, terraform.scan(files, {"backend_base_url": "backend"}).cache()


def test_terraform(scanned):
    _, rows = scanned
    nodes = {r["name"]: r for r in terraform.nodes(rows).collect()}
    edges_ = {(r["src"], r["type"], r["dst"]) for r in terraform.edges(rows).collect()}
    unset = "(unset:data.google_account.default.email)"
    assert edges_ == {
        ("api-svc", "runs-as", unset), ("api-svc", "deploy-env", "backend"), ("sub", "subscribes-to", "x-api"), ("SA:bot@x", "invokes", "api-svc"), ("tab", "in-dataset", "ds"), ("tab", "reads-from", "staging"),
        ("app.example.com.", "dns-resolves-to", "203.0.113.10"), ("app.example.com.", "dns-resolves-to", "203.0.113.11"),
    }
    assert set(nodes) == {"api-svc", "backend", "x-api", "sub", "tab", "(unset:var.bucket)", "key", "app.example.com.", "worker"}
    assert nodes["tab"]["attrs"]["staged_collection"] == "users" and nodes["tab"]["attrs"]["external"] == "true"
    assert nodes["(unset:var.bucket)"]["unresolved_kinds"] == {"var.bucket": "deploy-time-input"} and "infra/prod.tfvars:1" in nodes["(unset:var.bucket)"]["tfvars_candidates"]
    assert "hunter2" not in str(nodes)
    runs_as = next(r for r in terraform.edges(rows).collect() if r["type"] == "runs-as")
    assert runs_as["name_basis"] == ["ternary-default-branch"] and runs_as["unresolved_kinds"] == {"data.google_account.default.email": "provider-read"}
    assert nodes["x-api"]["provenance"] == f"infra/main.tf:{TF[: TF.index('google_pubsub_topic' + chr(34) + ' ' + chr(34) + 't')].count(chr(10)) + 1}"


def test_terraform_environment(scanned):
    files, _ = scanned
    rows = terraform.scan(files, {}, {"infra": ["infra/prod.tfvars"]})
    bucket = next(r for r in terraform.nodes(rows).collect() if r["kind"] == "datastore-bucket")
    assert (bucket["name"], bucket["name_basis"], bucket["name_sources"]) == ("real", ["tfvars"], ["infra/prod.tfvars:1"])
    with pytest.raises(Exception, match="missing"):
        terraform.scan(files, {}, {"infra": ["infra/none.tfvars"]}).collect()


def test_registry(spark):
    got = ws.registry_services(spark.createDataFrame([("r.yaml", REGISTRY)], "rel string, text string")).collect()
    assert [(r["name"], r["url"]) for r in got] == [("alpha", "http://alpha:1")]


def test_map(spark, tmp_path):
    for rel, text in {"app/c.py": CLIENT, "web/src/a.js": SCRIPT, "web/m.ts": MODELS, "app/s.py": STORE, "infra/main.tf": TF, "infra/reg.yaml": REGISTRY, "web/node_modules/x.js": SCRIPT}.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    config = ws.read_config(textwrap.dedent(f"""
        [map]
        workspace = "{tmp_path}"
        [repos]
        app = "app"
        web = "web"
        infra = "infra"
        [services]
        backend_base_url = "backend"
        [registry]
        service_config = ["infra/reg.yaml"]
        [emit.pages]
        app = "App"
    """))
    heads = spark.createDataFrame([("app", "abc1234", None)], "repo string, head string, error string")
    m = workspace_map.build(spark, config, "2024-01-01T00:00:00Z", heads=heads)
    patches = m.patches.collect()
    app = [p for p in patches if p["page"] == "App"]
    assert {p["type"] for p in app} == {"http-call", "dynamic", "data-store", "shares-datastore"} and all(p["extracted_from"]["sha"] == "abc1234" for p in app)
    assert any(p["page"] == "Gateway" and p["target"] == "[[svc:alpha]]" for p in patches)
    assert all(p["home_unmapped"] for p in patches if p["page"] == "web")
    assert not any("node_modules" in (r["src_file"] or "") for r in m.sites.collect())
    assert {r["name"] for r in m.nodes.collect()} >= {"alpha", "api-svc"}
    served = m.patches.select(F.col("page").alias("src"), F.regexp_replace("target", r"\[\[|\]\]", "").alias("dst"), "type", "endpoint", "condition", "provenance", "owner", "store", "collections", "confidence", "grounded")
    got = evaluation.evaluate(served, [{"id": "a", "expect": {"from": "App", "to": "backend", "type": "http-call", "endpoint_resolved": True}}, {"id": "b", "expect_absent": {"to": "nowhere"}}]).collect()
    assert [r["ok"] for r in got] == [True, True]


def test_files_of_extractors_are_not_those_of_a_survey(spark, tmp_path):
    call = 'import httpx\ndef f(client):\n    client.get("https://bitbucket.org/x")\n'
    script = 'fetch("https://bitbucket.org/x");\n'
    kept = {"a/__init__.py": call, "a/_client.py": call, "a/_inner/x.py": call, "a/.hidden/x.py": call, "a/big.py": "#" * 1_100_000 + "\n" + call, "a/__tests__/t.js": script}
    rest = {"a/tests/x.py": call, "a/__pycache__/x.py": call, "a/node_modules/x.js": script, "a/.git/HEAD": "ref", "a/_inner/x.json": "{}", "a/large.json": "1" * 1_100_000, "a/Dockerfile": "FROM x"}
    for rel, text in (kept | rest).items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    config = ws.Config(str(tmp_path), {"a": "a"}, languages=("python", "javascript"))
    heads = spark.createDataFrame([("a", "abc1234", None)], "repo string, head string, error string")
    assert {r["src_file"] for r in workspace_map.build(spark, config, "2024-01-01T00:00:00Z", heads=heads).sites.collect()} == set(kept)
    files = {r["rel"]: r["surveyed"] for r in ws.source_files(spark, config.workspace, config.repos).select("rel", "surveyed").collect()}
    assert {f for f, surveyed in files.items() if surveyed} == {"a/__init__.py", "a/_client.py", "a/tests/x.py", "a/Dockerfile"}
    assert not {"a/.git/HEAD", "a/_inner/x.json", "a/large.json"} & set(files)


def test_gate_and_classes(spark):
    e = spark.createDataFrame([("a", "http-call"), ("b", "dynamic"), ("c", "http-call")], "id string, kind string")
    facts = spark.createDataFrame([("a", False), ("b", True)], "id string, resolves boolean")
    assert {(r["id"], r["grounded"]) for r in edges.grounding_gate(e, facts).collect()} == {("b", True), ("c", False)}
    with pytest.raises(ValueError):
        edges.of_class(e, "other")
    with pytest.raises(ValueError):
        edges.check_grounding({"ok": True, "edges_grounded": 0}, required=True)
    assert edges.check_grounding(None, True, allow_ungrounded=True) == "bypassed"


def test_survey(spark):
    files = spark.createDataFrame([("a", "Dockerfile", ""), ("a", "src/x.py", "from fastapi import FastAPI; MongoClient()"), ("b", "package.json", "{}"), ("c", "src/x.py", "flask")], "repo string, rel string, text string")
    pages = inventory.page_inventory(inventory.survey(files), budget=30_000).orderBy("id").collect()
    assert [(p["id"], p["deferred"]) for p in pages] == [("a/api", False), ("a/data-store", True), ("a/service", False), ("b/component", True)]


def test_bridge_without_path(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert graph.bridge(e, "a", "d").count() == 0 and graph.bridge(e, "a", "a").count() == 0
    pages = spark.createDataFrame([("Alpha",), ("Alphabet",), ("Beta",)], "title string")
    assert graph.lookup(pages, "alpha") == "Alpha" and graph.lookup(pages, "phab") == "Alphabet"
    with pytest.raises(LookupError):
        graph.lookup(pages, "a")
