"""Extractors and parsers over sources written from the driver's tables, so that SQL can say what is found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.extract import javascript_source, python_source, terraform
from edgeloom.functions import text as T
from edgeloom.operators import envdiff, evaluation, graph, ordering
from edgeloom.plans.edge_queries import environment
from edgeloom.plans.registry import query, table
from edgeloom.sources import snapshots, workspace

HINTS = {"backend_base_url": "backend", "BASE_URL": "any"}


def filled(template: str, key: Column) -> Column:
    """The template with @ replaced by a key."""
    return F.replace(F.lit(template), F.lit("@"), key.cast("string"))


def sources(spark: SparkSession, sf: str, rel: str, *templates: str) -> DataFrame:
    """repo, rel, text, k: a file for each supplier, whose text is one of the templates in turn, @ being its key."""
    k = F.col("s_suppkey")
    text = F.lit(None).cast("string")
    for i, t in enumerate(templates):
        text = F.when(k % len(templates) == i, filled(t, k)).otherwise(text)
    repo = F.concat(F.lit("r"), (k % 7).cast("string"))
    return table(spark, sf, "supplier").select(repo.alias("repo"), F.concat(repo, F.lit("/"), filled(rel, k)).alias("rel"), text.alias("text"), k.alias("k"))


_K = "with s as (select s_suppkey k, 'r' || s_suppkey % 7 repo from supplier) "

_PYTHON = '''import httpx
class Client:
    def go(self, session, settings):
        session.get(f"{settings.backend_base_url}/items/@")
        if use_fast:
            session.post(f"{settings.base_url}/posts/@")
        session.delete(where)
'''
_PYTHON_LOCAL = '''def go(http, stream):
    base = "https://x@.run.app/v1"
    http.get(f"{base}/users")
    url = f"{base}/late/{stream}"
    return http.put(url)
'''


@query(_K + """select repo, 'svc/c' || k || '.py' as file, line, kind, service, endpoint, condition, confidence from s, lateral (values
        (0, 4, 'http-call', 'backend', '/items/' || k, null, 'high'), (0, 6, 'http-call', 'any', '/posts/' || k, 'use_fast', 'med'), (0, 7, 'dynamic', '(dynamic)', '(var)', null, 'low'),
        (1, 3, 'http-call', 'cloudrun:x' || k, '/users', null, 'high'), (1, 5, 'dynamic', '(dynamic)', '/late/{stream}', null, 'low')) t(m, line, kind, service, endpoint, condition, confidence) where k % 2 = m""")
def python_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    found = python_source.scan_calls(sources(spark, sf, "svc/c@.py", _PYTHON, _PYTHON_LOCAL), HINTS)
    return found.select(F.col("src_repo").alias("repo"), F.substring_index("src_file", "/", -2).alias("file"), F.col("src_line").cast("int").alias("line"), "kind", F.col("target_service").alias("service"), F.col("target_endpoint").alias("endpoint"), "condition", "confidence")


_SCRIPT = """const BASE = process.env.BACKEND_BASE_URL; // fetch("/gone")
/* axios.get("/gone") */
axios.get(`${BASE}/v1/users/${id}`);
fetch("https://x@.run.app/z");
api.post(
  "/relative/@");
const r = new Redis(opts);
https.get(where);
"""
_SCRIPT_PLAIN = """const HOST = "https://y@.run.app";
const PATH = `${HOST}/repos`;
await this.client.get<Row[]>(PATH);  got.post("/later");
myclient.get("/no"); fetch(name);
"""


@query(_K + """select repo, 'web/a' || k || '.ts' as file, line, kind, service, endpoint, confidence, form from s, lateral (values
        (0, 3, 'http-call', 'backend', '/v1/users/{id}', 'med', 'axios-like'), (0, 4, 'http-call', 'cloudrun:x' || k, 'https://x' || k || '.run.app/z', 'high', 'bare-callable'), (0, 5, 'dynamic', '(dynamic)', '/relative/' || k, 'low', null),
        (0, 7, 'data-store', 'Redis', '(tcp; ioredis)', 'high', null), (1, 3, 'http-call', 'cloudrun:y' || k, '/repos', 'med', 'axios-like')) t(m, line, kind, service, endpoint, confidence, form) where k % 2 = m""")
def javascript_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    found = javascript_source.scan_calls(sources(spark, sf, "web/a@.ts", _SCRIPT, _SCRIPT_PLAIN), HINTS)
    form = F.nullif(F.regexp_extract("resolved_via", r"\[([a-z-]+)\]$", 1), F.lit(""))
    return found.select(F.col("src_repo").alias("repo"), F.substring_index("src_file", "/", -2).alias("file"), F.col("src_line").cast("int").alias("line"), "kind", F.col("target_service").alias("service"), F.col("target_endpoint").alias("endpoint"), "confidence", form.alias("form"))


_STORE = '''class Repo:
    def __init__(self, db):
        self.users = db.users
    def go(self):
        self.users.find_one({})
        self.db["c@"].insert_one({})
        self.other.find({})
'''


@query(_K + "select repo, coll collection, mode, 'store' || k || '.py:' || line as place from s, lateral (values ('users', 'read', 5), ('c' || k, 'write', 6)) t(coll, mode, line)")
def python_collections(spark: SparkSession, sf: str) -> DataFrame:
    return python_source.scan_access(sources(spark, sf, "store@.py", _STORE)).select("repo", "collection", "mode", F.substring_index("provenance", "/", -1).alias("place"))


@query("with s as (select s_suppkey k, 'r' || s_suppkey % 7 repo from supplier) select repo, collection, 'write' as mode, min(model) model from (select repo, 'users' collection, 'User' model from s where k % 2 = 0 union all select repo, 'categories', 'Category' from s where k % 2 = 1) group by 1, 2")
def javascript_models(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf, "m@.ts", "export const U = mongoose.model<IUser>('User', s); mongoose.model('TestThing', t)", "mongoose.model('Category', c); mongoose.model('FDBx', t)")
    return javascript_source.scan_models(files).select("repo", "collection", "mode", "model")


_TF = '''variable "name" { default = "api" }
variable "bucket" {}
locals {
  full  = "${var.name}-@"
  email = var.name == "api" ? "bot@x" : data.google_account.default.email
}
# resource "google_pubsub_topic" "gone" { name = "gone" }
resource "google_cloud_run_v2_service" "svc" {
  name            = "${local.full}-svc"
  service_account = local.email
  template {
    containers {
      env {
        name  = "BACKEND_BASE_URL"
        value = "http://b"
      }
      env {
        name  = "SEARCH_INDEX_URL"
        value = var.bucket
      }
    }
  }
}
resource "google_storage_bucket" "b" { name = var.bucket }
resource "google_pubsub_topic" "t" { name = "topic-@" }
resource "google_pubsub_subscription" "u" {
  name  = "sub-@"
  topic = google_pubsub_topic.t.name
}
resource "google_cloud_run_service_iam_member" "m" {
  service = google_cloud_run_v2_service.svc.name
  role    = "roles/run.invoker"
  member  = "serviceAccount:${google_service_account.bot.email}"
}
resource "google_unknown_thing" "z" { name = "nothing" }
'''


def infrastructure(spark: SparkSession, sf: str) -> DataFrame:
    """Terraform of one repository a supplier, each with a file of variables."""
    own = sources(spark, sf, "main.tf", _TF).withColumn("repo", F.concat(F.lit("i"), F.col("k").cast("string"))).withColumn("rel", F.concat("repo", F.lit("/main.tf")))
    values = own.select("repo", F.concat("repo", F.lit("/prod.tfvars")).alias("rel"), filled('n = 1\nbucket = "real-@" # b\n', F.col("k")).alias("text"), "k")
    return terraform.scan(own.unionByName(values), HINTS)


_I = "with s as (select s_suppkey k, 'i' || s_suppkey repo from supplier) "


@query(_I + """select repo, name, kind, repo || '/main.tf:' || line as provenance, basis, candidates from s, lateral (values
    ('api-' || k || '-svc', 'cloud-run-service', 8, '', null), ('backend', 'service', 8, '', null), ('search-index', 'service', 8, '', null),
    ('(unset:var.bucket)', 'datastore-bucket', 24, '', '{"var.bucket": ["' || repo || '/prod.tfvars:2"]}'), ('topic-' || k, 'pubsub-topic', 25, '', null), ('sub-' || k, 'pubsub-subscription', 26, '', null)) t(name, kind, line, basis, candidates)""")
def terraform_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = terraform.nodes(infrastructure(spark, sf))
    return n.select("repo", "name", "kind", "provenance", F.array_join("name_basis", ",").alias("basis"), F.col("tfvars_candidates").alias("candidates"))


@query(_I + """select repo, src, type, dst, via, value, basis from s, lateral (values
    ('api-' || k || '-svc', 'runs-as', 'bot' || k || 'x', null, null, 'ternary-default-branch'), ('api-' || k || '-svc', 'deploy-env', 'backend', 'BACKEND_BASE_URL', 'http://b', ''), ('api-' || k || '-svc', 'deploy-env', 'search-index', 'SEARCH_INDEX_URL', '(unset:var.bucket)', ''),
    ('sub-' || k, 'subscribes-to', 'topic-' || k, null, null, ''), ('SA:(unset:google_service_account.bot.email)', 'invokes', 'api-' || k || '-svc', null, null, '')) t(src, type, dst, via, value, basis)""")
def terraform_edges(spark: SparkSession, sf: str) -> DataFrame:
    return terraform.edges(infrastructure(spark, sf)).select("repo", "src", "type", "dst", "via", "value", F.array_join("name_basis", ",").alias("basis"))


@query("select 'p' || n_nationkey || '.yaml' as rel, name, url from nation, lateral (values ('alpha', 'http://a:' || n_nationkey), ('gamma', 'http://g')) t(name, url)")
def service_registry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = filled("services:\n  alpha:\n    port: 1\n    url: http://a:@\n    url: http://second\n  beta:\n    other: 1\n  gamma:\n    url: 'http://g'\n", k)
    files = table(spark, sf, "nation").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".yaml")).alias("rel"), text.alias("text"))
    return workspace.registry_services(files).select("rel", "name", "url")


_SNAPSHOT = (
    '{"compute": {"services": [{"metadata": {"name": "api-@"}, "status": {"url": "https://u@"}}], "jobs": [{"name": "job-@-prod"}]}, "messaging": {"topics": [{"name": "projects/p/topics/t@"}], "subscriptions": [{"name": "s@", "topic": "projects/p/topics/t@"}]},'
    ' "datastores": {"buckets": [{"id": "b@"}, {}]}, "identity_invoke": {"invoke_policies": [{"service": "api-@", "policy": {"bindings": [{"role": "roles/run.invoker", "members": ["m1", "m2"]}, {"role": "roles/viewer", "members": ["m3"]}]}}]}}'
)


def snapshot_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(filled(_SNAPSHOT, F.col("s_suppkey")).alias("doc"))


@query("select name, kind, url, store from (select s_suppkey k from supplier), lateral (values ('api-' || k, 'cloud-run-service', 'https://u' || k, null), ('job-' || k, 'cloud-run-job', null, null), ('t' || k, 'pubsub-topic', null, null), ('b' || k, 'datastore-bucket', null, 'gcs')) t(name, kind, url, store)")
def snapshot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_nodes(snapshot_documents(spark, sf)).select("name", "kind", *(F.try_element_at("attrs", F.lit(a)).alias(a) for a in ("url", "store")))


@query("select src, type, dst, condition from (select s_suppkey k from supplier), lateral (values ('s' || k, 'subscribes-to', 't' || k, null), ('m1', 'invokes', 'api-' || k, 'roles/run.invoker'), ('m2', 'invokes', 'api-' || k, 'roles/run.invoker')) t(src, type, dst, condition)")
def snapshot_edges(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_edges(snapshot_documents(spark, sf)).select("src", "type", "dst", "condition")


@query("""select p_partkey k, case p_partkey % 3 when 0 then 'data.x.y' when 1 then 'var.' || p_size else 'local.z' end ref, case p_partkey % 3 when 0 then 'provider-read' when 1 then 'deploy-time-input' else 'not-statically-resolvable' end kind,
    p_partkey % 4 = 0 resolved, p_partkey % 5 = 0 word, case when p_partkey % 2 = 0 then 'use_fast,x_enabled' else '' end flags, case when p_partkey % 3 = 1 then 'var.' || p_size else '' end as unset from part""")
def parsing_functions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, "data.x.y").when(k % 3 == 1, F.concat(F.lit("var."), "p_size")).otherwise("local.z")
    endpoint = F.when(k % 4 == 0, F.concat(F.lit("/v1/"), k.cast("string"))).when(k % 4 == 1, "(var)").when(k % 4 == 2, "/v1/{id}").otherwise("  ")
    sentence = F.when(k % 5 == 0, "if use_fast then").otherwise("if use_faster or reuse_fast then")
    condition = F.when(k % 2 == 0, "x_enabled and use_fast and not use_fast").otherwise("enabled and user")
    name = F.when(k % 3 == 1, F.concat(F.lit("a-(unset:"), ref, F.lit(")-b"))).otherwise("plain")
    return table(spark, sf, "part").select(
        k.alias("k"), ref.alias("ref"), T.ref_kind(ref).alias("kind"), T.endpoint_is_resolved(endpoint).alias("resolved"), T.word_match(sentence, "use_fast").alias("word"), F.array_join(T.flags_in(condition), ",").alias("flags"), F.array_join(T.unset_refs(name), ",").alias("unset"),
    )


@query("select p_partkey k, p_partkey % 3 <> 2 as ok from part")
def provenance_prefix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), F.when(k % 3 == 0, "src/a.py:12").when(k % 3 == 1, "src/a.py").otherwise("src/a.pyx:3").alias("provenance"))
    return p.select("k", evaluation.predicate("provenance_prefix", "src/a.py").alias("ok"))


@query("select wanted, title from (values ('Nation 3', 'Nation 3'), ('nation 4', 'Nation 4'), ('tion 17', 'Nation 17')) t(wanted, title) where title in (select 'Nation ' || n_nationkey from nation)")
def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "nation").select(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("title"))
    return spark.createDataFrame([(w, graph.lookup(pages, w)) for w in ("Nation 3", "nation 4", "tion 17")], "wanted string, title string")


@query("""with p as (select p_partkey k, case when p_partkey % 2 = 0 then p_brand else lower(p_brand) end title from part), l as (select distinct title as dst from p union select distinct upper(title) from p),
    e as (select title, min(k) k from p group by 1), n as (select lower(title) t, min(k) k from p group by 1)
    select l.dst, 'p' || coalesce(e.k, n.k) as page from l left join e on e.title = l.dst left join n on n.t = lower(l.dst)""")
def resolve_exact_first(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pages = table(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("rel"), k.alias("walk_no"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.lower("p_brand")).alias("title"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("stem"))
    links = pages.select(F.col("title").alias("dst")).distinct()
    links = links.union(links.select(F.upper("dst"))).distinct()
    return graph.resolve_titles(links, graph.page_names(pages), exact=graph.exact_names(pages)).select("dst", "page")


@query("""with e as (select l_linestatus st, l_partkey k, sum(l_quantity::bigint)::bigint q, max(l_returnflag) flag, case when count(*) > 1 then 'yes' end many from lineitem where l_quantity >= 45 group by 1, 2), a as (select * from e where st = 'F'), b as (select * from e where st = 'O'),
    c as (select 'env-' || case when a.k is null then 'O' else 'F' end || '/part' || coalesce(a.k, b.k) as name, 'part-x' as kind, case when b.k is null then 'only_in_a' when a.k is null then 'only_in_b' when a.q <> b.q or a.flag <> b.flag or a.many is distinct from b.many then 'differs' else 'identical' end as status from a full join b on a.k = b.k)
    select status, kind, name, row_number() over (order by case status when 'only_in_a' then 0 when 'only_in_b' then 1 else 2 end, kind, name) place from c where status <> 'identical'""")
def envdiff_report(spark: SparkSession, sf: str) -> DataFrame:
    return envdiff.ordered(envdiff.compare_nodes(environment(spark, sf, "F"), environment(spark, sf, "O"))).select("status", "kind", "name", "place")


@query("select s_suppkey k, '  s' || s_suppkey || ' --part_of--> n' || s_nationkey as line, 's' || s_suppkey || ' -> n' || s_nationkey as path, '{\"src\":\"s' || s_suppkey || '\",\"field\":\"part_of\",\"dst\":\"n' || s_nationkey || '\"}' as json from supplier")
def output_forms(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("part_of").alias("field"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return s.select("k", graph.text_line().alias("line"), graph.path_line("src", "dst").alias("path"), graph.json_line().alias("json"))
