"""Little input that is much work is dealt to many tasks."""

from pyspark.sql import functions as F

from edgeloom.extract import python_source, terraform
from edgeloom.functions import text as T
from edgeloom.operators import coupling, generated, graph, shared


def test_texts_of_one_partition_are_dealt_out(spark):
    files = spark.range(400, numPartitions=1).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo"), F.concat(F.lit("r"), F.col("id").cast("string"), F.lit("/m.tf")).alias("rel"), F.lit('resource "google_pubsub_topic" "t" { name = "x" }').alias("text"),
    )
    found = terraform.nodes(terraform.scan(files, {}))
    assert found.select("repo", "name", "seq").distinct().count() == found.count() == 400
    assert found.select(F.spark_partition_id()).distinct().count() >= 4
    code = files.withColumn("rel", F.replace("rel", F.lit(".tf"), F.lit(".py"))).withColumn("text", F.lit("import httpx\nhttpx.get('https://a.example.com/x')\n"))
    sites = python_source.scan_calls(code, {})
    assert sites.count() == 400 and sites.select(F.spark_partition_id()).distinct().count() >= 4


def test_a_repository_is_read_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("r", f"r/f{i:02}.tf", f'locals {{ v{i} = "n{i}" }}\nresource "google_pubsub_topic" "t{i}" {{ name = local.v{(i + 1) % 20} }}') for i in range(20)]
        found = terraform.nodes(terraform.scan(spark.createDataFrame(rows, "repo string, rel string, text string"), {})).orderBy("seq").collect()
        assert [r["name"] for r in found] == [f"n{(i + 1) % 20}" for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stubs_read_edges_once(spark):
    links = spark.createDataFrame([("a", "[[X – y]]", "t", "e", "p"), ("a", "[[X – y]]", "t", "e", "p"), ("b", "X – y", None, "", "q"), ("b", "[[Known]]", "t", "e", "p"), ("c", None, "t", "e", "p"), ("c", "[[]]", "t", "e", "p"), ("c", "(unset:var.x)", "t", "e", "p")], "page string, dst string, type string, endpoint string, provenance string")
    names = spark.createDataFrame([("known",)], "key string")
    e = graph.broken(links, names).select(T.strip_wikilink("dst").alias("target"), F.col("page").alias("source"), "type", "endpoint", "provenance")
    want = generated.stub_pages(graph.dead_ends(links, names), e, "2024-01-01").collect()
    once = generated.stub_pages(graph.dead_ends(links, names, rows=generated.edge_row()), None, "2024-01-01")
    assert once.collect() == want and [r["n_edges"] for r in want] == [2]
    plan = once.select("path", "target", "n_edges")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_set" not in plan


def test_tasks_grow_with_the_input(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=1).select(
        F.col("id").alias("seq"), F.concat(F.lit("r"), F.col("id") % 90).alias("repo"), F.lit("s").alias("store"), F.sha2((F.col("id") % 30_000).cast("string"), 256).alias("collection"), F.when(F.col("id") % 7 == 0, "write").otherwise("read").alias("mode"), F.lit("p").alias("provenance"), F.lit(None).cast("string").alias("model"),
    )
    rows.write.parquet(f"{tmp_path}/a")
    read = spark.read.parquet(f"{tmp_path}/a")
    few, many = (shared.dealt(read, "repo", each=each).rdd.getNumPartitions() for each in (1 << 30, 1 << 16))
    assert few == spark.sparkContext.defaultParallelism and many > 2 * few
    modes = coupling.access_modes(read.withColumn("store", F.lit("s")))
    assert modes.count() == rows.select("repo", "collection").distinct().count()
    plan = modes.drop("provenance")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1 and plan.count("HashAggregate") == 2
