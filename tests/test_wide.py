"""Wide frames over many partitions, with and without adaptive execution: no row is lost, none gets another's value."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators import edges, ordering


@pytest.fixture(params=["true", "false"])
def adaptive(request, spark):
    partitions = "200" if request.param == "true" else "64"
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_are_gapless(spark, adaptive):
    n = 1_000_000
    rows = spark.range(n, numPartitions=50).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide")).repartition(200, "wide")
    got = ordering.numbered(rows, ["k", "id"], "n")
    found = got.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min("n").alias("low"), F.max("n").alias("high"), F.countDistinct("n").alias("numbers")).first()
    assert tuple(found) == (n, n, 1, n, n)
    wrong = got.groupBy(F.floor(F.col("n") / 1000).alias("b")).agg(F.min("k").alias("a"), F.max("k").alias("z")).orderBy("b")
    last = -1
    for r in wrong.collect():
        assert r["a"] >= last and r["z"] >= r["a"]
        last = r["z"]


def test_budget_defers_without_dropping(spark, adaptive):
    rows = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("wide")).repartition(64, "wide")
    got = ordering.within_budget(rows, ["id"], 1_000, 10)
    assert got.count() == 50_000 and got.where("not deferred").count() == 100 and got.where("deferred and id < 100").count() == 0


def test_running_budget_of_one_hot_group(spark, adaptive):
    rows = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"), (F.col("id") % 13).alias("cost")).repartition(97)
    got = ordering.running_budget(rows, ["g"], ["id"], "cost", 5_000)
    want = rows.withColumn("want", F.sum("cost").over(W.partitionBy("g").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    both = got.join(want.select(F.col("id").alias("i"), "want"), F.col("id") == F.col("i"))
    assert got.count() == 100_000
    assert both.where("running = want and deferred = (want > 5000)").count() == 100_000


def test_every_hint_is_right(spark, adaptive):
    sites = spark.range(400_000).select("id", F.when(F.col("id") % 2 == 0, "self.PAY_URL").otherwise("cfg.search_url").alias("base_expr"), F.pmod(F.xxhash64("id"), F.lit(999)).alias("k")).repartition(200, "k")
    hints = spark.createDataFrame([("url", "any", 0), ("pay_url", "pay", 1), ("SEARCH_URL", "search", 2), ("search_url", "other", 3)], "suffix string, service string, seq int")
    got = edges.resolve_hints(sites, hints)
    assert got.count() == 400_000
    assert got.where("service = case when id % 2 = 0 then 'pay' else 'search' end").count() == 400_000
