"""What operators share that write a result before they go on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share: spark.checkpoint.dir as the session has it.

    Only where all runs in one process (a local master, as in tests) may it be unset: a folder is then made. On a
    cluster a folder of the driver's machine would lose rows, so that is an error.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="edgeloom-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """df, written to the shared checkpoint folder; its lineage ends there, and its shuffle files are removed.

    files: at most so many are written. Give it where few rows are known to lie in many partitions: on a local file system
    the JVM starts processes for each file, and memory is counted twice while it does.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    shared_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by columns to four tasks a core at least. For rows of few bytes and much work: Spark reads a small file
    as one partition, and joins small partitions to one."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def dealt(df: DataFrame, *columns: str, each: int = 2 << 20) -> DataFrame:
    """df dealt out by columns to as many tasks as keep each at about `each` bytes of what is read, by Spark's estimate."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known, as of rows that came from Python or a checkpoint
        size = each * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, min(1 << 14, -(-size // each))), *columns)


def discard(df: DataFrame) -> None:
    """Deletes what cut(df) wrote. Call it on a frame that nothing will read again."""
    spark = df.sparkSession
    held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        delete(spark, held.get())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
