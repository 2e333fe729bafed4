"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process may do without; there a folder of its own is shared."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Spark removes a query's shuffle files at its end; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as compressed files in the shared folder, without its lineage. Shuffle files of the way there go at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """df with the running sum of an amount in an order over all rows, this row included. Rows are sorted over all tasks; what stands
    before each task's rows is a sum per task, so no task holds or ranks all rows.
    """
    ordered = df.withColumn("_amount", amount).orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ordered = checkpointed(ordered)
    parts = ordered.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per task
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ordered.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + inside).drop("_amount", "_part", "_row", "_before")


#: Rows of a key with more than this are dealt to blocks of about so many, and each block meets each.
HOT_ROWS = 1_000
#: Pairs that a task makes of rows with the same key, about.
PAIRS = 2_000_000


def met(rows: DataFrame, key: str, deal: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """rows twice, the columns to join the two by, and a number of tasks: as many as pairs of rows with the same key ask for. rows are read several times: they should come from files.

    Without a hot key both sides are one and the same shuffle. Otherwise a column _cell is one of the join's: rows of a hot key are dealt by another column to blocks, and a cell is a
    pair of blocks; so no cell has more than about HOT_ROWS squared pairs.
    """
    rows = rows.filter(F.col(key).isNotNull())
    counts = written(rows.groupBy(key).agg(F.count("*").alias("_n")), "counts")
    pairs, most = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2), F.max("_n")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((pairs or 0) // PAIRS) + 1)
    if (most or 0) <= HOT_ROWS:
        dealt = rows.repartition(tasks, key)
        return dealt, dealt, [key], tasks
    hot = counts.filter(F.col("_n") > HOT_ROWS).select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_blocks"))
    marked = rows.join(hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(deal), F.col("_blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    sides = [marked.withColumn("_cell", F.explode(F.transform(every, cell))).drop("_blocks").repartition(tasks, key, "_cell") for cell in (lambda x: own * F.col("_blocks") + x, lambda x: x * F.col("_blocks") + own)]
    return sides[0], sides[1], [key, "_cell"], tasks
