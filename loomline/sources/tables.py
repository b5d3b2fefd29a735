"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Settings by which the allocators of a Python worker return what it frees.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package by the path the driver has it at, and give freed memory back, as they are used again."""
    env = spark.sparkContext.environment
    for name, value in LEAN.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only on a local master, where all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/checkpoints/loomline"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what is at path when the driver ends."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it survives lost executors and cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later result reads."""
    for table in tables:
        if path := getattr(table, "_loomline_path", None):
            fs, p = _hadoop(table.sparkSession, path)
            fs.delete(p, True)


def ranked(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its place from 0 in the order, as name.

    Rows are dealt into ranges and ranked there; the ranges before add their counts. No task
    sees more than a range, and the counts are one row a range.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_here", here).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_here")).cast("long")).drop("_range", "_here", "_before")


def sum_before(df: DataFrame, key: str, value: str, name: str, block: int = 4096, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over all smaller keys (numbers from 0, one row each, apart for each value of by), as name.

    Sums are taken within blocks of keys and over the blocks' sums, so no task sees more than a
    block, or one row a block.
    """
    rows = df.withColumn("_block", F.floor(F.col(key) / block).cast("long"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_block").alias("_at"), before((Window.partitionBy(*by) if by else Window).orderBy("_block"), "_sum").alias("_blocks"))
    inner = rows.withColumn("_inner", before(Window.partitionBy(*by, "_block").orderBy(key), value))
    same = F.col("_block") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return inner.join(sums, same).withColumn(name, F.col("_blocks") + F.col("_inner")).drop("_block", "_blocks", "_inner", "_at", *[f"_of_{c}" for c in by])
