"""Rebuild on change: each batch of a stream of source files rebuilds the targets that it touches, and no others.

The folder of a build holds the sources as they came (one partition for each batch), one table for each rule with one partition for each
target, and a line for each batch that is done. Everything a batch writes is written over on a retry, so a repeated batch changes
nothing. Batches are joins and aggregates of Spark; no file or target goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.lookup import latest


@dataclass(frozen=True)
class Build:
    """A rule: which target a source belongs to (null: none), and how the sources of targets are put together."""

    name: str
    target: Column
    put_together: Callable[[DataFrame], DataFrame]


def bundled(between: str = "\n") -> Callable[[DataFrame], DataFrame]:
    """The contents of a target's sources by path, one behind the other."""

    def put_together(sources: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("path", "content")))
        return sources.groupBy("target").agg(F.array_join(F.transform(parts, lambda p: p["content"]), between).alias("content"))

    return put_together


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def rebuild(batch: DataFrame, number: int, folder: str, builds: list[Build]) -> None:
    """Take in a batch of sources (path, content; a null content removes its path) and rebuild what they touch.

    A path that moves to another target touches both. A batch that is done already is left alone.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{folder}/done/batch={number}/_SUCCESS"):
        return
    batch.select("path", "content").distinct().write.mode("overwrite").parquet(f"{folder}/sources/batch={number}")
    every = spark.read.schema("path string, content string, batch long").parquet(f"{folder}/sources").where(F.col("batch") <= number)
    now = latest(every, "path", "batch", "content")
    before = latest(every.where(F.col("batch") < number), "path", "batch", "content")
    changed = every.where(F.col("batch") == number).select("path").distinct()
    for build in builds:
        targets = lambda sources: sources.where("content IS NOT NULL").withColumn("target", build.target).where("target IS NOT NULL")  # noqa: B023, E731
        touched = targets(now).join(changed, "path", "left_semi").select("target").unionByName(targets(before).join(changed, "path", "left_semi").select("target")).distinct()
        sources = targets(now).join(touched, "target", "left_semi")
        made = touched.join(build.put_together(sources), "target", "left").select(F.lit(number).cast("long").alias("batch"), "content", F.col("target").cast("string").alias("target"))
        made.repartition("target").write.mode("overwrite").partitionBy("target").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{build.name}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")


def rebuild_on_change(files: DataFrame, folder: str, builds: list[Build]) -> None:
    """Run a stream of sources through rebuild() until it has nothing left; the next call takes up what has come since."""
    writer = files.writeStream.foreachBatch(lambda batch, number: rebuild(batch, number, folder, builds))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def built(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """target, content and batch (the one that built it last) of a rule's targets that have sources."""
    rows = spark.read.schema("batch long, content string, target string").parquet(f"{folder}/{name}")
    return rows.where("content IS NOT NULL").select("target", "content", "batch")
