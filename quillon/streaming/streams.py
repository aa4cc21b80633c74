"""Streams: files that arrive, the latest answer of each key, and answers that came too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quillon.operators.lookup import latest


def arriving(spark: SparkSession, path: str, like: DataFrame, pattern: str = "*") -> DataFrame:
    """A stream of the Parquet files that come to a path, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that a stream has now, written to a path and read again."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the row that is last in the order; for streams in complete or update mode too."""
    return latest(rows, key, *order)


def changed_only(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Requests whose value differs from the one before of their key, by the order; a first one too. Of A, B, A all stay."""
    before = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__same", F.col(value).eqNullSafe(F.lag(value).over(before)) & (F.row_number().over(before) > 1))
    return marked.where("not __same").drop("__same")


def changed_in_stream(rows: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """changed_only for a stream: key, value (text) and time of the requests that differ from the last one of their key. The
    state is one value for each key; rows of a batch count in the order of their time."""
    kind = dict(rows.dtypes)[key]

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(batches)).sort_values("time", kind="stable")
        last = state.get if state.exists else (None, False)
        keep = []
        for x in found["value"]:
            x = None if pd.isna(x) else x
            keep.append(not last[1] or x != last[0])
            last = (x, True)
        state.update(last)
        yield found.loc[keep, ["key", "value", "time"]]

    named = rows.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.col(time).cast("timestamp").alias("time"))
    changed = named.groupBy("key").applyInPandasWithState(step, f"key {kind}, value string, time timestamp", "value string, known boolean", "append", "NoTimeout")
    return changed.withColumnsRenamed({"key": key, "value": value, "time": time})


def in_time(answers: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Answers that echo the value that is current for their key; late ones go. A key without an answer counts as valid
    for whoever asks meanwhile."""
    now = current.select(F.col(key).alias("__key"), F.col(value).alias("__now"))
    return answers.join(now, (answers[key] == F.col("__key")) & answers[value].eqNullSafe(F.col("__now"))).select(*answers.columns)


def windowed_counts(stream: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Rows of each key in each window of event time; rows later than `late` go. An extra beside the inventory."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
