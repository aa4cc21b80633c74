"""Places that the driver and all executors can reach."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession


def sent_with_tasks(module: str) -> None:
    """Functions and classes of a module travel with the tasks that call them, so executors do not need this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """A new path below the session's spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-quillon-')}"
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: they are made once, and each later use reads the same ones."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def put_texts(texts: DataFrame, folder: str) -> str:
    """Write a file for each row (name, text) below a folder that all executors reach; the tasks write. The folder."""

    def put(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for row in rows:
            path = f"{base}/{row['name']}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(row["text"].encode())

    texts.select("name", "text").foreachPartition(put)
    return folder
