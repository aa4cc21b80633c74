"""HTTP as a data source of Spark: numbered pages read in batches and streams, and rows that are posted with an outcome each.

    spark.dataSource.register(HttpPages)
    spark.read.format("quillon_pages").option("url", "https://host/items?page={page}").option("last", 5000).load()

Options: url (with {page}), first (1), last, per_partition (100 pages to a task), timeout (30 seconds), and for streams latest: a url that
answers with the number of the last page there is. Rows are page, status and body; a request that fails has status 0.
"""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillon.sources.places import sent_with_tasks

sent_with_tasks(__name__)


def ask(url: str, timeout: float, data: bytes | None = None, headers: dict[str, str] | None = None) -> tuple[int, str]:
    """Status and body of an answer; 0 and what went wrong where there is none."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers or {}), timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""
    except (OSError, ValueError) as error:
        return 0, str(error)


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class _Asker:
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))
        self.first, self.each, self.latest = int(options.get("first", 1)), int(options.get("per_partition", 100)), options.get("latest")
        self.last = int(options.get("last", self.first - 1))

    def parts(self, first: int, last: int) -> list[Pages]:
        return [Pages(k, min(last, k + self.each - 1)) for k in range(first, last + 1, self.each)] or [Pages(first, first - 1)]

    def read(self, partition: Pages) -> Iterator[tuple[int, int, str]]:
        for page in range(partition.first, partition.last + 1):
            yield (page, *ask(self.url.replace("{page}", str(page)), self.timeout))


class PagesReader(_Asker, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return self.parts(self.first, self.last)


class PagesStream(_Asker, DataSourceStreamReader):
    """Offsets are the next page to ask for; a trigger takes the pages up to the last one that `latest` tells."""

    def initialOffset(self) -> dict[str, int]:
        return {"next": self.first}

    def latestOffset(self) -> dict[str, int]:
        status, body = ask(self.latest, self.timeout)
        if status != 200:
            raise OSError(f"{self.latest} answered {status}")
        return {"next": max(self.first, int(body) + 1)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Pages]:
        return self.parts(start["next"], end["next"] - 1)

    def commit(self, end: dict[str, int]) -> None:
        pass


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_pages"

    def schema(self) -> str:
        return "page long, status int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagesStream(dict(self.options))


def posted(rows: DataFrame, url: str, key: str, batch: int = 0, timeout: float = 30.0) -> DataFrame:
    """key, outcome ('success' or 'error'), status and message of each row that is sent as a form post; the tasks send.

    Each request names its batch and key (Idempotency-Key), so a server can tell a request of a task that was run again.
    """
    names = rows.columns

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame[names].astype(object).where(frame[names].notna(), "").itertuples(index=False):
                sent = dict(zip(names, row, strict=True))
                status, message = ask(url, timeout, urllib.parse.urlencode(sent).encode(), {"Idempotency-Key": f"{batch}-{sent[key]}"})
                out.append((str(sent[key]), "success" if status == 200 else "error", status, message))
            yield pd.DataFrame(out, columns=["key", "outcome", "status", "message"])

    return rows.mapInPandas(send, "key string, outcome string, status int, message string")


class PostedBatches:
    """For writeStream.foreachBatch: rows are posted, and what became of each is kept in a folder under its batch and key.

    A batch that is run again sends only what has no success on record; errors are sent anew. complete(batch, outcomes) is called when
    a batch has been recorded, with a DataFrame of its outcomes.
    """

    def __init__(self, url: str, key: str, folder: str, complete=None) -> None:
        self.url, self.key, self.folder, self.complete = url, key, folder, complete

    def outcomes(self, spark) -> DataFrame:
        """batch, attempt, key, outcome, status and message of every request on record."""
        return spark.read.schema("key string, outcome string, status int, message string, batch long, attempt int").parquet(self.folder)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, "attempt=*/_SUCCESS"))
        attempt = len(found) if found is not None else 0
        left = rows
        if attempt:
            done = self.outcomes(spark).where((F.col("batch") == batch) & (F.col("outcome") == "success")).select(F.col("key").alias("__done"))
            left = rows.join(done, F.col(self.key).cast("string") == F.col("__done"), "left_anti")
        posted(left, self.url, self.key, batch).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}/attempt={attempt}")
        if self.complete is not None:
            self.complete(batch, self.outcomes(spark).where(F.col("batch") == batch))
