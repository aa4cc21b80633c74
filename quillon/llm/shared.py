"""Small helpers that several corpus operators need: tables, text columns and tables in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


class Scratch:
    """Tables in the folder that all executors share, for cutting lineage.

    A job that loses an executor reads them again; nothing depends on an executor's own disk. The folder is the one
    that the session names in spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary
    folder takes its place. Call drop() for a table that no later result reads.
    """

    _open = threading.local()

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        for made in getattr(self._open, "lists", []):
            made.append(self)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='spark-quillon-')}"
        self.path = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @classmethod
    @contextmanager
    def of_a_stage(cls) -> Iterator[None]:
        """What this thread writes within goes at the end; what the stage returns has to be stored by then."""
        made: list[Scratch] = []
        cls._open.lists = [*getattr(cls._open, "lists", []), made]
        try:
            yield
        finally:
            cls._open.lists = cls._open.lists[:-1]
            for scratch in made:
                scratch.drop("")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows up to which ids are sent to all tasks (16 bytes each or less); more are joined by a shuffle.
SENT_IDS = 500_000


def sent_if_small(ids: DataFrame) -> DataFrame:
    """ids (a stored table of one or a few numbers a row), marked for broadcast after its rows were counted."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def text_mark(text: str = "text") -> Column:
    """64 bits of a text, which tell rows apart that repeat a doc_id."""
    return F.xxhash64(text)


def without_rows(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without those whose doc_id (null is a value) and text_mark() are among rows (columns doc_id and mark)."""
    gone = scratch.keep(rows.select("doc_id", "mark").distinct(), "dropped").select(F.struct("doc_id", "mark").alias("gone"))
    held = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone.doc_id")) & (text_mark("row.text") == F.col("gone.mark"))
    return held.join(sent_if_small(gone), same, "left_anti").select("row.*")


def most_frequent(counts: DataFrame, value: str, most: int, scratch: Scratch) -> pa.Table:
    """The rows of counts (value and n) with the highest n, at most so many, on the driver.

    Where they end is found in a histogram of n by its first three digits, so no task or driver sees more rows. Rows that
    tie with the first one beyond the bound are left out with it.
    """
    counts = scratch.keep(counts.select(value, "n"), "counts")
    unit = F.greatest(F.lit(1.0), F.pow(F.lit(10.0), F.length(F.col("n").cast("string")) - 3)).cast("long")
    level = F.col("n") - F.col("n") % unit
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > most:
            break
        least = r["level"]
    found = counts.where(F.col("n") >= least if least is not None else F.lit(False)).toArrow()
    scratch.drop("counts")
    return found


_SHIPPED: set[str] = set()
#: Bytes of rows that go to a Python worker at once, unless the session says otherwise: texts are long, and the default of
#: 64 MB is held several times by a task and its worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def ship(spark: SparkSession) -> SparkSession:
    """Make a session ready for Python workers: a bound on their batches, and this package on its executors, once for each
    application."""
    context = spark.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(BATCH[0]):
        spark.conf.set(BATCH[0], BATCH[1])
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-quillon-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as packed:
            for source in sorted(root.rglob("*.py")):
                packed.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark
