"""Exact dedup (operator 4): an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form (A-Z lower-cased), and its slot the leading bits of the key. All in
DataFrame operations:

1. Directory. Rows are counted by key, and keys by slot. A bucket of more than `capacity` rows is split in two by the next bit of its keys,
   which doubles the directory where it is deepest, until each fits or has the finest prefix; the directory maps each
   slot of the global depth, that of the deepest bucket, to its bucket. `capacity` is CAPACITY or, on more than 2^28 rows,
   what leaves 2^16 buckets, so the directory has 2^20 slots at most and can be sent to all tasks.
2. Rows alone. A map of 2^26 bits, made from the keys of several rows, goes to all tasks (2^20 rows of 64 bits at most). A
   row whose bit is not set shares its key with none, so it is the only link of its chain and gets its place where it
   is; its text does not travel. Where other keys share a bit, rows go to their owner without need, with the same result.
3. Owners. All other rows go to the owner task of their bucket, which is a range of keys, and their texts are shuffled this once. The
   owner sorts a bucket by key and text. Rows of one key are a chain: its links are the different texts, told apart by
   comparing bytes, and each link knows its rows and the largest doc_id. Owners write their buckets to the shared folder.
4. Hot buckets. Prefixes beyond the capacity at the finest depth (four bits more than buckets need on average) hold a
   group of copies that no split divides. Their rows are not sent to one owner: map tasks fold equal texts first, so
   a group with a third of all rows is one link for each task, and rows then find their link in the chain of their key by
   comparing bytes. Links are sent to all tasks if they are small, as measured; else Spark splits the rows' side.

Defined results. A null text counts as empty. A null doc_id loses against any other; where a group has null ids only,
keep_id is null and its rows are kept. Rows that repeat a doc_id and a text get the same verdict; a doc_id with two texts is
two documents. An empty table gives an empty result. Texts may be of any length; columns other than doc_id and text are
ignored, or carried along unchanged by drop_exact_copies, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import Scratch, ascii_lower, table

#: Rows that a bucket holds before it is split, and the most buckets that are aimed at.
CAPACITY, BUCKETS = 4096, 1 << 16
#: Bits that a prefix may have beyond those that buckets need on average.
BEYOND = 4
#: Leading bits of a key that name a cell of the map of keys in several rows; a cell has 64 bits.
CELLS = 20
#: Bytes of texts up to which the links of hot buckets are sent to all tasks.
SENT_BYTES = 8 << 20


def _slot(key: Column, depth: int) -> Column:
    """The leading bits of a 64-bit hash."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, n_rows: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth, hot) for every slot, and the depth of slots before the directory is cut to its global depth.

    keys has a column key, and n where a row stands for n of them. Counts at the finest depth are summed to all coarser ones at once; a bucket is the shallowest
    prefix that fits. Hot ones do not fit at the finest depth.
    """
    finest = 0 if n_rows <= capacity else math.ceil(math.log2(n_rows / capacity)) + BEYOND
    counts = keys.groupBy(_slot(F.col("key"), finest).alias("fine")).agg((F.sum("n") if "n" in keys.columns else F.count("*")).alias("n"))
    sized = (
        counts.select("n", "fine", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(fine, {finest} - depth)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    fits = F.col("n") <= capacity
    parents = sized.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = sized.where(fits | (F.col("depth") == finest)).withColumn("parent", F.when(F.col("depth") > 0, F.shiftright("prefix", 1)))
    leaves = split.join(parents, ["depth", "parent"], "left_semi").unionByName(split.where(F.col("depth") == 0))
    width = F.expr(f"shiftleft(1L, {finest} - depth)")
    slots = leaves.select(
        F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("slot"),
        F.expr(f"shiftleft(prefix, {finest} - depth)").alias("bucket"),
        F.col("depth").alias("local_depth"),
        (~fits).alias("hot"),
    )
    return slots, finest


def global_depth(slots: DataFrame, finest: int) -> tuple[DataFrame, int]:
    """The directory cut to the depth of its deepest bucket; that depth."""
    depth = slots.agg(F.max("local_depth")).first()[0] or 0
    return slots.where(F.col("slot") % (1 << finest - depth) == 0).withColumn("slot", F.shiftright("slot", finest - depth)), depth


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - CELLS)


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(63).cast("int"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """cell and bits of the keys (key, n) that several rows have: one row for each cell with any."""
    key = F.col("key")
    return keys.where("n > 1").groupBy(_cell(key).alias("cell")).agg(F.bit_or(_bit(key)).alias("bits"))


def normalised(row: str = "row") -> Column:
    return ascii_lower(F.coalesce(F.col(f"{row}.text"), F.lit("")))


def exact_links(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """For each row of docs its place in the index: row, bucket, key, chain (the link's place at its key), keep_id, group_size
    and text_sha256."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = rows.select("row", F.xxhash64(normalised()).alias("key"))
    keys = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")), "keys")
    n_rows = keys.agg(F.sum("n")).first()[0] or 0
    slots, finest = directory(keys, n_rows, max(capacity, n_rows // BUCKETS))
    slots, depth = global_depth(scratch.keep(slots, "counted"), finest)
    slots = scratch.keep(slots, "directory")
    shared = scratch.keep(shared_keys(keys), "shared")
    several = F.coalesce(F.col("bits").bitwiseAND(_bit(F.col("key"))) != 0, F.lit(False))
    placed = keyed.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(slots), "slot")
    placed = placed.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(shared), "cell", "left").select("row", "key", "bucket", "hot", several.alias("several"))
    alone = placed.where(~F.col("several")).select(
        "row",
        "bucket",
        "key",
        F.lit(1).alias("chain"),
        F.col("row.doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
    )
    placed = placed.where("several").drop("several")

    link = Window.partitionBy("bucket", "key", "norm")
    chain = Window.partitionBy("bucket", "key").orderBy("norm")
    owned = placed.where(~F.col("hot")).repartition("bucket").withColumn("norm", normalised())
    owned = owned.select(
        "row",
        "bucket",
        "key",
        F.dense_rank().over(chain).alias("chain"),
        F.max("row.doc_id").over(link).alias("keep_id"),
        F.count("*").over(link).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    if slots.where("hot").isEmpty():
        return alone.unionByName(owned)
    hot = placed.where("hot").withColumn("norm", normalised())
    links = hot.groupBy("bucket", "key", "norm").agg(F.max("row.doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = scratch.keep(links.withColumn("chain", F.dense_rank().over(chain)).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)), "links")
    size = links.agg(F.sum(F.octet_length("norm") + 100)).first()[0]
    found = hot.join(F.broadcast(links) if size <= SENT_BYTES else links, ["bucket", "key", "norm"])
    return alone.unionByName(owned).unionByName(found.select(*owned.columns))


def exact_groups(docs: DataFrame, scratch: Scratch | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    links = exact_links(docs.select("doc_id", "text"), scratch, capacity)
    index = scratch.keep(links.select(F.col("row.doc_id").alias("doc_id"), "bucket", "key", "chain", "keep_id", "group_size", "text_sha256"), "index")
    return index.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, scratch: Scratch | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, those with the largest doc_id."""
    links = exact_links(docs, scratch or Scratch(docs.sparkSession), capacity)
    return links.where(F.col("row.doc_id").eqNullSafe(F.col("keep_id"))).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
