"""Mixing sources to target weights (operator 5): hash-threshold histograms.

Each source gets a target number of words. A document has one hash, the same in every run; the documents of a source
whose hash is below the source's threshold are taken once more than the others. A larger budget gives a larger threshold,
so the documents of a small mix are nested in those of a large one.

The threshold comes from histograms, never from sorted documents: words are summed by source and the leading bits of
the hash, sums run over the buckets of a source until the budget is met, and only the bucket at the boundary is counted
again by its next bits. After LEVELS rounds a bucket holds about one document among 2^36 hashes for each source; it
goes in if that comes nearer to the target.

The hash is taken of doc_id, text and a number among the rows of a source that have both in common. Only such rows are
numbered: map tasks fold (doc_id, source, digest of the text) before the shuffle that finds them, and a group's rows are
numbered by the partitions that they stand in, with an offset for each partition, so a group with a third of all rows is
not in one task. Which of its rows gets which number does not matter, as they have the same words.

Scale: one pass over the texts leaves (source, size, hash) in the shared folder; the histograms read that. Map tasks
add up buckets before the shuffle, so a source that holds a third of all rows sends 2^BITS rows for each task. The
window over sources sees one row for each source, and the windows over buckets 2^BITS rows for each source.

Defined results. A null text has no words. Null is a source of its own, last in the order; sources tie in nothing, as each
has one name. A null doc_id is like any other. Rows that repeat are taken or left one by one. Sources without words get
the target 0. An empty table gives an empty result. Texts may be of any length; columns other than doc_id, text and source
are ignored, or carried along by apply_mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import WORD, Scratch, sent_if_small, table, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
LIMIT = 2.0
#: Bits of the hash, of each level's buckets, and levels.
HASH_BITS, BITS, LEVELS = 60, 12, 3


def document_hash(number: Column) -> Column:
    """Of doc_id, digest (of the text) and the row's number among those that have both."""
    of = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", number.cast("string"))
    return F.conv(F.substring(F.md5(of), 1, HASH_BITS // 4), 16, 10).cast("long")


def hashed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row (all of docs), doc_id, source and hash of every document."""
    keys = ["doc_id", "source", "digest"]
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", "row.doc_id", "row.source", F.md5(text_or_empty("row.text")).alias("digest"))
    folded = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    repeats = scratch.keep(folded.select(F.struct(*keys).alias("of")), "repeats")
    if repeats.isEmpty():
        return rows.select("row", "doc_id", "source", document_hash(F.lit(1)).alias("hash"))
    same = F.col("digest") == F.col("of.digest")
    for k in ("doc_id", "source"):
        same = same & F.col(k).eqNullSafe(F.col(f"of.{k}"))
    repeats = sent_if_small(repeats)
    again = scratch.keep(rows.join(repeats, same, "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
    parts = again.groupBy(*keys, "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("part")) - F.col("rows")
    parts = parts.select(F.struct(*keys, "part").alias("of"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.lit(0)))
    numbered = again.withColumn("within", within).join(parts, same & (F.col("part") == F.col("of.part")))
    alone = rows.join(repeats, same, "left_anti")
    return alone.select("row", "doc_id", "source", document_hash(F.lit(1)).alias("hash")).unionByName(
        numbered.select("row", "doc_id", "source", document_hash(F.col("before") + F.col("within")).alias("hash"))
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT
) -> DataFrame:
    """source, source_size and target, of one row for each source with its source_size.

    A target is min(level * weight, limit * size); the level at which the targets add up to the budget is where the
    resharing of all excess ends. Sources are taken in the order in which a rising level reaches their limit.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)).cast("double")
    )
    full = F.col("source_size") * F.lit(float(limit))
    order = everything.orderBy((full / F.col("weight")).asc(), F.col("rank").asc())
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.col("before"), F.lit(0.0))) / F.col("rest")
    filled = (
        ranked.withColumn("before", F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("level", level)
    )
    final = F.min_by("level", F.when(F.col("level") * F.col("weight") <= full, F.col("pos"))).over(everything)
    return filled.withColumn("final", final).select(
        "source", "source_size", F.coalesce(F.least(F.col("final") * F.col("weight"), full), full).alias("target")
    )


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and threshold: documents with a smaller hash are taken once more. budgets: source, rest (< its size)."""
    state = budgets.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        inside = sized.join(state, F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        counts = inside.groupBy("s", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("bucket")
        summed = counts.withColumn("upto", F.sum("words").over(run))
        boundary = (
            summed.where(F.col("upto") > F.col("rest"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "words", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left")), "bucket").alias("b"))
        )
        state = boundary.select("s", F.col("b.left").alias("rest"), F.col("b.bucket").alias("prefix"), F.col("b.words").alias("words"))
    shift = HASH_BITS - BITS * LEVELS
    nearer = F.when(F.col("rest") * 2 >= F.col("words"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return state.select("s", F.shiftleft(nearer, shift).alias("threshold"))


def plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Of hashed() rows doc_id, source, size and hash; and for each source s its source_size, target, passes (how often
    all its documents are taken) and threshold (documents with a smaller hash are taken once more)."""
    words = F.regexp_count(text_or_empty("row.text"), F.lit(WORD)).cast("long")
    sized = scratch.keep(rows.select("doc_id", "source", words.alias("size"), "hash"), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = source_targets(totals, weights, budget).withColumn("passes", passes)
    budgets = scratch.keep(budgets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "budgets")
    thresholds = _thresholds(sized.select("source", "size", "hash"), budgets.select("source", "rest"))
    found = budgets.join(thresholds, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "passes", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")
    )
    return sized, scratch.keep(found, "plan")


def copies() -> Column:
    return F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, scratch: Scratch | None = None, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    sized, sources = plan(hashed(docs.select("doc_id", "source", "text"), scratch), scratch, weights, budget)
    return (
        sized.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", copies())
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def apply_mix(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. No shuffle of texts that do not repeat: the
    plan has one row for each source, and a document's hash says how often it is taken."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = hashed(docs, scratch)
    _, sources = plan(rows, scratch)
    taken = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH numbered AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS number
  FROM documents
), sized AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(text) || ':' || number), 1, 15) AS BIGINT) AS hash
  FROM numbered
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS full_size FROM ranked
), placed AS (
  SELECT *, row_number() OVER o AS pos,
         coalesce(sum(full_size) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM weighted WINDOW o AS (ORDER BY full_size / weight, rank)
), levels AS (
  SELECT *, (budget - before) / rest_weight AS level FROM placed
), final AS (
  SELECT arg_min(level, pos) AS level FROM levels WHERE level * weight <= full_size
), targets AS (
  SELECT source, source_size, coalesce(least(final.level * weight, full_size), full_size) AS target FROM levels, final
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets
), cells AS (
  SELECT source, hash >> 24 AS cell, sum(size) AS words FROM sized GROUP BY ALL
), runs AS (
  SELECT c.source, cell, words, target - passes * source_size AS rest, sum(words) OVER (PARTITION BY c.source ORDER BY cell) AS upto
  FROM cells c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
), cuts AS (
  SELECT source, arg_min(CASE WHEN 2 * (rest - (upto - words)) >= words THEN cell + 1 ELSE cell END, cell) << 24 AS threshold
  FROM runs WHERE upto > rest GROUP BY source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN hash < coalesce(threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN cuts t ON s.source IS NOT DISTINCT FROM t.source
"""
