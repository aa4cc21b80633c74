"""Embedding near-dedup (operator 10): an exact metric range join over pivots.

Vectors of length one have cosine c or more exactly if their distance is sqrt(2 - 2c) or less, so near vectors are a range
join in a metric space.

1. Equal vectors are folded into one with its number of rows, by map tasks first: a vector with a third of all rows is
   one row from there on.
2. Pivots are vectors taken by a hash, PIVOTS at most and one for each CELL vectors at most; that bounds what is sent to
   all tasks. How many pay off is measured on SAMPLE other vectors: more pivots leave less to compare where vectors have
   clusters, and only copy them where they have none. Each vector belongs to the cell of its nearest pivot.
3. Boundary replication. A vector x of cell i can only be in range of a vector of cell j if its distance from the plane
   midway between the pivots, (d(x, j)^2 - d(x, i)^2) / (2 d(i, j)), is at most the radius; this is the triangle
   inequality in its form for Euclidean spaces. x is sent to these cells, and only to those with a higher number, so
   each pair meets once.
4. Cells join independently. A cell is split into blocks of at most about BLOCK vectors, so a hot cell is many tasks; a
   task holds one block and streams what is compared with it. Products run in single precision with a margin, and what
   comes within the margin is decided in double precision. A task sends on one row for each vector that has links: the
   number of rows linked and one vector of its own block; pairs are never rows.
5. Components come from these links.

Every vector is compared, recall is 1. Where vectors have no structure (independent directions in many dimensions), the
bound of step 3 holds for most cells, as it must for any exact method there, and the work then grows with the square of the
number of different vectors.

Defined results. Vectors that are null, zero, or hold nulls or values that are not finite link with nothing. A shorter
vector counts as filled up with zeros. Rows that repeat a vec_id are linked like any equal vectors. A row with a null
vec_id (ids are below 2^62) counts in others' n_links; its own component is that of its equal vectors, null if they have no id.
Ties at the threshold are decided in double precision. An empty table gives an empty result; columns other than vec_id
and embedding, labels among them, are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.memory import release
from quillon.llm.shared import Scratch, ship, table

COSINE = 0.9
PIVOTS, CELL, BLOCK, TILE, SAMPLE = 2048, 64, 4096, 1024, 512
#: How many comparisons cost as much as sending a vector to one more block.
SENT = 500
#: Ids from here on are those of vectors without one.
UNNAMED = 1 << 62
#: What single precision may be off by, generously.
MARGIN = 1e-4


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up to dim."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out, at = np.zeros((len(sizes), dim)), 0
    for k, n in enumerate(sizes):
        out[k, :n] = flat[at : at + n]
        at += n
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: str = "embedding"):
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, fits) & F.exists(column, lambda x: x != 0), F.lit(False))


def in_range(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and which cells the bound does not exclude for it."""
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-24))
    d2 = 2 - 2 * (x @ p.T)
    cell = d2.argmin(axis=1)
    own = d2[np.arange(len(cell)), cell]
    return cell, (d2 - own[:, None]) / (2 * apart[cell]) <= radius + 1e-9


def pivots_that_pay(pivots: np.ndarray, sample: np.ndarray, rows: int, radius: float, block: int) -> int:
    """How many of the pivots make the least work, as measured on a sample."""
    best, least = 1, math.inf
    count = 1
    while count <= len(pivots):
        cells = in_range(sample, pivots[:count], radius)[1].sum(axis=1).mean() if len(sample) else 1.0
        size = rows / count
        work = cells * (size + SENT * math.ceil(size / block))
        if work < least:
            best, least = count, work
        count *= 4
    return best


def place(vectors: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """id, n, embedding, cell (of the nearest pivot) and others (higher cells that the bound does not exclude)."""
    dim = pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        p = shared.value
        for batch in batches:
            cell, beyond = in_range(_unit(_matrix(batch.column(2), dim)), p, radius)
            beyond &= np.arange(len(p))[None, :] > cell[:, None]
            at = np.concatenate([[0], np.cumsum(beyond.sum(axis=1))]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(beyond)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), others], ["id", "n", "embedding", "cell", "others"])

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.select("id", "n", "embedding").mapInArrow(rows, f"id long, n long, embedding {kind}, cell int, others array<int>")


class Block:
    """The vectors of one task, and what is linked with them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, cosine: float) -> None:
        self.ids, self.n, self.x, self.cosine = ids, n, x, cosine
        self.x32 = x.astype(np.float32)
        self.links = np.zeros(len(ids), np.int64)
        self.up = np.arange(len(ids))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def compare(self, n: np.ndarray, x: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows of each of the given vectors, and the position of one that it is linked with (-1: none).

        first: the given vectors are this block's own from that position on; pairs count once and not with themselves.
        """
        near = self.x32 @ x.astype(np.float32).T >= self.cosine - MARGIN
        if first is not None:
            near &= np.arange(len(self.ids))[:, None] < np.arange(first, first + len(x))[None, :]
        total = int(near.sum())
        if not total:
            return np.zeros(len(x), np.int64), np.full(len(x), -1)
        if total * 20 > near.size:
            near &= self.x @ x.T >= self.cosine
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            sure = np.einsum("ij,ij->i", self.x[i], x[j]) >= self.cosine
            i, j = i[sure], j[sure]
        self.links += np.bincount(i, weights=n[j], minlength=len(self.ids)).astype(np.int64)
        counts = np.bincount(j, weights=self.n[i], minlength=len(x)).astype(np.int64)
        one = np.full(len(x), -1)
        one[j[::-1]] = i[::-1]  # the first of each
        roots = np.array([self.root(k) for k in range(len(self.up))])
        pairs = np.unique(np.column_stack([roots[i], roots[one[j]]]), axis=0)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            a, b = self.root(a), self.root(b)
            self.up[max(a, b)] = min(a, b)
        if first is not None:
            for k in np.flatnonzero(one >= 0).tolist():
                a, b = self.root(int(one[k])), self.root(first + k)
                self.up[max(a, b)] = min(a, b)
        return counts, one

    def within(self) -> None:
        for first in range(0, len(self.ids), TILE):
            part = slice(first, first + TILE)
            counts, _ = self.compare(self.n[part], self.x[part], first)
            self.links[part] += counts


def join_cells(jobs: DataFrame, dim: int, cosine: float) -> DataFrame:
    """id, links (rows linked in this task) and other (one of the linked vectors) from rows of cell, block, turn, id, n, embedding.

    turn 0: the vectors of the block; turn 1: those it is compared with.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["id", "links", "other"])

        def ended(block: Block) -> pa.RecordBatch:
            roots = np.array([block.root(k) for k in range(len(block.ids))], np.int64)
            some = block.links > 0
            return out(block.ids[some], block.links[some], block.ids[roots[some]])

        release()
        key, held, block = None, [], None

        def settle() -> Block | None:
            if not held:
                return block
            made = Block(*(np.concatenate([h[k] for h in held]) for k in range(3)), cosine)
            held.clear()
            made.within()
            return made

        for batch in batches:
            of = batch.column(0).to_numpy().astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            turn = batch.column(2).to_numpy()
            ids, n, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _unit(_matrix(batch.column(5), dim))
            cuts = np.flatnonzero(np.diff(of * 2 + turn)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != key:
                    if (block := settle()) is not None:
                        yield ended(block)
                    key, block = of[a], None
                if turn[a] == 0:
                    held.append((ids[a:b], n[a:b], x[a:b]))
                    continue
                block = settle()
                if block is None:
                    continue
                for at in range(a, b, TILE):
                    part = slice(at, min(at + TILE, b))
                    counts, one = block.compare(n[part], x[part])
                    if (some := counts > 0).any():
                        yield out(ids[part][some], counts[some], block.ids[one[some]])
        if (block := settle()) is not None:
            yield ended(block)

    return jobs.mapInArrow(rows, "id long, links long, other long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; pivots: so many instead of those that pay off."""
    spark = ship(embeddings.sparkSession)
    scratch = scratch or Scratch(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own = F.struct(F.xxhash64("embedding").alias("hash"), "embedding")
    classes = rows.where(usable()).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    # classes without an id get one of their own above all others; it never shows
    named = F.coalesce("first", F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("embedding"), 2))
    classes = scratch.keep(classes.select(named.alias("id"), "first", "n", "embedding"), "classes")
    size = classes.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dim")).first()
    found = None
    if size["rows"]:
        dim, radius, most = int(size["dim"]), math.sqrt(max(0.0, 2 - 2 * cosine)), pivots or max(1, min(PIVOTS, size["rows"] // CELL))
        # about so many vectors, by a hash: no partition sends more than its share
        share = int(1_000_000_000 * min(1.0, 1.25 * (most + SAMPLE) / size["rows"]))
        draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000_000))
        picked = sorted(classes.where(draw < share).select(draw.alias("draw"), "id", "embedding").collect())
        picked = picked or classes.select(F.lit(0), "id", "embedding").limit(1).collect()
        drawn = _unit(np.array([np.pad(np.array(r[2], float), (0, dim - len(r[2]))) for r in picked]))
        chosen = drawn[: pivots or pivots_that_pay(drawn[:most], drawn[most:], size["rows"], radius, block)]
        placed = scratch.keep(place(classes, chosen, radius), "placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("size")).collect()  # one row for each pivot
        blocks = F.lit(1).cast("long")
        if split := {r["cell"]: math.ceil(r["size"] / block) for r in sizes if r["size"] > block}:
            blocks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in split.items() for v in kv]), F.col("to")), F.lit(1)).cast("long")
        to = F.explode(F.concat(F.array("cell"), "others")).alias("to")
        sent = placed.select("id", "n", "embedding", "cell", to).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        # a vector's own block and those before it in its own cell, all blocks of other cells
        last = F.when(F.col("to") == F.col("cell"), F.col("block")).otherwise(F.col("blocks") - 1)
        sent = sent.select("id", "n", "embedding", "cell", "to", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        turn = F.when((F.col("to") == F.col("cell")) & (F.col("block") == F.col("own")), 0).otherwise(1)
        jobs = sent.select(F.col("to").cast("long").alias("cell"), "block", turn.alias("turn"), "id", "n", "embedding")
        jobs = jobs.repartition("cell", "block").sortWithinPartitions("cell", "block", "turn")
        found = scratch.keep(join_cells(jobs, dim, cosine), "found")
    else:
        found = spark.createDataFrame([], "id long, links long, other long")
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch, "linked")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        classes.join(counts, "id", "left")
        .join(labels, "id", "left")
        .select(own.alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    keyed = rows.withColumn("key", F.when(usable(), own))
    component = F.coalesce(F.when(F.col("component") < UNNAMED, F.col("component")), F.col("vec_id"))
    return keyed.join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v
  WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) >= 0.9 * a.len * b.len
), reach AS (
  SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM v LEFT JOIN counts ON vec_id = a LEFT JOIN least USING (vec_id)
"""
