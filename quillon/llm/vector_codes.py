"""Vector code compression (operator 13): product codes by Yinyang Lloyd, in whole numbers.

A component x counts as floor(4096 x), and a vector is cut into PARTS equal parts, each with a codebook of its own.

1. Start. A codebook begins as that part of the vectors with the ENTRIES smallest ids, and its entries are clustered into
   GROUPS groups once, on the driver.
2. A round is one Arrow map over the vectors, and its only state is one row for each vector: the entry of each part and, for
   each group, a lower bound of the distance to the group's entries other than that one. Bounds sink by the farthest
   move of an entry of their group. Only groups whose bound does not exceed the distance to the own entry are scanned.
   Bounds are floating-point numbers rounded down with a margin; every distance that decides is a whole number,
   so ties go to the lower index exactly.
3. Means. A task adds up the parts of each entry while it assigns them and writes one row of sums, which Spark adds up;
   the driver gets PARTS * ENTRIES sums and counts, whatever the number of vectors. Rounds are tables in the shared folder,
   and an earlier one goes when the next is written.

No row is shuffled in a round, so neither equal vectors nor hot labels meet anywhere; errors by label are an aggregate that map
tasks begin, joined back as one row a label.

Defined results. Vectors that are null or hold nulls or values that are not finite are dropped. A shorter vector counts as filled
up with zeros to the longest one, and the longest to a multiple of PARTS. With fewer vectors than ENTRIES the codebook has
so many entries; an empty table gives an empty result. Null ids come after all others, and rows that repeat an id go in order
of their vectors; each row gets its code. Components of any size are exact: those beyond EXACT in size, whose
squares might not fit, are compared as Python's whole numbers. An error beyond a long is null, and so is the sum of a label that
has one. Null labels are one label. Columns other than vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.embedding_join import _matrix
from quillon.llm.memory import release
from quillon.llm.shared import Scratch, sent_if_small, ship, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Groups of entries that share a lower bound.
GROUPS = 4
#: Components up to this size have squared distances that fit into 64 bits, in parts of up to 2^8 components.
EXACT = 1 << 26
#: What bounds may be off by in single precision, generously; their largest value.
MARGIN, FAR = 1e-6, 3e38
LONG = (1 << 63) - 1


def finite(column: str = "embedding"):
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def exact_up_to(width: int) -> int:
    return min(EXACT, math.isqrt((1 << 60) // width))


def whole(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(4096 x) as (rows, PARTS, width), and which rows have components beyond EXACT; those are Python's numbers."""
    y = np.floor(np.clip(x, -1e300, 1e300) * SCALE)
    large = (np.abs(y) > exact_up_to(width)).any(axis=1)
    if not large.any():
        return y.astype(np.int64).reshape(len(x), PARTS, width), large
    exact = np.where(large[:, None], 0, y).astype(np.int64).astype(object)
    for k in np.flatnonzero(large).tolist():
        exact[k] = [math.floor(v) * SCALE if abs(v) >= 1 << 52 else math.floor(v * SCALE) for v in x[k].tolist()]
    return exact.reshape(len(x), PARTS, width), large


class Codebooks:
    """Entries (whole numbers) of each part, the group of each entry, and how far groups have moved since the last round."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, moved: np.ndarray) -> None:
        self.entries, self.groups, self.moved = entries, groups, moved
        self.large = [any(abs(v) > exact_up_to(entries.shape[2]) for v in part.ravel().tolist()) for part in entries]
        self.small = [None if big else part.astype(np.int64) for big, part in zip(self.large, entries, strict=True)]

    @classmethod
    def start(cls, entries: np.ndarray) -> Codebooks:
        groups = np.array([grouped(part) for part in entries]).reshape(entries.shape[:2])
        return cls(entries, groups, np.zeros((len(entries), GROUPS)))

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """After a round: entries are the means, rounded down, of their parts; unused ones stay."""
        entries, moved = self.entries.copy(), np.zeros((len(self.entries), GROUPS))
        for p in range(len(entries)):
            for e in np.flatnonzero(counts[p]).tolist():
                mean = [s // int(counts[p, e]) for s in sums[p, e]]
                step = math.isqrt(sum((a - b) ** 2 for a, b in zip(mean, entries[p, e], strict=True))) + 1
                entries[p, e] = mean
                g = self.groups[p, e]
                moved[p, g] = max(moved[p, g], step if step < FAR else math.inf)
        return Codebooks(entries, self.groups, moved)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.entries.ravel().tolist()).encode()).hexdigest()


def grouped(entries: np.ndarray) -> list[int]:
    """The group of each of a part's entries: a few rounds of means from spread ones. Any grouping gives the same codes."""
    x = np.array([[float(max(-FAR, min(FAR, v))) for v in e] for e in entries.tolist()]).reshape(len(entries), -1)
    x = x / max(1.0, np.abs(x).max(initial=0))
    centres = x[: 1].copy()
    while len(centres) < min(GROUPS, len(x)):
        centres = np.vstack([centres, x[((x[:, None] - centres) ** 2).sum(2).min(1).argmax()]])
    near = np.zeros(len(x), np.int64)
    for _ in range(5):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == g].mean(0) if (near == g).any() else centres[g] for g in range(len(centres))])
    return near.tolist()


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    away = x[:, None, :] - entries[None, :, :]
    return (away * away).sum(axis=2)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.minimum(np.sqrt(squared) * (1 - MARGIN), FAR).astype(np.float32)


def scan_all(x: np.ndarray, entries: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, its squared distance and a bound for each group."""
    d = _squares(x, entries)
    near = d.argmin(axis=1)
    best = d[np.arange(len(x)), near]
    rest = d.astype(float)
    rest[np.arange(len(x)), near] = math.inf
    bounds = np.full((len(x), GROUPS), FAR, np.float32)
    for g in range(GROUPS):
        if (own := groups == g).any():
            bounds[:, g] = _down(rest[:, own].min(axis=1))
    return near, best, bounds


def scan_where_bounds_fail(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, near: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the entries and (sunken) bounds of the round before; also how many distances were taken."""
    away = x - entries[near]
    own = (away * away).sum(axis=1)
    reach = np.sqrt(own) * (1 + MARGIN)
    was, near, best, taken = near, near.copy(), own.copy(), len(x)
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(GROUPS):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(bounds[:, g] <= reach)
        if not len(members) or not len(rows):
            continue
        d = _squares(x[rows], entries[members])
        taken += d.size
        k = d.argmin(axis=1)  # members ascend, so the lower index wins
        least, at = d[np.arange(len(rows)), k], members[k]
        better = (least < best[rows]) | ((least == best[rows]) & (at < near[rows]))
        best[rows[better]], near[rows[better]] = least[better], at[better]
        scanned.append((g, members, rows, d))
    bounds = bounds.copy()
    left = np.flatnonzero(was != near)
    of = groups[was[left]]
    bounds[left, of] = np.minimum(bounds[left, of], _down(own[left].astype(float)))
    for g, members, rows, d in scanned:
        rest = np.where(members[None, :] == near[rows][:, None], math.inf, d.astype(float))
        bounds[rows, g] = _down(rest.min(axis=1))
    return near, best, bounds, taken


def assign(x: np.ndarray, large: np.ndarray, books: Codebooks, state: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (rows, PARTS), squared distances as Python's or 64-bit numbers, and bounds (rows, PARTS, GROUPS)."""
    n = len(x)
    near, best, bounds = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), object if large.any() or any(books.large) else np.int64), np.zeros((n, PARTS, GROUPS), np.float32)
    for p in range(PARTS):
        plain = np.flatnonzero(~large) if not books.large[p] else np.zeros(0, np.int64)
        if len(plain):
            own = x[plain, p].astype(np.int64)
            if state is None:
                found = scan_all(own, books.small[p], books.groups[p])
            else:
                sunk = state[1][plain, p] - (books.moved[p] * (1 + MARGIN)).astype(np.float32)[None, :]
                found = scan_where_bounds_fail(own, books.small[p], books.groups[p], state[0][plain, p].astype(np.int64), sunk * (1 - MARGIN) - 1e-3)[:3]
            near[plain, p], best[plain, p], bounds[plain, p] = found
        rest = np.flatnonzero(large) if not books.large[p] else np.arange(n)
        if len(rest):  # bounds of nought: scanned whole in the next round too
            d = _squares(x[rest, p].astype(object), books.entries[p])
            near[rest, p] = [min(range(len(r)), key=r.__getitem__) for r in d.tolist()]
            best[rest, p] = d[np.arange(len(rest)), near[rest, p]]
    return near, best, bounds


def _packed(near: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([a.tobytes() + b.tobytes() for a, b in zip(near.astype(np.uint8), bounds, strict=True)], pa.binary())


def _unpacked(states: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(states.to_pylist()), np.uint8).reshape(len(states), -1)
    return data[:, :PARTS], np.ascontiguousarray(data[:, PARTS:]).view(np.float32).reshape(len(states), PARTS, GROUPS)


def _limbs(values: list[int]) -> list[dict[str, int]]:
    """Numbers of any size as sums of limbs of 32 bits, which Spark can add up."""
    out = []
    for at, value in enumerate(values):
        limb = 0
        while value not in (0, -1) or (value == -1 and limb == 0):
            low = value & 0xFFFFFFFF
            value >>= 32
            if value == -1:
                low, value = low - (1 << 32), 0
            out.append({"at": at, "limb": limb, "n": low})
            limb += 1
    return out


def one_round(vectors: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """vectors with their new state, and from each task a row that has sums only: for each part and entry the count and the sum
    of every component."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("limb", pa.int32()), ("n", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        books, sums, schema = shared.value, None, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in range(3)), ("state", pa.binary()), ("sums", kind)])
            if not batch.num_rows:
                continue
            x, large = whole(_matrix(batch.column(1), PARTS * width), width)
            state = None if batch.column(3).null_count else _unpacked(batch.column(3))
            near, _, bounds = assign(x, large, books, state)
            if sums is None:
                sums = np.zeros((PARTS, ENTRIES, 1 + width), object)
            for p in range(PARTS):
                for e in np.unique(near[:, p]).tolist():
                    own = x[near[:, p] == e, p]
                    sums[p, e] += np.array([len(own), *own.sum(axis=0).tolist()], object)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(near, bounds), pa.nulls(len(x), kind)], schema=schema)
        if sums is not None:
            last = pa.array([_limbs([int(v) for v in sums.ravel().tolist()])], kind)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), last], schema=schema)

    held = dict(vectors.dtypes)
    return vectors.select("vec_id", "embedding", "label", "state").mapInArrow(
        rows, f"vec_id long, embedding {held['embedding']}, label {held['label']}, state binary, sums array<struct<at:int,limb:int,n:long>>"
    )


def final_codes(vectors: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kind = dict(vectors.dtypes)["label"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            x, large = whole(_matrix(batch.column(1), PARTS * width), width)
            state = None if batch.column(3).null_count else _unpacked(batch.column(3))
            near, best, _ = assign(x, large, shared.value, state)
            errors = [sum(r) for r in best.tolist()]
            code = [bytes(r).hex() for r in near.astype(np.uint8)]
            error = pa.array([e if e <= LONG else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code), error], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "embedding", "label", "state").mapInArrow(rows, f"vec_id long, label {kind}, code string, error long")


def _summed(done: DataFrame, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (Python's numbers) and counts of every part and entry."""
    sums = done.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.at", "s.limb").agg(F.sum("s.n").alias("n"))
    total = np.zeros(PARTS * ENTRIES * (1 + width), object)
    for r in sums.collect():  # bounded by the size of the codebooks
        total[r["at"]] += r["n"] << 32 * r["limb"]
    total = total.reshape(PARTS, ENTRIES, 1 + width)[:, :entries]
    return total[:, :, 1:], total[:, :, 0].astype(np.int64)


def learn(vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None, int]:
    """The vectors with their last state, the codebooks after so many rounds, and the width of a part. No codebooks: no vectors."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return vectors, None, 0
    width = max(1, -(-longest // PARTS))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES).toArrow()
    x, _ = whole(_matrix(first.column(0).combine_chunks(), PARTS * width), width)
    books = Codebooks.start(x.astype(object).transpose(1, 0, 2))
    for r in range(rounds):
        done = scratch.keep(one_round(vectors, books, width), f"round-{r}")
        books = books.replaced(*_summed(done, len(x), width))
        vectors = done.where("sums is null").drop("sums")
        if r:
            scratch.drop(f"round-{r - 1}")
    return vectors, books, width


def compress(embeddings: DataFrame, scratch: Scratch | None = None, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    scratch = scratch or Scratch(ship(embeddings.sparkSession))
    ship(embeddings.sparkSession)
    kept = embeddings.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.lit(None).cast("binary").alias("state"))
    vectors, books, width = learn(kept, scratch, rounds)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    codes = scratch.keep(final_codes(vectors, books, width), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    sums = scratch.keep(sums, "label-errors")
    known = codes.join(sent_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
    return known.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """All rounds, with every distance."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.e) AS e, min(list_sum([(p.e[k] - b.e[k]) * (p.e[k] - b.e[k]) FOR k IN range(1, len(p.e) + 1)])::BIGINT * 16 + b.entry) AS best
  FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part
)"""
    means = """m{n} AS (
  SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY k) AS e FROM (
    SELECT part, best % 16 AS entry, k, sum(e[k])::BIGINT AS s, count(*) AS c FROM a{r}, LATERAL unnest(range(1, len(e) + 1)) u(k) GROUP BY ALL
  ) GROUP BY part, entry
), b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{n} m ON b.part = m.part AND b.entry = m.entry
)"""
    steps = [step.format(r=r, n=r + 1) for r in range(ROUNDS) for step in (nearest, means)] + [nearest.format(r=ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, c[part * (len(c) // 8) + 1 : (part + 1) * (len(c) // 8)] AS e FROM v, range(8) r(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e FROM p QUALIFY entry < 16
), {", ".join(steps)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(e[k]::VARCHAR, ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM b{ROUNDS}, LATERAL unnest(range(1, len(e) + 1)) u(k)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN v USING (vec_id), books
"""


OP13_SQL = _sql()
