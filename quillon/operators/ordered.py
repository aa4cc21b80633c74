"""Ordered work over whole tables: what a row gets from all rows before it, without gathering a group or a table.

Rows are dealt by ranges of their order and sorted, so one long group is as many tasks as it has ranges. A task carries what
it has met along its rows and writes them to the shared folder; what it had met at its end is one row. The few rows of all
tasks are put in order, and each task's rows get what the tasks before it handed on. What is carried has to
combine associatively: the last value that was set, or a table of states that is applied to another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.places import sent_with_tasks, stored

sent_with_tasks(__name__)
#: Offsets up to which they are sent to all tasks, after a count; more are merged with the rows.
SENT = 100_000
#: Kinds of axes that keep their type; all others are compared as doubles.
PLAIN = ("int", "bigint", "double", "date", "timestamp", "timestamp_ntz")


# --- the last value before


def as_of(rows: DataFrame, at: str, offsets: DataFrame, keep: tuple[str, ...] = ("target",), bottom: object = None, sent: int = SENT) -> DataFrame:
    """rows with the columns `keep` of the offset that is the greatest at or below their column `at`; null before the first
    offset and for a null `at`.

    From `bottom` on rows have the last offset, wherever it is: the end of a page shows its last part. offsets (offset, ...)
    have different values; null ones are left out. A few offsets, as counted, go to all tasks, which search them;
    beyond that rows and offsets are one stream, dealt by ranges and sorted, so neither the spacing nor
    the number of offsets matters, and rows with one value in common are as many tasks as they need. Not a number is above all
    numbers. Columns of rows may have any names; those of `keep` take the place of equal ones.
    """
    kinds = dict(rows.dtypes)[at], dict(offsets.dtypes)["offset"]
    axis = kinds[0] if kinds[0] == kinds[1] and kinds[0] in PLAIN else "double"
    known = offsets.where("offset IS NOT NULL").select(F.col("offset").cast(axis).alias("offset"), F.struct(*keep).alias("found"))
    held = rows.select(F.col(at).cast(axis).alias("axis"), F.struct(*rows.columns).alias("row"))
    n = known.count()
    found = _searched(held, known) if n <= sent else _merged(held, known)
    value = F.col("found")
    if bottom is not None and n:
        last = known.agg(F.max_by("found", "offset").alias("last"))
        found = found.crossJoin(F.broadcast(last))  # one row
        value = F.when(F.col("axis") >= F.lit(bottom), F.col("last")).otherwise(value)
    return found.select("row", value.alias("found")).select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in keep], *[F.col("found")[c].alias(c) for c in keep])


def _searched(held: DataFrame, known: DataFrame) -> DataFrame:
    """axis, row and found, by a binary search among sorted offsets that are sent to all tasks."""
    table = known.orderBy("offset").toArrow()
    offsets = table["offset"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("offset").type)
    items = table["found"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("found").type)
    shared = held.sparkSession.sparkContext.broadcast((offsets, items))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, items = shared.value
        sorted_offsets = offsets.to_numpy(zero_copy_only=False)
        for batch in batches:
            axis = batch.column(0)
            some = pc.is_valid(axis).to_numpy(zero_copy_only=False)
            place = np.full(len(axis), -1)
            place[some] = np.searchsorted(sorted_offsets, axis.drop_null().to_numpy(zero_copy_only=False), side="right") - 1
            found = items.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([axis, batch.column(1), found], ["axis", "row", "found"])

    kinds = dict(held.dtypes)
    return held.mapInArrow(searched, f"axis {kinds['axis']}, row {kinds['row']}, found {dict(known.dtypes)['found']}")


def _merged(held: DataFrame, known: DataFrame) -> DataFrame:
    """axis, row and found, from one sorted stream of rows and offsets."""
    kinds = dict(held.dtypes)
    kind_of_found = dict(known.dtypes)["found"]
    asked = held.select("axis", F.xxhash64("row").alias("tie"), "row", F.lit(None).cast(kind_of_found).alias("found"))
    given = known.select(F.col("offset").alias("axis"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast(kinds["row"]).alias("row"), "found")
    order = ("axis", "tie")  # offsets have no tie and come before rows of the same value
    stream = asked.unionByName(given).repartitionByRange(*order).sortWithinPartitions(*order)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            found = batch.column(2)
            if last is not None:
                found = pa.concat_arrays([last, found])
            at = np.maximum.accumulate(np.where(pc.is_valid(found).to_numpy(zero_copy_only=False), np.arange(len(found)), -1))
            filled = found.take(pa.array(at, mask=at < 0))
            if len(at) and at[-1] >= 0:
                last = filled.slice(len(filled) - 1)
            filled = filled.slice(len(filled) - batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns[:2], filled], ["part", "axis", "row", "found"])

    met = stream.select("axis", "row", "found").mapInArrow(carried, f"part int, axis {kinds['axis']}, row {kinds['row']}, found {kind_of_found}")
    met = stored(met)
    # one row for each range: the last offset that it met, and what came before it
    ends = met.where("row IS NULL").groupBy("part").agg(F.max_by("found", "axis").alias("end"))
    parts = met.select("part").distinct().join(ends, "part", "left")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select("part", F.last("end", ignorenulls=True).over(earlier).alias("handed"))
    return met.where("row IS NOT NULL").join(F.broadcast(handed), "part", "left").select("axis", "row", F.coalesce("found", "handed").alias("found"))


# --- states that follow from the state before


def state_tables(step: Callable[[Column], Column], states: tuple[str | None, ...]) -> Column:
    """array: for each of the states (the first is that before any row) the place of the state that follows."""
    place = F.create_map(*[x for k, s in enumerate(states) if s is not None for x in (F.lit(s), F.lit(k))])
    return F.array(*[F.coalesce(F.try_element_at(place, step(F.lit(s).cast("string"))), F.lit(0)).cast("tinyint") for s in states])


def composed(tables: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row its group's tables up to it, applied one after another; begins: whether a row is the first of its group.

    The rows of a table double the stretch they stand for in each turn, as in a parallel prefix.
    """
    out, first = tables.copy(), np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
    reach = 1
    while reach < len(out):
        rows = np.flatnonzero(np.arange(len(out)) - reach >= first)
        if not len(rows):
            break
        out[rows] = np.take_along_axis(out[rows], out[rows - reach].astype(np.int64), axis=1)
        reach *= 2
    return out


def states_in_order(rows: DataFrame, key: str, order: str, step: Callable[[Column], Column], states: tuple[str | None, ...]) -> DataFrame:
    """rows with `state`: step(state of the row before in the order of its key) for every row; the first row's is step(states[0]).

    step gives a column from a column and may use all columns of the row. A row is a table from each state to the one that follows;
    tables of a stretch compose to one table, so stretches are folded in tasks of their own, and a group's
    length bounds nothing. Null keys are one group. Rows that share key and order follow each other in the order of their hash.
    """
    tabled = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("of"), F.col(order).alias("nth"), state_tables(step, states).alias("table"))
    by = ("of", "nth", F.xxhash64("row"))
    sorted_rows = tabled.repartitionByRange(*by).sortWithinPartitions(*by)
    n = len(states)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(1)
            tables = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            differ = np.zeros(len(of), bool)
            whole = pa.concat_arrays([before, of]) if before is not None else of
            codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changes = codes[1:] != codes[:-1]
            differ[-len(changes) :] = changes if len(changes) else False
            if before is None:
                differ[0] = True
            tables = composed(tables, np.concatenate([[True], differ[1:]]))
            if not differ[0]:  # the first group goes on from the last batch
                until = int(np.argmax(differ)) if differ.any() else len(of)
                tables[:until] = np.take_along_axis(tables[:until], np.broadcast_to(held, (until, n)).astype(np.int64), axis=1)
            before, held = of.slice(len(of) - 1), tables[-1].copy()
            at = pa.array(np.arange(0, n * len(of) + 1, n, dtype=np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(tables.ravel(), pa.int8()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), part, np.int32)), batch.column(0), of, lists], ["part", "row", "of", "table"])

    kinds = dict(tabled.dtypes)
    met = sorted_rows.select("row", "of", "table").mapInArrow(folded, f"part int, row {kinds['row']}, of {kinds['of']}, table array<tinyint>")
    met = stored(met)
    # a group that goes on in a later range: its last table in each range, folded in the order of ranges
    spread = met.groupBy("of").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select(F.col("of").alias("group"), "least", "most")
    own = met.join(F.broadcast(spread), F.col("of").eqNullSafe(F.col("group")), "left")  # fewer groups than ranges
    last = F.max_by("table", F.struct(F.col("row")[order], F.xxhash64("row"))).alias("table")
    ends = own.where("least IS NOT NULL").groupBy("group", "part").agg(last)
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.collect_list("table").over(earlier), F.lit(0).cast("tinyint"), lambda s, t: F.get(t, s))
    starts = ends.select(F.col("group").alias("of_group"), F.col("part").alias("of_part"), start.alias("start"))
    on = (F.col("part") == F.col("of_part")) & F.col("of").eqNullSafe(F.col("of_group"))
    found = met.join(F.broadcast(starts), on, "left")
    names = F.array(*[F.lit(s).cast("string") for s in states])
    state = F.get(names, F.get("table", F.coalesce("start", F.lit(0).cast("tinyint"))))
    return found.select("row", state.alias("state")).select(*[F.col("row")[c].alias(c) for c in rows.columns if c != "state"], "state")
