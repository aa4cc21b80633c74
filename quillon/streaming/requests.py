"""Requests and answers of many keys as streams: one request in flight, answers that come too late, requests that never end.

State lives in Spark's state store (RocksDB, set here where the session names none), one small row for each key, so it follows
the number of keys and survives lost executors with the query's checkpoint. Rows of a trigger count in the order of
their time, then as given by `nth`; nulls come first. A state is called once for the rows of a key in a trigger, not for each of
them: rows are dealt by key and packed into lists first, and what a state gives are lists too.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import timedelta
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.sources.places import sent_with_tasks

sent_with_tasks(__name__)
#: Rows of a key that are one list, at most; rows and bytes that a task packs at once.
LIST, PACK_ROWS, PACK_BYTES = 4096, 1 << 18, 32 << 20
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_state_store(spark: SparkSession) -> SparkSession:
    if spark.conf.get(STORE[0], None) != STORE[1]:
        spark.conf.set(*STORE)
    return spark


#: Stands for null among numbers and times.
NOTHING = -(2**63)


def _lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows with one key as lists in the order of time and number; at is the latest time of a list."""
    codes = table["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices
    table = table.append_column("code", codes)
    table = table.take(pc.sort_indices(table, [("code", "ascending"), ("micros", "ascending"), ("nth", "ascending")])).combine_chunks()
    code = table["code"].to_numpy()
    firsts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    starts = np.concatenate([np.arange(a, b, LIST) for a, b in zip(firsts, np.r_[firsts[1:], len(code)], strict=True)])
    offsets = pa.array(np.r_[starts, len(code)], pa.int32())
    columns = {"key": table["key"].take(starts), "at": table["at"].take(np.r_[starts[1:], len(code)] - 1)}
    for name in table.column_names:
        if name not in ("key", "at", "code"):
            columns[name] = pa.ListArray.from_arrays(offsets, table[name].combine_chunks())
    yield from pa.table(columns).combine_chunks().to_batches(max_chunksize=4096)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, size = [], 0, 0
    for batch in chain(batches, (None,)):
        if held and (batch is None or rows + batch.num_rows > PACK_ROWS or size + batch.nbytes > PACK_BYTES):
            yield from _lists(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
        if batch is not None and batch.num_rows:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes


def _packed(rows: DataFrame, key: str, answer: Column, valid: Column) -> DataFrame:
    """The rows as lists of one key each, dealt by key. The lowest long stands for a null number or time."""
    kind, at = dict(rows.dtypes)[key], F.col("at").cast("timestamp")
    number = lambda c: F.coalesce(c, F.lit(NOTHING))
    named = rows.select(
        F.col(key).alias("key"), at.alias("at"), number(F.unix_micros(at)).alias("micros"), number(F.col("nth").cast("long")).alias("nth"),
        F.coalesce(answer, F.lit(False)).alias("answer"), "value", F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    lists = "micros array<long>, nth array<long>, answer array<boolean>, value array<string>, valid array<boolean>"
    return named.repartition("key").mapInArrow(_pack, f"key {kind}, at timestamp, {lists}")


def _rows(packed: Iterator[Row], passed: int | None) -> list[tuple]:
    """micros, nth, answer, value and valid of a key's rows in order, without those that the watermark has passed."""
    lists = [list(zip(r.micros, r.nth, r.answer, r.value, r.valid, strict=True)) for r in packed]
    found = lists[0] if len(lists) == 1 else sorted(chain(*lists), key=lambda r: r[:2])
    return found if passed is None else [r for r in found if r[0] > passed]


def _given(found: DataFrame, *columns: str) -> DataFrame:
    """The rows of the lists that a state gave."""
    rows = found.select("key", F.explode(F.arrays_zip("nth", "micros", *columns)).alias("r"))
    number = lambda c: F.when(F.col(f"r.{c}") != NOTHING, F.col(f"r.{c}"))
    return rows.select("key", number("nth").alias("nth"), F.timestamp_micros(number("micros")).alias("at"), *[f"r.{c}" for c in columns])


def _as_lists(key: Any, names: tuple[str, ...], rows: list[tuple]) -> Iterator[Row]:
    for i in range(0, len(rows), LIST):
        yield Row(key=key[0], **dict(zip(names, map(list, zip(*rows[i : i + LIST], strict=True)), strict=True)))


def _expiry(micros: int) -> int:
    """The first millisecond after a time."""
    return micros // 1000 + 1


class Requests(StatefulProcessor):
    """The state of a key is its open or last request: value, valid, finished, when it was sent, and the value wanted by now.

    A value is asked for if no request is open and the last one was for another value. While one is open nothing is sent, and the
    value counts as right. An answer counts if it echoes the value of the open request, which then is finished; if another value
    is wanted by then, it is asked for at once. A request that has had no answer for `patience` is finished and its value
    counts as right; the key's next row or a timer notices it, whichever is first.
    """

    GIVEN = ("nth", "micros", "outcome", "value", "in_error")

    def __init__(self, patience: int | None, timers: bool) -> None:
        self.patience, self.timers = patience, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("request", "value string, valid boolean, finished boolean, sent long, wanted string")

    def _over(self, sent: int, now: int) -> bool:
        return self.patience is not None and now - sent > self.patience

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.held.exists()
        value, valid, finished, sent, wanted = tuple(self.held.get()) if known else (None, True, True, 0, None)
        was, out = sent if known and not finished else None, []
        for micros, nth, answer, of, fits in _rows(rows, timerValues.getCurrentWatermarkInMs() * 1000 if self.timers else None):
            if not finished and self._over(sent, micros):
                valid, finished = True, True
            if answer and (finished or value != of):
                out.append((nth, micros, "late", of, False))
            elif answer:
                valid, finished = fits, True
                out.append((nth, micros, "answered", value, not valid))
                if wanted != value:
                    value, valid, finished, sent = wanted, True, False, micros
                    out.append((nth, micros, "sent", value, False))
            elif not finished:
                wanted, known = of, True
                out.append((nth, micros, "waiting", of, False))
            elif known and value == of:
                wanted = value
                out.append((nth, micros, "known", value, not valid))
            else:
                value, valid, finished, sent, wanted, known = of, True, False, micros, of, True
                out.append((nth, micros, "sent", value, False))
        if known:
            self.held.update((value, valid, finished, sent, wanted))
            if self.timers and self.patience is not None and not finished and sent != was:
                self.handle.registerTimer(_expiry(sent + self.patience))
        return _as_lists(key, self.GIVEN, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        value, _, finished, sent, wanted = tuple(self.held.get()) if self.held.exists() else (None, True, True, 0, None)
        if finished or _expiry(sent + self.patience) > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # answered, or of an earlier request
        now, out = sent + self.patience, []
        out.append((NOTHING, now, "expired", value, False))
        if wanted == value:
            self.held.update((value, True, True, sent, wanted))
        else:
            self.held.update((wanted, True, False, now, wanted))
            self.handle.registerTimer(_expiry(now + self.patience))
            out.append((NOTHING, now, "sent", wanted, False))
        return _as_lists(key, self.GIVEN, out)


def requests(rows: DataFrame, key: str, patience: timedelta | None = None, late: str | None = None) -> DataFrame:
    """What becomes of each row of a stream: key, nth, at, outcome ('sent', 'waiting', 'known', 'answered', 'late' or 'expired'), value
    and in_error.

    rows (key, nth long, at timestamp, answer boolean, value string, valid boolean): a value that is wanted, or an answer with
    the value that it echoes. Null values are values; a null `valid` is not valid. late: how late rows may come; then requests
    that never end are noticed by timers of event time too, else by the next row of their key only.
    """
    with_state_store(rows.sparkSession)
    found = _packed(rows, key, F.col("answer"), F.col("valid"))
    found = found.withWatermark("at", late) if late is not None else found.drop("at")
    given = None if patience is None else round(patience.total_seconds() * 1_000_000)
    states = found.groupBy("key").transformWithState(
        Requests(given, late is not None),
        f"key {dict(rows.dtypes)[key]}, nth array<long>, micros array<long>, outcome array<string>, value array<string>, in_error array<boolean>",
        "Append",
        "EventTime" if late is not None else "None",
    )
    return _given(states, "outcome", "value", "in_error")


class InTime(StatefulProcessor):
    """A key's current value, and its answers until the watermark has passed them.

    Answers wait in lists of their numbers, times and values, in the order of time: one list for what a trigger brought (cut at LIST
    answers). A key has one timer, at the earliest of them, so a trigger looks at what waits for a key once, however many
    answers it passes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, micros long, nth long, due long")
        self.waiting = handle.getListState("waiting", "nth array<long>, micros array<long>, value array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        value, micros, nth, due = tuple(self.held.get()) if self.held.exists() else (None, None, None, None)
        more = []
        for at, n, answer, of, _ in _rows(rows, timerValues.getCurrentWatermarkInMs() * 1000):
            if answer:
                more.append((n, at, of))
            elif micros is None or (at, n) > (micros, nth):
                value, micros, nth = of, at, n
        if more:
            self.waiting.appendList([tuple(map(list, zip(*more[i : i + LIST], strict=True))) for i in range(0, len(more), LIST)])
            due = self._next(due, _expiry(more[0][1]))
        self.held.update((value, micros, nth, due))
        return iter(())

    def _next(self, due: int | None, at: int) -> int:
        """The earlier of the time that the key's timer has and another one, and a timer there."""
        if due is not None and due <= at:
            return due
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        value, micros, nth, _ = tuple(self.held.get())
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        kept, out, due = [], [], None
        for nths, times, values in map(tuple, self.waiting.get()):
            n = bisect_right(times, passed, key=_expiry)
            if micros is not None:
                out += [(nths[i], times[i], value) for i in range(n) if values[i] == value]
            if n < len(times):
                kept.append((nths[n:], times[n:], values[n:]))
                due = _expiry(times[n]) if due is None else min(due, _expiry(times[n]))
        if kept:
            self.waiting.put(kept)
            self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        self.held.update((value, micros, nth, due))
        return _as_lists(key, ("nth", "micros", "value"), out)


def in_time_stream(answers: DataFrame, current: DataFrame, key: str, late: str) -> DataFrame:
    """key, nth, at and value of the answers of a stream that echo the value current for their key when the watermark passes them.

    answers and current (key, nth long, at timestamp, value string) are two streams; the latest row of current counts, by at and
    nth. An answer waits for the watermark, which is `late` behind the newest row of either stream, so what is held are the
    answers of that time and one value for each key; what comes later than that is dropped.
    """
    with_state_store(answers.sparkSession)
    named = [d.select(F.col(key).alias("key"), "nth", "at", "value", F.lit(a).alias("answer")) for d, a in ((answers, True), (current, False))]
    both = _packed(named[0].unionByName(named[1]), "key", F.col("answer"), F.lit(True)).withWatermark("at", late)
    lists = "nth array<long>, micros array<long>, value array<string>"
    return _given(both.groupBy("key").transformWithState(InTime(), f"key {dict(answers.dtypes)[key]}, {lists}", "Append", "EventTime"), "value")
