"""Substring dedup (operator 12): super-k-mer partitioning over words.

A window is WINDOW consecutive words of one document; words of windows that also start in a document with a smaller doc_id go.

1. Minimisers. A window's minimiser is the least hash of the MINIMISER-word sequences in it, so equal windows have equal
   ones. Consecutive windows that share it are a super-k-mer, at most LONGEST windows each.
2. What can repeat. For every minimiser the least and greatest doc_id and the number of its super-k-mers are summed, by map
   tasks first. Minimisers of one document alone have no repeats; the others are marked in a bitmap of fixed size (BITS), which
   all tasks get. A mark too many only sends more.
3. Buckets. Super-k-mers of marked minimisers travel as one packed string each to the bucket of their minimiser, which
   puts equal strings together, sorts the windows of different ones, and so has the least doc_id of every window, by
   comparing whole words. It returns the stretches of words that go, for each document.
4. Hot buckets. A minimiser with more than HOT super-k-mers (a passage that a third of all documents share, in contexts of their
   own) is marked in a second bitmap and sends no strings: its windows are counted as digests of 128 bits in an
   aggregate that map tasks begin, so no bucket holds more than HOT strings. Windows that repeat there are sent to all
   tasks if they are SENT at most, as counted; else they are joined by their digests, where Spark splits a hot side.
5. Texts. The stretches of a document are joined to its text, which is shuffled once, and a last map leaves their words out.

Defined results. A null or empty text has no words. A row without a doc_id counts as later than all rows with one: it loses
windows that they have, and takes none from others. Rows that repeat a doc_id are documents of the same rank, so they take
nothing from one another, and each is judged by its own text. A window that repeats in its own document only stays. An empty
table gives an empty result. Columns other than doc_id and text are ignored, whatever their names. Memory follows the longest
text, HOT * LONGEST windows of a bucket, and the bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import release
from quillon.llm.shared import Scratch, ship, table, text_mark
from quillon.llm.shingles import CHUNK, mixed, words_of

WINDOW, MINIMISER = 50, 16
#: Windows of a super-k-mer at most, and super-k-mers of a bucket at most.
LONGEST, HOT = 256, 512
#: Each bitmap has 2^BITS bits.
BITS = 26
#: Repeated windows of hot buckets that are sent to all tasks at most, of 24 bytes each.
SENT = 1 << 20
#: The rank of rows without a doc_id.
LAST = (1 << 63) - 1

SPAN = "doc long, mark long, start int, stop int"


def ranked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce(text_mark(), F.lit(0)).alias("mark")
    )


class Chunk:
    """The super-k-mers of several texts: their minimiser, first window and number of windows, among the words of all texts."""

    def __init__(self, docs: list[int], marks: list[int], texts: list[bytes], window: int, short: int) -> None:
        self.docs, self.marks, self.texts, self.window = np.array(docs, np.int64), np.array(marks, np.int64), texts, window
        self.words, places = words_of(b"\n".join(texts))
        self.ends = np.searchsorted(places, np.cumsum([len(t) + 1 for t in texts]))
        self.begins = np.append(0, self.ends[:-1])
        n = len(self.words) - window + 1
        self.minimiser, self.first, self.windows, self.text = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        if n <= 0:
            return
        text = np.repeat(np.arange(len(texts)), self.ends - self.begins)[:n]
        least = sliding_least(rolled(self.words, short), window - short + 1)
        fit = np.arange(n) + window <= self.ends[text]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (fit[1:] != fit[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))[fit[at]]
        at = at[fit[at]]
        parts = -(-size // LONGEST)
        of = np.repeat(np.arange(len(at)), parts)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = at[of] + turn * LONGEST
        self.windows = np.minimum(size[of] - turn * LONGEST, LONGEST)
        self.minimiser, self.text = least[at[of]], text[at[of]]

    def members(self, which: np.ndarray) -> np.ndarray:
        """The first word of each window of some super-k-mers."""
        sizes = self.windows[which]
        return np.repeat(self.first[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each word."""
        return rolled(self.words, self.window), rolled(mixed(self.words, 0x5851F42D4C957F2D), self.window, 0xDA942042E4DD58B5)

    def packed(self, k: int) -> bytes:
        """The words of a super-k-mer, one space between."""
        t = self.text[k]
        first = self.first[k] - self.begins[t]
        return b" ".join(self.split(t)[first : first + self.windows[k] + self.window - 1])

    def split(self, text: int) -> list[bytes]:
        if getattr(self, "_held", (None,))[0] != text:
            self._held = text, self.texts[text].split()  # bytes split at ASCII white space only
        return self._held[1]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many successive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == width else np.minimum(values[: -(width - reach)], values[width - reach :])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def rolled(words: np.ndarray, window: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A polynomial modulo 2^64 of each so many successive hashes."""
    n = len(words) - window + 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return mixed((sums[window:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))


def chunks_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Chunk]:
    """Chunks of batches of doc, mark and text (binary)."""
    short = min(MINIMISER, max(1, window // 3))
    for batch in batches:
        docs, marks, texts, size = [], [], [], 0
        for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs.append(doc)
            marks.append(mark)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= 4 * CHUNK:
                yield Chunk(docs, marks, texts, window, short)
                docs, marks, texts, size = [], [], [], 0
        if docs:
            yield Chunk(docs, marks, texts, window, short)


def folded(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Different keys with their least and greatest doc and their number."""
    order = np.lexsort([docs, *reversed(keys)])
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.ones(len(docs), bool)
    if len(docs):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1 if len(at) else at
    return [k[at] for k in keys], docs[at], docs[last], last - at + 1


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "mark", F.col("text").cast("binary").alias("text"))


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def minimisers(docs: DataFrame, window: int) -> DataFrame:
    """h, least, most and n of every minimiser."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for chunk in chunks_of(batches, window):
            (h,), least, most, n = folded([chunk.minimiser], chunk.docs[chunk.text])
            yield _batch([h, least, most, n], ["h", "least", "most", "n"])

    counts = _inputs(docs).mapInArrow(rows, "h long, least long, most long, n long")
    return counts.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))


def bitmaps(counts: DataFrame, hot: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of minimisers that may repeat: cold and hot ones. At most 2^bits / 64 rows come to the driver."""
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    slot = F.shiftright(F.col("h").bitwiseAND((1 << bits) - 1), 6)
    found = (
        counts.where("least < most")
        .groupBy(slot.alias("slot"))
        .agg(F.bit_or(F.when(F.col("n") <= hot, bit).otherwise(0)).alias("cold"), F.bit_or(F.when(F.col("n") > hot, bit).otherwise(0)).alias("hot"))
        .toArrow()
    )
    maps = []
    for name in ("cold", "hot"):
        out = np.zeros(1 << bits - 6, np.uint64)
        out[found["slot"].to_numpy()] = found[name].to_numpy().astype(np.int64).view(np.uint64)
        maps.append(out)
    return maps[0], maps[1]


def marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(6)) & np.uint64(len(bitmap) - 1)
    return (bitmap[slot.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def super_kmers(docs: DataFrame, maps: Broadcast, window: int) -> DataFrame:
    """h, doc, mark, start (a word) and packed of every super-k-mer of a cold minimiser that may repeat."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cold, hot = maps.value
        for chunk in chunks_of(batches, window):
            which = np.flatnonzero(marked(chunk.minimiser, cold) & ~marked(chunk.minimiser, hot))
            of = chunk.text[which]
            packed = pa.array([chunk.packed(k) for k in which.tolist()], pa.binary())
            numbers = [chunk.minimiser[which].view(np.int64), chunk.docs[of], chunk.marks[of], (chunk.first[which] - chunk.begins[of]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), packed], ["h", "doc", "mark", "start", "packed"])

    return _inputs(docs).mapInArrow(rows, "h long, doc long, mark long, start int, packed binary")


def windows_in(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, as slices of it."""
    at = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    begins, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(packed)]
    return [packed[a:b] for a, b in zip(begins, ends[window - 1 :], strict=False)]


def bucket_spans(members: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """From (doc, mark, start, packed) of one minimiser: (doc, mark, start, stop) of words that go."""
    strings: dict[bytes, list[tuple[int, int, int]]] = {}
    for doc, mark, start, packed in members:
        strings.setdefault(packed, []).append((doc, mark, start))
    firsts = [min(own)[0] for own in strings.values()]
    if len(set(firsts)) == 1 and all(max(own)[0] == firsts[0] for own in strings.values()):
        return
    if len(strings) == 1:
        leasts = [[firsts[0]]]
        sizes = [next(iter(strings)).count(b" ") + 2 - window]
    else:
        held = sorted((w, first, k, at) for k, (packed, first) in enumerate(zip(strings, firsts, strict=True)) for at, w in enumerate(windows_in(packed, window)))
        sizes = [0] * len(strings)
        for _, _, k, _ in held:
            sizes[k] += 1
        leasts = [[0] * n for n in sizes]
        for _, same in groupby(held, lambda x: x[0]):
            least = None
            for _, first, k, at in same:
                least = first if least is None else least
                leasts[k][at] = least
    for own, least, size in zip(strings.values(), leasts, sizes, strict=True):
        stretches = [(v, sum(1 for _ in same)) for v, same in groupby(least)] if len(strings) > 1 else [(least[0], size)]
        for doc, mark, start in own:
            at, begin = 0, None
            for v, n in [*stretches, (LAST, 0)]:
                if v < doc and begin is None:
                    begin = at
                if (v >= doc or not n) and begin is not None:
                    yield doc, mark, start + begin, start + at + window - 1
                    begin = None
                at += n


def buckets(packed: DataFrame, window: int) -> DataFrame:
    """doc, mark, start and stop of the words that cold minimisers remove."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, members, out = None, [], []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "mark", "start", "stop"])

        for batch in batches:
            for h, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != key:
                    out.extend(bucket_spans(members, window))
                    key, members = h, []
                members.append(tuple(member))
            yield ready()
        out.extend(bucket_spans(members, window))
        yield ready()

    return packed.repartition("h").sortWithinPartitions("h").mapInArrow(rows, SPAN)


def hot_windows(docs: DataFrame, maps: Broadcast, window: int) -> DataFrame:
    """a, b (a digest) and least of the windows of hot minimisers that are in several documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for chunk in chunks_of(batches, window):
            which = np.flatnonzero(marked(chunk.minimiser, maps.value[1]))
            if len(which):
                at, (a, b) = chunk.members(which), chunk.digests()
                (a, b), least, most, _ = folded([a[at], b[at]], np.repeat(chunk.docs[chunk.text[which]], chunk.windows[which]))
                yield _batch([a, b, least, most], ["a", "b", "least", "most"])

    found = _inputs(docs).mapInArrow(rows, "a long, b long, least long, most long")
    return found.groupBy("a", "b").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("a", "b", "least")


def hot_spans(docs: DataFrame, maps: Broadcast, repeated: DataFrame, window: int, sent: int) -> DataFrame:
    """doc, mark, start and stop of the words that hot minimisers remove; repeated: a stored table of hot_windows()."""
    known = None
    if repeated.count() <= sent:
        rows = repeated.toArrow()
        a, b, least = (rows[c].to_numpy().astype(np.int64) for c in ("a", "b", "least"))
        order = np.lexsort((b, a))
        known = docs.sparkSession.sparkContext.broadcast((a[order], b[order], least[order]))

    def asked(chunk: Chunk) -> tuple[np.ndarray, ...]:
        which = np.flatnonzero(marked(chunk.minimiser, maps.value[1]))
        at, (a, b) = chunk.members(which), chunk.digests() if len(which) else (np.zeros(0, np.uint64),) * 2
        return at, np.repeat(chunk.text[which], chunk.windows[which]), a[at].view(np.int64), b[at].view(np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first, second, least = known.value
        for chunk in chunks_of(batches, window):
            at, text, a, b = asked(chunk)
            place = np.searchsorted(first, a)
            goes = np.zeros(len(at), bool)
            open_ = np.arange(len(at))
            while len(open_):  # one turn, but for windows that share half a digest
                open_ = open_[place[open_] < len(first)]
                open_ = open_[first[place[open_]] == a[open_]]
                same = second[place[open_]] == b[open_]
                goes[open_[same]] = least[place[open_[same]]] < chunk.docs[text[open_[same]]]
                open_ = open_[~same]
                place[open_] += 1
            at, text = at[goes], text[goes]
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0)]) if len(at) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
            of = text[begin]
            start, stop = at[begin] - chunk.begins[of], at[end] - chunk.begins[of] + window
            yield _batch([chunk.docs[of], chunk.marks[of], start.astype(np.int32), stop.astype(np.int32)], ["doc", "mark", "start", "stop"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for chunk in chunks_of(batches, window):
            at, text, a, b = asked(chunk)
            yield _batch([a, b, chunk.docs[text], chunk.marks[text], (at - chunk.begins[text]).astype(np.int32)], ["a", "b", "doc", "mark", "start"])

    if known is not None:
        return _inputs(docs).mapInArrow(found, SPAN)
    every = _inputs(docs).mapInArrow(listed, "a long, b long, doc long, mark long, start int")
    return every.join(repeated, ["a", "b"]).where("least < doc").select("doc", "mark", "start", (F.col("start") + window).alias("stop"))


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, hot: int = HOT, bits: int = BITS, sent: int = SENT) -> DataFrame:
    """doc, mark and spans (start and stop of words that go; they may overlap) of each document of ranked() that loses words."""
    counts = scratch.keep(minimisers(docs, window), "minimisers")
    cold_map, hot_map = bitmaps(counts, hot, bits)
    scratch.drop("minimisers")
    maps = docs.sparkSession.sparkContext.broadcast((cold_map, hot_map))
    spans = buckets(super_kmers(docs, maps, window), window)
    if hot_map.any():
        repeated = scratch.keep(hot_windows(docs, maps, window), "hot")
        spans = spans.unionByName(hot_spans(docs, maps, repeated, window, sent))
    spans = spans.distinct().groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return scratch.keep(spans, "spans")


def without_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words that stay, one space between) from doc_id, text and spans."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if spans:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, [s["start"] for s in spans], 1)
                    np.add.at(edges, [s["stop"] for s in spans], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return rows.mapInArrow(mapped, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, window: int = WINDOW, hot: int = HOT, bits: int = BITS, sent: int = SENT) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row."""
    spark = ship(docs.sparkSession)
    rows = ranked(docs)
    spans = repeated_spans(rows, scratch or Scratch(spark), window, hot, bits, sent)
    return without_spans(rows.join(spans.hint("merge"), ["doc", "mark"], "left"))


def sha256_of(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_of("kept").alias("kept_sha256"))


OP12_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT id, doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS words FROM texts, LATERAL unnest(range(len(w) - 49)) u(i)
), first AS (
  SELECT words, min(doc_id) AS least FROM windows GROUP BY words
), gone AS (
  SELECT id, i FROM windows JOIN first USING (words) WHERE least < doc_id
), places AS (
  SELECT id, i, w[i + 1] AS word FROM texts, LATERAL unnest(range(len(w))) u(i)
), near AS (
  SELECT id, i, word, max(gone.i) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
  FROM places LEFT JOIN gone USING (id, i)
), kept AS (
  SELECT id, count_if(removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS text FROM near GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (id)
"""
