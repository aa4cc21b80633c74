"""Periodic run detection (operator 11): Crochemore's partition refinement over words, level by level.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of at least LEAST words and EXPONENT
periods are reported.

1. Classes. At level l two positions are in one class if the same l words begin there. Level 1 are equal words. A class of
   level l splits by the classes of the positions one to the right. Of the parts of a split class all but the largest (the
   smaller halves) are looked at in the next level, and only their left neighbours move, so a text of n words
   moves n log n positions in all. A position so near the end that l words do not fit stays where it is: it stands
   behind all members that count, so it parts no neighbours.
2. Neighbours. Members of a class are a linked list by position. Where neighbours are l apart at level l, the l words repeat at
   once: a square with a root that is no power itself. Links that change are filed by their distance and looked at when
   the level gets there.
3. Runs. Squares of one period at successive positions are one run. Levels end at a third of a text's length; where no class
   splits any more, only distances on file are left to look at.

All texts of a group of about GROUP words take their levels together, each step in a few numpy calls; texts never share a
class. Tasks map over their rows, nothing is shuffled, and memory follows GROUP and the longest text. The largest part
of a split is set aside as the method has it, so long periodic texts cost n log n too.

Defined results. A null or empty text has no words and no runs. A null doc_id is reported as it is, and its words are never
exchanged by the query's rule. Rows that repeat a doc_id or a text get a row each. An empty table gives an empty result. Of
runs with the same exponent the smallest start, then the smallest period, is the best. Columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import release
from quillon.llm.shared import ship, table

#: Words of a run at least, and periods.
LEAST, EXPONENT = 24, 3
#: Words of texts that are handled together (a longer text by itself).
GROUP = 1 << 18

#: From a doc_id and a number of words: the first word that is exchanged and the period that the rest gets, or None.
Rule = Callable[[int | None, int], tuple[int, int] | None]
RUN = "array<struct<start:long,length:long,period:long>>"


def _members(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Classes:
    """The classes of a level over the words of several texts, with a gap behind each."""

    def __init__(self, words: np.ndarray, texts: np.ndarray, limit: np.ndarray) -> None:
        """words: numbers, -1 in gaps; texts: each position's text; limit: the last level at which it counts."""
        n = len(words)
        self.n, self.limit, self.level = n, np.append(limit, 0), 1
        key = texts * (words.max(initial=0) + 2) + words + 1
        _, self.of = np.unique(key, return_inverse=True)
        self.placed = np.argsort(self.of, kind="stable")  # members of a class stand side by side
        self.place = np.empty(n, np.int64)
        self.place[self.placed] = np.arange(n)
        sizes = np.bincount(self.of)
        classes = len(sizes)
        self.size, self.first = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[:classes], self.first[:classes] = sizes, np.cumsum(sizes) - sizes
        self.classes = classes
        self.after, self.before = np.full(n + 1, n), np.full(n + 1, n)  # n: none
        same = np.flatnonzero(self.of[self.placed[:-1]] == self.of[self.placed[1:]])
        left, right = self.placed[same], self.placed[same + 1]
        self.after[left], self.before[right] = right, left
        self.starts = np.concatenate([[True], texts[1:] != texts[:-1]])
        # of each text's words all but the most frequent one are to be looked at
        text_of = texts[self.placed[self.first[:classes]]]
        order = np.lexsort((-sizes, text_of))
        largest = order[np.concatenate([[True], text_of[order][1:] != text_of[order][:-1]])]
        small = np.ones(classes, bool)
        small[largest] = False
        small &= words[self.placed[self.first[:classes]]] >= 0
        self.small = np.flatnonzero(small)
        self.filed: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        self.later: list[np.ndarray] = []
        self.until = 2  # distances below are filed one by one
        self.file(left)

    def file(self, at: np.ndarray) -> None:
        """Keep positions until the level gets to their distance from the next member."""
        apart = self.after[at] - at
        fit = (apart >= self.level) & (apart <= self.limit[self.after[at]]) & (apart <= self.limit[at])
        at, apart = at[fit], apart[fit]
        near = apart < self.until
        if not near.all():
            self.later.append(at[~near])
            at, apart = at[near], apart[near]
        if len(at):
            order = np.argsort(apart, kind="stable")
            values, cuts = np.unique(apart[order], return_index=True)
            for value, part in zip(values.tolist(), np.split(at[order], cuts[1:]), strict=True):
                self.filed[value].append(part)

    def squares(self) -> np.ndarray:
        """Positions whose next member is as far away as the level, in order."""
        if self.level >= self.until:
            self.until *= 2
            if self.later:
                held, self.later = np.unique(np.concatenate(self.later)), []
                self.file(held)
        found = self.filed.pop(self.level, None)
        if found is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(found))
        return at[self.after[at] - at == self.level]

    def refine(self) -> None:
        """To the next level, or on to one with squares on file where no class splits any more."""
        self.level += 1
        if not len(self.small):
            while self.level < self.until and self.level not in self.filed:
                self.level += 1
            return
        right = self.placed[_members(self.first[self.small], self.size[self.small])]
        right = right[~self.starts[right]]
        moved = right - 1
        fit = (self.size[self.of[moved]] > 1) & (self.limit[moved] >= self.level)
        moved, right = moved[fit], right[fit]
        self.small = self.small[:0]
        if not len(moved):
            return
        group = self.of[moved] * (self.n + 1) + self.of[right]
        order = np.lexsort((moved, group))
        moved, group = moved[order], group[order]
        parent = self.of[moved]
        begins = np.concatenate([[True], group[1:] != group[:-1]])
        at_group = np.flatnonzero(begins)
        sizes = np.diff(np.append(at_group, len(moved)))
        parents = parent[at_group]  # of each group, ascending
        at_parent = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        taken = np.add.reduceat(sizes, at_parent)
        groups = np.diff(np.append(at_parent, len(parents)))
        own = parents[at_parent]
        # classes that move as a whole, in one group, do not split
        whole = np.repeat((taken == self.size[own]) & (groups == 1), groups)
        if whole.any():
            keep = np.repeat(~whole, sizes)
            moved, parent = moved[keep], parent[keep]
            sizes, parents = sizes[~whole], parents[~whole]
            if not len(moved):
                return
            at_parent = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            taken = np.add.reduceat(sizes, at_parent)
            groups = np.diff(np.append(at_parent, len(parents)))
            own = parents[at_parent]
        self.unlink(moved[np.lexsort((moved, parent))], parent)
        ends = self.first[own] + self.size[own]
        self.swap(moved, parent, own, ends - taken)
        rest = self.size[own] - taken
        # groups become classes; where nothing is left of a class, its first group keeps the name
        names = self.classes + np.arange(len(sizes))
        names[at_parent[rest == 0]] = own[rest == 0]
        used, fresh = np.unique(names[names >= self.classes], return_inverse=True)
        names[names >= self.classes] = self.classes + fresh
        self.classes += len(used)
        if self.classes > len(self.size):
            more = self.classes + self.n
            self.size, self.first = np.resize(self.size, more), np.resize(self.first, more)
        first = np.repeat(ends - taken, groups) + (np.cumsum(sizes) - sizes) - np.repeat(np.cumsum(taken) - taken, groups)
        self.size[own], places = rest, _members(first, sizes)
        self.size[names], self.first[names] = sizes, first
        self.placed[places], self.place[moved] = moved, places
        self.of[moved] = np.repeat(names, sizes)
        # links within groups
        last = np.cumsum(sizes) - 1
        self.after[moved[:-1]], self.before[moved[1:]] = moved[1:], moved[:-1]
        self.after[moved[last]], self.before[moved[last - sizes + 1]] = self.n, self.n
        self.file(moved)
        # the smaller halves: all parts of a class but its largest
        owner = np.repeat(np.arange(len(own)), groups)
        part_of = np.concatenate([owner, np.flatnonzero(rest)])
        part_size, part = np.concatenate([sizes, rest[rest > 0]]), np.concatenate([names, own[rest > 0]])
        order = np.lexsort((-part_size, part_of))
        largest = np.concatenate([[True], part_of[order][1:] != part_of[order][:-1]])
        self.small = part[order[~largest]]

    def unlink(self, moved: np.ndarray, parent: np.ndarray) -> None:
        """Take positions (by class and position) out of their lists."""
        joined = (self.after[moved[:-1]] == moved[1:]) & (len(moved) > 1)
        head = np.concatenate([[True], ~joined])
        tail = np.concatenate([~joined, [True]])
        left, right = self.before[moved[head]], self.after[moved[tail]]
        self.after[left], self.before[right] = right, left
        self.file(left[left < self.n])

    def swap(self, moved: np.ndarray, parent: np.ndarray, own: np.ndarray, cut: np.ndarray) -> None:
        """Bring the positions that move behind those that stay, in each class; cut: where the former will begin."""
        border = cut[np.searchsorted(own, parent)]
        outside = moved[self.place[moved] < border]
        if not len(outside):
            return
        ends = self.first[own] + self.size[own]
        behind = self.placed[_members(cut, ends - cut)]
        goes = np.zeros(self.n, bool) if len(moved) * 16 > self.n else None
        if goes is not None:
            goes[moved] = True
            stays = behind[~goes[behind]]
        else:
            stays = behind[~np.isin(behind, moved)]
        a, b = self.place[outside], self.place[stays]  # both by class, as many of each
        self.placed[b], self.placed[a] = outside, stays
        self.place[outside], self.place[stays] = b, a


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """(start, length, period) of each run, by start and period, for texts given as word numbers."""
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate([x for t in texts for x in (t, [-1])]) if texts else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(texts)), lengths + 1)
    begins = np.cumsum(lengths + 1) - lengths - 1
    found: list[np.ndarray] = []
    if len(words):
        left = np.repeat(begins + lengths, lengths + 1) - np.arange(len(words))
        classes = Classes(words, number, np.minimum((lengths // exponent)[number], left))
        deepest = int(lengths.max()) // exponent
        while classes.level <= deepest:
            at = classes.squares()
            if len(at):
                q = classes.level
                cuts = np.flatnonzero(np.diff(at) != 1)
                start, end = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
                length = end - start + 2 * q
                fit = length >= max(least, exponent * q)
                found.append(np.column_stack([number[start], start - begins[number[start]], length, np.full(len(start), q)])[fit])
            if not len(classes.small) and not classes.filed and not classes.later:
                break
            classes.refine()
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def find_runs(docs: DataFrame, rule: Rule | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (by start and period) and collapsed (the words kept, one space between) of every row."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def answered(ids: list[int | None], held: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        all_runs = runs_of(numbers, least, exponent)
        collapsed = []
        for words, runs in zip(held, all_runs, strict=True):
            if len(runs):
                words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
            collapsed.append(b" ".join(words))
        rows = np.concatenate(all_runs)
        fields = [pa.array(rows[:, k]) for k in range(3)]
        at = np.cumsum([0, *map(len, all_runs)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists.cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids: list[int | None] = []
            held: list[list[bytes]] = []
            numbers: list[np.ndarray] = []
            size, index = 0, defaultdict[bytes, int]()
            index.default_factory = index.__len__
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()  # bytes split at ASCII white space only
                if rule is not None and words and (cut := rule(doc_id, len(words))) is not None:
                    start, period = cut
                    words = words[:start] + [words[start + k % period] for k in range(len(words) - start)]
                ids.append(doc_id)
                held.append(words)
                numbers.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= GROUP:
                    yield answered(ids, held, numbers)
                    ids, held, numbers, size = [], [], [], 0
                    index.clear()
            if ids:
                yield answered(ids, held, numbers)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, f"doc_id long, runs {RUN}, collapsed string")


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The query's rule: a tenth of the documents go on with a period from some word on."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), planted)
    ahead = lambda a, b: (
        F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1))
        .when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1))
        .otherwise(F.when(a.period < b.period, -1).otherwise(1))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.get(F.array_sort("runs", ahead), 0)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: Equal words of a text at every distance that three periods allow, gathered to stretches.
OP11_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::BIGINT FOR k IN range(8)]),
             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h
  FROM documents
), rule AS (
  SELECT id, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
         CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p
  FROM base
), texts AS MATERIALIZED (
  SELECT id, doc_id, n, CASE WHEN planted THEN [w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] FOR i IN range(n)] ELSE w END AS w
  FROM rule
), words AS MATERIALIZED (
  SELECT id, n, i, w[i + 1] AS word FROM texts, LATERAL unnest(range(n)) u(i)
), equal AS (
  SELECT a.id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.id = b.id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 3 <= a.n
), stretches AS (
  SELECT id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM equal
  ) GROUP BY id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS MATERIALIZED (
  SELECT id, start, length, min(q) AS period FROM stretches GROUP BY id, start, length
), best AS (
  SELECT id, start, length, period, row_number() OVER (PARTITION BY id ORDER BY start, period) AS place FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.id = r.id AND s.length * r.period > r.length * s.period)
), lines AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY id
), dropped AS (
  SELECT DISTINCT id, i FROM runs, LATERAL unnest(range(start + period, start + length)) u(i)
), collapsed AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (id, i) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN lines USING (id) LEFT JOIN best ON best.id = texts.id AND place = 1 LEFT JOIN collapsed ON collapsed.id = texts.id
"""
