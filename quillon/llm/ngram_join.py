"""N-gram Jaccard join (operator 9): T-occurrence search with DivideSkip.

Two texts link when their sets of word shingles have a Jaccard similarity of `percent` / 100 or more. A partner of a set
of n shingles then occurs on at least T = ceil(n * percent / 100) of the set's n inverted lists.

1. Frequent shingles. Each task counts shingles in blocks of its documents and passes on those that occur twice in a
   block; the MOST_FREQUENT of the sums are known to all tasks as the long lists. This is an order of lists only: any
   order gives the same links, a good one gives few candidates. Its bound is what makes its broadcast safe.
2. Candidates. Of a set's lists the longest are set aside, so that two linked sets share at least c of the others, with c
   about (1 - percent / 100) * n; a shared passage is not enough then. Entries of these short lists are dealt by shingle,
   pairs on a list are counted, and those that reach c are candidates. On a list of more than NEAR + 1 entries no pair
   is made, so a list makes rows in proportion to its entries, however long it is. Two sets share at most as many such
   lists as each of them is on, so c is less by that for them. What that leaves are pairs which share long lists only, c
   of them: both have c long lists then, and of these one in common that is not among the c - 1 longest of either. So only
   sets with that many are joined, each with the first one of such a list. Components of candidates are groups: all links
   lie within them.
3. Search. The sets of candidate groups are gathered by group, in blocks of at most BLOCK shingles, and each block is
   searched with DivideSkip: lists of the block are sorted by length, the long ones set aside, the short ones merged and
   counted, and sets that reach the remaining need are probed on the long lists by binary search. Sets of a block that
   already are connected are not compared again.
4. Large groups. A group of several blocks goes on in rounds: a block of its unsettled sets is compared with what is not
   settled by comparison in its blocks. A set is settled when it was compared with all others, or is in the group's largest component, whose pairs
   need no comparison. So a group of near copies needs one or two rounds, whatever its size, and no link is lost.

Exact copies of a set are one member throughout. Output is one row for each document.

Defined results. Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id each get a row with
the set of their own text, and are linked only as other documents are.
A row without a doc_id links like others, and others link through it; it gets the least id that its links reach and goes for
that one, or null, and stays, where they reach no id. Of ties nothing has to be chosen: equal sets are one. An empty table
gives an empty result; columns other than doc_id and text are ignored, or carried along by drop_near_copies, whatever
their names. Memory of a task follows the longest text and BLOCK.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.memory import release
from quillon.llm.shared import Scratch, most_frequent, sent_if_small, ship, table, text_mark, without_rows
from quillon.llm.shingles import Frequencies, shingle_sets, signature

WORDS, PERCENT = 4, 85
#: Lists whose length is known to all tasks, at most: 16 bytes each.
MOST_FREQUENT = 1 << 19
#: Shingles that a task counts together, and that a block of the search holds; sets that a task remembers, to list each once.
COUNTED, BLOCK, SEEN = 1 << 20, 1 << 20, 200_000
#: Entries before it on a list that an entry is paired with.
NEAR = 32
#: Entries of short lists up to which they are merged by a heap; beyond, by counting.
HEAPED = 256


def need(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """T: the least number of common shingles that a set of n has with any partner."""
    return -(-n * percent // 100)


def frequent_shingles(docs: DataFrame, words: int, scratch: Scratch, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in ascending order, and their counts."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["shingle", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts, held, seen = [], 0, set()
        for batch in batches:
            for shingles in shingle_sets((t.as_py() for t in batch.column(0)), words):
                if (mark := signature(shingles)) in seen:
                    continue
                seen.add(mark)
                parts.append(shingles)
                held += len(shingles)
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield counted(parts)

    counts = docs.select("text").mapInArrow(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = most_frequent(counts, "shingle", most, scratch)
    values = found["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["n"].to_numpy()[order]


def shared_need(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """c: how many short lists two linked sets share at least, if each keeps n - T + c of its lists."""
    return 1 + n - need(n, percent)


def describe_sets(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, sig (128 bits of the set), node (64 bits of it) and prefix: its lists that are
    not set aside.

    A set that a task met before has no prefix again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefix(s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keep = min(len(s), len(s) - need(len(s), percent) + shared_need(len(s), percent))
        short = s[lengths == 0]
        if len(short) >= keep:
            return short[:keep].view(np.int64)
        rest = np.flatnonzero(lengths)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        return np.concatenate([short, s[rest[: keep - len(short)]]]).view(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lists = Frequencies(*shared.value)
        seen: set[bytes] = set()
        for batch in batches:
            sizes, sigs, prefixes = [], [], []
            for s in shingle_sets((t.as_py() for t in batch.column(1)), words):
                sig = signature(s)
                sizes.append(len(s))
                sigs.append(sig)
                if not len(s) or sig in seen:
                    prefixes.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                prefixes.append(prefix(s, lists.of(s)))
            nodes = np.frombuffer(b"".join(sig[:8] for sig in sigs), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(nodes), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n_shingles", "sig", "node", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark().alias("mark")).mapInArrow(
        rows, "doc_id long, mark long, n_shingles long, sig binary, node long, prefix array<long>"
    )


def shared_lists(sets: DataFrame, percent: int, near: int = NEAR) -> DataFrame:
    """a, b, long, n, c. Of lists of up to near + 1 entries: sets a and b are on n of them together, and c is what two such
    sets share at least. Of longer ones (long is true): set a is on list b, and c is what a set shares with its least
    partner."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def found(token: np.ndarray, node: np.ndarray, n: np.ndarray, is_long: np.ndarray) -> pa.RecordBatch:
            least = shared_need(need(n[is_long], percent), percent)
            parts = [(node[is_long], token[is_long], np.ones(len(least), bool), least)]
            token, node, n = token[~is_long], node[~is_long], n[~is_long]
            for lag in range(1, near + 1):
                i = np.arange(lag, len(token))
                i = i[token[i] == token[i - lag]]
                if not len(i):
                    break
                j = i - lag
                ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                parts.append((node[j], node[i], np.zeros(len(i), bool), shared_need(np.minimum(n[i], n[j]), percent)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(4)], ["a", "b", "long", "c"])

        held, last, of_long = [np.zeros(0, np.int64)] * 3, None, None
        for batch in batches:
            columns = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            fresh = np.ones(len(columns[0]), bool)  # copies of a set that several tasks met are one entry
            fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            if len(fresh) and (columns[0][0], columns[1][0]) == last:
                fresh[0] = False
            token, node, n = (c[fresh] for c in columns)
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(first, len(token)))
            long = (sizes > near + 1) | (token[first] == of_long if of_long is not None else False)
            ends = len(token) if long[-1] else int(first[-1])  # what is not known to be long waits for the rest of its list
            held = [x[ends:] for x in (token, node, n)]
            if ends:
                last, of_long = (token[ends - 1], node[ends - 1]), token[-1] if long[-1] else None
                yield found(token[:ends], node[:ends], n[:ends], np.repeat(long, sizes)[:ends])
        if len(held[0]):
            yield found(*held, np.zeros(len(held[0]), bool))

    entries = sets.select(F.explode("prefix").alias("shingle"), "node", F.col("n_shingles").alias("n"))
    dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "node")
    met = dealt.mapInArrow(rows, "a long, b long, long boolean, c long")
    return met.groupBy("a", "b", "long").agg(F.count("*").alias("n"), F.max("c").alias("c"))


def candidates(sets: DataFrame, percent: int, scratch: Scratch, near: int = NEAR) -> DataFrame:
    """a, b: sets that share enough of their short lists, and sets that one of their long lists joins."""
    shared = scratch.keep(shared_lists(sets, percent, near), "shared")
    on_long = shared.where("long").select(F.col("a").alias("node"), F.col("b").alias("shingle"), "c")
    pairs = shared.where("not long").select("a", "b", "n", "c")
    lists = on_long.groupBy("shingle").agg(F.count("*").alias("length"))
    counts = scratch.keep(on_long.groupBy("node").agg(F.count("*").alias("lists"), F.max("c").alias("c")), "on-long-lists")
    # two sets may share as many long lists as each of them is on, so much less is enough of the short ones
    few = sent_if_small(counts.select("node", "lists"))
    less = (
        pairs.where("n < c")
        .join(few.select(F.col("node").alias("a"), F.col("lists").alias("lists_a")), "a")
        .join(few.select(F.col("node").alias("b"), F.col("lists").alias("lists_b")), "b")
        .where("n >= c - least(lists_a, lists_b)")
    )
    # only what long lists alone can bring up to the need is joined by them, and by no more than the shortest of them that
    # hold one in common with any partner
    most = sent_if_small(counts.where("lists >= c").select("node", "lists"))
    ranked = on_long.join(most, "node").join(lists, "shingle").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("length", "shingle")))
    held = scratch.keep(ranked.where("k <= lists - c + 1").select("node", "shingle"), "held-lists")
    first = held.groupBy("shingle").agg(F.min("node").alias("first"))
    joined = held.join(first, "shingle").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return pairs.where("n >= c").select("a", "b").unionByName(less.select("a", "b")).unionByName(joined)


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def divide_skip(sets: list[np.ndarray], percent: int, queries: np.ndarray | None = None) -> Groups:
    """Connect positions of linked sets; with queries (a mask), only pairs of a query and another set are looked at."""
    groups = Groups(len(sets))
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    entries, lengths = owner[order], np.bincount(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(n)
    for q in range(len(sets)) if queries is None else np.flatnonzero(queries):
        own = ids[ends[q] - n[q] : ends[q]]
        t = int(need(int(n[q]), percent))
        mine = own[lengths[own] > 1]
        if len(mine) < t:
            continue
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        longest = int(lengths[mine[-1]])
        aside = min(t - 1, int(t / (0.01 * math.log2(longest) + 1)))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        lists = [entries[starts[i] : starts[i + 1]] for i in short]
        counts = np.zeros(len(sets), np.int64)
        if sum(map(len, lists)) <= HEAPED:
            for x in heapq.merge(*(part.tolist() for part in lists)):
                counts[x] += 1
        else:
            counts += np.bincount(np.concatenate(lists), minlength=len(sets))
        counts[q] = 0
        if queries is None:
            counts[q:] = 0  # pairs with later sets are theirs to find
        else:
            counts[queries] = 0
        hits = np.flatnonzero((counts >= max(1, t - aside)) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q])))
        probes = np.sort(long)
        for c in hits.tolist():
            if groups.root(c) == groups.root(int(q)):
                continue
            theirs = ids[ends[c] - n[c] : ends[c]]
            at = np.minimum(np.searchsorted(theirs, probes), len(theirs) - 1)
            common = int(counts[c]) + int((theirs[at] == probes).sum())
            if 100 * common >= percent * (int(n[c]) + int(n[q]) - common):
                groups.join(c, int(q))
    return groups


def search(gathered: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the sets of each job (columns job, part, query, id, shingles; rows of a job together).

    Where a job has queries (query is true), only pairs of a query and another set are looked at.
    """

    def solved(rows: list[tuple[int, bool, bytes]]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        ids = [r[0] for r in rows]
        queries = np.array([r[1] for r in rows])
        groups = divide_skip([np.frombuffer(r[2], np.uint64) for r in rows], percent, queries if queries.any() else None)
        for k in range(len(ids)):
            if (root := groups.root(k)) != k:
                yield ids[root], ids[k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        job, held = None, []
        for batch in batches:
            links: list[tuple[int, int]] = []
            for of, part, query, i, shingles in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (of, part) != job:
                    links += solved(held)
                    job, held = (of, part), []
                held.append((i, query, shingles))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        links = list(solved(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    jobs = gathered.select("job", "part", "query", "id", "shingles").repartition("job", "part").sortWithinPartitions("job", "part")
    return jobs.mapInArrow(rows, "a long, b long")


def fetch_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """job, part and shingles of members (doc_id, node, job, part), with the node as id; of a doc_id's texts the one counts
    whose set is that node."""
    wanted = sent_if_small(members.select("doc_id", "node", "job", "part"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            text, node, job, part = (batch.column(k) for k in range(4))
            sets = list(shingle_sets((t.as_py() for t in text), words))
            same = pa.array([int.from_bytes(signature(s)[:8], "little", signed=True) == k for s, k in zip(sets, node.to_pylist(), strict=True)], pa.bool_())
            found = pa.RecordBatch.from_arrays([node, job, part, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "job", "part", "shingles"])
            yield found.filter(same)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(wanted, "doc_id").select("text", "node", "job", "part").mapInArrow(rows, "id long, job long, part long, shingles binary")


def fetch_nameless(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The same for sets that only rows without a doc_id have, by the mark of a text; of equal rows one is read."""
    wanted = sent_if_small(members.select("mark", "node", "job", "part"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets((t.as_py() for t in batch.column(3)), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["id", "job", "part", "shingles"])

    texts = docs.where("doc_id is null").select(text_mark().alias("mark"), "text")
    once = texts.join(wanted, "mark").groupBy("node", "job", "part").agg(F.min("text").alias("text"))
    return once.mapInArrow(rows, "id long, job long, part long, shingles binary")


def _rounds(hot: DataFrame, links: DataFrame, percent: int, scratch: Scratch, block: int) -> DataFrame:
    """The links between blocks of groups with several blocks. hot: id, job, part, n, shingles; links: those known."""
    ids = hot.select("id", "job", "n")
    done, r = scratch.keep(ids.select("id").limit(0), "done-0"), 0
    while True:
        r += 1
        labels = connected_components(links, scratch, f"round-{r}")
        state = ids.join(labels, "id", "left").select("id", "job", "n", F.coalesce("component", "id").alias("label"))
        sizes = state.groupBy("job", "label").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("job").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
        open_ = scratch.keep(state.join(largest, "job").where("label <> largest").join(done, "id", "left_anti").select("id", "job", "n"), f"open-{r}")
        if open_.isEmpty():
            return links
        shares = open_.groupBy("job").agg(F.ceil(F.sum("n") / block).alias("shares"))
        asked = scratch.keep(open_.join(shares, "job").where(F.pmod(F.xxhash64("id", F.lit(r)), F.col("shares")) == 0).select("id", "job"), f"asked-{r}")
        if asked.isEmpty():
            continue
        parts = hot.select("job", "part").distinct()
        # pairs of one part and those of sets that are done were looked at before
        questions = hot.join(asked.select("id"), "id", "left_semi").select("job", F.col("part").alias("own"), "id", "shingles", F.lit(True).alias("query"))
        questions = questions.join(parts, "job").where("own <> part").drop("own")
        rest = hot.join(asked.select("job").distinct(), "job", "left_semi").join(done, "id", "left_anti")
        gathered = questions.unionByName(rest.select("job", "part", "id", "shingles", F.lit(False).alias("query")))
        found = scratch.keep(search(gathered, percent), f"found-{r}")
        links = scratch.keep(links.unionByName(found).distinct(), f"linked-{r}")
        done = scratch.keep(done.unionByName(asked.select("id")), f"done-{r}")


def labelled(docs: DataFrame, words: int, percent: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """doc_id, mark (of the text), n_shingles and component_id of every row."""
    ship(docs.sparkSession)
    sets = scratch.keep(describe_sets(docs, words, percent, frequent_shingles(docs, words, scratch)), "sets")
    groups = connected_components(candidates(sets.where("prefix is not null"), percent, scratch), scratch, "candidates")
    groups = groups.select(F.col("id").alias("node"), F.col("component").alias("job"))
    firsts = sets.where("n_shingles > 0").groupBy("sig", "node", "n_shingles").agg(F.min("doc_id").alias("id"), F.min(F.when(F.col("doc_id").isNull(), F.col("mark"))).alias("mark"))
    firsts = scratch.keep(firsts, "firsts")
    members = scratch.keep(firsts.select(F.col("id").alias("doc_id"), "mark", "node", F.col("n_shingles").alias("n")).join(groups, "node"), "members")
    sizes = members.groupBy("job").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    placed = members.join(sizes, "job").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = scratch.keep(placed, "placed")
    gathered = fetch_sets(docs, placed.where("doc_id is not null"), words)
    nameless = placed.where("doc_id is null")
    if not nameless.isEmpty():
        gathered = gathered.unionByName(fetch_nameless(docs, nameless, words))
    large = not placed.where("blocks > 1").isEmpty()
    if large:
        gathered = scratch.keep(gathered, "gathered")
    links = scratch.keep(search(gathered.withColumn("query", F.lit(False)), percent), "links")
    if large:
        hot = gathered.join(placed.where("blocks > 1").select(F.col("node").alias("id"), "n"), "id")
        links = _rounds(hot, links, percent, scratch, block)
    labels = connected_components(links, scratch, "linked").select(F.col("id").alias("node"), "component")
    classes = scratch.keep(firsts.join(labels, "node", "left").select("sig", "id", "component"), "classes")
    least = classes.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    classes = classes.join(least, "component", "left").select("sig", F.coalesce("least", "id").alias("component_id"))
    return sets.select("doc_id", "mark", "n_shingles", "sig").join(classes, "sig", "left").select(
        "doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    return labelled(docs, words, percent, scratch or Scratch(docs.sparkSession), block).drop("mark")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies, the one with the least doc_id."""
    scratch = scratch or Scratch(docs.sparkSession)
    groups = labelled(docs, words, percent, scratch)
    return without_rows(docs, groups.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))), scratch)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
