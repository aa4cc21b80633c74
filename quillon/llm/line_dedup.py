"""Line dedup (operator 1): an exact set-similarity join of lines.

A line is what stands between line feeds; its tokens are its distinct words after lower-casing A-Z. A line is removed when
an earlier one, by (doc_id, text, position), has a Jaccard similarity of PERCENT / 100 or more with it, whether that one
stays or not. The first line of each kind stays. Lines without words stay.

1. Rarity. Words are counted in blocks by the tasks; the MOST_FREQUENT of the sums get their places in an order, known
   to all tasks, and all other words count as rarer. Any order gives the same result, and the bound makes the broadcast
   safe.
2. Lines of equal token sets are one class, whose first line matters; this ends most repeats.
3. Prefixes. A class lists its n - ceil(n * PERCENT / 100) + 1 rarest tokens. Entries are dealt by 36 bits of the token
   (tokens that share them are one list, which adds candidates and loses none), and a list is sorted by n, so that the
   length filter leaves an entry a run of entries before it. Of those, the positional filter (a pair is found on the list of its
   first common token, so all that is common stands there or behind) and a parity map of all tokens (which differs in no
   more bits than the sets differ in tokens; 64 bits of sets up to FOLDED, 128 of larger ones) leave candidates. An entry
   is compared with LAGS entries before it, and the NEAREST candidates by their maps become pairs; entries that are part of
   any other candidate, or whose run is longer, are marked as open.
4. Verification. The token sets of the pairs are fetched by the position of their first line, and compared; of a pair that
   is similar the later class is removed.
5. Open entries are taken up again only on lists where a class that is not removed yet has an earlier open one. Such a
   list is a job, or a job for each two blocks of BLOCK of its entries, that has the token sets: each class still in
   question counts the tokens that it shares with all earlier ones of the block, on inverted lists. A job gives
   one row for each class that it removes. So pairs of a group of near copies never become rows, and none is missed.

Defined results. A null or empty text has no lines of words. Rows that repeat a doc_id and text are the same document and
get the same result; rows that repeat a doc_id with other texts are documents of their own, in the order of a hash of
the text. Rows without a doc_id come after all rows with one, in the order of a hash of the text; those with one text are the same
document. An empty table gives an empty result. Columns other than
doc_id and text are ignored, or carried along by drop_similar_lines, whatever their names. Memory of a task follows the
longest text, and the blocks above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import release
from quillon.llm.shared import SENT_IDS, Scratch, most_frequent, sent_if_small, ship, table, text_mark
from quillon.llm.shingles import CHUNK, Frequencies, chunks, lowered, mixed, words_of

PERCENT = 80
#: Words with a place in the order, at most: 16 bytes each.
MOST_FREQUENT = 1 << 18
#: Words that a task counts together; lines handled at once (2^12); classes that a task remembers, to list each once.
COUNTED, LINES, SEEN = 1 << 21, 4096, 150_000
#: Entries of a list that each entry is compared with, and candidates of those that become pairs.
LAGS, NEAREST = 96, 2
#: Tokens up to which a parity map has 64 bits.
FOLDED = 72
#: Entries of a list that are one block of a job.
BLOCK = 4096


#: The rank of rows without a doc_id.
LAST = (1 << 63) - 1


def ranked(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def frequent_words(docs: DataFrame, scratch: Scratch, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words in ascending order, and their places (1: the rarest of them)."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], ["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts, held = [], 0
        for batch in batches:
            for texts in chunks(t.as_py() for t in batch.column(0)):
                parts.append(words_of(b"\n".join(texts))[0])
                held += len(parts[-1])
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    counts = docs.select("text").mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = most_frequent(counts.where("n > 2"), "word", most, scratch)
    values = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    place = np.lexsort((values, found["n"].to_numpy()))
    places = np.empty(len(values), np.int64)
    places[place] = np.arange(1, len(values) + 1)
    order = np.argsort(values)
    return values[order], places[order]


def coded(words: np.ndarray, order: Frequencies) -> np.ndarray:
    """Codes that ascend from rare to frequent words: 51 bits of a rare word's hash, or the highest bit and a place."""
    place = order.of(words)
    return np.where(place > 0, np.uint64(1 << 51) | place.astype(np.uint64), words >> np.uint64(13))


def distinct(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return sorted_[new]


def sets_of(words: np.ndarray, at: np.ndarray, lines: int, order: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each of 2^12 lines at most (at: a word's line), in ascending order: their lines and codes, and
    each line's number of codes and its start."""
    codes = distinct(np.sort(coded(words, order) | at.astype(np.uint64) << np.uint64(52)))
    at, token = (codes >> np.uint64(52)).astype(np.int64), codes & np.uint64((1 << 52) - 1)
    n = np.bincount(at, minlength=lines)
    return at, token, n, np.cumsum(n) - n


def packed(words: np.ndarray, order: Frequencies) -> bytes:
    """A set of word hashes: frequent words by their places, in four bytes each, and the hashes of all others."""
    place = order.of(words)
    places = np.sort(place[place > 0]).astype(np.uint32)
    return np.uint32(len(places)).tobytes() + places.tobytes() + np.sort(words[place == 0]).tobytes()


def packed_lines(lines: list[bytes], order: Frequencies) -> tuple[np.ndarray, list[bytes]]:
    """Of 2^12 lines at most: the first half of each one's class (0 for a line without words), and its packed set of words."""
    words, places = words_of(b"\n".join(lines))
    at = np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), places, side="right")
    _, token, n, starts = sets_of(words, at, len(lines), order)
    node, some = np.zeros(len(lines), np.int64), n > 0
    if some.any():
        node[some] = class_of(token, starts[some])[0]
    ends = np.searchsorted(at, np.arange(len(lines)), side="right").tolist()
    return node, [packed(distinct(np.sort(words[a:b])), order) for a, b in zip([0, *ends], ends, strict=False)]


def unpacked(data: bytes) -> np.ndarray:
    """Different numbers for different words; no hash is as small as a place."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.concatenate([np.frombuffer(data, np.uint32, n, 4).astype(np.uint64), np.frombuffer(data[4 + 4 * n :], np.uint64)])


def class_of(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of codes."""
    hi, lo = (np.add.reduceat(mixed(tokens, salt), starts).view(np.int64) for salt in (1, 2))
    return hi, lo


def describe_lines(docs: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each line with words: doc_id, mark (of the text), line, hi and lo (the class), prefix (rarest
    tokens as keys of lists, or null where the task met the class before), even and odd (the parity map: how many tokens have each bit,
    modulo 2; of up to FOLDED tokens both halves are folded into even)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def described(doc: np.ndarray, mark: np.ndarray, line: np.ndarray, at: np.ndarray, words: np.ndarray, order: Frequencies, seen: set) -> pa.RecordBatch:
        at, token, n, starts = sets_of(words, at, len(doc), order)
        hi, lo = class_of(token, starts)
        bit = mixed(token, 3) >> np.uint64(57)  # 0 to 127
        one = np.uint64(1) << (bit & np.uint64(63))
        folded = np.bitwise_xor.reduceat(one, starts).view(np.int64)
        odd = np.bitwise_xor.reduceat(np.where(bit >= 64, one, np.uint64(0)), starts).view(np.int64)
        odd[n <= FOLDED] = 0
        keep = np.minimum(_prefix(n, percent), n)
        met = np.zeros(len(doc), bool)
        for k, key in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
            if key in seen:
                met[k] = True
            elif len(seen) < SEEN:
                seen.add(key)
        keep[met] = 0
        own = np.arange(len(token)) - starts[at] < keep[at]
        listed = (mixed(token[own], 4) >> np.uint64(N_BITS) << np.uint64(N_BITS)).view(np.int64) | n[at[own]]
        ends = pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(listed), mask=pa.array(met))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(mark), pa.array(line, pa.int32()), pa.array(hi), pa.array(lo), lists, pa.array(folded ^ odd), pa.array(odd)],
            ["doc_id", "mark", "line", "hi", "lo", "prefix", "even", "odd"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order, seen = Frequencies(*shared.value), set()
        for batch in batches:
            ids, marks, done = batch.column(0).to_numpy(), batch.column(2).to_numpy(), 0
            for texts in chunks(t.as_py() for t in batch.column(1)):
                data = b"\n".join(texts)
                words, places = words_of(data)
                feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
                of_line = np.searchsorted(feeds, places)  # the number of the line in the chunk
                begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
                first_line = np.searchsorted(feeds, begins)  # of each document
                lines, at = np.unique(of_line, return_inverse=True)
                owner = np.searchsorted(first_line, lines, side="right") - 1
                for a in range(0, len(lines), LINES):
                    b = min(a + LINES, len(lines))
                    w = slice(*np.searchsorted(at, [a, b]))
                    own = done + owner[a:b]
                    yield described(ids[own], marks[own], lines[a:b] - first_line[owner[a:b]], at[w] - a, words[w], order, seen)
                done += len(texts)

    return docs.select(ranked().alias("doc_id"), "text", text_mark().alias("mark")).mapInArrow(
        rows, "doc_id long, mark long, line int, hi long, lo long, prefix array<long>, even long, odd long"
    )


#: Bits of n in the key of an entry, behind those of its token: one number to sort by.
N_BITS = 28


def list_entries(lines: DataFrame) -> DataFrame:
    """key, node, at (the place in the prefix), even and odd of the entries, dealt by token and sorted by key."""
    entries = lines.where("prefix is not null").select(F.posexplode("prefix").alias("at", "key"), F.col("hi").alias("node"), "even", "odd")
    return entries.select("key", "node", "at", "even", "odd").repartition(F.shiftrightunsigned("key", N_BITS)).sortWithinPartitions("key")


def list_pairs(entries: DataFrame, percent: int, lags: int, nearest: int) -> DataFrame:
    """From list_entries(): pairs of nodes as a, b with is_open false; open entries as a: node, b: token."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 5
        was_open = np.zeros(0, bool)
        for batch in batches:
            new = [c.to_numpy().astype(np.int64) for c in batch.columns]
            key, node, at, even, odd = (np.concatenate([t, c]) for t, c in zip(tail, new, strict=True))
            token, n = key >> N_BITS, key & ((1 << N_BITS) - 1)
            fresh = len(token) - len(new[0])
            is_open = np.concatenate([was_open, np.zeros(len(new[0]), bool)])
            a, b, gap = [], [], []

            def runs(i: np.ndarray, lag: int, token=token, n=n) -> np.ndarray:
                return i[(token[i] == token[i - lag]) & (100 * n[i - lag] >= percent * n[i])]

            i = np.arange(fresh, len(token))
            for lag in range(1, lags + 1):
                i = runs(i[i >= lag], lag)  # what ends a run ends it for greater lags too
                if not len(i):
                    break
                j = i - lag
                both = n[i] + n[j]
                overlap = -(-percent * both // (100 + percent))
                ok = np.flatnonzero((node[i] != node[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= overlap))
                p, q, both, most = i[ok], j[ok], both[ok], (both - 2 * overlap)[ok]
                x, y = even[p] ^ even[q], odd[p] ^ odd[q]
                uneven = (n[p] <= FOLDED) != (n[q] <= FOLDED)  # of these the larger set's map is folded too
                x[uneven] ^= y[uneven]
                y[uneven] = 0
                apart = np.bitwise_count(x.view(np.uint64)).astype(np.int64) + np.bitwise_count(y.view(np.uint64))
                ok = apart <= most
                a.append(p[ok])
                b.append(q[ok])
                gap.append((apart[ok] + 1.0) / both[ok])
            if len(i):  # a run goes on: the entry, and all that are further back on its list
                i = runs(i[i > lags], lags + 1)
                is_open[i] = True
                is_open[i - lags - 1] = True
            a, b, gap = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, gap))
            order = np.lexsort((gap, a))
            a, b = a[order], b[order]
            turn = np.arange(len(a)) - np.searchsorted(a, a)
            rest = turn >= nearest
            is_open[a[rest]] = True
            is_open[b[rest]] = True
            a, b = a[~rest], b[~rest]
            # entries that later ones may still open wait for the next batch
            done = max(0, len(token) - lags - 1)
            old = np.flatnonzero(is_open[:done])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([False, True], [len(a), len(old)])), pa.array(np.concatenate([node[a], node[old]])), pa.array(np.concatenate([node[b], token[old]]))],
                ["is_open", "a", "b"],
            )
            tail, was_open = [x[done:] for x in (key, node, at, even, odd)], is_open[done:]
        old = np.flatnonzero(was_open)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(old), bool)), pa.array(tail[1][old]), pa.array(tail[0][old] >> N_BITS)], ["is_open", "a", "b"])

    return entries.mapInArrow(rows, "is_open boolean, a long, b long")


def fetch_tokens(docs: DataFrame, wanted: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node and tokens (packed) of the lines (first: doc_id, mark and line; node)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    by_doc = wanted.groupBy("first.doc_id", "first.mark").agg(F.collect_list(F.struct("first.line", "node")).alias("lines"))
    if wanted.count() <= SENT_IDS:  # else texts are shuffled to them
        by_doc = F.broadcast(by_doc)
    held = docs.select(ranked().alias("doc_id"), text_mark().alias("mark"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = Frequencies(*shared.value)

        def ready(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            found, tokens = packed_lines([line for _, line in held], order) if held else ((), ())
            good = [(node, t) for (node, line), own, t in zip(held, found, tokens, strict=True) if node == own and line]
            nodes, tokens = zip(*good, strict=True) if good else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])

        for batch in batches:
            held, size = [], 0
            for text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = lowered(text).split(b"\n")
                for x in lines:
                    if x["line"] < len(found):
                        held.append((x["node"], found[x["line"]]))
                        size += len(held[-1][1])
                    if len(held) == LINES or size >= CHUNK:
                        yield ready(held)
                        held, size = [], 0
            yield ready(held)

    # equal rows give a node more than once
    return held.join(by_doc, ["doc_id", "mark"]).select("text", "lines").mapInArrow(rows, "node long, tokens binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token sets are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = unpacked(x), unpacked(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def later_of_block(sets: list[np.ndarray], asks: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Which of those that ask have a similar set of a lower rank."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    entries, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    ends, found = np.cumsum(n), np.zeros(len(sets), bool)
    for q in np.flatnonzero(asks).tolist():
        own = ids[ends[q] - n[q] : ends[q]]
        both = np.bincount(np.concatenate([entries[starts[i] : starts[i + 1]] for i in own]), minlength=len(sets))
        found[q] = ((100 * both >= percent * (n + n[q] - both)) & (rank < rank[q])).any()
    return found


def search_lists(jobs: DataFrame, percent: int) -> DataFrame:
    """The nodes that a similar and earlier class of their job removes. jobs: token, ask_block, block, asks, node, first, tokens."""

    def solved(held: list[tuple]) -> list[int]:
        unique = {}
        for asks, node, first, tokens in held:
            had = unique.get(node)
            unique[node] = (asks or had is not None and had[0], first, tokens)
        rank = {first: k for k, first in enumerate(sorted(first for _, first, _ in unique.values()))}
        found = later_of_block(
            [unpacked(tokens) for _, _, tokens in unique.values()],
            np.array([asks for asks, _, _ in unique.values()]),
            np.array([rank[first] for _, first, _ in unique.values()]),
            percent,
        )
        return [node for node, is_found in zip(unique, found.tolist(), strict=True) if is_found]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        job, held = None, []
        for batch in batches:
            out: list[int] = []
            columns = [c.to_pylist() for c in batch.columns]
            for token, ask_block, block, asks, node, doc, mark, line, tokens in zip(*columns, strict=True):
                if (token, ask_block, block) != job:
                    out += solved(held) if held else []
                    job, held = (token, ask_block, block), []
                held.append((asks, node, (doc, mark, line), tokens))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])
        yield pa.RecordBatch.from_arrays([pa.array(solved(held) if held else [], pa.int64())], ["node"])

    key = ["token", "ask_block", "block"]
    dealt = jobs.select(*key, "asks", "node", "first.doc_id", "first.mark", "first.line", "tokens").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(rows, "node long")


def open_jobs(open_: DataFrame, classes: DataFrame, removed: DataFrame, block: int, scratch: Scratch) -> DataFrame | None:
    """token, ask_block, block, asks, node and first of the entries that are left to compare; None if there are none.

    An entry asks if its class is not removed yet and a class of the same list is earlier.
    """
    settled = removed.select("node", F.lit(True).alias("settled"))
    held = open_.join(classes.select("node", "first"), "node").join(settled, "node", "left")
    held = scratch.keep(held.select("token", "node", "first", F.col("settled").isNull().alias("asks")), "open")
    spans = held.groupBy("token").agg(F.min("first").alias("begin"), F.max(F.when(F.col("asks"), F.col("first"))).alias("end"), F.count("*").alias("size"))
    lists = scratch.keep(spans.where("end > begin").select("token", "begin", "end", F.ceil(F.col("size") / block).cast("long").alias("blocks")), "open-lists")
    if lists.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    left = held.join(sent_if_small(lists), "token").where("first <= end").withColumn("asks", F.col("asks") & (F.col("first") > F.col("begin"))).withColumn("own", own)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # as one that asks to every block, as one that answers to every block of those that ask
    roles = F.when(~F.col("asks"), F.array(F.lit(False))).when(F.col("blocks") == 1, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    sent = left.select("token", "node", "first", "own", "blocks", F.explode(roles).alias("asks")).withColumn("other", F.explode(every))
    ask_block, answer_block = (F.when(F.col("asks") == role, F.col("own")).otherwise(F.col("other")) for role in (True, False))
    return sent.select("token", ask_block.alias("ask_block"), answer_block.alias("block"), "asks", "node", "first")


def similar_lines(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None, lags: int = LAGS, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """doc_id, mark (of the text) and line of every line that is removed."""
    spark = ship(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    frequent = frequent_words(docs, scratch)
    lines = scratch.keep(describe_lines(docs, percent, frequent), "lines")
    first = lines.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "mark", "line")).alias("first"), F.count("*").alias("lines"))
    classes = scratch.keep(first.select(F.col("hi").alias("node"), "lo", "first", "lines"), "classes")
    listed = scratch.keep(list_pairs(list_entries(lines), percent, lags, nearest), "listed")

    pairs = scratch.keep(listed.where("not is_open").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    open_ = scratch.keep(listed.where("is_open").select(F.col("a").alias("node"), F.col("b").alias("token")).distinct(), "open-entries")
    # all other classes are read once more only where they repeat
    near = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(True).alias("near"))
    nodes = near.unionByName(open_.select("node", F.lit(False).alias("near"))).groupBy("node").agg(F.max("near").alias("near"))
    met = scratch.keep(classes.join(nodes, "node"), "met")
    wanted = met.where("near").select("node", "first")
    tokens = scratch.keep(fetch_tokens(docs, wanted, frequent), "near-tokens")
    ends = [wanted.select(F.col("node").alias(k), F.col("first").alias(f"first_{k}")) for k in ("a", "b")]
    placed = verified(pairs, tokens, percent).join(ends[0], "a").join(ends[1], "b")
    removed = scratch.keep(placed.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("node")).distinct(), "near-removed")
    scratch.drop("near-tokens")
    if (jobs := open_jobs(open_, met, removed, block, scratch)) is not None:
        jobs = scratch.keep(jobs, "jobs")
        wanted = scratch.keep(jobs.select("node", "first").distinct(), "open-wanted")
        tokens = scratch.keep(fetch_tokens(docs, wanted, frequent), "open-tokens")
        more = search_lists(jobs.join(tokens, "node"), percent)
        removed = scratch.keep(removed.unionByName(more).distinct(), "removed")
    # classes that lose lines: those that are removed, and the others that have more lines than their first
    similar = met.join(removed, "node", "left_semi").select("node", "lo", "first", F.lit(True).alias("similar"))
    repeated = classes.where("lines > 1").join(removed, "node", "left_anti").select("node", "lo", "first", F.lit(False).alias("similar"))
    losing = scratch.keep(similar.unionByName(repeated), "losing")
    held = lines.select("doc_id", "mark", "line", F.col("hi").alias("node"), "lo").join(sent_if_small(losing), ["node", "lo"])
    return held.where(F.col("similar") | (F.struct("doc_id", "mark", "line") != F.col("first"))).select("doc_id", "mark", "line")


def _gone(docs: DataFrame, percent: int, **parameters) -> DataFrame:
    """of (doc_id and mark) and removed (positions) of the documents that lose lines."""
    lines = similar_lines(docs.select("doc_id", "text"), percent, **parameters)
    return lines.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("removed")).select(F.struct("doc_id", "mark").alias("of"), "removed")


def removed_lines(docs: DataFrame, percent: int = PERCENT, **parameters) -> DataFrame:
    """doc_id, n_removed and removed (positions of the lines, from 0) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"))
    found = rows.join(_gone(docs, percent, **parameters), (ranked() == F.col("of.doc_id")) & (F.col("mark") == F.col("of.mark")), "left")
    return found.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_similar_lines(docs: DataFrame, percent: int = PERCENT, **parameters) -> DataFrame:
    """docs with the removed lines cut from text; all other columns stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = (ranked("row.doc_id") == F.col("of.doc_id")) & (text_mark("row.text") == F.col("of.mark"))
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda _, k: ~F.array_contains("removed", k)), "\n")
    text = F.when(F.col("removed").isNotNull(), kept).otherwise(F.col("row.text")).alias("text")
    found = rows.join(_gone(docs, percent, **parameters), same, "left")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(table(spark, sf_dir, "documents"))
