"""Toxicity (operator 3): class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary text, predict each letter of a word from up to ORDER - 1 before it. They are
interpolated Kneser-Ney models: the longest contexts (and n-grams that begin a word, which nothing comes before) use the
counts of their class, the others the number of different letters before an n-gram in their class, and the shortest ones
(up to order SHARED) are shared: they add up both classes, so an expression that one class has never shown falls back to
the same probability in both. No n-gram is left out.

A text is scored by comparing its length-normalised log-likelihoods in both models: the difference for each word is the sum
over its letters, and what is compared is the mean over all words, and the highest mean over WINDOWS neighbouring words,
as a few words decide in a long text. The share of words with a difference of STRONG or more is added, since a difference
that comes from many such words says more than an equal one from a single rare word. A logistic function of these four,
fitted on labelled rows that gave no counts, makes the score.

Learning. Only labelled rows outside fold 2 are used: folds 0 and 1 for counts, 3 for the fit. Both are bounded samples by
a hash of the id, of about MAX_TOXIC and MAX_ORDINARY documents for counts and a quarter of each for the fit. Texts are
learned from as a whole; where the sample has more than MAX_LETTERS letters, as measured, fewer rows are taken, again by a hash.
Words and n-grams are counted by Spark; what reaches the driver is the table of distinct n-grams of the sample as numbers,
one order at a time, which MAX_LETTERS limits, and that is broadcast.

Scoring is a map over whole texts, without a shuffle. Words are numbered over many texts at once, and the n-grams of the
distinct ones looked up in sorted arrays. Labels, language, source and doc_id are never inputs of a score.

Defined results: a null or empty text, like one of white space, is scored from ratios of 0. Where no label of either
class can be learned from, each score is 0. Rows that repeat get equal scores, and each a row; a null doc_id stays null
and is never learned from; labels that repeat a doc_id count once (as toxic, if one of them says so), null ones not at all.
An empty table gives an empty result, and columns other than doc_id and text are ignored, whatever their names. A run
without white space is read as words of 40 letters; memory of a task follows the longest text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import held, release
from quillon.llm.shared import Scratch, fold_of, ship, table, text_or_empty
from quillon.llm.shingles import mixed
from quillon.llm.words import WORDS, numbered, word_lists

#: Documents of each class that counts are taken from (about: the sample is by hash), and letters of all of them, at most.
MAX_TOXIC, MAX_ORDINARY, MAX_LETTERS = 4000, 8000, 1 << 27
ORDER, SHARED = 6, 2
DISCOUNT = 0.9
WINDOWS = (4, 16)
#: A log-ratio from which a word counts as a toxic expression.
STRONG = 4.0
THRESHOLD = 0.3
#: What a text is compared by: the mean, the windows and the share.
FEATURES = 2 + len(WINDOWS)
#: What stands before and behind a word; no word has white space.
START, END = "\n", " "
#: Letters whose n-grams are looked up together.
TOGETHER = 1 << 16


def sample_ids(labels: DataFrame) -> DataFrame:
    """id, toxic and fits of the labels that are learned from: a sample by the hash of the id, which is bounded.

    fits: the row is for fitting the logistic function (fold 3), not for counts (folds 0 and 1).
    """
    toxic = labels.where(F.col("toxic").cast("int").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of() != 2))
    rows = toxic.groupBy(F.col("doc_id").alias("id"), (fold_of() == 3).alias("fits")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw, keep = F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.lit(False)
    for r in rows.groupBy("fits", "toxic").agg(F.count("*").alias("n")).collect():  # four rows at most
        wanted = (MAX_TOXIC if r["toxic"] else MAX_ORDINARY) // (4 if r["fits"] else 1)
        of = (F.col("fits") == r["fits"]) & (F.col("toxic") == r["toxic"])
        keep = keep | of & (draw < int(1_000_000 * min(1.0, wanted / r["n"])))
    return rows.where(keep)


def thinned(sample: DataFrame, most: int = MAX_LETTERS) -> DataFrame:
    """Of a stored sample (id, text, toxic, fits) so many rows, whole, that they have about `most` letters; all if they are fewer."""
    letters = sample.where("not fits").agg(F.sum(F.length("text"))).first()[0] or 0
    if letters <= most:
        return sample
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000_000))
    return sample.where(F.col("fits") | (draw < int(1_000_000_000 * most / letters)))


def word_counts(sample: DataFrame) -> DataFrame:
    """word, t and o: how often each word occurs in toxic and in ordinary rows."""

    def counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
        t, o = (pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), t, o], ["word", "t", "o"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for words in word_lists(text.as_py()):
                    for word in words:
                        counts.setdefault(word, [0, 0])[toxic] += 1
                    if len(counts) >= WORDS:
                        yield counted(counts)
                        counts = {}
        yield counted(counts)

    found = sample.select("text", "toxic").mapInArrow(rows, "word string, t long, o long")
    return found.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def ngram_counts(words: DataFrame) -> DataFrame:
    """ngram, t and o: occurrences in each class of the n-grams of orders 1 to ORDER, within words.

    A word has one mark before it, which only contexts have, and one behind it, which is predicted like a letter.
    """
    padded = F.concat(F.lit(START), F.col("word"), F.lit(END))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.length(padded)),
            lambda end: F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER), end)), lambda n: F.substring(padded, end - n + F.lit(1), n)),
        )
    )
    return words.select("t", "o", F.explode(spans).alias("ngram")).groupBy("ngram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def keys_of(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of words with marks, one behind another: 64-bit keys of the n-grams that end at each place, for n from 0 to ORDER; and
    the length of the longest one there, which ends where its word begins."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((START + (END + START).join(words) + END).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    room = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sums, letters = [np.zeros(len(codes), np.uint64)], mixed(codes + np.uint64(1), 5)
    for _ in range(ORDER):
        before = np.concatenate([[np.uint64(0)], sums[-1][:-1]])
        sums.append(before * np.uint64(0x9E3779B97F4A7C15) + letters)
    return [mixed(h, n + 1) for n, h in enumerate(sums)], room


def keyed_ngrams(counts: DataFrame) -> DataFrame:
    """n, key, context (its key), suffix, begins (a word) and t, o of each n-gram."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            # read as words without their marks, so each n-gram ends one place before its word does
            keys, _ = keys_of(names)
            ends = np.cumsum(sizes + 2) - 2
            own, context, suffix = (np.zeros(len(names), np.uint64) for _ in range(3))
            for n in range(1, ORDER + 1):
                of = np.flatnonzero(sizes == n)
                own[of], context[of], suffix[of] = keys[n][ends[of]], keys[n - 1][ends[of] - 1], keys[n - 1][ends[of]]
            begins = [name[0] == START for name in names]
            numbers = (pa.array(x.view(np.int64)) for x in (own, context, suffix))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), *numbers, pa.array(begins, pa.bool_()), batch.column(1), batch.column(2)],
                ["n", "key", "context", "suffix", "begins", "t", "o"],
            )

    return counts.select("ngram", "t", "o").mapInArrow(rows, "n long, key long, context long, suffix long, begins boolean, t long, o long")


class Order:
    """The n-grams of one order, by ascending key."""

    def __init__(self, rows: pa.Table) -> None:
        key, context, suffix = (rows[c].to_numpy().view(np.uint64) for c in ("key", "context", "suffix"))
        order = np.argsort(key)
        self.key, self.context, self.suffix = key[order], context[order], suffix[order]
        self.begins = rows["begins"].to_numpy()[order]
        self.counts = np.column_stack([rows[c].to_numpy()[order] for c in ("t", "o")])

    def at(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, keys)


def ratio_tables(order_of: Callable[[int], Order]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both models as one table: the keys of n-grams with the log-ratio of their probabilities (toxic to ordinary), and of
    contexts with the log-ratio of their weights for going back; keys ascend."""
    keys, ratios, contexts, backs = [], [], [], []
    now, lower, lower_p = order_of(1), None, np.full((1, 2), 1.0)
    for k in range(1, ORDER + 1):
        use, longer = now.counts.astype(float), None
        if k < ORDER:
            longer = order_of(k + 1)
            before = np.zeros_like(use)
            np.add.at(before, now.at(longer.suffix), longer.counts > 0)
            use = np.where(now.begins[:, None], use, before)
        if k <= SHARED:
            use = np.repeat(use.sum(1, keepdims=True), 2, axis=1)
        names, context = np.unique(now.context, return_inverse=True)
        total, kinds = (np.column_stack([np.bincount(context, x[:, c], len(names)) for c in (0, 1)]) for x in (use, use > 0))
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        below = lower_p[lower.at(now.suffix)] if lower is not None else lower_p / max(1, len(now.key))
        p = np.maximum(use - DISCOUNT, 0) / np.maximum(total[context], 1) + weight[context] * below
        keys.append(now.key)
        ratios.append(np.log(p[:, 0] / p[:, 1]).astype(np.float32))
        contexts.append(names)
        backs.append(np.log(weight[:, 0] / weight[:, 1]).astype(np.float32))
        now, lower, lower_p = longer, now, p
    out: list[np.ndarray] = []
    for names, values in ((keys, ratios), (contexts, backs)):
        order = np.argsort(names := np.concatenate(names))
        out += names[order], np.concatenate(values)[order]
    return tuple(out)


class Lookup:
    """Values of ascending 64-bit keys. Keys are hashes, so their leading bits say nearly where one is."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        bits = max(4, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0 for none), and whether it has one."""
        slot = (keys >> self.shift).astype(np.int64)
        at, last = self.begins[slot], self.begins[slot + 1]
        values, known, todo = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool), np.flatnonzero(at < last)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == keys[todo]
            values[todo[hit]], known[todo[hit]] = self.values[here[hit]], True
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < last[todo]]
        return values, known


class Ratios:
    """Log-ratios of words and texts, from ratio tables."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, contexts: np.ndarray, backs: np.ndarray) -> None:
        self.ngrams, self.contexts = Lookup(keys, ratios), Lookup(contexts, backs)

    def words(self, words: list[str]) -> np.ndarray:
        out, at, size = np.zeros(len(words)), 0, 0
        for k, word in enumerate(words):
            size += len(word) + 2
            if size >= TOGETHER or k + 1 == len(words):
                out[at : k + 1] = self._words(words[at : k + 1])
                at, size = k + 1, 0
        return out

    def _words(self, words: list[str]) -> np.ndarray:
        keys, room = keys_of(words)
        total, todo = np.zeros(len(room)), np.flatnonzero(room > 1)  # nothing predicts the mark before a word
        for n in range(ORDER, 0, -1):
            fits = todo[room[todo] >= n]
            value, known = self.ngrams.of(keys[n][fits])
            total[fits] += value
            back = fits[~known]
            total[back] += self.contexts.of(keys[n - 1][back - 1])[0]
            todo = np.concatenate([todo[room[todo] < n], back])
        begins = np.flatnonzero(room == 1)
        return np.add.reduceat(total, begins)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text the mean ratio of its words, the highest means of windows and the share of strong words; 0 without words."""
        out, parts = np.zeros((len(texts), FEATURES)), []

        def ended(k: int) -> None:
            if parts:
                r = parts[0] if len(parts) == 1 else np.concatenate(parts)
                parts.clear()
                sums = np.concatenate([[0.0], np.cumsum(r)])
                highest = (float((sums[w:] - sums[:-w]).max() / w) if len(r) > w else sums[-1] / w for w in WINDOWS)
                out[k] = [sums[-1] / len(r), *highest, math.log1p(100.0 * float((r >= STRONG).mean()))]

        last = -1
        for words, numbers, of, sizes in numbered(text or "" for text in texts):
            r, at = self.words(words)[numbers], 0
            for k, size in zip(of, sizes, strict=True):
                if k != last:
                    ended(last)
                    last = k
                parts.append(r[at : at + size])
                at += size
        ended(last)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the offset) by Newton steps, on standardised columns; their means and deviations."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) ** 0.5 * np.diag([1.0] * (len(w) - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, deviation


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> dict | None:
    """The tables and the logistic function; None where one class has no rows to learn from."""
    ship(docs.sparkSession)
    # the ids of the sample are bounded, so they go to all tasks and no text is shuffled
    ids = scratch.keep(sample_ids(labels), "ids")
    texts = docs.select(F.col("doc_id").alias("__id"), text_or_empty().alias("text"))
    sample = scratch.keep(texts.join(F.broadcast(ids), F.col("__id") == F.col("id")).select("id", "text", "toxic", "fits"), "sample")
    sample = thinned(sample)
    grams = scratch.keep(keyed_ngrams(ngram_counts(word_counts(sample.where("not fits")))), "grams")
    seen = grams.where("n = 1").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not seen["t"] or not seen["o"]:
        return None
    tables = ratio_tables(lambda k: Order(grams.where(F.col("n") == k).toArrow()))  # bounded by the sample
    scratch.drop("grams")
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tables))
    del tables

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = ratios_of(model)
        for batch in batches:
            found = ratios.features(batch.column(0).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    fits = sample.where("fits").select("text", "toxic").mapInArrow(rows_of, "x array<double>, toxic int").collect()
    fits.sort(key=lambda r: (r["toxic"], r["x"]))
    y = np.array([r["toxic"] for r in fits], float)
    if not len(y) or y.min() == y.max():  # too few rows for a fit: the mean ratio counts as it is
        weights = np.array([1.0] + [0.0] * FEATURES), np.zeros(FEATURES), np.ones(FEATURES)
    else:
        weights = fit_logistic(np.array([r["x"] for r in fits]), y)
    scratch.drop("sample")
    return {"model": model, "weights": weights}


def ratios_of(model) -> Ratios:
    key, tables = model.value
    return held(key, lambda: Ratios(*tables))


class Scorer:
    """Scores and ratios of texts, in a task."""

    def __init__(self, learned: dict) -> None:
        self.model, self.weights = learned["model"], learned["weights"]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        w, mean, deviation = self.weights
        x = ratios_of(self.model).features(texts)
        return 1 / (1 + np.exp(-np.clip(((x - mean) / deviation) @ w[:-1] + w[-1], -30, 30))), x


def score_toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the ratios that are compared as `ratios`."""
    learned = learn(docs, labels, scratch or Scratch(docs.sparkSession))
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of() == 2).alias("held_out"))
    schema = "doc_id long, held_out boolean, score double, predicted int, ratios array<double>"
    if learned is None:
        empty = F.array().cast("array<double>")
        return inputs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), empty.alias("ratios"))
    scorer = Scorer(learned)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score, x = scorer(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "held_out", "score", "predicted", "ratios"],
                )

    return inputs.mapInArrow(rows, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns; a map over rows."""
    learned = learn(docs, labels, scratch or Scratch(docs.sparkSession))
    if learned is None:
        return docs
    scorer, at = Scorer(learned), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield part.filter(pa.array(scorer(part.column(at).to_pylist())[0] < THRESHOLD))

    return docs.mapInArrow(rows, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("ratios")
