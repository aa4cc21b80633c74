"""Language ID (operator 6): averaged hashed subword embeddings with a linear softmax.

A word gives features: itself and its character n-grams of 2 to 5 letters, between word marks; each feature is hashed
to a row of an embedding table. A text is the mean of its features' rows, and a linear layer with softmax gives the
languages' probabilities. Table and layer are trained together by stochastic gradient descent in numpy, with a rate that
falls to zero, over segments of SEGMENT words. Words are runs without white space after lower-casing; of a run beyond
LONGEST letters (a text without spaces) each LONGEST letters are a word.

Calibrated rejection: on part of the sample that was not trained on, a temperature is fitted by likelihood, and the
threshold is the score below which at most REJECT of the right answers lie. find_languages() marks texts below it
(`rejected`) and leaves what follows from that to its caller; lang_pred stays the likeliest language.

Learning uses rows with a language outside fold 2: of each language about PER_LANGUAGE different texts, by a hash of the
text, so that copies and rows without an id add nothing. Every language that labels name is learned, however rare. Tasks cut
SEGMENTS segments from all over each text, and score those that calibrate; this is what reaches the driver, so its amount
follows the number of languages alone, and no length of text changes it. The model is broadcast: it has BUCKETS rows of DIM
numbers and as many for each language, or of one number for each language where these are fewer.

Scoring is a map over rows without a shuffle. Words are numbered over many texts at once, each distinct word's features
are hashed and summed in numpy, and texts add up the rows of their words. Language, source and doc_id are never inputs of
a prediction.

Defined results: 'und' with score 0 for a null text or one without a letter, and for all rows where no language can be
learned. A null doc_id stays null. Rows that repeat get equal results, and each a row. Of equally likely languages the
first by name is given. An empty table gives an empty result; columns other than doc_id, text and lang are ignored.
Memory of a task follows the longest text, not the number of its features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import held, release
from quillon.llm.shared import Scratch, fold_of, sent_if_small, ship, table
from quillon.llm.shingles import mixed
from quillon.llm.words import LONGEST, numbered, word_lists

PER_LANGUAGE = 800
BUCKET_BITS, DIM = 16, 16
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (2, 3, 4, 5)
SEGMENT, SEGMENTS, EPOCHS, BATCH, RATE = 24, 6, 4, 64, 40.0
#: Steps of training at least, for small samples, and for each language.
STEPS, STEPS_EACH = 600, 10
REJECT = 0.01
UNDETERMINED = "und"
#: Numbers (rows x languages) of n-grams that are summed together.
SUMMED = 1 << 22


def windows(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the words themselves and each n in turn: the buckets of all places, BUCKETS where no n-gram of a word begins,
    and where each word's places start."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = "<" + "><".join(words) + ">"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # letters from a place to the end of its word
    factor = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.full(LONGEST + 3, factor, np.uint64))
    whole = np.add.reduceat(mixed(codes) * power[np.arange(len(codes)) - np.repeat(starts, sizes)], starts)
    yield (mixed(whole, 1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.arange(len(words))
    h, ahead = codes, np.concatenate([codes, np.zeros(max(NGRAMS), np.uint64)])
    for n in range(2, max(NGRAMS) + 1):
        h = h * factor + ahead[n - 1 : n - 1 + len(codes)]
        if n in NGRAMS:
            yield np.where(left >= n, mixed(h, n) >> np.uint64(64 - BUCKET_BITS), np.uint64(BUCKETS)).astype(np.int64), starts


class Classifier:
    """Trained rows: mean over features of rows @ layer is linear, so up to DIM languages both are kept as one table of languages'
    logits, and the layer is None."""

    def __init__(self, languages: list[str], rows: np.ndarray, offset: np.ndarray, temperature: float, threshold: float, layer: np.ndarray | None = None) -> None:
        self.languages, self.rows, self.offset, self.layer = languages, rows, offset, layer
        self.temperature, self.threshold = temperature, threshold
        #: One more column counts features; the last row is that of no feature.
        self.table = np.zeros((BUCKETS + 1, rows.shape[1] + 1), np.float32)
        if languages:
            self.table[:-1, :-1] = rows
            self.table[:-1, -1] = 1.0

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its features' rows, and their number."""
        out = np.empty((len(words), self.table.shape[1]))
        step = max(64, SUMMED // (self.table.shape[1] * (LONGEST + 2)))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            out[at : at + len(part)] = sum(np.add.reduceat(np.take(self.table, buckets, axis=0), starts) for buckets, starts in windows(part))
        return out

    def means(self, texts: list[str]) -> np.ndarray:
        """The languages' logits of each text; 0 for a text without words."""
        total = np.zeros((len(texts), self.table.shape[1]))
        for words, numbers, of, sizes in numbered(texts):
            rows = self.word_rows(words)[numbers]
            np.add.at(total, of, np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
        means = total[:, :-1] / np.maximum(total[:, -1:], 1.0)
        return (means if self.layer is None else means @ self.layer) + self.offset

    def softmax(self, z: np.ndarray) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, for each text."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        some = [k for k, text in enumerate(texts) if text and self.languages and any(map(str.isalpha, text))]
        if some:
            p = self.softmax(self.means([texts[k] for k in some]))
            best = p.argmax(1)
            for k, b, score in zip(some, best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True):
                out[k] = self.languages[b], score, score < self.threshold
        return out


def segments(text: str, rng: np.random.Generator) -> list[str]:
    """Up to SEGMENTS segments of a text, spread over it; words are separated by spaces."""
    words = [w for part in word_lists(text) for w in part]
    out = []
    if words:
        n = min(SEGMENTS, max(1, len(words) // SEGMENT))
        for at in rng.integers(0, max(1, len(words) - SEGMENT + 1), n):
            out.append(" ".join(words[at : at + int(rng.integers(3, SEGMENT + 1))]))
    return out


def features(cut: list[str]) -> list[np.ndarray]:
    """The buckets of all features of each segment."""
    index = {w: k for k, w in enumerate(dict.fromkeys(w for s in cut for w in s.split(" ")))}
    of: list[list[np.ndarray]] = []
    for part in batched(index, 4096):
        per_word = [np.split(buckets, starts[1:]) for buckets, starts in windows(list(part))]
        of += [[b[b < BUCKETS] for b in word] for word in zip(*per_word, strict=True)]
    rows = [np.concatenate(word) for word in of]
    return [np.concatenate([rows[index[w]] for w in s.split(" ")]) for s in cut]


def train(cut: list[str], labels: list[int], n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The embeddings, the layer and the offsets, from segments and their languages' numbers."""
    xs, y = features(cut), np.array(labels)
    rng = np.random.default_rng(seed)
    rows, layer, offset = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 1 / DIM, (DIM, n)), np.zeros(n)
    weight = len(y) / (n * np.maximum(np.bincount(y, minlength=n), 1))  # rare languages count as much as others
    a_pass = len(xs) // BATCH + 1
    epochs = max(EPOCHS, -(-max(STEPS, STEPS_EACH * n) // a_pass))
    steps, step = epochs * a_pass, 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            sizes = np.array([len(xs[k]) for k in at])
            flat = np.concatenate([xs[k] for k in at])
            mean = np.add.reduceat(rows[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            z = mean @ layer + offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[y[at], None] / len(at)
            rate = RATE * (1 - step / steps)
            down = p @ layer.T / sizes[:, None]
            layer -= 0.02 * rate * (mean.T @ p)
            offset -= 0.02 * rate * p.sum(0)
            np.add.at(rows.reshape(-1), (flat[:, None] * DIM + np.arange(DIM)).reshape(-1), np.repeat(-rate * down, sizes, axis=0).reshape(-1))
            step += 1
    return rows, layer, offset


def calibrate(model: Classifier, z: np.ndarray, y: np.ndarray) -> None:
    """Set the temperature and the threshold from logits and languages' numbers of texts that were not trained on."""
    if not len(y):
        return

    # as if one text more had been right and one wrong, so that a sample without an error does not make all scores 1
    n = z.shape[1]
    wanted = np.full(z.shape, 1 / (len(y) + 2) / max(1, n - 1))
    wanted[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)

    def loss(t: float) -> float:
        model.temperature = float(t)
        return -float((wanted * np.log(model.softmax(z) + 1e-300)).sum())

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = model.softmax(z)
    right = p[np.arange(len(y)), y][p.argmax(1) == y]
    model.threshold = float(np.quantile(right, REJECT)) if len(right) else 0.0


def take_sample(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, text, hash and calibrates of the rows to learn from: different texts, about PER_LANGUAGE for each language."""
    rows = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & (fold_of() != 2)).select("lang", "text", F.xxhash64("text").alias("hash"))
    share = F.greatest(F.lit(1), (1_000_000_000 * PER_LANGUAGE / F.col("n")).cast("long"))
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", share.alias("share"))
    shares = sent_if_small(scratch.keep(shares, "shares"))
    draw = F.pmod("hash", F.lit(1_000_000_000))
    sample = rows.join(shares, "lang").where(draw < F.col("share")).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    return sample.select("lang", "text", "hash", (F.pmod(F.shiftright("hash", 24), F.lit(5)) == 0).alias("calibrates"))


def learn(docs: DataFrame, scratch: Scratch | None = None) -> Classifier:
    spark = ship(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    sample = scratch.keep(take_sample(docs, scratch), "sample")

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            cut = [segments(t.as_py(), np.random.default_rng(h.as_py() & (1 << 62) - 1)) for t, h in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string())), batch.column(2)], ["lang", "cut", "hash"])

    seen = sample.where("not calibrates").select("lang", "text", "hash").mapInArrow(cut_rows, "lang string, cut array<string>, hash long")
    seen = sorted((r["lang"], r["hash"], s) for r in seen.collect() for s in r["cut"])  # the bound is on rows, segments and their lengths
    languages = sorted({r[0] for r in seen})
    if not languages:
        return Classifier([], np.zeros((1, 1)), np.zeros(1), 1.0, 0.0)
    number = {lang: k for k, lang in enumerate(languages)}
    rows, layer, offset = train([s for _, _, s in seen], [number[lang] for lang, _, _ in seen], len(languages))
    if len(languages) <= DIM:
        rows, layer = rows @ layer, None
    model = Classifier(languages, rows.astype(np.float32), offset, 1.0, 0.0, layer)
    shared = _shared(spark, model)

    def logit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared)
        for batch in batches:
            z = own.means(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z.tolist(), pa.list_(pa.float64()))], ["lang", "z"])

    rest = sample.where("calibrates").select("lang", "text").mapInArrow(logit_rows, "lang string, z array<double>").collect()
    rest = sorted((number[r["lang"]], tuple(r["z"])) for r in rest if r["lang"] in number)
    calibrate(model, np.array([z for _, z in rest]), np.array([k for k, _ in rest], int))
    scratch.drop("sample")
    return model


def _shared(spark: SparkSession, model: Classifier):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, (model.languages, model.rows, model.offset, model.temperature, model.threshold, model.layer)))


def _model(shared) -> Classifier:
    key, parts = shared.value
    return held(key, lambda: Classifier(*parts))


def find_languages(docs: DataFrame, model: Classifier | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    spark = ship(docs.sparkSession)
    shared = _shared(spark, model or learn(docs, scratch))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.bool_()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of() == 2).alias("held_out")).mapInArrow(
        rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_languages(table(spark, sf_dir, "documents"))
