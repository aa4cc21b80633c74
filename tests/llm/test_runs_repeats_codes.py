"""Periodic runs, substring dedup and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import periodic_runs, substring_dedup, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, runs int, kept boolean"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, None) for i, t in rows], SCHEMA)


# --- periodic runs


def plain_runs(w, least=24, exponent=3):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, exponent * q) and all(any(w[s + k] != w[s + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    letters = rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            s, block = rng.randrange(n), [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
            for k in range(s, min(n, s + rng.randint(1, 150))):
                w[k] = block[(k - s) % len(block)]
    return w


@pytest.mark.parametrize("least, exponent", [(24, 3), (1, 2), (5, 2), (1, 4)])
def test_runs_are_those_of_a_plain_search(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(60):
        texts = [periodic(rng, rng.randint(0, 160)) for _ in range(rng.randint(1, 8))]
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts], least, exponent)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least, exponent) for t in texts]


def test_long_periodic_texts_take_few_levels():
    words = np.random.default_rng(3).integers(0, 5000, 40_000)
    long = np.resize(words, 150_000)
    (got,) = periodic_runs.runs_of([long])
    assert got.tolist() == [[0, 150_000, 40_000]]
    assert periodic_runs.runs_of([np.zeros(200_000, np.int64), np.arange(5)])[0].tolist() == [[0, 200_000, 1]]
    assert periodic_runs.runs_of([]) == []


def test_runs_of_odd_rows(spark):
    cycle = " ".join(["a b\tc"] * 12)
    rows = [(1, None), (2, ""), (3, " \n"), (4, cycle), (4, cycle), (None, "x " * 30), (5, "x x " * 30), (6, "y " * 23), (7, "one two")]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(docs_of(spark, rows)).collect()), key=repr)
    wanted = [(1, [], ""), (2, [], ""), (3, [], ""), *[(4, [(0, 36, 3)], "a b c")] * 2, (None, [(0, 30, 1)], "x"), (5, [(0, 30, 1)], "x x"), (6, [], " ".join("y" * 23)), (7, [], "one two")]
    assert got == sorted(wanted, key=repr)
    assert periodic_runs.find_runs(docs_of(spark, [])).count() == 0


def test_small_groups_give_the_same_runs(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(map(str, periodic(rng, 90)))) for k in range(30)]
    want = {k: plain_runs(t.split()) for k, t in rows}
    for r in periodic_runs.find_runs(docs_of(spark, rows)).collect():
        assert [tuple(x) for x in r["runs"]] == want[r["doc_id"]]
    numbers = [np.array([int(w) for w in t.split()]) for _, t in rows]
    assert [[tuple(x) for x in periodic_runs.runs_of([n])[0].tolist()] for n in numbers] == [want[k] for k, _ in rows]


def test_the_rule_of_the_query():
    found = {k: periodic_runs.planted(k, 100) for k in range(2000)}
    some = [v for v in found.values() if v]
    assert 120 < len(some) < 280 and all(0 <= a < 100 and 1 <= p <= 1 + (100 - a) // 3 for a, p in some)
    assert periodic_runs.planted(None, 9) is None and all(periodic_runs.planted(k, 0) is None for k in range(50))


# --- substring dedup


def plain_removal(rows, window):
    first = {}
    rank = lambda i: math.inf if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, math.inf), rank(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def shared_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [" ".join(word() for _ in range(rng.choice([10, 12, 15, 25, 60]))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))))
        rows.append((k, ("\t" if k % 3 else "  ").join(parts)))
    rows += [(100 + k, rows[5][1]) for k in range(20)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[11][1]), (None, rows[11][1]), (None, " ".join("n%d" % k for k in range(40))), (None, None), (500, ""), (501, "a " * 700), (502, "b a " * 5 + "a " * 700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, bits, sent", [(512, 26, 1 << 20), (2, 26, 1 << 20), (2, 26, 0), (0, 6, 1 << 20), (512, 6, 0)])
def test_removed_words_are_those_of_a_plain_version(spark, hot, bits, sent):
    """hot = 2 or 0 counts windows as digests, sent = 0 joins them by a shuffle, bits = 6 marks nearly all minimisers."""
    rows = shared_texts(hot + bits)
    found = substring_dedup.remove_repeats(docs_of(spark, rows).repartition(5), window=12, hot=hot, bits=bits, sent=sent)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()), key=repr) == plain_removal(rows, 12)


def test_long_super_kmers_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LONGEST", 7)
    rng = random.Random(2)
    words = [f"w{rng.randrange(9)}" for _ in range(400)]
    texts = [words, words[50:] + words[:60], ["z"] * 300, ["y", *["z"] * 200]]
    chunk = substring_dedup.Chunk([1, 2, 3, 4], [0] * 4, [" ".join(t).encode() for t in texts], 10, 3)
    assert chunk.windows.max() == 7 and chunk.windows.sum() == sum(len(t) - 9 for t in texts)
    by = {}
    for k in range(len(chunk.first)):
        by.setdefault(int(chunk.minimiser[k]), []).append((int(chunk.docs[chunk.text[k]]), int(chunk.text[k]), int(chunk.first[k] - chunk.begins[chunk.text[k]]), chunk.packed(k)))
    gone = [set() for _ in texts]
    for members in by.values():
        for _, text, start, stop in substring_dedup.bucket_spans(members, 10):
            gone[text].update(range(start, stop))
    assert [len(g) for g in gone] == [n for _, _, n, _ in plain_removal([(k, " ".join(t)) for k, t in enumerate(texts)], 10)]


def test_substring_dedup_of_empty_tables(spark):
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in substring_dedup.remove_repeats(docs_of(spark, [(1, "a b")])).collect()] == [(1, 2, 0, "a b")]


def test_sliding_and_rolling_hashes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for width in (1, 2, 3, 16, 35):
        assert substring_dedup.sliding_least(values, width).tolist() == [values[k : k + width].min() for k in range(300 - width + 1)]
    same = np.concatenate([values, values])
    rolled = substring_dedup.rolled(same, 50)
    assert rolled[:251].tolist() == rolled[300:551].tolist() and len(set(rolled.tolist())) == 300


# --- vector codes


def plain_codes(rows, rounds=6):
    """rows of (vec_id, vector, label), by Python's whole numbers and all distances."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // 8))
    scaled = lambda x: math.floor(x * 4096) if abs(x) < 2**40 else int(x) * 4096
    whole = lambda v: [scaled(x) for x in v] + [0] * (8 * width - len(v))
    parts = [[whole(v)[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[parts[k][p] for k in order] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(8):
            own = {}
            for x in parts:
                own.setdefault(near(x[p], books[p])[1], []).append(x[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = new
    found = [[near(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    fits = [e if e < 2**63 else None for e in errors]
    sums = {}
    for (_, _, lab), e in zip(kept, fits, strict=True):
        sums.setdefault(lab, []).append(e)
    total = {k: None if None in v or sum(v) >= 2**63 else sum(v) for k, v in sums.items()}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[lab], sha) for (i, _, lab), f, e in zip(kept, found, fits, strict=True)), key=repr)


def vectors_of(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, lab, 1, "s") for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code int, state string")


def compressed(df, **more):
    return sorted((tuple(r) for r in vector_codes.compress(df, **more).collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_codes_are_those_of_all_distances(spark, rounds):
    rng = np.random.default_rng(rounds)
    centres = rng.normal(0, 1, (30, 16))
    rows = [(k, (centres[k % 30] + rng.normal(0, 0.1 * (k % 4), 16)).round(2).tolist(), None if k % 7 == 0 else k % 3) for k in range(300)]
    rows += [(400 + k, rows[3][1], 1) for k in range(60)]
    assert compressed(vectors_of(spark, rows).repartition(5), rounds=rounds) == plain_codes(rows, rounds)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 1, 19).tolist(), k % 2) for k in range(40)]
    rows += [(50, None, 1), (51, [1.0, None], 1), (52, [float("nan")], 1), (53, [float("inf")], 1), (54, [], 1), (55, [1.0], None)]
    rows += [(None, rows[2][1], None), (3, rows[4][1], 0), (3, rows[4][1], 0)]
    assert compressed(vectors_of(spark, rows)) == plain_codes(rows)
    huge = rows + [(60, [1e30, -1e30, 3.0], 7), (61, [2e5] * 5, 8), (0, [1e9] * 9, 9), (62, [1e300], 7)]
    assert compressed(vectors_of(spark, huge).repartition(4)) == plain_codes(huge)
    few = rows[:3]
    assert compressed(vectors_of(spark, few)) == plain_codes(few)
    assert compressed(vectors_of(spark, [])) == [] and compressed(vectors_of(spark, [(1, None, 1)])) == []


def test_ties_take_the_lower_index_and_groups_are_skipped():
    """Bounds leave most distances out, and results are those of all distances."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-40000, 40000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-300, 300, (2000, 8))
    groups = np.array(vector_codes.grouped(centres.astype(object)))
    near, best, bounds = vector_codes.scan_all(x, centres, groups)
    moved = centres + rng.integers(-20, 20, centres.shape)
    far = np.sqrt(((moved - centres) ** 2).sum(1))
    drift = np.array([far[groups == g].max(initial=0) for g in range(vector_codes.GROUPS)])
    got = vector_codes.scan_where_bounds_fail(x, moved, groups, near, bounds - drift[None, :].astype(np.float32) - 1)
    want = vector_codes.scan_all(x, moved, groups)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert got[3] < 0.6 * 16 * len(x)
    true = [np.sqrt(np.where((groups == g)[None, :] & (np.arange(16)[None, :] != want[0][:, None]), ((x[:, None] - moved) ** 2).sum(2), np.inf).min(1)) for g in range(vector_codes.GROUPS)]
    assert (got[2] <= np.array(true).T).all()
    tied = np.array([[0], [10], [20], [10]])
    assert vector_codes.scan_all(np.array([[5], [15], [10]]), tied, np.array([0, 1, 0, 0]))[0].tolist() == [0, 1, 1]


def test_limbs_add_up():
    for value in (0, 1, -1, 5, -5, 2**32, -(2**32), 2**31, -(2**63), 2**200 + 17, -(2**130) - 3):
        assert sum(r["n"] << 32 * r["limb"] for r in vector_codes._limbs([value])) == value


def test_label_errors_join_hot_and_null_labels(spark):
    rows = [(k, [float(k % 5), 1.0], None if k % 3 else 4) for k in range(90)]
    got = vector_codes.compress(vectors_of(spark, rows)).groupBy("label_error").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in got} <= {30, 60, 90}
