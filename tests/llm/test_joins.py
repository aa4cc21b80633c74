from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from quillon.llm import components, embedding_join, exact_dedup, line_dedup, mixing, ngram_join, registry, shingles, url_filters
from quillon.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, size int, kept boolean"


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns, wanted = sql_rows(registry.oracle_sql()[name], sf_dir)
    assert sorted(df.columns) == columns and wanted
    assert spark_rows(df) == wanted


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "ONE two"), (7, "w " * 3000), (7, "w " * 3000), (8, " ".join(map(str, range(20000)))), (None, "one two"), (9, "ünï A")]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark), "t")
    wanted = {k: 0 for k in range(31)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert {r["id"]: r["component"] for r in got.collect()} == wanted
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark), "e").count() == 0


# --- exact dedup


@pytest.mark.parametrize("capacity", [2, 4, 1000])
def test_exact_groups_of_odd_rows(spark, capacity):
    """With small capacities buckets split, and copies fill hot ones."""
    odd = [*ODD, *[(100 + k, "Copy of a text") for k in range(30)], (7, "another text of the same id")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs_of(spark, odd), capacity=capacity).collect()), key=repr)
    groups = {}
    for i, t in odd:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert got == sorted(((i, best[t], len(ids), i == best[t]) for t, ids in groups.items() for i in ids), key=repr)
    kept = exact_dedup.drop_exact_copies(docs_of(spark, odd), capacity=capacity)
    assert kept.columns == docs_of(spark, odd).columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in odd if i == best[(t or "").translate(LOWER)])
    assert exact_dedup.exact_groups(docs_of(spark, []), capacity=capacity).count() == 0


def test_texts_that_share_a_key_are_links_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    got = {(r["row"]["doc_id"], r["chain"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_links(docs_of(spark, [(1, "a"), (2, "b"), (3, "A"), (4, "c")]), Scratch(spark)).collect()}
    assert got == {(1, 1, 3, 2), (3, 1, 3, 2), (2, 2, 2, 1), (4, 3, 4, 1)}


@pytest.mark.parametrize("capacity", [2, 1000])
def test_keys_that_share_a_bit_with_repeated_ones_change_nothing(spark, monkeypatch, capacity):
    odd = [*ODD, *[(100 + k, "Copy of a text") for k in range(30)], *[(200 + k, f"text {k}") for k in range(40)]]
    want = sorted(exact_dedup.exact_groups(docs_of(spark, odd), capacity=capacity).collect(), key=repr)
    monkeypatch.setattr(exact_dedup, "_cell", lambda key: F.lit(0).cast("long"))
    monkeypatch.setattr(exact_dedup, "_bit", lambda key: F.lit(1).cast("long"))
    assert sorted(exact_dedup.exact_groups(docs_of(spark, odd), capacity=capacity).collect(), key=repr) == want


def test_only_keys_of_several_rows_are_marked(spark):
    keys = spark.createDataFrame([(5, 1), (-1, 2), (-2, 3), (7 << 44 | 63, 2), (7 << 44 | 1, 1)], "key long, n long")
    got = {(r["cell"], r["bits"] & (1 << 64) - 1) for r in exact_dedup.shared_keys(keys).collect()}
    assert got == {((1 << 20) - 1, 1 << 63 | 1 << 62), (7, 1 << 63)}


def test_directory_covers_all_slots_once(spark):
    entries = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(900).select(F.xxhash64(F.lit(7)).alias("key")))
    slots, finest = exact_dedup.directory(entries, 5900, 300)
    slots, depth = exact_dedup.global_depth(slots, finest)
    got = sorted((r["slot"], r["bucket"] >> finest - depth, r["local_depth"], r["hot"]) for r in slots.collect())
    assert [s for s, *_ in got] == list(range(2**depth)) and max(k for _, _, k, _ in got) == depth
    assert all(b <= s < b + 2 ** (depth - k) for s, b, k, _ in got) and sum(hot for *_, hot in got) == 1
    rows = entries.collect()
    for bucket, local, hot in {(b, k, h) for _, b, k, h in got}:
        n = sum((r["key"] & (1 << 64) - 1) >> 64 - local == bucket >> depth - local for r in rows)
        assert n <= 300 or hot


# --- mixing


def filled(sizes, weights, budget):
    """Targets by resharing again and again."""
    left, target = set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        rest = budget * sum(sizes) - sum(2.0 * sizes[k] for k in range(len(sizes)) if k not in left)
        share = {k: rest * weights[k] / sum(weights[j] for j in left) for k in left}
        over = {k for k in left if share[k] > 2 * sizes[k]}
        for k in left:
            target[k] = 2.0 * sizes[k] if k in over else share[k]
        if not over:
            break
        left -= over
    return target


def test_targets_are_those_of_resharing(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 20):
        sizes = [int(x) for x in rng.integers(0, 1000, n)]
        table = spark.createDataFrame([(f"s{k:02d}", s) for k, s in enumerate(sizes)], "source string, source_size long")
        got = [r["target"] for r in mixing.source_targets(table).orderBy("source").collect()]
        assert got == pytest.approx(filled(sizes, [(3, 1, 2)[k % 3] for k in range(n)], 1.5))


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), None if i % 5 == 0 else f"s{i % 5}") for i in range(3000)] + [(None, None, "s1"), (5, "a b", "s2"), (5, "a b", "s2")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, True) for i, t, s in rows], SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_ids_and_repeats_meet_targets(spark):
    rows = [(None if i % 2 else i, f"w{i} " * (1 + i % 5), f"s{i % 3}") for i in range(600)]
    rows += [(7, "a b c", "s1")] * 150 + [(None, "d e", "s2")] * 150 + [(None, None, None)] * 20
    docs = spark.createDataFrame([(i, t, "en", s, 1, True) for i, t, s in rows], SCHEMA)
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=repr) for n in (3, 5))
    assert first == again and len(first) == len(rows)
    for source in {r[1] for r in first}:
        own = [r for r in first if r[1] == source]
        assert abs(sum(r[6] for r in own) - own[0][4]) <= 5
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in first)
    clashing = docs.withColumnRenamed("kept", "hash").withColumnRenamed("size", "copies")
    assert mixing.apply_mix(clashing).columns == clashing.columns


# --- URL filters


def test_as_of_intervals(spark):
    day = dt.date
    log = [("a.com", day(2024, 1, 10), "block", "l"), ("a.com", day(2024, 3, 1), "unlist", "l"), ("x.a.com", day(2024, 2, 1), "allow", "l"), ("b.org", day(2024, 5, 5), "block", "m"), (None, day(2024, 1, 1), "block", "l")]
    entries = spark.createDataFrame(log, "domain string, at date, action string, list string")
    asked = [("a.com", day(2024, 1, 9)), ("a.com", day(2024, 1, 10)), ("y.a.com", day(2024, 2, 29)), ("x.a.com", day(2024, 1, 31)), ("x.a.com", day(2024, 2, 1)), ("a.com", day(2024, 3, 1)), ("b.org", day(2033, 1, 1)), ("", day(2024, 6, 1)), ("xa.com", day(2024, 2, 1)), ("b.org", None)]
    captures = spark.createDataFrame([(k, h, d) for k, (h, d) in enumerate(asked)], "page_id long, host string, fetched date").withColumn("capture", F.struct("page_id", "host"))
    got = [r["verdict"] for r in url_filters.evaluate(captures, entries).orderBy("page_id").collect()]
    assert got == ["none", "block", "block", "block", "allow", "none", "block", "none", "none", "none"]
    assert spark.range(1).select(url_filters.host_of(F.lit("HTTP://u:p@Ex.COM:80/x"))).first()[0] == "ex.com"


def test_entries_of_a_last_label(spark):
    log = [("zip", dt.date(2024, 1, 1), "block", "l"), ("localhost", dt.date(2024, 1, 1), "block", "l"), ("b.zip", dt.date(2024, 1, 1), "allow", "l")]
    entries = spark.createDataFrame(log, "domain string, at date, action string, list string")
    hosts = ["a.x.zip", "zip", "a.localhost", "a.b.zip", "a.unzip", "zip.com", ""]
    captures = spark.createDataFrame([(k, h, dt.date(2024, 2, 1)) for k, h in enumerate(hosts)], "page_id long, host string, fetched date").withColumn("capture", F.struct("page_id", "host"))
    got = [(r["verdict"], r["matched_domain"]) for r in url_filters.evaluate(captures, entries).orderBy("page_id").collect()]
    assert got == [("block", "zip"), ("block", "zip"), ("block", "localhost"), ("allow", "b.zip"), *[("none", None)] * 3]


def test_odd_captures(spark):
    day = dt.date
    entries = spark.createDataFrame([("a.com", day(2024, 1, 1), "block", "l"), ("a.com", day(2050, 1, 1), "unlist", "l")], "domain string, at date, action string, list string")
    asked = [(1, "http://a.com/x", day(2024, 2, 1)), (1, "http://a.com/x", day(2024, 2, 1)), (2, None, day(2024, 2, 1)), (None, "http://b.a.com", day(2049, 12, 31)), (3, "http://" + "a." * 50_000 + "a.com/" + "p" * 100_000, day(2050, 1, 1)), (4, "not a url", None)]
    captures = spark.createDataFrame(asked, "page_id long, url string, fetched date").withColumn("host", url_filters.host_of(F.col("url"))).drop("url")
    captures = captures.withColumn("capture", F.struct("page_id", "host"))
    got = sorted(((r["page_id"], r["verdict"]) for r in url_filters.evaluate(captures, entries).collect()), key=repr)
    assert got == sorted([(1, "block"), (1, "block"), (2, "none"), (None, "block"), (3, "none"), (4, "none")], key=repr)
    assert {r["verdict"] for r in url_filters.evaluate(captures, entries.limit(0)).collect()} == {"none"}
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0


def test_long_hosts_with_entries_of_their_own(spark, tmp_path):
    """Hosts up to the longest that there can be are asked for label by label; longer ones are no hosts, in Spark and in SQL."""
    hosts = [".".join(["a"] * n + [f"h{k}.org"]) for k in range(30) for n in (1, 60, 100 + k % 30, 200)] + ["x" * 253, "x" * 254, "ads-track.example.com", "b.EXAMPLE.net"]
    rows = [(k, f"http://{h}/p", None, "clash") for k, h in enumerate(hosts)] + [(k + 500, f"https://u@{h}:80", None, "clash") for k, h in enumerate(hosts)] + [(2000, None, None, None), (2001, "no url", None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    df = url_filters.op7_url_filters(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        found = con.execute(url_filters.OP7_SQL)
        names = [c[0] for c in found.description]
        wanted = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert spark_rows(df) == wanted and len({r["verdict"] for r in df.collect()}) >= 2
    assert {r["host"] for r in df.where("page_id = 121 or page_id = 3").collect()} == {""}


# --- near copies


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({b" ".join(w)} if w else set()))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in lists.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            lists[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in sets}


def variants(n, size, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, size, int(rng.integers(0, 3))):
            words[k] = f"x{rng.integers(0, 50)}"
        out.append(" ".join(words))
    return out


def test_near_groups_of_the_documents(spark, rows):
    got = {tuple(r) for r in ngram_join.near_groups(docs_of(spark, rows)).collect()}
    assert got == brute_groups(rows, 4, 85)


def test_near_groups_of_a_large_family_in_small_blocks(spark):
    rows = [(10 + k, t) for k, t in enumerate(variants(70, 60, 5))] + [(500 + k, t) for k, t in enumerate(variants(40, 25, 6))]
    got = {tuple(r) for r in ngram_join.near_groups(docs_of(spark, rows), block=400).collect()}
    assert got == brute_groups(rows, 4, 85)


def test_near_groups_of_odd_rows(spark):
    got = {tuple(r) for r in ngram_join.near_groups(docs_of(spark, ODD)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 19997, 8), (None, 1, 5), (9, 1, 9)} == got
    assert ngram_join.near_groups(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block", [400, ngram_join.BLOCK])
def test_links_through_rows_without_ids(spark, block):
    """Two texts that only a third one links, which has no id, are one component; copies of it are many rows."""
    words = [f"w{k}" for k in range(60)]
    a, b, c = words[:], words[4:] + ["x1", "x2", "x3", "x4"], words[8:] + [f"x{k}" for k in range(1, 9)]
    few = [f"y{k}" for k in range(50)]
    texts = [" ".join(w) for w in (a, b, c, few, [*few[:-1], "z"])]
    rows = [(1, texts[0]), (3, texts[2]), *[(None, texts[1])] * 9, (None, texts[3]), (None, texts[3] + "  "), (None, texts[4]), (7, "other words stand here")]
    named = [(i if i is not None else 1000 + texts.index(t.strip()), t) for i, t in rows]
    want = {(t, n, None if root >= 1000 else root) for (_, t), (n, root) in zip(named, [next((n, r) for i, n, r in brute_groups(named, 4, 85) if i == k) for k, _ in named], strict=True)}
    got = ngram_join.labelled(docs_of(spark, rows).repartition(3), 4, 85, Scratch(spark), block)
    marks = {r["mark"]: r["text"] for r in docs_of(spark, rows).select("text", ngram_join.text_mark().alias("mark")).collect()}
    found = got.collect()
    assert {(marks[r["mark"]], r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == len(rows)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 3)} == {1} and sum(r["component_id"] is None for r in found) == 3


def test_no_text_is_lost_with_near_copies(spark):
    long = " ".join(map(str, range(200)))
    rows = [*ODD, (1, "same text"), (1, "unique text"), (2, "same text"), (None, "no id here"), (None, "no id here"), (None, long), (50, long + " x"), (40, long + " y")]
    want = [r for r in rows if r not in [(6, "ONE two"), (None, "one two"), (2, "same text"), (50, long + " x"), (None, long)]]
    for order in (rows, rows[::-1]):
        docs = docs_of(spark, order)
        kept = ngram_join.drop_near_copies(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def no_frequent(*_):
    """As on a corpus with far more long lists than are known to the tasks."""
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


def test_texts_with_a_common_passage_are_no_candidates_though_its_lists_are_not_known(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + f" {passage} " + " ".join(f"w{i}y{k}" for k in range(30))) for i in range(90)]
    rows += [(200, rows[5][1] + " z"), (201, passage), (202, passage + " z")]
    groups = []

    def components_of(pairs, scratch, name):
        found = components.connected_components(pairs, scratch, name)
        if name == "candidates":
            groups.extend(r["n"] for r in found.groupBy("component").agg(F.count("*").alias("n")).collect())
        return found

    monkeypatch.setattr(ngram_join, "connected_components", components_of)
    monkeypatch.setattr(ngram_join, "frequent_shingles", no_frequent)
    got = {tuple(r) for r in ngram_join.near_groups(docs_of(spark, rows)).collect()}
    assert got == brute_groups(rows, 4, 85) and {r[0]: r[2] for r in got}[200] == 5
    assert sorted(groups) == [2, 2]


def mixed_families(seed):
    """Families, texts of passages in any order, short texts of few words, and texts of their own."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{j}w{k}" for k in range(int(rng.integers(3, 30)))) for j in range(4)]
    texts = [*variants(50, 40, seed), *variants(45, 18, seed + 1), *variants(8, 200, seed + 2)]
    texts += [" ".join(passages[j] for j in rng.permutation(4)[: rng.integers(1, 5)]) + f" own{i % 37}" * int(rng.integers(0, 3)) for i in range(80)]
    texts += [" ".join(f"s{j}" for j in rng.integers(0, 3, int(rng.integers(1, 12)))) for i in range(80)]
    texts += [" ".join(f"t{i}w{k}" for k in range(30)) + " " + passages[i % 4] for i in range(40)]
    rows = list(enumerate(texts))
    return rows + [(1000 + i, t) for i, t in rows[::3]] + [(2000 + i, t.upper()) for i, t in rows[::5]]


@pytest.mark.parametrize(("near", "percent"), [(1, 85), (3, 80), (32, 85), (32, 80)])
def test_links_lie_within_groups_of_candidates(spark, near, percent):
    """Whatever number of entries makes a list long, also where many tasks met copies of a set."""
    rows = mixed_families(near + percent)
    scratch = Scratch(spark)
    sets = scratch.keep(ngram_join.describe_sets(docs_of(spark, rows).repartition(6), 4, percent, no_frequent()), "sets")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = components.connected_components(ngram_join.candidates(sets.where("prefix is not null"), percent, scratch, near), scratch, "candidates").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    group, node = {r["id"]: r["component"] for r in found}, {r["doc_id"]: r["node"] for r in sets.collect()}
    for i, n, least in brute_groups(rows, 4, percent):
        assert not n or group.get(node[i], node[i]) == group.get(node[least], node[least])


@pytest.mark.parametrize("block", [2500, ngram_join.BLOCK])
def test_near_groups_of_mixed_families(spark, monkeypatch, block):
    rows = mixed_families(block % 7)
    want = brute_groups(rows, 4, 85)
    assert {tuple(r) for r in ngram_join.near_groups(docs_of(spark, rows).repartition(5), block=block).collect()} == want
    monkeypatch.setattr(ngram_join, "frequent_shingles", no_frequent)
    assert {tuple(r) for r in ngram_join.near_groups(docs_of(spark, rows).repartition(5), block=block).collect()} == want


def test_near_copies_of_the_pipeline_have_no_group_of_a_common_passage(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(14))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + f" {passage} " + " ".join(f"w{i}y{k}" for k in range(30))) for i in range(60)]
    rows += [(100, rows[7][1] + " z"), (101, "q " + rows[8][1])]
    sizes = []

    def components_of(pairs, scratch, name):
        found = components.connected_components(pairs, scratch, name)
        sizes.extend(r["count"] for r in found.groupBy("component").count().collect() if name == "candidates")
        return found

    monkeypatch.setattr(ngram_join, "connected_components", components_of)
    monkeypatch.setattr(ngram_join, "frequent_shingles", no_frequent)
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_copies(docs_of(spark, rows)).collect()) == list(range(60))
    assert sizes == [2, 2]


def test_queries_of_a_block_are_compared_with_other_sets_only():
    a, b = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    groups = ngram_join.divide_skip([a, a[:99], b, b[:98], b[:97]], 85, np.array([True, True, True, False, False]))
    assert [groups.root(k) for k in range(5)] == [0, 1, 2, 2, 2]


# --- lines


def brute_lines(rows, percent):
    lines = [(i, k, frozenset(x.split())) for i, t in sorted(rows) for k, x in enumerate((t or "").encode().lower().split(b"\n"))]
    lists, out = {}, {i: [] for i, _ in rows}
    for x, (i, k, s) in enumerate(lines):
        common = {}
        for w in s:
            for y in lists.get(w, ()):
                common[y] = common.get(y, 0) + 1
        if any(100 * n >= percent * (len(s) + len(lines[y][2]) - n) for y, n in common.items()):
            out[i].append(k)
        for w in s:
            lists.setdefault(w, []).append(x)
    return {(i, tuple(v)) for i, v in out.items()}


@pytest.mark.parametrize(("lags", "nearest", "block"), [(1, 1, 4096), (96, 2, 4096), (4, 0, 3)])
def test_removed_lines_of_the_documents(spark, rows, lags, nearest, block):
    got = {(r["doc_id"], tuple(r["removed"])) for r in line_dedup.removed_lines(docs_of(spark, rows), lags=lags, nearest=nearest, block=block).collect()}
    assert got == brute_lines(rows, 80)


def test_removed_lines_of_families_and_odd_rows(spark):
    rows = [(10 + k, f"{t}\nown line {k} a{k} b{k} c{k}") for k, t in enumerate(variants(80, 30, 8))] + [r for r in ODD if r[0] not in (7, None)]
    nameless = rows[0][1] + "\nno other line is like this"
    got = {(r["doc_id"], tuple(r["removed"])) for r in line_dedup.removed_lines(docs_of(spark, [*rows, (None, nameless), (None, nameless)]), lags=3).collect()}
    assert got == {(None if i == 10**9 else i, gone) for i, gone in brute_lines([*rows, (10**9, nameless)], 80)}
    assert (None, (0, 1)) in got
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_similar_lines(docs_of(spark, [(1, "a b c\nd\n\na b c"), (2, "A b c"), (3, None)])).collect()}
    assert cut == {1: "a b c\nd\n", 2: "", 3: None}
    assert line_dedup.removed_lines(docs_of(spark, [])).count() == 0


def test_pairs_of_lines_are_found_at_the_first_common_token_and_short_sets_have_maps_of_64_bits(spark):
    """Both have 40 tokens and need 36 in common, so the first of these is one of the first five; all nine of the prefix are common or but one."""
    short = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(short)), (2, " ".join([*short[:-1], "other"])), (3, " ".join(f"v{k}" for k in range(90)))]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lines = line_dedup.describe_lines(docs_of(spark, rows).coalesce(1), 80, none).cache()
    of = {r["doc_id"]: r for r in lines.collect()}
    assert of[1]["odd"] == of[2]["odd"] == 0 != of[3]["odd"] and len({r["hi"] for r in of.values()}) == 3
    assert {key & 0xFFFFFFF for key in of[1]["prefix"]} == {40} and len(of[1]["prefix"]) == 9
    found = line_dedup.list_pairs(line_dedup.list_entries(lines), 80, 96, 2).collect()
    assert 1 <= len(found) <= 5
    assert all((r["is_open"], {r["a"], r["b"]}) == (False, {of[1]["hi"], of[2]["hi"]}) for r in found)


def test_lines_about_the_length_at_which_maps_are_folded(spark):
    long = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*long[: 50 + 5 * k], *(f"x{k}_{i}" for i in range(k % 4))])) for k in range(14)] + [(20 + k, " ".join(long[k : k + 71 + k % 3])) for k in range(30)]
    want = brute_lines(rows, 80)
    assert sum(len(gone) for _, gone in want) > 20
    for parameters in ({}, {"lags": 2, "nearest": 1, "block": 3}):
        assert {(r["doc_id"], tuple(r["removed"])) for r in line_dedup.removed_lines(docs_of(spark, rows), **parameters).collect()} == want


def test_rows_that_repeat_an_id_lose_the_same_lines_in_any_order(spark):
    words = "a b c d e f g h i j"
    rows = [(1, words), (1, "z y x w v"), (2, words[:-1] + "k"), (2, words[:-1] + "k"), (3, "z y x w v\n" + words)]
    want = sorted([(1, ()), (1, ()), (2, (0,)), (2, (0,)), (3, (0, 1))])
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = docs_of(spark, order).withColumnRenamed("kept", "removed").withColumnRenamed("size", "mark")
        assert sorted((r["doc_id"], tuple(r["removed"])) for r in line_dedup.removed_lines(docs, percent=80).collect()) == want
        cut = line_dedup.drop_similar_lines(docs)
        assert cut.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in cut.collect()) == sorted([(1, words), (1, "z y x w v"), (2, ""), (2, ""), (3, "")])


def test_lines_of_rows_without_ids(spark):
    """They lose lines to all rows with an id, and to one another by the order of a hash; equal rows keep the same lines."""
    texts = ["one two three four five\nleft alone", "one two three four five\nright alone", "six seven eight"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (7, texts[2]), (None, texts[2])]
    marks = dict(tuple(r) for r in docs_of(spark, rows).select("text", line_dedup.text_mark()).collect())
    first, later = sorted(texts[:2], key=marks.get)
    cut = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_similar_lines(docs_of(spark, rows).repartition(3)).collect()), key=repr)
    want = [(i, t if t == first or i else "" if t == texts[2] else t.split("\n")[1]) for i, t in rows]
    assert cut == sorted(want, key=repr) and later != first


def test_long_words_that_share_a_polynomial_differ():
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, _ = shingles.words_of(f"{a} {b} {a}".encode())
    assert hashes[0] == hashes[2] != hashes[1]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_frequencies_find_their_hashes_only(n):
    rng = np.random.default_rng(n)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), np.arange(n % 7, dtype=np.uint64), ~np.arange(n % 3, dtype=np.uint64)]))
    counts = rng.integers(1, 99, len(values))
    asked = np.concatenate([rng.permutation(values), rng.integers(0, 1 << 63, 999, dtype=np.uint64), np.array([0, 1, 77, (1 << 64) - 1], np.uint64)])
    want = dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert shingles.Frequencies(values, counts).of(asked, -1).tolist() == [want.get(x, -1) for x in asked.tolist()]


def test_lines_are_packed_together_as_by_themselves():
    often = np.sort(np.unique(shingles.words_of(b"the of and a to")[0]))
    order = shingles.Frequencies(often, np.arange(1, 6))
    lines = [b"the cat and the hat", b"", b" \t ", b"hat cat", b"\xc3\x9f the", b"cat hat hat"]
    nodes, tokens = line_dedup.packed_lines(lines, order)
    for line, node, token in zip(lines, nodes.tolist(), tokens, strict=True):
        (alone,), (own,) = line_dedup.packed_lines([line], order)
        assert (node, token) == (alone, own)
        assert len(line_dedup.unpacked(token)) == len(set(line.split()))
    assert nodes[1] == nodes[2] == 0 and nodes[3] == nodes[5] != nodes[0] and tokens[3] == tokens[5]


# --- vectors


def test_vectors_in_many_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(0, 0.25, (300, 8)), rng.normal(0, 1, (100, 8))]).astype(np.float32)
    x[5] = x[6] = x[7]
    data = [(int(k) * 3, v.tolist()) for k, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, None] * 4), (9004, [float("nan")] * 8), (9005, [float("inf")] + [0.0] * 7), (9006, [1e-30] + [0.0] * 7), (9007, [5.0]), (9008, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_vectors(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>"), pivots=10, block=16).collect()}
    ids = np.array([k for k, _ in data] + [9006, 9007])
    u = np.concatenate([x.astype(float), [[1.0] + [0.0] * 7] * 2])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = ids.copy()
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    wanted = {int(i): (int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}
    wanted |= {i: (0, i, True) for i in (9001, 9002, 9003, 9004, 9005, 9008)}
    assert got == wanted


def test_pivots_pay_off_where_vectors_have_clusters():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    clusters = unit(rng.normal(0, 1, (300, 64)))[rng.integers(0, 300, 3000)] + rng.normal(0, 0.02, (3000, 64))
    for x, few in ((unit(clusters), False), (unit(rng.normal(0, 1, (3000, 64))), True)):
        count = embedding_join.pivots_that_pay(x[:1024], x[1024:1536], 100_000, 0.447, 4096)
        assert (count <= 16) == few


def test_equal_and_missing_vectors(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0])]
    got = sorted(map(tuple, embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == sorted([(3, 3, 2, False), (3, 3, 2, False), (2, 3, 2, True), (None, 3, 2, False), (None, 0, None, True)], key=repr)
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    clashing = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, component string")
    assert sorted(map(tuple, embedding_join.near_vectors(clashing).collect()), key=repr) == got
