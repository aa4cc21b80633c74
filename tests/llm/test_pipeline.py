from __future__ import annotations

from collections import Counter

import duckdb
import sentencepiece
from test_joins import brute_groups

import corpus_pipeline
from quillon.llm import mixing, pieces, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_are_named_functions():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "sentence_pieces"]


def test_pipeline_gives_the_rows_of_the_plain_version(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # toxicity is learned, so its own scores decide here; their quality has tests of its own
    fine = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in fine}
    last = {}
    for i, r in sorted(rows.items()):
        last[r["text"].translate(LOWER)] = i
    rows = {i: rows[i] for i in last.values()}
    groups = brute_groups([(i, r["text"]) for i, r in rows.items()], 5, 80)
    rows = {i: rows[i] for i, _, c in groups if i == c}
    spark.createDataFrame(list(rows.values()), docs.schema).coalesce(1).write.parquet(str(tmp_path / "left"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/left/*.parquet'")
        taken = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP5_SQL})").fetchall()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    wanted = Counter()
    for i, size, words in taken:
        wanted[i, tuple(model.encode(rows[i]["text"]))] += words // max(size, 1)
    got = Counter((r["doc_id"], tuple(r["piece_ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +wanted


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeats, ids with two texts and rows without ids: no text is lost but by a stage's own rule."""
    long = " ".join(f"word{k}" for k in range(120))
    rows = [
        (1, "first text of one", "en", "a", 1), (1, "another text of one", "en", "a", 1), (2, "first text of one", "en", "a", 1), (None, "no id at all", "en", None, 1),
        (None, "first text of one", None, "b", 1), (3, None, "en", "a", 1), (4, "", "en", "b", 1), (5, long, "en", "b", 1), (6, long + " x", "en", "b", 1), (6, "six again", "en", "b", 1),
        (7, "twice", "en", "a", 1), (7, "twice", "en", "a", 1), (8, "one two " * 9000, "en", "a", 1),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        held = stage(spark, held, str(tmp_path))
    texts = Counter((r["doc_id"], r["text"] and r["text"][:20]) for r in held.collect())
    assert texts == {(1, "another text of one"): 1, (2, "first text of one"): 1, (None, "no id at all"): 1, (4, ""): 1, (5, long[:20]): 1, (6, "six again"): 1, (7, "twice"): 2, (8, "one two " * 2 + "one "): 1}
    machine = pieces.Transducer(pieces.read_model())
    taken = {tuple(r["piece_ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert taken <= {tuple(machine.encode(t).tolist()) for _, t, *_ in rows}


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
    assert docs.count() > 0
