"""From raw documents to token ids: five stages, each over all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

* toxicity: documents predicted to be toxic go; the labels of sf_dir teach the models.
* exact_dedup: of equal texts (A-Z lower-cased) the one with the largest doc_id stays.
* ngram_jaccard: of each group of near copies (shingles of five words, similarity 0.8 or more) the one with the least
  doc_id stays.
* source_mixing: documents are taken so often that the words of the sources meet their targets; a document that is
  taken twice is two rows.
* sentence_pieces: the ids of each row's text.

Odd rows. Null and empty texts pass the first stage (no model finds them toxic), are exact copies of one another, so that
the one with the largest doc_id stays, are near copies of none, have no words that a mix could take, and so end there.
Rows without a doc_id are documents like others: of exact copies one with an id stays, else all of them do; each is taken
or left by itself in the mix, and has a null doc_id at the end. A doc_id with several texts is several documents, each judged
by its own text, and no text is lost with another of its id. Rows that repeat both are kept or dropped together, but for the
mix, which counts each. Ties are broken by doc_id. Empty tables give an empty result; without labels of both classes
nothing is toxic. Further columns are carried along to the mix, whatever their names; tables with the columns of
documents are expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from quillon.llm.shared import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentence_pieces", encode),
]

#: Toxicity and pieces have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch.of_a_stage():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
