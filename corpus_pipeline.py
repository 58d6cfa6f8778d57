"""A corpus from raw documents to sampled pieces: toxic documents go, one of each group of near duplicates stays, documents that
overlap the benchmark go, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonestudy.llm import decontaminate, ngram_join, pieces, toxicity
from zonestudy.llm.shared import written

#: File of the piece vocabulary, readable at this path on every machine.
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score by a model of the labels is below 0.7, with all their columns.

    Null and empty texts have the score of a document without words and stay; repeated rows are judged one by one; without labels of both kinds,
    or without documents, nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, with all its columns.

    Null and empty texts are linked with nothing and stay. Rows of one doc_id go by their own texts. A row with a null doc_id goes where a document with an
    id is in its group; of a group without ids one row stays. No rows give no rows."""
    return ngram_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns.

    Null and empty texts overlap nothing and stay; repeated rows are judged one by one; without items nothing goes; no rows give no rows."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, with doc_id, the number of ids and what decoding them gave; no other columns.

    Null and empty texts have no ids; a null doc_id draws as 0; repeated rows stay; no rows give no rows."""
    return pieces.encode_documents(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained model and sampled segmentations aren't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
