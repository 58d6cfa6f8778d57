"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestudy.llm import bitpack, capfilter, chat, decontaminate, licenses, merkle, ngram_join, pieces, runs, sharding, toxicity, url_filter, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(_table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_documents(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(_table(spark, sf_dir, "documents"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_toxicity,
        op3_ngram_jaccard_join,
        op4_sentencepiece,
        op5_benchmark_decontamination,
        op6_token_id_output,
        op7_sharding,
        op8_chat_formatting,
        op9_license_scan,
        op10_url_filters,
        op11_merkle_manifest,
        op12_periodic_runs,
        op13_embedding_near_dedup,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_nearest_neighbours": vptree.ORACLE,
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_periodic_runs": runs.ORACLE,
    "op13_embedding_near_dedup": capfilter.ORACLE,
}
