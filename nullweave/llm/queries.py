"""The thin opN queries over the driver's tables; each calls its operator with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, decontaminate, html, langid, minhash, oracles, quality, substring, token_counts, token_ids
from .common import crc_mod, plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = plain(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    weights = quality.train(documents.where(~held_out), table(spark, sf_dir, "labels"))
    scored = quality.score(documents, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = plain(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    models = langid.train(documents, ~held_out)
    found = langid.predict(documents.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digests(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, end_id=0)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_html_text, op3_quality, op4_near_duplicates, op5_language, op6_top_k, op7_token_ids, op8_substrings, op9_token_counts, op10_decontamination)}
ORACLE = {
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op6_top_k": oracles.TOP_K,
    "op8_substrings": oracles.SUBSTRINGS,
    "op10_decontamination": oracles.DECONTAMINATION,
}
