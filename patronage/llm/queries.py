"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import ann, bpe, language, lines, packing, personal, simhash, spelling, tokens, topk, toxicity, turns, urls
from patronage.llm.common import crc32_mod, read

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = toxicity.train(docs, labels.where(crc32_mod("doc_id", 3) != 1))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op2_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(crc32_mod("doc_id", 4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split("text", "\n", -1))
    done = lines.deduplicate_lines(docs, removed="removed", shortest=1)
    kept = F.when(F.col("text").isNotNull(), n_lines).otherwise(0)
    return done.select("doc_id", kept.alias("kept_lines"), "removed", F.sha2("text", 256).alias("text_sha256"), "text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORDS)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(spark, read(spark, sf_dir, "documents"), WORDS)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), BYTES, digest=True)


def op7_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op9_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), damage=31)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_digest(read(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return personal.digest(docs, personal.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_compression_toxicity, op2_hierarchical_language, op3_line_dedup, op4_best_fit_packing, op5_token_files, op6_bpe_round_trip,
        op7_collision_neighbours, op8_url_templates, op9_dual_tree_top_k, op10_simhash_near_dedup,
        op11_spelling_variants, op12_conversation_repair, op13_personal_data,
    )
}
SQL: dict[str, str] = {"op8_url_templates": urls.SQL, "op9_dual_tree_top_k": topk.SQL}
