"""The queries op1 to op13 and the pipeline, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, decontaminate, html_text, neighbours, quality, repeats, secrets, sharding, simhash, spelling, token_counts, warc
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

RANKS = "byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp", "root")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distances as whole millionths, which compare exactly; -1 where a guard held
    ppm = lambda c: F.coalesce(F.round(F.col(c) * 1_000_000).cast("long"), F.lit(-1).cast("long")).alias(f"{c}_ppm")
    judged = quality.quality(table(spark, sf_dir, "documents"))
    distances = ("class_distance", "word_distance")
    return judged.select(*[c for c in judged.columns if c not in distances], *[ppm(c) for c in distances])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(
        table(spark, sf_dir, "documents"), sharding.even_tree(40), sharding.even_tree(41)
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip_documents(table(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secret_scans,
        op3_decontamination,
        op4_simhash,
        op5_quality,
        op6_warc,
        op7_sharding,
        op8_bpe,
        op9_html,
        op10_suffix_dedup,
        op11_spelling_variants,
        op12_nearest_neighbours,
        op13_conversation_trie,
    )
}
