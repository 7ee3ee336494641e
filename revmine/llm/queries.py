"""The registered queries of the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classlm, exact, idfile, mixing, ogg, quality, simhash, unigram, warc
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.label(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(table(spark, sf_dir, "documents")).drop("first_ids")


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_warc_round_trip, op3_simhash_near_dedup, op4_bpe_round_trip, op5_token_counts, op6_exact_dedup, op7_source_mixing, op8_class_lm, op9_token_file, op10_ogg_media)}
ORACLES = {"op6_exact_dedup": exact.ORACLE, "op7_source_mixing": mixing.ORACLE}
