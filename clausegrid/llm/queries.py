"""The queries of the training-data operators on the given tables, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import bpe, caps, lengths, licences, mixing, ngram_join, passages, pii, quality, repair, repetition, secret_scan, warc
from clausegrid.llm.common import stored, table


#: The vocabulary file; it must be readable under this path on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), VOCABULARY)


def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess_quality(table(spark, folder, "documents"))


def op3_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    counted = lengths.encoded_lengths(table(spark, folder, "documents"), VOCABULARY, ("source",))
    # Written once: the sums look at it twice, and the texts should be encoded once.
    histogram = stored(lengths.length_histogram(counted, ("source",)), "length-histogram")
    return lengths.context_totals(histogram, ("source",))


def op4_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op5_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_vectors(table(spark, folder, "embeddings"))


def op6_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived_pages(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op8_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_licence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences.recognise(table(spark, folder, "documents"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_report(table(spark, folder, "conversations"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = repetition.with_planted_runs(table(spark, folder, "documents"))
    return repetition.run_digest(repetition.find_runs(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_robust_outliers,
        op3_length_histogram,
        op4_compact_windows,
        op5_cap_filters,
        op6_warc_salvage,
        op7_mix_sources,
        op8_secret_forest,
        op9_licence_rules,
        op10_ngram_jaccard,
        op11_personal_data,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}
ORACLE = {
    "op6_warc_salvage": warc.SQL,
    "op7_mix_sources": mixing.SQL,
    "op9_licence_rules": licences.check_sql(),
    "op11_personal_data": pii.check_sql(),
    "op12_conversation_repair": repair.check_sql(),
    "op13_periodic_runs": repetition.check_sql(),
}
