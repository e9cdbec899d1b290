"""Cross-document references, dated phrases and supersession cues of whole paragraph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


def find_references(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, char_start) → raw reference, key and absolute span; no shuffle."""
    # Every reference has one of these; most texts have neither and need no pattern.
    likely = F.contains("text", F.lit("/")) | F.contains("text", F.lit("-"))
    hits = paragraphs.where(likely).select(
        *keys,
        F.col("char_start").alias("__base"),
        F.inline(T.matches_with_offsets(F.col("text"), K.REFERENCE)),
    )
    return hits.select(
        *keys,
        F.col("piece").alias("raw_reference"),
        T.normalise_reference(F.col("piece")).alias("normalised_reference"),
        (F.col("__base") + F.col("start")).alias("char_start"),
        (F.col("__base") + F.col("start") + F.length("piece")).alias("char_end"),
    )


def dated_phrases(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, char_start) → 'dated …' phrases with absolute span and the parsed date."""
    likely = F.contains(F.lower("text"), F.lit("dated"))
    hits = paragraphs.where(likely).select(
        *keys,
        F.col("char_start").alias("__base"),
        F.inline(T.matches_with_offsets(F.col("text"), K.DATED)),
    )
    token = F.regexp_extract("piece", T.U + K.DATED, 1)
    return hits.select(
        *keys,
        F.col("piece").alias("raw"),
        (F.col("__base") + F.col("start")).alias("char_start"),
        (F.col("__base") + F.col("start") + F.length("piece")).alias("char_end"),
        T.parse_date_token(token).alias("parsed"),
    )


def supersession_cues(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("cue", T.supersession_cue(F.col("text")))
