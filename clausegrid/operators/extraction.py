"""Obligations: sentence rules, template labels and validated model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import first_per_key


def split_sentences(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) → one row per sentence with its offset; the pieces cover the text."""
    return texts.select(*keys, F.inline(T.sentences(F.col("text")))).withColumnRenamed("piece", "sentence")


def extract_obligations(
    paragraphs: DataFrame,
    keys: list[str],
    modals: tuple[str, ...] = K.MODALS,
    excluded: str | None = K.NO_REQUIREMENT,
    max_actor_words: int = K.MAX_ACTOR_WORDS,
) -> DataFrame:
    """One row per modal sentence with a named actor; offsets are relative to ``text``.

    A sentence is read in the row of its paragraph, so every part of it is worked out once.
    """
    modal = r"\b(" + "|".join(modals) + r")\b"
    if all(word[:1].isalpha() for word in modals):
        modal = T.at_first("".join(sorted({word[0] for word in modals})), modal)
    through = T.U + r"(?s)^.*?" + modal
    no_requirement = None
    if excluded:
        no_requirement = T.U + (T.at_first(K.NO_REQUIREMENT_FIRST, excluded) if excluded == K.NO_REQUIREMENT else excluded)

    def read(sentence: Column) -> Column:
        piece = sentence["piece"]
        marker = F.length(F.regexp_extract(piece, T.U + K.ENUMERATOR, 0))
        return T.bound(marker, lambda n: T.bound(T.rstrip(F.substring(piece, n + 1, F.length(piece))), lambda body: stated(body, sentence["start"] + n)))

    def stated(body: Column, start: Column) -> Column:
        head = F.struct(F.regexp_extract(body, through, 0).alias("all"), F.regexp_extract(body, through, 1).alias("modality"))
        required = F.lit(True) if no_requirement is None else ~body.rlike(no_requirement)
        return T.bound(head, lambda h: F.when((h["modality"] != "") & required, parted(body, start, h)))

    def parted(body: Column, start: Column, head: Column) -> Column:
        size = F.length(head["all"])
        tail = T.strip(F.substring(body, size + 1, F.length(body)))
        return F.struct(
            F.rtrim(body, F.lit(";")).alias("text"),
            T.strip(F.substring(body, F.lit(1), size - F.length(head["modality"]))).alias("actor"),
            T.rstrip(F.rtrim(tail, F.lit(".;"))).alias("action"),
            head["modality"].alias("modality"),
            start.alias("char_start"),
        )

    words = F.size(F.split(T.squeeze(F.col("actor")), " "))
    return (
        paragraphs.select(*keys, F.inline(F.filter(F.transform(T.sentences(F.col("text")), read), lambda o: o.isNotNull())))
        .where((F.col("actor") != "") & (words <= max_actor_words) & (F.length("action") >= K.MIN_ACTION_CHARS))
        .withColumn("char_end", F.col("char_start") + F.length("text"))
    )


def dedupe_spans(extracted: DataFrame, extractor: str = K.EXTRACTOR_NAME) -> DataFrame:
    """First obligation per (circular_id, start, end) in paragraph order; offsets become absolute.

    Input: circular_id, order_index, base_offset and the columns of ``extract_obligations``.
    """
    moved = extracted.withColumns(
        {
            "char_start": F.col("base_offset") + F.col("char_start"),
            "char_end": F.col("base_offset") + F.col("char_end"),
            "extractor": F.lit(extractor),
        }
    ).drop("base_offset")
    return first_per_key(
        moved, ["circular_id", "char_start", "char_end"], [F.col("order_index").asc(), F.col("text").asc()]
    )


OBLIGATION_ANSWER = S.ArrayType(
    S.StructType(
        [
            S.StructField("text", S.StringType()),
            S.StructField("actor", S.StringType()),
            S.StructField("action", S.StringType()),
            S.StructField("modality", S.StringType()),
            S.StructField("confidence", S.DoubleType()),
        ]
    )
)


def unfence(answer: Column) -> Column:
    """JSON text of an answer, with or without a code fence around it."""

    def opened(body: Column) -> Column:
        bare = F.regexp_replace(body, "^`+|`+$", "")
        cut = F.when(F.instr(bare, "\n") > 0, F.regexp_replace(bare, r"(?s)^[^\n]*\n", "")).otherwise(bare)
        return F.when(body.startswith("```"), cut).otherwise(body)

    return T.bound(T.strip(answer), opened)


def validate_extractions(answers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Model answers (keys, answer, source, base_offset, tokens_in, tokens_out, cost_usd).

    Returns the accepted obligations with absolute spans, and one report row per key group:
    malformed answers, accepted and dropped items, token sums and the cost, unknown as soon as
    one call has no price.
    """
    wrapper = S.StructType([S.StructField("obligations", OBLIGATION_ANSWER)])
    item_ok = lambda o: (
        (F.length(o["text"]) >= K.MIN_OBLIGATION_CHARS)
        & (o["modality"].isNull() | o["modality"].isin(*K.MODALS))
        & (o["confidence"].isNull() | o["confidence"].between(0.0, 1.0))
    )

    def located(o: Column) -> Column:
        fields = [o[name].alias(name) for name in OBLIGATION_ANSWER.elementType.names]
        return F.struct(*fields, T.resolve_quote(o["text"], F.col("source")).alias("__span"))

    def judged(doc: Column) -> Column:
        shaped = doc["obligations"].isNotNull() & F.forall(doc["obligations"], lambda o: F.coalesce(item_ok(o), F.lit(False)))
        return F.when(shaped, F.transform(doc["obligations"], located))

    # An answer is read, and each of its quotes looked for, once: a filter over these columns would do it all again.
    items = T.bound(F.from_json(unfence(F.col("answer")), wrapper), judged)
    kept = F.filter(items, lambda o: o["__span"].isNotNull())
    accepted = answers.select(*keys, "base_offset", F.inline(kept)).select(
        *keys,
        T.strip(F.col("text")).alias("text"),
        "actor",
        "action",
        "modality",
        "confidence",
        (F.col("base_offset") + F.col("__span.start")).alias("char_start"),
        (F.col("base_offset") + F.col("__span.end")).alias("char_end"),
    )
    sized = lambda found: F.struct(
        F.size(found).alias("n"), F.size(F.filter(found, lambda o: o["__span"].isNull())).alias("lost")
    )
    counted = answers.select(
        "tokens_in", "tokens_out", "cost_usd", T.bound(items, lambda found: F.when(found.isNotNull(), sized(found))).alias("__found")
    )
    lost = F.coalesce(F.col("__found.lost"), F.lit(0))
    report = counted.agg(
        F.count("*").alias("answers"),
        F.count_if(F.col("__found").isNull()).alias("malformed"),
        F.sum(F.coalesce(F.col("__found.n"), F.lit(0)) - lost).alias("accepted"),
        F.sum(lost).cast("long").alias("dropped"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("cost_usd"),
    )
    return accepted, report


def label_by_templates(texts: DataFrame, keys: list[str], templates: list[str]) -> DataFrame:
    """Every match of the given sentence templates with the actor before its modal and its span.

    Templates are a bounded list of patterns given by the caller; ``{n}`` stands for a number
    and a blank for any white space.
    """
    actor = T.strip(
        F.regexp_extract("text", r"(?U)^(.{3,60}?)\s+(?:shall|must|may|should)\b", 1)
    )
    found = None
    for template in templates:
        pattern = template_pattern(template)
        hits = texts.select(*keys, F.inline(T.matches_with_offsets(F.col("text"), pattern)))
        found = hits if found is None else found.unionByName(hits)
    named = found.withColumnRenamed("piece", "text").withColumn("actor", actor)
    return named.where(F.col("actor") != "").select(
        *keys,
        "text",
        "actor",
        F.col("start").alias("char_start"),
        (F.col("start") + F.length("text")).alias("char_end"),
    )


def template_pattern(template: str) -> str:
    out = []
    for piece in template.split("{n}"):
        out.append(r"\s+".join(_quoted(w) for w in piece.split(" ")))
    return r"\d+".join(out)


def _quoted(word: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in word)
