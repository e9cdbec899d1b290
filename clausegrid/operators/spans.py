"""Spans: quotes to positions, texts at positions, highlighted segments, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


def resolve_quotes(rows: DataFrame) -> DataFrame:
    """(…, quote, source, base_offset) → char_start, char_end in the source's coordinates."""
    located = rows.withColumn("__span", T.resolve_quote(F.col("quote"), F.col("source")))
    return located.select(
        *rows.columns,
        (F.col("base_offset") + F.col("__span.start")).alias("char_start"),
        (F.col("base_offset") + F.col("__span.end")).alias("char_end"),
    )


def span_within(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    return (outer_start <= start) & (start < end) & (end <= outer_end)


def span_text(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, paragraph_id, char_start, char_end) → the text at the offsets and its paragraph's bounds.

    A paragraph is a slice of its document's full text, so the paragraph alone answers and the
    full texts never move.
    """
    p = paragraphs.select(
        F.col("id").alias("paragraph_id"),
        F.col("text").alias("__text"),
        F.col("char_start").alias("paragraph_start"),
        F.col("char_end").alias("paragraph_end"),
    )
    joined = spans.join(p, "paragraph_id")
    return joined.select(
        "id",
        "paragraph_id",
        "paragraph_start",
        "paragraph_end",
        T.sliced(
            F.col("__text"),
            (F.col("char_start") - F.col("paragraph_start")).cast("int"),
            (F.col("char_end") - F.col("paragraph_start")).cast("int"),
        ).alias("span_text"),
        span_within(
            F.col("char_start"), F.col("char_end"), F.col("paragraph_start"), F.col("paragraph_end")
        ).alias("within"),
    )


def highlight_segments(texts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marked and unmarked segments of each text, and the spans that do not fit inside it.

    Inputs: (parent_id, text, text_start) and (parent_id, span_id, start, end), offsets absolute.
    Of the spans opening at one position only the shortest can be kept, so they are reduced to
    one per position before a parent's spans meet; their number is bounded by the text. Joins sort
    both sides: the frames of texts look small to the planner, but there are as many as texts.
    """
    frames = texts.select(
        "parent_id", "text_start", F.length("text").alias("size"), F.col("text").alias("__text")
    )
    opened = spans.where("start < end").groupBy("parent_id", "start").agg(F.min(F.struct("end", "span_id")).alias("best"))

    def local(rows: DataFrame, end: str, span_id: str) -> DataFrame:
        return rows.join(frames.drop("__text").hint("merge"), "parent_id").select(
            "parent_id",
            F.col(span_id).alias("span_id"),
            (F.col("start") - F.col("text_start")).cast("int").alias("s"),
            (F.col(end) - F.col("text_start")).cast("int").alias("e"),
            "size",
        )

    fits = (F.col("s") >= 0) & (F.col("e") <= F.col("size")) & (F.col("s") < F.col("e"))
    outside = local(spans, "end", "span_id").where(~fits).select("parent_id", "span_id")
    shortest = (
        local(opened, "best.end", "best.span_id")
        .where(fits)
        .groupBy("parent_id")
        .agg(F.array_sort(F.collect_list(F.struct("s", "e", "span_id"))).alias("spans"))
    )
    joined = frames.join(shortest.hint("merge"), "parent_id", "left").withColumn(
        "spans",
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int,span_id:string>>")),
    )
    empty = F.array().cast("array<struct<s:int,e:int,span_id:string>>")
    piece = lambda s, e, i: F.struct(
        s.cast("int").alias("s"), e.cast("int").alias("e"), i.cast("string").alias("span_id")
    )
    none = F.lit(None).cast("string")

    def step(acc, span):
        before = F.when(
            span["s"] > acc["at"], F.array(piece(acc["at"], span["s"], none))
        ).otherwise(empty)
        taken = F.concat(acc["out"], before, F.array(piece(span["s"], span["e"], span["span_id"])))
        keep = span["s"] >= acc["at"]
        return F.struct(
            F.when(keep, span["e"]).otherwise(acc["at"]).alias("at"),
            F.when(keep, taken).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    walked = F.aggregate("spans", zero, step)
    rest = F.when(
        walked["at"] < F.col("size"), F.array(piece(walked["at"], F.col("size"), none))
    ).otherwise(empty)
    segments = joined.select(
        "parent_id", "__text", F.posexplode(F.concat(walked["out"], rest)).alias("segment", "p")
    )
    return (
        segments.select(
            "parent_id",
            "segment",
            T.sliced(F.col("__text"), F.col("p.s"), F.col("p.e")).alias("text"),
            F.col("p.span_id").alias("span_id"),
        ),
        outside,
    )


def check_constraints(
    circulars: DataFrame,
    paragraphs: DataFrame,
    obligations: DataFrame,
    clauses: DataFrame,
    citations: DataFrame | None = None,
    supersessions: DataFrame | None = None,
    assessments: DataFrame | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """One row per violated rule and offending key; an empty result means the tables are sound.

    Tables that are not given are not checked.
    """

    def bad(rule: str, rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))

    def repeated(rule: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return bad(rule, twice, F.concat_ws("|", *keys))

    spans = [
        bad(f"{name}: span is empty or reversed", df.where("char_end <= char_start"), F.col("id"))
        for name, df in (("paragraph", paragraphs), ("obligation", obligations), ("clause", clauses))
    ]
    inside = obligations.alias("o").join(
        paragraphs.select(
            F.col("id").alias("paragraph_id"),
            F.col("char_start").alias("ps"),
            F.col("char_end").alias("pe"),
            F.col("text").alias("ptext"),
        ),
        "paragraph_id",
    )
    sliced = T.sliced(
        F.col("ptext"),
        (F.col("char_start") - F.col("ps")).cast("int"),
        (F.col("char_end") - F.col("ps")).cast("int"),
    )
    checks = spans + [
        repeated("circular number is not unique", circulars, ["circular_number"]),
        repeated("obligation span is not unique", obligations, ["circular_id", "char_start", "char_end"]),
        repeated("clause number is not unique in its pack", clauses, ["policy_pack_id", "clause_number"]),
        bad("paragraph text does not fill its span", paragraphs.where("length(text) <> char_end - char_start"), F.col("id")),
        bad("obligation lies outside its paragraph", inside.where("char_start < ps OR char_end > pe"), F.col("id")),
        bad("obligation text differs from its slice", inside.where(sliced != F.col("text")), F.col("id")),
        bad(
            "extraction method is unknown",
            paragraphs.where(~F.col("extraction_method").isin(*K.EXTRACTION_METHODS)),
            F.col("id"),
        ),
    ]
    for what, df, column, allowed in (
        ("resolution method", citations, "resolution_method", K.RESOLUTION_METHODS),
        ("supersession type", supersessions, "supersession_type", K.SUPERSESSION_TYPES),
        ("assessment status", assessments, "status", K.ASSESSMENT_STATUSES),
        ("step status", steps, "status", K.STEP_STATUSES),
    ):
        if df is not None:
            known = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
            checks.append(bad(f"{what} is unknown", df.where(~known), F.col("id")))
    if steps is not None:
        checks.append(repeated("step sequence is not unique in its run", steps, ["run_id", "seq"]))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out
