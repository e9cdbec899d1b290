"""Pages to paragraphs with exact offsets, full texts, page routing and chunks.

Windows and groups here run inside one document, which arrived as a few text values and is
bounded by them; all of them share one exchange on the document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


def route_pages(
    pages: DataFrame,
    quality_threshold: float = K.TEXT_QUALITY_THRESHOLD,
    table_share: float = K.TABLE_DOMINANT_SHARE,
) -> DataFrame:
    """(doc_id, page_number, chars, width, height, table_area) → quality, table share, needs_vision."""
    inches = F.greatest(
        (F.col("width") / K.POINTS_PER_INCH) * (F.col("height") / K.POINTS_PER_INCH), F.lit(1e-6)
    )
    area = F.col("width") * F.col("height")
    quality = F.least(F.lit(1.0), F.col("chars") / inches / K.FULL_DENSITY_CHARS_PER_SQIN)
    tables = F.when(area > 0, F.least(F.lit(1.0), F.col("table_area") / area)).otherwise(0.0)
    return pages.withColumns({"quality": quality, "table_ratio": tables}).withColumn(
        "needs_vision",
        (F.col("quality") < quality_threshold) | (F.col("table_ratio") >= table_share),
    )


def vision_share(routed: DataFrame, keys: list[str]) -> DataFrame:
    return routed.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.count_if("needs_vision").alias("vision_pages"),
        (F.count_if("needs_vision") / F.count("*")).alias("vision_fraction"),
    )


def resolve_page_text(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A usable transcript of a page that needs vision wins; otherwise the embedded text is kept."""
    keys = ["doc_id", "page_number"]
    told = transcripts.select(*keys, T.blank_to_null(T.strip("transcript")).alias("__told"))
    joined = pages.join(told, keys, "left")
    use = F.col("needs_vision") & F.col("__told").isNotNull()
    return joined.select(
        *[c for c in pages.columns if c != "text"],
        F.when(use, F.col("__told")).otherwise(F.col("text")).alias("text"),
        F.when(use, "vision").otherwise("text").alias("extraction_method"),
    )


def split_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) → one row per block: (doc_id, page_number, block, text)."""
    pages = pages.repartition("doc_id")
    page = W.partitionBy("doc_id", "page_number").orderBy("line_no")
    lines = pages.select(
        "doc_id",
        "page_number",
        F.posexplode(F.split(T.normalise_text(F.col("text")), "\n")).alias("line_no", "line"),
    )
    line = F.col("line")
    flagged = lines.withColumns(
        {
            "is_table": T.found(line, K.TABLE_LINE),
            "is_blank": T.strip(line) == "",
            "opens": T.found(line, K.NUMBERED_START) | T.found(line, K.HEADING_LINE),
        }
    )
    was_table = F.lag("is_table", 1, False).over(page)
    starts = (F.col("is_table") != was_table) | (
        ~F.col("is_table") & (F.col("is_blank") | F.col("opens"))
    )
    numbered = flagged.withColumn("starts", starts).withColumn(
        "block", F.sum(F.col("starts").cast("int")).over(page)
    )
    blocks = (
        numbered.where(~F.col("is_blank"))
        .groupBy("doc_id", "page_number", "block")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    )
    text = T.strip(F.array_join(F.col("lines.line"), "\n"))
    return blocks.select("doc_id", "page_number", "block", text.alias("text")).where(F.col("text") != "")


def segment_corpus(pages: DataFrame) -> DataFrame:
    """Pages → paragraphs: number, heading in force across pages, offsets into the full text."""
    head = T.first_line(F.col("text"))
    is_heading = T.found(head, K.HEADING_LINE) & ~F.contains(F.col("text"), F.lit("|"))
    order = W.partitionBy("doc_id").orderBy("page_number", "block")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("text")
    gap = len(K.PARAGRAPH_SEPARATOR)
    placed = split_blocks(pages).withColumns(
        {
            "order_index": F.row_number().over(order) - 1,
            "para_number": T.para_number(head),
            "heading_path": F.last(F.when(is_heading, T.strip(head)), ignorenulls=True).over(upto),
            "through": F.sum(size + gap).over(upto),
        }
    )
    return placed.select(
        "doc_id",
        "order_index",
        "para_number",
        "heading_path",
        "text",
        (F.col("through") - gap - size).alias("char_start"),
        (F.col("through") - gap).alias("char_end"),
        "page_number",
    )


def place_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, text) → non-blank lines as paragraphs with offsets, for texts without markers."""
    lines = texts.repartition("doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    order = W.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = len(K.PARAGRAPH_SEPARATOR)
    kept = lines.select("doc_id", "line_no", T.strip(F.col("line")).alias("text")).where(
        F.col("text") != ""
    )
    through = F.sum(F.length("text") + gap).over(upto)
    return kept.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("order_index"),
        "text",
        (through - gap - F.length("text")).alias("char_start"),
        (through - gap).alias("char_end"),
        F.lit(None).cast("string").alias("heading_path"),
    )


def assemble_full_text(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ordered paragraphs joined by a blank line; the offsets above index this string."""
    return paragraphs.groupBy(key).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("order_index", "text")))["text"],
            K.PARAGRAPH_SEPARATOR,
        ).alias("full_text")
    )


def chunk_paragraphs(
    paragraphs: DataFrame,
    target_tokens: int = K.CHUNK_TARGET_TOKENS,
    overlap_tokens: int = K.CHUNK_OVERLAP_TOKENS,
) -> DataFrame:
    """Whole paragraphs grouped up to a token target, with a trailing overlap.

    A document's paragraphs meet in one row, and everything else happens there. Which paragraphs a chunk holds
    follows from the first *new* one p alone: it begins with as many before p as the overlap takes, no
    further back than the last paragraph that filled a chunk by itself, and ends before the target is passed. Both
    ends are searched in the running token sums. So p also knows the next chunk's first new paragraph, and
    the chunks are the paragraphs reached from the first one by these pointers.
    """
    place = F.struct(
        F.col("order_index").cast("long").alias("order_index"), "text", "char_start", "char_end", "heading_path",
        T.estimate_tokens(F.col("text")).alias("tokens"),
    )
    documents = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("p"))
    bounds = _chunk_bounds(F.col("p.tokens"), target_tokens, overlap_tokens)
    chunks = documents.select("doc_id", "p", F.posexplode(bounds).alias("order_index", "b"))
    held = F.slice("p", F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1)
    rows = chunks.select("doc_id", "order_index", held.alias("p"))
    text = F.array_join("p.text", K.PARAGRAPH_SEPARATOR)
    return rows.select(
        "doc_id",
        F.col("order_index").cast("int").alias("order_index"),
        text.alias("text"),
        F.array_min("p.char_start").alias("char_start"),
        F.array_max("p.char_end").alias("char_end"),
        T.estimate_tokens(text).alias("token_count"),
        F.element_at("p", 1)["heading_path"].alias("heading_path"),
        F.element_at("p", 1)["order_index"].alias("first_paragraph"),
        F.element_at("p", -1)["order_index"].alias("last_paragraph"),
    )


#: Doublings of the chunk list: two chunks hold more than a target of tokens together, so a document of the
#: largest text a row can hold has fewer than 2 ** 22 chunks.
DOUBLINGS = 22


def _chunk_bounds(tokens: Column, target: int, overlap: int) -> Column:
    """(first, last) paragraph of each chunk in order, from the token counts of a document's paragraphs."""

    def pointers(n: Column) -> Column:
        """For every paragraph as the first new one: the chunk's bounds, and the next first new one."""
        large = F.filter(F.transform(n["tokens"], lambda t, i: F.when(t >= target, i)), lambda i: i.isNotNull())

        def of(m: Column) -> Column:
            through = lambda i: F.coalesce(F.get(m["through"], i), F.lit(0))

            def bounds(t: Column, p: Column) -> Column:
                fresh = F.coalesce(F.get(m["large"], T.count_below(m["large"], p) - 1) + 1, F.lit(0))
                # The first s whose sum of what stands before it is at least that before p less the overlap.
                back = through(p - 1) - overlap
                first = F.when(back <= 0, F.lit(0)).otherwise(T.count_below(m["through"], back) + 1)
                return T.bound(
                    F.greatest(fresh, F.least(first, p)),
                    lambda s: F.struct(
                        s.alias("first"),
                        F.when(t >= target, p)
                        .otherwise(F.greatest(p, T.count_below(m["through"], through(s - 1) + target + 1) - 1))
                        .alias("last"),
                    ),
                )

            return F.transform(n["tokens"], bounds)

        return T.bound(F.struct(large.alias("large"), n["through"].alias("through")), of)

    def chained(b: Column) -> Column:
        follow = F.transform(b, lambda x: F.when(x["last"] + 1 < F.size(b), x["last"] + 1))

        def doubled(state: Column, left: int) -> Column:
            further = F.filter(F.transform(state["starts"], lambda i: F.get(state["jump"], i)), lambda i: i.isNotNull())
            starts = F.concat(state["starts"], further)
            if left == 1:
                return starts
            jump = F.transform(state["jump"], lambda j: F.get(state["jump"], j))
            more = T.bound(F.struct(starts.alias("starts"), jump.alias("jump")), lambda next_: doubled(next_, left - 1))
            return F.when(F.get(state["jump"], F.element_at(state["starts"], -1)).isNull(), starts).otherwise(more)

        first = F.struct(F.array(F.lit(0)).alias("starts"), follow.alias("jump"))
        starts = T.bound(first, lambda state: doubled(state, DOUBLINGS))
        return F.transform(starts, lambda i: F.get(b, i))

    numbers = F.struct(tokens.alias("tokens"), T.running_sums(tokens).alias("through"))
    return T.bound(T.bound(numbers, pointers), chained)
