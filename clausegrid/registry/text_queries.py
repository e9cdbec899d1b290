"""Text preparation and extraction over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import extraction as X
from clausegrid.operators import references as R
from clausegrid.operators import segmentation as G
from clausegrid.operators import policy as P
from clausegrid.operators import spans as N
from clausegrid.plans.corpora import Corpora
from clausegrid.registry.core import query
from clausegrid.registry.shared_sql import terms_sql


@query("normalise_text", "SELECT * FROM clean_pages")
def _(c: Corpora):
    return c.circular_pages.withColumn("text", T.normalise_text(F.col("text")))


@query("split_blocks", "SELECT doc_id, page_number, CAST(block AS BIGINT) AS block, text FROM page_blocks")
def _(c: Corpora):
    return G.split_blocks(c.circular_pages)


@query(
    "para_number",
    "SELECT doc_id, order_index, para_number FROM page_paragraphs WHERE para_number IS NOT NULL",
)
def _(c: Corpora):
    return (
        G.segment_corpus(c.circular_pages)
        .where(F.col("para_number").isNotNull())
        .select("doc_id", "order_index", "para_number")
    )


@query("heading_path", "SELECT doc_id, order_index, heading_path FROM page_paragraphs")
def _(c: Corpora):
    return G.segment_corpus(c.circular_pages).select("doc_id", "order_index", "heading_path")


@query(
    "paragraph_offsets",
    "SELECT doc_id, order_index, para_number, heading_path, text, char_start, char_end, page_number FROM page_paragraphs",
)
def _(c: Corpora):
    return G.segment_corpus(c.circular_pages)


@query(
    "assemble_full_text",
    """SELECT doc_id, length(t) AS chars, sha256(t) AS digest
FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY order_index) AS t FROM page_paragraphs GROUP BY 1)""",
)
def _(c: Corpora):
    full = G.assemble_full_text(G.segment_corpus(c.circular_pages))
    return full.select(
        "doc_id", F.length("full_text").alias("chars"), F.sha2("full_text", 256).alias("digest")
    )


def _page_measures(c: Corpora):
    plain = F.regexp_replace("html", "<[^>]*>", "")
    return c.pages.select(
        F.col("page_id").alias("doc_id"),
        F.lit(1).alias("page_number"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        F.length(F.trim(plain)).alias("chars"),
        (F.length("url") * 72.0).alias("width"),
        F.lit(792.0).alias("height"),
        ((F.length("html") - F.length(plain)) * 72.0).alias("table_area"),
    )


_ROUTED = """SELECT doc_id, host, round(quality, 6) AS quality, round(table_ratio, 6) AS table_ratio,
  quality < 0.15 OR table_ratio >= 0.40 AS needs_vision
FROM (SELECT page_id AS doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  least(1.0, length(trim(plain)) / (length(url) * 11.0::DOUBLE) / 5.0) AS quality,
  least(1.0, (length(html) - length(plain)) * 72.0::DOUBLE / (length(url) * 72.0 * 792.0)) AS table_ratio
  FROM (SELECT *, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages))"""


@query("route_pages", _ROUTED)
def _(c: Corpora):
    return G.route_pages(_page_measures(c)).select(
        "doc_id",
        "host",
        F.round("quality", 6).alias("quality"),
        F.round("table_ratio", 6).alias("table_ratio"),
        "needs_vision",
    )


@query(
    "vision_share",
    f"""SELECT host, count(*) AS pages, count(*) FILTER (needs_vision) AS vision_pages,
  round(count(*) FILTER (needs_vision) / count(*), 6) AS vision_fraction FROM ({_ROUTED}) GROUP BY host""",
)
def _(c: Corpora):
    routed = G.route_pages(_page_measures(c))
    return G.vision_share(routed, ["host"]).withColumn(
        "vision_fraction", F.round("vision_fraction", 6)
    )


@query(
    "resolve_page_text",
    """SELECT d.doc_id // 8 AS doc_id, CAST(d.doc_id % 8 + 1 AS INT) AS page_number, n_chars < 200 AS needs_vision,
  CASE WHEN n_chars < 200 AND trim(t.text) <> '' THEN trim(t.text) ELSE d.text END AS text,
  CASE WHEN n_chars < 200 AND trim(t.text) <> '' THEN 'vision' ELSE 'text' END AS extraction_method
FROM documents d LEFT JOIN conversations t ON t.conv_id = d.doc_id // 8 AND t.turn = d.doc_id % 8""",
)
def _(c: Corpora):
    """Eight documents are the pages of one; every turn of a conversation is the transcript of a page."""
    page = (F.col("doc_id") % 8 + 1).cast("int").alias("page_number")
    pages = c.documents.select(F.expr("doc_id div 8").alias("doc_id"), page, "text", (F.col("n_chars") < 200).alias("needs_vision"))
    told = c.conversations.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("transcript")
    )
    return G.resolve_page_text(pages, told)


@query(
    "estimate_tokens",
    """SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INT)) AS tokens,
  greatest(1, CAST(round_even(length(source) / 4.0, 0) AS INT)) AS source_tokens FROM documents""",
)
def _(c: Corpora):
    return c.documents.select(
        "doc_id",
        T.estimate_tokens(F.col("text")).alias("tokens"),
        T.estimate_tokens(F.col("source")).alias("source_tokens"),
    )


_CHUNKS = """WITH RECURSIVE sized AS (
  SELECT doc_id, order_index AS i, tokens,
    CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY order_index) AS BIGINT) - tokens AS before
  FROM document_paragraphs),
ends AS (SELECT doc_id, max(i) AS last_i FROM sized GROUP BY 1),
walk AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS start_i, false AS emits, false AS closes,
    CAST(NULL AS BIGINT) AS out_start FROM ends
  UNION ALL
  SELECT w.doc_id, s.i,
    CASE WHEN s.tokens >= 400 THEN NULL
      WHEN w.start_i IS NULL THEN s.i
      WHEN s.before - b.before + s.tokens > 400 THEN coalesce((SELECT min(k.i) FROM sized k
        WHERE k.doc_id = s.doc_id AND k.i >= w.start_i AND k.i < s.i AND s.before - k.before <= 60), s.i)
      ELSE w.start_i END,
    w.start_i IS NOT NULL AND s.before - b.before + s.tokens > 400,
    s.tokens >= 400,
    CASE WHEN s.tokens >= 400 THEN
      CASE WHEN w.start_i IS NULL THEN s.i
        WHEN s.before - b.before + s.tokens > 400 THEN coalesce((SELECT min(k.i) FROM sized k
          WHERE k.doc_id = s.doc_id AND k.i >= w.start_i AND k.i < s.i AND s.before - k.before <= 60), s.i)
        ELSE w.start_i END END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1
  LEFT JOIN sized b ON b.doc_id = w.doc_id AND b.i = w.start_i),
bounds AS (
  SELECT w.doc_id, p.start_i AS first_paragraph, w.i - 1 AS last_paragraph
  FROM walk w JOIN walk p ON p.doc_id = w.doc_id AND p.i = w.i - 1 WHERE w.emits
  UNION ALL SELECT doc_id, out_start, i FROM walk WHERE closes
  UNION ALL SELECT w.doc_id, w.start_i, w.i FROM walk w JOIN ends e ON e.doc_id = w.doc_id AND e.last_i = w.i
    WHERE w.start_i IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY last_paragraph, first_paragraph) - 1 AS order_index,
  first_paragraph, last_paragraph, char_start, char_end, length(text) AS chars,
  greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INT)) AS token_count
FROM (SELECT b.doc_id, b.first_paragraph, b.last_paragraph, min(p.char_start) AS char_start,
    max(p.char_end) AS char_end, string_agg(p.text, chr(10) || chr(10) ORDER BY p.order_index) AS text
  FROM bounds b JOIN document_paragraphs p
    ON p.doc_id = b.doc_id AND p.order_index BETWEEN b.first_paragraph AND b.last_paragraph
  GROUP BY ALL)"""


@query("chunk_paragraphs", _CHUNKS)
def _(c: Corpora):
    return G.chunk_paragraphs(c.document_paragraphs).select(
        "doc_id",
        "order_index",
        "first_paragraph",
        "last_paragraph",
        "char_start",
        "char_end",
        F.length("text").alias("chars"),
        "token_count",
    )


_SENTENCES = """SELECT {keys}, CAST(sum(length(piece) + gap) OVER (PARTITION BY {keys} ORDER BY k)
    - length(piece) AS BIGINT) AS start, piece AS sentence
FROM (SELECT {keys}, k, regexp_replace(raw, '^\\s*' || chr(2), '') AS piece,
    CASE WHEN k = 0 THEN 0 ELSE length(regexp_extract(raw, '^(\\s*)' || chr(2), 1)) END AS gap
  FROM (SELECT {keys}, unnest(parts) AS raw, unnest(range(len(parts))) AS k
    FROM (SELECT {keys}, string_split(regexp_replace(text, '([.;])(\\s+)([A-Z(\\d])',
      '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS parts FROM {table})))"""


@query("split_sentences", _SENTENCES.format(keys="doc_id", table="documents"))
def _(c: Corpora):
    return X.split_sentences(c.documents, ["doc_id"]).withColumn("start", F.col("start").cast("long"))


#: The query's blanks: Unicode white space. DuckDB's trim takes spaces only and RE2's \\s is ASCII.
_BLANK_CODES = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
_BLANKS = "concat(" + ", ".join(f"chr({code})" for code in _BLANK_CODES) + ")"
_BLANK_RUN = "[" + "".join(f"\\x{{{code:X}}}" for code in _BLANK_CODES) + "]+"


def _obligation_sql(keys: str, table: str, modals: str, excluded: str) -> str:
    return f"""SELECT {keys}, regexp_replace(body, ';+$', '') AS text, actor, action, modality, char_start,
  char_start + length(regexp_replace(body, ';+$', '')) AS char_end
FROM (SELECT *, trim(hit.a, {_BLANKS}) AS actor, hit.m AS modality,
    rtrim(regexp_replace(trim(hit.b, {_BLANKS}), '[.;]+$', ''), {_BLANKS}) AS action
  FROM (SELECT *, regexp_extract(body,
      '(?s)^(.*?(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_]))({modals})([^\\p{{L}}\\p{{N}}\\p{{M}}_].*|)$', ['a', 'm', 'b']) AS hit
    FROM (SELECT {keys}, start + length(marker) AS char_start, rtrim(substr(sentence, length(marker) + 1), {_BLANKS}) AS body
      FROM (SELECT *, regexp_extract(sentence, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?|\\([a-z0-9]{{1,4}}\\))\\s+') AS marker
        FROM ({_SENTENCES.format(keys=keys, table=table)}))))
  WHERE hit.m <> '' {excluded})
WHERE actor <> '' AND len(regexp_split_to_array(actor, '{_BLANK_RUN}')) <= 8 AND length(action) >= 10"""


_EXCLUDED = """AND NOT regexp_matches(body, '(?i)(issued in exercise of powers|stand superseded|shall stand modified|read (?:this circular )?together with|continue to apply|shall come into force)')"""


@query("extract_obligations", _obligation_sql("id", "paragraphs", "shall|must|may|should", _EXCLUDED))
def _(c: Corpora):
    return X.extract_obligations(c.paragraphs.select("id", "text"), ["id"]).withColumns(
        {k: F.col(k).cast("long") for k in ("char_start", "char_end")}
    )


@query(
    "extract_by_connectives",
    _obligation_sql("doc_id", "documents", "the|la|que|und|de", "AND true"),
)
def _(c: Corpora):
    return X.extract_obligations(
        c.documents.select("doc_id", "text"), ["doc_id"], ("the", "la", "que", "und", "de"), None
    ).withColumns({k: F.col(k).cast("long") for k in ("char_start", "char_end")})


@query(
    "dedupe_spans",
    """SELECT circular_id, order_index, text, char_start, char_end, 'rules-v2' AS extractor
FROM (SELECT *, row_number() OVER (PARTITION BY circular_id, char_start, char_end ORDER BY order_index, text) AS k
  FROM (SELECT circular_id, order_index, p.char_start + d.s AS char_start, p.char_start + d.e AS char_end,
      substr(text, d.s + 1, d.e - d.s) AS text
    FROM (SELECT *, length(text) AS n FROM paragraphs) p,
    LATERAL (SELECT unnest([0, 0, 4, 0]) AS s, unnest([n, n, n, 9]) AS e) d)) WHERE k = 1""",
)
def _(c: Corpora):
    found = c.paragraphs.select(
        "circular_id",
        "order_index",
        F.col("char_start").alias("base_offset"),
        "text",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("s"), (F.length("text") if e is None else F.lit(e)).alias("e"))
                    for s, e in ((0, None), (0, None), (4, None), (0, 9))
                ]
            )
        ),
    )
    rows = found.select(
        "circular_id",
        "order_index",
        "base_offset",
        T.sliced(F.col("text"), F.col("s"), F.col("e")).alias("text"),
        F.col("s").cast("long").alias("char_start"),
        F.col("e").cast("long").alias("char_end"),
    )
    return X.dedupe_spans(rows)


def _answers(c: Corpora):
    """Model-like answers made from the obligation texts: some fenced, some broken, some misquoted."""
    quote = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit(" indeed"))).otherwise(F.col("text"))
    item = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    quote.alias("text"),
                    F.col("actor"),
                    F.lit("deliver").alias("action"),
                    F.when(F.col("id") % 7 == 0, "ought").otherwise("shall").alias("modality"),
                    F.lit(0.5).alias("confidence"),
                )
            ).alias("obligations")
        )
    )
    body = F.when(F.col("id") % 11 == 0, F.lit("no json")).otherwise(item)
    return c.obligations.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
        .alias("answer"),
        F.col("text").alias("source"),
        F.col("char_start").alias("base_offset"),
        F.length("text").alias("tokens_in"),
        F.lit(3).alias("tokens_out"),
        F.when(F.col("id") % 13 != 0, F.lit(0.25)).alias("cost_usd"),
    )


@query(
    "validate_extractions",
    """SELECT id, text, actor, 'deliver' AS action, 'shall' AS modality, 0.5::DOUBLE AS confidence,
  char_start, char_end FROM obligations WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0""",
)
def _(c: Corpora):
    return X.validate_extractions(_answers(c), ["id"])[0]


@query(
    "extraction_usage",
    """SELECT count(*) AS answers, count(*) FILTER (id % 7 = 0 OR id % 11 = 0) AS malformed,
  count(*) FILTER (id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0) AS accepted,
  count(*) FILTER (id % 5 = 0 AND id % 7 <> 0 AND id % 11 <> 0) AS dropped,
  CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(3) AS BIGINT) AS tokens_out,
  CASE WHEN count(*) FILTER (id % 13 = 0) = 0 THEN 0.25::DOUBLE * count(*) END AS cost_usd FROM obligations""",
)
def _(c: Corpora):
    return X.validate_extractions(_answers(c), ["id"])[1]


_REFERENCE_RE2 = (
    r"\b(?:SEBI(?:[/-][A-Za-z0-9][A-Za-z0-9&_.\-]*(?: [A-Z][A-Za-z]+)?){2,8}[/-]\d{1,10}"
    r"|CIR(?:[/-][A-Za-z0-9][A-Za-z0-9&_.\-]*(?: [A-Z][A-Za-z]+)?){1,6}[/-]\d{4}(?:[/-]\d{1,4})?"
    r"|(?:MRD2?|MIRSD|IMD|CFD|ISD|DDHS|OIAE|AFD|ITD|GSD|LAD(?:-NRO)?|DNPD|IVD|CDMRD)"
    r"(?:[/-][A-Za-z0-9][A-Za-z0-9&_.\-]*(?: [A-Z][A-Za-z]+)?){1,6}[/-]\d{4}(?:[/-]\d{1,4})?)"
)
_NORMALISED = (
    "trim(regexp_replace(replace(upper(regexp_replace(trim({x}), '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g')),"
    " '-', '/'), '/{{2,}}', '/', 'g'), '/')"
)


@query(
    "find_references",
    f"""SELECT id, raw_reference, {_NORMALISED.format(x='raw_reference')} AS normalised_reference,
  char_start + instr(text, raw_reference) - 1 AS char_start,
  char_start + instr(text, raw_reference) - 1 + length(raw_reference) AS char_end
FROM (SELECT id, text, char_start, unnest(regexp_extract_all(text, '{_REFERENCE_RE2}')) AS raw_reference FROM paragraphs)""",
)
def _(c: Corpora):
    return R.find_references(c.paragraphs, ["id"])


@query(
    "normalise_reference",
    f"""SELECT id, {_NORMALISED.format(x='raw')} AS normalised FROM (
  SELECT id, ' (' || lower(replace(circular_number, '/HO/', '-HO//')) || '/).; ' AS raw FROM circulars)""",
)
def _(c: Corpora):
    raw = F.concat(
        F.lit(" ("), F.lower(F.replace("circular_number", F.lit("/HO/"), F.lit("-HO//"))), F.lit("/).; ")
    )
    return c.circulars.select("id", T.normalise_reference(raw).alias("normalised"))


@query(
    "dated_phrases",
    """SELECT id, raw, char_start + instr(text, raw) - 1 AS char_start,
  char_start + instr(text, raw) - 1 + length(raw) AS char_end,
  CAST(strptime(replace(substr(raw, 7), ',', ''), '%B %d %Y') AS DATE) AS parsed
FROM (SELECT id, text, char_start, unnest(regexp_extract_all(text,
  '(?i)\\bdated\\s+(?:[A-Z][a-z]+\\s+\\d{1,2},?\\s+\\d{4}|\\d{1,2}\\s+[A-Z][a-z]+,?\\s+\\d{4}|\\d{1,2}[./-]\\d{1,2}[./-]\\d{4})')) AS raw
  FROM paragraphs)""",
)
def _(c: Corpora):
    return R.dated_phrases(c.paragraphs, ["id"])


@query(
    "parse_date_token",
    """SELECT id, CASE WHEN id % 6 = 5 THEN NULL ELSE issue_date END AS parsed FROM circulars""",
)
def _(c: Corpora):
    def shown(form: str):
        return F.date_format("issue_date", form)

    token = (
        F.when(F.col("id") % 6 == 0, shown("MMMM dd, yyyy"))
        .when(F.col("id") % 6 == 1, shown("d MMMM yyyy"))
        .when(F.col("id") % 6 == 2, shown("dd.MM.yyyy"))
        .when(F.col("id") % 6 == 3, shown("d-M-yyyy"))
        .when(F.col("id") % 6 == 4, F.lower(shown("dd/MM/yyyy")))
        .otherwise(shown("yyyy MM dd"))
    )
    return c.circulars.select("id", T.parse_date_token(token).alias("parsed"))


def _cue_sql(text: str) -> str:
    from clausegrid.functions import fixed as K

    whens = " ".join(
        "WHEN regexp_matches({x}, '{p}') THEN '{k}'".format(x=text, p=p, k=k) for p, k in K.SUPERSESSION_CUES
    )
    return f"CASE {whens} END"


_CUE_TEXTS = (
    "shall supersede it",
    "stands superseded",
    "it supersedes all",
    "hereby rescinded",
    "stand withdrawn",
    "was repealed",
    "shall stand modified",
    "stands modified",
    "an amendment to it",
    "listed in Annexure 1 of this text are replaced",
    "no such wording",
)


@query(
    "supersession_cue",
    f"""SELECT id, {_cue_sql('text')} AS cue FROM (SELECT id, text || ' ' || [{', '.join(f"'{t}'" for t in _CUE_TEXTS)}][
  CAST(id % {len(_CUE_TEXTS)} AS INT) + 1] AS text FROM paragraphs)""",
)
def _(c: Corpora):
    extra = F.element_at(
        F.array(*[F.lit(t) for t in _CUE_TEXTS]), (F.col("id") % len(_CUE_TEXTS) + 1).cast("int")
    )
    rows = c.paragraphs.select("id", F.concat_ws(" ", "text", extra).alias("text"))
    return R.supersession_cues(rows).select("id", "cue")


@query(
    "parse_policy_clauses",
    """SELECT manual_id, k - 1 AS order_index, [number_a, number_b][k] AS clause_number,
  [heading_a, heading_b][k] AS heading, ['Part A — Intake', 'Part B — Records'][k] AS heading_path,
  [text_a, text_b][k] AS text, instr(markdown, [text_a, text_b][k]) - 1 AS char_start,
  instr(markdown, [text_a, text_b][k]) - 1 + length([text_a, text_b][k]) AS char_end
FROM (SELECT *, regexp_extract(markdown, '### ([A-Z]\\.\\d+)', 1) AS number_a,
    regexp_extract(markdown, '(?s)Records.*### ([A-Z]\\.\\d+)', 1) AS number_b,
    trim(regexp_extract(markdown, '### A\\.1 ([^\\n]*)', 1)) AS heading_a,
    regexp_extract(markdown, '### B\\.\\d+ ([^\\n]*)', 1) AS heading_b,
    regexp_extract(markdown, '(?s)(### A.*?days\\.)', 1) AS text_a,
    regexp_extract(markdown, '(?s)(### B.*?kept\\.)', 1) AS text_b FROM manuals), (SELECT unnest([1, 2]) AS k)""",
)
def _(c: Corpora):
    return P.parse_policy_clauses(c.manuals)


@query(
    "new_packs",
    "SELECT manual_id, m.name, m.version FROM manuals m ANTI JOIN (SELECT name, 'v7' AS version FROM packs WHERE is_synthetic) p "
    "ON p.name = m.name AND p.version = m.version",
)
def _(c: Corpora):
    stored = c.packs.where("is_synthetic").select("name", F.lit("v7").alias("version"))
    return P.new_packs(c.manuals.drop("markdown"), stored).select("manual_id", "name", "version")


@query(
    "resolve_quotes",
    """SELECT id, base_offset, CASE WHEN place > 0 THEN base_offset + place - 1 END AS char_start,
  CASE WHEN place > 0 THEN base_offset + place - 1 + length(hit) END AS char_end
FROM (SELECT *, CASE WHEN hit <> '' THEN instr(source, hit) ELSE 0 END AS place
  FROM (SELECT id, char_start AS base_offset, text AS source, CASE id % 4 WHEN 0 THEN text
      WHEN 3 THEN '' ELSE substr(text, instr(text, 'deliver')) END AS hit FROM obligations))""",
)
def _(c: Corpora):
    tail = F.substring("text", F.instr("text", "deliver"), F.length("text"))
    kind = F.col("id") % 4
    rows = c.obligations.select(
        "id",
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("  "), tail))
        .when(kind == 2, F.replace(tail, F.lit(" lot "), F.lit("  lot\n")))
        .otherwise(F.concat(tail, F.lit(" else")))
        .alias("quote"),
        F.col("text").alias("source"),
        F.col("char_start").alias("base_offset"),
    )
    return N.resolve_quotes(rows).drop("quote", "source")


@query(
    "span_within",
    """SELECT o.id, p.char_start <= o.char_start - o.id % 3 * 2 AND o.char_start - o.id % 3 * 2 < o.char_end
  AND o.char_end <= p.char_end AS within FROM obligations o JOIN paragraphs p ON p.id = o.paragraph_id""",
)
def _(c: Corpora):
    p = c.paragraphs.select(F.col("id").alias("paragraph_id"), F.col("char_start").alias("ps"), F.col("char_end").alias("pe"))
    start = F.col("char_start") - F.col("id") % 3 * 2
    return c.obligations.join(p, "paragraph_id").select(
        "id", N.span_within(start, F.col("char_end"), F.col("ps"), F.col("pe")).alias("within")
    )


@query(
    "span_text",
    """SELECT o.id, o.paragraph_id, p.char_start AS paragraph_start, p.char_end AS paragraph_end,
  o.text AS span_text, true AS within FROM obligations o JOIN paragraphs p ON p.id = o.paragraph_id""",
)
def _(c: Corpora):
    return N.span_text(c.obligations, c.paragraphs)


@query("content_terms", f"SELECT doc_id, array_to_string({terms_sql('text')}, ' ') AS terms FROM documents")
def _(c: Corpora):
    return c.documents.select(
        "doc_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms")
    )


_QUANTITY_SQL = """SELECT id, CASE WHEN hit = '' THEN NULL WHEN t <> '' THEN 'T+ settlement days'
  WHEN u IN ('percent', '%') THEN 'percent' ELSE u || 's' END AS unit,
  TRY_CAST(coalesce(nullif(t, ''), nullif(b, ''), nullif(n, '')) AS BIGINT) AS value, nullif(hit, '') AS matched
FROM (SELECT id, text, regexp_extract(text, q) AS hit, regexp_extract(text, q, 1) AS t, regexp_extract(text, q, 2) AS b,
    regexp_extract(text, q, 3) AS n, rtrim(lower(regexp_extract(text, q, 4)), 's') AS u
  FROM (SELECT *, '(?i)T\\s*\\+\\s*(\\d+)|(?:\\((\\d+)\\)|(\\d+))\\s*(?:calendar\\s+|working\\s+|trading\\s+)?(days?|hours?|years?|months?|percent|%)' AS q
    FROM (SELECT id, CASE id % 5 WHEN 0 THEN text WHEN 1 THEN 'settle on T + ' || id % 7 || ' day'
      WHEN 2 THEN 'kept five (' || id % 9 || ') working years' WHEN 3 THEN 'at most ' || id % 100 || '% of it'
      ELSE 'no limit at all' END AS text FROM obligations)))"""


@query("stated_quantity", _QUANTITY_SQL)
def _(c: Corpora):
    kind = F.col("id") % 5
    text = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("settle on T + "), (F.col("id") % 7).cast("string"), F.lit(" day")))
        .when(kind == 2, F.concat(F.lit("kept five ("), (F.col("id") % 9).cast("string"), F.lit(") working years")))
        .when(kind == 3, F.concat(F.lit("at most "), (F.col("id") % 100).cast("string"), F.lit("% of it")))
        .otherwise("no limit at all")
    )
    rows = c.obligations.select("id", T.stated_quantity(text).alias("q"))
    return rows.select("id", "q.unit", "q.value", "q.matched")


@query(
    "deontic_flags",
    """SELECT id, regexp_matches(text, '(?i)\\b(?:shall|must|may)\\s+not\\b|\\bprohibited\\b|\\bno\\s+\\w+(?:\\s+\\w+)?\\s+shall\\b|\\bunder\\s+no\\s+circumstance') AS prohibits,
  regexp_matches(regexp_replace(text, '(?i)\\bmay\\s+not', '', 'g'), '(?i)\\bmay\\b|\\bpermitted\\b|\\bis\\s+allowed\\b') AS permits
FROM obligations""",
)
def _(c: Corpora):
    return c.obligations.select(
        "id", T.prohibits(F.col("text")).alias("prohibits"), T.permits(F.col("text")).alias("permits")
    )


_TILES = """SELECT doc_id, trim(piece, ' ' || chr(9) || chr(10)) AS sentence,
  CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(ltrim(piece, ' ' || chr(9) || chr(10))) AS start
FROM (SELECT doc_id, unnest(tiles) AS piece, unnest(range(len(tiles))) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.;]+[.;]?|[.;]') AS tiles FROM documents))"""


@query(
    "clause_sentences",
    f"SELECT * FROM ({_TILES}) WHERE length(sentence) >= 12",
)
def _(c: Corpora):
    rows = c.documents.select("doc_id", F.inline(T.clause_sentences(F.col("text"))))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("piece").alias("sentence"))


_TRIMMED = """CASE WHEN length({x}) <= 240 THEN {x} WHEN contains(left({x}, 240), ' ')
  THEN rtrim(regexp_extract(left({x}, 240), '(?s)^(.*) ', 1), ',;:') ELSE left({x}, 240) END"""


@query(
    "best_sentence",
    f"""SELECT doc_id, turn, score, start, {_TRIMMED.format(x='sentence')} AS sentence
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, turn ORDER BY score DESC, start) AS k
  FROM (SELECT s.doc_id, turn, start, sentence, len(list_intersect({terms_sql('sentence')}, q.terms)) AS score
    FROM ({_TILES}) s JOIN (SELECT conv_id, turn, {terms_sql('text')} AS terms FROM conversations) q
      ON q.conv_id = s.doc_id WHERE length(sentence) >= 12) WHERE score > 0) WHERE k = 1""",
)
def _(c: Corpora):
    asked = c.conversations.select(
        F.col("conv_id").alias("doc_id"), "turn", T.content_terms(F.col("text")).alias("terms")
    )
    best = T.best_sentence(T.clause_sentences(F.col("text")), F.col("terms"))
    rows = c.documents.join(asked, "doc_id").select("doc_id", "turn", best.alias("b")).where("b IS NOT NULL")
    return rows.select(
        "doc_id",
        "turn",
        F.col("b.score").cast("long").alias("score"),
        F.col("b.start").cast("long").alias("start"),
        F.col("b.piece").alias("sentence"),
    )


@query(
    "quote_trim",
    f"SELECT doc_id, {_TRIMMED.format(x='body')} AS quote FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10)) AS body FROM documents)",
)
def _(c: Corpora):
    return c.documents.select("doc_id", T.trim_quote(F.col("text")).alias("quote"))


@query(
    "strip_reference",
    """SELECT circular_id, trim(regexp_replace(replace(text, raw, ' '), '\\s+', ' ', 'g')) AS query
FROM (SELECT circular_id, text, regexp_extract(text, '(SEBI|CIR)/[A-Z0-9/]+', 0) AS raw FROM reference_texts)""",
)
def _(c: Corpora):
    raw = F.regexp_extract("text", "(SEBI|CIR)/[A-Z0-9/]+", 0)
    return c.reference_texts.select("circular_id", T.strip_reference(F.col("text"), raw).alias("query"))


@query(
    "normalise_actor",
    """SELECT id, CASE WHEN a LIKE '%ies' AND length(a) > 4 THEN left(a, length(a) - 3) || 'y'
  WHEN a LIKE '%s' AND a NOT LIKE '%ss' THEN left(a, length(a) - 1) ELSE a END AS actor
FROM (SELECT id, regexp_replace(lower(trim(['The Brokers', ' every Intermediaries ', 'An Analyst', 'All boss', 'ties', actor][
  CAST(id % 6 AS INT) + 1])), '(?i)^(the|a|an|every|all|any)\\s+', '') AS a FROM obligations)""",
)
def _(c: Corpora):
    names = ["The Brokers", " every Intermediaries ", "An Analyst", "All boss", "ties"]
    raw = F.element_at(F.array(*[F.lit(n) for n in names], F.col("actor")), (F.col("id") % 6 + 1).cast("int"))
    return c.obligations.select("id", T.normalise_actor(raw).alias("actor"))


_TEMPLATES = [
    f"Supplier {{n}} {verb} deliver the {adjective} {noun} lot within {{n}} days of each request."
    for verb in ("shall", "may")
    for adjective, noun in (("small", "ring"), ("red", "bolt"), ("hot", "gear"))
]


@query(
    "label_by_templates",
    """SELECT circular_id, text, actor, char_start - ps AS char_start, char_end - ps AS char_end
FROM (SELECT o.*, p.char_start AS ps FROM obligations o JOIN paragraphs p ON p.id = o.paragraph_id)
WHERE regexp_matches(text, '^Supplier \\d+ (shall|may) deliver the (small ring|red bolt|hot gear) lot within')""",
)
def _(c: Corpora):
    labelled = X.label_by_templates(c.paragraphs.select("circular_id", "text"), ["circular_id"], _TEMPLATES)
    return labelled.withColumns({k: F.col(k).cast("long") for k in ("char_start", "char_end")})


@query(
    "document_family",
    "SELECT id, lower(trim(regexp_replace(regexp_replace(title, '[\\d()]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS family FROM circulars",
)
def _(c: Corpora):
    return c.circulars.select("id", T.document_family(F.col("title")).alias("family"))


@query(
    "family_split",
    """SELECT id, CASE WHEN list_sum(list_transform(string_split(sha256(checksum), ''),
  lambda d: CASE WHEN d = '' THEN 0 ELSE strpos('0123456789abcdef', d) - 1 END)) % 3 = 0 THEN 'dev' ELSE 'test' END AS split
FROM circulars""",
)
def _(c: Corpora):
    return c.circulars.select("id", T.family_split(F.col("checksum")).alias("split"))


@query("content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(c: Corpora):
    return c.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "context_snippet",
    """SELECT id, substr(text, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0)) AS before, substr(text, s + 8, 30) AS after
FROM (SELECT id, text, instr(text, 'deliver') - 1 AS s FROM obligations)""",
)
def _(c: Corpora):
    at = F.instr("text", "deliver") - 1
    rows = c.obligations.select("id", T.context_snippet(F.col("text"), at, at + 7, 30).alias("x"))
    return rows.select("id", "x.before", "x.after")


_SPAN_SQL = """SELECT id AS parent_id, text, char_start AS text_start,
  [{'s': char_start + id % 5, 'e': char_start + id % 5 + 9, 'i': 'a'},
   {'s': char_start + id % 11, 'e': char_start + id % 11 + 12, 'i': 'b'},
   {'s': char_start + 20, 'e': char_start + 30 + id % 90, 'i': 'c'}] AS spans FROM obligations"""


def _marked(c: Corpora):
    texts = c.obligations.select(
        F.col("id").alias("parent_id"), "text", F.col("char_start").alias("text_start")
    )
    s, k = F.col("text_start"), F.col("parent_id")
    at = lambda i, a, b: F.struct(F.lit(i).alias("span_id"), a.alias("start"), b.alias("end"))
    spans = texts.select(
        "parent_id",
        F.inline(
            F.array(
                at("a", s + k % 5, s + k % 5 + 9), at("b", s + k % 11, s + k % 11 + 12), at("c", s + 20, s + 30 + k % 90)
            )
        ),
    )
    return N.highlight_segments(texts, spans)


@query(
    "highlight_segments",
    f"""WITH fit AS (SELECT parent_id, text, length(text) AS n, list_sort(list_filter(list_transform(spans,
      lambda x: {{'s': x.s - text_start, 'e': x.e - text_start, 'i': x.i}}), lambda x: x.e <= length(text))) AS f FROM ({_SPAN_SQL})),
kept AS (SELECT parent_id, text, n, f, len(f) >= 2 AND f[2].s >= f[1].e AS k2 FROM fit),
kept3 AS (SELECT *, len(f) >= 3 AND f[3].s >= CASE WHEN k2 THEN f[2].e ELSE f[1].e END AS k3 FROM kept),
cuts AS (SELECT parent_id, text, n, list_concat([f[1]], CASE WHEN k2 THEN [f[2]] ELSE [] END, CASE WHEN k3 THEN [f[3]] ELSE [] END) AS g FROM kept3),
pieces AS (SELECT parent_id, text, unnest(list_concat(
    list_transform(g, lambda x: {{'s': x.s, 'e': x.e, 'i': x.i}}),
    list_transform(list_zip(list_concat([0::BIGINT], list_transform(g, lambda x: x.e)), list_concat(list_transform(g, lambda x: x.s), [n])),
      lambda z: {{'s': z[1], 'e': z[2], 'i': NULL::VARCHAR}}))) AS p FROM cuts)
SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY p.s) - 1 AS segment,
  substr(text, p.s + 1, p.e - p.s) AS text, p.i AS span_id FROM pieces WHERE p.e > p.s""",
)
def _(c: Corpora):
    return _marked(c)[0]


@query(
    "highlight_out_of_range",
    f"SELECT parent_id, x.i AS span_id FROM (SELECT parent_id, text, text_start, unnest(spans) AS x FROM ({_SPAN_SQL})) WHERE x.e - text_start > length(text)",
)
def _(c: Corpora):
    return _marked(c)[1]


@query(
    "query_terms",
    """SELECT item_id, array_to_string(list_filter(list_distinct(w), lambda x: true), ' ') AS terms FROM (
  SELECT item_id, list_transform(list_sort(list_transform(list_filter(list_zip(parts, range(len(parts))),
    lambda z: length(z[1]) > 2 AND z[1] NOT IN ('the','and','for','of','to','in','a','an','on','by','or','with','are','was','were','this','that','from','into','than','before','after','shall','must')
      AND list_position(parts, z[1]) = z[2] + 1), lambda z: {'k': z[2], 'v': z[1]})), lambda s: s.v) AS w
  FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}+/-]+') AS parts FROM benchmark))""".replace(
        "list_filter(list_distinct(w), lambda x: true)", "w"
    ),
)
def _(c: Corpora):
    return c.benchmark.select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(
    "check_constraints",
    """SELECT 'circular number is not unique' AS rule, circular_number AS key FROM circulars GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'obligation: span is empty or reversed', CAST(id AS VARCHAR) FROM obligations WHERE id % 17 = 0
UNION ALL SELECT 'obligation text differs from its slice', CAST(id AS VARCHAR) FROM obligations WHERE id % 17 = 0
UNION ALL SELECT 'extraction method is unknown', CAST(id AS VARCHAR) FROM paragraphs WHERE id % 19 = 0""",
)
def _(c: Corpora):
    spoilt = c.obligations.withColumn(
        "char_end", F.when(F.col("id") % 17 == 0, F.col("char_start")).otherwise(F.col("char_end"))
    )
    odd = c.paragraphs.withColumn(
        "extraction_method", F.when(F.col("id") % 19 == 0, "guess").otherwise(F.col("extraction_method"))
    )
    return N.check_constraints(c.circulars, odd, spoilt, c.clauses)
