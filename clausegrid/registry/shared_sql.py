"""The derived corpus tables in DuckDB SQL, added as CTEs to the check queries that use them."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    TABLES[name] = sql


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the derived tables it mentions, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = [f"{name} AS ({body})" for name, body in TABLES.items() if name in needed]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if "WITH RECURSIVE" in sql else "WITH "
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql) if re.match(r"\s*WITH\b", sql) else None
    joined = ",\n".join(ctes)
    return f"{head}{joined},\n{body}" if body is not None else f"{head}{joined}\n{sql}"


shared(
    "circulars",
    """SELECT o_orderkey AS id,
  'SEBI/HO/' || dept || '/CIR/P/' || year(o_orderdate) || '/' || o_orderkey AS circular_number,
  CASE o_orderstatus WHEN 'F' THEN 'Circular' WHEN 'O' THEN 'Master Circular' ELSE 'Advisory' END
    || ' on delivery standards of ' || dept || ' (' || year(o_orderdate) || ')' AS title,
  CASE WHEN o_totalprice >= 5000 THEN CAST(o_orderdate AS DATE) END AS issue_date,
  dept AS department,
  CASE o_orderstatus WHEN 'F' THEN 'circular' WHEN 'O' THEN 'master_circular' ELSE 'advisory' END AS doc_type,
  CASE WHEN o_orderstatus = 'P' THEN 'synthetic://corpus/' ELSE 'https://example.org/circulars/' END
    || o_orderkey AS source_url,
  sha256('SEBI/HO/' || dept || '/CIR/P/' || year(o_orderdate) || '/' || o_orderkey) AS checksum,
  o_custkey AS cluster
FROM (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MIRSD' WHEN '2' THEN 'CFD'
        WHEN '3' THEN 'MRD' WHEN '4' THEN 'IMD' ELSE 'ISD' END AS dept FROM orders)""",
)
shared(
    "reference_texts",
    """SELECT c.id AS circular_id, CASE c.id % 4
  WHEN 0 THEN 'This text is issued in the interest of investors. Circular ' || d.circular_number || ' stands superseded.'
  WHEN 1 THEN 'Circular ' || d.circular_number || ' is partially modified to the extent stated above.'
  WHEN 2 THEN 'All intermediaries are advised to read ' || d.circular_number
    || ' for the earlier framework and its reporting formats.'
  ELSE 'Reference is invited to CIR/LEG/DP/' || c.id || '/'
    || year(coalesce(c.issue_date, DATE '1995-01-01')) || ' dated '
    || strftime(coalesce(d.issue_date, DATE '1994-01-01'), '%B %d, %Y') || ' on the same subject.' END AS text
FROM circulars c JOIN circulars d ON d.id = c.id // 2""",
)
shared(
    "items",
    """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS item_no,
  'Supplier ' || l_suppkey || ' '
    || CASE l_returnflag WHEN 'A' THEN 'shall' WHEN 'N' THEN 'may' ELSE 'shall not' END
    || ' deliver the ' || p_name || ' lot within ' || CAST(l_quantity AS BIGINT)
    || ' days of each request.' AS sentence
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
shared(
    "paragraphs",
    """SELECT circular_id * 10000000 + order_index AS id, circular_id, order_index, para_number, heading_path, text,
  through - 2 - length(text) AS char_start, through - 2 AS char_end,
  1 + order_index // 8 AS page_number, extraction_method
FROM (SELECT *, CAST(sum(length(text) + 2) OVER (PARTITION BY circular_id ORDER BY order_index) AS BIGINT) AS through
  FROM (
    SELECT id AS circular_id, CAST(0 AS BIGINT) AS order_index,
      'Circular No. ' || circular_number || ' issued by ' || department AS text,
      CAST(NULL AS VARCHAR) AS para_number, CAST(NULL AS VARCHAR) AS heading_path, 'text' AS extraction_method
    FROM circulars
    UNION ALL
    SELECT id, 1, 'DELIVERY OBLIGATIONS', NULL, 'DELIVERY OBLIGATIONS', 'text' FROM circulars
    UNION ALL
    SELECT l_orderkey, item_no + 1, item_no || '. ' || sentence, CAST(item_no AS VARCHAR),
      'DELIVERY OBLIGATIONS', CASE WHEN l_tax = 0 THEN 'vision' ELSE 'text' END FROM items
    UNION ALL
    SELECT r.circular_id, coalesce(n, 0) + 2, r.text, NULL, 'DELIVERY OBLIGATIONS', 'text'
    FROM reference_texts r
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) k ON k.l_orderkey = r.circular_id))""",
)
shared(
    "obligations",
    """SELECT id, circular_id, id AS paragraph_id, substr(text, length(para_number) + 3) AS text,
  regexp_extract(text, '(Supplier \\d+)', 1) AS actor,
  char_start + length(para_number) + 2 AS char_start, char_end
FROM paragraphs WHERE para_number IS NOT NULL""",
)
shared(
    "packs",
    """SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id, p_brand AS name, 'v1' AS version,
  CAST(split_part(p_brand, '#', 2) AS INT) > 5 AS is_synthetic FROM part""",
)
shared(
    "clauses",
    """SELECT id, policy_pack_id, n - 1 AS order_index, clause_number, heading, text,
  through - 2 - length(text) AS char_start, through - 2 AS char_end
FROM (SELECT *, row_number() OVER w AS n, CAST(sum(length(text) + 2) OVER w AS BIGINT) AS through
  FROM (SELECT *, '### ' || clause_number || ' ' || heading || chr(10) || chr(10) || 'The desk '
      || CASE p_type WHEN 'PROMO' THEN 'shall not' WHEN 'ECONOMY' THEN 'may' ELSE 'shall' END
      || ' keep ' || p_name || ' stock for ' || p_size || ' days under ' || lower(p_type) || ' rules'
      || CASE p_type WHEN 'STANDARD' THEN ' on request.' ELSE '.' END AS text
    FROM (SELECT *, p_partkey AS id, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS policy_pack_id,
        CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'LARGE' THEN 'B' WHEN 'MEDIUM' THEN 'C'
          WHEN 'PROMO' THEN 'D' WHEN 'SMALL' THEN 'E' ELSE 'F' END || '.' || p_partkey AS clause_number,
        'Delivery of ' || p_name AS heading FROM part))
  WINDOW w AS (PARTITION BY policy_pack_id ORDER BY id))""",
)
shared(
    "assessments",
    """SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS run_id, o_orderkey AS circular_id,
  o_custkey % 25 + 1 AS policy_pack_id,
  CASE WHEN o_totalprice >= 5000 THEN CAST(o_orderdate AS DATE) END AS as_of_date,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status,
  CAST(o_orderdate AS DATE) AS created_on FROM orders""",
)
shared(
    "findings",
    """SELECT f.*, CASE WHEN quote_status = 'VERIFIED' THEN o.char_start END AS circular_span_start,
  CASE WHEN quote_status = 'VERIFIED' THEN o.char_end END AS circular_span_end
FROM (SELECT l_orderkey * 10000000 + item_no + 1 AS id, l_orderkey AS assessment_id,
    l_orderkey * 10000000 + item_no + 1 AS obligation_id,
    CASE WHEN l_discount > 0 THEN l_partkey END AS policy_clause_id,
    CASE WHEN l_discount = 0 THEN 'NO_MATCH' WHEN l_discount < CAST(0.03 AS DOUBLE) THEN 'CONFLICT'
      WHEN l_discount < CAST(0.06 AS DOUBLE) THEN 'MODIFIED'
      WHEN l_discount < CAST(0.09 AS DOUBLE) THEN 'ALREADY_COVERED' ELSE 'NEW_REQUIREMENT' END AS impact_type,
    'Judged on a lot of ' || p_name AS rationale,
    CASE WHEN l_discount = 0 THEN 'NOT_APPLICABLE' WHEN l_tax >= CAST(0.07 AS DOUBLE) THEN 'FAILED'
      ELSE 'VERIFIED' END AS quote_status,
    CASE WHEN l_discount > 0 THEN l_discount * 10 END AS confidence,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'ACCEPTED'
      WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'REJECTED' ELSE 'PENDING' END AS analyst_decision
  FROM items) f JOIN obligations o ON o.id = f.obligation_id""",
)
shared(
    "steps",
    """SELECT event_id AS id, user_id AS run_id, event_type AS node,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'RUNNING' ELSE 'OK' END AS status,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in,
  CAST(json_extract_string(props, '$.k') AS BIGINT) // 3 AS tokens_out, value AS latency_ms,
  CASE event_type WHEN 'click' THEN 'openai/gpt-oss-20b' WHEN 'view' THEN 'openai/gpt-oss-120b'
    WHEN 'error' THEN 'unlisted-model' ELSE 'llama-3.3-70b-versatile' END AS model, ts AS started_at
FROM events""",
)
shared(
    "outcomes",
    """SELECT 'q-' || o_orderkey AS query_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'identifier' WHEN '2' THEN 'out_of_scope'
    WHEN '3' THEN 'control' ELSE 'semantic' END AS subset,
  'c-' || o_custkey AS cluster, mode, ['D' || o_orderkey] AS relevant,
  list_transform(range(1, 11), lambda i: CASE WHEN i = draw % 15 + 1 THEN 'D' || o_orderkey ELSE 'X' || i END) AS retrieved,
  CASE WHEN draw % 29 <> 0 THEN (draw % 1000) / 1000.0::DOUBLE END AS top_score,
  (draw % 977) / 10.0::DOUBLE AS latency_ms
FROM (SELECT *, ('0x' || substr(md5(o_orderkey || '|' || mode), 1, 8))::BIGINT AS draw
  FROM orders, (SELECT unnest(['dense', 'lexical', 'hybrid', 'hybrid_rerank']) AS mode))""",
)
shared(
    "circular_pages",
    """SELECT c.id AS doc_id, CAST(p AS INT) AS page_number, CASE p WHEN 1 THEN
  'Circular No. ' || c.circular_number || ' issued by ' || c.department || chr(13) || chr(10) || chr(13) || chr(10)
  || 'DELIVERY OBLIGATIONS' || chr(10) || '1. Every depositor shall ' || chr(64257) || 'le the return for '
  || c.cluster || ' by noon.   ' || chr(10) || 'continued on the next line; See the note.' || chr(10)
  || '| Item | Days |' || chr(10) || '| lot | ' || c.id % 30 || ' |' || chr(10)
  || '(a) The agent must not delay.'
  ELSE 'continued order dated ' || strftime(coalesce(c.issue_date, DATE '1994-01-01'), '%B %d, %Y')
  || chr(10) || chr(10) || chr(10) || chr(10) || 'PART B' || chr(10)
  || '2.1 The agent should reply to ' || c.department || ' within ' || c.id % 9 || ' days.' || chr(9) || chr(10)
  || 'ANNEXURE - 1' || chr(10) || '  |x|' || chr(10) END AS text
FROM circulars c, (SELECT unnest([1, 2]) AS p)""",
)
shared(
    "clean_pages",
    """SELECT doc_id, page_number, trim(regexp_replace(regexp_replace(replace(replace(
  regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(64257), 'fi'), chr(160), ' '),
  '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text
FROM circular_pages""",
)
shared(
    "page_lines",
    """SELECT *, sum(CASE WHEN is_table <> was_table OR (NOT is_table AND (line_blank OR opens)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS block
FROM (SELECT *, coalesce(lag(is_table) OVER (PARTITION BY doc_id, page_number ORDER BY line_no), false) AS was_table
  FROM (SELECT doc_id, page_number, line_no, line, regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AS is_table,
      trim(line) = '' AS line_blank,
      regexp_matches(line, '^\\s*(?:\\d+(?:\\.\\d+)*\\.?|\\([a-z]{1,3}\\)|\\([0-9]{1,2}\\))\\s+\\S')
      OR regexp_matches(line, '^\\s*(?:ANNEX(?:URE)?[\\s\\-–]*[A-Z0-9]*|PART\\s+[A-Z0-9]+|[A-Z][A-Z \\-&,/]{6,})\\s*$') AS opens
    FROM (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS line_no FROM clean_pages)))""",
)
shared(
    "page_blocks",
    """SELECT doc_id, page_number, block, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10)) AS text
FROM page_lines WHERE NOT line_blank GROUP BY ALL""",
)
shared(
    "page_paragraphs",
    """SELECT doc_id, row_number() OVER w - 1 AS order_index,
  nullif(regexp_replace(regexp_extract(head,
    '^\\s*(\\d+(?:\\.\\d+)*\\.?|\\([a-z]{1,3}\\)|\\([0-9]{1,2}\\))\\s+\\S', 1), '\\.+$', ''), '') AS para_number,
  last_value(CASE WHEN heading AND NOT contains(text, '|') THEN trim(head) END IGNORE NULLS) OVER w AS heading_path,
  text, page_number, CAST(sum(length(text) + 2) OVER w AS BIGINT) - 2 - length(text) AS char_start,
  CAST(sum(length(text) + 2) OVER w AS BIGINT) - 2 AS char_end
FROM (SELECT *, split_part(text, chr(10), 1) AS head, regexp_matches(split_part(text, chr(10), 1),
    '^\\s*(?:ANNEX(?:URE)?[\\s\\-–]*[A-Z0-9]*|PART\\s+[A-Z0-9]+|[A-Z][A-Z \\-&,/]{6,})\\s*$') AS heading FROM page_blocks)
WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, block)""",
)
shared(
    "document_paragraphs",
    """SELECT doc_id, row_number() OVER w - 1 AS order_index, text,
  CAST(sum(length(text) + 2) OVER w AS BIGINT) - 2 - length(text) AS char_start,
  CAST(sum(length(text) + 2) OVER w AS BIGINT) - 2 AS char_end,
  greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INT)) AS tokens
FROM (SELECT doc_id, line_no, trim(line, ' ' || chr(9)) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))
WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
)
shared(
    "manuals",
    """SELECT p_partkey AS manual_id, p_brand AS name, 'v' || p_size AS version,
  '# Manual' || chr(10) || 'Preamble.' || chr(10) || chr(10) || '## Part A — Intake' || chr(10) || chr(10)
  || '### A.1 Delivery of ' || p_name || '  ' || chr(10) || chr(10) || 'The desk shall deliver within '
  || p_size || ' days.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Part B — Records' || chr(10)
  || '### B.' || p_partkey || ' Keeping ' || p_type || ' records' || chr(10) || 'Records are kept.'
  || chr(10) || '#### Note' || chr(10) || 'Not a clause.' AS markdown FROM part""",
)


def terms_sql(expr: str, distinct: bool = True) -> str:
    """Content words of a text as a DuckDB list."""
    from clausegrid.functions import fixed as K

    stops = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
    generic = ", ".join(f"'{w}'" for w in K.GENERIC_WORDS)
    stemmed = (
        "CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, length(w) - 3) "
        "WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, length(w) - 2) "
        "WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, length(w) - 2) "
        "WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END"
    )
    listed = (
        f"list_filter(list_transform(list_filter(regexp_extract_all(lower({expr}), '[a-z][a-z\\-]+'), "
        f"lambda w: w NOT IN ({stops})), lambda w: {stemmed}), "
        f"lambda s: s NOT IN ({generic}) AND length(s) > 2)"
    )
    return f"list_sort(list_distinct({listed}))" if distinct else listed
shared(
    "refs",
    """SELECT id AS paragraph_id, circular_id, text, raw_reference,
  trim(regexp_replace(replace(upper(raw_reference), '-', '/'), '/{2,}', '/', 'g'), '/.') AS normalised_reference,
  char_start + instr(text, raw_reference) - 1 AS char_start,
  char_start + instr(text, raw_reference) - 1 + length(raw_reference) AS char_end
FROM (SELECT id, circular_id, text, char_start, regexp_extract(text, '(SEBI|CIR)/[A-Z0-9/]+', 0) AS raw_reference FROM paragraphs)
WHERE raw_reference <> ''""",
)
shared(
    "citations",
    """SELECT citing_circular_id, citing_paragraph_id, raw_reference, normalised_reference,
  coalesce(n, d) AS cited_circular_id, coalesce(n, d) IS NOT NULL AS resolved,
  CASE WHEN n IS NOT NULL THEN 'regex' WHEN d IS NOT NULL THEN 'date' ELSE 'unresolved' END AS resolution_method,
  char_start, char_end, text
FROM (SELECT r.circular_id AS citing_circular_id, paragraph_id AS citing_paragraph_id, raw_reference,
    normalised_reference, char_start, char_end, text, c.id AS n,
    CASE WHEN contains(text, ' dated ') THEN u.id END AS d
  FROM refs r LEFT JOIN circulars c ON c.circular_number = r.normalised_reference
  LEFT JOIN (SELECT issue_date, min(id) AS id FROM circulars WHERE issue_date IS NOT NULL GROUP BY 1 HAVING count(*) = 1) u
    ON strftime(u.issue_date, '%B %d, %Y') = regexp_extract(text, 'dated ([A-Z][a-z]+ \\d+, \\d+)', 1))
WHERE coalesce(n, d) IS NULL OR coalesce(n, d) <> citing_circular_id""",
)
shared(
    "supersessions",
    """SELECT c.citing_circular_id AS superseding_circular_id, c.cited_circular_id AS superseded_circular_id,
  c.raw_reference, c.citing_paragraph_id AS evidence_paragraph_id, c.char_start,
  CASE WHEN contains(c.text, 'stands superseded') THEN 'supersedes' ELSE 'partial' END AS supersession_type,
  k.issue_date AS effective_date, c.resolved, c.citing_circular_id AS edge_id
FROM citations c JOIN circulars k ON k.id = c.citing_circular_id
WHERE contains(c.text, 'stands superseded') OR contains(c.text, 'partially modified')""",
)


def occurrences_sql(table: str, key: str, text: str = "text") -> str:
    """One row per content word of each text with its place among all words."""
    from clausegrid.functions import fixed as K

    stops = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
    generic = ", ".join(f"'{w}'" for w in K.GENERIC_WORDS)
    return f"""SELECT {key}, pos, term FROM (SELECT {key}, pos,
    CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, length(w) - 3)
      WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, length(w) - 2)
      WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, length(w) - 2)
      WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END AS term
  FROM (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS pos
    FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z][a-z\\-]+') AS ws FROM {table}))
  WHERE w NOT IN ({stops})) WHERE term NOT IN ({generic}) AND length(term) > 2"""


shared("chunk_words", occurrences_sql("(SELECT doc_id AS chunk_id, text FROM documents)", "chunk_id"))
shared(
    "query_words",
    "SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, term FROM ("
    + occurrences_sql("(SELECT item_id AS query_id, text FROM benchmark)", "query_id")
    + "))",
)
shared(
    "cover_hits",
    """SELECT h.*, m.n_terms FROM (SELECT query_id, chunk_id, pos, term FROM query_words JOIN chunk_words USING (term)) h
JOIN (SELECT query_id, chunk_id, any_value(n_terms) AS n_terms FROM query_words JOIN (SELECT DISTINCT chunk_id, term FROM chunk_words) USING (term)
  GROUP BY 1, 2 HAVING count(*) = any_value(n_terms)) m USING (query_id, chunk_id)""",
)
shared(
    "lexical_scores",
    """SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + pos - start - (hits - 1))), 9) AS score
FROM (SELECT *, lag(start, 1, -1) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS opened,
    (SELECT count(*) FROM cover_hits k WHERE k.query_id = e.query_id AND k.chunk_id = e.chunk_id AND k.pos BETWEEN e.start AND e.pos) AS hits
  FROM (SELECT query_id, chunk_id, pos, min(lp) AS start FROM (
      SELECT a.query_id, a.chunk_id, a.pos, a.n_terms, b.term, max(b.pos) AS lp
      FROM cover_hits a JOIN cover_hits b USING (query_id, chunk_id) WHERE b.pos <= a.pos GROUP BY ALL)
    GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_terms)) e)
WHERE start <> opened GROUP BY 1, 2""",
)
_SLOT = "('0x' || substr(md5(term), 1, 8))::BIGINT % 384"
shared(
    "chunk_slots",
    f"""SELECT chunk_id, slot, tf, sqrt(sum(tf * tf) OVER (PARTITION BY chunk_id)) AS norm
FROM (SELECT chunk_id, {_SLOT} AS slot, count(*)::DOUBLE AS tf FROM chunk_words GROUP BY 1, 2)""",
)
shared(
    "query_slots",
    f"""SELECT query_id, slot, tf, sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS norm
FROM (SELECT query_id, {_SLOT} AS slot, count(*)::DOUBLE AS tf FROM ("""
    + occurrences_sql(
        "(SELECT item_id AS query_id, 'Represent this sentence for searching relevant passages: ' || text AS text FROM benchmark)",
        "query_id",
    )
    + ") GROUP BY 1, 2)",
)
shared(
    "dense_scores",
    """SELECT query_id, chunk_id, round(coalesce(s, 0), 9) AS score
FROM (SELECT DISTINCT query_id FROM query_slots) CROSS JOIN (SELECT DISTINCT chunk_id FROM chunk_slots)
LEFT JOIN (SELECT query_id, chunk_id, sum(q.tf / q.norm * (c.tf / c.norm)) AS s FROM query_slots q JOIN chunk_slots c USING (slot) GROUP BY 1, 2)
  USING (query_id, chunk_id)""",
)
shared(
    "dense_hits",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_scores) WHERE rank <= 50""",
)
shared(
    "lexical_hits",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lexical_scores) WHERE rank <= 50""",
)
shared(
    "fused_hits",
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank
FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, min(dense) AS dense_rank, min(lexical) AS lexical_rank
  FROM (SELECT query_id, chunk_id, rank, rank AS dense, NULL AS lexical FROM dense_hits
    UNION ALL SELECT query_id, chunk_id, rank, NULL, rank FROM lexical_hits) GROUP BY 1, 2)""",
)
shared(
    "query_sets",
    f"SELECT item_id AS query_id, {terms_sql('text')} AS terms FROM benchmark",
)
shared(
    "chunk_sets",
    f"SELECT doc_id AS chunk_id, {terms_sql('text')} AS terms FROM documents",
)
shared(
    "reranked_hits",
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT f.query_id, f.chunk_id, f.rrf_score, len(list_intersect(q.terms, c.terms)) / len(q.terms)::DOUBLE AS score
  FROM fused_hits f JOIN query_sets q USING (query_id) JOIN chunk_sets c USING (chunk_id) WHERE f.rank <= 50)""",
)
shared(
    "chunk_validity",
    """SELECT d.doc_id AS chunk_id, k.issue_date, r.out_since FROM documents d JOIN circulars k ON k.id = d.doc_id
LEFT JOIN (SELECT superseded_circular_id AS id, min(effective_date) AS out_since FROM supersessions
  WHERE resolved AND supersession_type = 'supersedes' GROUP BY 1) r ON r.id = k.id WHERE k.issue_date IS NOT NULL""",
)
shared(
    "query_days",
    "SELECT item_id AS query_id, CAST(DATE '1998-01-01' + CAST(item_id % 1000 AS INT) AS DATE) AS as_of FROM benchmark",
)
shared(
    "tasks",
    f"""SELECT a.id AS assessment_id, a.policy_pack_id, o.id AS obligation_id, o.text, o.char_start, o.char_end,
  {terms_sql("o.text")} AS terms FROM assessments a JOIN obligations o ON o.circular_id = a.circular_id""",
)
shared("clause_words", f"SELECT policy_pack_id, id AS clause_id, {terms_sql('text')} AS words FROM clauses")
shared(
    "set_scores",
    """SELECT policy_pack_id, terms, clause_id, len(list_intersect(terms, words)) / len(terms)::DOUBLE AS score,
  row_number() OVER (PARTITION BY policy_pack_id, terms ORDER BY len(list_intersect(terms, words)) DESC, clause_id) AS rank
FROM (SELECT DISTINCT policy_pack_id, terms FROM tasks) JOIN clause_words USING (policy_pack_id)""",
)
shared(
    "pair_rows",
    """SELECT t.assessment_id, t.obligation_id, s.clause_id AS policy_clause_id, c.clause_number, t.text AS obligation_text,
  t.char_start AS obligation_start, c.text AS clause_text, c.char_start AS clause_start, t.terms, s.score
FROM tasks t JOIN set_scores s USING (policy_pack_id, terms) JOIN clauses c ON c.id = s.clause_id
WHERE s.rank <= 3 AND s.score >= 0.35""",
)
_BAN = "(?i)\\b(?:shall|must|may)\\s+not\\b|\\bprohibited\\b|\\bno\\s+\\w+(?:\\s+\\w+)?\\s+shall\\b|\\bunder\\s+no\\s+circumstance"
_MAY = "(?i)\\bmay\\b|\\bpermitted\\b|\\bis\\s+allowed\\b"
shared(
    "judged_rows",
    f"""SELECT *, CASE impact_type
    WHEN 'NO_MATCH' THEN 'Clause ' || clause_number || ' shares too few terms with the obligation (' || pct || ' of its content words) to address the same requirement.'
    WHEN 'MODIFIED' THEN 'Both texts set a limit in days, but the obligation states ' || od || ' days while clause ' || clause_number || ' states ' || cd || ' days; the clause needs its figure updated.'
    WHEN 'CONFLICT' THEN 'One text prohibits what the other permits: the obligation ' || CASE WHEN ob THEN 'forbids' ELSE 'allows' END || ' the conduct that clause ' || clause_number || ' ' || CASE WHEN ob THEN 'allows' ELSE 'forbids' END || '.'
    WHEN 'ALREADY_COVERED' THEN 'Clause ' || clause_number || ' addresses the same requirement (' || pct || ' of the obligation''s content words recur in it) and states no conflicting figure.'
    ELSE 'Clause ' || clause_number || ' covers related ground but does not state this requirement; only part of the obligation''s wording recurs in it.' END AS rationale,
  round_even(score, 2) AS confidence, obligation_text AS circular_quote,
  CASE WHEN impact_type = 'NO_MATCH' THEN '' ELSE sentence END AS clause_quote
FROM (SELECT *, CAST(round_even(score * 100, 0) AS INT) || '%' AS pct, CASE WHEN score < 0.25 THEN 'NO_MATCH'
    WHEN od <> cd THEN 'MODIFIED'
    WHEN ob <> cb AND score >= 0.4 AND regexp_matches(regexp_replace(CASE WHEN ob THEN sentence ELSE obligation_text END, '(?i)\\bmay\\s+not', '', 'g'), '{_MAY}') THEN 'CONFLICT'
    WHEN score >= 0.5 THEN 'ALREADY_COVERED' ELSE 'NEW_REQUIREMENT' END AS impact_type
  FROM (SELECT *, regexp_extract(obligation_text, '(\\d+) days', 1) AS od, regexp_extract(clause_text, '(\\d+) days', 1) AS cd,
      regexp_extract(clause_text, '(The desk .*)$', 1) AS sentence, regexp_matches(obligation_text, '{_BAN}') AS ob,
      regexp_matches(regexp_extract(clause_text, '(The desk .*)$', 1), '{_BAN}') AS cb FROM pair_rows))""",
)
shared(
    "unmatched_tasks",
    """SELECT t.*, s.clause_id AS closest_id, s.score AS closest_score, c.clause_number AS closest_number
FROM tasks t JOIN set_scores s USING (policy_pack_id, terms) JOIN clauses c ON c.id = s.clause_id WHERE s.rank = 1 AND s.score < 0.35""",
)
shared(
    "real_findings",
    """SELECT assessment_id, obligation_id, policy_clause_id, clause_number, impact_type, rationale, confidence,
  obligation_start AS circular_span_start, obligation_start + length(circular_quote) AS circular_span_end,
  CASE WHEN clause_quote <> '' THEN clause_start + instr(clause_text, clause_quote) - 1 END AS clause_span_start,
  CASE WHEN clause_quote <> '' THEN clause_start + instr(clause_text, clause_quote) - 1 + length(clause_quote) END AS clause_span_end,
  'VERIFIED' AS quote_status, NULL AS verification_note, NULL AS unlocated_quote, 1 AS verification_attempts FROM judged_rows
UNION ALL SELECT assessment_id, obligation_id, NULL, NULL, 'NO_MATCH',
  'No policy clause scored at or above the relevance threshold (0.35) for this obligation, so no judgement was made. The closest was '
    || closest_number || ' at ' || printf('%.2f', closest_score) || '.', NULL, NULL, NULL, NULL, NULL, 'NOT_APPLICABLE', NULL, NULL, 0
FROM unmatched_tasks""",
)
shared(
    "scored_outcomes",
    """SELECT *, CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END AS hit_1, CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS hit_5,
  CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END AS hit_10, coalesce(1.0::DOUBLE / rank, 0) AS reciprocal_rank,
  CASE WHEN mode = 'hybrid_rerank' THEN top_score IS NULL OR top_score < 0.35::DOUBLE END AS refused
FROM (SELECT *, nullif(list_position(retrieved, relevant[1]), 0) AS rank FROM outcomes)""",
)
shared(
    "annotations",
    """SELECT 'q-' || (conv_id // 2) || '-' || turn AS question_id, CASE WHEN role = 'system' THEN 'unsure' WHEN turn % 3 = 0 THEN 'not_relevant' ELSE 'relevant' END AS relevance,
  CASE WHEN turn % 5 = 4 THEN 'odd' ELSE 'none' END AS ambiguity,
  CASE turn % 3 WHEN 0 THEN 'provisional' ELSE 'reviewed' END AS review_status, CASE WHEN turn % 4 = 1 THEN 'model' ELSE 'human' END AS reviewer_type,
  'model' AS annotator_type, CASE WHEN turn % 7 < 6 THEN '2024-01-01' END AS reviewed_at, CASE WHEN turn % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
  role AS family, conv_id AS document, CAST(turn AS INT) AS char_start, CAST(turn AS INT) + 20 AS char_end,
  substr(text, CAST(turn AS INT) + 1, 20) AS quote,
  CASE WHEN turn % 6 = 5 THEN 'x' ELSE sha256(substr(text, CAST(turn AS INT) + 1, 20)) END AS quote_sha256 FROM conversations""",
)
shared(
    "review_candidates",
    """SELECT 'r-' || conv_id || '-' || pair AS record_id, md5(CAST(conv_id % 5 AS VARCHAR)) AS snapshot_sha256,
  CASE (conv_id + pair) % 3 WHEN 0 THEN 'rules' ELSE 'model' END AS generator, CASE conv_id % 2 WHEN 0 THEN 'real' ELSE 'synthetic' END AS corpus
FROM (SELECT DISTINCT conv_id, turn // 2 AS pair FROM conversations WHERE role <> 'system')""",
)
shared(
    "reviews",
    """SELECT conv_id * 1000 + turn AS line, CASE WHEN turn % 13 <> 12 THEN 'r-' || conv_id || '-' || (turn // 2) END AS record_id,
  CASE WHEN turn % 7 = 6 THEN 'maybe' WHEN role = 'user' THEN 'supported' WHEN role = 'assistant' THEN 'unsupported' ELSE 'insufficient' END AS label,
  'p' || turn AS reviewer_id, CASE WHEN turn % 5 = 4 THEN 'model' ELSE 'human' END AS reviewer_type,
  CASE WHEN turn % 11 = 5 THEN '2024-01-01' ELSE '2024-01-01T10:00:00+00:00' END AS reviewed_at,
  CASE WHEN turn % 3 = 2 THEN 'old' ELSE md5(CAST(conv_id % 5 AS VARCHAR)) END AS snapshot_sha256 FROM conversations""",
)
shared(
    "review_states",
    """SELECT *, CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN snapshot_sha256 <> now THEN 'stale'
  WHEN line = max(line) FILTER (problem IS NULL AND snapshot_sha256 = now) OVER (PARTITION BY record_id) THEN 'current' ELSE 'replaced' END AS state
FROM (SELECT r.*, c.snapshot_sha256 AS now, CASE WHEN r.record_id IS NULL THEN 'no record_id' WHEN label = 'maybe' THEN 'label is not a known label'
    WHEN reviewer_type <> 'human' THEN 'the reviewer is not recorded as a human' WHEN reviewed_at = '2024-01-01' THEN 'reviewed_at is not an ISO time with a timezone'
    WHEN c.record_id IS NULL THEN 'no candidate ' || r.record_id END AS problem
  FROM reviews r LEFT JOIN review_candidates c USING (record_id))""",
)
