"""Citation graph and point-in-time questions over all derived circulars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from clausegrid.operators import graph as G
from clausegrid.operators import references as R
from clausegrid.operators import temporal as P
from clausegrid.plans.corpora import Corpora
from clausegrid.registry.core import query

AS_OF = [date(year, 1, 1) for year in range(1995, 2002)]
AS_OF_SQL = "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in AS_OF) + "]) AS as_of)"


def citations_of(c: Corpora):
    """The whole job from paragraph texts to citations."""
    p = c.paragraphs.select(F.col("id").alias("paragraph_id"), "circular_id", "text", "char_start")
    refs = R.find_references(p, ["circular_id", "paragraph_id"])
    return G.resolve_citations(refs, R.dated_phrases(p, ["paragraph_id"]), c.circulars)


def supersessions_of(c: Corpora):
    edges = G.supersession_edges(citations_of(c), c.paragraphs, c.circulars)
    return edges.withColumn("edge_id", F.col("superseding_circular_id"))


@query("resolve_citations", "SELECT * EXCLUDE (text) FROM citations")
def _(c: Corpora):
    return citations_of(c)


@query("supersession_edges", "SELECT * FROM supersessions")
def _(c: Corpora):
    return supersessions_of(c)


@query(
    "graph_report",
    """SELECT a.*, b.*, round(citations_resolved / citations_found, 6) AS resolution_rate, e.*
FROM (SELECT count(*) AS citations_found, count(*) FILTER (resolved) AS citations_resolved FROM citations) a,
(SELECT count(*) AS supersessions_found, count(*) FILTER (resolved) AS supersessions_resolved FROM supersessions) b,
(SELECT string_agg(raw_reference, '|' ORDER BY issue_date DESC NULLS LAST, id DESC, citing_paragraph_id, char_start) AS unresolved_examples
 FROM (SELECT x.*, k.issue_date, k.id FROM citations x JOIN circulars k ON k.id = x.citing_circular_id WHERE NOT resolved
   ORDER BY issue_date DESC NULLS LAST, k.id DESC, citing_paragraph_id, char_start LIMIT 20)) e""",
)
def _(c: Corpora):
    cited = c.citations
    edges = G.supersession_edges(cited, c.paragraphs, c.circulars)
    return G.graph_report(cited, edges, c.circulars).withColumn(
        "resolution_rate", F.round("resolution_rate", 6)
    )


@query("resolution_stats", "SELECT count(*) FILTER (resolved) AS resolved, count(*) AS total FROM citations")
def _(c: Corpora):
    return G.resolution_stats(c.citations)


@query(
    "outbound_edges",
    """SELECT x.* EXCLUDE (text), k.circular_number AS cited_number, k.title AS cited_title
FROM citations x LEFT JOIN circulars k ON k.id = x.cited_circular_id""",
)
def _(c: Corpora):
    return G.outbound_edges(c.citations, c.circulars)


@query(
    "inbound_edges",
    """SELECT x.* EXCLUDE (text), k.circular_number AS citing_number, k.title AS citing_title
FROM citations x LEFT JOIN circulars k ON k.id = x.citing_circular_id WHERE cited_circular_id IS NOT NULL""",
)
def _(c: Corpora):
    return G.inbound_edges(c.citations, c.circulars)


_CHAIN = """SELECT superseding_circular_id AS circular_id, 'outgoing' AS direction, edge_id, superseding_circular_id,
  superseded_circular_id, supersession_type, effective_date, resolved,
  supersession_type IN ('supersedes', 'rescinds') AS removes_from_force FROM supersessions
UNION ALL SELECT superseded_circular_id, 'incoming', edge_id, superseding_circular_id, superseded_circular_id,
  supersession_type, effective_date, resolved, supersession_type IN ('supersedes', 'rescinds')
FROM supersessions WHERE superseded_circular_id IS NOT NULL"""


@query("amendment_chain", _CHAIN)
def _(c: Corpora):
    return G.amendment_chain(c.supersessions)


_GONE = """(SELECT DISTINCT as_of, superseded_circular_id AS id FROM supersessions, {dates}
  WHERE resolved AND supersession_type IN ('supersedes', 'rescinds') AND effective_date <= as_of)""".format(
    dates=AS_OF_SQL
)


@query("out_of_force_ids", f"SELECT * FROM {_GONE}")
def _(c: Corpora):
    return P.out_of_force_ids(c.supersessions, AS_OF)


@query(
    "in_force_as_of",
    f"""SELECT as_of, id FROM circulars k, {AS_OF_SQL} d WHERE issue_date <= as_of
  AND NOT EXISTS (SELECT 1 FROM {_GONE} g WHERE g.id = k.id AND g.as_of = d.as_of)""",
)
def _(c: Corpora):
    return P.in_force_as_of(c.circulars, c.supersessions, AS_OF)


@query(
    "force_state",
    f"""SELECT id, as_of, state, CASE WHEN state = 'out-of-force' THEN since END AS since,
  CASE WHEN state = 'out-of-force' THEN by_edge END AS by_edge,
  CASE WHEN state = 'in-force' THEN amended END AS amended_by, CASE WHEN state = 'in-force' THEN undated END AS undated_removals
FROM (SELECT *, CASE WHEN issue_date IS NULL THEN 'unknown-date' WHEN issue_date > as_of THEN 'not-issued'
    WHEN since IS NOT NULL THEN 'out-of-force' ELSE 'in-force' END AS state
  FROM (SELECT k.id, k.issue_date, as_of,
      min(s.effective_date) FILTER (supersession_type = 'supersedes' AND s.effective_date <= as_of) AS since,
      arg_min(s.edge_id, (s.effective_date, s.edge_id)) FILTER (supersession_type = 'supersedes' AND s.effective_date <= as_of) AS by_edge,
      count(*) FILTER (supersession_type = 'partial' AND (s.effective_date IS NULL OR s.effective_date <= as_of)) AS amended,
      count(*) FILTER (supersession_type = 'supersedes' AND s.effective_date IS NULL) AS undated
    FROM circulars k CROSS JOIN {AS_OF_SQL} LEFT JOIN supersessions s ON s.superseded_circular_id = k.id AND s.resolved
    GROUP BY ALL))""",
)
def _(c: Corpora):
    return P.force_state(c.circulars, c.supersessions, AS_OF)


@query(
    "amending_edges",
    f"""SELECT as_of, superseded_circular_id AS id, edge_id FROM supersessions, {AS_OF_SQL}
WHERE resolved AND supersession_type = 'partial' AND (effective_date IS NULL OR effective_date <= as_of)""",
)
def _(c: Corpora):
    return P.amending_edges(c.supersessions, AS_OF)


_SPINE = f"""SELECT id AS selected_id, id AS neighbour_id, issue_date, NULL AS relation,
  coalesce(issue_date > DATE '1998-01-01', false) AS after_marker FROM circulars
UNION ALL
SELECT circular_id, other, k.issue_date, CASE direction WHEN 'outgoing' THEN 'Taken out of force by the selected circular'
  ELSE 'Takes the selected circular out of force' END
  || coalesce(' from ' || strftime(effective_date, '%Y-%m-%d'), ' (no effective date recorded)'),
  coalesce(k.issue_date > DATE '1998-01-01', false)
FROM (SELECT *, CASE direction WHEN 'outgoing' THEN superseded_circular_id ELSE superseding_circular_id END AS other FROM ({_CHAIN})) e
JOIN circulars k ON k.id = other WHERE other <> circular_id"""


@query("timeline", _SPINE)
def _(c: Corpora):
    return P.timeline(c.circulars, G.amendment_chain(c.supersessions), date(1998, 1, 1))


@query(
    "timeline_marker",
    f"SELECT selected_id, count(*) FILTER (NOT after_marker) AS marker_at FROM ({_SPINE}) GROUP BY 1",
)
def _(c: Corpora):
    spine = P.timeline(c.circulars, G.amendment_chain(c.supersessions), date(1998, 1, 1))
    return P.marker_position(spine)
