"""Cases on which a query and its SQL once stated different rules."""

import duckdb
import pytest
from checking import differences

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, **rows):
    con = duckdb.connect()
    for name, (data, kinds) in rows.items():
        spark.createDataFrame(data, kinds).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_blanks_around_a_connective_are_cut(spark, tmp_path):
    texts = ["Agents\nde\nfile the long return today.", "Agents \tde file the long return; \n", "a\nb\tc d e f g h de file every return", None]
    con = tables(spark, tmp_path, documents=([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS))
    found = QUERIES["extract_by_connectives"](spark, str(tmp_path))
    assert differences(found, con, ORACLE["extract_by_connectives"]) is None
    assert ("Agents", "file the long return today") in {(r.actor, r.action) for r in found.collect()}


@pytest.mark.parametrize("name", ["lexical_topk", "retrieve_lexical"])
def test_equal_windows_tie_whatever_their_order(spark, tmp_path, name):
    fill = 5  # words between the windows; the left sum of the first order is the smaller one then

    def text(gaps):
        return " ".join(" ".join(["alpha"] + ["gamma"] * g + ["beta"] + ["gamma"] * fill) for g in gaps)

    orders = [(0, 3, 1), (1, 3, 0), (0, 3, 1)]
    data = [(i, text(gaps), "en", "s", 0) for i, gaps in enumerate(orders)]
    con = tables(spark, tmp_path, documents=(data, DOCUMENTS), benchmark=([(7, "alpha beta")], "item_id long, text string"))
    found = QUERIES[name](spark, str(tmp_path))
    assert differences(found, con, ORACLE[name]) is None
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [0, 1, 2]
