"""The vector index and the blocked postings against exact scans."""

import numpy as np
import pytest

from clausegrid.operators import retrieval as R
from clausegrid.operators import vector_index as V
from clausegrid.operators.indexing import embed_texts, index_text
from clausegrid.operators.lexical_index import block_postings, candidate_blocks, index_blocks, read_blocks


def clustered(n, clusters, dim=24, spread=0.05, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return [(i, (centres[i % clusters] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(6000, 60) + [(9001, [0.0] * 24), (9002, None), (9003, [float("nan")] * 24), (9004, [1.0] * 24), (9005, [1.0] * 24)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    return vectors, V.build_index(vectors, str(tmp_path_factory.mktemp("index")))


def test_exact_and_reads_a_tenth_of_the_pairs(spark, built):
    vectors, index = built
    asked = vectors.where("chunk_id % 50 = 0 OR chunk_id > 9000").withColumnRenamed("chunk_id", "query_id")
    usable = vectors.where("chunk_id not in (9001, 9002, 9003)")
    want = hits(R.dense_topk(asked.where("query_id not in (9001, 9002, 9003)"), usable, 20))
    assert hits(V.indexed_topk(asked, index, 20)) == want
    known = V._usable(asked)
    first = V.first_cells(known, index, 20)
    nth = {q: s for q, r, _, s in want if r == 20}
    worst = spark.createDataFrame(list(nth.items()), "query_id long, worst double")
    more = V.further_cells(known.join(worst, "query_id"), first, index)
    read = V.pairs_read(first, index).first().pairs + V.pairs_read(more, index).first().pairs
    assert read < 0.1 * known.count() * usable.count()
    assert sum(index.size) == usable.count()


def test_probes_are_approximate_and_measured(spark, built):
    vectors, index = built
    asked = vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(q, c) for q, _, c, _ in hits(V.indexed_topk(asked, index, 20))}
    near = {(q, c) for q, _, c, _ in hits(V.indexed_topk(asked, index, 20, probes=2))}
    assert len(exact & near) >= 0.9 * len(exact)


def test_dates_apply_inside_the_index(spark, tmp_path):
    rows = [(i, v, 10 + i % 7, 40 - i % 5) for i, v in clustered(800, 10)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>, valid_from int, valid_until int")
    asked = spark.createDataFrame([(i, rows[i][1], 9 + i) for i in range(0, 30)], "query_id long, vector array<double>, as_of_day int")
    index = V.build_index(vectors, str(tmp_path / "dated"))
    assert hits(V.indexed_topk(asked, index, 5)) == hits(R.dense_topk(asked, vectors, 5))


def test_empty_and_tiny_tables(spark, tmp_path):
    schema = "chunk_id long, vector array<double>"
    none = V.build_index(spark.createDataFrame([], schema), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert V.indexed_topk(asked, none).count() == 0
    one = V.build_index(spark.createDataFrame([(7, [1.0, 1.0]), (7, [1.0, 1.0])], schema), str(tmp_path / "one"))
    assert [(q, c) for q, _, c, _ in hits(V.indexed_topk(asked, one))] == [(1, 7), (1, 7)]


def words(n, seed=9):
    rng = np.random.default_rng(seed)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("rst", "lmn", "ndo")]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    return [(i, " ".join(rng.choice(vocabulary, size=rng.integers(5, 60), p=weight / weight.sum()))) for i in range(n)]


@pytest.mark.parametrize("block", [4, 64])
def test_blocks_give_the_same_hits(spark, block):
    texts = words(700)
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    postings = index_text(chunks)
    blocks = block_postings(postings, len(texts), block).persist()
    asked = [(i, " ".join(texts[i * 7][1].split()[:k])) for i, k in zip(range(60), [1, 2, 3, 4, 5] * 12)]
    asked += [(90, "unknownword " + texts[0][1]), (91, ""), (92, None), (93, texts[3][1]), (93, texts[3][1])][:4]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    assert hits(R.lexical_topk(queries, blocks, 5)) == hits(R.lexical_topk(queries, postings, 5))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [4, 64])
def test_blocks_made_of_texts_without_a_shuffle_give_the_same_hits(spark, block):
    texts = words(700) + [(700, None), (701, ""), (702, "The of and"), (703, "bast-like " * 3000)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    postings = index_text(chunks)
    blocks = index_blocks(chunks, block)
    assert "Exchange" not in plan_of(index_blocks(spark.createDataFrame(texts, "chunk_id long, text string")))
    entries = blocks.select("term", "block", "n", "max_count", R.F.explode(R.F.arrays_zip("ids", "positions")).alias("e"))
    want = sorted(tuple(r) for r in postings.select("term", "chunk_id", "positions").collect())
    assert sorted(tuple(r) for r in entries.select("term", "e.ids", "e.positions").collect()) == want
    assert blocks.where("n <> size(ids) OR max_count <> array_max(transform(positions, p -> size(p)))").count() == 0
    assert entries.groupBy("block").agg(R.F.count_distinct("e.ids").alias("n")).where(f"n > {block}").count() == 0
    asked = [(i, " ".join(texts[i * 7][1].split()[:k])) for i, k in zip(range(60), [1, 2, 3, 4, 5] * 12)]
    asked += [(90, "unknownword " + texts[0][1]), (91, ""), (92, None), (93, texts[3][1])]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    assert hits(R.lexical_topk(queries, blocks.persist(), 5)) == hits(R.lexical_topk(queries, postings, 5))


def test_texts_are_encoded_where_they_are_read(spark):
    from collections import Counter

    from clausegrid.functions import text as T
    from clausegrid.functions.ranking import hash_draw

    texts = words(60) + [(60, None), (61, ""), (62, "The of and")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    got = embed_texts(chunks, "chunk_id", 16)
    assert "Exchange" not in plan_of(got)
    drawn = chunks.select("chunk_id", R.F.transform(T.term_occurrences(R.F.col("text")), lambda t: hash_draw(t, R.F.lit(16))).alias("slots"))
    want = {}
    for r in drawn.where("size(slots) > 0").collect():
        tf = Counter(r.slots)
        norm = sum(v * v for v in tf.values()) ** 0.5
        want[r.chunk_id] = [tf[i] / norm for i in range(16)]
    assert {r.chunk_id: r.vector for r in got.collect()} == want and len(want) == 60


def test_bound_holds_and_saves_reading(spark):
    # One text in forty is ten times as long: blocks without one cannot reach the best scores. Where all texts
    # are alike the bound saves little.
    texts = [(i, (t + " ") * (10 if i % 40 == 0 else 1)) for i, t in words(2000, 3)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    blocks = block_postings(index_text(chunks), len(texts), 8).persist()
    queries = spark.createDataFrame([(i, " ".join(texts[i][1].split()[:2])) for i in range(40)], "query_id long, text string")
    terms = R.query_terms_table(queries)
    candidates = candidate_blocks(terms, blocks).persist()
    every = read_blocks(candidates, terms, blocks).withColumn("score", R.cover_density(R.F.col("hits"), R.F.col("n_terms")))
    best = every.groupBy("query_id").agg(R.F.max("score").alias("best")).join(
        candidates.groupBy("query_id").agg(R.F.max("bound").alias("bound")), "query_id")
    assert best.where("best > bound + 1e-9").count() == 0
    looks = []

    def score(wanted):
        looks.append(wanted.count())
        return read_blocks(wanted, terms, blocks).select("query_id", "chunk_id", R.cover_density(R.F.col("hits"), R.F.col("n_terms")).alias("score"))

    from clausegrid.operators.lexical_index import two_looks

    got = hits(two_looks(candidates, score, 3, first=4))
    assert got == hits(R.lexical_topk(queries, index_text(chunks), 3))
    assert sum(looks) < 0.8 * candidates.count()


def test_queries_are_the_ids_divisible_by_100_against_every_vector(spark):
    import __spark_entry__ as entry

    found = entry.queries()["dense_topk_indexed"](spark, "/root/testdata/sf0.001").collect()
    assert {r.query_id % 100 for r in found} == {0} and any(r.chunk_id % 100 for r in found)


def test_exclusions_read_blocks_only(spark, monkeypatch):
    import __spark_entry__ as entry

    def whole(*_):
        raise AssertionError("the whole posting table is joined")

    monkeypatch.setattr(R, "matching_chunks", whole)
    assert entry.queries()["temporal_exclusions"](spark, "/root/testdata/sf0.001").columns == ["query_id", "circular_id"]


@pytest.mark.parametrize("name", ["dense_topk", "dense_topk_indexed", "dense_topk_hashed"])
def test_every_vector_is_a_query(spark, name):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    every = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in entry.queries()[name](spark, folder).select("query_id").collect()} == every


@pytest.mark.parametrize("name", ["dense_topk", "dense_topk_indexed"])
def test_the_sql_of_searches_asks_for_every_vector(name):
    import __spark_entry__ as entry
    from checking import connect

    con = connect("/root/testdata/sf0.001")
    asked = con.execute(f"SELECT count(DISTINCT query_id) FROM ({entry.oracle_sql()[name]})").fetchone()
    assert asked == con.execute("SELECT count(*) FROM embeddings").fetchone()


def test_second_look_gives_only_what_can_be_among_the_best(spark):
    rows = clustered(400, 4)
    left = spark.createDataFrame([(0, i, v, 0.999 if i else None) for i, v in rows[:2]], "cell int, query_id long, vector array<double>, worst double")
    right = spark.createDataFrame([(0, i, v) for i, v in rows], "cell int, chunk_id long, vector array<double>")
    every = {(q, c): s for q, c, s in R.best_of_cells(left.drop("worst"), right, ["cell"], 100, cut=False).collect()}
    near = {(q, c): s for q, c, s in R.best_of_cells(left, right, ["cell"], 100, cut=False).collect()}
    assert near == {k: s for k, s in every.items() if k[0] == 0 or s >= 0.999}
    assert 0 < sum(q for q, _ in near) < 100 == sum(q for q, _ in every)
