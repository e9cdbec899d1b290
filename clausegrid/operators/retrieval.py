"""Ranking chunks for whole query sets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import top_n
from clausegrid.operators.indexing import embed_queries, embed_texts, index_text
from clausegrid.operators.lexical_index import candidate_blocks, read_blocks, two_looks
from clausegrid.operators.temporal import removals
from clausegrid.session import cut_lineage

NEVER = 2**31 - 1  # a day number after every date
SCORE_DIGITS = 9


def search_filters(
    circulars: DataFrame,
    department: str | None = None,
    doc_type: str | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Metadata predicates, pushed to the scan of the circulars."""
    for column, value in (("department", department), ("doc_type", doc_type)):
        if value:
            circulars = circulars.where(F.col(column) == value)
    if date_from:
        circulars = circulars.where(F.col("issue_date") >= F.lit(date_from))
    if date_to:
        circulars = circulars.where(F.col("issue_date") <= F.lit(date_to))
    return circulars


def validity(chunks: DataFrame, circulars: DataFrame, supersessions: DataFrame) -> DataFrame:
    """(chunk_id, circular_id, valid_from, valid_until) as day numbers; undated circulars never qualify."""
    gone = removals(supersessions).select(F.col("id").alias("circular_id"), "out_since")
    dated = circulars.where(F.col("issue_date").isNotNull()).select(
        F.col("id").alias("circular_id"), F.unix_date("issue_date").alias("valid_from")
    )
    return (
        chunks.select("chunk_id", "circular_id")
        .join(dated, "circular_id")
        .join(gone, "circular_id", "left")
        .select(
            "chunk_id",
            "circular_id",
            "valid_from",
            F.coalesce(F.unix_date("out_since"), F.lit(NEVER)).alias("valid_until"),
        )
    )


# --- dense ------------------------------------------------------------------------------


def dense_topk(
    queries: DataFrame,
    chunks: DataFrame,
    n: int = K.RETRIEVE_TOP_N,
    query_block: int = 512,
    chunk_block: int = 16384,
) -> DataFrame:
    """Exact cosine top-n: (query_id, vector[, as_of_day]) against (chunk_id, vector[, valid_from, valid_until]).

    Both sides are cut into blocks of bounded size (the numbers of rows decide how many), and
    each pair of blocks is one matrix product that emits only its n best per query. Pairs are
    never rows, nothing passes through the driver but two counts, and the final cut sees at
    most n rows per query and block.
    """
    q_blocks = max(1, math.ceil(queries.count() / query_block))
    c_blocks = max(1, math.ceil(chunks.count() / chunk_block))
    left = _spread(queries, "query_id", "qb", q_blocks, "cb", c_blocks)
    right = _spread(chunks, "chunk_id", "cb", c_blocks, "qb", q_blocks)
    return best_of_cells(left, right, ["qb", "cb"], n)


def dense_topk_hashed(
    queries: DataFrame,
    chunks: DataFrame,
    n: int = K.RETRIEVE_TOP_N,
    tables: int = 6,
    bits: int = 4,
    dim: int = K.VECTOR_DIM,
    query_block: int = 512,
    chunk_block: int = 16384,
) -> DataFrame:
    """Approximate top-n: only chunks that share a random-hyperplane signature in some table are scored.

    A crowded signature is cut into blocks like the exact scan, so no task holds more than a
    block of each side. Scores are exact; neighbours may be missed.
    """
    q_blocks = max(1, math.ceil(queries.count() / query_block))
    c_blocks = max(1, math.ceil(chunks.count() / chunk_block))
    left = _signed(_spread(queries, "query_id", "qb", q_blocks, "cb", c_blocks), tables, bits, dim)
    right = _signed(_spread(chunks, "chunk_id", "cb", c_blocks, "qb", q_blocks), tables, bits, dim)
    found = best_of_cells(left, right, ["table", "signature", "qb", "cb"], n, cut=False)
    once = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_n(once, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], n)


def _spread(df: DataFrame, key: str, own: str, blocks: int, other: str, copies: int) -> DataFrame:
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )


def _signed(df: DataFrame, tables: int, bits: int, dim: int) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def signatures(vectors: pd.Series) -> pd.Series:
        planes = np.random.default_rng(K.SAMPLE_SEED).standard_normal((dim, tables * bits))
        signs = (np.stack(vectors.to_numpy()) @ planes > 0).reshape(-1, tables, bits)
        return pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2).astype("int32")))

    return df.select("*", F.posexplode(signatures("vector")).alias("table", "signature"))


def best_of_cells(left: DataFrame, right: DataFrame, cells: list[str], n: int, cut: bool = True) -> DataFrame:
    """The n best of each query in each cell; scores under a query's ``worst``, where it has one, are left out."""
    dated = "as_of_day" in left.columns and "valid_from" in right.columns
    bounded = "worst" in left.columns

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "chunk_id", "score"]
        if q.empty or c.empty:
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in zip(names, ("int64", "int64", "float64"))})
        a = np.stack(q["vector"].to_numpy()).astype("float64")
        b = np.stack(c["vector"].to_numpy()).astype("float64")
        with np.errstate(divide="ignore", invalid="ignore"):
            sims = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
        # Equal texts must tie exactly whatever the blocking, so that ids decide between them.
        sims = np.round(sims, SCORE_DIGITS)
        sims[~np.isfinite(sims)] = -np.inf
        if dated:
            day = q["as_of_day"].to_numpy()[:, None]
            open_ = (c["valid_from"].to_numpy()[None, :] <= day) & (c["valid_until"].to_numpy()[None, :] > day)
            sims[~open_] = -np.inf
        if bounded:
            sims[sims < q["worst"].fillna(-np.inf).to_numpy(dtype="float64")[:, None]] = -np.inf
        ids, found, scores = c["chunk_id"].to_numpy(), [], []
        for s in sims:
            pool = np.flatnonzero(s > -np.inf)
            if len(pool) > n:
                worst = np.partition(s[pool], len(pool) - n)[len(pool) - n]
                pool = pool[s[pool] >= worst]
            order = pool[np.lexsort((ids[pool], -s[pool]))][:n]
            found.append(ids[order])
            scores.append(s[order])
        asked = np.repeat(q["query_id"].to_numpy(), [len(f) for f in found])
        return pd.DataFrame({"query_id": asked, "chunk_id": np.concatenate(found), "score": np.concatenate(scores)})

    wanted_q = cells + ["query_id", "vector"] + (["as_of_day"] if dated else []) + (["worst"] if bounded else [])
    wanted_c = cells + ["chunk_id", "vector"] + (["valid_from", "valid_until"] if dated else [])
    best = (
        left.select(*wanted_q)
        .groupBy(*cells)
        .cogroup(right.select(*wanted_c).groupBy(*cells))
        .applyInPandas(score, "query_id long, chunk_id long, score double")
    )
    if not cut:
        return best
    return top_n(best, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], n)


# --- lexical ----------------------------------------------------------------------------


def query_terms_table(queries: DataFrame) -> DataFrame:
    """(query_id, text) → one row per distinct content word, numbered, with their count."""
    terms = queries.select("query_id", T.content_terms(F.col("text")).alias("terms"))
    return terms.select(
        "query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("term_no", "term")
    )


def matching_chunks(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hits) for chunks holding *every* term of the query.

    Candidates come from the query's rarest word only; the other words are then looked up by
    (chunk, word). A common word is never joined across the collection unless it is the rarest
    one, when every chunk it yields has to be looked at anyway.
    """
    wanted = terms.select("term").distinct()
    df = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = (
        terms.join(df, "term", "left")
        .groupBy("query_id")
        .agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    )
    candidates = rarest.join(postings.select("term", "chunk_id"), "term").select("query_id", "chunk_id")
    looked_up = candidates.join(terms, "query_id").join(postings, ["chunk_id", "term"])
    return (
        looked_up.groupBy("query_id", "chunk_id")
        .agg(
            F.count("*").alias("matched"),
            F.first("n_terms").alias("n_terms"),
            F.flatten(
                F.collect_list(
                    F.transform(
                        "positions",
                        lambda p: F.struct(p.alias("pos"), F.col("term_no").alias("term_no")),
                    )
                )
            ).alias("hits"),
        )
        .where("matched = n_terms")
        .drop("matched")
    )


def cover_density(hits: Column, n_terms: Column) -> Column:
    """Sum over minimal windows holding all terms of 0.1 / (1 + other words inside).

    Walking the sorted hits, the latest position of every term is kept; the window that ends at
    a hit starts at the earliest of them and is minimal when that start has moved.
    """
    unseen = F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.lit(-1))
    zero = F.struct(
        unseen.alias("place"),
        unseen.alias("index"),
        F.lit(-1).alias("open"),
        F.lit(0).alias("seen"),
        F.lit(0.0).alias("score"),
    )

    def step(acc, hit):
        place = F.transform(acc["place"], lambda p, i: F.when(i == hit["term_no"], hit["pos"]).otherwise(p))
        index = F.transform(acc["index"], lambda p, i: F.when(i == hit["term_no"], acc["seen"]).otherwise(p))
        start, others = F.array_min(place), acc["seen"] - F.array_min(index)
        gain = F.when(
            (start >= 0) & (start != acc["open"]), 0.1 / (1 + hit["pos"] - start - others)
        ).otherwise(0.0)
        return F.struct(
            place.alias("place"),
            index.alias("index"),
            start.alias("open"),
            (acc["seen"] + 1).alias("seen"),
            (acc["score"] + gain).alias("score"),
        )

    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["score"])


def lexical_topk(
    queries: DataFrame,
    postings: DataFrame,
    n: int = K.RETRIEVE_TOP_N,
    valid: DataFrame | None = None,
) -> DataFrame:
    """All query words must occur; ranked by cover density, ties by chunk id.

    ``postings`` may be plain ones (chunk_id, term, positions) or blocks of them (``block_postings``), of which only
    those are read that can hold one of the n best.
    """
    terms = query_terms_table(queries)

    def scored(found: DataFrame) -> DataFrame:
        if valid is not None:
            days = queries.select("query_id", "as_of_day")
            found = (
                found.join(valid, "chunk_id")
                .join(days, "query_id")
                .where("valid_from <= as_of_day AND valid_until > as_of_day")
            )
        # Equal sums must tie whatever the order of the windows, so that ids decide between them.
        density = F.round(cover_density(F.col("hits"), F.col("n_terms")), SCORE_DIGITS)
        return found.select("query_id", "chunk_id", density.alias("score"))

    if "block" in postings.columns:
        return two_looks(candidate_blocks(terms, postings), lambda some: scored(read_blocks(some, terms, postings)), n)
    found = scored(matching_chunks(terms, postings))
    return top_n(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], n)


# --- fusion, rescoring, refusal ----------------------------------------------------------


def rrf_fusion(hits: DataFrame, k: int = K.RRF_K, n: int | None = None) -> DataFrame:
    """(query_id, retriever, chunk_id, rank) → reciprocal rank fusion with ranks and contributions."""
    best = hits.groupBy("query_id", "chunk_id", "retriever").agg(F.min("rank").alias("rank"))
    part = 1.0 / (k + F.col("rank"))
    fused = best.groupBy("query_id", "chunk_id").agg(
        F.sum(part).alias("rrf_score"),
        F.min(F.when(F.col("retriever") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("retriever") == "lexical", F.col("rank"))).alias("lexical_rank"),
        F.map_from_entries(F.collect_list(F.struct("retriever", part))).alias("contributions"),
    )
    order = [F.col("rrf_score").desc(), F.col("chunk_id").asc()]
    return top_n(fused, ["query_id"], order, n or NEVER)


def overlap_score(query: Column, passage: Column) -> Column:
    """Default pair scorer: share of the query's content words that the passage holds."""
    terms = T.content_terms(query)
    shared = F.size(F.array_intersect(terms, T.content_terms(passage)))
    return F.when(F.size(terms) > 0, shared / F.size(terms)).otherwise(0.0)


def pair_rescore(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Order candidates by a pair score; ``scorer`` may be a pandas UDF around a model."""
    joined = candidates.join(queries.select("query_id", F.col("text").alias("__q")), "query_id").join(
        chunks.select("chunk_id", F.col("text").alias("__p")), "chunk_id"
    )
    scored = joined.withColumn("score", scorer(F.col("__q"), F.col("__p"))).drop("__q", "__p")
    return top_n(
        scored.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], NEVER
    )


def refusal_gate(
    hits: DataFrame,
    queries: DataFrame,
    threshold: float = K.RELEVANCE_THRESHOLD,
    apply_threshold: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(kept hits, one row per query with top_score and below_threshold); no hit is no refusal."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    below = F.coalesce(F.col("top_score") < threshold, F.lit(False))
    verdict = queries.select("query_id").join(top, "query_id", "left").withColumn("below_threshold", below)
    if not apply_threshold:
        return hits, verdict
    kept = hits.join(verdict.where("below_threshold").select("query_id"), "query_id", "left_anti")
    return kept, verdict


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    mode: str,
    postings: DataFrame | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    valid: DataFrame | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_score,
    n: int = K.RETRIEVE_TOP_N,
    top_k: int = K.RERANK_TOP_K,
    nearest: Callable[[DataFrame, DataFrame, int], DataFrame] = dense_topk,
) -> DataFrame:
    """Ranked hits (query_id, chunk_id, rank, score, score_kind, rrf_score) in one of four modes.

    ``queries``: query_id, text[, as_of_day]; ``chunks``: chunk_id, text. Indexes and vectors
    may be given when they are stored; otherwise they are derived from the texts. ``nearest`` finds the
    neighbours of query vectors; a search of a vector index may stand for the exact scan.
    """
    lists = {}
    if mode != "dense":
        postings = index_text(chunks) if postings is None else postings
        lists["lexical"] = lexical_topk(queries, postings, n, valid)
    if mode != "lexical":
        vectors = embed_texts(chunks, "chunk_id") if vectors is None else vectors
        asked = embed_queries(queries) if query_vectors is None else query_vectors
        if valid is not None:
            vectors = vectors.join(valid.drop("circular_id"), "chunk_id")
            asked = asked.join(queries.select("query_id", "as_of_day"), "query_id")
        lists["dense"] = nearest(asked, vectors, n)
    no_rrf = F.lit(None).cast("double").alias("rrf_score")
    if mode in ("dense", "lexical"):
        kind = "cosine_similarity" if mode == "dense" else "ts_rank_cd"
        return lists[mode].where(F.col("rank") <= top_k).select(
            "query_id", "chunk_id", "rank", "score", F.lit(kind).alias("score_kind"), no_rrf
        )
    ranked = [df.select("query_id", "chunk_id", "rank", F.lit(name).alias("retriever")) for name, df in lists.items()]
    fused = rrf_fusion(ranked[0].unionByName(ranked[1]), n=n)
    if mode == "hybrid":
        return fused.where(F.col("rank") <= top_k).select(
            "query_id", "chunk_id", "rank", F.col("rrf_score").alias("score"), F.lit("rrf").alias("score_kind"), "rrf_score"
        )
    rescored = pair_rescore(fused.select("query_id", "chunk_id", "rrf_score"), queries, chunks, scorer)
    return rescored.where(F.col("rank") <= top_k).select(
        "query_id", "chunk_id", "rank", "score", F.lit("pair_score").alias("score_kind"), "rrf_score"
    )


def retrieve_or_refuse(
    queries: DataFrame,
    chunks: DataFrame,
    mode: str,
    threshold: float = K.RELEVANCE_THRESHOLD,
    apply_threshold: bool = True,
    **how,
) -> tuple[DataFrame, DataFrame]:
    """(hits, one row per query with top_score, threshold and below_threshold), as a user asks for them.

    Only pair scores lie on the scale of the threshold, so only ``hybrid_rerank`` refuses: a query whose best score
    is below it keeps no hits, unless ``apply_threshold`` is off. ``how`` goes to ``retrieve``.
    """
    hits = cut_lineage(retrieve(queries, chunks, mode, **how))
    gated = mode == "hybrid_rerank"
    kept, verdict = refusal_gate(hits, queries, threshold if gated else float("-inf"), gated and apply_threshold)
    limit = F.lit(threshold if gated else None).cast("double")
    return kept, verdict.select("query_id", "top_score", limit.alias("threshold"), "below_threshold")


def temporal_exclusions(
    queries: DataFrame,
    chunks: DataFrame,
    valid: DataFrame,
    n: int = K.RETRIEVE_TOP_N,
    top_k: int = K.RERANK_TOP_K,
    **stored: DataFrame,
) -> DataFrame:
    """What would have ranked on each query's date but was already out of force, by circular.

    Retrieval runs again with every circular issued by the date allowed, superseded or not; of
    the fused top the ones out of force on the date are reported.
    """
    issued = valid.withColumn("valid_until", F.lit(NEVER))
    fused = retrieve(queries, chunks, "hybrid", valid=issued, n=n, top_k=top_k, **stored)
    days = queries.select("query_id", "as_of_day")
    return (
        fused.join(valid, "chunk_id")
        .join(days, "query_id")
        .where("valid_until <= as_of_day")
        .select("query_id", "circular_id")
        .distinct()
    )


def hydrate_hits(hits: DataFrame, chunks: DataFrame, circulars: DataFrame) -> DataFrame:
    """Texts and circular attributes join after the cut; hits whose chunk is gone drop out."""
    body = chunks.select("chunk_id", "circular_id", "text")
    names = circulars.select(
        F.col("id").alias("circular_id"), "circular_number", "title", "issue_date"
    )
    return hits.join(body, "chunk_id").join(names, "circular_id", "left")


def distinct_document_ranking(
    hits: DataFrame, excluded: DataFrame | None = None, cutoff: int = K.RANKING_CUTOFF
) -> DataFrame:
    """(query_id, document, rank, score) → distinct documents in rank order, citing one removed.

    The result is one row per query that has any: the list of at most ``cutoff`` documents and
    the best score among them.
    """
    if excluded is not None:
        hits = hits.join(excluded.select("query_id", "document"), ["query_id", "document"], "left_anti")
    best = hits.groupBy("query_id", "document").agg(
        F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score")
    )
    kept = top_n(best, ["query_id"], [F.col("rank").asc()], cutoff, "place")
    return kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "document")))["document"].alias("retrieved"),
        F.min_by("score", "place").alias("top_score"),
    )
