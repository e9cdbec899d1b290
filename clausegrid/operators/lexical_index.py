"""Postings in blocks: an inverted index whose block heads tell which blocks need not be read.

Chunks are dealt into blocks of at most about ``BLOCK`` of them. A row holds the postings of one term in one block;
its head (number of chunks, largest term count) is read without them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions.ranking import top_n
from clausegrid.operators.indexing import terms_in_place
from clausegrid.session import cut_lineage

#: Chunks of a block, and blocks of a query that are read before its n-th best score bounds the others.
BLOCK = 256
FIRST_BLOCKS = 16
#: Rows up to which terms or blocks of the queries are sent to every task; more are joined by shuffling.
BROADCAST_ROWS = 200_000
HEAD = ["term", "block", "n", "max_count"]


def block_postings(postings: DataFrame, chunks: int, block: int = BLOCK) -> DataFrame:
    """(chunk_id, term, positions) of ``chunks`` chunks as rows (term, block, n, max_count, ids, positions).

    Dealt by ranges of (term, block) and sorted, so that written files and their row groups hold few terms each.
    The block of a chunk follows from the hash of its id; a frequent term has one row for each block.
    """
    blocks = max(1, math.ceil(chunks / block))
    entry = F.struct("chunk_id", "positions")
    rows = (
        postings.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
        .groupBy("term", "block")
        .agg(
            F.count("*").alias("n"),
            F.max(F.size("positions")).alias("max_count"),
            F.array_sort(F.collect_list(entry)).alias("entries"),
        )
    )
    return (
        rows.select(*HEAD, F.col("entries.chunk_id").alias("ids"), F.col("entries.positions").alias("positions"))
        .repartitionByRange("term", "block")
        .sortWithinPartitions("term", "block")
    )


def index_blocks(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chunk_id, text) → the rows of ``block_postings``, without any shuffle.

    A block is made of chunks that a task reads one after another, so the words of a chunk never leave its task. A
    block's number holds the task's in its upper half.
    """
    listed = S.ArrayType(S.ArrayType(S.IntegerType()))
    fields = [("term", S.StringType()), ("block", S.LongType()), ("n", S.LongType()), ("max_count", S.IntegerType())]
    schema = S.StructType([S.StructField(*f) for f in [*fields, ("ids", S.ArrayType(chunks.schema["chunk_id"].dataType)), ("positions", listed)]])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                blocks = math.ceil(batch.num_rows / block)
                yield _blocks_of(batch, number, blocks)
                number += blocks

    return chunks.select("chunk_id", terms_in_place(F.col("text")).alias("words")).mapInArrow(blocked, schema)


def _blocks_of(batch: pa.RecordBatch, number: int, blocks: int) -> pa.RecordBatch:
    """Chunks and their words cut into ``blocks`` blocks: one row per term and block, by term, then block."""
    batch = batch.take(pc.sort_indices(batch["chunk_id"]))
    words = batch["words"]
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    flat, row = words.flatten(), np.repeat(np.arange(batch.num_rows), counts)
    pos = np.arange(len(flat)) - (np.cumsum(counts) - counts)[row]
    kept = flat.is_valid().to_numpy(zero_copy_only=False)
    row, pos, terms = row[kept], pos[kept], flat.drop_null().dictionary_encode()
    by_name = pc.sort_indices(terms.dictionary).to_numpy()
    rank = np.empty(len(by_name), "int64")
    rank[by_name] = np.arange(len(by_name))
    key = rank[terms.indices.to_numpy()] * blocks + row * blocks // batch.num_rows
    # Chunks stand by id and words by place, so a stable order by term and block keeps both.
    order = np.argsort(key, kind="stable")
    key, row, pos = key[order], row[order], pos[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    entries = np.flatnonzero(fresh)
    lengths = np.diff(np.append(entries, len(key)))
    fresh = np.ones(len(entries), bool)
    fresh[1:] = key[entries[1:]] != key[entries[:-1]]
    groups = np.flatnonzero(fresh)
    key = key[entries[groups]]
    starts = pa.array(np.append(groups, len(entries)), "int32")
    places = pa.ListArray.from_arrays(pa.array(np.append(entries, len(order)), "int32"), pa.array(pos, "int32"))
    columns = {
        "term": terms.dictionary.take(pa.array(by_name[key // blocks])),
        "block": pa.array(number + key % blocks, "int64"),
        "n": pa.array(np.diff(np.append(groups, len(entries))), "int64"),
        "max_count": pa.array(np.maximum.reduceat(lengths, groups) if len(groups) else lengths, "int32"),
        "ids": pa.ListArray.from_arrays(starts, batch["chunk_id"].take(pa.array(row[entries]))),
        "positions": pa.ListArray.from_arrays(starts, places),
    }
    return pa.RecordBatch.from_pydict(columns)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def candidate_blocks(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, block, bound): blocks in which every term of the query occurs, and the best score one can give.

    ``terms``: query_id, n_terms, term_no, term. Heads are read once; where a task holds whole blocks, those of
    a query are counted before anything is shuffled. Minimal windows around one occurrence start with different terms,
    so a chunk has at most ``n_terms`` times as many as its scarcest term has occurrences, and no more than it has
    hits; each scores a tenth at most.
    """
    asked = blocks.select(*HEAD).join(_small(terms, terms.count()), "term")
    bound = F.least(F.sum("max_count"), F.first("n_terms") * F.min("max_count")) * 0.1
    return (
        asked.groupBy("query_id", "block")
        .agg(F.count("*").alias("__terms"), F.first("n_terms").alias("__wanted"), bound.alias("bound"))
        .where("__terms = __wanted")
        .select("query_id", "block", "bound")
    )


def read_blocks(wanted: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n_terms, hits) of the chunks in ``wanted`` blocks that hold every term of the query.

    The postings of one query and block meet in one row: a block's chunks for each term, no more.
    """
    n_rows = wanted.count()
    asked = _small(wanted.select("query_id", "block").join(terms, "query_id"), n_rows * 8)
    parts = asked.join(blocks, ["term", "block"]).groupBy("query_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("n", "term_no", "ids", "positions"))).alias("parts"), F.first("n_terms").alias("n_terms")
    )
    shared = F.aggregate("parts", F.col("parts")[0]["ids"], lambda ids, p: F.array_intersect(ids, p["ids"]))
    found = parts.where(F.size("parts") == F.col("n_terms")).select("query_id", "n_terms", "parts", F.explode(shared).alias("chunk_id"))

    def placed(part: Column) -> Column:
        mine = F.element_at(part["positions"], F.array_position(part["ids"], F.col("chunk_id")).cast("int"))
        return F.transform(mine, lambda pos: F.struct(pos.alias("pos"), part["term_no"].alias("term_no")))

    return found.select("query_id", "chunk_id", "n_terms", F.flatten(F.transform("parts", placed)).alias("hits"))


def two_looks(candidates: DataFrame, score, n: int, first: int = FIRST_BLOCKS) -> DataFrame:
    """(query_id, chunk_id, score, rank): the n best, reading only blocks that can hold one of them.

    ``score(blocks)`` gives (query_id, chunk_id, score) of some candidate blocks. The ``first`` blocks of the highest
    bound give an n-th score; a later block is read only if its bound reaches it.
    """
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    ranked = cut_lineage(top_n(candidates, ["query_id"], [F.col("bound").desc(), F.col("block").asc()], 2**31 - 1, "place"))
    found = score(ranked.where(F.col("place") <= first))
    rest = ranked.where(F.col("place") > first)
    if rest.isEmpty():
        return top_n(found, ["query_id"], order, n)
    best = cut_lineage(top_n(found, ["query_id"], order, n))
    nth = best.where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    more = rest.join(nth, "query_id", "left").where("least IS NULL OR bound >= least - 1e-9")
    return top_n(best.drop("rank").unionByName(score(more)), ["query_id"], order, n)
