"""Documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Shingles are hashed into groups, about half as many as the set has shingles and 64 at least; a set
is the point of its group counts, and two sets share no more than the sum of the coordinate minima of
their points. Numbers of groups are powers of two, so a finer point is folded to compare it with a coarser
one. Points that could be similar are brought together, indexed there (folded to
the coarsest of them) in an R-tree whose nodes hold the coordinate maxima, and the pairs whose bound is
high enough, folded and then in full, are verified on their whole sets.

Bringing points together: of two sets with similarity s, both hold one of the other's first
``n - ceil(s n) + 1`` shingles in any common order. The order is: shingles of at most ``COMMON`` sets
first, then by hash, so a passage that many documents share brings none of them together unless they
consist of such passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import alone, stored
from clausegrid.llm.components import components
from clausegrid.llm.shingles import digest, list_array, shingle_set, text_bytes

NUMBER, OF = 4, 5  # similarity 4/5
#: A point has 2**6 groups at least; folded together in one index, 1,024 at most.
GROUP_BITS, MAX_GROUPS = 6, 1024
#: Sets holding a shingle from which on it counts as common and goes to the end of the order.
COMMON = 256
#: Points of one bucket that a task indexes at once; larger buckets are joined block by block.
BLOCK = 1024
#: Ids (8 bytes each) up to which a list of documents is broadcast to pick their texts.
BROADCAST_IDS = 1_000_000
LEAF = 16
#: Rounds in which the sets of a bucket are held against one of them, before what is left is indexed.
STARS = 2
#: Common shingles (8 bytes each) up to which they are sent to every task; beyond, they are joined.
BROADCAST_COMMON = 200_000


def prefix_length(n):
    """Shingles of a set of n, first in any common order, one of which every similar set must hold."""
    return n - (NUMBER * n + OF - 1) // OF + 1


def point_of(hashes: np.ndarray) -> bytes:
    """The group counts of a set: a byte that says how wide they are, and the counts."""
    bits = min(max(GROUP_BITS, int(len(hashes) // 3).bit_length()), 24)
    groups = np.bincount(hashes.view(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits)
    width = 1 if groups.max(initial=0) < 1 << 8 else 4
    return bytes([width]) + groups.astype(f"<u{width}").tobytes()


def counts_of(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"<u{point[0]}", offset=1)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(axis=1)


def folded_points(points: list[bytes]) -> np.ndarray:
    """Points of one number of groups, the least among them and ``MAX_GROUPS`` at most."""
    counts = [counts_of(p) for p in points]
    groups = min(MAX_GROUPS, min(map(len, counts)))
    return np.array([_folded(c, groups) for c in counts]).astype(np.int32)


def shared_at_most(a: bytes, b: bytes) -> int:
    a, b = counts_of(a), counts_of(b)
    groups = min(len(a), len(b))
    return int(np.minimum(_folded(a, groups), _folded(b, groups)).sum())


def _features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and, of the whole text: n, digest of the set, its least hashes, group counts."""
    kept = docs.select(*keep, "text")
    schema = kept.drop("text").select("*", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("set"), F.array(F.lit(0).cast("long")).alias("least"), F.lit(b"").alias("point")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(d) for d in text_bytes(batch.column(batch.num_columns - 1))]
                least = [s[: prefix_length(len(s)) + len(s) // 20 + 8] for s in sets]
                points = [point_of(s) for s in sets]
                new = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    list_array(least, pa.int64()),
                    pa.array(points, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "n", "set", "least", "point"])

    return kept.mapInArrow(run, schema)


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, hashes`` of the sets ``wanted`` (row, doc_id, set): their texts are read again.

    A set comes once, whatever the number of documents that have it, or more often where ids repeat.
    """
    ids = wanted.select(F.xxhash64(_id_key()).alias("id_hash")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.xxhash64(_id_key()).alias("id_hash"), "text").join(F.broadcast(ids) if few else ids, "id_hash", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                sets = [shingle_set(d) for d in text_bytes(whole.slice(at, 200).column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), list_array(sets, pa.int64())], names=["set", "hashes"])

    found = texts.mapInArrow(run, "set binary, hashes array<long>")
    rows = wanted.select("row", "set")
    return stored(found.join(F.broadcast(rows) if few else rows, "set").select("row", "hashes"), "sets")


def _prefixes(docs: DataFrame, points: DataFrame, members: DataFrame) -> DataFrame:
    """``hash, row``: the first shingles of every set in the common order, of those that two sets hold."""
    entries = points.select("row", "n", F.posexplode("least").alias("pos", "hash"))
    shared = stored(entries.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    live = stored(entries.join(shared, "hash"), "live")
    length = prefix_length_column()
    common = live.where(F.col("held") > COMMON)
    if common.isEmpty():
        return live.where(F.col("pos") < length).select("hash", "row")
    # Sets with common shingles among their least ones: how many of those stand before each place, and whether
    # those that are left are too few, which is marked here, so that entries need not be joined with it again.
    passed = common.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("passed"), F.first("n").alias("size"))
    passed = stored(
        passed.join(points.select("row", F.size("least").alias("stored")), "row").select(
            "row", "passed", "size", (F.col("stored") - F.size("passed") < prefix_length_column("size")).alias("short")
        ),
        "common",
    )
    short = passed.where("short").select("row", "size")
    before = lambda: F.size(F.filter(F.coalesce("passed", F.array()), lambda x: x < F.col("pos")))
    plain = (
        live.where(F.col("held") <= COMMON)
        .join(passed.select("row", "passed", "short"), "row", "left")
        .where(~F.coalesce("short", F.lit(False)) & (F.col("pos") - before() < length))
        .select("hash", "row")
    )
    # Sets that consist of common shingles for the most part: the order over all of their shingles.
    own = _sets(docs, members.join(short, "row").select("row", "doc_id", "set"))
    extra = stored(_common_last(own, common.select("hash").distinct()), "extra")
    # A rare shingle of theirs may be one that a single other set has among its least ones.
    theirs = stored(extra.select("hash").distinct(), "theirs")
    few = theirs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    meeting = entries.join(F.broadcast(theirs) if few else theirs, "hash", "left_semi").join(shared, "hash", "left_anti").select("hash", "row")
    return plain.union(extra).union(meeting).distinct()


def _common_last(sets: DataFrame, common: DataFrame) -> DataFrame:
    """``hash, row``: the first shingles of whole sets (row, hashes), the common ones ordered last."""
    known = common.limit(BROADCAST_COMMON + 1).collect()
    if len(known) > BROADCAST_COMMON:
        flagged = sets.select("row", F.explode("hashes").alias("hash")).distinct().join(common.withColumn("is_common", F.lit(True)), "hash", "left")
        order = F.struct(F.coalesce("is_common", F.lit(False)).alias("c"), F.col("hash").alias("h"))
        ordered = flagged.groupBy("row").agg(F.sort_array(F.collect_list(order)).alias("s"))
        first = ordered.select("row", F.explode(F.slice("s", F.lit(1), prefix_length_column(F.size("s")))).alias("x"))
        return first.select(F.col("x.h").alias("hash"), "row")
    last = sets.sparkSession.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in known], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = []
            for hashes in batch.column("hashes"):
                hashes = hashes.values.to_numpy()
                is_common = np.isin(hashes, last.value, assume_unique=True)
                first.append(np.concatenate((hashes[~is_common], hashes[is_common]))[: prefix_length(len(hashes))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), list_array(first, pa.int64())], names=["row", "first"])

    return sets.mapInArrow(run, "row long, first array<long>").select(F.explode("first").alias("hash"), "row").distinct()


def prefix_length_column(n="n") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (n - F.floor((NUMBER * n + OF - 1) / OF) + 1).cast("int")


def _similar(both: int, a: int, b: int) -> bool:
    return OF * both >= NUMBER * (a + b - both)


def _hopeful(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those whose sizes and points allow them to be similar."""
    side = lambda x: points.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where((OF * F.col("n_a") >= NUMBER * F.col("n_b")) & (OF * F.col("n_b") >= NUMBER * F.col("n_a")))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = whole.slice(at, 4096)
                most = map(shared_at_most, x.column("point_a").to_pylist(), x.column("point_b").to_pylist())
                n = x.column("n_a").to_numpy() + x.column("n_b").to_numpy()
                fits = np.fromiter(most, np.int64, len(n)) >= needed(n)
                yield x.select(["a", "b"]).filter(pa.array(fits))

    return sized.mapInArrow(bounded, pairs.select("a", "b").schema)


def _verified(hopeful: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those that are similar, by their whole sets."""
    hopeful = stored(hopeful, "hopeful")
    ends = hopeful.select(F.col("a").alias("row")).union(hopeful.select("b")).distinct()
    sets = _sets(docs, reps.join(ends, "row"))
    hashes = lambda x: sets.select(F.col("row").alias(x), F.col("hashes").alias(f"hashes_{x}"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                x, fits = whole.slice(at, 64), []
                for left, right in zip(x.column("hashes_a"), x.column("hashes_b")):
                    left, right = left.values.to_numpy(), right.values.to_numpy()
                    if len(left) > len(right):
                        left, right = right, left
                    place = np.minimum(np.searchsorted(right, left), len(right) - 1)
                    fits.append(_similar(int((right[place] == left).sum()), len(left), len(right)))
                yield x.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return hopeful.join(hashes("a"), "a").join(hashes("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, hopeful.schema)


def needed(n: np.ndarray) -> np.ndarray:
    """Shared shingles that two sets of n shingles together need: NUMBER/OF of their union."""
    return -(-NUMBER * n // (OF + NUMBER))


class CountTree:
    """An R-tree of count vectors: every node has the maxima of its counts and the range of set sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*counts[:, :4].T, sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        upper, low, high = self.counts, self.sizes, self.sizes
        while True:
            starts = np.arange(0, len(low), LEAF)
            upper = np.maximum.reduceat(upper, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((upper, low, high))
            if len(starts) <= 1:
                break

    def partners(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose summed minima reach what their sizes need."""
        query, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        for level in range(len(self.levels), -1, -1):
            upper, low, high = self.levels[level - 1] if level else (self.counts, self.sizes, self.sizes)
            fits = []
            for at in range(0, len(query), 8192):
                q, k = query[at : at + 8192], node[at : at + 8192]
                near = (OF * high[k] >= NUMBER * sizes[q]) & (NUMBER * low[k] <= OF * sizes[q])
                q, k = q[near], k[near]
                least = np.maximum(low[k], -(-NUMBER * sizes[q] // OF))
                enough = np.minimum(counts[q], upper[k]).sum(axis=1) >= needed(sizes[q] + least)
                fits.append((q[enough], k[enough]))
            query, node = (np.concatenate(x) for x in zip(*fits)) if fits else (query, node)
            if level:
                n_below = len(self.levels[level - 2][1]) if level > 1 else len(self.sizes)
                query = np.repeat(query, LEAF)
                node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                there = node < n_below
                query, node = query[there], node[there]
        return query, self.order[node]


def _indexed_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of different components in the same bucket whose points allow them to be similar.

    ``mixed``: hash, held, row, n, point, root. A bucket of more than ``BLOCK`` points is dealt into blocks
    by a hash of the row, and every two blocks meet in a task of their own. Rows of large buckets carry the
    other large buckets they are in, so that a pair is looked at in the first that both are in.
    """
    large = mixed.where(F.col("held") > COMMON)
    lists = large.groupBy("row").agg(F.sort_array(F.collect_list("hash")).alias("also")).withColumn("large", F.lit(True))
    mixed = mixed.withColumn("large", F.col("held") > COMMON).join(lists, ["row", "large"], "left")
    mixed = mixed.withColumn("also", F.coalesce("also", F.array().cast("array<long>")))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    dealt = mixed.select("hash", "row", "n", "point", "root", "also", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "n", "point", "root", "also")
    dealt = dealt.repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j", "row")

    def met_before(also: list[np.ndarray], word: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """For every one of left and of right, whether both are in a large bucket before this one."""
        earlier = [x[x < word] for x in also]
        known, at = np.unique(np.concatenate(earlier), return_inverse=True)
        if not len(known):
            return None
        has = np.zeros((len(also), len(known)), np.float32)
        has[np.repeat(np.arange(len(also)), [len(x) for x in earlier]), at] = 1
        return has[left] @ has[right].T > 0

    def of_bucket(rows: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        row, n, root, own = (rows.column(c).to_numpy() for c in ("row", "n", "root", "own"))
        points = rows.column("point").to_pylist()
        counts = folded_points(points)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return row[:0], row[:0]
        q, p = CountTree(counts[left], n[left]).partners(counts[right], n[right])
        a, b = left[p], right[q]
        good = (root[a] != root[b]) & ((row[a] < row[b]) | (i != j))
        before = met_before([np.array(x.as_py(), np.int64) for x in rows.column("also")], rows.column("hash")[0].as_py(), left, right)
        if before is not None:
            good &= ~before[p, q]
        a, b = a[good], b[good]
        most = np.fromiter((shared_at_most(points[x], points[y]) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
        good = most >= needed(n[a] + n[b])
        a, b = row[a[good]], row[b[good]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()

        def buckets(table: pa.Table, last: bool):
            """Whole buckets of the sorted rows; the one that may go on is kept back."""
            key = [table.column(c).to_numpy() for c in ("hash", "i", "j")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            starts = [0, *cut.tolist()]
            ends = [*cut.tolist(), table.num_rows]
            for a, b in list(zip(starts, ends))[: None if last else -1]:
                if b - a > 1:
                    yield of_bucket(table.slice(a, b - a), int(key[1][a]), int(key[2][a]))
            return

        def emit(table: pa.Table, last: bool):
            if len(seen) > 50_000:
                seen.clear()
            new = []
            for a, b in buckets(table, last):
                for pair in zip(a.tolist(), b.tolist()):
                    if pair not in seen:
                        seen.add(pair)
                        new.append(pair)
            left, right = zip(*new) if new else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not held.num_rows:
                continue
            yield emit(held, False)
            key = [held.column(c).to_numpy() for c in ("hash", "i", "j")]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
            held = held.slice(int(changes[-1]) + 1 if len(changes) else 0)
        if held is not None and held.num_rows:
            yield emit(held, True)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, n, set, rep`` of every document with a shingle or none, and ``node, root`` of linked sets."""
    features = stored(_features(docs, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "features")
    filled = features.where("n > 0")
    firsts = stored(filled.groupBy("set").agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "classes")
    members = stored(features.select("row", "doc_id", "n", "set").join(firsts.select("set", "rep"), "set", "left"), "members")
    copies = members.where("n > 0 AND row <> rep").select("row")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    points = filled.join(F.broadcast(copies) if few else copies, "row", "left_anti").select("row", "n", "least", "point")
    spark = docs.sparkSession

    def met() -> DataFrame:
        buckets = stored(_prefixes(docs, points, members), "buckets")
        sizes = buckets.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1")
        return _distinct_buckets(buckets.join(sizes, "hash"))

    buckets = alone(spark, met, "met")
    wanted = stored(buckets.groupBy("row").agg(F.count("*").alias("degree")), "wanted")
    reps = members.where("row = rep").select("row", "doc_id", "set")
    light = stored(points.select("row", "n", "point").join(wanted.select("row"), "row"), "points")
    buckets = stored(buckets.join(wanted, "row"), "degrees")
    labelled, tested, links = buckets.withColumn("root", F.col("row")), None, None
    # First every set of a bucket against one and the same of them, then of what is still apart against
    # another one, and so on: that settles tight groups without their pairs.
    for k in range(STARS):
        pairs = _star(labelled, k)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "star")
        tested = pairs if tested is None else tested.union(pairs)
        new = alone(spark, lambda pairs=pairs: _verified(_hopeful(pairs, light), docs, reps), "links")
        if k and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        roots = alone(spark, lambda links=links: components(links), "roots")
        labelled = _apart(buckets.where("held > 2"), roots)
    mixed = labelled.join(light, "row").select("hash", "held", "row", "n", "point", "root")
    rest = _indexed_pairs(mixed).join(tested, ["a", "b"], "left_anti")
    more = alone(spark, lambda: _verified(rest, docs, reps), "links")
    if more.isEmpty():
        return members, roots
    return members, alone(spark, lambda: components(links.union(more)), "roots")


def _distinct_buckets(buckets: DataFrame) -> DataFrame:
    """Of buckets with the same rows, one: a passage or a near copy brings its documents together often.

    Only buckets of at most ``COMMON`` rows are compared, so that their lists of rows are short.
    """
    small = buckets.where(F.col("held") <= COMMON).groupBy("hash").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    one = small.groupBy("rows").agg(F.min("hash").alias("hash"))
    kept = one.select("hash", F.explode("rows").alias("row"), F.size("rows").cast("long").alias("held"))
    return kept.unionByName(buckets.where(F.col("held") > COMMON).select("hash", "row", "held"))


def _star(labelled: DataFrame, k: int) -> DataFrame:
    """In each bucket, one row against those of other components.

    At first the row that is in most buckets: the text that others are copies of has no shingles of its
    own. Later the first by a hash that depends on k.
    """
    order = F.struct((-F.col("degree") * int(k == 0)).alias("d"), F.xxhash64("row", F.lit(k)).alias("o"), "row", "root")
    first = labelled.groupBy("hash").agg(F.min(order).alias("first")).select("hash", "first.row", "first.root")
    first = first.toDF("hash", "pivot", "pivot_root")
    pairs = labelled.join(first, "hash").where("root <> pivot_root")
    return pairs.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct()


def _apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows, with their components, of buckets that hold more than one component."""
    labelled = buckets.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    apart = labelled.groupBy("hash").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("hash")
    return stored(labelled.join(apart, "hash", "left_semi"), "apart")


def _classed(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set, root, component_id``; root is null for documents without shingles."""
    members, roots = _linked(docs)
    rooted = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = rooted.join(least, "root", "left")
    return joined.select("doc_id", "n", "set", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text; no other is read).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z read as a-z; a text of fewer than five is one shingle;
    null or empty texts have none and link with nothing. Two rows link when their sets' Jaccard similarity
    is at least 0.8; equal sets always do. component_id is the least doc_id that links lead to; for rows
    of null ids the least one that is not null, or null. Repeated rows are rows like others. Shingles are
    compared by 64-bit hash. No rows: none.
    """
    return _classed(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each group of similar documents: its least doc_id.

    Documents without words stay. Of several rows with that same id one stays; of a group with null ids
    alone, one. Texts are not shuffled unless more than ``BROADCAST_IDS`` documents go.
    """
    classed = alone(docs.sparkSession, lambda: _classed(docs), "classed")
    twice = classed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 OR doc_id IS NULL").select("doc_id")
    twice = stored(twice, "repeated")
    gone = classed.where("root IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    gone = stored(gone.join(twice, "doc_id", "left_anti"), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    lone = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return lone
    # Rows of repeated or null ids: told apart by their sets.
    same = lambda x: F.col("doc_id").eqNullSafe(F.col(x))
    ids = F.broadcast(twice.withColumnRenamed("doc_id", "__id")) if twice.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else twice.withColumnRenamed("doc_id", "__id")
    lone = lone.join(ids, same("__id"), "left_anti")
    unclear = docs.join(ids, same("__id"), "left_semi")
    rows = _features(unclear.select(F.struct(*docs.columns).alias("__row"), "text"), ["__row"]).select("__row", "n", F.col("set").alias("__set"))
    class_of = classed.where("root IS NOT NULL").select(F.col("set").alias("__set"), "root", "component_id").distinct()
    placed = rows.join(class_of, "__set", "left")
    mine = placed.where(F.col("root").isNotNull() & F.col("__row.doc_id").eqNullSafe(F.col("component_id")))
    chosen = mine.groupBy("root").agg(F.min_by("__row", F.xxhash64("__set")).alias("__row")).select("__row.*")
    wordless = placed.where("root IS NULL").select("__row.*")
    return lone.unionByName(chosen).unionByName(wordless)
