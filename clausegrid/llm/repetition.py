"""Periodic runs of words: an online sparse diagonal DP over earlier occurrences, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length
``max(6, 4 q)`` or more, which no neighbouring word extends.

The DP walks over the words. A word's earlier occurrence d words before adds one to the match length of
diagonal (lag) d; a diagonal whose word does not match ends there, and if it is long enough for its lag
its run is emitted. Plainly done, a frequent word has an earlier occurrence on very many diagonals and the
work is square to the text. Diagonals are therefore kept sparse by looking at a word together with the
ones that follow it. For lags d in (w/2, w], w = 1, 2, 4, ..., only the *nearest* earlier occurrence of the
sequence of w words that starts at the word may add to its diagonal. That is exact:

- Inside a run of smallest period q, with w/2 < q <= w, a sequence of w >= q words has no occurrence nearer
  than q words before: two nearer ones would give the run a smaller period. So the run's own diagonal is the
  one that grows, without a break, and ends exactly where the run ends.
- A diagonal d that grows like this for ``4 d`` words has no smaller period for the same reason.

Each word touches one diagonal for each w, so a text of n words costs n log n, whatever it repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import CRC_TABLE_SQL, bound_batches, crc32_sql, let, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAST, TIMES = 6, 4
#: Words whose texts go through the DP together; bounds a task's memory but for a single longer text.
TOGETHER = 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def _numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """One number for each distinct (text, word), texts end to end, and where each text starts."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in texts], out=starts[1:])
    codes = np.empty(starts[-1], np.int64)
    before = 0
    for words, at in zip(texts, starts[:-1].tolist()):
        seen: dict[str, int] = {}
        codes[at : at + len(words)] = [before + seen.setdefault(w, len(seen)) for w in words]
        before += len(seen)
    return codes, starts


def _diagonals(codes: np.ndarray, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The diagonals that end at width ``width``: first and last place that added to each, and its lag.

    ``codes`` numbers the sequences that start at ``places`` (ascending).
    """
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    here = order[1:][same]
    lag = np.zeros(len(places), np.int64)
    lag[here] = places[here] - places[order[:-1][same]]
    grows = np.flatnonzero((lag <= width) & (lag > width // 2))
    if not len(grows):
        return grows, grows, grows
    at, by = places[grows], lag[grows]
    ends = np.append((at[1:] != at[:-1] + 1) | (by[1:] != by[:-1]), True)
    begins = np.append(True, ends[:-1])
    return at[begins], at[ends], by[begins]


def word_runs(texts: list[list[str]]) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    codes, starts = _numbered(texts)
    total = len(codes)
    longest = int(np.diff(starts).max()) if len(texts) else 0
    places, width, found = np.arange(total, dtype=np.int64), 1, []
    while len(places) and (width <= 1 or 4 * (width // 2 + 1) <= longest):
        first, last, lag = _diagonals(codes, width, places)
        length = last + width - first + lag
        enough = length >= np.maximum(LEAST, TIMES * lag)
        found.append(np.stack([first[enough] - lag[enough], length[enough], lag[enough]], 1))
        # Twice as many words: a sequence that occurs once, or with an end that does, occurs once.
        counts = np.bincount(codes)
        repeated = counts[codes] > 1
        places, codes = places[repeated], codes[repeated]
        following = np.full(total + width, -1, np.int64)
        following[places] = codes
        end = following[places + width]
        places, codes, end = places[end >= 0], codes[end >= 0], end[end >= 0]
        codes = np.unique(codes * np.int64(total + 1) + end, return_inverse=True)[1] if len(codes) else codes
        width *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[text]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words joined by one space, without those a run holds after its first period."""
    if not len(runs):
        return " ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return " ".join(w for w, k in zip(words, kept.tolist()) if k)


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``, the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; runs stand by start, then period. ``collapsed`` leaves out
    the words that any run holds after its first period and joins the rest by one space. A null text has no
    words, as an empty one. One row for each row of the table, repeated ones included; keys may be null, and
    other columns are left out, whatever their names. Texts are taken whole, many at a time.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    kinds = {"n_words": "long", "runs": RUNS, "collapsed": "string"}
    schema = kept.drop("__text").select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def finished(columns: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
        runs = word_runs(texts)
        flat = np.concatenate(runs)
        offsets = np.zeros(len(runs) + 1, np.int32)
        np.cumsum([len(r) for r in runs], out=offsets[1:])
        parts = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]
        items = pa.StructArray.from_arrays(parts, fields=list(run_type.value_type))
        new = [
            pa.array([len(w) for w in texts], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), items),
            pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            for i, value in enumerate(batch.column(len(keep)).to_pylist()):
                texts.append(WORD.findall(value or ""))
                size += len(texts[-1])
                if size >= TOGETHER or i == batch.num_rows - 1:
                    yield finished([batch.column(c).slice(first, i + 1 - first) for c in range(len(keep))], texts)
                    texts, first, size = [], i + 1, 0

    return kept.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, a tenth of the texts made periodic from some word on, chosen by the checksum of the id.

    With h the CRC-32 of the decimal id (null: of the empty text), g = floor(h / 10) and n words: if h ends in 0,
    each word i >= a = g % n becomes word a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def periodic(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        # Bound once: both are the same for every word.
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        source = lambda i, ap: F.when(i < ap["a"], i).otherwise(ap["a"] + (i - ap["a"]) % ap["p"])
        planted = let(F.struct(a.alias("a"), p.alias("p")), lambda ap: F.transform(words, lambda _, i: F.get(words, source(i, ap))))
        return F.when(n > 0, F.array_join(planted, " ")).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), periodic)).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text.

    The greatest exponent is that of length / period, compared as whole numbers; ties go to the smallest
    start, then period. Without a run its four columns are null.
    """

    def better(best: Column, r: Column) -> Column:
        more, less = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (more > less), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("__best", best)
    b = F.col("__best")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        b["start"].alias("start"),
        b["length"].alias("length"),
        b["period"].alias("period"),
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def check_sql() -> str:
    """The digest in SQL: equal words at every lag, islands of consecutive ones, the smallest period of each stretch."""
    return f"""
    WITH {CRC_TABLE_SQL},
    d AS MATERIALIZED (SELECT *, len(w) AS n, h // 10 AS g FROM (
      SELECT row_number() OVER () AS row, doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents, crc)),
    q AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d),
    e AS MATERIALIZED (SELECT row, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM q)),
    pairs AS (SELECT x.row, y.i, y.i - x.i AS q FROM e x JOIN e y
      ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    islands AS (SELECT row, q, min(i) - q AS start, count(*) + q AS length FROM (
      SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island),
    runs AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM islands
      WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
    per AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM runs GROUP BY row),
    best AS (SELECT DISTINCT ON (row) * FROM runs ORDER BY row, length / period DESC, start, period),
    kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM e WHERE NOT EXISTS (
      SELECT 1 FROM runs r WHERE r.row = e.row AND e.i >= r.start + r.period AND e.i < r.start + r.length) GROUP BY row)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM d LEFT JOIN per USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)"""
