"""Conversation repair: weighted CYK parsing of the turns against a repair grammar.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. The grammar is in Chomsky normal
form over the states of that language: non-terminal ``p>q`` stands for all turns that lead from state p to
state q, with the rules ``p>q -> p>r r>q``. A cell is the minimum (cost, audit) of the edits that turn a span of
rows into such turns; the audit is the edits' initials in order. Cells of single rows take in the
insertions that may stand before and after the row (insertion closure: the cheapest way from state to
state without any row).

Every non-terminal can be cut at any place, so all splits of a span give the same minimum and one is enough:
the chart holds spans of 1, 2, 4, ... rows and their combinations, bottom-up by span length, and a
conversation of n rows needs about n of them. Minima combine because two audits of equal cost over
the same span never begin one another (they would differ by insertions only, which cost).

A conversation may be longer than a task should hold: rows are dealt by ranges of (conversation, turn),
each task parses its span, and the few spans of a conversation are combined afterwards. The edits are then
written along the sorted rows, a row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import CRC_TABLE_SQL, bound_batches, crc32_sql, stored

KEEP, REROLE, DELETE, INSERT = (0, "K"), (1, "R"), (2, "D"), (5, "I")
TRUNCATED = 5
#: state -> state by initial: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an answer.
STEPS = {(0, 1): "s", (0, 2): "u", (1, 2): "u", (3, 2): "u", (2, 3): "a"}
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
#: Conversation rows looked up together when edits are written.
LINES = 4096

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def _joined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts: ``p>q -> p>r r>q``."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            other = right.get((r, q))
            if other is not None:
                made = (cost + other[0], audit + other[1])
                if (p, q) not in out or made < out[p, q]:
                    out[p, q] = made
    return out


def _closure() -> Cells:
    """Insertions alone: the cheapest turns from state to state over an empty span."""
    cells: Cells = {(p, p): (0, "") for p in STATES}
    cells |= {step: INSERT for step, initial in STEPS.items() if initial in ROLES}
    while (wider := _joined(cells, cells)) != cells:
        cells = wider
    return cells


EMPTY = _closure()


@lru_cache(maxsize=None)
def _row(kind: str) -> Cells:
    """Cells of one row. ``kind``: initial of its role (x: another one) and fault (b, d, t or .)."""
    initial, fault = kind
    more = TRUNCATED if fault == "t" else 0
    cells: Cells = {(p, p): DELETE for p in STATES}
    if fault not in "bd":
        for step, wanted in STEPS.items():
            edit = KEEP if initial == wanted else REROLE if wanted in ROLES else None
            if edit is not None:
                cells[step] = (edit[0] + more, edit[1])
    return _joined(_joined(EMPTY, cells), EMPTY)


class Chart:
    """The spans of a growing row of turns; spans of equal length are combined as they come to stand side by side."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells) -> None:
        length = 1
        while self.spans and self.spans[-1][0] == length:
            cells, length = _joined(self.spans.pop()[1], cells), 2 * length
        self.spans.append((length, cells))

    def whole(self) -> Cells:
        cells = self.spans[-1][1] if self.spans else EMPTY
        for _, left in reversed(self.spans[:-1]):
            cells = _joined(left, cells)
        return cells


def _parsed(kinds: list[str]) -> Cells:
    chart = Chart()
    for kind in kinds:
        chart.add(_row(kind))
    return chart.whole()


@lru_cache(maxsize=10_000)
def _parsed_short(kinds: tuple[str, ...]) -> Cells:
    return _parsed(list(kinds))


def cheapest(cells: Cells) -> Cell:
    """Cost and audit of the best edits of a whole conversation: to nothing, or to complete turns."""
    return min(cells[0, 0], cells[0, 3])


# ------------------------------------------------------------------ rows and their faults

ORDER = ("turn", "role", "text")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 decides.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls
    count as one space: in the key, and as role and text of the row.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("__f") == 1, "").when(F.col("__f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("__f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        filled(rows)
        .withColumn("__f", fault)
        .where("__f <> 0")
        .select("conv_id", "turn", F.when(F.col("__f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("__copy"))
        .drop("__copy")
    )


def filled(rows: DataFrame) -> DataFrame:
    """The four columns of conversations, null roles and texts as one space."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def _identity() -> Column:
    """Conversation, role and text in one value."""
    parts = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text"))
    return F.sha2(parts, 256)


def with_kinds(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, identity, kind``; ``later``: the same role and text stand at an earlier turn.

    The kind is the role's initial (x if not s, u or a) and b for blank, t for truncated or a point. Repeats
    are counted before they are sought: only values that occur again are joined back.
    """
    initial = F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    fault = F.when(~F.col("text").rlike(WORD_CHARACTER), "b").when(~last.isin(".", "!", "?"), "t").otherwise(".")
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    rows = rows.select("conv_id", "turn", "role", "text", _identity().alias("identity"), kind.alias("kind"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = (
        rows.groupBy("identity")
        .agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
        .where("__n > 1")
        .drop("__n")
    )
    return rows.join(again, "identity", "left").select(*rows.columns, F.coalesce(place > F.col("__first"), F.lit(False)).alias("later"))


SPANS = "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, cells array<struct<p:int,q:int,cost:long,audit:string>>"
LEGAL = ("su", "ua", "au")


class Span(NamedTuple):
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    cells: Cells

    def followed(self, other: Span) -> Span:
        counts = [a + b for a, b in zip(self[:4], other[:4])]
        counts[3] += self.last + other.first not in LEGAL
        return Span(*counts, self.first, other.last, _joined(self.cells, other.cells))


def _spans(rows: DataFrame) -> DataFrame:
    """One row for each conversation and task: its faults, outer initials and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        short, chart, counts = [], None, [0, 0, 0, 0]
        conv, first, last, before = None, None, None, None

        def ended() -> dict:
            cells = _parsed_short(tuple(short)) if chart is None else chart.whole()
            return {
                "conv_id": conv, "part": part, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
                "illegal": counts[3], "first": first, "last": last,
                "cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()],
            }

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "identity", "kind", "later")]
            for this, identity, kind, later in zip(*columns):
                if first is not None and this != conv:
                    out.append(ended())
                    short, chart, counts, first, last, before = [], None, [0, 0, 0, 0], None, None, None
                conv = this
                if kind[1] == "b":
                    counts[0] += 1
                elif later or identity == before:
                    kind = kind[0] + "d"
                    counts[1] += 1
                elif kind[1] == "t":
                    counts[2] += 1
                counts[3] += last is not None and last + kind[0] not in LEGAL
                first, last, before = first or kind[0], kind[0], identity
                if chart is None and len(short) < 64:
                    short.append(kind)
                else:
                    if chart is None:
                        chart = Chart()
                        for k in short:
                            chart.add(_row(k))
                    chart.add(_row(kind))
            if out:
                yield _batch(out)
        if first is not None:
            yield _batch([ended()])

    cells = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    arrow = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32())]
        + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
        + [("first", pa.string()), ("last", pa.string()), ("cells", cells)]
    )

    def _batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    ordered = rows.repartitionByRange(F.col("conv_id"), *_order()).sortWithinPartitions("conv_id", *_order(), "later")
    return ordered.select("conv_id", "identity", "kind", "later").mapInArrow(run, SPANS)


def repair_plan(rows: DataFrame) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows.

    ``rows``: conv_id, turn, role, text; rows stand by turn (nulls first), those of one turn by role, then text.
    Other columns are left out. Null roles and texts count as one space; a null conv_id is a conversation of its
    own; no rows: no result. The first fault of a row counts: blank (no word character), duplicate (role and text
    seen earlier), truncated (the last such character is none of ``.!?``). ``illegal`` counts neighbours whose
    initials are not su, ua or au. Edits and costs: Keep 0; Rerole to user or assistant 1; Delete 2,
    required for blank and duplicate rows; Insert a user or assistant turn without text 5; a truncated row that
    stays costs 5 more. ``audit`` is the ASCII-least of the cheapest.
    """
    bound_batches(rows.sparkSession)
    spans = _spans(with_kinds(filled(rows)))
    keys = ("blank", "duplicate", "truncated", "illegal", "first", "last")
    collected = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *keys, "cells"))).alias("spans"))
    arrow = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in (*keys[:4], "cost")] + [("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole = None
                for s in row["spans"]:
                    cells = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]}
                    span = Span(*(s[k] for k in keys), cells)
                    whole = span if whole is None else whole.followed(span)
                cost, audit = cheapest(whole.cells)
                out.append({"conv_id": row["conv_id"], **dict(zip(keys[:4], whole[:4])), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return collected.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# ------------------------------------------------------------------ writing the edits

def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
    """(conversation, edit, role, text) along sorted rows in which a plan stands before its conversation's rows.

    Deleted rows are left out; a conversation starts with an entry without edit, whatever becomes of it.
    """
    audit, at, produced, odd, conv = "", 0, 0, 0, None

    def wanted() -> str:
        """The role at the next place: after an optional system turn, user and assistant take turns."""
        return ROLES["ua"[(produced - odd) % 2]]

    def inserted():
        nonlocal at, produced
        while at < len(audit) and audit[at] == "I":
            yield conv, "I", wanted(), ""
            at, produced = at + 1, produced + 1

    for batch in batches:
        for this, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if plan is not None:
                conv, audit, at, produced = this, plan, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                yield conv, None, None, None
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    yield conv, edit, role if edit == "K" else wanted(), text
                    produced += 1
            yield from inserted()


def _with_plans(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows and plans together, each conversation in one task and in order, its plan first."""
    marks = plan.select("conv_id", F.lit(0).alias("__row"), F.lit(None).cast("long").alias("turn"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    lines = filled(rows).select("conv_id", F.lit(1).alias("__row"), F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("audit"), "role", "text")
    both = marks.unionByName(lines).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "__row", *_order()).select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns of the repaired conversations, numbered from 0.

    ``plan`` is ``repair_plan`` of the same rows. A conversation that loses all its turns has none.
    """
    bound_batches(rows.sparkSession)
    arrow = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position = [], 0
        for conv, edit, role, text in _edited(batches):
            position = 0 if edit is None else position
            if edit is not None:
                out.append((conv, position, edit, role, text))
                position += 1
            if len(out) >= LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return _with_plans(rows, plan).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def repaired_digest(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the repaired ``role:text`` lines joined by newlines, taken along the rows."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, now, empty = [], [], None, True
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                if now is not None:
                    digests.append(now.hexdigest())
                ids.append(conv)
                now, empty = sha256(), True
            else:
                now.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
            if len(ids) > LINES:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
                ids, digests = ids[-1:], []
        if now is not None:
            digests.append(now.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

    return _with_plans(rows, plan).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """The plan, the missing turns and the digest of every conversation of ``rows`` after damage.

    A conversation that the damage leaves without rows keeps zeros, an empty audit and the digest of nothing.
    """
    after = damaged(rows)
    plan = stored(repair_plan(after), "repair-plans")
    turns = after.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    out = rows.select("conv_id").distinct()
    for part in (plan, gaps, repaired_digest(after, plan)):
        named = part.withColumnRenamed("conv_id", "__conv")
        out = out.join(named, out["conv_id"].eqNullSafe(F.col("__conv")), "left").drop("__conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def check_sql() -> str:
    """The report in SQL: the cheapest edits by walking over the rows with the best (cost, audit) of each state."""
    plus = lambda x, cost, letter: f"struct_pack(c := {x}.c + {cost}, a := {x}.a || {letter})"
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    insert = lambda x: plus(x, 5, "'I'")
    inserts = lambda x: plus(x, 10, "'II'")
    delete = lambda x: plus(x, 2, "'D'")
    closed = f"""v0 AS w0, v1 AS w1, {least("v2", insert("v0"), insert("v1"), insert("v3"))} AS w2,
      {least("v3", insert("v2"), inserts("v0"), inserts("v1"))} AS w3"""
    stays = "CASE WHEN fault = 't' THEN 5 WHEN fault = '.' THEN 0 ELSE 1000000000 END"
    as_ = lambda initial: (f"CASE WHEN initial = '{initial}' THEN 0 ELSE 1 END + {stays}", f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END")
    system = (f"CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END + {stays}", "'K'")
    never = "struct_pack(c := CAST(1000000000 AS BIGINT), a := '')"
    return f"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
      FROM conversations, crc),
    g AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)),
      CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM f WHERE f <> 0),
    k AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault
      FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM g))),
    walk AS (
      SELECT conv, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '') AS v0, {never} AS v1, {never} AS v2, {never} AS v3
      FROM k WHERE i = 1
      UNION ALL
      SELECT conv, i, {delete("w0")} AS v0, {least(delete("w1"), plus("w0", *system))} AS v1,
        {least(delete("w2"), *(plus(w, *as_("u")) for w in ("w0", "w1", "w3")))} AS v2, {least(delete("w3"), plus("w2", *as_("a")))} AS v3
      FROM (SELECT walk.conv, k.i, initial, fault, {closed} FROM walk JOIN k ON k.conv = walk.conv AND k.i = walk.i + 1)),
    plan AS MATERIALIZED (SELECT conv, {least("w0", "w3")} AS best FROM (
      SELECT conv, {closed} FROM (SELECT *, max(i) OVER (PARTITION BY conv) AS n FROM walk) WHERE i = n)),
    faults AS (SELECT conv, conv_id, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
      FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM k) GROUP BY conv, conv_id),
    edits AS (SELECT conv, seq, edit, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS i,
        sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w - 1 AS place, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv) % 2 AS odd
      FROM (SELECT conv, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS seq FROM plan WHERE best.a <> '')
      WINDOW w AS (PARTITION BY conv ORDER BY seq)),
    lines AS (SELECT e.conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY seq) AS text
      FROM edits e LEFT JOIN k ON k.conv = e.conv AND k.i = e.i WHERE edit <> 'D' GROUP BY e.conv)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
      sha256(coalesce(lines.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN plan USING (conv) LEFT JOIN lines USING (conv)"""
