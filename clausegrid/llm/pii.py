"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Everything is DataFrame functions in the row of the text. Offsets are code points. Patterns cannot run in
time square to the text: runs are taken whole (possessively) and a match starts at the start of its run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import running_sums
from clausegrid.llm.common import let

#: Code points before and after a proposed span that are looked at for context words.
BEFORE, AFTER = 48, 24
#: Hundredths: what context words add and take away, and the score a span of the further kinds needs.
CUE, COUNTER_CUE, THRESHOLD = 40, 30, 60
#: Words that speak against personal data near a number.
COUNTER = "order|invoice|version|isbn|sku|part|serial|build|page|chapter|section|article"


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""

    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an international account number (letters and digits, no blanks) leave 1 modulo 97?

    Its first four characters go to the end and letters count as 10 to 35, as published for these numbers.
    """
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def add(rest: Column, place: Column) -> Column:
        c = F.ascii(F.substring(turned, place, F.lit(1)))
        return F.when(c <= 57, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _card(s: Column) -> Column:
    return let(F.translate(s["value"], " -", ""), lambda d: F.length(d).between(12, 19) & luhn(d))


def _ip(s: Column) -> Column:
    small = lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255"))
    return F.forall(F.split(s["value"], r"\."), lambda part: small(F.regexp_replace(part, "^0+", "")))


def _phone(s: Column) -> Column:
    return F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15)


def _any(s: Column) -> Column:
    return F.lit(True)


def _apart(s: Column) -> Column:
    """No letter, digit, sign or point of a longer number stands next to the span."""
    return ~F.right(s["before"], F.lit(1)).rlike(r"[A-Za-z0-9+.-]") & ~s["after"].rlike(r"^(?:[A-Za-z0-9]|[.-][0-9])")


#: What stands before a national number that is the rest of an international one.
ABROAD = r"\+[0-9]{1,3}[ .(-]*$"


def _national(s: Column) -> Column:
    return _apart(s) & ~s["before"].rlike(ABROAD)


def _account(s: Column) -> Column:
    return _apart(s) & let(F.translate(s["value"], " ", ""), lambda a: F.length(a).between(15, 34) & mod97(a))


def _social(s: Column) -> Column:
    area, group, serial = F.substring(s["value"], 1, 3), F.substring(s["value"], 5, 2), F.substring(s["value"], 8, 4)
    return _apart(s) & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``confirm`` decides on the span and its surroundings, ``cues`` raise ``score``.

    A span of a ``base`` kind stays once confirmed, whatever its score. ``plain`` is ``pattern`` without
    possessive marks and look-behind, for engines that lack them. Every match holds ``sign``.
    """

    name: str
    pattern: str
    plain: str
    confirm: Callable[[Column], Column]
    score: int
    cues: str
    base: bool = False
    sign: str = ""


# The four base patterns; see `plain`.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ACCOUNT = r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?: ?[A-Z0-9]{1,3})?"
SOCIAL = r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]"
LOCAL = r"\(?[0-9][0-9][0-9]\)?[ .-][0-9][0-9][0-9][.-][0-9][0-9][0-9][0-9]"
DATE = r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}"
PASSPORT = r"[A-Z]{1,2}[0-9]{6,8}"

KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        EMAIL, _any, 90, "mail|email|contact|write", True, "@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", IP, _ip, 60, "ip|address|host|server|client|login", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", CARD, _card, 70, "card|credit|debit|visa|mastercard|amex|payment", True),
    Kind("phone", PHONE, PHONE, _phone, 70, "phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp", True, "+"),
    Kind("iban", ACCOUNT, ACCOUNT, _account, 80, "iban|account|bank|transfer|konto|compte|cuenta"),
    Kind("ssn", SOCIAL, SOCIAL, _social, 40, "ssn|social|security|taxpayer"),
    Kind("local_phone", LOCAL, LOCAL, _national, 35, "phone|tel|telephone|call|mobile|cell|fax"),
    Kind("birth_date", DATE, DATE, _apart, 25, "born|birth|birthday|birthdate|dob|geboren|nacido|nacida"),
    Kind("passport", PASSPORT, PASSPORT, _apart, 25, "passport|reisepass|passeport|pasaporte"),
)

SPAN = "struct<start:int,order:int,end:int,kind:string,value:string,score:int>"


def _near(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """The confirmed spans of one kind, in order, those of the further kinds at ``THRESHOLD`` or more."""

    def located(hits: Column) -> Column:
        def with_gaps(both: Column) -> Column:
            gaps = both["gaps"]
            sizes = F.transform(hits, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

            def made(end: Column, i: Column) -> Column:
                value = F.get(hits, i)
                earlier = F.concat(
                    F.right(F.coalesce(F.get(gaps, i - 1), F.lit("")), F.lit(BEFORE)), F.coalesce(F.get(hits, i - 1), F.lit(""))
                )
                near = F.right(F.get(gaps, i), F.lit(BEFORE))
                before = F.when(F.length(near) < BEFORE, F.right(F.concat(earlier, near), F.lit(BEFORE))).otherwise(near)
                return F.struct(
                    (end - F.length(value)).alias("start"),
                    end.alias("end"),
                    value.alias("value"),
                    before.alias("before"),
                    F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
                )

            def scored(s: Column) -> Column:
                around = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
                score = (
                    F.lit(kind.score)
                    + F.when(around.rlike(_near(kind.cues)), CUE).otherwise(0)
                    - F.when(around.rlike(_near(COUNTER)), COUNTER_CUE).otherwise(0)
                )
                return F.struct(
                    s["start"].alias("start"),
                    F.lit(order).alias("order"),
                    s["end"].alias("end"),
                    F.lit(kind.name).alias("kind"),
                    s["value"].alias("value"),
                    F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"),
                )

            sure = F.transform(F.filter(F.transform(running_sums(sizes), made), kind.confirm), scored)
            return sure if kind.base else F.filter(sure, lambda s: s["score"] >= THRESHOLD)

        found = let(F.struct(F.split(text, kind.pattern, -1).alias("gaps")), with_gaps)
        return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.sign:
        hits = F.when(F.contains(text, F.lit(kind.sign)), hits).otherwise(F.array().cast("array<string>"))
    return let(hits, located)


def find_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, order, end, kind, value, score) by start, then kind as listed.

    Matches of a kind are leftmost and do not overlap; one that its check refuses is dropped and not tried
    again from within. Spans of different kinds may overlap. Base kinds stay once confirmed; the others
    need ``THRESHOLD`` hundredths, which context words within ``BEFORE`` and ``AFTER`` code points raise or
    lower (those before a span are looked for back to the start of the match before the last of its kind).
    A null or empty text has no spans. Repeated rows and null ids stay rows of their own; columns of
    the table stay as they are, but for one of the name ``spans``, which the result takes over.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(whole, kind, i) for i, kind in enumerate(kinds)])
    return docs.withColumn("spans", F.array_sort(found))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, all spans as a string."""
    base = [k.name for k in KINDS if k.base]
    found = find_personal_data(docs.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("spans", lambda s: s["order"] < len(base))
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(listed(of_base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def check_sql() -> str:
    """The same in SQL, from the plain patterns."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    turned = "replace(substr(value, 5), ' ', '') || substr(value, 1, 4)"
    apart = (
        "NOT regexp_matches(right(before, 1), '[A-Za-z0-9+.-]')"
        " AND NOT regexp_matches(after, '^(?:[A-Za-z0-9]|[.-][0-9])')"
    )
    doubled = f"list_transform(range(length({digits})), lambda i: CAST(substr({digits}, length({digits}) - i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END)"
    confirm = {
        "email": "true",
        "ip": r"len(list_filter(string_split(value, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform({doubled}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{apart} AND length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform("
        f"string_split({turned}, ''), lambda c: CAST(CASE WHEN ascii(c) <= 57 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),"
        " lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1",
        "ssn": f"{apart} AND substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 3) < '900'"
        " AND substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000'",
        "local_phone": f"{apart} AND NOT regexp_matches(before, '{ABROAD}')",
        "birth_date": apart,
        "passport": apart,
    }
    parts = []
    for order, kind in enumerate(KINDS):
        keep = "true" if kind.base else f"score >= {THRESHOLD}"
        parts.append(f"""
        SELECT doc_id, row, {order} AS ord, '{kind.name}' AS kind, stop - length(value) AS start, stop FROM (
          SELECT *, {kind.score} + CASE WHEN regexp_matches(around, '{_near(kind.cues)}') THEN {CUE} ELSE 0 END
            - CASE WHEN regexp_matches(around, '{_near(COUNTER)}') THEN {COUNTER_CUE} ELSE 0 END AS score
          FROM (SELECT *, lower(before || ' ' || after) AS around FROM (
            SELECT doc_id, row, value, sum(length(gap) + length(value)) OVER w AS stop,
              right(right(coalesce(lag(gap) OVER w, ''), {BEFORE}) || coalesce(lag(value) OVER w, '') || gap, {BEFORE}) AS before,
              left(next_gap, {AFTER}) AS after
            FROM (SELECT doc_id, row, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap,
                unnest(gaps[2:len(hits) + 1]) AS next_gap, generate_subscripts(hits, 1) AS i
              FROM (SELECT doc_id, row, regexp_extract_all(text, '{kind.plain}') AS hits,
                string_split_regex(text, '{kind.plain}') AS gaps FROM d) WHERE len(hits) > 0)
            WINDOW w AS (PARTITION BY row ORDER BY i))
          WHERE {confirm[kind.name]})) WHERE {keep}""")
    n_base = sum(k.base for k in KINDS)
    counts = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    name = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
    found AS ({' UNION ALL '.join(parts)}),
    per AS (SELECT row, {sums}, string_agg({name}, ',' ORDER BY start, ord) FILTER (ord < {n_base}) AS base,
      string_agg({name}, ',' ORDER BY start, ord) AS spans FROM found GROUP BY row)
    SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per ON d.row = per.row"""
