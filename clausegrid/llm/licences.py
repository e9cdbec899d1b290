"""Licence scans by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences; the sequence of a text's
identifiers is matched against ordered rules, and what one rule has matched is gone for the next.
Everything happens in the text's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import let

# Wording of public licences, after normalisation. The first pattern that fits names the
# sentence. Every pattern needs one of CLUES in the sentence.
CLUES = "licen[cs]|copyright|permission is hereby|redistribut|warrant|all rights reserved|public domain|as is|creative commons|cc by|cc0|any later version|gpl|endorse|in the hope that|apache-2|bsd"
SENTENCES = [
    ("MIT_GRANT", "^permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", "^the above copyright notice and this permission notice shall be included"),
    ("MIT_AS_IS", "^the software is provided as is without warranty of any kind"),
    ("BSD_GRANT", "^redistribution and use in source and binary forms"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright"),
    ("BSD_NAMES", "^neither the name .* may be used to endorse or promote"),
    ("BSD_AS_IS", "^this software is provided by .* as is"),
    ("APACHE2_COMPLIANCE", "you may not use this (file|work) except in compliance with the license"),
    ("APACHE2_AS_IS", "distributed on an as is basis"),
    ("AGPL3", "gnu affero general public license.* version 3"),
    ("LGPL3", "gnu lesser general public license.* version 3"),
    ("LGPL2_1", "gnu lesser general public license.* version 2.1"),
    ("GPL3_OR_LATER", "gnu general public license.* version 3.* any later version"),
    ("GPL3", "gnu general public license.* version 3|gpl ?v?3"),
    ("GPL2_OR_LATER", "gnu general public license.* version 2.* any later version"),
    ("GPL2", "gnu general public license.* version 2|gpl ?v?2"),
    ("OR_LATER", "any later version"),
    ("GPL_USEFUL", "distributed in the hope that it will be useful"),
    ("APACHE2", "apache license version 2.0|apache license 2.0|apache-2.0"),
    ("MPL2", "mozilla public license.* (v[.] )?2.0"),
    ("CC_BY_NC_4", "cc by-nc 4.0|creative commons attribution-noncommercial 4.0"),
    ("CC_BY_SA_4", "cc by-sa 4.0|creative commons attribution-sharealike 4.0"),
    ("CC_BY_4", "cc by 4.0|creative commons attribution 4.0"),
    ("CC0", "cc0|creative commons zero"),
    ("MIT", "mit license|licensed under mit|license mit"),
    ("BSD3", "bsd 3-clause|3-clause bsd|new bsd license"),
    ("BSD2", "bsd 2-clause|2-clause bsd|simplified bsd license"),
    ("PUBLIC_DOMAIN", "public domain"),
    ("ALL_RIGHTS", "all rights reserved"),
    ("COPYRIGHT", "^copyright "),
    ("OTHER_LICENCE", "licensed under|license agreement|under the terms of the .*licen[cs]e"),
]
# Licences by the identifiers that show them, the most specific first.
RULES = [
    ("MIT", "(?:<MIT>)?<MIT_GRANT><MIT_NOTICE>(?:<MIT_AS_IS>)?"),
    ("BSD-3-Clause", "<BSD_GRANT>(?:<BSD_SOURCE>)?<BSD_BINARY><BSD_NAMES>(?:<BSD_AS_IS>)?"),
    ("BSD-2-Clause", "<BSD_GRANT>(?:<BSD_SOURCE>)?<BSD_BINARY>(?:<BSD_AS_IS>)?"),
    ("Apache-2.0", "<APACHE2>(?:<APACHE2_COMPLIANCE>)?(?:<APACHE2>)?(?:<APACHE2_AS_IS>)?"),
    ("AGPL-3.0", "<AGPL3>(?:<OR_LATER>)?(?:<GPL_USEFUL>)?"),
    ("LGPL-3.0", "<LGPL3>(?:<OR_LATER>)?(?:<GPL_USEFUL>)?"),
    ("LGPL-2.1", "<LGPL2_1>(?:<OR_LATER>)?(?:<GPL_USEFUL>)?"),
    ("GPL-3.0-or-later", "(?:<GPL3_OR_LATER>|<GPL3><OR_LATER>)(?:<GPL_USEFUL>)?"),
    ("GPL-2.0-or-later", "(?:<GPL2_OR_LATER>|<GPL2><OR_LATER>)(?:<GPL_USEFUL>)?"),
    ("GPL-3.0", "<GPL3>(?:<GPL_USEFUL>)?"),
    ("GPL-2.0", "<GPL2>(?:<GPL_USEFUL>)?"),
    ("MPL-2.0", "<MPL2>"),
    ("CC-BY-NC-4.0", "<CC_BY_NC_4>"),
    ("CC-BY-SA-4.0", "<CC_BY_SA_4>"),
    ("CC-BY-4.0", "<CC_BY_4>"),
    ("CC0-1.0", "<CC0>"),
    ("MIT", "<MIT>"),
    ("BSD-3-Clause", "<BSD3>"),
    ("BSD-2-Clause", "<BSD2>"),
    ("Public-Domain", "<PUBLIC_DOMAIN>"),
    # A notice that a licence (by now "#") follows is that licence's own.
    (None, "(?:<COPYRIGHT>)?<ALL_RIGHTS>(?:<COPYRIGHT>|<ALL_RIGHTS>)*#"),
    ("Proprietary", "(?:<COPYRIGHT>)?<ALL_RIGHTS>"),
    ("Unknown", "<OTHER_LICENCE>"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "[.!?;]+[ \\t\\r]+|[.!?;]*\\n"
# A newline inside a hard-wrapped sentence, with the comment sign of the next line. The line
# before is long and has no end of a sentence; the next one is no list item, and if it starts like a
# sentence of its own, the line before is longer.
_NO_ITEM = "(?![0-9a-z]{1,3}[.)][ \\t]|\\([0-9a-z]\\)[ \\t]|[-\u2022][ \\t])"
_NO_START = "(?!Copyright |Licensed |SPDX|All rights|ALL RIGHTS|Permission is|Redistribution|The above copyright|Neither |NEITHER |THE SOFTWARE IS|THIS SOFTWARE IS|This |Released )"
_NEXT = "[ \\t\\r]*\\n[ \\t]*(?:(?:#+|//+|\\*+|;+|--+|%+|>+)[ \\t]+)?"
WRAP = (
    f"(?<=[^\\n]{{25}})(?<![.!?;: \\t\\r]){_NEXT}{_NO_ITEM}(?=[a-z0-9(\"'`])"
    f"|(?<=[^\\n]{{40}})(?<![.!?;: \\t\\r]){_NEXT}{_NO_ITEM}{_NO_START}(?=[A-Z])"
)
# The GPL's semicolon before its version ends no sentence.
VERSION = ";(?=\\s+(?:(?:#+|//+|\\*+)\\s+)?either\\s+(?:(?:#+|//+|\\*+)\\s+)?version)"


def _normal(sentence: Column) -> Column:
    """Lower case, everything but letters, digits and ``. + -`` as one blank, no full stops at the end."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9.+-]+", " ")
    return F.regexp_replace(plain, "^ +|[ .]+$", "")


def _identifier(sentence: Column) -> Column:
    """The first fitting identifier of a normalised sentence; most have no clue and are left at once."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(sentence.rlike(CLUES), out)


def sentences_of(text: Column) -> Column:
    """The known licence sentences of a text in order: place, identifier and wording of each.

    Sentences wrapped over several lines are joined first.
    """
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), VERSION, ","), WRAP, " ")
    whole = F.split(joined, BREAK)
    known = F.transform(whole, lambda s, i: F.struct(i.cast("long").alias("sentence"), let(_normal(s), _identifier).alias("identifier"), s.alias("wording")))
    kind = "array<struct<sentence:bigint,identifier:string,wording:string>>"
    found = F.filter(known, lambda x: x["identifier"].isNotNull()).cast(kind)
    clue = F.translate(text, UPPER, LOWER).rlike(CLUES)
    return F.when(F.coalesce(clue, F.lit(False)), found).otherwise(F.array().cast(kind))


def licence_sentences(docs: DataFrame) -> DataFrame:
    """One row per known licence sentence: doc_id, sentence (its number), identifier, wording."""
    return docs.select("doc_id", F.inline(sentences_of(F.col("text"))))


def recognise(docs: DataFrame) -> DataFrame:
    """``doc_id, licence, matches, identifiers``: a row for each licence found in a text.

    ``docs``: doc_id, text; other columns are not read. ``matches`` counts the places where a rule of the
    licence fits, ``identifiers`` is the text's whole sequence. Null and empty texts, and texts without
    licence sentences, have no rows; repeated rows have theirs each.
    """
    found = docs.select("doc_id", sentences_of(F.col("text")).alias("found")).where(F.size("found") > 0)
    rows = found.select("doc_id", F.array_join(F.transform("found", lambda x: F.concat(F.lit("<"), x["identifier"], F.lit(">"))), "").alias("identifiers"))
    rows = rows.withColumn("left", F.col("identifiers"))
    for k, (_, pattern) in enumerate(RULES):
        rows = rows.select("*", F.regexp_count("left", F.lit(pattern)).alias(f"n_{k}")).withColumn("left", F.regexp_replace("left", pattern, "#"))
    names = list(dict.fromkeys(name for name, _ in RULES if name))
    total = lambda name: sum((F.col(f"n_{k}") for k, (n, _) in enumerate(RULES) if n == name), F.lit(0))
    by_licence = F.array(*[F.struct(F.lit(n).alias("licence"), total(n).cast("long").alias("matches")) for n in names])
    return rows.select("doc_id", F.inline(by_licence), "identifiers").where("matches > 0")


def check_sql() -> str:
    """The same in SQL: sentences as rows, rules one after the other."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    rules = "joined"
    for k, (_, pattern) in enumerate(RULES):
        rules = (
            f"(SELECT * EXCLUDE (rest), len(regexp_extract_all(rest, {quote(pattern)})) AS n_{k}, "
            f"regexp_replace(rest, {quote(pattern)}, '#', 'g') AS rest FROM {rules})"
        )
    counts = " UNION ALL ".join(f"SELECT r, doc_id, identifiers, {quote(n)} AS licence, n_{k} AS n FROM matched" for k, (n, _) in enumerate(RULES) if n)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '{BREAK}') AS parts
  FROM documents WHERE regexp_matches(translate(text, '{UPPER}', '{LOWER}'), '{CLUES}')),
s AS (SELECT r, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM d),
n AS (SELECT r, doc_id, k, regexp_replace(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9.+-]+', ' ', 'g'), '^ +|[ .]+$', '', 'g') AS s FROM s),
i AS (SELECT r, doc_id, k, CASE {cases} END AS id FROM n),
joined AS (SELECT r, doc_id, string_agg('<' || id || '>', '' ORDER BY k) AS identifiers, string_agg('<' || id || '>', '' ORDER BY k) AS rest
  FROM i WHERE id IS NOT NULL GROUP BY r, doc_id),
matched AS (SELECT * FROM {rules})
SELECT doc_id, licence, CAST(sum(n) AS BIGINT) AS matches, identifiers FROM ({counts}) WHERE n > 0 GROUP BY r, doc_id, identifiers, licence
"""
