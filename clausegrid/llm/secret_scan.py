"""Secrets in texts: candidates by shape, and a random forest that removes the false ones.

Candidates, their features and the forest's trees are column expressions, so a text is scanned, scored
and redacted in its own row. The forest is Spark ML's, fitted on labelled findings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import let, stored, words_of

# Shapes and words by which findings are known.
LONG_RUN = r"[A-Za-z0-9+/_\-]{16,}+={0,2}"
SHORT_VALUE = r"[^\s\"'`,;()]{8,}+"
#: A value behind an assignment sign in the same word; not what follows a URL's scheme.
INNER_VALUE = r"[A-Za-z0-9_\])\"'`](?:=>|:=|=|:)[\"'`]?(?!//)([^\s\"'`,;()]{8,}+)"
KEY_WORDS = "token|secret|passw|passwd|pwd|api_?key|apikey|access_?key|private_?key|credential|auth|bearer|akia|ghp_|xox[bp]-"
PLAIN_WORDS = "commit|revision|sha1|sha256|md5|digest|checksum|hash|uuid|guid|isbn|card|phone|call|tel|fax|order|invoice|serial|version|build"
TEST_PATHS = "test|example|sample|fixture|mock|dummy|doc"
DICTIONARY = (
    "the and for that with this from have are was were been will would there their which about when where your "
    "der die das und nicht eine einer mit für auf ist von den des sich auch les des une est dans pour que qui pas sur "
    "los las una del por con para como más pero example sample test user name value data file path http https www com "
    "org html index image table page item list node class function return string number object config default setting "
    "version build release update create delete select insert server client request response message error"
).split()

FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "kind_changes", "case_changes", "distinct_share",
    "dictionary", "key_word", "assigned", "quoted", "plain_word", "test_path", "path_depth",
)
#: Labelled findings of each kind that the forest is fitted on, about; more are thinned by hash.
MAX_LABELLED = 10_000
TREES, DEPTH, LIMIT = 20, 5, 0.5
MASK = "[SECRET]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _features(found: Column, word: Column, words: Column, at: Column, path: Column) -> Column:
    """One candidate as a struct: its word's place, itself, and the features."""
    n = F.length(found).cast("double")
    near = lambda k: F.coalesce(F.get(words, at + k), F.lit(""))
    around = F.lower(F.concat_ws(" ", near(-3), near(-2), near(-1), word, near(1)))
    lead = F.concat(near(-1), F.left(word, F.position(found, word) - 1))
    low = F.lower(found)
    flag = lambda c: c.cast("double")
    values = {
        "length": n,
        "digit_share": _count(found, "[0-9]") / n,
        "upper_share": _count(found, "[A-Z]") / n,
        "hex_share": _count(low, "[0-9a-f]") / n,
        "kind_changes": _count(found, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "case_changes": _count(found, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "distinct_share": F.size(F.array_distinct(F.split(found, ""))) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))) / n,
        "key_word": flag(around.rlike(KEY_WORDS)),
        "assigned": flag(lead.rlike(r"[=:]\W*$")),
        "quoted": flag(word.rlike("[\"'`]")),
        "plain_word": flag(around.rlike(PLAIN_WORDS)),
        "test_path": flag(path.rlike(TEST_PATHS)),
        "path_depth": _count(path, "[/\\\\]"),
    }
    return F.struct(at.cast("long").alias("word"), found.alias("secret"), *[values[f].alias(f) for f in FEATURES])


def candidates_of(text: Column, path: Column) -> Column:
    """All candidates of a text in order, as an array of structs.

    A candidate is a run of at least 16 letters, digits and ``+/_-`` holding a digit, or a value of at
    least 8 characters that stands after an assignment sign, in the word or at the end of the word before,
    holding a digit or led by a key word. Runs inside such a value are none of their own. A null text has none;
    a null path counts as empty.
    """
    path = F.lower(F.coalesce(path.cast("string"), F.lit("")))

    def of_words(words: Column) -> Column:
        at_sign = lambda i: F.coalesce(F.get(words, i - 1), F.lit("")).rlike("[:=]>?\\W*$")
        long = lambda i: F.length(F.get(words, i)) >= 16
        short = lambda i: (F.length(F.get(words, i)) >= 8) & at_sign(i)
        inner = lambda i: (F.length(F.get(words, i)) >= 10) & F.get(words, i).rlike(INNER_VALUE)
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: long(i) | short(i) | inner(i))

        def of_place(i: Column) -> Column:
            word = F.get(words, i)
            runs = F.regexp_extract_all(word, F.lit(LONG_RUN), F.lit(0))
            inside = F.regexp_extract_all(word, F.lit(INNER_VALUE), F.lit(1))
            after = F.when(at_sign(i) & (F.size(inside) == 0), F.regexp_extract_all(word, F.lit(SHORT_VALUE), F.lit(0))).otherwise(inside)
            # A run with a sentence's end behind it is found without that.
            bare = lambda v: F.regexp_replace(v, "[.!?:]+$", "")
            values = F.transform(after, lambda v: F.when(F.exists(runs, lambda r: r == bare(v)), bare(v)).otherwise(v))
            rest = F.filter(runs, lambda r: ~F.exists(values, lambda v: F.contains(v, r)))
            before = lambda k: F.coalesce(F.get(words, i - k), F.lit(""))
            lead = lambda x: F.lower(F.concat_ws(" ", before(2), before(1), F.left(word, F.position(x, word) - 1)))
            led = F.filter(values, lambda x: x.rlike("[0-9]") | lead(x).rlike(KEY_WORDS))
            found = F.concat(led, F.filter(rest, lambda x: x.rlike("[0-9]")))
            return F.transform(found, lambda x: _features(x, word, words, i, path))

        return F.when(F.size(words) > 0, F.flatten(F.transform(places, of_place)))

    return F.coalesce(let(words_of(text), of_words), F.array().cast("array<" + CANDIDATE + ">"))


CANDIDATE = "struct<word:bigint,secret:string," + ",".join(f"{f}:double" for f in FEATURES) + ">"


def find_candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, word (place of its word in the text), secret, and the features."""
    found = docs.select("doc_id", candidates_of(F.col("text"), F.col("source")).alias("found"))
    return found.select("doc_id", F.inline("found"))


def certain_labels(candidates: DataFrame) -> DataFrame:
    """Findings that rules can label for sure, with ``is_secret`` 1 or 0; the others are left out.

    Secret: a quoted, mixed value assigned to a name that says so. Not secret: digits alone, or a value
    neither assigned nor near such a name.
    """
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 1.0) & (F.col("dictionary") < 0.3)
    yes = (F.col("key_word") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & mixed & (F.col("test_path") == 0)
    no = (F.col("digit_share") == 1.0) | ((F.col("key_word") == 0) & (F.col("assigned") == 0))
    return candidates.withColumn("is_secret", F.when(yes, 1).when(no, 0)).where("is_secret IS NOT NULL")


def fit_forest(labelled: DataFrame) -> Callable[[Callable[[str], Column]], Column] | None:
    """The forest's score, 0 to 1, given how a feature is read; None unless both labels occur.

    ``labelled`` has the features, ``secret`` and ``is_secret``. At most about ``MAX_LABELLED`` findings of
    each label are used, taken by hash, in a fixed order: the same findings give the same forest.
    """
    counts = {r["is_secret"]: r["count"] for r in labelled.groupBy("is_secret").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    part = F.lit(0)
    for label, n in counts.items():
        part = F.when(F.col("is_secret") == label, F.lit(min(1_000_000, 1_000_000 * MAX_LABELLED // n))).otherwise(part)
    chance = F.pmod(F.xxhash64("doc_id", "word", "secret"), F.lit(1_000_000))
    sample = stored(labelled.where(chance < part), "labelled")
    rows = sample.coalesce(1).sortWithinPartitions("doc_id", "word", "secret", *FEATURES)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).withColumn("label", F.col("is_secret").cast("double"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(rows)
    return partial(_score, model)


def _tree(node, value) -> Column:
    """A tree as nested cases; a leaf gives its share of secrets among the findings it was grown on."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / sum(stats)))
    split = node.split()
    feature = value(FEATURES[split.featureIndex()])
    return F.when(feature <= split.threshold(), _tree(node.leftChild(), value)).otherwise(_tree(node.rightChild(), value))


def _score(model, value) -> Column:
    trees = [_tree(tree._call_java("rootNode"), value) for tree in model.trees]
    return sum(trees[1:], trees[0]) / len(trees)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, word, secret, score, is_secret``: one row for every candidate of every text.

    ``docs``: doc_id, text, source (the path); other columns are not read. ``labelled``: findings as
    ``find_candidates`` gives them with ``is_secret``; by default those of ``docs`` that rules can label.
    Where one of the labels is missing, nothing is removed: every score is 1. Null and empty texts have
    no candidates; repeated rows have theirs each; no rows, none.
    """
    found = stored(find_candidates(docs), "candidates")
    score = fit_forest(certain_labels(found) if labelled is None else labelled)
    scored = found.withColumn("score", F.round(score(F.col), 9) if score else F.lit(1.0))
    return scored.select("doc_id", "word", "secret", "score", (F.col("score") >= LIMIT).alias("is_secret"))


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every occurrence of a secret in its own text replaced by ``[SECRET]``.

    All rows and columns stay; a column n_chars is counted again where the text changed. Which findings
    are secrets is decided as in ``scan``. Findings of one text are scored together with that text, so
    no text is shuffled.
    """
    found = stored(find_candidates(docs), "candidates")
    labelled = certain_labels(found) if labelled is None else labelled
    rows = docs.select(F.struct(*docs.columns).alias("__row"), candidates_of(F.col("text"), F.col("source")).alias("__found"))
    score = fit_forest(labelled)
    if score:
        true = F.filter("__found", lambda x: F.round(score(lambda f: x[f]), 9) >= LIMIT)
    else:
        true = F.col("__found")
    secrets = F.array_distinct(F.transform(true, lambda x: x["secret"]))
    text = F.aggregate(secrets, F.col("__row.text"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    changed = rows.select("__row", text.alias("__text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            same = F.col("__text").eqNullSafe(F.col("__row.text"))
            counted = F.length("__text").cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(same, F.col("__row.n_chars")).otherwise(counted).alias("n_chars"))
        else:
            columns.append(F.col(f"__row.`{c}`"))
    return changed.select(*columns)
