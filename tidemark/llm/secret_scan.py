"""Secrets in texts: candidates by pattern, false ones removed by a random forest.

A candidate is a word that holds a run of at least twelve key characters with a digit among them, or a value
given to a name such as password.  The forest sees its length, how its characters change class from one
to the next, how much of it dictionary words cover, the path of its document and the words beside it.
The dictionary is the corpus: a part of a candidate is a word if enough documents use it as one.

Extraction, features, training and scoring are DataFrame operations and Spark's own random forest; no
Python runs on executors.  The forest is trained on at most MAX_FINDINGS labelled findings, those with the
smallest hashes; everything else covers all rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_hash, written

MAX_FINDINGS = 50_000
TREES, DEPTH, SEED = 20, 6, 7
LEAST_DOCS = 5  # documents that must use a part as a word before it counts as one
KEPT_FROM = 0.5

#: fixed values: names that secrets are given under, and path parts of texts that hold made-up ones
NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential"
MOCK_PATHS = "test|example|sample|fixture|mock|demo|doc"
#: a whole run of at least twelve key characters with a digit among them, read once from its start
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{12})[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+"
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?[=:][\"']?[^\s\"']{{6,}}"
CANDIDATE = rf"{ASSIGNED}|{RUN}"

FEATURES = [
    "length", "digits", "capitals", "hexadecimal", "class_changes", "vowel_changes", "distinct_chars", "dictionary",
    "path_mock", "path_depth", "in_url", "assigned", "quoted", "name_beside", "plain_before", "plain_after",
]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, text_hash, path, place (of the word, from 0), word, value, before, after of every candidate."""
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_hash().alias("text_hash"),
        F.coalesce(where, F.lit("")).alias("path"),
        F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "").alias("words"),
    )

    def is_candidate(i: Column) -> Column:
        word = F.get("words", i)
        return (F.length(word) >= 12) & word.rlike(CANDIDATE)

    places = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), is_candidate))
    # outer: for an inner explode Spark infers a filter and writes the split into every turn of its lambda
    found = words.withColumn("places", places).select("*", F.explode_outer("places").alias("place")).where("place is not null")
    beside = [F.coalesce(F.get("words", F.col("place") + k), F.lit("")) for k in (-2, -1, 1)]
    word = F.get("words", F.col("place"))
    named = word.rlike(ASSIGNED)
    value = F.when(named, F.regexp_extract(word, rf"(?i)(?:{NAMES})[\"']?[=:][\"']?([^\s\"',;]+)", 1)).otherwise(
        F.regexp_extract(word, RUN, 0)
    )
    return found.select(
        "doc_id",
        "text_hash",
        "path",
        "place",
        word.alias("word"),
        value.alias("value"),
        F.concat_ws(" ", beside[0], beside[1]).alias("before"),
        beside[1].alias("last"),
        beside[2].alias("after"),
    )


def letter_parts(value: Column) -> Column:
    """The runs of three and more letters of a value, lower-cased."""
    return F.filter(F.split(F.lower(value), "[^a-z]+"), lambda p: F.length(p) >= 3)


def dictionary(docs: DataFrame, parts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """part, of those in parts, that at least least_docs documents use as a word."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))
    used = docs.select(F.explode_outer(words).alias("part")).join(parts, "part", "left_semi")
    return used.groupBy("part").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("part")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with one column per feature."""
    key = ["doc_id", "text_hash", "path", "place"]
    own = found.select(*key, F.explode(F.array_distinct(letter_parts(F.col("value")))).alias("part"))
    covered = own.join(known, "part", "left_semi")
    # a part that stands twice in a value covers twice
    parts = covered.groupBy(*key).agg(F.collect_set("part").alias("in_dictionary"))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in key], "in_dictionary")
    same = F.lit(True)
    for c in key:
        same = same & found[c].eqNullSafe(parts[f"_{c}"])
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / n

    def changes(classes: Column) -> Column:
        return F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n

    def replaced(c: Column, *steps: tuple[str, str]) -> Column:
        for pattern, by in steps:
            c = F.regexp_replace(c, pattern, by)
        return c

    in_words = F.filter(letter_parts(value), lambda p: F.array_contains(F.coalesce("in_dictionary", F.array().cast("array<string>")), p))
    plain = r"^[\p{L}.,;]*$"
    columns = {
        "length": F.length(value),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "hexadecimal": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "class_changes": changes(replaced(value, ("[A-Z]", "U"), ("[a-z]", "l"), ("[0-9]", "0"), ("[^Ul0]", "-"))),
        "vowel_changes": changes(replaced(F.lower(value), ("[aeiou]", "V"), ("[a-z]", "c"), ("[^Vc]", "-"))),
        "distinct_chars": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": F.length(F.array_join(in_words, "")) / n,
        "path_mock": F.col("path").rlike(f"(?i)(?:{MOCK_PATHS})"),
        "path_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "in_url": F.contains("word", F.lit("://")) | F.contains("word", F.lit("@")),
        "assigned": F.col("word").rlike(ASSIGNED) | F.col("last").rlike("[=:]$"),
        "quoted": F.col("word").rlike("[\"'`]"),
        "name_beside": F.concat_ws(" ", "before", "word").rlike(rf"(?i)(?:{NAMES})"),
        "plain_before": F.col("last").rlike(plain),
        "plain_after": F.col("after").rlike(plain),
    }
    joined = found.join(parts, same, "left")
    return joined.select(*[found[c] for c in found.columns], *[columns[f].cast("double").alias(f) for f in FEATURES])


def train(labelled: DataFrame, most: int = MAX_FINDINGS):
    """A forest from findings with features and `secret` (0 or 1); None unless both are among them."""
    usable = labelled.where(F.col("secret").isNotNull()).select(*FEATURES, F.col("secret").cast("double").alias("secret"))
    chosen = written(usable.orderBy(F.xxhash64(*FEATURES), *FEATURES, "secret").limit(most), "labelled-findings")
    if chosen.select("secret").distinct().limit(2).count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    )
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(chosen))


def findings(docs: DataFrame, path: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every candidate with its features, written once."""
    found = written(candidates(docs, path), "candidates")
    parts = written(found.select(F.explode(letter_parts(F.col("value"))).alias("part")).distinct(), "parts")
    return written(featured(found, dictionary(docs, parts, least_docs)), "findings")


def judged(found: DataFrame, model, kept_from: float = KEPT_FROM) -> DataFrame:
    """doc_id, text_hash, place, n_chars, value_sha256, probability, kept of every finding.

    probability is the forest's that the candidate is a secret; kept is whether it reaches kept_from.  Without
    a forest every candidate is kept, with no probability.  Secrets are told by digest, not by value.
    Texts that are null, empty or without candidates give no row; rows of docs that repeat give
    repeated findings; a document without a path has an empty one.
    """
    if model is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
        scored = model.transform(vectors).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(
        "doc_id",
        "text_hash",
        "place",
        F.length("value").alias("n_chars"),
        F.sha2("value", 256).alias("value_sha256"),
        "probability",
        (F.coalesce("probability", F.lit(1.0)) >= kept_from).alias("kept"),
    )


#: fixed values: formats that tell what a value is, for findings nobody has labelled by hand
SECRET_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{18,64})$"
OTHER_FORMATS = r"^(?:[0-9+-]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-z]{3,}[0-9]{1,4}|(?:[a-z]+[-_/])+[0-9]+)$"


def labelled_by_format(found: DataFrame) -> DataFrame:
    """found with `secret`: 1 for a known key format, 0 for numbers, ids and words with a number, else null."""
    value = F.col("value")
    return found.withColumn("secret", F.when(value.rlike(SECRET_FORMATS), 1).when(value.rlike(OTHER_FORMATS), 0))
