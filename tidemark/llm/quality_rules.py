"""Quality rules from a document's own counts and from how often its lines occur on its host.

Cross-document line frequency: every normalised line is hashed, and the distinct documents that hold it are
counted per host.  Lines above the limit are taken out, and a document that loses nearly all of its
characters this way is rejected.  A line is boilerplate because documents that differ share it, so
documents are told apart, for this count, by a hash of the set of all their lines.  A thousand
copies of an article are one document here; a menu above a thousand articles is in a thousand.

Everything is a DataFrame expression.  Texts are read once; what the counting needs (line hashes and
lengths) is written to the shared folder.  Line counts are aggregated twice, first by (host, line,
context), so neither a hot host nor a hot line meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, text_hash, written

#: fixed values: white space between words, and characters counted as symbols
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: a line is boilerplate on a host if it is in at least so many distinct documents, however many the host has
LINE_DOCS = 50
#: a document is depleted if it loses more than this share of its lines' characters
DEPLETED_SHARE = 0.9


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def window_hashes(words: Column) -> Column:
    """Hash of each run of WINDOW words; null for fewer words."""
    last = F.size(words) - (WINDOW - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def repeated_places(hashes: Column) -> Column:
    """(hash, place) of all windows, equal ones side by side; null unless two are equal."""
    twice = F.size(hashes) > F.size(F.array_distinct(hashes))
    return F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def covered_words(sides: Column) -> Column:
    """How many words the windows cover that equal a neighbour in the sorted list."""

    def equal(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(sides, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(sides, k + 1)["h"] == x["h"], F.lit(False)
        )

    return F.sort_array(F.transform(F.filter(sides, equal), lambda x: x["i"]))


def line_facts(lines: Column) -> Column:
    """hash and length of each normalised line that is not blank.  Part of a digest that SQL has too, 64 bits of it."""
    bare = F.filter(F.transform(lines, lambda x: F.lower(F.btrim(x, F.lit(SPACES)))), lambda x: x != "")
    return F.transform(bare, lambda x: F.struct(F.substring(F.md5(x), 1, 16).alias("h"), F.length(x).alias("n")))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_hash, host, the counts of the text alone, base_failed, and `lines` (hash, length)."""
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_hash().alias("text_hash"),
        (F.col(host).cast("string") if host in docs.columns else F.lit(None).cast("string")).alias("host"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    split = read.select(
        "doc_id",
        "text_hash",
        "host",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        words_of(F.col("text")).alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "text_hash",
        "host",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.filter("lines", lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("full"),
        line_facts(F.col("lines")).alias("lines"),
        window_hashes(F.col("words")).alias("hashes"),
    )
    sorted_out = hashed.select(
        "doc_id",
        "text_hash",
        "host",
        "n_symbols",
        "n_words",
        "word_chars",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        "lines",
        repeated_places(F.col("hashes")).alias("sides"),
    )
    placed = sorted_out.withColumn("places", covered_words(F.col("sides"))).drop("sides")
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    counted = placed.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    ).drop("places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def line_contexts(counts: DataFrame) -> DataFrame:
    """host, h, context: once per distinct line of a document, with a hash of all its lines."""
    own = counts.select("host", F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("all"))
    return own.select("host", F.xxhash64("all").alias("context"), F.explode("all").alias("h")).select("host", "h", "context")


def frequent_lines(counts: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """host, h, docs of the lines above the limit."""
    docs = line_contexts(counts).distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
    return docs.where(F.col("docs") >= line_docs)


def judge(
    docs: DataFrame,
    host: str = "source",
    line_docs: int = LINE_DOCS,
    depleted_share: float = DEPLETED_SHARE,
) -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    line_chars, removed_chars, kept of every row of docs.

    kept is false for a text that fails the base rules, and for one that loses more than depleted_share of its
    lines' characters to lines above the limit.  Null, empty and blank texts have no words and fail.
    Rows without a host share one.  Rows that repeat doc_id and text are judged alike, each; one text
    counts once for a line however often it is repeated.  An empty table gives an empty result.
    Columns besides doc_id, text and the host column are not read.
    """
    counts = written(base_counts(docs, host), "base-counts")
    frequent = written(frequent_lines(counts, line_docs), "frequent-lines")
    own = counts.select("doc_id", "text_hash", "host", F.explode("lines").alias("x"))
    known = frequent.select(F.col("host").alias("of_host"), F.col("h").alias("of_h"))
    hit = own.join(known, own["host"].eqNullSafe(known["of_host"]) & (own["x.h"] == known["of_h"]), "left_semi")
    # rows that repeat as a whole would add up: each counts its own copy, so the sum is divided again below
    lost = hit.groupBy("doc_id", "text_hash", "host").agg(F.sum("x.n").alias("all_removed"))
    copies = counts.groupBy("doc_id", "text_hash", "host").agg(F.count("*").alias("copies")).where("copies > 1")
    same = ["doc_id", "text_hash", "host"]
    lost = lost.select(*[F.col(c).alias(f"l_{c}") for c in same], "all_removed")
    copies = copies.select(*[F.col(c).alias(f"c_{c}") for c in same], "copies")

    def match(prefix: str) -> Column:
        return (
            F.col("doc_id").eqNullSafe(F.col(f"{prefix}_doc_id"))
            & (F.col("text_hash") == F.col(f"{prefix}_text_hash"))
            & F.col("host").eqNullSafe(F.col(f"{prefix}_host"))
        )

    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    removed = F.coalesce(F.col("all_removed"), F.lit(0)) / F.coalesce(F.col("copies"), F.lit(1))
    found = counts.withColumn("line_chars", chars).join(lost, match("l"), "left").join(copies, match("c"), "left")
    found = found.withColumn("removed_chars", removed.cast("bigint"))
    depleted = F.col("removed_chars") > depleted_share * F.col("line_chars")
    return found.select(
        "doc_id",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "line_chars",
        "removed_chars",
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of docs that judge() keeps, as they are; their boilerplate lines are left to line dedup."""
    verdicts = judge(docs, host, **limits).where("kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    kept = written(verdicts, "kept")
    mark = free_name(docs, "_text_hash")
    known = docs.withColumn(mark, F.xxhash64(docs["text"], docs["text"].isNull()))
    same = known["doc_id"].eqNullSafe(kept["_doc"]) & (known[mark] == kept["_text"])
    return known.join(kept, same, "left_semi").drop(mark)
