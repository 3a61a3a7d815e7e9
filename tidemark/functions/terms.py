"""Phrase extraction from free text against a vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import BASE_VOCABULARY
from tidemark.functions.arrays import let, no_strings, sorted_set

# A word may carry inner dots (node.js) and trailing + or # (c++, c#); any other
# visible character is a token of its own.
TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*[+#]*|[^\s\p{L}\p{N}]"
_TOKEN_PY = re.compile(r"[^\W_]+(?:\.[^\W_]+)*[+#]*|[^\s\w]|_")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def extract_terms(text: Column, vocabulary: Iterable[str] = BASE_VOCABULARY) -> Column:
    """Sorted distinct vocabulary terms in text, overlaps included.

    Narrow: no shuffle and no join.  Longer phrases are only built where their
    first token occurs, so the cost stays close to one pass over the tokens.
    """
    by_length: dict[int, dict[str, str]] = {}
    for term in vocabulary:
        parts = _TOKEN_PY.findall(term.lower())
        by_length.setdefault(len(parts), {})[" ".join(parts)] = term.lower()

    def found(words: Column) -> Column:
        hits = [_phrases(words, length, terms) for length, terms in sorted(by_length.items())]
        return sorted_set(F.concat(*hits))

    return F.when(text.isNull(), no_strings()).otherwise(let(tokens(text), found))


def _phrases(words: Column, length: int, terms: dict[str, str]) -> Column:
    if length == 1:
        return F.filter(words, lambda w: w.isin(*terms))
    firsts = sorted({phrase.split(" ")[0] for phrase in terms})

    def phrase_at(word: Column, i: Column) -> Column:
        rest = [F.get(words, i + k) for k in range(1, length)]
        return F.when(word.isin(*firsts), F.concat_ws(" ", word, *rest))

    hits = F.filter(F.transform(words, phrase_at), lambda p: p.isin(*terms))
    respelled = {phrase: term for phrase, term in terms.items() if phrase != term}
    if not respelled:
        return hits

    def spell(phrase: Column) -> Column:
        out = phrase
        for joined, term in sorted(respelled.items()):
            out = F.when(phrase == joined, term).otherwise(out)
        return out

    return F.transform(hits, spell)


def phrase_grams(words: Column, lengths: Iterable[int]) -> Column:
    """All distinct runs of these numbers of tokens, joined by spaces."""
    def runs(length: int) -> Column:
        last = F.size(words) - (length - 1)
        starts = F.when(last > 0, F.sequence(F.lit(1), last))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))
        return F.coalesce(joined, no_strings())

    return F.array_distinct(F.flatten(F.array(*[runs(length) for length in lengths])))


#: bytes of phrases that every task may hold: a table within them stays where the texts are
HELD_BYTES = 4 << 20
#: bytes of a held phrase besides its text
HELD_EACH = 100


def extract_from_table(rows: DataFrame, vocabulary: DataFrame, key: str, text: str, longest: int = 8) -> DataFrame:
    """(key, terms) of every row: the sorted distinct terms of vocabulary (one column, term) that its text holds.

    Gives what extract_terms gives, for vocabularies too large to stand in a plan: terms are a table, texts become runs of as
    many tokens as terms have, and the two meet in a join by hash, with the phrases compared besides.  A table within
    HELD_BYTES is broadcast, so that no run of tokens is shuffled; Spark cannot tell the size of every table by itself.  Terms
    of more than `longest` tokens stop the query.  key identifies a row; a null text and one without terms have none.
    """
    spelled = vocabulary.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    split = spelled.select("term", tokens(F.col("term")).alias("_t"))
    size = F.when(F.size("_t") <= longest, F.size("_t")).otherwise(
        F.raise_error(F.concat(F.lit("term of too many tokens: "), F.col("term"))).cast("int")
    )
    phrases = split.select("term", size.alias("n"), F.array_join("_t", " ").alias("phrase"))
    phrases = phrases.select("term", "n", "phrase", F.xxhash64("phrase").alias("_h"))
    # at most `longest` rows
    held = F.sum(F.octet_length("term") + F.octet_length("phrase") + HELD_EACH)
    sizes = {r[0]: r[1] for r in phrases.groupBy("n").agg(held).collect() if r[0]}
    lengths = sorted(sizes)
    if sum(sizes.values()) <= HELD_BYTES:
        phrases = F.broadcast(phrases)
    if not lengths:
        return rows.select(key, no_strings().alias("terms"))
    grams = rows.select(F.col(key).alias("_key"), F.explode(let(tokens(F.col(text)), lambda words: phrase_grams(words, lengths))).alias("_gram"))
    grams = grams.select("_key", "_gram", F.xxhash64("_gram").alias("_g"))
    hits = grams.join(phrases, (F.col("_g") == F.col("_h")) & (F.col("_gram") == F.col("phrase")))
    found = hits.groupBy("_key").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    return rows.join(found, rows[key] == found["_key"], "left").select(
        rows[key], F.coalesce("_terms", no_strings()).alias("terms")
    )
