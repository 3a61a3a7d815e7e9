"""One document of each group of texts whose word shingles are similar: SimHash near-dedup at a Jaccard similarity.

Fingerprints of the shingle sets are linked by Golay keys within three bits, as near_dups does, and sets under one
fingerprint or linked ones are compared in full.  That settles most copies.  But two texts of similarity 0.8 mostly have fingerprints
further apart than any radius that keys of 64 bits can guarantee, so what is still apart then goes through
the chosen-path join, whose trees miss such a pair with a chance below 1e-5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, near_dups
from tidemark.llm.common import written

#: texts are similar if their sets of runs of so many words have a Jaccard similarity of PARTS / OF or more
WIDTH, PARTS, OF = 5, 4, 5


def print_pairs(sets: DataFrame) -> DataFrame:
    """a, b: each set beside the first one of its fingerprint, and the first ones of fingerprints within three bits."""
    firsts = written(sets.groupBy("print").agg(F.min("id").alias("first")), "first-sets")
    same = sets.join(firsts, "print").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = near_dups.links(firsts)
    ends = [firsts.select(F.col("print").alias(side), F.col("first").alias(f"{side}_id")) for side in ("a", "b")]
    linked = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return same.union(linked)


def similar_groups(docs: DataFrame, width: int = WIDTH, parts: int = PARTS, of: int = OF) -> DataFrame:
    """doc_id, text_hash, root of every row of docs: rows that a chain of similar texts connects have one root.

    Words are those of near_dups.groups().  A text of fewer words than width is one shingle; texts without words are alike.
    Rows with a null doc_id are compared like others; rows that repeat doc_id and text have one root.
    An empty table gives no rows; other columns are not read.
    """
    rows = chosen_path.similar_rows(docs, width, parts, of, first=print_pairs)
    # no set has the hash zero but by chance, and then of 2**64 values
    return rows.select("doc_id", "text_hash", F.coalesce("root", F.lit(0)).cast("bigint").alias("root"))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id stays.

    Ties go to the smaller text hash, and a row without an id stays only where no other has one.  Rows that
    repeat doc_id and text are cut down to one.  All columns of docs are kept as they are.
    """
    return near_dups.first_of_each(docs, similar_groups(docs, width))
