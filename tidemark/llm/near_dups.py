"""Near-duplicate groups by SimHash with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into four segments of 16 bits.  Two fingerprints that differ in at most three
bits agree in some segment, and of the other three segments, which share at most three errors,
one has at most one.  So for every ordered pair of segments (i, j) the key is segment i as it is and a Golay
codeword near segment j.  The perfect binary Golay code [23, 12, 7] puts every 23-bit word within three
bits of exactly one codeword; a word one bit away from it has that codeword within four bits.  A
fingerprint is therefore filed under its nearest codeword and looked up under all codewords within
four bits, one or six of them.  This misses no pair within three bits; the join checks the distance.

Only distinct fingerprints are filed, so a group of exact copies is one row of the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, free_name, identified, pieces, texts_of, written
from tidemark.llm.graph import component_roots

SEED = 42
#: shingles whose bits are counted at once
SHINGLES_AT_ONCE = 100_000

#: fixed value: generator polynomial of the binary Golay code [23, 12, 7], x^11+x^10+x^6+x^5+x^4+x^2+1
GOLAY_POLYNOMIAL = 0b110001110101
GOLAY_BITS, GOLAY_CHECKS = 23, 11
SEGMENTS, SEGMENT_BITS = 4, 16
RADIUS = 3


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of `width` words, repeats included; all words if there are fewer; none if there are none."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)))


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    parts = shingles(text, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), dtype=">u8", count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        rows = hashes[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        # sums of up to 255 rows fit a byte
        bits = np.unpackbits(rows, axis=1)
        whole = len(bits) // 255 * 255
        blocks = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8)
        ones += blocks.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash and the fingerprint (as a signed 64-bit number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_hash"), pa.array(prints)], ["doc_id", "text_hash", "print"]
            )

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, print bigint")


def _remainder(word: int) -> int:
    for bit in range(GOLAY_BITS - 1, GOLAY_CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GOLAY_POLYNOMIAL << bit - GOLAY_CHECKS
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of 16-bit words, and per remainder the error patterns of up to four bits, lightest first."""
    single = [_remainder(1 << b) for b in range(GOLAY_BITS)]
    remainders = np.zeros(1 << SEGMENT_BITS, dtype=np.int32)
    for b in range(SEGMENT_BITS):
        remainders[1 << b : 2 << b] = remainders[: 1 << b] ^ single[b]
    patterns: list[list[int]] = [[] for _ in range(1 << GOLAY_CHECKS)]
    for weight in range(5):
        for bits in combinations(range(GOLAY_BITS), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            patterns[rest].append(sum(1 << b for b in bits))
    counts = np.array([len(p) for p in patterns], dtype=np.int64)
    padded = np.zeros((len(patterns), counts.max()), dtype=np.int64)
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    return remainders, padded, counts


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word the indices of the codewords within four bits, nearest first, and how many they are."""
    remainders, patterns, counts = golay_tables()
    rest = remainders[words]
    return (words.astype(np.int64)[:, None] ^ patterns[rest]) >> GOLAY_CHECKS, counts[rest]


def segment_keys(prints: np.ndarray, nearby: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints; nearby: under all codewords near, else the nearest one."""
    prints = prints.view(np.uint64)
    parts = [(prints >> np.uint64(SEGMENT_BITS * s) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)]
    rows, keys = [], []
    for j in range(SEGMENTS):
        codes, counts = golay_indices(parts[j])
        for k in range(codes.shape[1] if nearby else 1):
            has = np.flatnonzero(counts > k)
            for i in range(SEGMENTS):
                if i != j:
                    rows.append(has)
                    keys.append((i * SEGMENTS + j) << 28 | parts[i][has] << 12 | codes[has, k])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame, nearby: bool) -> DataFrame:
    """key, print for every key of every fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            values = column(batch, "print").to_numpy()
            rows, keys = segment_keys(values, nearby)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(run, "key bigint, print bigint")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a < b: every pair of distinct fingerprints of `prints` within radius bits, radius at most three."""
    if radius > RADIUS:
        raise ValueError(f"the keys guarantee pairs within {RADIUS} bits")
    filed = keyed(prints, nearby=False).withColumnRenamed("print", "a")
    asked = keyed(prints, nearby=True).withColumnRenamed("print", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # Spark takes either side to be as small as prints, whose keys are 12 and up to 72 times as many rows: not to be broadcast
    met = filed.hint("merge").join(asked, (filed["key"] == asked["key"]) & near)
    return met.select("a", "b").distinct()


def groups(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, print, root, component_id, n_links of every row of docs.

    Rows are linked if their fingerprints differ in at most radius bits, and component_id is the smallest
    doc_id of all rows a chain of links reaches, the row itself included (null if none of them has
    an id).  root is one fingerprint of the component, which names it even where ids repeat or are
    missing.  n_links counts the other distinct fingerprints a row's one is linked to.

    Words are what white space separates, A-Z lower-cased; null, empty and blank texts have the
    fingerprint zero and are linked like any other.  Repeated rows share a component.  An empty table
    gives an empty result; columns besides doc_id and text are not read.
    """
    known = written(fingerprints(docs, width), "prints")
    distinct = written(known.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct-prints")
    edges = written(links(distinct, radius), "links")
    roots = component_roots(edges)
    ends = edges.select(F.col("a").alias("end")).union(edges.select("b"))
    degree = ends.groupBy("end").agg(F.count("*").alias("n_links"))
    member = (
        distinct.join(roots, distinct["print"] == roots["node"], "left")
        .join(degree, distinct["print"] == degree["end"], "left")
        .select("print", "low", F.coalesce("root", "print").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = member.join(lowest, "root").select("print", "root", "component_id", "n_links")
    return known.join(by_print, "print").select("doc_id", "text_hash", "print", "root", "component_id", "n_links")


def hex_print(column_name: str):
    return F.lower(F.lpad(F.hex(F.col(column_name)), 16, "0"))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text, in order."""
    parts = set(shingles(text, width))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts))
    return np.unique(hashes.view(np.int64))


def one_of_each(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without the near-duplicates: of each component the row with the smallest doc_id stays.

    Ties go to the smaller text hash, and a row without an id stays only where no other has one.  Rows that
    repeat doc_id and text are cut down to one.  All columns of docs are kept as they are.
    """
    return first_of_each(docs, groups(docs, width, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each root."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    rows = found.groupBy("root", order.alias("row")).agg(F.count("*").alias("copies"))
    best = rows.groupBy("root").agg(F.min(F.struct("row", "copies")).alias("best"))
    stays = written(
        best.select(F.col("best.row.d").alias("_doc"), F.col("best.row.t").alias("_text"), F.col("best.copies").alias("_copies")),
        "stays",
    )
    mark = free_name(docs, "_text_hash")
    known = docs.withColumn(mark, F.xxhash64(docs["text"], docs["text"].isNull()))
    same = known["doc_id"].eqNullSafe(stays["_doc"]) & (known[mark] == stays["_text"])
    once = known.join(stays.where("_copies = 1"), same, "left_semi")
    # written apart, as a rule empty: only these rows are sorted out by value
    repeated = written(stays.where("_copies > 1"), "repeated")
    same = known["doc_id"].eqNullSafe(repeated["_doc"]) & (known[mark] == repeated["_text"])
    again = known.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark])
    return once.union(again).drop(mark)
