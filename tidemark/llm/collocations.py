"""Collocations: phrases whose words come together more often than their parts tell.

Counting goes by size of phrase.  A phrase found `least` times has parts found as often, so a phrase is counted
only where both phrases one word shorter are frequent.  Which ones are, tasks learn from a bit table
of fixed size (SIEVE_BITS): a full table lets more phrases be counted, and never loses one.

The counts then are two streams, as in external estimation of language models.  In prefix order (language, words
from the first on) a phrase comes after all its beginnings and before all its extensions to the right, so one pass in
lockstep gives every phrase the counts of its beginnings and its most frequent right extension.  In suffix
order (words from the last on) a second pass adds the counts of its ends and its most frequent left extension.
No pass holds more than one phrase of each size, and neither looks anything up by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, pieces, texts_of, written
from tidemark.session import pinned

#: language of documents that state none
NO_LANGUAGE = "und"
#: bits of the table of frequent phrases (8 MB); a power of two
SIEVE_BITS = 1 << 26
SIEVE_PROBES = 2
#: bytes of text that are counted together inside a task, and counts handed on at once
BYTES_AT_ONCE = 8_000_000
ROWS_AT_ONCE = 20_000

#: marks the end of a piece; it never is a word, as pieces are cut at it
_CUT = b","
_PIECES = bytes.maketrans(b".;:!?\n\x0b\x0c\r\t", b"," * 9 + b" ")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their words before the last, and of the last."""
    mixed = (left ^ left >> np.uint64(31)) * _ODD[0] + right * _ODD[1]
    return (mixed ^ mixed >> np.uint64(29)) * _ODD[2]


def bits_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a table that stand for each hash."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [hashes * _ODD[p] >> shift for p in range(SIEVE_PROBES)]


def in_sieve(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for bit in bits_of(hashes, len(sieve) * 64):
        found &= (sieve[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def make_sieve(counts: DataFrame, bits: int) -> np.ndarray:
    """A bit table of the phrases (lang, phrase) of counts; of bits / 64 numbers, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(column(batch, "lang").to_pylist(), column(batch, "phrase").to_pylist(), strict=True):
                words = word_hashes(lang, phrase.encode().split(b" "))
                whole = words[:1]
                for i in range(1, len(words)):
                    whole = chained(whole, words[i : i + 1])
                hashes.append(whole)
            all_bits = np.concatenate(bits_of(np.concatenate(hashes), bits)) if hashes else np.empty(0, np.uint64)
            slots = (all_bits >> np.uint64(6)).astype(np.int64)
            masks = (np.uint64(1) << (all_bits & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(masks)], ["slot", "mask"])

    marks = counts.select("lang", "phrase").mapInArrow(run, "slot bigint, mask bigint")
    found = marks.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    sieve = np.zeros(bits // 64, dtype=np.uint64)
    sieve[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return sieve


def stretches(texts: Iterator[tuple[str, bytes]], longest: int, at_once: int) -> Iterator[tuple[str, pa.DictionaryArray, int]]:
    """(language, words, skip): words of texts joined up to a limit; a longer text is cut.

    Phrases that end within the first `skip` words belong to the stretch before, whose last words those are.
    """
    held: dict[str, list[bytes]] = {}
    size = 0
    for lang, text in texts:
        data = text.lower().translate(_PIECES)
        if len(data) <= at_once:
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size > at_once:
                for of in list(held):
                    yield of, words_of(_CUT.join(held.pop(of))), 0
                size = 0
            continue
        at, before = 0, []
        while at < len(data):
            end = data.find(b" ", at + at_once)
            end = len(data) if end < 0 else end
            words = words_of(b" ".join([*before, data[at:end]]))
            yield lang, words, len(before)
            before = [w.as_py() for w in words[max(len(words) - longest + 1, 0) :]] if longest > 1 else []
            at = end
    for of in list(held):
        yield of, words_of(_CUT.join(held.pop(of))), 0


def words_of(data: bytes) -> pa.DictionaryArray:
    """Words and cuts in order, each distinct one stored once."""
    spaced = pa.array([data.replace(_CUT, b" , ")], pa.large_binary()).view(pa.large_string())
    words = pc.ascii_split_whitespace(spaced).values.dictionary_encode()
    codes, vocabulary = words.indices, words.dictionary.cast(pa.large_binary())
    # spaces at the ends leave empty strings
    empty = pc.index(vocabulary, pa.scalar(b"", pa.large_binary())).as_py()
    if empty >= 0:
        codes = codes.filter(pc.not_equal(codes, empty))
    return pa.DictionaryArray.from_arrays(codes, vocabulary)


def phrases_of(
    lang: str, words: pa.DictionaryArray, skip: int, size: int, sieve: np.ndarray | None
) -> tuple[pa.Array, np.ndarray]:
    """Phrases of `size` words and their counts; only those whose parts the sieve holds, if one is given."""
    codes, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
    places = len(codes) - size + 1
    if places <= 0:
        return pa.array([], pa.large_binary()), np.empty(0, np.int64)
    fine = pc.not_equal(vocabulary, pa.scalar(_CUT, pa.large_binary())).to_numpy(zero_copy_only=False)
    if sieve is not None:
        hashes = word_hashes(lang, vocabulary.to_pylist())
        if size == 2:
            fine &= in_sieve(sieve, hashes)
    fine = fine[codes]
    fits = np.ones(places, dtype=bool)
    fits[: max(skip - size + 1, 0)] = False
    for i in range(size):
        fits &= fine[i : i + places]
    at = np.flatnonzero(fits)
    if sieve is not None and size > 2:
        for start in (0, 1):
            part = hashes[codes[at + start]]
            for i in range(1, size - 1):
                part = chained(part, hashes[codes[at + start + i]])
            at = at[in_sieve(sieve, part)]
    many = max(len(vocabulary), 1)
    if many**size < 1 << 63:
        mixed = codes[at]
        for i in range(1, size):
            mixed = mixed * many + codes[at + i]
        mixed.sort()
        first = np.flatnonzero(np.diff(mixed, prepend=-1))
        counts = np.diff(first, append=len(mixed))
        rest, found = mixed[first], []
        for _ in range(size):
            rest, last = np.divmod(rest, many)
            found.append(last)
        found.reverse()
    else:
        mixed = codes[at]
        for i in range(1, size):
            _, mixed = np.unique(mixed * many + codes[at + i], return_inverse=True)
        _, first, counts = np.unique(mixed, return_index=True, return_counts=True)
        found = [codes[at[first] + i] for i in range(size)]
    parts = [vocabulary.take(pa.array(f)) for f in found]
    return (parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))), counts


def phrase_counts(
    docs: DataFrame, size: int, sieve: np.ndarray | None = None, longest: int = 3, at_once: int = BYTES_AT_ONCE
) -> DataFrame:
    """lang, phrase, f of the phrases of `size` words; one more row per language, with a null phrase, counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[str, bytes]]:
            for batch in pieces(batches):
                for lang, text in zip(column(batch, "lang").to_pylist(), texts_of(batch), strict=True):
                    yield lang, text.encode("utf-8", "replace")

        for lang, words, skip in stretches(texts(), longest, at_once):
            phrases, counts = phrases_of(lang, words, skip, size, sieve)
            if size == 1:
                phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.large_binary())])
                counts = np.append(counts, counts.sum())
            for at in range(0, len(counts), ROWS_AT_ONCE):
                some, n = phrases[at : at + ROWS_AT_ONCE], counts[at : at + ROWS_AT_ONCE].astype(np.int64)
                langs = pa.DictionaryArray.from_arrays(np.zeros(len(n), np.int32), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, some.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["lang", "phrase", "f"])

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    counted = rows.mapInArrow(run, "lang string, phrase string, f bigint")
    # most phrases are rare: tables of them in front of the shuffle fill the heap and add up little that tasks have not
    return counted.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Chain:
    """The phrases a stream is inside of, one of each size."""

    def __init__(self, given: tuple | None) -> None:
        #: lang, word, count, most frequent extension, row
        self.links: list[list] = []
        if given:
            self.links.append([*given, 0, None])

    def closed(self, depth: int) -> Iterator[list]:
        """Phrases of more than depth words, which nothing more can extend."""
        while len(self.links) > depth:
            yield self.links.pop()

    def take(self, lang: str, words: list[str], f: int, row: tuple) -> Iterator[list]:
        if self.links and self.links[0][0] != lang:
            yield from self.closed(0)
        same = 0
        while same < min(len(self.links), len(words) - 1) and self.links[same][1] == words[same]:
            same += 1
        yield from self.closed(same)
        if len(self.links) != len(words) - 1:
            raise ValueError(f"the stream lacks a part of {' '.join(words)!r}")
        if self.links:
            self.links[-1][3] = max(self.links[-1][3], f)
        self.links.append([lang, words[-1], f, 0, (row, [x[2] for x in self.links])])


_STREAM = "lang string, phrase string, f bigint, left array<bigint>, right array<bigint>, extended bigint"


def in_lockstep(rows: DataFrame, longest: int, suffix: bool) -> DataFrame:
    """rows (see _STREAM) with the counts of all their beginnings in `left`, or of all their ends in `right`, shortest
    first, and in `extended` the count of the most frequent phrase one word longer, so far."""
    split = F.split("phrase", " ")
    ordered = rows.withColumn("words", F.reverse(split) if suffix else split)
    keys = [F.get("words", F.lit(i)).alias(f"_k{i}") for i in range(longest)]
    names = ["lang", *[f"_k{i}" for i in range(longest)]]
    # extensions of two words stay with them; of single words, each range is told the last one before it
    ranged = pinned(
        ordered.select("*", *keys).repartitionByRange(*names[:3]).sortWithinPartitions(*names)
        .withColumn("part", F.spark_partition_id()).drop(*names[2:])
    )
    last = ranged.where(F.size("words") == 1).groupBy("part").agg(F.max(F.struct("lang", "_k0", "f")).alias("x")).collect()
    lasts = sorted((r.part, (r.x.lang, r.x["_k0"], r.x.f)) for r in last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for batch in batches:
            out: list[list] = []
            for r in batch.to_pylist():
                if chain is None:
                    earlier = [x for part, x in lasts if part < r["part"]]
                    chain = Chain(earlier[-1] if earlier else None)
                out.extend(chain.take(r["lang"], r["words"], r["f"], (r["phrase"], r["left"], r["right"], r["extended"])))
            yield _emitted(out, suffix)
        if chain is not None:
            yield _emitted(list(chain.closed(0)), suffix)

    return ranged.select("lang", "phrase", "f", "left", "right", "extended", "words", "part").mapInArrow(run, _STREAM)


def _emitted(links: list[list], suffix: bool) -> pa.RecordBatch:
    rows = [(lang, f, extended, *info) for lang, _, f, extended, info in links if info]
    given = [r[3] for r in rows]
    own, ints = [r[4] for r in rows], pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([g[0] for g in given], pa.string()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([g[1] for g in given] if suffix else own, ints),
            pa.array(own if suffix else [g[2] for g in given], ints),
            pa.array([max(r[2], g[3]) for r, g in zip(rows, given, strict=True)], pa.int64()),
        ],
        ["lang", "phrase", "f", "left", "right", "extended"],
    )


_SCORED = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def scored(rows: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one covers; Python's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, left, right = r["f"], r["left"], r["right"]
                if not left or 100 * r["extended"] >= share * a:
                    continue
                cuts = [(1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(zip(left, reversed(right), strict=True))]
                score, _, x, y = min(cuts)
                out.append((r["lang"], r["phrase"], a, x, y, score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names)

    _names = ["lang", "phrase", "a", "l", "r", "score"]
    return rows.mapInArrow(run, _SCORED)


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    first: int | None = 2000,
    bits: int = SIEVE_BITS,
    at_once: int = BYTES_AT_ONCE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    a is how often the phrase occurs, all places counted; cutting it after k words leaves parts with counts l and r and the
    score floor(10^6 a a / (l r)).  The lowest-scoring cut speaks for the phrase, the earliest of equal ones.
    Phrases found fewer than `least` times are out, and so are those inside a longer one that is
    found `least` times and in `share` percent of their places.  n counts the language's words.  rank goes by score
    and a, falling, then by the phrase's bytes; `first` is the last rank returned (None: all).

    Words are what spaces and tabs separate, A-Z lower-cased; phrases end at any of . , ; : ! ? and line ends (U+000A to
    U+000D).  A null language is 'und'; null and empty texts hold no words; repeated rows count each time, as their
    texts do; doc_id is not read and may be null.  An empty table gives no rows.
    Columns besides text and lang are not read.
    """
    sieve, levels, totals = None, [], None
    for size in range(1, longest + 1):
        counts = phrase_counts(docs, size, sieve, longest, at_once)
        wanted = (F.col("f") >= least) | F.col("phrase").isNull()
        found = written(counts.where(wanted), f"phrases-{size}")
        if size == 1:
            totals = found.where("phrase is null").select("lang", F.col("f").alias("n"))
            found = found.where("phrase is not null")
        levels.append(found)
        if size < longest:
            sieve = make_sieve(found, bits)
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    none = F.array().cast("array<bigint>")
    rows = rows.select("lang", "phrase", "f", none.alias("left"), none.alias("right"), F.lit(0).cast("bigint").alias("extended"))
    both = in_lockstep(in_lockstep(rows, longest, suffix=False), longest, suffix=True)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = written(scored(both, share), "scored").withColumn("rank", F.row_number().over(best).cast("bigint"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
