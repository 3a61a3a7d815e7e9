"""Documents that hold a benchmark item, by SimHash over item-sized windows.

Every document position starts a window of each size on a ladder (steps of a fifth), and every item is
filed with its first and its last window of the largest ladder size that fits it.  Window fingerprints
slide: bit counts are differences of running sums, so a window costs the same whatever its size.

Fingerprints within RADIUS = 3 of 64 bits agree in one of four blocks of 16 bits, so all of them are found
through four equality keys.  An edited passage may still be similar enough while its fingerprint is further
off: an item is also cut into as many parts as such edits cannot all reach, and each part is filed with a
window of its own under its whole fingerprint, which an untouched part shares.

Tasks drop windows whose blocks and fingerprints do not occur among the items' of that size, by bit
tables whose size does not depend on the number of items.  What passes is joined to the items, and pairs
within the radius are verified: the item against the words in that place (as many as it has, one more or one
less, from there or a word beside), by weighted Jaccard similarity of five-word shingles, a shingle
weighing as often as it occurs.

Words are runs of letters, digits and other non-ASCII characters, A-Z lower-cased, so case, punctuation
and line breaks do not hide a passage.  Items shorter than a shingle are one shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, free_name, identified, pieces, texts_of, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
BLOCKS, BLOCK_BITS = 4, 16
#: number of the table for whole fingerprints, after the blocks', and how many leading bits it holds
WHOLE, VALUE_BITS = BLOCKS, 20
TABLES = BLOCKS + 1
BUCKET_BITS = 32_768  # of the bitmap functions
LARGEST = 30_000  # words of the largest window; longer items are filed with windows of this size
#: bytes of text, and words, hashed at once
BYTES_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 14

#: other bytes than letters, digits and parts of non-ASCII characters separate words
SEPARATED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
U = np.uint64


def ladder() -> list[int]:
    sizes = [1]
    while sizes[-1] * 6 // 5 <= LARGEST:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 6 // 5))
    return sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BYTES_AT_ONCE)
            steps = [np.full(size, b, dtype=U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_powers = _Powers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the first word of each text (and the end)."""
    raw = [t.encode("utf-8", "replace").translate(SEPARATED) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    up, down = _powers.to(len(data) + 1)
    letter = data != 32
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(data.astype(U) * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    offsets = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words; runs across the end of a text are the caller's to skip."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(n, dtype=U)
    for k in range(width):
        total += words[k : k + n] * U(pow(_BASE, 2 * k + 3, 1 << 64))
    return mixed(total)


def width_of(size: int) -> int:
    return min(SHINGLE, size)


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Row k holds, per bit, how many of the first k hashes have it set, modulo 2^16.

    Differences of rows fewer than 2^15 apart are exact.  Sums run inside blocks of 64 rows, all blocks at
    once, and then over the blocks.
    """
    n = len(hashes)
    bits = np.zeros((-(-n // 64) * 64, 64), dtype=np.uint16)
    bits[:n] = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    blocks = bits.reshape(-1, 64, 64)
    for k in range(1, 64):
        blocks[:, k] += blocks[:, k - 1]
    blocks[1:] += np.cumsum(blocks[:-1, -1], axis=0, dtype=np.uint16)[:, None, :]
    sums = np.zeros((n + 1, 64), dtype=np.uint16)
    sums[1:] = bits[:n]
    return sums


def window_prints(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first place, fingerprints) of every window of every size over words, in stretches."""
    for width in sorted({width_of(s) for s in sizes}):
        shingles = shingle_hashes(words, width)
        counts = {s: s - width + 1 for s in sizes if width_of(s) == width}
        reach = max(counts.values())
        for at in range(0, len(shingles), WORDS_AT_ONCE):
            part = shingles[at : at + WORDS_AT_ONCE + reach - 1]
            sums = running_bits(part)
            for size, m in counts.items():
                n = min(WORDS_AT_ONCE, len(part) - m + 1)
                if n > 0:
                    ones = (sums[m : m + n] - sums[:n]) > m // 2
                    yield size, at, np.packbits(ones.ravel()).view(">u8").astype(U)


def blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    """The four blocks of each fingerprint, the lowest bits first."""
    parts = prints.astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS)
    return [parts[:, b] for b in range(BLOCKS)]


def values_of(prints: np.ndarray, tables: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(table, value) of each fingerprint in each of the tables."""
    if any(t < BLOCKS for t in tables):
        blocks = blocks_of(prints)
        yield from ((t, blocks[t]) for t in tables if t < BLOCKS)
    if WHOLE in tables:
        yield WHOLE, (prints >> U(64 - VALUE_BITS)).astype(np.int64)


def key_of(size: int, table: int, values: np.ndarray) -> np.ndarray:
    return (size * TABLES + table) << VALUE_BITS | values.astype(np.int64)


def parts_needed(shingles: int, least: float) -> int:
    """Parts of an item that edits cannot all reach while the similarity stays at least `least`.

    Edits may take away at most k shingles.  One at either end takes one; any other that reaches another
    part takes SHINGLE.
    """
    k = int(shingles * (1 - least) / (1 + least) + 1e-9)
    return min(k, 2) + 1 + max(0, k - 2) // SHINGLE


def filed_items(benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key, print, item_id, anchor, n, hashes of the windows each item is filed with."""
    sizes = np.array(ladder())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, first = word_hashes(texts_of(batch))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                own = words[first[i] : first[i + 1]]
                n = len(own)
                if not n:
                    continue
                size = int(sizes[np.searchsorted(sizes, n, side="right") - 1])
                hashes = shingle_hashes(own, width_of(n)).view(np.int64)
                windows = [(size, a, list(range(BLOCKS))) for a in sorted({0, n - size})]
                parts = parts_needed(len(hashes), least)
                if parts > 1:
                    share = int(sizes[np.searchsorted(sizes, n // parts, side="right") - 1])
                    windows += [(share, n * k // parts, [WHOLE]) for k in range(parts)]
                for size, anchor, tables in windows:
                    (_, _, prints) = next(window_prints(own[anchor : anchor + size], [size]))
                    for t, values in values_of(prints, tables):
                        rows.append((i, int(key_of(size, t, values)[0]), int(prints.view(np.int64)[0]), anchor, n, hashes))
            names = ["key", "print", "item_id", "anchor", "n", "hashes"]
            if rows:
                at = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        column(batch, "item_id").take(at),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.array([r[4] for r in rows], pa.int32()),
                        pa.array([r[5] for r in rows], pa.list_(pa.int64())),
                    ],
                    names,
                )

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return items.mapInArrow(run, "key bigint, print bigint, item_id bigint, anchor int, n int, hashes array<bigint>")


def bit_tables(filed: DataFrame) -> dict[int, dict[int, bytes]]:
    """Per window size and table a bit per value that occurs: 8 KB a block and 128 KB for whole prints, 55 sizes at most."""
    value = F.col("key").bitwiseAND((1 << VALUE_BITS) - 1) + 1
    table = F.shiftright("key", VALUE_BITS)
    rows = filed.groupBy(table.alias("table"), F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")
    )
    found: dict[int, dict[int, list[bytes]]] = {}
    for r in rows.collect():
        size, table = divmod(r["table"], TABLES)
        buckets = (1 << (VALUE_BITS if table == WHOLE else BLOCK_BITS)) // BUCKET_BITS
        empty = bytes(BUCKET_BITS // 8)
        found.setdefault(size, {}).setdefault(table, [empty] * buckets)[r["bucket"] - 1] = bytes(r["bits"])
    return {size: {t: b"".join(buckets) for t, buckets in tables.items()} for size, tables in found.items()}


def asked_windows(docs: DataFrame, tables: dict[int, dict[int, bytes]]) -> DataFrame:
    """key, print, doc_id, text_hash, start of every window that shares a value with an item's of its size."""
    sizes = sorted(tables)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {
            s: {t: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").astype(bool) for t, b in sorted(own.items())}
            for s, own in shared.value.items()
        }
        for batch in pieces(batches):
            texts = texts_of(batch)
            at = 0
            while at < len(texts):
                # some texts at a time; a very long one alone
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BYTES_AT_ONCE):
                    held += len(texts[end])
                    end += 1
                words, first = word_hashes(texts[at:end])
                owner = np.repeat(np.arange(at, end), np.diff(first))
                last = np.repeat(first[1:], np.diff(first))
                begin = np.repeat(first[:-1], np.diff(first))
                found = []
                for size, place, prints in window_prints(words, sizes):
                    for t, values in values_of(prints, list(known[size])):
                        hit = np.flatnonzero(np.take(known[size][t], values))
                        where = place + hit
                        inside = where + size <= last[where]
                        hit, where = hit[inside], where[inside]
                        if len(hit):
                            found.append((key_of(size, t, values[hit]), prints[hit].view(np.int64), where))
                if found:
                    key, prints, where = (np.concatenate(x) for x in zip(*found, strict=True))
                    row = pa.array(owner[where], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key),
                            pa.array(prints),
                            column(batch, "doc_id").take(row),
                            column(batch, "text_hash").take(row),
                            pa.array((where - begin[where]).astype(np.int32)),
                        ],
                        ["key", "print", "doc_id", "text_hash", "start"],
                    )
                at = end

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "key bigint, print bigint, doc_id bigint, text_hash bigint, start int")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    left, right = Counter(a.tolist()), Counter(b.tolist())
    both = sum((left & right).values())
    return both / max(1, len(a) + len(b) - both)


def verified(docs: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start_word, item_words of the candidates that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out: list[tuple] = []
            for i, (text, asked) in enumerate(zip(texts_of(batch), column(batch, "asked").to_pylist(), strict=True)):
                words, _ = word_hashes([text])
                for c in asked:
                    own, n = np.array(c["hashes"], np.int64), c["n"]
                    alike, back = max(
                        (similarity(shingle_hashes(words[max(0, b) : max(0, b + m)], width_of(n)).view(np.int64), own), -max(0, b))
                        for b in (c["begin"] - 1, c["begin"], c["begin"] + 1)
                        for m in (n - 1, n, n + 1)
                    )
                    if alike >= least:
                        out.append((i, c["item_id"], alike, -back, n))
            names = ["doc_id", "text_hash", "item_id", "similarity", "start_word", "item_words"]
            if out:
                row = pa.array([o[0] for o in out], pa.int32())
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id").take(row),
                        column(batch, "text_hash").take(row),
                        *[pa.array([o[k + 1] for o in out], kind) for k, kind in enumerate(kinds)],
                    ],
                    names,
                )

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    asked = candidates.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).agg(
        F.collect_list(F.struct("item_id", "begin", "n", "hashes")).alias("asked")
    )
    asked = written(asked, "candidates")
    met = rows.join(asked, rows["doc_id"].eqNullSafe(asked["_doc"]) & (rows["text_hash"] == asked["_text"]))
    return met.select("doc_id", "text_hash", "text", "asked").mapInArrow(
        run, "doc_id bigint, text_hash bigint, item_id bigint, similarity double, start_word bigint, item_words bigint"
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start_word, item_words: one row per document and item it holds.

    Of several places the most similar one is told, then the first; words count from 0.  Rows of docs that
    repeat doc_id and text are one document.  Items that share an id are told as one; equal texts
    under several ids are told under each.  Null, empty and wordless texts, of documents or items, hold
    nothing and are in nothing.  Empty tables give an empty result.  Columns besides doc_id and text,
    and item_id and text, are not read.
    """
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee windows within {RADIUS} bits")
    filed = written(filed_items(benchmark, least), "items")
    asked = asked_windows(docs, bit_tables(filed))
    items = filed.withColumnRenamed("print", "item_print").withColumnRenamed("key", "item_key")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    pairs = asked.join(items, (F.col("key") == F.col("item_key")) & near)
    candidates = pairs.select("doc_id", "text_hash", "item_id", (F.col("start") - F.col("anchor")).alias("begin"), "n", "hashes")
    found = verified(docs, candidates.distinct(), least)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "item_words"))
    return (
        found.groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), "best.item_words")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, as they are."""
    leaks = written(contaminated(docs, benchmark, least).select("doc_id", "text_hash").distinct(), "leaks")
    leaks = leaks.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    mark = free_name(docs, "_text_hash")
    known = docs.withColumn(mark, F.xxhash64(docs["text"], docs["text"].isNull()))
    same = known["doc_id"].eqNullSafe(leaks["_doc"]) & (known[mark] == leaks["_text"])
    return known.join(leaks, same, "left_anti").drop(mark)
