"""Packing of token sequences into bins by length patterns, fitted by non-negative least squares.

Only the histogram of piece lengths, at most `size` numbers, comes to the driver.  There, patterns of two
and three lengths that fill a sequence to the last token are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded down to what the histogram holds, and
what is left over goes best-fit decreasing, many equal pieces at a time.  The outcome is a list
of slots: the pieces of one length, numbered from r on, go to sequences from s on at an offset.  Spark
numbers the pieces of each length and every task looks its own up in the slots.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, pieces, texts_of, written
from tidemark.operators.scale import running_before

#: last character both libraries are tested to treat alike
FAST_UP_TO = "\u024f"
FIT_ROUNDS = 400
#: parts of the fitted counts that are tried; the plan with the fewest sequences is taken
SHARES = (1.0, 0.5, 0.0)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids of texts as bytes (little-endian unsigned 32 bit).

    The vocabulary is given twice: as a tokenizer file, and the same as ranks of byte strings, which is
    several times as fast to apply.  Both split texts by one pattern but by Unicode tables of their own, so
    texts with characters past FAST_UP_TO, or with a special token's string, take the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=merged, special_tokens={})
        self.beyond = re.compile(f"[^\0-{FAST_UP_TO}]")

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.beyond.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


@cache
def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(vocabulary, ranks, pattern)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, with what is over in front."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, vocabulary: tuple[str, str, str], end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of docs."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                ids = encoder(*vocabulary).encode(text) + end
                for p, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    row.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pa.array(row, pa.int32())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def full_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of lengths, longest first and padded with 0, that add up to size: pairs and triples of present lengths."""
    has = np.zeros(size + 1, dtype=bool)
    has[present] = True
    found = []
    for a in range(size - 1, 0, -1):
        if not has[a]:
            continue
        rest = size - a
        b = np.arange(min(a, rest), 0, -1)
        c = rest - b
        good = has[b] & (c <= b) & ((c == 0) | has[c])
        found.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A's columns being the patterns' length counts.

    Projected gradient steps with momentum; A has at most three entries in a column, so it is used
    through the patterns themselves.
    """
    flat = patterns.ravel()
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    used = np.bincount(flat, minlength=len(histogram)).astype(float)
    used[0] = 0
    step = 1.0 / (3.0 * used.max())  # 1 / (bound of A's largest squared singular value)
    weight = np.ones(len(histogram))
    weight[0] = 0
    y, t = x, 1.0
    for _ in range(FIT_ROUNDS):
        made = np.bincount(flat, weights=np.repeat(y, patterns.shape[1]), minlength=len(histogram))
        short = (made - histogram) * weight
        after = np.maximum(0.0, y - step * short[patterns].sum(axis=1))
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / ahead * (after - x)
        x, t = after, ahead
    return x


class Plan:
    """Slots: pieces first..first+n-1 of a length go to sequences base.., `times` to a sequence, from an offset on."""

    def __init__(self, histogram: np.ndarray, size: int):
        self.size, self.left = size, histogram.astype(np.int64).copy()
        self.next_piece = np.zeros_like(self.left)
        self.sequences = 0
        self.slots: list[tuple[int, int, int, int, int]] = []

    def place(self, lengths: list[int], count: int) -> None:
        """`count` sequences of the given lengths."""
        if count <= 0:
            return
        offset = 0
        for n in lengths:
            self._fill(n, count, self.sequences, offset)
            offset += n
        self.sequences += count

    def _fill(self, length: int, count: int, base: int, offset: int) -> None:
        self.slots.append((length, int(self.next_piece[length]), count, base, offset))
        self.next_piece[length] += count
        self.left[length] -= count

    def most(self, lengths: np.ndarray) -> int:
        """How many sequences of the given lengths the pieces that are left allow."""
        values, times = np.unique(lengths, return_counts=True)
        return int((self.left[values] // times).min())

    def best_fit(self) -> None:
        """What is left, longest first, into the fullest sequences that have room, runs of equal pieces at once."""
        rooms: list[list[tuple[int, int]]] = [[] for _ in range(self.size + 1)]  # by room: (first sequence, count)
        for length in range(self.size, 0, -1):
            room = length
            while self.left[length] > 0:
                while room <= self.size and not rooms[room]:
                    room += 1
                if room > self.size:
                    # new sequences, each filled as far as pieces of this length go
                    each = self.size // length
                    whole, rest = divmod(int(self.left[length]), each)
                    for count, times in ((whole, each), (min(rest, 1), rest)):
                        if count:
                            base = self.sequences
                            self.place([length] * times, count)
                            rooms[self.size - length * times].append((base, count))
                    break
                base, count = rooms[room].pop()
                here = min(count, int(self.left[length]))
                if count > here:
                    rooms[room].append((base + here, count - here))
                self._fill(length, here, base, self.size - room)
                rooms[room - length].append((base, here))
                room = length  # the room just made may be the tightest now


    def lookup(self) -> np.ndarray:
        """The slots by length and first piece: columns length, first, sequence, offset."""
        found = np.array([(n, first, base, offset) for n, first, _, base, offset in self.slots], dtype=np.int64).reshape(-1, 4)
        return found[np.lexsort((found[:, 1], found[:, 0]))]

    @staticmethod
    def find(slots: np.ndarray, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the nth pieces of the given lengths: the last slot that begins at or before them."""
        at = np.zeros(len(length), dtype=np.int64)
        for n in np.unique(length):
            low, high = np.searchsorted(slots[:, 0], [n, n + 1])
            mine = length == n
            at[mine] = low + np.searchsorted(slots[low:high, 1], nth[mine], side="right") - 1
        return slots[at, 2] + nth - slots[at, 1], slots[at, 3]


def pack(histogram: np.ndarray, size: int) -> Plan:
    """A plan for histogram[n] pieces of each length n (histogram[0] unused)."""
    rest = histogram.copy()
    rest[size] = 0
    patterns = full_patterns(np.flatnonzero(rest[1:]) + 1, size)
    counts = fit_counts(patterns, rest.astype(float))
    order = np.argsort(-counts, kind="stable")
    plans = []
    for share in SHARES:
        plan = Plan(histogram, size)
        plan.place([size], int(plan.left[size]))
        for i in order:
            if share * counts[i] < 1:
                break
            lengths = patterns[i][patterns[i] > 0]
            plan.place(lengths.tolist(), min(int(share * counts[i]), plan.most(lengths)))
        plan.best_fit()
        plans.append(plan)
    return min(plans, key=lambda p: p.sequences)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _nth, 0-based within each length.  Pieces equal in all columns may swap numbers: nothing else can."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    return running_before(rows, ["length"], order, {"_nth": F.lit(1).cast("bigint")})


def pack_documents(
    docs: DataFrame, vocabulary: tuple[str, str, str], end_id: int = 2, size: int = 1024
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs.

    A document is its text's ids (a null text is empty) and end_id.  Longer ones than size are cut into
    pieces of size ids; what is over is the first piece.  Sequences hold at most size ids and are
    filled from 0 without gaps.  Rows that repeat a doc_id are documents of their own; an empty
    table gives an empty result; columns besides doc_id and text are not read.  vocabulary: the paths
    of a tokenizer file and of its rank file, and the pattern that splits texts before merges.
    """
    spark = docs.sparkSession
    rows = written(token_pieces(docs, vocabulary, end_id, size), "pieces")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `size` rows
        histogram[r["length"]] = r["count"]
    plan = pack(histogram, size)
    # at most three slots a pattern, size^2 / 12 patterns, and a few per length from the best fit
    slots = spark.sparkContext.broadcast(plan.lookup())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (column(batch, c).to_numpy() for c in ("length", "_nth"))
            sequence, offset = Plan.find(slots.value, length, nth)
            names = [c for c in batch.schema.names if c != "_nth"]
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return numbered(rows).mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")
