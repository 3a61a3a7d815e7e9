"""Lines that many documents share, found by a range-partitioned stream, returned as keep bitmaps.

Line hashes are range-partitioned on (hash, document) and sorted by (hash, document, position), so a line
that fills a third of the table is spread over many tasks.  Each task streams its range once, holding
no more than the rows of the first documents of one line.  A line may begin in one range and end in
another; such lines, at most two per range, report a count per range, and their totals decide.

What comes out is, per document that loses lines, a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, free_name, identified, pieces, replaced, texts_of, written

LINES = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, pos int, n_lines int"
ROWS = LINES + ", kind int, n_docs bigint, part int"
#: kinds of streamed rows
DROP, UNDECIDED, FIRST, RANGE_COUNT = range(4)


def line_key(line: bytes) -> bytes:
    """A line without white space at both ends, A-Z lower-cased.  bytes methods touch ASCII only."""
    return line.strip().lower()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has at least min_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            halves, row, pos, totals = [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                lines = text.encode("utf-8", "replace").split(b"\n")
                totals.append(len(lines))
                for p, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                        halves.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        pos.append(p)
            if not row:
                continue
            hashes = np.frombuffer(b"".join(halves), dtype="<i8").reshape(-1, 2)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(hashes[:, 0])),
                    pa.array(np.ascontiguousarray(hashes[:, 1])),
                    column(batch, "doc_id").take(at),
                    column(batch, "text_hash").take(at),
                    pa.array(pos, pa.int32()),
                    pa.array(totals, pa.int32()).take(at),
                ],
                ["h1", "h2", "doc_id", "text_hash", "pos", "n_lines"],
            )

    rows = identified(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_hash", "text")
    return rows.mapInArrow(run, LINES)


class RangeStream:
    """Walks one sorted range and tells which lines' rows go.

    A line's rows are held back until enough documents have been seen; then they, and all that
    follow, go out at once.  Only the held-back rows and the state of one line are kept.
    """

    def __init__(self, part: int, min_docs: int, keep_first: bool):
        self.part, self.min_docs, self.keep_first = part, min_docs, keep_first
        self.held: pa.Table | None = None
        self.seen_docs = 0  # documents of the current line whose rows have gone out already
        self.last_doc: tuple | None = None
        self.is_first_line = True

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([batch])
        if self.held is not None:
            rows = pa.concat_tables([self.held, rows]).combine_chunks()
        yield from self._walk(rows, ended=False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            yield from self._walk(self.held, ended=True)

    def _walk(self, rows: pa.Table, ended: bool) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if not n:
            return
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        doc, text = rows.column("doc_id"), rows.column("text_hash").to_numpy()
        no_id = doc.is_null().to_numpy()
        doc = doc.fill_null(0).to_numpy()
        new_line = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_line.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (no_id[1:] != no_id[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new_line)
        sizes = np.diff(np.r_[starts, n])
        # rows that follow released rows of the same line: count on from there, their first row is none
        continued = self.last_doc is not None and self.last_doc[:2] == (h1[0], h2[0])
        if self.last_doc is not None and not continued:
            yield from self._closed()
        docs = np.add.reduceat(new_doc, starts).astype(np.int64)
        if continued:
            docs[0] += self.seen_docs - int(self.last_doc[2:] == (no_id[0], doc[0], text[0]))
        full = docs >= self.min_docs
        edge = np.zeros(len(starts), dtype=bool)
        edge[0] = self.is_first_line
        edge[-1] |= ended
        first = new_line.copy()
        first[0] = not continued
        kind = np.full(n, -1)
        goes = np.repeat(full, sizes)
        unsure = np.repeat(edge & ~full, sizes)
        open_tail = 0 if ended else int(sizes[-1])
        if not ended and not full[-1]:
            goes[n - open_tail :] = unsure[n - open_tail :] = False
        kind[goes] = DROP
        kind[unsure] = UNDECIDED
        if self.keep_first:
            # the first row stays; in the first line of a range it may be a later one of the whole line
            kind[first & goes] = -1
            at_edge = np.repeat(edge, sizes)
            kind[first & at_edge & (goes | unsure)] = FIRST
        yield from self._rows(rows, kind)
        counted = edge.copy()
        if not ended:
            counted[-1] = False
        yield from self._counts(h1[starts[counted]], h2[starts[counted]], docs[counted])
        if ended:
            self.held = None
            return
        # the last line may go on
        if len(starts) > 1:
            self.is_first_line = False
        if full[-1]:
            self.held = None
            self.seen_docs = int(docs[-1])
            self.last_doc = (h1[-1], h2[-1], no_id[-1], doc[-1], text[-1])
        else:
            self.held, self.last_doc, self.seen_docs = rows.slice(n - open_tail), None, 0

    def _closed(self) -> Iterator[pa.RecordBatch]:
        """The released line has ended; as the first line of the range it reports its count."""
        if self.is_first_line:
            yield from self._counts(np.array([self.last_doc[0]]), np.array([self.last_doc[1]]), np.array([self.seen_docs]))
            self.is_first_line = False
        self.last_doc, self.seen_docs = None, 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """End of the range: its last line reports a count too."""
        if self.last_doc is not None:
            yield from self._counts(np.array([self.last_doc[0]]), np.array([self.last_doc[1]]), np.array([self.seen_docs]))
        else:
            yield from self.finish()

    def _rows(self, rows: pa.Table, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(kind >= 0)
        if len(at):
            out = rows.take(pa.array(at)).combine_chunks().to_batches()[0]
            n = out.num_rows
            extra = [pa.array(kind[at].astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(np.full(n, self.part, np.int32))]
            yield pa.RecordBatch.from_arrays([*out.columns, *extra], [*out.schema.names, "kind", "n_docs", "part"])

    def _counts(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(h1)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1, pa.int64()),
                    pa.array(h2, pa.int64()),
                    *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())],
                    pa.array(np.full(n, RANGE_COUNT, np.int32)),
                    pa.array(docs, pa.int64()),
                    pa.array(np.full(n, self.part, np.int32)),
                ],
                ["h1", "h2", "doc_id", "text_hash", "pos", "n_lines", "kind", "n_docs", "part"],
            )


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, pos, n_lines of every line that goes."""
    # written first: the range cut samples its input, and texts should be split into lines once
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    order = ["h1", "h2", "doc_id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = RangeStream(TaskContext.get().partitionId(), min_docs, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from stream.feed(batch)
        yield from stream.close()

    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    rows = written(ranges.mapInArrow(run, ROWS), "line-runs")
    # lines at the edges of ranges: at most two per range
    edges = (
        rows.where(F.col("kind") == RANGE_COUNT)
        .groupBy(F.col("h1").alias("e1"), F.col("h2").alias("e2"))
        .agg(F.sum("n_docs").alias("docs"), F.min("part").alias("first_part"))
        .where(F.col("docs") >= min_docs)
    )
    sure = rows.where(F.col("kind") == DROP)
    open_rows = rows.where(F.col("kind").isin(UNDECIDED, FIRST)).join(
        edges, (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    )
    late = open_rows.where((F.col("kind") == UNDECIDED) | (F.col("part") > F.col("first_part")))
    wanted = ["doc_id", "text_hash", "pos", "n_lines"]
    return sure.select(*wanted).union(late.select(*wanted))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep_bitmap of every document that loses a line.

    A line goes if its key (white space stripped at both ends, A-Z lower-cased) has at least min_chars code
    points and stands in at least min_docs documents: from all documents, or with keep_first from
    all places but the first by (doc_id, text_hash, position).  The bitmap is zlib-compressed, one
    bit per line, most significant first, 1 for a line that stays.

    Documents are told apart by doc_id and text, so copies of a row count once.  A null or empty text is
    one empty line, which never goes for min_chars >= 1.  Null ids sort first and are ids like others.
    An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            maps = []
            for n, gone in zip(column(batch, "n_lines").to_pylist(), column(batch, "gone").to_pylist(), strict=True):
                keep = np.ones(n, dtype=np.uint8)
                keep[gone] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            names = ["doc_id", "text_hash", "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in names], pa.array(maps, pa.binary())], [*names, "keep_bitmap"]
            )

    per_doc = (
        dropped_lines(docs, min_docs, min_chars, keep_first)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("gone"), F.max("n_lines").cast("bigint").alias("n_lines"))
        .withColumn("n_dropped", F.size("gone").cast("bigint"))
    )
    return per_doc.mapInArrow(run, "doc_id bigint, text_hash bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join(line for line, k in zip(lines, keep.tolist(), strict=True) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, dropped: str | None = None) -> DataFrame:
    """docs with the lines cut that bitmaps drop; every row and column stays.

    Rows without a bitmap keep their text as it is, null texts included.  dropped names a column to add
    that counts the lines cut.
    """
    bitmap, count = free_name(docs, "_keep_bitmap"), free_name(docs, dropped or "_n_dropped")
    mine, theirs = free_name(docs, "_text_hash"), bitmaps.select(
        F.col("doc_id").alias("_b_doc"),
        F.col("text_hash").alias("_b_hash"),
        F.col("keep_bitmap").alias(bitmap),
        F.col("n_dropped").alias(count),
    )
    known = docs.withColumn(mine, F.xxhash64(docs["text"], docs["text"].isNull()))
    joined = known.join(theirs, known["doc_id"].eqNullSafe(theirs["_b_doc"]) & (known[mine] == theirs["_b_hash"]), "left")
    rows = joined.select(*[known[c] for c in docs.columns], F.coalesce(theirs[count], F.lit(0)).alias(count), theirs[bitmap])
    schema = rows.drop(bitmap).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            maps, texts = column(batch, bitmap).to_pylist(), column(batch, "text").to_pylist()
            cut = [t if m is None else kept_lines(t or "", m) for t, m in zip(texts, maps, strict=True)]
            out = replaced(batch, "text", pa.array(cut, pa.string()))
            yield out.drop_columns([bitmap])

    cut = rows.mapInArrow(run, schema)
    return cut if dropped else cut.drop(count)
