"""Near-duplicates by chosen-path set similarity join.

A document is the set of its word shingles, and has COORDINATES minwise tokens, each the smallest of its shingles
under a hash of its own.  Two sets agree in a coordinate with a chance of their Jaccard similarity, so a tree that
sends a set down by coordinates keeps similar sets together: every node chooses one coordinate, sometimes a second,
by its own path, and its sets go on to one child for each value there.  A pair of sets at the threshold then has on average
one child or more in common for every node they share, while other sets fall apart.  Small nodes
are compared exhaustively, larger ones branch again, and independent trees are grown side by side, level by level.

Groups, not pairs, are wanted, so a node whose sets are all in one group already is settled and leaves its tree.  Trees start
some branchings below their roots, where sets that are like no other are alone.  First each set is compared with the one it
meets most often of those that come first in its nodes, and in larger nodes with three likely ones of a few at random, which
settles a large group of near copies at the cost of its size.  Of what is left open a node is small if few of its sets
are outside its largest group: those are compared with all others, and sets of one group are not.  A comparison looks at
sketches of the sets first, then at the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bit_table, column, discard, identified, in_bit_table, pieces, texts_of, written
from tidemark.llm.graph import star_edges
from tidemark.llm.near_dups import SEED, shingle_set

#: minwise tokens of a set
COORDINATES = 64
#: a sketch splits the shingles into BINS by their hashes and keeps a number of PLANES bits of the smallest one in each
BINS, PLANES = 512, 4
#: shingles hashed at once
SHINGLES_AT_ONCE = 8192
#: how many numbers there are
MARKS = (1 << PLANES) - 1
#: sets of a node that are compared in one block
BLOCK = 4096
#: sets of a larger node that are compared with each other at random, before all outside its largest group are compared
PARTNERS = 16
#: pairs whose sketches, and pairs whose nodes are compared at once
PAIRS_AT_ONCE, NODES_AT_ONCE = 16384, 512
#: a pair at the threshold is hidden by its sketches if they are so many standard deviations off, one in 100,000
DEVIATIONS = 4.3


@dataclass(frozen=True)
class Forest:
    """Shape of the search.  At a threshold of t a pair that is t similar is missed by a tree that is d levels deep with
    a chance of q(d) = (1 - t + t q(d - 1)) ** c, c children chosen; all trees together miss it with q ** trees."""

    trees: int = 10
    #: a node is compared exhaustively if so few of its sets are outside its largest group
    small: int = 1000
    #: levels whose nodes choose two coordinates; below, the second one is chosen for a share of the nodes
    broad: int = 3
    #: branchings before nodes are looked at for the first time
    first: int = 2

    def missed(self, threshold: float, levels: int) -> float:
        """Chance that no tree brings a pair at the threshold together, if its nodes branch `levels` times after the root."""
        lost = 0.0
        for level in range(levels, 0, -1):
            one = 1 - threshold + threshold * lost
            lost = one * one if level <= self.broad else one * (1 - self.second(threshold)) + one * one * self.second(threshold)
        return (1 - threshold + threshold * lost) ** self.trees

    @staticmethod
    def second(threshold: float) -> float:
        """Share of deeper nodes that choose a second coordinate: children a pair shares then average one."""
        return min(1 / threshold - 1, 1.0)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def minwise(hashes: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper halves of the smallest hash of every coordinate."""
    odd, offset = multipliers
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[at : at + SHINGLES_AT_ONCE].view(np.uint64)
        np.minimum(low, (np.multiply.outer(odd, some) + offset[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A number from 1 to 15 for a bin, zero for an empty one; hashes are in order.

    Of every 64 bins there is one word for each bit of their numbers.
    """
    bins = (hashes.view(np.uint64) >> np.uint64(65 - BINS.bit_length())).astype(np.int64) ^ BINS // 2
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    marks = np.zeros(BINS, dtype=np.uint64)
    marks[bins[first]] = hashes[first].view(np.uint64) % np.uint64(MARKS) + np.uint64(1)
    planes = marks >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), axis=1).reshape(PLANES, -1, 8).transpose(1, 0, 2).copy().view(np.int64).ravel()


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        rows = hashes[at : at + SHINGLES_AT_ONCE].astype(">i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


_SIGNED = "doc_id bigint, text_hash bigint, node bigint, n bigint, print bigint, tokens array<int>, " + ", ".join(
    f"s{i} bigint" for i in range(BINS * PLANES // 64)
)
SKETCH = tuple(f"s{i}" for i in range(BINS * PLANES // 64))


def node_of(hashes: np.ndarray) -> int | None:
    """A number for a set; null for an empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else None


def signed(docs: DataFrame, width: int, prints: bool) -> DataFrame:
    """doc_id, text_hash, node (a hash of the shingle set, null for an empty one), n (its size), print (its SimHash, if
    asked for), tokens and sketch of every row."""
    multipliers = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(t, width) for t in texts_of(batch)]
            nodes = [node_of(s) for s in sets]
            tokens = [minwise(s, multipliers) if len(s) else None for s in sets]
            marks = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), column(batch, "text_hash"), pa.array(nodes, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([majority(s) if prints and len(s) else None for s in sets], pa.int64()),
                    pa.array(tokens, pa.list_(pa.int32())),
                    *[pa.array(marks[:, i]) for i in range(len(SKETCH))],
                ],
                ["doc_id", "text_hash", "node", "n", "print", "tokens", *SKETCH],
            )

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, _SIGNED)


def full_sets(docs: DataFrame, table: np.ndarray, width: int) -> DataFrame:
    """id, hashes of the sets of the rows whose hash of doc_id and text_hash is in a bit table, and perhaps of a few others.

    Tasks tell by the table, of fixed size, which texts to read, so texts are not shuffled; as it fills up, more are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces([whole.filter(pa.array(in_bit_table(table, column(whole, "key").to_numpy())))]):
                sets = [shingle_set(t, width) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"]
                )

    rows = identified(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.select(F.xxhash64("doc_id", "text_hash").alias("key"), "text")
    # rows that repeat a document give its set again
    return rows.mapInArrow(run, "id bigint, hashes array<bigint>").where("id is not null").dropDuplicates(["id"])


def agreement(left: str, right: str) -> tuple[Column, Column]:
    """(bins that agree, bins that are not empty in both) of two sketches, in columns <left>s0 ... and <right>s0 ..."""
    differ, used = F.lit(0), F.lit(0)
    for at in range(0, len(SKETCH), PLANES):
        other, any_bit = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for s in SKETCH[at : at + PLANES]:
            other = other.bitwiseOR(F.col(left + s).bitwiseXOR(F.col(right + s)))
            any_bit = any_bit.bitwiseOR(F.col(left + s)).bitwiseOR(F.col(right + s))
        differ, used = differ + F.bit_count(other), used + F.bit_count(any_bit)
    return used - differ, used


def likely(agree: np.ndarray, used: np.ndarray, sizes: np.ndarray, others: np.ndarray, share: float) -> np.ndarray:
    """What Join._likely() says, but for the sizes."""
    chance = 1 / MARKS
    drawn = (1 - chance) ** 2 * share * (1 - share) * np.maximum(1 - used * (1 + share) / (sizes + others), 0)
    spread = np.sqrt(used * (drawn + (1 - share) * chance * (1 - chance)))
    return agree + 1 >= (share + (1 - share) * chance) * used - DEVIATIONS * spread


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are in order of `cell`, so that none is spread over two batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        cell = column(batch, "cell").to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        if rest and len(cell) and column(rest[0], "cell")[0].as_py() != cell[0]:
            yield pa.concat_batches(rest)
            rest = []
        if len(cuts):
            yield pa.concat_batches([*rest, batch.slice(0, cuts[-1])])
            rest = []
            batch = batch.slice(cuts[-1])
        if batch.num_rows:
            rest.append(batch)
    if rest:
        yield pa.concat_batches(rest)


def likely_pairs(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b of rows in order of their cell: likely pairs of different groups, one of which asks and the other is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cells_of(batches):
            cell, ids, roots, n, number = (column(batch, c).to_numpy() for c in ("cell", "id", "root", "n", "number"))
            outer, asks, asked = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("outer", "asks", "asked"))
            marks = np.stack([column(batch, s).to_numpy() for s in SKETCH], axis=1).reshape(len(ids), -1, PLANES)
            held = column(batch, "nodes")
            counts = np.diff(held.offsets.to_numpy())
            nodes = np.full((len(ids), counts.max()), 1 << 40, dtype=np.int64)
            nodes[np.arange(nodes.shape[1]) < counts[:, None]] = held.flatten().to_numpy()
            first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if cell[0] > 0 else cell[0] + 1))
            sizes = np.diff(first, append=len(cell))
            begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
            left = np.flatnonzero(asks)
            total = np.cumsum(size[left])
            at = 0
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                some = left[at:to]
                a = np.repeat(some, size[some])
                steps = np.arange(len(a)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                b = begin[a] + steps
                at = to
                met = asked[b] & (roots[a] != roots[b]) & (~outer[b] | (ids[a] < ids[b]))
                met &= np.minimum(n[a], n[b]) >= share * np.maximum(n[a], n[b]) - 1e-6
                a, b = a[met], b[met]
                one, two = marks[a], marks[b]
                used = np.bitwise_count(np.bitwise_or.reduce(one | two, axis=2).view(np.uint64)).sum(axis=1, dtype=np.int64)
                agree = used - np.bitwise_count(np.bitwise_or.reduce(one ^ two, axis=2).view(np.uint64)).sum(axis=1, dtype=np.int64)
                met = likely(agree, used, n[a], n[b], share)
                a, b = a[met], b[met]
                for k in range(0, len(a), NODES_AT_ONCE):
                    l, r = a[k : k + NODES_AT_ONCE], b[k : k + NODES_AT_ONCE]
                    # filled up with numbers that differ, so that they are no common nodes
                    theirs = nodes[r] + (nodes[r] == 1 << 40)
                    common = (nodes[l][:, :, None] == theirs[:, None, :]).any(axis=2)
                    here = np.where(common, nodes[l], 1 << 41).min(axis=1) == number[l]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[l[here]]), pa.array(ids[r[here]])], ["a", "b"])

    return run


#: finds pairs (a, b) of the sets it is given
Candidates = Callable[[DataFrame], DataFrame]


class Join:
    """One search: the signed sets, the groups found so far, and the sets read so far."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, parts: int, of: int, forest: Forest) -> None:
        self.docs, self.sets, self.width, self.parts, self.of, self.forest = docs, sets, width, parts, of, forest
        #: links that are not yet part of the groups
        self.fresh: list[DataFrame] = []
        self.edges: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.read: DataFrame | None = None
        #: tree -> the order in which it uses coordinates; the first one is its root's
        rng = np.random.default_rng(SEED + 1)
        first = rng.permutation(COORDINATES)
        self.order = []
        for tree in range(forest.trees):
            start = int(first[tree % COORDINATES])
            self.order.append([start, *(int(c) for c in rng.permutation(COORDINATES) if c != start)])
        self.levels = (COORDINATES - 1) // 2

    def children(self, node: Column, level: int) -> list[Column]:
        """Children of a node that the set in `tokens` goes on to at this level of `tree`; the second one may be null."""
        found = []
        for at in (2 * level - 1, 2 * level):
            place = F.get(F.array(*[F.lit(order[at]) for order in self.order]), "tree")
            found.append(F.xxhash64(node, place, F.get("tokens", place)))
        if level > self.forest.broad:
            share = int(1000 * self.forest.second(self.parts / self.of))
            found[1] = F.when(F.pmod(F.xxhash64(node, F.lit("second")), F.lit(1000)) < share, found[1])
        return found

    def start(self, level: int) -> DataFrame:
        """tree, node, id after so many branchings."""
        first = F.array(*[F.lit(order[0]) for order in self.order])
        tree = F.explode(F.sequence(F.lit(0), F.lit(self.forest.trees - 1))).alias("tree")
        rows = self.sets.select("id", "tokens", tree)
        rows = rows.withColumn("node", F.xxhash64("tree", F.get("tokens", F.get(first, "tree"))))
        for at in range(1, level + 1):
            rows = self.grown(rows, at)
        return rows.drop("tokens")

    def grown(self, rows: DataFrame, level: int) -> DataFrame:
        nodes = F.filter(F.array(*self.children(F.col("node"), level)), lambda c: c.isNotNull())
        return rows.select("tree", F.explode(nodes).alias("node"), "id", "tokens")

    def branched(self, members: DataFrame, level: int) -> DataFrame:
        """Children of the nodes of members (tree, node, id) at this level."""
        return self.grown(members.join(self.sets.select("id", "tokens"), "id"), level).drop("tokens")

    def together(self, members: DataFrame) -> DataFrame:
        """members (tree, node, id) without those that are alone in their node."""
        dealt = members.repartition("tree", "node")
        shared = dealt.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        # both sides lie by node already; Spark counts a set once, not in each of its nodes, and might broadcast all nodes
        return dealt.join(shared.hint("merge"), ["tree", "node"], "left_semi")

    def open_members(self, members: DataFrame) -> DataFrame:
        """tree, node, id, root, first, first_root, core, size, outside of the nodes that hold several groups.

        first is the smallest set of a node, core the group with the most, outside the number of sets in other groups.
        """
        self.settle()
        if self.roots is None:
            rooted = members.withColumn("root", F.col("id"))
        else:
            rooted = members.join(self.roots, members["id"] == self.roots["of"], "left")
            rooted = rooted.select("tree", "node", "id", F.coalesce("root", "id").alias("root"))
        held = rooted.groupBy("tree", "node", "root").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        groups = held.groupBy("tree", "node").agg(
            F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("root", "n").alias("core"),
            F.min("low").alias("first"), F.min_by("root", "low").alias("first_root"),
        )
        groups = groups.withColumn("outside", F.col("size") - F.col("most")).drop("most")
        return written(rooted.join(groups.where("outside > 0"), ["tree", "node"]), "open-nodes")

    def reopened(self, opened: DataFrame) -> DataFrame:
        """opened after the links found since."""
        if not self.fresh:
            return opened
        now = self.open_members(opened.select("tree", "node", "id"))
        discard(opened)
        return now

    def star_pairs(self, opened: DataFrame) -> DataFrame:
        """a, b: each set beside that smallest one of a node which it meets in the most nodes, if they are likely."""
        met = opened.where(F.col("root") != F.col("first_root")).groupBy("id", "first").agg(F.count("*").alias("n"))
        pairs = met.groupBy(F.col("id").alias("b")).agg(F.max_by("first", "n").alias("a"))
        info = self.sets.select("id", "n", *SKETCH)
        for side in ("a", "b"):
            pairs = pairs.join(info.select(*[F.col(c).alias(side + ("" if c == "id" else c)) for c in info.columns]), side)
        return pairs.where(self._likely()).select("a", "b")

    def node_pairs(self, opened: DataFrame) -> DataFrame:
        """a, b: all likely pairs of different groups inside a node, in blocks: sets outside the core beside all of the node.

        A pair that shares several nodes is given in one of them only.
        """
        number = F.hash("tree", "node")
        nodes = opened.groupBy("id").agg(F.collect_list(number).alias("nodes"))
        rows = opened.join(self.sets.select("id", "n", *SKETCH).join(nodes, "id"), "id")

        def dealt(blocks: Column) -> tuple[Column, Column]:
            """The block of a set, and all of them."""
            count = F.ceil(blocks).cast("bigint")
            return F.pmod(F.xxhash64("id"), count), F.sequence(F.lit(0).cast("bigint"), count - 1)

        outer = F.col("root") != F.col("core")
        (x, xs), (y, ys) = dealt(F.col("outside") / self.forest.small), dealt(F.col("size") / BLOCK)
        beside = F.transform(xs, lambda at: F.struct(at.alias("x"), y.alias("y")))
        across = F.transform(ys, lambda at: F.struct(x.alias("x"), at.alias("y")))
        cells = F.explode(F.when(outer, F.array_union(beside, across)).otherwise(beside)).alias("in")
        rows = rows.select("tree", "node", "id", "root", "n", *SKETCH, "nodes", number.alias("number"), outer.alias("outer"), x.alias("x"), y.alias("y"), cells)
        asks = (F.col("outer") & (F.col("x") == F.col("in.x"))).alias("asks")
        asked = (F.col("y") == F.col("in.y")).alias("asked")
        cell = F.xxhash64("tree", "node", "in.x", "in.y").alias("cell")
        rows = rows.select(cell, "id", "root", "n", *SKETCH, "nodes", "number", "outer", asks, asked)
        dealt_out = rows.repartition("cell").sortWithinPartitions("cell")
        return dealt_out.mapInArrow(likely_pairs(self.parts / self.of), "a bigint, b bigint")

    def random_pairs(self, opened: DataFrame, turn: int) -> DataFrame:
        """a < b: each set outside the core beside the likeliest of another group and two more likely ones, of PARTNERS or so
        that a hash brings together in each node."""
        info = self.sets.select("id", "n", *SKETCH)
        few = F.pmod(F.xxhash64("id", F.lit(turn), "tree"), F.ceil(F.col("size") / PARTNERS).cast("bigint"))
        rows = opened.join(info, "id").select("tree", "node", "id", "root", "core", "n", *SKETCH, few.alias("few"))
        names = ["id", "root", "n", *SKETCH]
        left, right = (
            rows.select("tree", "node", "few", "core", *[F.col(c).alias(of + ("" if c == "id" else c)) for c in names]) for of in "ab"
        )
        met = left.where(F.col("aroot") != F.col("core")).drop("core").join(right, ["tree", "node", "few"])
        agree, used = agreement("a", "b")
        pairs = met.where((F.col("aroot") != F.col("broot")) & self._likely()).select("a", "b", (agree / used).alias("share"))
        mixed = F.xxhash64("a", "b")
        # the likeliest alone would make pairs; two more, whichever they are, make one group of near copies
        some = F.array(F.max_by("b", "share"), F.max_by("b", mixed), F.min_by("b", mixed))
        best = pairs.groupBy("a").agg(some.alias("some")).select("a", F.explode("some").alias("b"))
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _likely(self) -> Column:
        """Whether a pair at the threshold would agree in so few bins once in 100,000 times or more.

        The bins that are used are a sample of the union without replacement, so the fewer shingles are not in it the
        less it varies; and different shingles agree in their numbers once in MARKS.
        """
        sizes = self.of * F.least("an", "bn") >= self.parts * F.greatest("an", "bn")
        agree, used = agreement("a", "b")
        share, chance = self.parts / self.of, 1 / MARKS
        union = (F.col("an") + F.col("bn")) / (1 + share)
        drawn = (1 - chance) ** 2 * share * (1 - share) * F.greatest(1 - used / union, F.lit(0.0))
        spread = F.sqrt(used * (drawn + (1 - share) * chance * (1 - chance)))
        return sizes & (agree + 1 >= (share + (1 - share) * chance) * used - DEVIATIONS * spread)

    def confirm(self, pairs: DataFrame, name: str) -> None:
        """Compare the full sets of pairs and take what is similar as edges."""
        pairs = written(pairs, f"pairs-{name}")
        if pairs.isEmpty():
            return
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if self.read is not None:
            ends = ends.join(self.read.select("id"), "id", "left_anti")
        wanted = bit_table(ends.join(self.sets.select("id", "w_doc", "w_text"), "id").select(F.xxhash64("w_doc", "w_text")))
        if wanted.any():
            more = written(full_sets(self.docs, wanted, self.width), "full-sets")
            self.read = more if self.read is None else self.read.union(more)
        left = self.read.select(F.col("id").alias("a"), F.col("hashes").alias("a_set"))
        right = self.read.select(F.col("id").alias("b"), F.col("hashes").alias("b_set"))
        both, common = F.size("a_set") + F.size("b_set"), F.size(F.array_intersect("a_set", "b_set"))
        similar = self.of * common >= self.parts * (both - common)
        found = written(pairs.join(left, "a").join(right, "b").where(similar).select("a", "b"), f"links-{name}")
        discard(pairs)
        if not found.isEmpty():
            self.fresh.append(found)

    def settle(self) -> None:
        """Bring the groups up to the links found since, so far as two rounds do.

        Sets of one group are always connected; that two groups are not is settled at the end only.
        """
        if not self.fresh:
            return
        before = [x for x in (self.edges, *self.fresh) if x is not None]
        self.edges = star_edges(self.links(), rounds=2)
        self.roots = self.edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("root"))
        self.fresh = []
        for table in before:
            discard(table)

    def links(self) -> DataFrame | None:
        """a, b that connect what is connected; None if nothing is."""
        links = [x for x in (*self.fresh, self.edges) if x is not None]
        return reduce(DataFrame.union, links) if links else None

    def run(self) -> DataFrame | None:
        """of, root of every set that is not the smallest of its group; None if there are no links at all."""
        level = min(self.forest.first, self.levels)
        members = written(self.together(self.start(level)), f"level-{level}")
        # all further steps are about sets that are not alone
        self.sets = written(self.sets.join(members.select("id").distinct(), "id", "left_semi"), "shared-sets")
        opened = self.open_members(members)
        if not opened.isEmpty():
            self.confirm(self.star_pairs(opened), "star")
        while not opened.isEmpty():
            # near copies become one group before they are compared with each other
            opened = self.reopened(opened)
            self.confirm(self.random_pairs(opened.where(F.col("outside") > PARTNERS), level), f"random-{level}")
            opened = self.reopened(opened)
            # without coordinates left, nodes of any size are compared in blocks
            last = level >= self.levels
            large = F.col("outside") > self.forest.small
            self.confirm(self.node_pairs(opened if last else opened.where(~large)), f"node-{level}")
            rest = opened.where(large).select("tree", "node", "id")
            if last or rest.isEmpty():
                break
            level += 1
            members = written(self.together(self.branched(rest, level)), f"level-{level}")
            discard(opened)
            opened = self.open_members(members)
        links = self.links()
        return None if links is None else star_edges(links).select(F.col("a").alias("of"), F.col("b").alias("root"))


def distinct_sets(known: DataFrame) -> DataFrame:
    """id, n, print, tokens, sketch, w_doc, w_text of every distinct set of known that is not empty."""
    first = F.min(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")))
    rows = known.where("node is not null").groupBy(F.col("node").alias("id")).agg(
        first.alias("x"), F.first(F.struct("n", "print", "tokens", *SKETCH)).alias("set")
    )
    return rows.select("id", "set.*", F.col("x.d").alias("w_doc"), F.col("x.t").alias("w_text"))


def similar_rows(
    docs: DataFrame, width: int, parts: int, of: int, forest: Forest | None = None, first: Candidates | None = None
) -> DataFrame:
    """doc_id, text_hash, n_shingles, root of every row of docs: rows that chains of similar texts connect have one root.

    Texts are similar if the Jaccard similarity of their sets of shingles of `width` words is parts / of or more.  root is null for
    a text without words.  first finds pairs of sets (a, b: ids) that are compared before the trees grow.
    """
    known = written(signed(docs, width, prints=first is not None), "signed")
    sets = written(distinct_sets(known), "sets")
    known = known.select("doc_id", "text_hash", "node", "n")
    join = Join(docs, sets, width, parts, of, forest or Forest())
    if first is not None:
        join.confirm(first(sets), "first")
    roots = join.run()
    if roots is None:
        return known.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("node").alias("root"))
    met = known.join(roots, known["node"] == roots["of"], "left")
    return met.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, parts: int = 85, of: int = 100, forest: Forest | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row of docs.

    Words are what white space separates, A-Z lower-cased; a text of fewer words than width is one shingle.  Rows whose
    sets have a Jaccard similarity of parts / of or more are linked, and component_id is the smallest doc_id that a chain of links
    reaches, the row itself included (null if none of them has an id).  kept: doc_id is component_id, or neither is there.
    Null, empty and blank texts have no shingles and are linked with nothing, not even with each other or rows of the same
    id.  Rows that repeat in whole share a component.  An empty table gives no rows; other columns are not read.

    Links are confirmed on full sets, so none is wrong.  One can be missed: by all trees (Forest.missed; 3e-8 at the
    threshold where the first nodes looked at are small, 1e-7 after seven branchings) or by its sketch (1e-5).
    """
    rows = written(similar_rows(docs, width, parts, of, forest), "similar-rows")
    lowest = rows.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("low"))
    met = rows.join(lowest, rows["root"] == lowest["of"], "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    out = met.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
