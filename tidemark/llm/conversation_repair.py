"""Conversations put back into the order (system)? (user assistant)+ by the cheapest edits, with an audit of them.

The audit is a dynamic program over the rows of a conversation.  Its states are what the repaired text
ends in so far (nothing, system, user, assistant); each holds the cheapest edits that lead there, among equally cheap ones those
whose letters come first.  Edits are shared prefixes: a node of a persistent tree is one edit after another node, with
pointers to its ancestors 1, 2, 4, ... edits back and a rolling hash of all its letters.  Two audits of equal cost are told apart
by the first letter they differ in, which a search over ancestors finds by their hashes; where hashes of different nodes agree, letters are
compared one by one.

A conversation may hold a third of all rows, so rows are cut into ranges of (conversation, turn, role, text): a range solves the
conversations it holds whole, and of those it shares with other ranges it gives the best edits from every state
to every state, which are put together afterwards.  Texts take no part in this; only a digest or the
repaired rows read them, in order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

_SPACES = " \t\n\x0b\x0c\r"
#: nodes of a tree beyond which edits that all states agree on are taken out of it
_NODES = 50_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state -> state that a row of this initial leads to
_STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT_ROLE = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_LEGAL_PAIRS = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    """What edits cost; all but keep must be above zero, as ties then never end in one audit continuing the other."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audits:
    """Strings of edits as nodes of a tree; node 0 is the empty one."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def after(self, node: int, letter: str) -> int:
        ups, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(ups)
        return len(self.letter) - 1

    def back(self, node: int, depth: int) -> int:
        """The ancestor of node that has this depth."""
        while self.depth[node] > depth:
            steps = self.depth[node] - depth
            node = self.up[node][steps.bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same; equal hashes are verified."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def before(self, a: int, b: int) -> bool:
        """Whether a's letters come before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.back(a, depth), self.back(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def spelled(self, node: int, since: int = 0) -> str:
        """Letters of node after its first `since`."""
        letters = []
        while self.depth[node] > since:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))


class Repair:
    """Best edits of the rows seen so far, from one state to every state."""

    def __init__(self, entry: int, costs: Costs) -> None:
        self.costs, self.audits, self.settled, self.limit = costs, Audits(), [], _NODES
        #: state -> (cost, node)
        self.best: dict[int, tuple[int, int]] = {entry: (0, 0)}
        self._insert()

    def _offer(self, into: dict[int, tuple], state: int, cost: int, node: int, letter: str) -> None:
        known = into.get(state)
        if known and known[0] < cost:
            return
        made = self.audits.after(node, letter)
        if not known or cost < known[0] or self.audits.before(made, known[1]):
            into[state] = (cost, made)

    def _insert(self) -> None:
        # a user, then an assistant; more would only go round
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(self.best, _NEXT_ROLE[state], cost + self.costs.insert, node, "I")

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        now: dict[int, tuple[int, int]] = {}
        stay = self.costs.truncated if truncated else 0
        kept = {} if must_go else _STEPS.get(initial, {})
        for state, (cost, node) in self.best.items():
            self._offer(now, state, cost + self.costs.delete, node, "D")
            if must_go:
                continue
            if state in kept:
                self._offer(now, kept[state], cost + stay, node, "K")
            given = _NEXT_ROLE[state]
            if kept.get(state) != given:
                self._offer(now, given, cost + stay + self.costs.rerole, node, "R")
        self.best = now
        self._insert()
        if len(self.audits.letter) > self.limit:
            self._settle()
            self.limit = max(_NODES, 2 * len(self.audits.letter))

    def _settle(self) -> None:
        """Take out the edits that all states begin with, and nodes that none ends in."""
        old = self.audits
        nodes = [n for _, n in self.best.values()]
        depth = min(old.depth[n] for n in nodes)
        shared = nodes[0]
        for node in nodes[1:]:
            low, high = 0, min(depth, old.depth[shared])
            while low < high:
                middle = (low + high + 1) // 2
                if old.back(shared, middle) == old.back(node, middle):
                    low = middle
                else:
                    high = middle - 1
            shared = old.back(shared, low)
        since = old.depth[shared]
        self.settled.append(zlib.compress(old.spelled(shared).encode()))
        self.audits, made = Audits(), {}
        for state, (cost, node) in list(self.best.items()):
            at = 0
            for letter in old.spelled(node, since):
                if (at, letter) not in made:
                    made[at, letter] = self.audits.after(at, letter)
                at = made[at, letter]
            self.best[state] = (cost, at)

    def audit(self, state: int) -> str:
        return "".join(zlib.decompress(s).decode() for s in self.settled) + self.audits.spelled(self.best[state][1])

    def end(self) -> tuple[int, str]:
        """Cost and audit of what ends whole: with nothing, or with an assistant."""
        ends = [s for s in (NOTHING, ASSISTANT) if s in self.best]
        cost = min(self.best[s][0] for s in ends)
        return cost, min(self.audit(s) for s in ends if self.best[s][0] == cost)


_COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
_FACTS = "n bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, first string, last string"
_PART = f"conv_id bigint, part int, inner boolean, costs array<bigint>, audits array<binary>, {_FACTS}"


class Stretch:
    """The rows of one conversation inside one range."""

    def __init__(self, conv_id: int | None, opens: bool, costs: Costs) -> None:
        self.conv_id = conv_id
        #: it may go on from the range before, in any state
        self.opens = opens
        self.repairs = [Repair(e, costs) for e in (range(4) if opens else (NOTHING,))]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.first = self.last = self.row = None

    def add(self, turn: int | None, initial: str, digest: str, blank: bool, stopped: bool, repeat: bool) -> None:
        counts = self.counts
        # rows that repeat in whole are neighbours
        repeat = repeat or (turn, initial, digest) == self.row
        self.row = (turn, initial, digest)
        fault = "blank" if blank else "duplicate" if repeat else None if stopped else "truncated"
        if fault:
            counts[fault] += 1
        counts["n"] += 1
        if turn is not None and turn != self.high:
            counts["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL_PAIRS:
            counts["illegal"] += 1
        self.last = initial
        for repair in self.repairs:
            repair.row(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def part(self, number: int, closes: bool) -> dict:
        """A row of _PART: of an inner stretch the result, of another one the best edits by state it starts and ends in."""
        inner = not (self.opens or closes)
        if inner:
            cost, audit = self.repairs[0].end()
            costs, audits = [cost], [audit.encode()]
        else:
            costs, audits = [], []
            for repair in self.repairs:
                for state in range(4):
                    known = state in repair.best
                    costs.append(repair.best[state][0] if known else None)
                    audits.append(zlib.compress(repair.audit(state).encode()) if known else None)
        facts = {"low": self.low, "high": self.high, "first": self.first, "last": self.last}
        return {"conv_id": self.conv_id, "part": number, "inner": inner, "costs": costs, "audits": audits, **self.counts, **facts}


def _schema(ddl: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl.schema)


def _order(digest: Column) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), digest]


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, copy of rows; null roles and texts read as one space, `copies` rows become as many."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    rows = conversations.select(*ids, role.alias("role"), text.alias("text"), copies.alias("copies"))
    # a row without copies stays as a mark that its conversation exists
    copy = F.explode(F.sequence(F.when(F.col("copies") > 0, 1).otherwise(0), F.col("copies"))).alias("copy")
    return rows.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"), copy)


def edit_audits(rows: DataFrame, costs: Costs | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in rows (see rows_of).

    Rows are taken by turn (nulls first), those of a turn by role and md5 of the text.  A row is blank without
    a character other than white space, else a duplicate if role and text were seen earlier, else truncated if its
    last such character is none of . ! ?.  Blank and duplicate rows must be deleted.
    """
    costs = costs or Costs()
    bare = F.rtrim(F.translate("text", _SPACES[1:], " " * (len(_SPACES) - 1)))
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "copy", (bare == "").alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("stopped"), F.md5(F.concat_ws(":", "role", "digest")).alias("content"),
    )
    # the first place of every content; joined on the place too, so no content's rows meet in one task
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "copy")
    placed = narrow.withColumn("place", place)
    firsts = placed.where("copy > 0").groupBy("conv_id", "content").agg(F.min("place").alias("place"))
    firsts = firsts.select(
        F.col("conv_id").alias("f_conv"), F.col("content").alias("f_content"), F.col("place.known").alias("f_known"),
        F.col("place.turn").alias("f_turn"), F.col("place.copy").alias("f_copy"),
    )
    same = (
        placed["conv_id"].eqNullSafe(firsts["f_conv"]) & (placed["content"] == firsts["f_content"])
        & (placed["place.known"] == firsts["f_known"]) & (placed["place.turn"] == firsts["f_turn"]) & (placed["copy"] == firsts["f_copy"])
    )
    marked = placed.join(firsts, same, "left").withColumn("repeat", F.col("f_copy").isNull())
    order = _order(F.col("digest"))
    ranged = (
        marked.select("conv_id", "turn", "role", "digest", "copy", "blank", "stopped", "repeat", (F.col("copy") > 0).alias("there"))
        .repartitionByRange(*order).sortWithinPartitions(*order, "copy").withColumn("part", F.spark_partition_id())
    )
    spark = rows.sparkSession
    shape = _schema(spark.createDataFrame([], _PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, done = None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                number = r["part"]
                if now is None or r["conv_id"] != now.conv_id:
                    if now is not None:
                        done.append(now.part(number, closes=False))
                    now = Stretch(r["conv_id"], now is None, costs)
                if r["there"]:
                    now.add(r["turn"], r["role"][:1], r["role"] + r["digest"], r["blank"], r["stopped"], r["repeat"])
            yield pa.RecordBatch.from_pylist(done, shape)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.part(number, closes=True)], shape)

    parts = written(ranged.mapInArrow(run, _PART), "conversation-parts")
    names = ["conv_id", "n", "turns", "blank", "duplicate", "truncated", "illegal", "low", "high"]
    whole = parts.where("inner").select(*names, F.col("costs")[0].alias("cost"), F.col("audits")[0].cast("string").alias("audit"))
    # at most two stretches of a range are not inner
    open_ended = parts.where("not inner").groupBy("conv_id").applyInArrow(put_together, whole.schema)
    gaps = F.col("high") - F.col("low") + 1 - F.col("turns")
    return whole.unionByName(open_ended).select(
        "conv_id", F.coalesce(gaps, F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


class _Linked:
    """Compressed stretches of an audit, one after another."""

    def __init__(self, before: _Linked | None, packed: bytes) -> None:
        self.before, self.packed = before, packed
        self.depth = before.depth + 1 if before else 1

    def spelled(self, since: int = 0) -> str:
        parts, at = [], self
        while at is not None and at.depth > since:
            parts.append(zlib.decompress(at.packed).decode())
            at = at.before
        return "".join(reversed(parts))

    def precedes(self, other: _Linked) -> bool:
        a, b = self, other
        while a is not None and a is not b:
            a, b = a.before, b.before
        since = a.depth if a is not None else 0
        return self.spelled(since) < other.spelled(since)


def put_together(table: pa.Table) -> pa.Table:
    """One conversation's stretches, in the order of their ranges, as one row."""
    parts = sorted(table.to_pylist(), key=lambda p: p["part"])
    total = dict.fromkeys(_COUNTS, 0)
    low = high = last = None
    best: dict[int, tuple[int, _Linked | None]] = {NOTHING: (0, None)}
    for p in parts:
        for name in _COUNTS:
            total[name] += p[name]
        if p["low"] is not None:
            total["turns"] -= p["low"] == high
            low, high = p["low"] if low is None else low, p["high"]
        if p["first"] is not None:
            total["illegal"] += last is not None and last + p["first"] not in _LEGAL_PAIRS
            last = p["last"]
        now: dict[int, tuple[int, _Linked]] = {}
        for entry, (cost, linked) in best.items():
            for state in range(4):
                at = entry * 4 + state
                if at >= len(p["costs"]) or p["costs"][at] is None:
                    continue
                made = (cost + p["costs"][at], _Linked(linked, p["audits"][at]))
                known = now.get(state)
                if not known or made[0] < known[0] or (made[0] == known[0] and made[1].precedes(known[1])):
                    now[state] = made
        best = now
    ends = [best[s] for s in (NOTHING, ASSISTANT) if s in best]
    cost = min(c for c, _ in ends)
    audit = min(linked.spelled() for c, linked in ends if c == cost)
    row = {"conv_id": parts[0]["conv_id"], **total, "low": low, "high": high, "cost": cost, "audit": audit}
    names = ["conv_id", "n", "turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "cost"]
    fields = [pa.field(n, pa.int64()) for n in names] + [pa.field("audit", pa.string())]
    return pa.Table.from_pylist([row], pa.schema(fields))


def followed(audit: str) -> Callable[[str | None, str | None], Iterator[tuple[str, str | None, str | None]]]:
    """A function that takes row after row (role, text), at last (None, None), and gives (edit, role, text) of what they become.

    role and text are None for a deleted row.
    """
    kept = len(audit) - audit.count("D")
    state = {"at": 0, "out": 0}

    def given() -> str:
        # an odd number of rows starts with the system's
        return ("user", "assistant")[(state["out"] - kept % 2) % 2]

    def step(role: str | None, text: str | None) -> Iterator[tuple[str, str | None, str | None]]:
        while state["at"] < len(audit) and audit[state["at"]] == "I":
            yield "I", given(), ""
            state["at"] += 1
            state["out"] += 1
        if role is None:
            return
        edit = audit[state["at"]]
        state["at"] += 1
        if edit == "D":
            yield "D", None, None
            return
        yield edit, role if edit == "K" else given(), text
        state["out"] += 1

    return step


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows behind their conversation's audit: conversations may share a task, and each is read in order."""
    none = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), none.alias("digest"), "audit")
    lines = rows.where("copy > 0").select("conv_id", "turn", "role", "text", "digest", none.alias("audit"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, tuple]]:
    """(conv_id, whether it starts, (turn, edit, role, text)); a start has no edit."""
    step, conv_id = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["audit"] is not None:
                if step is not None:
                    yield from ((conv_id, False, (None, *e)) for e in step(None, None))
                step, conv_id = followed(r["audit"]), r["conv_id"]
                yield conv_id, True, ()
            else:
                yield from ((conv_id, False, (r["turn"] if e[0] != "I" else None, *e)) for e in step(r["role"], r["text"]))
    if step is not None:
        yield from ((conv_id, False, (None, *e)) for e in step(None, None))


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn (null where inserted), edit, role, text of the repaired conversations, deleted rows left out."""
    ddl = "conv_id bigint, place bigint, turn bigint, edit string, role string, text string"
    names = ["conv_id", "place", "turn", "edit", "role", "text"]
    shape = _schema(rows.sparkSession.createDataFrame([], ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for conv_id, starts, line in _conversations(batches):
            if starts:
                place = 0
            elif line[2] is not None:
                out.append(dict(zip(names, (conv_id, place, *line), strict=True)))
                place += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        yield pa.RecordBatch.from_pylist(out, shape)

    return _in_order(rows, audits).mapInArrow(run, ddl)


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the repaired rows as role:text, joined by line feeds.

    A digest runs over a conversation from its first row to its last, so one task reads all of one, row by row,
    however long; it holds the audit and one batch of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, sha, first = [], [], None, True

        for conv_id, starts, line in _conversations(batches):
            if starts:
                if sha is not None:
                    digests.append(sha.hexdigest())
                ids.append(conv_id)
                sha, first = hashlib.sha256(), True
            elif line[2] is not None:
                sha.update(f"{'' if first else chr(10)}{line[2]}:{line[3]}".encode("utf-8", "replace"))
                first = False
        if sha is not None:
            digests.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

    return _in_order(rows, audits).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair(conversations: DataFrame, costs: Costs | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    conversations has conv_id, turn, role, text and may have copies (how often a row stands there; 0: not at all, yet the
    conversation counts as one).  Nulls in role and text read as one space; rows with a null conv_id are one conversation;
    null turns come first and leave no gaps; rows that repeat in whole are duplicates of their first; rows of one turn are
    taken by role, then by md5 of the text.  Roles are told by their first letter; an empty or unknown role is
    never legal where it stands.  A conversation without rows has no edits, costs nothing and
    digests the empty string.  An empty table gives no rows.  Other columns are not read.
    """
    rows = rows_of(conversations)
    audits = written(edit_audits(rows, costs), "audits")
    digests = repaired_digests(rows, audits)
    out = audits.join(digests, audits["conv_id"].eqNullSafe(digests["conv_id"]))
    return out.select(audits["*"], "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes out . ! ?, 3 repeats, 4 makes a user's.

    Nulls in any of the four columns read as one space there and in the damaged row, the null conv_id and turn stay null.
    """
    space = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *ids)) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
