"""Conversation repair against all edit sequences of short conversations and a plain program for longer ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair
from tidemark.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
BARE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """conv_id -> damaged rows, for rows (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        out[conv]  # noqa: B018  a conversation stays even without rows
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_facts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BARE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return rows, faults, gaps, illegal


def plain_choices(row, fault):
    """(cost, letter, role) a row can become; role None for a deleted one."""
    late = 5 if fault == "truncated" else 0
    out = [(2, "D", None)]
    if fault not in ("blank", "duplicate"):
        out += [(late, "K", row[1]), (1 + late, "R", "user"), (1 + late, "R", "assistant")]
    return out


def all_sequences(rows, faults, most_inserts):
    """The best of all edit sequences with at most so many inserts in each gap."""
    gaps = [[(5 * n, "I" * n, list(p)) for n in range(most_inserts + 1) for p in itertools.product(("user", "assistant"), repeat=n)]]
    slots = gaps + [s for r, f in zip(rows, faults, strict=True) for s in ([(c, x, [(o, r[2])] if o is not None else []) for c, x, o in plain_choices(r, f)], gaps[0])]
    best = None
    for pick in itertools.product(*slots):
        out = [(x, "") if isinstance(x, str) else x for p in pick for x in p[2]]
        if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            found = (sum(p[0] for p in pick), "".join(p[1] for p in pick), out)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def plain_program(rows, faults):
    """The same by states, holding whole strings: state is what the last row's initial is."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def offer(into, state, cost, letters, out):
        if state not in into or (cost, letters) < into[state][:2]:
            into[state] = (cost, letters, out)

    def inserts(into):
        for _ in range(3):
            for state, (cost, letters, out) in list(into.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        offer(into, role[0], cost + 5, letters + "I", [*out, (role, "")])

    inserts(best)
    for row, fault in zip(rows, faults, strict=True):
        now = {}
        for state, (cost, letters, out) in best.items():
            for c, letter, role in plain_choices(row, fault):
                if role is None:
                    offer(now, state, cost + c, letters + letter, out)
                elif role[:1] and role[:1] in follows[state]:
                    offer(now, role[:1], cost + c, letters + letter, [*out, (role, row[2])])
        inserts(now)
        best = now
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain_repair(rows, solve=plain_program):
    out = []
    for conv, given in plain_damage(rows).items():
        ordered, faults, gaps, illegal = plain_facts(given)
        cost, audit, text = solve(ordered, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in text).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(conversations):
    rows = repair.repair(repair.damaged(conversations)).collect()
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def made_up(n, longest, seed):
    rng = random.Random(seed)
    texts = ["a.", "b!", "no end", "", " \t", "same.", "same.", "café?", "x. "]
    roles = ["user", "assistant", "user", "assistant", "system", "", None, "tool", "u", "S"]
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 3, -5])
        for _ in range(rng.randrange(longest + 1)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice([*texts, f"t{turn}.", f"t{turn}.", None])))
            turn += rng.choice([1, 1, 1, 0, 2])
    return rows


def test_short_conversations_against_all_sequences(spark):
    rows = made_up(60, 3, 1)
    given = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 3]
    by_conv = plain_damage(given)
    short = {c for c, r in by_conv.items() if len(r) <= 3}
    want = plain_repair([r for r in given if r[0] in short], lambda r, f: all_sequences(r, f, 2))
    assert len(want) > 30
    assert found(spark.createDataFrame([r for r in given if r[0] in short], SCHEMA)) == want


def test_longer_conversations_against_a_plain_program(spark):
    rows = made_up(80, 14, 2) + [(None, t, r, x) for _, t, r, x in made_up(1, 9, 3)]
    rows += rows[:40]
    # extra columns with names used inside are not read
    given = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("part", F.lit(1)).withColumn("digest", F.lit(""))
    assert found(given) == plain_repair(rows)


def test_a_conversation_of_a_third_of_all_rows_is_cut(spark):
    rng = random.Random(5)
    hot = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"text {i}.", f"text {i % 50}!", "cut off", " "])) for i in range(900)]
    rows = hot + made_up(60, 10, 6)[:400]
    given = spark.createDataFrame(rows, SCHEMA)
    assert found(given) == plain_repair(rows)
    everything = repair.rows_of(repair.damaged(given))
    audits = repair.edit_audits(everything)
    lines = [r for r in repair.repaired_rows(everything, audits).where("conv_id = 7").orderBy("place").collect()]
    _, _, out = plain_program(*plain_facts(plain_damage(hot)[7])[:2])
    assert [(r.role, r.text) for r in lines] == out and [r.place for r in lines] == list(range(len(out)))
    assert any(r.edit == "R" for r in lines) and all((r.turn is None) == (r.edit == "I") for r in lines)


def test_stretches_put_together_are_one_conversation():
    """However a conversation is cut, its parts give what it gives whole."""
    import pyarrow as pa

    rng = random.Random(8)
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    for _ in range(60):
        rows = [(i, names[rng.choice("uuuaaast")], rng.choice(["x.", "cut", "", f"y{i}."])) for i in range(rng.randrange(1, 25))]
        ordered, faults, gaps, illegal = plain_facts(rows)
        want = plain_program(ordered, faults)[:2]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=3))
        parts = []
        for number, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(rows)])):
            stretch = repair.Stretch(1, number > 0, repair.Costs())
            for (turn, role, text), fault in zip(ordered[a:b], faults[a:b], strict=True):
                stretch.add(turn, role[:1], f"{turn}", fault == "blank", fault != "truncated", fault == "duplicate")
            parts.append(stretch.part(number, closes=True))
        rng.shuffle(parts)
        got = repair.put_together(pa.Table.from_pylist(parts, pa.schema([
            ("conv_id", pa.int64()), ("part", pa.int32()), ("inner", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.binary())),
            *[(n, pa.int64()) for n in ("n", "turns", "blank", "duplicate", "truncated", "illegal", "low", "high")],
            ("first", pa.string()), ("last", pa.string()),
        ]))).to_pylist()[0]
        assert (got["cost"], got["audit"]) == want
        assert got["illegal"] == illegal and got["high"] - got["low"] + 1 - got["turns"] == gaps
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]


def test_settled_edits_change_nothing(monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice("uuaas"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(600)]

    def solved():
        one = repair.Repair(repair.NOTHING, repair.Costs())
        for row in rows:
            one.row(*row)
        return one.end(), len(one.settled)

    (whole, none), _ = solved(), monkeypatch.setattr(repair, "_NODES", 60)
    (cut, some) = solved()
    assert whole == cut and none == 0 and some > 3


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that calls everything equal, letters alone decide."""
    monkeypatch.setattr(repair, "_PRIME", 1)
    tree, words = repair.Audits(), ["", "D", "DK", "DKI", "DKKD", "DR", "K", "KD", "RRRRRK", "RRRRRR"]
    nodes = []
    for word in words:
        at = 0
        for letter in word:
            at = tree.after(at, letter)
        nodes.append(at)
    assert all(tree.before(a, b) == (x < y) for a, x in zip(nodes, words, strict=True) for b, y in zip(nodes, words, strict=True))


def test_other_costs(spark):
    """Dear deletions make inserts pay."""
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c.")]
    given = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copies int")
    out = repair.repair(given, repair.Costs(rerole=9, delete=9)).collect()
    assert [(r.audit, r.cost) for r in out] == [("KIKK", 5)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, None, None, None)] * 3, [(1, 1, "user", "x" * 300_000 + ".")]])
def test_edges(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain_repair(rows)


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op11_conversation_repair"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_repair(rows)
