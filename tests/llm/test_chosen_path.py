"""Chosen-path groups against a comparison of all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, clashing, corpus, documents
from tidemark.llm import chosen_path
from tidemark.llm.queries import QUERIES


def plain_set(text, width):
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def plain_rows(rows, width=3, parts=85, of=100):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text), by comparing all sets that share a shingle."""
    sets = [plain_set(t, width) for _, t in rows]
    first: dict = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(s, i)
    low = {i: i for i in first.values()}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    holders, links = defaultdict(list), 0
    for s, i in first.items():
        common: dict = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, c in common.items():
            if of * c >= parts * (len(s) + len(sets[j]) - c):
                links += 1
                low[find(i)] = find(j)
    ids = defaultdict(list)
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            ids[find(first[s])].append(doc_id)
    out = []
    for (doc_id, _), s in zip(rows, sets, strict=True):
        component = (min(ids[find(first[s])], default=None)) if s else doc_id
        out.append((doc_id, len(s), component, doc_id == component))
    return sorted(out, key=repr), links


def found(docs, **how):
    rows = chosen_path.near_duplicates(docs, **how).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=repr)


def edited(words, edits, rng):
    given = list(words)
    for _ in range(edits):
        at = rng.randrange(len(given) + 1)
        given[at : at + rng.choice([0, 1])] = rng.choice([[], [f"n{rng.randrange(10**6)}"]])
    return given


def families(seed, sizes=(2, 3, 7, 30, 120, 500), members=9):
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        for _ in range(8):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for m in range(members):
                rows.append((len(rows), " ".join(edited(words, m * size // 250 + (m > 5), rng)), "en", "s", None))
    return rows


def test_families_of_edited_texts(spark):
    rows = families(1)
    want, links = plain_rows([r[:2] for r in rows])
    assert found(documents(spark, rows)) == want
    assert links > 150 and len({r[2] for r in want}) > 60


def test_a_large_group_a_chain_and_a_shared_passage(spark):
    """With nodes of at most 8 sets trees branch many times: hundreds of near copies, a chain, and texts that share a passage only."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(base, 2, rng)) for _ in range(400)]
    ring = [f"r{i}" for i in range(900)]
    texts += [" ".join(ring[10 * i : 10 * i + 140]) for i in range(60)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"o{i}x{k}" for k in range(60)]) for i in range(500)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    want, links = plain_rows([r[:2] for r in rows])
    assert links > 10_000 and len({r[2] for r in want}) > 500
    assert found(documents(spark, rows), forest=chosen_path.Forest(small=8)) == want


def test_pairs_at_the_threshold_are_found_as_often_as_said(spark):
    """Pairs barely similar enough, each among many texts that share half of it, so that trees must branch."""
    rng = random.Random(3)
    rows = []
    for p in range(60):
        half = [f"h{p}x{i}" for i in range(60)]
        own = [f"a{p}x{i}" for i in range(62)]
        rows.append(half + own)
        rows.append(half + own[:53] + [f"b{p}x{i}" for i in range(9)])
        rows += [half + [f"c{p}x{k}x{i}" for i in range(60)] for k in range(30)]
    docs = [(i, " ".join(r), "en", "s", None) for i, r in enumerate(rows)]
    rng.shuffle(docs)
    want, links = plain_rows([r[:2] for r in docs])
    assert links == 60
    forest = chosen_path.Forest(small=4)
    assert forest.missed(0.85, 3) < 1e-4
    assert found(documents(spark, docs), forest=forest) == want


def test_without_coordinates_left_nodes_are_compared_in_blocks(spark, monkeypatch):
    """Texts that agree in every coordinate but are not similar enough."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(base, rng.choice([1, 9]), rng)), "en", "s", None) for i in range(200)]
    want, _ = plain_rows([r[:2] for r in rows])
    make = chosen_path.Join.__init__

    def shallow(self, *args):
        make(self, *args)
        self.levels = 1

    monkeypatch.setattr(chosen_path.Join, "__init__", shallow)
    assert found(documents(spark, rows), forest=chosen_path.Forest(small=5)) == want


@pytest.mark.parametrize("how", [{}, {"width": 5, "parts": 4, "of": 5}, {"width": 1, "parts": 1, "of": 2}])
def test_edges(spark, how):
    docs = documents(spark)
    want, _ = plain_rows([(r.doc_id, r.text) for r in docs.collect()], **how)
    assert found(docs, **how) == want
    assert found(clashing(docs).withColumnRenamed("kept", "node").withColumnRenamed("length", "id"), **how) == want
    assert found(spark.createDataFrame([], DOCS), **how) == []


def test_pairs_found_elsewhere_are_confirmed(spark):
    """A forest without a common coordinate finds nothing; pairs handed in are linked if they are similar."""
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words), "en", "s", None), (2, " ".join(words[:48]), "en", "s", None), (3, "e f g h", "en", "s", None)]
    docs = documents(spark, rows)

    def all_pairs(sets):
        left, right = (sets.select(chosen_path.F.col("id").alias(c)) for c in "ab")
        return left.join(right, chosen_path.F.col("a") < chosen_path.F.col("b"))

    roots = {r.doc_id: r.root for r in chosen_path.similar_rows(docs, 3, 85, 100, first=all_pairs).collect()}
    assert roots[1] == roots[2] != roots[3]


def test_tokens_estimate_similarity():
    rng = np.random.default_rng(5)
    shared = rng.integers(-(2**63), 2**63, 850)
    sets = [np.unique(np.concatenate([shared, rng.integers(-(2**63), 2**63, 75)])) for _ in range(80)]
    tokens = [chosen_path.minwise(s, chosen_path._multipliers()) for s in sets]
    agree = [np.mean(a == b) for i, a in enumerate(tokens) for b in tokens[:i]]
    assert abs(np.mean(agree) - 0.85) < 0.02


def test_query_of_the_corpus(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = QUERIES["op13_minhash_near_dups"](spark, sf_dir).collect()
        want, links = plain_rows([(r.doc_id, r.text) for r in corpus(spark, sf_dir).collect()])
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=repr) == want and links


def test_sketches_agree_where_sets_do(spark):
    """Sketches of similar sets are hardly ever hidden, those of others mostly are."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (40, 150, 3000):
        for t, kind in ((0.85, "near"), (0.6, "far")):
            common = int(n * 2 * t / (1 + t))
            for _ in range(60):
                a = np.unique(rng.integers(-(2**63), 2**63, n))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[:common]], rng.integers(-(2**63), 2**63, n - common)]))
                rows.append((kind, len(a), len(b), *map(int, chosen_path.sketch(a)), *map(int, chosen_path.sketch(b))))
    names = [f"{side}{s}" for side in "ab" for s in chosen_path.SKETCH]
    given = spark.createDataFrame(rows, "kind string, an bigint, bn bigint, " + ", ".join(f"{n} bigint" for n in names))
    join = chosen_path.Join(None, None, 3, 84, 100, chosen_path.Forest())
    likely = {r.kind: r.n for r in given.where(join._likely()).groupBy("kind").agg({"kind": "count"}).toDF("kind", "n").collect()}
    assert likely["near"] >= 175 and likely.get("far", 0) < 90


def test_a_bit_table_holds_all_its_keys(spark):
    from tidemark.llm.common import bit_table, in_bit_table

    keys = np.random.default_rng(7).integers(-(2**63), 2**63, 3000)
    table = bit_table(spark.createDataFrame([(int(k),) for k in keys[:1500]], "k bigint"))
    found = in_bit_table(table, keys)
    assert found[:1500].all() and found[1500:].sum() < 5
    assert not in_bit_table(bit_table(spark.createDataFrame([], "k bigint")), keys).any()


def outsiders(members=120, others=60):
    """Near copies of one text, and texts that are nearly similar enough to them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(140)]

    def changed(places):
        return " ".join(f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(base))

    texts = [changed({rng.randrange(140)}) for _ in range(members)]
    texts += [changed(set(range(5 + rng.randrange(5), 140, 20))) for _ in range(others)]
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def test_texts_just_below_the_threshold_make_few_full_comparisons(spark, monkeypatch):
    """What is compared in full does not grow with copies times those that only nearly are copies."""
    compared = []
    confirm = chosen_path.Join.confirm

    def counted(self, pairs, name):
        given = [tuple(sorted(r)) for r in pairs.collect()]
        assert len(given) == len(set(given))
        compared.append(len(given))
        confirm(self, pairs, name)

    monkeypatch.setattr(chosen_path.Join, "confirm", counted)
    rows = outsiders()
    want, _ = plain_rows([r[:2] for r in rows])
    assert found(documents(spark, rows)) == want
    assert len({r[2] for r in want}) == 61
    assert sum(compared) < 1500


def test_pairs_in_blocks_are_those_in_one(spark, monkeypatch):
    """Nodes of many blocks, over batches of few rows: each likely pair comes once, in any cut."""
    rows = outsiders(60, 30)
    want, _ = plain_rows([r[:2] for r in rows], parts=7, of=10)
    monkeypatch.setattr(chosen_path, "BLOCK", 7)
    monkeypatch.setattr(chosen_path, "PAIRS_AT_ONCE", 50)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found(documents(spark, rows), parts=7, of=10, forest=chosen_path.Forest(small=1000)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
