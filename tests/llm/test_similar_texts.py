"""Near-duplicates by shingle similarity against a comparison of all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
from tests.llm.helpers import DOCS, corpus, documents
from tidemark.llm import chosen_path, near_dups, similar_texts
from tidemark.llm.common import written


def plain_set(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def plain_roots(texts):
    """For each text the first one that a chain of similarities of 0.8 or more reaches."""
    sets = [plain_set(t) for t in texts]
    first, low = {}, {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
        low.setdefault(first[s], first[s])

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    holders = defaultdict(list)
    for s, i in first.items():
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, c in common.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return [find(first[s]) for s in sets]


def same_split(found, rows):
    """Whether rows of found (doc_id is the place in rows) are split as plain_roots splits them."""
    roots = {r.doc_id: r.root for r in found.collect()}
    want = plain_roots([r[1] for r in rows])
    pairs = {(roots[i], want[i]) for i in range(len(rows))}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_similar_groups_miss_none(spark):
    rng = random.Random(3)
    rows = []
    for size in [1, 3, 4, 5, 6, 9, 10, 30, 100, 400]:
        for _ in range(6):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            for edits in range(6):
                given = list(words)
                for _ in range(edits * size // 100 + (edits > 3)):
                    at = rng.randrange(len(given))
                    given[at : at + rng.choice([0, 1])] = [f"w{rng.randrange(4000)}"]
                rows.append((len(rows), " ".join(given), "en", "a", None))
    # a ring of texts, each similar to its neighbours only, and many that share one passage but nothing else
    ring = [f"r{i}" for i in range(400)]
    rows += [(len(rows) + i, " ".join(ring[10 * i : 10 * i + 110]), "en", "a", None) for i in range(20)]
    rows += [(len(rows) + i, " ".join(ring[:8] + [f"s{i}x{k}" for k in range(4)]), "en", "a", None) for i in range(40)]
    rows += [(len(rows), None, "en", "a", None), (len(rows) + 1, " \n", "en", "a", None)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert same_split(similar_texts.similar_groups(documents(spark, rows)), rows)
    assert len(set(plain_roots([r[1] for r in rows]))) < len(rows) - 100


def test_similar_groups_of_the_corpus(spark):
    texts = [r.text for r in corpus(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()]
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    assert same_split(similar_texts.similar_groups(documents(spark, rows)), rows)


def test_stage_drops_copies_a_few_words_apart(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*words[: 30 * i], f"new{i}", *words[30 * i + 1 :]]), "en", "a", None) for i in range(6)]
    rows.append((9, " ".join(reversed(words)), "en", "a", None))
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 9]


def test_a_shared_passage_makes_no_pairs_by_the_square(spark, monkeypatch):
    """Texts that share a passage and nothing else: what is compared in full grows with the texts, not with their square."""
    from tidemark.llm import chosen_path

    compared = []
    confirm = chosen_path.Join.confirm

    def counted(self, pairs, name):
        compared.append(pairs.count())
        confirm(self, pairs, name)

    monkeypatch.setattr(chosen_path.Join, "confirm", counted)
    sizes = {}
    for n in (300, 1200):
        compared.clear()
        passage = " ".join(f"p{i}" for i in range(20))
        rows = [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(60)), "en", "s", None) for i in range(n)]
        assert similar_texts.similar_groups(documents(spark, rows)).select("root").distinct().count() == n
        sizes[n] = sum(compared)
    assert sizes[300] < 300 and sizes[1200] < 1200


def test_few_tables_are_written_aside(spark, monkeypatch):
    """Each table written is several plans that the driver holds: a stage of a few rounds needs no hundred of them."""
    from tidemark.llm import chosen_path, common, graph

    names = []

    def noted(df, name):
        names.append(name)
        return common.written(df, name)

    for module in (chosen_path, graph, similar_texts):
        monkeypatch.setattr(module, "written", noted)
    rng = random.Random(9)
    rows = []
    for family in range(20):
        words = [f"f{family}w{i}" for i in range(100)]
        for _ in range(8):
            given = list(words)
            for _ in range(3):
                given[rng.randrange(100)] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(given), "en", "a", None))
    assert same_split(similar_texts.similar_groups(documents(spark, rows)), rows)
    assert len(names) < 20


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_few_prints_are_not_broadcast(spark):
    """Spark takes the 64 keys of a fingerprint for one row as large as the fingerprint."""
    prints = written(spark.createDataFrame([(i, i) for i in range(50)], "print bigint, low bigint"), "prints")
    plan = plan_of(near_dups.links(prints))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_nodes_of_few_sets_are_not_broadcast(spark):
    """Spark takes a set for one row in all the nodes it is in."""
    docs = documents(spark)
    sets = written(chosen_path.distinct_sets(written(chosen_path.signed(docs, 5, True), "signed")), "sets")
    join = chosen_path.Join(docs, sets, 5, 4, 5, chosen_path.Forest())
    members = join.together(join.start(2))
    plan = plan_of(members)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert members.count() > members.select("id").distinct().count() > 0
