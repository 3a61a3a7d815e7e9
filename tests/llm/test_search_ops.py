"""Decontamination, licence scan, url reputation and toxicity against plain Python and held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import DOCS, SF, as_rows, clashing, corpus, documents
from tidemark.llm import decontamination, license_scan, queries, toxicity, url_reputation

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(WORD, lower(text or ""))


@pytest.fixture(params=["edges", "corpus"])
def docs(request, spark):
    return documents(spark) if request.param == "edges" else corpus(spark)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# decontamination

ITEMS = "item_id bigint, text string"


def plain_leaks(docs, items, least=0.8):
    """Best similarity of each document and item over all places, by weighted Jaccard on five-word shingles."""

    def bag(w, width):
        return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))

    found = {}
    for r in docs:
        w = words(r.text)
        for item in items:
            own = words(item.text)
            if not own:
                continue
            width = min(5, len(own))
            want = bag(own, width)
            if not want.keys() & bag(w, width).keys():
                continue
            for at in range(max(0, len(w) - len(own)) + 1):
                part = bag(w[at : at + len(own)], width)
                same, either = sum((part & want).values()), sum((part | want).values())
                if same and same / either >= least:
                    key = (r.doc_id, item.item_id)
                    found[key] = max(found.get(key, 0), same / either)
    return found


def test_leaks_of_the_corpus(spark):
    docs, items = corpus(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_leaks(docs.collect(), items.collect())
    found = decontamination.contaminated(clashing(docs), items).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert len(found) == len(want) >= 3


def test_planted_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 5, 8, 17, 40, 90, 400))]
    items += [(20, items[4][1]), (21, None), (22, "  "), (None, items[5][1].upper())]
    filler = [word() for _ in range(300)]
    rows = []
    for i, text in items[:8]:
        shouted = re.sub(" ", ",\n", text).upper() + "!"
        rows.append((i, " ".join(filler[:50]) + " " + shouted + " " + " ".join(filler[50:90]), "en", "a", None))
    rows.append((100, " ".join(filler), "en", "a", None))
    changed = items[7][1].split()
    changed[200] = "other"
    rows.append((101, " ".join(changed), "en", "a", None))
    rows += [(None, items[6][1], None, None, None), (102, None, None, None, None), (103, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = decontamination.contaminated(docs, spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id): r.start_word for r in found.collect()}
    want = {(i, i): 50 for i in range(8)} | {(4, 20): 50, (5, None): 50, (101, 7): 0, (None, 6): 0}
    assert got == want
    left = decontamination.without_leaks(clashing(docs), spark.createDataFrame(items, ITEMS))
    assert sorted(r.doc_id for r in left.collect()) == [100, 102, 103] and left.columns == clashing(docs).columns


def test_edited_leaks(spark):
    """Whatever a plain search over all places finds at 0.8 is found, wherever the edits are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 120)))) for i in range(25)]
    rows = []
    for d in range(250):
        own = items[d % 25][1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, 1, -1, -2, rng.randrange(len(own))])
            own[at] = word()
        rows.append((d, " ".join([word() for _ in range(rng.randint(0, 30))] + own + [word() for _ in range(20)]), "en", "a", None))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    want = plain_leaks(docs.collect(), bench.collect())
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs, bench).collect()}
    assert want.keys() <= found.keys() and all(found[k] >= v - 1e-9 for k, v in want.items())
    assert sum(v < 1 for v in want.values()) > 60 and len(found) <= len(want) * 1.1
    assert [decontamination.parts_needed(m, 0.8) for m in (8, 9, 17, 18, 55, 63, 96, 396)] == [1, 2, 2, 3, 3, 4, 4, 11]


def test_window_prints():
    hashes, first = decontamination.word_hashes(["The cat, sat.", "", "cat THE", "é x"])
    assert first.tolist() == [0, 3, 3, 5, 7] and hashes[0] == hashes[4] and hashes[1] == hashes[3]
    hashes = np.random.default_rng(1).integers(0, 2**63, 3 * decontamination.WORDS_AT_ONCE, dtype=np.uint64)
    rng = random.Random(2)
    for size, at, prints in decontamination.window_prints(hashes, [3, 7, 300]):
        for k in rng.sample(range(len(prints)), 5):
            own = decontamination.shingle_hashes(hashes[at + k : at + k + size], decontamination.width_of(size)).tolist()
            assert int(prints[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


# licences


def plain_base(text):
    w = words(text)
    places, labels = [], set()
    for label, phrase in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    (1, "x\nThis work is licensed under the GNU General Public License, version 3.", "en", "a", None),
    (2, "cc by CC-BY 4.0 and Licensed under CC BY-NC 4.0.", "en", "a", None),
    (3, "MIT license. mit LICENSE apache\nlicense", "en", "a", None),
    (4, "gnu general public", "en", "a", None),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE.", "en", "a", None),
    (6, "ALL RIGHTS RESERVED", "en", "a", None),
]


def test_licences(docs, spark):
    docs = docs.union(documents(spark, LICENSED))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = license_scan.scan(clashing(docs))
    assert as_rows(found, *names) == sorted(((r.doc_id, *plain_base(r.text)) for r in docs.collect()), key=repr)
    for r in found.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "")


def test_licence_templates(spark):
    found = {r.doc_id: r for r in license_scan.scan(documents(spark, LICENSED)).collect()}
    labels = {1: "gpl", 2: "cc-by,cc-by-nc", 3: "apache,mit", 4: "", 5: "mit", 6: "all-rights-reserved"}
    assert {k: r.labels for k, r in found.items()} == labels
    assert found[1].score == found[3].score == 1 and 0.6 <= found[5].score < 1


def test_anchors_miss_no_match():
    rng = random.Random(9)
    templates = [*license_scan.base_templates(), *license_scan.notice_templates()]
    vocabulary = sorted({w for t in templates for w in t.words})
    weight = {w: rng.random() * 5 + 0.1 for w in vocabulary}
    index = license_scan.Index(templates, weight)
    for _ in range(300):
        t = rng.choice(templates)
        text = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in t.words]
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + text
        want = set()
        for u in templates:
            for at in range(1 - len(u.words), len(text)):
                region, lead = text[max(0, at) : max(0, at + len(u.words))], max(0, -at)
                same = sum(weight[a] for a, b in zip(u.words[lead:], region, strict=False) if a == b)
                if same >= u.share * sum(weight[w] for w in u.words) - 1e-9 and license_scan.holds(region, u.phrase):
                    want.add(u.label)
        assert index.scan(text)[2] == want


# urls


def test_hosts_and_rules(spark):
    urls = [
        (1, "https://A.Example.ORG/es/x?q#f"),
        (2, "http://example.org/en/12"),
        (3, "http://x.com/de/1"),
        (4, "http://x.com/fr"),
        (5, "ftp://org/"),
        (6, "no scheme.org/"),
        (7, None),
        (8, "http://notorg/x"),
        (9, "a://b.net#x://c.org/"),
        (10, "http://x.org?/es/"),
        (10, "http://x.org?/es/"),
        (11, ""),
        (None, "http://x.com/fr/\n2"),
    ]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    nobody = spark.createDataFrame([], "host string, bad int")
    found = url_reputation.judge(clashing(pages), nobody, queries.URL_RULES)
    want = [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "x.com", "/de/1", "com/de/", "block"),
        (4, "x.com", "/fr", None, "allow"),
        (5, "org", "/", "org/", "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "notorg", "/x", None, "allow"),
        (9, "b.net", "", None, "allow"),
        (10, "x.org", "", None, "allow"),
        (10, "x.org", "", None, "allow"),
        (11, "", "", None, "allow"),
        (None, "x.com", "/fr/\n2", "com/fr/", "allow"),
    ]
    assert as_rows(found, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert {round(r.bad_rate, 3) for r in found.collect()} == {0.5}
    assert url_reputation.judge(pages.limit(0), nobody, queries.URL_RULES).collect() == []


def test_reputation_shrinks(spark):
    """Many outcomes speak for themselves; few ones lean on the domain, none on it alone."""
    seen = [("bad.spam.net", 1)] * 90 + [("bad.spam.net", 0)] * 10 + [("new.spam.net", 1)] * 2
    seen += [("good.com", 0)] * 95 + [("good.com", 1)] * 5 + [("few.com", 1), (None, 1), ("few.com", None)]
    outcomes = spark.createDataFrame(seen, "host string, bad int")
    hosts = spark.createDataFrame([(h,) for h in ("bad.spam.net", "new.spam.net", "other.spam.net", "good.com", "few.com", "x.de")], "host string")
    found = {r.host: r for r in url_reputation.reputations(hosts, outcomes).collect()}
    assert found["bad.spam.net"].bad_bound > 0.5
    assert found["bad.spam.net"].bad_rate - found["bad.spam.net"].bad_bound < found["other.spam.net"].bad_rate - found["other.spam.net"].bad_bound
    assert 0.02 < found["good.com"].bad_rate < 0.1 and found["few.com"].bad_rate < 0.9
    assert found["other.spam.net"].n == 0 and found["other.spam.net"].bad_rate > 0.5 > found["x.de"].bad_rate
    pages = spark.createDataFrame([(1, "http://bad.spam.net/x"), (2, "http://good.com/x")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_reputation.judge(pages, outcomes).collect()} == {1: "block", 2: "allow"}


# toxicity


def brute_best(model, word):
    """The best reading of a word over every combination of choices."""
    readings = [("", 0.0)]
    for at in range(len(word)):
        readings = [(s + x, c + cost) for s, c in readings for x, cost in toxicity.Restorer.choices(word, at)]

    def score(text, cost):
        ids = [0, 0, 0, *[toxicity.symbol_of(c) for c in text], 0]
        code = lambda g: ((g[0] * 28 + g[1]) * 28 + g[2]) * 28 + g[3]
        return sum(float(model[code(ids[i : i + 4])]) for i in range(len(ids) - 3)) - cost

    return max(score(*r) for r in readings), score


def test_viterbi_finds_the_best_reading(spark):
    counts = toxicity.four_grams([r.text or "" for r in corpus(spark).collect()])
    model = toxicity.smoothed(counts.astype(float))
    assert np.allclose(np.exp(model.astype(float)).reshape(-1, 28).sum(axis=1), 1, atol=1e-3)
    restorer = toxicity.Restorer(model)
    for word in ("1d10t", "st00pid", "l0o5er", "a1b2", "aaabb", "i.d.i", "x*y!", "$@$"):
        best, score = brute_best(model, word)
        decoded = restorer.decode(word)
        costs = [("", 0.0)]
        for at in range(len(word)):
            costs = [(s + x, c + k) for s, c in costs for x, k in restorer.choices(word, at)]
        assert math.isclose(max(score(t, c) for t, c in costs if t == decoded), best, rel_tol=1e-5)


def test_restored_words(spark):
    model = toxicity.language_model(corpus(spark, "/root/testdata/sf0.01"))
    restorer = toxicity.Restorer(model)
    plain = {"idiot": ("1d10t", "iiidiot", "i.d.i.o.t", "id!ot"), "moron": ("m0ron", "m-o-r-o-n", "morrron"), "trash": ("tr@sh",)}
    for word, ways in plain.items():
        assert [restorer.restore(w) for w in ways] == [word] * len(ways)
    assert [restorer.restore(w) for w in ("hello", "hello,", '"été!"', "4.0", "", "###")] == ["hello", "hello", "été", "4.0", "", ""]
    assert toxicity.spaced_out("a word i d 1 0 t here".split()) == ["id10t", "d10t", "id10"]


def test_gram_counts():
    counts = toxicity.four_grams(["Ab, ab", "é"])
    code = lambda *s: ((s[0] * 28 + s[1]) * 28 + s[2]) * 28 + s[3]
    assert counts[code(0, 0, 0, 1)] == 2 and counts[code(0, 0, 1, 2)] == 2 and counts[code(0, 1, 2, 0)] == 2
    assert counts[code(0, 0, 0, 27)] == 1 and counts[code(0, 0, 27, 0)] == 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = corpus(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    want = {r.doc_id: r.toxic for r in labels.collect()}
    right = Counter()
    for r in toxicity.score(clashing(docs), model).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in want:
            right[want[r.doc_id] == r.predicted] += 1
    assert right[True] > 0.95 * right.total() and right.total() > 50


def test_tampered_toxic_texts_score_high(spark):
    sf = "/root/testdata/sf0.01"
    docs = corpus(spark, sf)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(1, "you 1d10t", "en", "a", None), (2, "such a m 0 r 0 n he is", "en", "a", None), (3, "hello there", "en", "a", None)]
    rows += [(4, None, None, None, None), (None, "", None, None, None)]
    found = {r.doc_id: r for r in toxicity.score(documents(spark, rows), model).collect()}
    assert found[1].score > 0.5 and found[2].score > 0.5 and found[3].score < 0.2
    assert found[4].score == found[None].score < 0.5 and found[1].n_restored == 1


def test_labels_may_be_odd(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 1), (2, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, odd):
        scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "one two three")], ITEMS)
    assert decontamination.contaminated(nothing, items).collect() == []
    assert decontamination.contaminated(documents(spark), items.limit(0)).collect() == []
    assert decontamination.without_leaks(documents(spark), items.limit(0)).count() == documents(spark).count()
    assert license_scan.scan(nothing).collect() == []
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(nothing, toxicity.learn(nothing, labels)).collect() == []
