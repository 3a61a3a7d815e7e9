"""Collocations against plain counting; the registered query has its SQL twin besides."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import DOCS, clashing, corpus, documents
from tidemark.llm import collocations

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, longest=3, least=10, share=50, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    out = []
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        inside = any(
            100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (of, q), f in candidates.items()
            if of == lang and len(q) > len(p)
        )
        if not inside:
            cuts = []
            for k in range(1, len(p)):
                x, y = counts[lang, p[:k]], counts[lang, p[k:]]
                cuts.append((1_000_000 * a * a // (x * y), k, x, y))
            score, _, x, y = min(cuts)
            out.append((lang, " ".join(p), a, x, y, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, rank, before = [], 0, None
    for lang, *rest in out:
        rank = rank + 1 if lang == before else 1
        before = lang
        if first is None or rank <= first:
            ranked.append((lang, rank, *rest))
    return ranked


def found(docs, **limits):
    return sorted(tuple(r[n] for n in NAMES) for r in collocations.collocations(docs, **limits).collect())


def invented(n, seed):
    rng = random.Random(seed)
    words = [*"abcdefgh", "The", "É", "new", "york", "city", "x\x00y", "\x1cz", "　"]
    joins = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "; ", "\x0b", "\r\n", " ! "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(120)))
        text += "new york city hall " * rng.randrange(3)
        rows.append((rng.choice([i, None]), rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, "und"]), "s", None))
    return rows


@pytest.mark.parametrize("limits", [{}, {"longest": 2}, {"longest": 4, "least": 4}, {"least": 3, "share": 90, "first": 7}, {"longest": 1}])
def test_against_plain_counting(spark, limits):
    rows = invented(150, 4)
    rows += rows[:20]
    want = plain([(r[2], r[1]) for r in rows], **limits)
    assert found(documents(spark, rows), **limits) == sorted(want)
    assert limits.get("longest") == 1 or len(want) > 7


def test_long_texts_are_cut_without_loss_and_without_counting_twice(spark):
    rows = invented(60, 5)
    text = " ".join(r[1] or "" for r in rows) + " " + "no end of words here " * 300
    want = plain([("en", text), ("de", text)])
    docs = documents(spark, [(1, text, "en", "s", None), (1, text, "de", "s", None)])
    for at_once in (50, 999, 10_000):
        assert found(docs, at_once=at_once) == sorted(want)


def test_a_full_sieve_loses_nothing(spark):
    rows = invented(80, 6)
    want = sorted(plain([(r[2], r[1]) for r in rows], least=3))
    assert found(documents(spark, rows), least=3, bits=64) == want == found(documents(spark, rows), least=3)


def test_counts_past_64_bits():
    """Scores are whole numbers of any size."""
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_002
    assert 1_000_000 * a * a > 2**64 and 1_000_000 * a * a // (left * right) == 999_999


def test_a_first_word_that_fills_many_ranges(spark):
    """Extensions of one word are spread over ranges, and all of them know its count."""
    text = ". ".join(f"the w{i} v{i}" for i in range(400))
    docs = documents(spark, [(i, text, "en", "s", None) for i in range(10)])
    out = collocations.collocations(docs, first=None).collect()
    assert len(out) == 400 and {(r.phrase.split()[0], r.a, r.l, r.r, r.n) for r in out} == {("the", 10, 10, 10, 12_000)} or {
        (r.a, r.n) for r in out
    } == {(10, 12_000)}
    assert sorted((tuple(r[n] for n in NAMES) for r in out)) == sorted(plain([("en", text)] * 10, first=None))


def test_edges(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    rows = documents(spark).collect()
    docs = clashing(documents(spark)).withColumnRenamed("kept", "phrase")
    assert found(docs, least=2) == sorted(plain([(r.lang, r.text) for r in rows], least=2))


def test_corpus(spark):
    docs = corpus(spark)
    want = plain([(r.lang, r.text) for r in docs.collect()])
    assert found(docs) == sorted(want) and want
