"""Token counts, packing, line dedup, near-duplicates and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, as_rows, clashing, corpus, documents
from tidemark.llm import line_dedup, near_dups, packing, quality_rules, queries, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


@pytest.fixture(params=["edges", "corpus"])
def docs(request, spark):
    return documents(spark) if request.param == "edges" else corpus(spark)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# token counts


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in docs.collect():
        n = len(model.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 300))
    assert as_rows(token_counts.count_tokens(clashing(docs), PIECES, limit=300)) == sorted(want, key=repr)


def test_token_counts_of_odd_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.TokenCounter(PIECES)
    rng = random.Random(5)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\n\n", "é", "①", "▁", "<s>", "\t", "!!!", "0", "=", "==", "aaaa", "\r", "𝒳", "x\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["=" * 777, " " * 300, "ab" * 3000, "\n", "\na", " \n"]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


# packing


def check_packing(found, docs, size):
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return sequences


@pytest.mark.parametrize("size", [64, 1024])
def test_packing(docs, size):
    found = packing.pack_documents(clashing(docs), queries.BYTE_BPE, size=size).collect()
    sequences = check_packing(found, docs.collect(), size)
    bound = -(-sum(r.length for r in found) // size)
    assert len(sequences) <= bound * 1.02 + 1


def test_encoders_agree():
    both = packing.Encoder(*queries.BYTE_BPE)

    def same(text):
        return np.frombuffer(both.encode(text), dtype="<u4").tolist() == both.tokenizer.encode(text, add_special_tokens=False).ids

    for code in range(ord(packing.FAST_UP_TO) + 10):
        c = chr(code)
        assert same(f"a{c}b {c}{c} 1{c}2 '{c}'s{c}"), hex(code)
    assert same("a <|endoftext|> b") and same("") and same("\n \n")


def test_patterns_fit():
    rng = np.random.default_rng(2)
    histogram = rng.integers(0, 50, 257)
    histogram[0] = 0
    plan = packing.pack(histogram, 256)
    assert (plan.left[1:] == 0).all() and (plan.next_piece[1:] == histogram[1:]).all()
    assert plan.sequences <= 1.01 * (histogram * np.arange(257)).sum() / 256 + 1
    patterns = packing.full_patterns(np.arange(1, 257), 256)
    assert (patterns.sum(axis=1) == 256).all() and len(np.unique(patterns, axis=0)) == len(patterns)
    assert packing.pack(np.zeros(257, dtype=np.int64), 256).sequences == 0


# line dedup


def plain_lines(rows, min_docs, min_chars=1, keep_first=False):
    """(doc_id, text) to (n_lines, kept text), documents being distinct (doc_id, text)."""
    distinct = {(r.doc_id, r.text) for r in rows}
    key = lambda line: lower(line.strip(WS))
    holders = defaultdict(set)
    for d, t in distinct:
        for line in (t or "").split("\n"):
            holders[key(line)].add((d, t))
    common = {k for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    seen = set()

    def order(x):
        return (x[0] is not None, x[0] or 0)

    for d, t in sorted(distinct, key=order):
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            if k in common and not (keep_first and k not in seen):
                continue
            seen.add(k)
            kept.append(line)
        out[d, t] = (len(lines), len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_line_dedup(docs, min_docs):
    rows = docs.collect()
    want = plain_lines(rows, min_docs)
    bitmaps = line_dedup.keep_bitmaps(clashing(docs), min_docs)
    cut = line_dedup.apply_bitmaps(clashing(docs), bitmaps, dropped="gone").collect()
    assert len(cut) == len(rows)
    expected = Counter()
    for r in rows:
        n, kept, text = want[r.doc_id, r.text]
        expected[(r.doc_id, text if r.text is not None else None, n - kept, r.lang, "taken")] += 1
    assert Counter((r.doc_id, r.text, r.gone, r.lang, r.n_lines) for r in cut) == expected


def test_line_dedup_in_many_ranges(spark):
    """Lines that cross ranges, a line in a third of the documents, first occurrences."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lines = [f"shared {rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))] + [f"own {i}"]
        if i % 3 == 0:
            lines.insert(0, " HOT line\t")
        rows.append((i, "\n".join(lines), "en", "a", None))
    docs = spark.createDataFrame(rows, DOCS)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for min_docs, first in ((10, False), (2, False), (2, True), (10, True), (130, False)):
            bitmaps = line_dedup.keep_bitmaps(docs, min_docs, keep_first=first)
            found = {r.doc_id: r.text for r in line_dedup.apply_bitmaps(docs, bitmaps).collect()}
            want = plain_lines(docs.collect(), min_docs, keep_first=first)
            if first:  # which document is first is by (doc_id, text_hash), ids are distinct here
                assert sorted(found) == sorted(d for d, _ in want)
            assert found == {d: v[2] for (d, _), v in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_op10_digest(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op10_line_dedup(spark, str(tmp_path)).collect():
        assert r.n_dropped == 0 and len(r.kept_sha256) == 64
        if r.doc_id in (3, 4):
            assert (r.n_lines, r.kept_sha256) == (1, hashlib.sha256(b"").hexdigest())


# near-duplicates


def plain_print(text, width=3):
    w = lower(text or "").encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", w) if x]
    parts = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    prints = [plain_print(r.text) for r in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
        low[find(i)] = find(first[p]) if find(first[p]) < find(i) else find(i)
        for q, j in first.items():
            if (p ^ q).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[find(i)].append(r.doc_id)
    return [(r.doc_id, f"{p:016x}", min(ids[find(i)], default=None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]


def test_near_dups(docs):
    found = near_dups.groups(clashing(docs)).withColumn("fingerprint", near_dups.hex_print("print"))
    assert as_rows(found, "doc_id", "fingerprint", "component_id") == sorted(plain_groups(docs.collect()), key=repr)


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for flips in range(4):
        part = slice(flips * 1000, flips * 1000 + 1000)
        for _ in range(flips):
            b[part] ^= np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64)
    filed, asked = defaultdict(set), defaultdict(set)
    for store, prints, nearby in ((filed, a, False), (asked, b, True)):
        rows, keys = near_dups.segment_keys(prints.view(np.int64), nearby)
        for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
            store[r].add(k)
    assert all(filed[i] & asked[i] for i in range(4000))
    _, patterns, counts = near_dups.golay_tables()
    assert sorted(Counter(counts.tolist()).items()) == [(1, 277), (6, 1771)] and patterns.shape == (2048, 6)


def test_links_are_all_links(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << b
            prints.add(x)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    want = {(p, q) for i, p in enumerate(signed) for q in signed[i + 1 :] if ((p ^ q) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "print bigint")
    assert {tuple(r) for r in near_dups.links(df).collect()} == want and len(want) > 100


def test_one_of_each(docs):
    rows = docs.collect()
    kept = near_dups.one_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns
    kept = kept.collect()
    groups = {}
    for r, (_, _, component) in zip(rows, plain_groups(rows), strict=True):
        groups.setdefault(component, []).append(r)
    assert len(kept) == len(groups)
    assert Counter(r.doc_id for r in kept) == Counter(list(groups))


# quality rules


def plain_quality(r):
    text = r.text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(WS)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (
        r.doc_id,
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def test_quality_counts(docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert as_rows(quality_rules.judge(clashing(docs)), *names) == sorted(map(plain_quality, docs.collect()), key=repr)


def test_boilerplate_is_not_copies(spark):
    """A menu above different articles is taken out; copies of an article are no boilerplate."""
    body = "some words of an article that goes on for a while, number {}"
    menu = " ".join(f"entry{i}" for i in range(50))
    rows = [(i, menu + "\n" + body.format(i), "en", "a", None) for i in range(60)]
    rows += [(100 + i, menu + "\nshort one {}".format(i % 7), "en", "a", None) for i in range(10)]
    rows += [(200 + i, body.format("copy") + "\nand a second line", "en", "a", None) for i in range(80)]
    rows += [(300, menu + "\n" + body.format(1), "en", "other host", None)]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS), line_docs=20).collect()}
    assert all(found[i].removed_chars > 300 and found[i].kept for i in range(60))
    assert not any(found[100 + i].kept for i in range(10))
    assert all(found[200 + i].removed_chars == 0 and found[200 + i].kept for i in range(80))
    assert found[300].removed_chars == 0 and found[300].kept


def test_keep_good(docs):
    kept = quality_rules.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns
    want = Counter(r.doc_id for r in quality_rules.judge(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_empty_tables(nothing):
    assert token_counts.count_tokens(nothing, PIECES).collect() == []
    assert packing.pack_documents(nothing, queries.BYTE_BPE).collect() == []
    assert line_dedup.keep_bitmaps(nothing).collect() == []
    assert line_dedup.apply_bitmaps(nothing, line_dedup.keep_bitmaps(nothing)).collect() == []
    assert near_dups.groups(nothing).collect() == [] and near_dups.one_of_each(nothing).collect() == []
    assert quality_rules.judge(nothing).collect() == [] and quality_rules.keep_good(nothing).collect() == []
