"""The pipeline against a plain version of its stages, and each stage on rows that try its edges."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, SF, clashing, corpus, documents
from tests.llm.test_search_ops import plain_leaks
from tests.llm.test_similar_texts import plain_roots
from tests.llm.test_text_ops import check_packing, plain_lines, plain_quality
from tidemark.llm import quality_rules


class Row:
    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text


def plain_boilerplate(rows, hosts):
    """Ids of documents that lose over nine tenths of their lines' characters to lines common on their host."""
    strip = lambda x: x.strip(quality_rules.SPACES).lower()
    own = {r.doc_id: [strip(x) for x in (r.text or "").split("\n") if strip(x)] for r in rows}
    holders: dict = {}
    for d, lines in own.items():
        for line in set(lines):
            holders.setdefault((hosts[d], line), set()).add(frozenset(lines))
    common = {k for k, v in holders.items() if len(v) >= 50}
    gone = set()
    for d, lines in own.items():
        lost = sum(len(x) for x in lines if (hosts[d], x) in common)
        if lost > 0.9 * sum(map(len, lines)):
            gone.add(d)
    return gone


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_run_equals_the_plain_version(spark, sf_dir):
    docs, items = corpus(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    gone = plain_boilerplate(docs, {r.doc_id: r.source for r in docs})
    rows = [Row(r.doc_id, r.text) for r in docs if not plain_quality(r)[-1] and r.doc_id not in gone]
    # ids are distinct here, so the first occurrence of a line is that of the smallest id
    lines = plain_lines(rows, 10, keep_first=True)
    rows = [Row(r.doc_id, lines[r.doc_id, r.text][2]) for r in rows]
    rows.sort(key=lambda r: r.doc_id)
    rows = [r for i, (r, root) in enumerate(zip(rows, plain_roots([r.text for r in rows]), strict=True)) if i == root]
    leaked = {d for d, _ in plain_leaks(rows, items)}
    rows = [r for r in rows if r.doc_id not in leaked]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(found, rows, 1024)
    assert {r.doc_id for r in found} == {r.doc_id for r in rows} and 0 < len(rows) < len(docs)


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for rows in (documents(spark), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            given = clashing(rows)
            out = stage(spark, given, SF)
            if name != "packing":
                assert out.columns == given.columns
            assert out.count() <= max(given.count(), 1) * 30


def test_line_stage_keeps_first_occurrences(spark):
    shared = "this line stands in many documents and is kept where it comes first"
    rows = [(i, f"{shared}\nown line {i}", "en", "a", 3) for i in range(12)]
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, documents(spark, rows), SF).collect()}
    assert out[0].text == f"{shared}\nown line 0" and out[0].n_chars == len(out[0].text)
    assert all(out[i].text == f"own line {i}" for i in range(1, 12))
