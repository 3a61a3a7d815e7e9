"""How many documents hold a line, where documents are mostly shared lines."""

from __future__ import annotations

import pytest

from tests.llm.helpers import documents
from tidemark.llm import quality_rules


@pytest.mark.parametrize("n_docs, shared", [(600, 40), (400, 20), (80, 60)])
def test_documents_of_mostly_shared_lines_are_counted_each(spark, n_docs, shared):
    menu = "\n".join(f"entry{i} leads{i} to{i} another{i} page{i}" for i in range(shared))
    rows = [(i, f"{menu}\nown line {i}", "en", "a", None) for i in range(n_docs)]
    docs = documents(spark, rows + rows[:5])
    counts = quality_rules.base_counts(docs, "source")
    found = [r.docs for r in quality_rules.frequent_lines(counts).collect()]
    assert found == [n_docs] * shared
    assert not any(r.kept or r.base_failed for r in quality_rules.judge(docs).collect())


def test_the_limit_does_not_grow_with_the_host(spark):
    """The same 55 documents are judged alike alone and among 6,000 others of their host."""
    menu = "\n".join(f"entry{i} leads{i} to{i} another{i} page{i}" for i in range(20))
    rows = [(i, f"{menu}\nown line {i}", "en", "a", None) for i in range(55)]
    others = [(1000 + i, f"document {i} has a line of ten or more words that is its own {i}", "en", "a", None) for i in range(6000)]
    for given in (rows, rows + others):
        found = quality_rules.judge(documents(spark, given)).where("doc_id < 55").collect()
        assert len(found) == 55 and not any(r.kept or r.base_failed for r in found)
