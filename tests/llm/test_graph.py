"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import graph


def plain_components(edges):
    low: dict = {}

    def find(i):
        while low.setdefault(i, i) != i:
            i = low[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    return {(i, find(i)) for i in low if find(i) != i}


def graphs():
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(-40, 40)]
    hubs = [(0, i) for i in range(1, 60)] + [(i, 1000) for i in range(100, 160)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    odd = [(5, 5), (7, 8), (8, 7), (7, 8), (2**62, -(2**62))]
    return {"chain": chain, "hubs": hubs, "random": some, "odd": odd, "none": []}


@pytest.mark.parametrize("name", graphs())
def test_components(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = plain_components(edges)
    assert sorted(tuple(r) for r in graph.component_roots(df).collect()) == sorted(want)
    # a table as it is, and edges after two rounds only, connect the same
    assert sorted(tuple(r) for r in graph.star_edges(df).collect()) == sorted(want)
    after = [tuple(r) for r in graph.star_edges(df, rounds=2).collect()]
    assert all(b < a for a, b in after) and len(after) == len(set(after))
    assert plain_components(after) == want and len(after) <= max(len(edges), len(want))


def test_a_round_shuffles_edges_few_times(spark):
    """Each shuffle of each round has as many tasks as there are partitions, and the driver keeps track of all of them."""
    edges = graph.written(spark.createDataFrame(graphs()["random"], "a bigint, b bigint"), "edges")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = graph._small_star(graph._large_star(edges))
        star.collect()
        plan = star._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # those whose tasks run: what is shuffled alike is reused
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(shuffles) <= 5, plan


def test_rounds_write_one_table_each(spark, monkeypatch):
    names = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.createDataFrame(graphs()["chain"], "a bigint, b bigint")
    graph.star_edges(df, rounds=2)
    assert len(names) == 2
