"""Connected components of an undirected graph held as an edge table.

Alternating star rounds: a large star points every neighbour above a node at the smallest node around
it, a small star does the same for the neighbours below.  The table never grows beyond its number
of edges, and chains shorten by a constant factor a round, so there are about log(nodes) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """a, b with b < a, some of them repeated."""
    both = edges.union(edges.select("b", "a"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: those of a large star, b < a.  The edge to the lowest neighbour stays, the others' ends move there."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    end = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
    return edges.join(lowest, "a").select(end.alias("a"), F.col("low").alias("b")).distinct()


def star_edges(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges a, b with b < a that connect what edges connects, after so many rounds, or after the last one that changes them.

    After the last one b is the smallest node of a's component.  edges is read several times, so it should be a table;
    direction, repeats and loops do not matter.
    """
    current, mark, done = edges.select("a", "b"), None, 0
    while rounds is None or done < rounds:
        done += 1
        current = written(_small_star(_large_star(current)), "edges")
        if rounds is None:
            now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if now == mark:
                break
            mark = now
    return current


def component_roots(edges: DataFrame) -> DataFrame:
    """node, root for every node that is not the smallest of its component.

    edges has bigint columns a and b; direction, repeats and loops do not matter.  Rounds go on until
    the table stops changing; each is written to the shared folder, so lineage stays short.
    """
    table = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    return star_edges(table).select(F.col("a").alias("node"), F.col("b").alias("root"))
