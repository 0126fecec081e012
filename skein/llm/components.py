"""Connected components of an edge table, by alternating large-star and small-star.

Edges are (a, b) with a > b. Large-star links a vertex's larger neighbours to its
least neighbour, small-star its smaller ones; both keep the components, and the
alternation ends when every component is a star around its least vertex. Each
step is a pre-aggregated minimum, written, and a plain join that adaptive
execution can split, so a vertex with very many neighbours needs neither a list
of them nor one task for its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    linked = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of `edges` (a, b), component being its least vertex.

    Self-links are ignored; no edges give no rows.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = list(scratch.live.values())
    edges = scratch.write(edges, "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large = scratch.write(_large_star(edges, scratch), "large")
        after = scratch.write(_small_star(large, scratch), "edges")
        scratch.drop(*[x for x in scratch.live.values() if x is not after and not any(x is y for y in before)])
        edges, now = after, _mark(after)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
