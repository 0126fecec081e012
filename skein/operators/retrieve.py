"""A question to a small, ranked, budgeted piece of the graph as text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import score_text, tokens_of
from ..session import settle
from .graph import Graph
from .traverse import reach

TOP, GAP = 3, 0.25
ELLIPSIS = "…\n"


def term_weights(graph: Graph, question: str) -> list[tuple[str, float]]:
    """(term, inverse document frequency) of the question's terms, repeats kept."""
    terms = tokens_of(question)
    if not terms:
        return []
    distinct = sorted(set(terms))
    label = F.lower("label")
    counts = graph.nodes.agg(F.count("*").alias("n"), *[F.count_if(F.contains(label, F.lit(t))).alias(f"t{i}") for i, t in enumerate(distinct)]).first()
    if not counts.n:
        return []
    weight = {t: max(math.log(counts.n / max(1, counts[f"t{i}"])), 0.0) + 1.0 for i, t in enumerate(distinct)}
    return [(t, weight[t]) for t in terms]


def seed_scores(graph: Graph, question: str) -> DataFrame:
    """(id, score) of the nodes whose label matches: 3, 2 or 1 (equal, prefix, inside) times each term's weight."""
    label, total = F.lower("label"), F.lit(0.0)
    for term, weight in term_weights(graph, question):
        t = F.lit(term)
        total = total + F.when(label == t, 3 * weight).when(F.startswith(label, t), 2 * weight).when(F.contains(label, t), weight).otherwise(0.0)
    return graph.nodes.select("id", total.alias("score")).filter("score > 0")


def seeds(graph: Graph, question: str, top: int = TOP, gap: float = GAP) -> DataFrame:
    """(id, score, rank): the best `top` nodes (ties by id) that reach `gap` of the best score."""
    best = seed_scores(graph, question).orderBy(F.desc("score"), "id").limit(top)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")  # `top` rows
    ranked = best.select("id", "score", (F.row_number().over(order) - 1).alias("rank"), F.max("score").over(Window.partitionBy(F.lit(0))).alias("most"))
    return ranked.filter(F.col("score") >= gap * F.col("most")).drop("most")


def lines(graph: Graph, reached: DataFrame) -> DataFrame:
    """(depth, path, k, target, relation, line) of all nodes reached (k 0) and their edges among them (k 1)."""
    label = graph.nodes.select("id", "label", "kind")
    own = reached.join(label, "id", "left")
    head = F.concat(F.lit("["), F.when(F.col("kind") == "", F.lit("node")).otherwise(F.col("kind")), F.lit("] "), F.col("label"), F.lit("\n"))
    nodes = own.select("depth", "path", F.lit(0).alias("k"), F.lit("").alias("target"), F.lit("").alias("relation"), F.coalesce(head, F.lit("")).alias("line"))
    inside = graph.edges.join(reached.select(F.col("id").alias("target")), "target", "left_semi").join(own.filter("label IS NOT NULL").select(F.col("id").alias("source"), "depth", "path"), "source")
    named = inside.join(label.select(F.col("id").alias("target"), F.col("label").alias("to")), "target", "left")
    text = F.concat(F.lit("  → "), F.col("relation"), F.lit(" "), F.coalesce("to", "target"), F.lit(" ("), score_text(F.col("confidence")), F.lit(")\n"))
    return nodes.unionByName(named.select("depth", "path", F.lit(1).alias("k"), "target", "relation", text.alias("line")))


ORDER = ("depth", "path", "k", "target", "relation")


def rendered(all_lines: DataFrame, budget: int) -> DataFrame:
    """(at, line): the lines that start below `budget` bytes, then an ellipsis if a node starts at or above it.

    Lines of dangling nodes are empty: they take no place, but such a node can
    still start at or above the budget. Of lines with at least one byte only
    the first budget + 1 can matter; the running sum is over those, and those
    before the last node tell whether it starts at or above the budget.
    """
    place = F.struct(*ORDER)
    first = all_lines.filter("line <> ''").orderBy(*ORDER).limit(budget + 1)
    order = Window.partitionBy(F.lit(0)).orderBy(*ORDER)  # budget + 1 rows at most
    before = F.coalesce(F.sum(F.octet_length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.select((F.row_number().over(order) - 1).cast("long").alias("at"), "line", before.alias("before"))
    kept = placed.filter(F.col("before") < budget).select("at", "line")
    last = all_lines.filter("k = 0").agg(F.max(place).alias("last"))
    ahead = last.join(first.select(place.alias("place"), F.octet_length("line").alias("bytes")), F.col("place") < F.col("last"), "left")  # one row with budget + 1 rows
    flag = ahead.groupBy("last").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).filter(F.col("last").isNotNull() & (F.col("bytes") >= budget))
    return kept.unionByName(flag.select(F.lit((1 << 62)).cast("long").alias("at"), F.lit(ELLIPSIS).alias("line")))


def answer_lines(graph: Graph, question: str, depth: int = 3, budget: int = 4000) -> DataFrame:
    """(at, line) of the answer to a question; no rows if no label matches."""
    degrees = settle(graph.degrees(), graph.rows)
    hub = graph.hub_threshold(degrees).first().hub_threshold
    return rendered(settle(lines(graph, reach(graph, seeds(graph, question), depth, degrees, hub)), graph.rows), budget)


def answer(graph: Graph, question: str, depth: int = 3, budget: int = 4000) -> DataFrame:
    """(text): the answer in one row; empty text if no label matches."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "")
    return answer_lines(graph, question, depth, budget).agg(joined.alias("text"))
