"""Breadth-first reach, shortest paths and fixpoint propagation by bounded driver loops.

Discovery order needs no running counter: a node's place is the path of ids that
first reached it, and paths of one level compare like queue positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Grown, settle
from .graph import Graph

MEETS = {"min": (F.min, F.least), "max": (F.max, F.greatest), "bit_and": (F.bit_and, lambda a, b: a.bitwiseAND(b)), "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b))}


def reach(graph: Graph, seeds: DataFrame, depth: int, degrees: DataFrame | None = None, hub: int | None = None) -> DataFrame:
    """(id, depth, path): what is reached from seeds (id, rank) within `depth` steps along edges.

    Nodes whose degree is above `hub` are reached but not passed through. path
    orders the nodes of one depth as a queue would have found them. A level joins its
    nodes, which are few as a rule, to the written edges: these are not dealt then,
    and equal steps do no harm, as a node keeps its least path.
    """
    step = graph.edges.select(F.col("source").alias("id"), F.col("target"))
    if degrees is None and hub is not None:
        degrees = settle(graph.degrees(), graph.rows)
    if not graph.written:
        step = settle(step, graph.rows)  # read once a level, instead of the graph's own plan
    known = settle(seeds.select("id", F.lit(0).alias("depth"), F.array(F.format_string("%010d", F.col("rank").cast("long"))).alias("path")))
    front, known = known, Grown(known)
    for d in range(1, depth + 1):
        passed = front.select("id", "path")
        if hub is not None:
            passed = settle(passed.join(degrees.filter(F.col("degree") <= hub).select("id"), "id"), graph.rows)
        found = passed.join(step, "id").groupBy("target").agg(F.min("path").alias("path"))
        fresh = found.withColumnRenamed("target", "id").join(known.frame().select("id"), "id", "left_anti")
        front = settle(fresh.select("id", F.lit(d).alias("depth"), F.concat("path", F.array("id")).alias("path")), graph.rows)
        if front.isEmpty():
            break
        known.add(front)
    return known.frame()


def shortest_path(graph: Graph, start: str, goal: str) -> DataFrame:
    """(at, id): the nodes of a shortest directed path, in order; no rows if there is none.

    It takes a round a step, until the goal is found or nothing new is.
    """
    spark = graph.nodes.sparkSession
    both = [r.id for r in graph.nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().collect()]  # two rows at most
    empty = spark.createDataFrame([], "at long, id string")
    if start not in both or goal not in both:
        return empty
    front = settle(spark.createDataFrame([(start, [start])], "id string, path array<string>"))
    known = Grown(front.select("id"))
    step = settle(graph.edges.select(F.col("source").alias("id"), "target").distinct())
    while not front.isEmpty():
        done = front.filter(F.col("id") == goal)
        if not done.isEmpty():
            return done.select(F.posexplode("path").alias("at", "id")).select(F.col("at").cast("long").alias("at"), "id")
        found = front.join(step, "id").groupBy("target").agg(F.min("path").alias("path"))
        fresh = found.withColumnRenamed("target", "id").join(known.frame(), "id", "left_anti")
        front = settle(fresh.select("id", F.concat("path", F.array("id")).alias("path")))
        known.add(front.select("id"))
    return empty


def propagate(graph: Graph, seed: Column, meet: str = "min", edge_filter: Column | None = None, most_passes: int | None = None) -> DataFrame:
    """(id, value): `seed` (of a node's columns) carried along admitted edges until nothing changes.

    Each pass folds the sources' values of the pass before into the targets by an
    idempotent, commutative, associative `meet`, so equal links do no harm, and only
    sources that changed in that pass send theirs again; dangling edge ends are
    passed over. It stops when no node with a link of its own changed, or after
    n + 1 passes.
    """
    gather, join = MEETS[meet]
    admitted = graph.edges if edge_filter is None else graph.edges.filter(edge_filter)
    links = settle(admitted.select("source", "target"), graph.rows)
    senders = links.select(F.col("source").alias("id")).distinct().withColumn("sends", F.lit(True))
    values = settle(graph.nodes.select("id", seed.alias("value")).join(senders, "id", "left").withColumn("sends", F.col("sends").isNotNull()), graph.rows)
    passes = most_passes if most_passes is not None else values.count() + 1
    changed = values.filter("sends")
    for _ in range(passes):
        sent = links.join(changed.select(F.col("id").alias("source"), "value"), "source").groupBy(F.col("target").alias("id")).agg(gather("value").alias("arriving"))
        after = values.join(sent, "id", "left").withColumn("next", F.when(F.col("arriving").isNull(), F.col("value")).otherwise(join(F.col("value"), F.col("arriving"))))
        after = settle(after.select("id", F.col("next").alias("value"), "sends", (F.col("sends") & ~F.col("next").eqNullSafe(F.col("value"))).alias("changed")), graph.rows)
        values, changed = after.drop("changed"), after.filter("changed")
        if changed.isEmpty():
            break
    return values.select("id", "value")
