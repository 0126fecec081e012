"""A graph as two DataFrames: ordered ingest, merge, erasure, lookups and degrees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import settle

HUB_PERCENT = 99
#: Threshold of a graph without nodes.
NO_HUBS = (1 << 63) - 1


def _first(column: str, keep: Column) -> Column:
    """The earliest value of `column` by seq among rows that `keep` admits."""
    return F.min_by(F.when(keep, F.col(column)), F.when(keep, F.col("seq")))


@dataclass(frozen=True)
class Graph:
    """nodes (id, label, kind, source) and edges (source, target, relation, confidence, seq).

    `tables` are those it is made of; their rows size the shuffles of what is written.
    `written` says that both are read from files, not made again each time.
    """

    nodes: DataFrame
    edges: DataFrame
    tables: tuple[DataFrame, ...] = ()
    written: bool = False

    @cached_property
    def rows(self) -> int:
        """Rows of `tables`; 0, which leaves shuffles to Spark, without any."""
        return reduce(DataFrame.union, [t.select(F.lit(1)) for t in self.tables]).count() if self.tables else 0

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))

    @staticmethod
    def from_log(log: DataFrame) -> Graph:
        """Folds an ordered log of node, edge and forget events into a graph.

        A label is the id where an edge named the node first, otherwise the first
        non-empty one; kind and source are the first that are given. A forget
        hides what came before it for that id. Equal edges keep the highest
        confidence (the least tag) and their first place. One aggregation over
        nodes and one over edges; seq decides order, not partitioning.
        """
        forgets = log.filter("op = 'forget'").groupBy("id").agg(F.max("seq").alias("gone"))
        named = log.filter("op = 'node'").select("id", "seq", "label", "kind", F.col("node_source").alias("source"), F.lit(False).alias("bare"))
        links = log.filter("op = 'edge'")
        blank = F.lit(None).cast("string")
        ends = links.select(F.explode(F.array("source", "target")).alias("id"), "seq").select("id", "seq", blank.alias("label"), blank.alias("kind"), blank.alias("source"), F.lit(True).alias("bare"))
        events = named.unionByName(ends).join(forgets, "id", "left").filter("gone IS NULL OR seq > gone")
        nodes = events.groupBy("id").agg(
            F.min_by("bare", "seq").alias("bare"), _first("label", F.col("label") != "").alias("label"), _first("kind", F.col("kind") != "").alias("kind"), _first("source", F.col("source").isNotNull()).alias("node_source")
        )
        nodes = nodes.select("id", F.when(F.col("bare"), F.col("id")).otherwise(F.coalesce("label", F.lit(""))).alias("label"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("node_source").alias("source"))
        by_source = forgets.select(F.col("id").alias("source"), F.col("gone").alias("gone_s"))
        by_target = forgets.select(F.col("id").alias("target"), F.col("gone").alias("gone_t"))
        alive = links.select("source", "target", "relation", "confidence", "seq").join(by_source, "source", "left").join(by_target, "target", "left")
        alive = alive.filter(F.col("seq") > F.greatest(F.coalesce("gone_s", F.lit(-1)), F.coalesce("gone_t", F.lit(-1))))
        return Graph(nodes, _deduped(alive))

    def merge(self, other: Graph) -> Graph:
        """This graph, then the other one's nodes, then its edges; what is given here wins."""
        mine = self.nodes.withColumn("seq", F.lit(0))
        theirs = other.nodes.withColumn("seq", F.lit(1))
        both = mine.unionByName(theirs).repartition("id")  # dealt first, as values of strings are gathered by sorting and a scan would sort all it reads
        nodes = both.groupBy("id").agg(_first("label", F.col("label") != "").alias("label"), _first("kind", F.col("kind") != "").alias("kind"), _first("source", F.col("source").isNotNull()).alias("source"))
        nodes = nodes.select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("kind", F.lit("")).alias("kind"), "source")
        ends = other.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
        nodes = nodes.unionByName(ends.select("id", F.col("id").alias("label"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("source")))
        last = self.edges.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_shift"))
        shifted = other.edges.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("_shift")).drop("_shift")  # one row
        return Graph(nodes, _deduped(self.edges.unionByName(shifted)), self.tables + other.tables)

    def forget(self, ids: DataFrame) -> Graph:
        """Without the nodes in `ids` (id) and all edges from or to them; unknown ids change nothing."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), edges.select("source", "target", "relation", "confidence", "seq"), self.tables)

    def settled(self) -> Graph:
        """This graph with both tables written once, for operators that read them several times."""
        return Graph(settle(self.nodes, self.rows), settle(self.edges, self.rows), self.tables, True)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def node_count(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("node_count"))

    def node_ids(self) -> DataFrame:
        return self.nodes.select("id")

    def neighbors(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("source") == node_id)

    def neighbors_of(self, ids: DataFrame) -> DataFrame:
        """Out-edges of many nodes at once: one join instead of point lookups."""
        return self.edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")

    def fact_views(self, provenance: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """(id, label, kind, source, edges, envelopes): a node with its sorted out-edges and envelopes.

        With `ids`, edges and envelopes of other nodes go before anything is gathered.
        """
        nodes, edges = self.nodes, self.edges
        if ids is not None:
            wanted = ids.select("id").distinct()
            nodes = nodes.join(wanted, "id", "left_semi")
            edges = edges.join(wanted.withColumnRenamed("id", "source"), "source", "left_semi")
            provenance = provenance.join(wanted.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
        out = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target", "relation", "confidence"))).alias("edges"))
        kept = provenance.groupBy(F.col("subject_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "asserting_agent", "basis", "algorithm"))).alias("envelopes"))
        none_e, none_p = (F.array().cast(frame.schema[c].dataType) for frame, c in ((out, "edges"), (kept, "envelopes")))
        return nodes.join(out, "id", "left").join(kept, "id", "left").withColumns({"edges": F.coalesce("edges", none_e), "envelopes": F.coalesce("envelopes", none_p)})

    def degrees(self) -> DataFrame:
        """(id, degree) of every node: edges from and to it, a self-link counting twice."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))

    def hub_threshold(self, degrees: DataFrame | None = None) -> DataFrame:
        """(hub_threshold): the degree at place min(floor(0.99 n), n - 1) of the sorted degrees, at least 1.

        It is read from the histogram of degrees, so no sort of all nodes is needed.
        `degrees` saves counting them again.
        """
        histogram = (settle(self.degrees(), self.rows) if degrees is None else degrees).groupBy("degree").agg(F.count("*").alias("c"))
        lists = histogram.agg(F.array_sort(F.collect_list(F.struct("degree", "c"))).alias("h"), F.sum("c").alias("n"))
        at = F.least(F.floor(F.col("n") * HUB_PERCENT / 100), F.col("n") - 1)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("d"))
        found = F.aggregate("h", start, lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["d"], F.when(a["seen"] + x["c"] > at, x["degree"])).alias("d")), lambda a: a["d"])
        return lists.select(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(NO_HUBS)).otherwise(F.greatest(found, F.lit(1))).cast("long").alias("hub_threshold"))


def _deduped(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "relation").agg(F.min("confidence").alias("confidence"), F.min("seq").alias("seq"))
