"""Streaming ingest folds to the same graph as one batch, and replays add nothing."""

from skein import schema
from skein.operators.graph import Graph
from skein.sources.projection import product_log
from skein.streaming import ingest


def rows(graph):
    return sorted(map(tuple, graph.nodes.collect()), key=str), sorted((r.source, r.target, r.relation, r.confidence) for r in graph.edges.collect())


def test_stream_equals_batch(spark, sf, tmp_path):
    log = product_log(spark, sf)
    cut = log.approxQuantile("seq", [0.3, 0.7], 0)
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    bounds = [("seq < {0}", 0), ("seq >= {0} AND seq < {1}", 1), ("seq >= {1}", 2)]
    for where, i in bounds:
        log.filter(where.format(*cut)).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(schema.INGEST_LOG).option("recursiveFileLookup", "true").parquet(source)
        ingest.start(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(ingest.graph(spark, out)) == rows(Graph.from_log(log))
    last = spark.read.schema(schema.INGEST_LOG).parquet(f"{source}/2")
    ingest.append_batch(last, 2, out)
    assert rows(ingest.graph(spark, out)) == rows(Graph.from_log(log))
