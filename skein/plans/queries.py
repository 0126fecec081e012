"""Registered graph queries: one for each operator, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators import provenance as P
from ..operators import retrieve as R
from ..operators import spectral, traverse
from ..operators import trust as T
from ..operators.graph import Graph
from ..operators.index import NodeIndex
from ..operators.signatures import MockScheme, Registry
from ..operators.trust import TrustStore, authorized, chained
from ..session import settle
from ..sources import artifact as A
from ..sources.projection import product_log, quantity_tag, star_graph, tables, trade_graph, turn_graph

QUESTION, DEPTH, BUDGET = "asia customer", 2, 4000
#: A question whose seeds are a customer and hubs, for reach and a budget that cuts.
WIDE, WIDE_DEPTH, WIDE_BUDGET = "customer 000000007", 3, 900


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_lines(spark, sf_dir)


def canonical_ids(spark, d):
    (customer,) = tables(spark, d, "customer")
    return customer.select("c_custkey", S.canonical(F.lit("Customer"), F.col("c_name")).alias("id"))


def product_collisions(spark, d):
    (part,) = tables(spark, d, "part")
    return part.groupBy(S.canonical(F.lit("product"), F.col("p_name")).alias("id")).agg(F.count("*").alias("parts")).filter("parts > 1")


def confidence_rubric(spark, d):
    (lineitem,) = tables(spark, d, "lineitem")
    tags = lineitem.groupBy(quantity_tag(F.col("l_quantity")).cast("int").alias("tag")).agg(F.count("*").alias("lines"))
    tag = F.col("tag")
    return tags.select("tag", "lines", S.confidence_name(tag).alias("name"), F.round(S.score(tag), 6).alias("score"), S.trust(tag).cast("int").alias("trust"), S.score_text(tag).alias("shown"))


def trust_levels(spark, d):
    edges = star_graph(spark, d).edges.filter("relation = 'supplies'")
    trust = S.trust(F.col("confidence"))
    return edges.groupBy("source").agg(F.min(trust).cast("int").alias("least"), F.max(trust).cast("int").alias("most"), F.count("*").alias("edges"))


def tokenize_labels(spark, d):
    nodes = star_graph(spark, d).nodes
    return nodes.select("id", F.posexplode(S.tokens(F.col("label"))).alias("at", "token")).select("id", F.col("at").cast("long").alias("at"), "token")


def node_upsert(spark, d):
    return Graph.from_log(product_log(spark, d)).nodes


def edge_upsert(spark, d):
    return Graph.from_log(product_log(spark, d)).edges.select("source", "target", "relation", "confidence", "seq")


def auto_endpoints(spark, d):
    return Graph.from_log(product_log(spark, d)).nodes.filter("label = id AND kind = ''").select("id")


def _blanked(spark, d) -> Graph:
    trade = trade_graph(spark, d)
    odd = F.expr("pmod(cast(right(id, 1) as int), 2) = 1")
    return Graph(trade.nodes.withColumn("label", F.when(odd, F.lit("")).otherwise(F.concat(F.lit("first "), "label"))), trade.edges)


def graph_merge(spark, d):
    merged = _blanked(spark, d).merge(star_graph(spark, d))
    return settle(merged.nodes.select("id", "label", "kind"), merged.rows)


def graph_merge_edges(spark, d):
    merged = _blanked(spark, d).merge(star_graph(spark, d))
    return settle(merged.edges.groupBy("relation").agg(F.count("*").alias("edges"), F.min("confidence").cast("int").alias("least")), merged.rows)


def forget_node(spark, d):
    graph = star_graph(spark, d)
    (supplier,) = tables(spark, d, "supplier")
    left = graph.forget(supplier.filter("s_suppkey % 3 = 0").select(S.canonical(F.lit("supplier"), F.col("s_name")).alias("id")))
    return left.nodes.select("id", "kind").unionByName(left.edges.select(F.concat_ws(" ", "source", "target").alias("id"), F.col("relation").alias("kind")))


def node_by_id(spark, d):
    return star_graph(spark, d).node("nation::nation_3")


def neighbors(spark, d):
    return star_graph(spark, d).neighbors("supplier::supplier_000000001").select("source", "target", "relation", "confidence")


def node_kinds(spark, d):
    return star_graph(spark, d).nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def node_count(spark, d):
    return star_graph(spark, d).node_count()


def node_ids(spark, d):
    return star_graph(spark, d).node_ids()


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Two envelopes for each nation, one for each region, signed by the mock scheme; some are spoilt."""
    nation, region = tables(spark, d, "nation", "region")
    none = F.array().cast("array<struct<identity:string,role:string,signature:binary>>")
    n = nation.select(S.canonical(F.lit("nation"), F.col("n_name")).alias("subject_id"), F.col("n_nationkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    r = region.select(S.canonical(F.lit("region"), F.col("r_name")).alias("subject_id"), F.col("r_regionkey").alias("k"), F.lit(0).alias("ord"))
    both = n.unionByName(r)
    k, o = F.col("k"), F.col("ord")
    rows = both.select(
        "subject_id", o.cast("long").alias("ord"), F.concat(F.lit("agent:"), k.cast("string")).alias("asserting_agent"), F.pmod(k + o, F.lit(7)).cast("int").alias("basis"),
        F.encode(F.concat(F.lit("parent"), k.cast("string")), "utf-8").alias("parent_hash"), F.when(k % 5 == 4, F.lit("mock-v9")).otherwise(F.lit("mock-v1")).alias("algorithm"), none.alias("attestations"),
    )
    return rows


def signed_envelopes(spark: SparkSession, d: str) -> DataFrame:
    scheme = MockScheme()

    @F.pandas_udf("binary")
    def sign(agent, payload):
        return agent.combine(payload, lambda a, p: scheme.sign(a, bytes(p)))

    rows = P.with_payload(envelopes(spark, d))
    good = sign("asserting_agent", "payload")
    key = F.substring_index("asserting_agent", ":", -1).cast("int")
    signature = F.when(key % 4 == 3, F.encode(F.lit("spoilt!!"), "utf-8")).otherwise(good)
    given = F.when(key % 6 == 5, F.array().cast(rows.schema["attestations"].dataType)).otherwise(F.array(F.struct(F.col("asserting_agent").alias("identity"), F.lit("agent-signs-action").alias("role"), signature.alias("signature"))))
    return rows.withColumn("attestations", given).drop("payload")


def fact_view(spark, d):
    graph = star_graph(spark, d)
    views = graph.fact_views(envelopes(spark, d))
    return views.select("id", "label", F.size("edges").cast("long").alias("n_edges"), F.get("edges", F.lit(0))["target"].alias("first_target"), F.size("envelopes").cast("long").alias("n_envelopes"))


def degree(spark, d):
    graph = star_graph(spark, d)
    return settle(graph.degrees(), graph.rows)


def hub_threshold(spark, d):
    return star_graph(spark, d).hub_threshold()


def seed_scores(spark, d):
    return R.seed_scores(star_graph(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"))


def seed_topk(spark, d):
    return R.seeds(star_graph(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bfs_reach(spark, d):
    graph = star_graph(spark, d).settled()
    degrees = settle(graph.degrees(), graph.rows)
    hub = graph.hub_threshold(degrees).first().hub_threshold
    return traverse.reach(graph, R.seeds(graph, WIDE), WIDE_DEPTH, degrees, hub).select("id", F.col("depth").cast("int").alias("depth"))


def render_lines(spark, d):
    return R.answer_lines(star_graph(spark, d).settled(), QUESTION, DEPTH, BUDGET)


def query_text(spark, d):
    return R.answer(star_graph(spark, d).settled(), WIDE, WIDE_DEPTH, WIDE_BUDGET)


def shortest_path(spark, d):
    """From the first to the last turn of the first conversation."""
    graph = turn_graph(spark, d)
    (turns,) = tables(spark, d, "conversations")
    first = turns.agg(F.min("conv_id").alias("c")).first().c
    ends = turns.filter(F.col("conv_id") == first).agg(F.min("turn").alias("a"), F.max("turn").alias("b")).first()
    return traverse.shortest_path(graph, f"turn::{first}_{ends.a}", f"turn::{first}_{ends.b}")


def propagate_trust(spark, d):
    """The least customer number (last two digits) that reaches each order and part."""
    graph = star_graph(spark, d)
    seed = F.when(F.col("kind") == "customer", F.expr("cast(right(label, 2) as int)")).otherwise(F.lit(100))
    return traverse.propagate(graph, seed, "min", F.col("relation").isin("placed", "contains")).select("id", F.col("value").cast("int").alias("value"))


def _interned(spark, d) -> NodeIndex:
    nation, supplier = tables(spark, d, "nation", "supplier")
    first = nation.select(S.canonical(F.lit("nation"), F.col("n_name")).alias("node_id"), F.col("n_nationkey").cast("long").alias("first_seq"))
    more = supplier.select(S.canonical(F.lit("supplier"), F.col("s_name")).alias("node_id"), (F.col("s_suppkey") % 4).alias("first_seq"))
    return NodeIndex.empty(spark).intern(first).intern(first.unionByName(more))


def index_intern(spark, d):
    return _interned(spark, d).table.select("u64", "node_id", "state")


def index_tombstone(spark, d):
    (nation,) = tables(spark, d, "nation")
    ids = nation.select(S.canonical(F.lit("nation"), F.col("n_name")).alias("node_id"), F.col("n_nationkey").cast("long").alias("k"))
    index = _interned(spark, d).tombstone(ids.filter("k % 4 = 0").select("node_id", (100 - F.col("k")).alias("seq")))
    again = index.intern(ids.filter("k % 8 = 0").select("node_id", F.col("k").alias("first_seq")))
    return again.table.select("u64", "node_id", "state", "died_seq")


def index_resolve(spark, d):
    """Nations merge into the next one, except every fifth: chains of up to five."""
    (nation,) = tables(spark, d, "nation")
    name = lambda k: F.concat(F.lit("nation::nation_"), k.cast("string"))
    k = F.col("n_nationkey")
    pairs = nation.filter("n_nationkey % 5 < 4 AND n_nationkey < 24").select(name(k).alias("from_id"), name(k + 1).alias("into_id"), k.cast("long").alias("seq"))
    return _interned(spark, d).merge(pairs).resolve().select("u64", "resolved")


def index_counts(spark, d):
    index = _interned(spark, d)
    return index.live_count().withColumn("capacity", F.lit(index.capacity).cast("long"))


def signed_payload(spark, d):
    return P.with_payload(envelopes(spark, d)).select("subject_id", "ord", S.hex_of(F.col("payload")).alias("payload"))


def provenance_counts(spark, d):
    return P.by_subject(envelopes(spark, d)).select("subject_id", F.size("envelopes").cast("long").alias("envelopes"))


def _trust_table(spark, d) -> DataFrame:
    """Root, regions as tenants (all but one with a key), nations as agents."""
    region, nation = tables(spark, d, "region", "nation")
    key = F.lit(b"k")
    tenant = F.concat(F.lit("tenant:"), F.col("r_regionkey").cast("string"))
    root = spark.createDataFrame([("root", "mock-v1", bytearray(b"k"), None, None)], schema.TRUST_IDS)
    tenants = region.filter("r_regionkey <> 3").select(tenant.alias("identity"), F.lit("mock-v1").alias("algorithm"), key.alias("public_key"), F.lit("root").alias("parent"), S.slug(F.col("r_name")).alias("scope"))
    agents = nation.select(F.concat(F.lit("agent:"), F.col("n_nationkey").cast("string")).alias("identity"), F.lit("mock-v1").alias("algorithm"), key.alias("public_key"), F.concat(F.lit("tenant:"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(None).cast("string").alias("scope"))
    return root.unionByName(tenants).unionByName(agents)


def trust_chain(spark, d):
    return chained(_trust_table(spark, d), "root").select("identity", F.col("depth").cast("int").alias("depth"))


def is_authorized(spark, d):
    return authorized(_trust_table(spark, d), "root")


def verify_mock(spark, d):
    rows = P.verified(signed_envelopes(spark, d), Registry([MockScheme()]))
    return rows.select("subject_id", "ord", "outcome", S.hex_of(F.get("attestations", F.lit(0))["signature"]).alias("signature"))


def _store() -> TrustStore:
    """Root, four tenants (region 3 is not one) and an agent of each, all with the mock scheme."""
    store = TrustStore("root", "mock-v1", b"root key")
    for k, name in enumerate(("africa", "america", "asia", None, "middle_east")):
        if name:
            store.add_tenant(f"tenant:{k}", "mock-v1", f"key {k}".encode(), name)
        store.add_agent(f"agent:{k}", "mock-v1", f"agent key {k}".encode(), f"tenant:{k}")
    return store


def trust_store(spark, d):
    store = _store()
    names = spark.createDataFrame([(n, *(store.public_key(n) or (None, None))) for n in ("root", "tenant:0", "tenant:3", "agent:3")], "identity string, scheme string, key binary")
    return store.table(spark).join(names, "identity", "full").select("identity", "algorithm", S.hex_of(F.col("public_key")).alias("public_key"), "parent", "scope", S.hex_of(F.col("key")).alias("asked"))


def verify_authorized(spark, d):
    """Each envelope's verdict, the namespace asked being that of region 2."""
    rows = T.verify_authorized(signed_envelopes(spark, d), F.lit("asia"), Registry([MockScheme()]), _store())
    return rows.select("subject_id", "ord", "asserting_agent", "outcome")


def provenance_lookup(spark, d):
    """Envelopes inserted twice: how many there are, and those of one subject."""
    rows = envelopes(spark, d)
    both = P.inserted(rows, rows.filter("ord = 0"))
    some = P.for_subject(both, "nation::nation_3").select(F.col("subject_id").alias("what"), F.col("ord").alias("n"))
    return some.unionByName(P.size(both).select(F.lit("all").alias("what"), F.col("envelopes").alias("n"))).unionByName(P.size(P.for_subject(both, "nobody")).select(F.lit("none").alias("what"), F.col("envelopes").alias("n")))


def artifact_envelope_rows(spark, d):
    return signed_envelopes(spark, d).select("subject_id", "ord", S.hex_of(A.envelope_bytes()).alias("record"))


def artifact_node_rows(spark, d):
    return star_graph(spark, d).nodes.select("id", S.hex_of(A.node_bytes()).alias("record"))


def artifact_edge_rows(spark, d):
    return star_graph(spark, d).edges.select("source", "target", "relation", S.hex_of(A.edge_bytes()).alias("record"))


def artifact_roundtrip(spark, d):
    """The trade graph through the binary container and back."""
    raw = A.Artifact.of(trade_graph(spark, d), _interned(spark, d), signed_envelopes(spark, d)).to_bytes()
    return A.Artifact.from_bytes(spark, raw).graph.edges.select("source", "target", "relation", "confidence")


def laplacian_weights(spark, d):
    return spectral.weights(trade_graph(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


def laplacian_entries(spark, d):
    return spectral.laplacian(trade_graph(spark, d)).select("a", "b", F.round("value", 6).alias("value"))


def fiedler(spark, d):
    """What L v - c v leaves at each node, c the algebraic connectivity and v its vector: nothing."""
    graph = trade_graph(spark, d)
    c, v = spectral.algebraic_connectivity(graph), settle(spectral.fiedler_vector(graph))
    moved = spectral.laplacian(graph).join(v.select(F.col("id").alias("b"), F.col("value").alias("v")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("value") * F.col("v")).alias("moved"))
    return v.join(moved, "id").select("id", F.round(F.abs(F.col("moved") - c * F.col("value")), 6).alias("residual"))


def embedding(spark, d):
    """The Laplacian put together again from all coordinates: the sum of c x_a x_b over the eigenvalues c but the first, which is 0."""
    graph = trade_graph(spark, d)
    frame, values = spectral.spectral_embedding(graph, graph.nodes.count() - 1)
    weights = F.array(*[F.lit(x) for x in values])
    x = settle(frame)
    pairs = x.select(F.col("id").alias("a"), F.col("coords").alias("x")).crossJoin(x.select(F.col("id").alias("b"), F.col("coords").alias("y")))  # 25 nations
    dot = F.aggregate(F.zip_with(F.zip_with("x", "y", lambda p, q: p * q), weights, lambda p, c: p * c), F.lit(0.0), lambda s, p: s + p)
    return pairs.select("a", "b", F.round(dot, 6).alias("value")).filter("abs(value) > 0.0000005")


def index_lookup(spark, d):
    """Each number with its live id, whether it is dead, and the number its id has now."""
    (nation,) = tables(spark, d, "nation")
    name = S.canonical(F.lit("nation"), F.col("n_name")).alias("node_id")
    index = _interned(spark, d).tombstone(nation.filter("n_nationkey % 4 = 0").select(name, F.col("n_nationkey").cast("long").alias("seq")))
    asked = index.table.select("u64", F.col("node_id").alias("own")).unionByName(spark.createDataFrame([(index.capacity, "nobody")], "u64 long, own string"))
    by_number = index.id_of(asked).join(index.is_tombstoned(asked), "u64")
    by_id = index.u64_of(asked.select(F.col("own").alias("node_id"))).select(F.col("node_id").alias("own"), F.col("u64").alias("found"))
    return asked.join(by_number, "u64").join(by_id, "own").select("u64", "own", "node_id", "dead", "found")


def trust_version(spark, d):
    return spark.createDataFrame([(schema.TRUST_MAP_VERSION,)], "version int")


_ALL = (
    canonical_ids, product_collisions, confidence_rubric, trust_levels, tokenize_labels, node_upsert, edge_upsert, auto_endpoints, graph_merge, graph_merge_edges, forget_node, node_by_id, neighbors,
    node_kinds, node_count, node_ids, fact_view, degree, hub_threshold, seed_scores, seed_topk, bfs_reach, render_lines, query_text, shortest_path, propagate_trust, index_intern, index_tombstone,
    index_resolve, index_counts, signed_payload, provenance_counts, trust_chain, is_authorized, verify_mock, trust_store, verify_authorized, provenance_lookup, index_lookup, trust_version,
    artifact_node_rows, artifact_edge_rows, artifact_envelope_rows, artifact_roundtrip, laplacian_weights, laplacian_entries, fiedler, embedding,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}
