"""The star-schema tables as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import canonical, canonical_key
from ..operators.graph import Graph


def _id(namespace: str, entity: str | Column) -> Column:
    return canonical(F.lit(namespace), (F.col(entity) if isinstance(entity, str) else entity).cast("string"))


def _key_id(frame: DataFrame, namespace: str, key: str) -> Column:
    """`_id` of a column of keys, which are whole numbers as a rule."""
    return canonical_key(F.lit(namespace), F.col(key)) if isinstance(frame.schema[key].dataType, IntegralType) else _id(namespace, key)


def _nodes(frame: DataFrame, kind: str, entity: str, label: Column) -> DataFrame:
    return frame.select(_key_id(frame, kind, entity).alias("id"), label.alias("label"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("source"))


def _edges(frame: DataFrame, source: Column, target: Column, relation: str, confidence: Column | int = 0) -> DataFrame:
    tag = F.lit(confidence) if isinstance(confidence, int) else confidence
    return frame.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), tag.cast("int").alias("confidence"))


def quantity_tag(quantity: Column) -> Column:
    """Confidence of a supply by its quantity."""
    return F.when(quantity >= 45, 1).when(quantity >= 35, 2).when(quantity >= 25, 3).when(quantity >= 15, 4).when(quantity >= 5, 5).otherwise(6)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, orders and parts, linked by keys and by lineitem."""
    region, nation, customer, supplier, part, orders, lineitem = tables(spark, sf_dir, "region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    nodes = [
        _nodes(region, "region", "r_name", F.col("r_name")),
        _nodes(nation, "nation", "n_name", F.col("n_name")),
        _nodes(customer, "customer", "c_name", F.col("c_name")),
        _nodes(supplier, "supplier", "s_name", F.col("s_name")),
        _nodes(part, "part", "p_partkey", F.col("p_name")),
        _nodes(orders, "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
    ]
    customers = customer.select("c_custkey", _id("customer", "c_name").alias("c_id"), "c_nationkey")  # an id a customer, not one an order
    suppliers = supplier.select("s_suppkey", _id("supplier", "s_name").alias("s_id"), "s_nationkey")
    sold = lineitem.select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # an order's lines are few and stay together: its ids are counted in one task and pack well
    supplied = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min(quantity_tag(F.col("l_quantity"))).alias("tag"))
    placed = orders.select("o_orderkey", "o_custkey").repartition("o_orderkey")  # a task of a scan can have millions of orders, whatever the split
    n = nation.select("n_nationkey", _id("nation", "n_name").alias("n_id"), "n_regionkey")
    c, s = customers, suppliers
    edges = [
        _edges(n.join(region, n.n_regionkey == region.r_regionkey), F.col("n_id"), _id("region", "r_name"), "in_region"),
        _edges(c.join(n, c.c_nationkey == n.n_nationkey), F.col("c_id"), F.col("n_id"), "located_in"),
        _edges(s.join(n, s.s_nationkey == n.n_nationkey), F.col("s_id"), F.col("n_id"), "located_in"),
        _edges(placed.join(c, F.col("o_custkey") == c.c_custkey), F.col("c_id"), _key_id(orders, "order", "o_orderkey"), "placed"),
        _edges(sold, _key_id(sold, "order", "l_orderkey"), _key_id(sold, "part", "l_partkey"), "contains"),
        _edges(supplied.join(s, F.col("l_suppkey") == s.s_suppkey), F.col("s_id"), _key_id(supplied, "part", "l_partkey"), "supplies", F.col("tag")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges).withColumn("seq", F.lit(0).cast("long")), (customer, supplier, part, orders, lineitem))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, linked customer nation to supplier nation by orders; cyclic. Confidence by the number of lines."""
    nation, customer, supplier, orders, lineitem = tables(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem")
    lines = lineitem.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    a, b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b"))
    edges = _edges(pairs.join(a, "c_nationkey").join(b, "s_nationkey"), _id("nation", "a"), _id("nation", "b"), "trades", F.pmod(F.col("n"), F.lit(7)))
    return Graph(_nodes(nation, "nation", "n_name", F.col("n_name")), edges.withColumn("seq", F.lit(0).cast("long")))


def turn_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Conversation turns as chains: each turn links to the next one."""
    (turns,) = tables(spark, sf_dir, "conversations")
    at = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nodes = turns.select(_id("turn", at).alias("id"), F.col("role").alias("label"), F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("source"))
    after = turns.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), _id("turn", at).alias("next"))
    edges = turns.join(after, ["conv_id", "turn"]).select(_id("turn", at).alias("source"), F.col("next").alias("target"), F.lit("next").alias("relation"), F.pmod("turn", F.lit(7)).cast("int").alias("confidence"))
    return Graph(nodes, edges.withColumn("seq", F.lit(0).cast("long")))


def product_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest log over parts: collapsing product ids, edges before nodes, blanks and erasures.

    Products are named by p_name, which repeats, so events of many parts meet in
    one node. Every seventh part comes as an edge first; brands are forgotten at
    the end where their number is odd.
    """
    (part,) = tables(spark, sf_dir, "part")
    product, brand = _id("product", "p_name"), _id("brand", "p_brand")
    text = lambda v=None: F.lit(v).cast("string")
    key = F.col("p_partkey")
    blank = F.when(key % 3 == 0, F.lit("")).otherwise(F.col("p_name"))
    node = part.select((key * 4 + 2).alias("seq"), F.lit("node").alias("op"), product.alias("id"), blank.alias("label"), F.when(key % 2 == 0, F.lit("")).otherwise(F.col("p_type")).alias("kind"), F.when(key % 5 == 0, F.concat(F.lit("part:"), key.cast("string"))).alias("node_source"), text().alias("source"), text().alias("target"), text().alias("relation"), F.lit(None).cast("int").alias("confidence"))
    edge = part.select((key * 4 + F.when(key % 7 == 0, 1).otherwise(3)).alias("seq"), F.lit("edge").alias("op"), text().alias("id"), text().alias("label"), text().alias("kind"), text().alias("node_source"), product.alias("source"), brand.alias("target"), F.lit("made_by").alias("relation"), F.pmod(F.col("p_size"), F.lit(7)).cast("int").alias("confidence"))
    odd = part.filter(F.expr("pmod(cast(right(p_brand, 1) as int), 2) = 1 AND p_partkey % 2 = 1"))
    forget = odd.select((key * 4).alias("seq"), F.lit("forget").alias("op"), brand.alias("id"), text().alias("label"), text().alias("kind"), text().alias("node_source"), text().alias("source"), text().alias("target"), text().alias("relation"), F.lit(None).cast("int").alias("confidence"))
    return node.unionByName(edge).unionByName(forget)
