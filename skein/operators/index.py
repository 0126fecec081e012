"""A stable dense index of node ids: never reused numbers, tombstones and merge lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..session import numbered, settle

LIVE, TOMBSTONED, MERGED = "live", "tombstoned", "merged"


@dataclass(frozen=True)
class NodeIndex:
    """table (u64, node_id, state, into_u64, died_seq) and the next free number.

    Live rows map ids to numbers; dead ones keep theirs for good. died_seq is the
    order of death.
    """

    table: DataFrame
    capacity: int = 0
    deaths: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> NodeIndex:
        return NodeIndex(spark.createDataFrame([], schema.NODE_INDEX))

    def _live(self) -> DataFrame:
        return self.table.filter(F.col("state") == LIVE).select("u64", "node_id")

    def intern(self, ids: DataFrame) -> NodeIndex:
        """Numbers the ids of (node_id, first_seq) that are not live, in order of first_seq, then id."""
        fresh = ids.groupBy("node_id").agg(F.min("first_seq").alias("first_seq")).join(self._live().select("node_id"), "node_id", "left_anti")
        rows = settle(numbered(fresh, F.asc("first_seq"), F.asc("node_id"), name="u64", start=self.capacity))
        none = F.lit(None).cast("long")
        added = rows.select("u64", "node_id", F.lit(LIVE).alias("state"), none.alias("into_u64"), none.alias("died_seq"))
        return NodeIndex(self.table.unionByName(added), self.capacity + rows.count(), self.deaths)

    def u64_of(self, ids: DataFrame) -> DataFrame:
        """(node_id, u64): null where an id is not live."""
        return ids.select("node_id").join(self._live(), "node_id", "left")

    def id_of(self, numbers: DataFrame) -> DataFrame:
        return numbers.select("u64").join(self._live(), "u64", "left")

    def is_tombstoned(self, numbers: DataFrame) -> DataFrame:
        dead = self.table.filter(F.col("state") != LIVE).select("u64", F.lit(True).alias("dead"))
        return numbers.select("u64").join(dead, "u64", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))

    def tombstones(self) -> DataFrame:
        """(u64, died_seq) of dead numbers; died_seq is their order."""
        return self.table.filter(F.col("state") != LIVE).select("u64", "died_seq")

    def tombstone(self, ids: DataFrame) -> NodeIndex:
        """Kills the live ids of (node_id, seq), in order of seq; others change nothing."""
        doomed = ids.groupBy("node_id").agg(F.min("seq").alias("seq")).join(self._live(), "node_id")
        order = settle(numbered(doomed, F.asc("seq"), F.asc("u64"), name="died", start=self.deaths).select("u64", "died"))
        return self._bury(order.withColumn("into", F.lit(None).cast("long")), TOMBSTONED, order.count())

    def merge(self, pairs: DataFrame) -> NodeIndex:
        """Merges (from_id, into_id, seq) one after the other by seq: the survivor is interned first.

        An id that a pair took away has a new life, with a new number, from its
        next mention on, be that in this call or in a later one; of a pair with
        itself nothing comes but the number.
        """
        dies = (F.col("from_id") != F.col("into_id")).cast("int")
        ahead = pairs.select(F.col("into_id").alias("node_id"), "seq", (F.col("seq") * 2).alias("pos"), F.lit(0).alias("dies"))
        mentions = ahead.unionByName(pairs.select(F.col("from_id").alias("node_id"), "seq", (F.col("seq") * 2 + 1).alias("pos"), dies.alias("dies")))
        own = Window.partitionBy("node_id").orderBy("pos")
        lives = settle(mentions.withColumn("life", F.coalesce(F.sum("dies").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")))
        firsts = lives.groupBy("node_id", "life").agg(F.min("pos").alias("first"))
        alive = self._live().select("node_id", F.lit(0).cast("long").alias("life"), "u64")
        old = settle(firsts.join(alive, ["node_id", "life"]).select("node_id", "life", "u64"))
        fresh = firsts.join(old.select("node_id", "life"), ["node_id", "life"], "left_anti")
        new = settle(numbered(fresh, F.asc("first"), F.asc("node_id"), name="u64", start=self.capacity).select("node_id", "life", "u64"))
        none = F.lit(None).cast("long")
        table = self.table.unionByName(new.select("u64", "node_id", F.lit(LIVE).alias("state"), none.alias("into_u64"), none.alias("died_seq")))
        known = NodeIndex(table, self.capacity + new.count(), self.deaths)
        placed = lives.join(old.unionByName(new), ["node_id", "life"])
        gone = placed.filter("dies = 1").select("seq", "u64").join(placed.filter("pos % 2 = 0").select("seq", F.col("u64").alias("into")), "seq")
        order = settle(numbered(gone, F.asc("seq"), F.asc("u64"), name="died", start=known.deaths).select("u64", "died", "into"))
        return known._bury(order, MERGED, order.count())

    def _bury(self, dead: DataFrame, state: str, count: int) -> NodeIndex:
        joined = self.table.join(dead, "u64", "left")
        died = F.col("died").isNotNull()
        table = joined.select("u64", "node_id", F.when(died, F.lit(state)).otherwise(F.col("state")).alias("state"), F.coalesce("into", "into_u64").alias("into_u64"), F.coalesce("died", "died_seq").alias("died_seq"))
        return NodeIndex(settle(table), self.capacity, self.deaths + count)

    def resolve(self, numbers: DataFrame | None = None, most_doublings: int = 64) -> DataFrame:
        """(u64, resolved): the end of each number's merge lineage, by pointer doubling.

        Numbers that are unknown, live or deleted resolve to themselves.
        """
        jump = settle(self.table.filter(F.col("into_u64").isNotNull()).select("u64", F.col("into_u64").alias("resolved")))
        for _ in range(most_doublings):
            further = jump.select(F.col("u64").alias("resolved"), F.col("resolved").alias("next"))
            after = settle(jump.join(further, "resolved", "left").select("u64", F.coalesce("next", "resolved").alias("resolved"), F.col("next").isNotNull().alias("moved")))
            jump = after.select("u64", "resolved")
            if after.filter("moved").isEmpty():
                break
        asked = self.table.select("u64") if numbers is None else numbers.select("u64")
        return asked.join(jump, "u64", "left").withColumn("resolved", F.coalesce("resolved", "u64"))

    def live_count(self) -> DataFrame:
        return self._live().agg(F.count("*").alias("live_count"))

    def snapshot(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        spark = self.table.sparkSession
        spark.createDataFrame([(self.capacity, self.deaths)], "capacity long, deaths long").write.mode("overwrite").parquet(f"{path}/scalars")

    @staticmethod
    def restore(spark: SparkSession, path: str) -> NodeIndex:
        row = spark.read.parquet(f"{path}/scalars").first()
        return NodeIndex(spark.read.schema(schema.NODE_INDEX).parquet(f"{path}/table"), row.capacity, row.deaths)
