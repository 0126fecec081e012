"""Written intermediates: lineage is cut by tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the input for each partition of a sized shuffle, and bytes of a file that one of its tasks reads at most.
ROWS, SPLIT = 1 << 18, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset on a single machine, a temporary folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        found = spark.sparkContext.getCheckpointDir()
    return str(found).rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The driver deletes the folder when it shuts down; until then any frame may still read it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside deals its shuffles over a partition for each ROWS of `rows`, so a task's memory does not grow with the input.

    The session's number of partitions is fixed, and small ones are joined up to 64 MB of packed bytes, which
    can be millions of rows. The session's settings are put back at the end; up to ROWS rows nothing is set.
    """
    wanted = {}
    if rows > ROWS:
        parts = max(-(-rows // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        split = min(SPLIT, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        wanted = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": str(split)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(frame: DataFrame, rows: int = 0) -> DataFrame:
    """Writes a frame and reads it back: survives lost executors and keeps plans of loops short. `rows` of its input size its shuffles."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with sized(spark, rows):
        frame.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


class Grown:
    """A frame that grows by written parts; parts of like age are written together, so that plans stay short.

    After n parts about log2(n) + 4 frames are united, and each row was written
    again at most log2(n) times.
    """

    def __init__(self, first: DataFrame) -> None:
        self.parts = [(1, first)]

    def add(self, part: DataFrame) -> None:
        self.parts.append((1, part))
        while len(self.parts) > 4 and self.parts[-1][0] >= self.parts[-2][0]:
            (a, one), (b, two) = self.parts.pop(), self.parts.pop()
            self.parts.append((a + b, settle(two.unionByName(one))))

    def frame(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for _, x in self.parts])


def numbered(frame: DataFrame, *order: Column, name: str = "at", start: int = 0) -> DataFrame:
    """`frame` with a dense number in the given order, without one partition for all rows.

    Range partitions are sorted and written; each row's number is its place in its
    partition plus the rows of the partitions before (one count a partition).
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    offsets, total = [], start
    for row in sorted(counts, key=lambda r: r.part):
        offsets += [F.lit(row.part), F.lit(total)]
        total += row.n
    base = F.create_map(*offsets)[F.shiftright("_place", 33)] if offsets else F.lit(0)
    return placed.withColumn(name, (base + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_place")
