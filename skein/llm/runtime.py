"""Shared folder, written intermediates and row keys for the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys and positions share one long: key * 2**POSITION_BITS + position.
POSITION_BITS = 27
MAX_KEY = 1 << 36


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    It is read from spark.checkpoint.dir. Only where that is unset (tests, a
    single machine) a temporary folder is made and set as checkpoint folder; on a
    cluster that raises, as executors would write to disks of their own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return str(found).rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches of bounded rows and bytes: each is held by the JVM and by Python at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(key, str(most))


class Scratch:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    A written table cuts lineage and survives lost executors. `drop` deletes a
    table that is no longer needed and lets Spark clear the shuffle files of
    plans that nothing refers to any more.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None) -> None:
        self.spark = spark
        small_batches(spark)
        self.root = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.passing = folder is None
        self.run = uuid.uuid4().hex[:6]
        self.count = 0
        self.live: dict[str, DataFrame] = {}

    def write(self, frame: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
        """keep: `result` does not drop it, as what the call returns reads it."""
        self.count += 1
        path = f"{self.root}/{self.run}-{self.count:03d}-{name}"
        frame.write.option("compression", "zstd").parquet(path)
        out = self.open(path, frame.schema)
        if self.passing and self.count == 1:
            self._file_system().deleteOnExit(self._path())  # when the driver ends; frames may read it until then
        if not keep:
            self.live[path] = out
        return out

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)

    def _file_system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def stay(self) -> None:
        """The folder outlives this driver."""
        self.passing = False
        self._file_system().cancelDeleteOnExit(self._path())

    def open(self, path: str, schema) -> DataFrame:
        """A table that was written before; it stays unless it is dropped."""
        out = self.spark.read.schema(schema).parquet(path)
        out._skein_path = path
        return out

    def result(self, frame: DataFrame) -> DataFrame:
        """Writes the last table of the call and drops all others."""
        rest = list(self.live.values())
        out = self.write(frame, "result")
        self.drop(*rest)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            self.live.pop(frame._skein_path, None)
            path = jvm.org.apache.hadoop.fs.Path(frame._skein_path)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def keyed(docs: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """Rows (key, doc_id, text) with a unique key in [0, 2**36) that follows doc_id's order.

    whole: with a struct `row` of all other columns, for `rebuilt`.

    The key is doc_id itself where it is unique, not null and in range. Otherwise
    rows are numbered in doc_id order, nulls first; rows of equal id then count as
    separate documents, in the order of their texts.
    """
    row = [F.struct(F.lit(0).alias("_skein"), *[docs[c] for c in docs.columns if c not in ("doc_id", "text")]).alias("row")] if whole else []
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *row)
    seen = own.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.max("n").alias("most"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"), F.max(F.col("doc_id").isNull()).alias("nulls")
    ).first()
    if seen.most is None or (seen.most == 1 and not seen.nulls and seen.least >= 0 and seen.largest < MAX_KEY):
        return own.select(F.col("doc_id").alias("key"), *own.columns)
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64("text")
    ordered = own.repartitionByRange(parts, F.asc_nulls_first("doc_id"), digest).sortWithinPartitions(F.asc_nulls_first("doc_id"), digest)
    numbered = scratch.write(ordered.select(F.monotonically_increasing_id().alias("at"), *own.columns), "numbered", keep=whole)
    counts = numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = {}
    total = 0
    for row in sorted(counts.collect(), key=lambda r: r.part):  # one row for each partition
        before[row.part] = total
        total += row.n
    if total > MAX_KEY:
        raise ValueError(f"{total} rows are above the limit of {MAX_KEY}")
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.shiftright("at", 33)]
    return numbered.select((offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("key"), *own.columns)


def rebuilt(rows: DataFrame, docs: DataFrame, new_text: bool) -> DataFrame:
    """The columns of `docs` from rows (doc_id, text, row); n_chars, if there, follows a new text."""
    out = []
    for c in docs.columns:
        if c in ("doc_id", "text"):
            out.append(F.col(c).cast(docs.schema[c].dataType).alias(c))
        elif c == "n_chars" and new_text:
            out.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return rows.select(*out)
