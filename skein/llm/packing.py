"""Harmonic packing of documents into sequences of `CAPACITY` tokens (operator 10).

Class k holds pieces that fill a k-th of a sequence, 4096 div k tokens, and a bin
of class k takes k of them. A document is cut into whole sequences, then greedily
into the largest class that still fits, down to `FINE` tokens, below which every
length is a class of its own (k = 4096 div length). All pieces of a class are of
equal length, so a bin is filled by counting: workers number their own pieces of
each class, and one small table of counts by class and worker places them. The
pieces that are left over, fewer than k in class k (about 21,000 at most,
whatever the input), are put together largest first.

Defined results: null and empty texts are the end id alone; a very long text is
encoded whole and cut into as many sequences as it fills; equal lengths are told
apart by doc_id, start and ids; equal rows are packed
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch
from .tokens import encoder

CAPACITY, FINE, END_ID = 4096, 64, 2
#: Pieces that one worker numbers.
WORKER_ROWS = 10_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def class_lengths(capacity: int, fine: int) -> list[int]:
    """Piece lengths from large to small: capacity div k down to `fine`, then every length."""
    large = {capacity // k for k in range(1, capacity + 1) if capacity // k > fine}
    return sorted(large | set(range(1, fine + 1)), reverse=True)


def cut(n: int, lengths: list[int]) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [lengths[0]] * (n // lengths[0])
    rest = n % lengths[0]
    for length in lengths:
        if not rest:
            break
        while length <= rest:
            out.append(length)
            rest -= length
    return out


def pieces(docs: DataFrame, path: str | None, capacity: int, fine: int) -> DataFrame:
    """PIECES rows of (doc_id, text); each id of a document lies in one piece."""
    lengths = class_lengths(capacity, min(fine, capacity))
    end = END_ID.to_bytes(4, "little")

    def cut_batch(known, batch):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), 256):
            rows = []
            for doc, packed in zip(ids[i : i + 256], known.encode([t or "" for t in texts[i : i + 256]])):
                packed += end
                n, at = len(packed) // 4, 0
                for length in cut(n, lengths):
                    rows.append((doc, at, length, zlib.crc32(packed[4 * at : 4 * (at + length)]), n))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def kernel(batches):
        with encoder(path) as known:
            for batch in batches:
                yield from cut_batch(known, batch)

    return docs.mapInArrow(kernel, PIECES)


def _together(rows: list, capacity: int) -> list[tuple]:
    """(row, bin, offset): each bin takes the longest piece that still fits, again and again."""
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(row.length, []).append(row)
    out, bin_ = [], 0
    while by_length:
        used = 0
        for length in sorted(by_length, reverse=True):
            own = by_length[length]
            while own and used + length <= capacity:
                out.append((own.pop(), bin_, used))
                used += length
            if not own:
                del by_length[length]
        bin_ += 1
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, fine: int = FINE, worker_rows: int = WORKER_ROWS) -> DataFrame:
    """PIECES with sequence_id and offset, for every row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = scratch.write(pieces(own, path, capacity, fine), "pieces")
    workers = max(1, -(-cuts.count() // worker_rows))
    dealt = cuts.withColumn("worker", F.pmod(F.xxhash64("doc_id", "start"), F.lit(workers)).cast("int"))
    counts = dealt.groupBy("length", "worker").agg(F.count("*").alias("c"))
    counts = scratch.write(counts, "counts")
    per_class = Window.partitionBy("length").orderBy("worker")
    before = counts.withColumn("before", F.sum("c").over(per_class) - F.col("c")).drop("c")
    totals = sorted(((r.length, r.c) for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()), reverse=True)  # a row a class
    base, sequences = {}, 0
    for length, total in totals:
        base[length] = (sequences, total // (capacity // length))
        sequences += base[length][1]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not base:
        return spark.createDataFrame([], schema)
    firsts = spark.createDataFrame([(n, *b) for n, b in base.items()], "length long, base long, bins long")
    rank = F.row_number().over(Window.partitionBy("length", "worker").orderBy("doc_id", "start", "ids_crc32"))
    placed = dealt.withColumn("rank", rank).join(before, ["length", "worker"]).join(F.broadcast(firsts), "length")  # at most one row a class
    k = F.floor(F.lit(capacity) / F.col("length"))
    placed = placed.withColumn("at", F.col("before") + F.col("rank") - 1).withColumn("bin", F.floor(F.col("at") / k))
    placed = scratch.write(placed.select(*cuts.columns, "base", "bins", "bin", "at"), "placed")
    full = placed.filter("bin < bins").select(*cuts.columns, (F.col("base") + F.col("bin")).cast("long").alias("sequence_id"), ((F.col("at") - F.col("bin") * k) * F.col("length")).cast("long").alias("offset"))
    rest = placed.filter("bin >= bins").select(*cuts.columns).collect()  # fewer than k pieces of each class k
    last = [(*row, sequences + bin_, offset) for row, bin_, offset in _together(rest, capacity)]
    return scratch.result(full.unionByName(spark.createDataFrame(last, schema)))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
