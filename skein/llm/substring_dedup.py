"""Substring dedup: a compacted de Bruijn graph of token k-mers (operator 4).

Vertices are word k-mers, sampled: of each `window` words the leftmost of least
hash, so a window always holds one, at the same place in each of its copies. An
edge is the text from the start of one sampled k-mer to the end of the next one
in the document (from its beginning, to its end). Steps:

1. Each occurrence of a k-mer with its edge in and its edge out. Only vertices
   that occur twice or more can lie on repeated paths; the others go at once.
2. A vertex whose occurrences all have the same edge in and the same edge out
   has in-degree and out-degree one and does not branch. Vertices that do not
   branch compact into paths, by pointer doubling: Spark joins, as many as the
   logarithm of the longest path. Every occurrence of such a vertex lies on an
   occurrence of its whole path, up to the branching vertices at both ends.
3. Long repeated spans, the occurrences of paths of `window` words or more, are
   read at their source coordinates and compared by a digest of their words.
4. Windows that no path settles, as they hold a branching vertex or reach beyond
   their path, are read at their source coordinates too, each of them an edge of
   the full graph of `window`-word k-mers, and compared one by one.

Each window's copies take the same way, 3 or 4: either their vertex does not
branch, then all of them lie at the same place of the same path, or they do not.

Defined results: a null or empty text has no words and loses none; a very long
text is read in overlapping pieces and behaves as any other, up to 2**27 bytes,
from which on the call raises ValueError; equal rows are separate documents, so
both lose what they share; every occurrence of a repeated window goes, the first
one too, so there are no ties; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, repeats
from .runtime import POSITION_BITS, Scratch, keyed

#: Words of a window, and words of the k-mers that are vertices.
WINDOW, ANCHOR = 35, 10
#: v: k-mer at `ord`; windows that sample it: n, the first one `lead` words before it; prev: the sampled k-mer before it (0: none);
#: into, out: its edges; before, after: words that they add to its left and to its right.
VERTICES = "v long, ord long, lead int, n int, prev long, into long, before int, out long, after int"
SPANS = "h long, w long, ord long, n int"
#: Rounds of pointer doubling: paths of 2**MOST_ROUNDS vertices.
MOST_ROUNDS = 40


def vertices(docs: DataFrame, tokens: repeats.Tokens) -> DataFrame:
    """VERTICES rows: every occurrence of a sampled k-mer in (key, text), with its edges."""
    k = tokens.anchor

    def rows(values, before, keys, first):
        text, begin, count, at, hashes = repeats.runs_of(values, before, tokens.window, k)
        spans = repeats.Spans(values)
        linked = text[1:] == text[:-1]  # with the k-mer before
        left, right, prev = before[text].copy(), before[text + 1].copy(), np.zeros(len(at), np.uint64)
        left[1:][linked] = at[:-1][linked]
        right[:-1][linked] = at[1:][linked] + k
        prev[1:][linked] = hashes[:-1][linked]
        starts, ends = np.ones(len(at), np.uint64), np.full(len(at), 2, np.uint64)
        starts[1:][linked] = 0
        ends[:-1][linked] = 0
        into, out = spans.of(left, at + k, starts), spans.of(at, right, ends)
        ord_ = (keys[text] << POSITION_BITS) | (at - before[text] + first)
        small = lambda x: x.astype(np.int32)
        return hashes.view(np.int64), ord_, small(at - begin), small(count), prev.view(np.int64), into.view(np.int64), small(at - left), out.view(np.int64), small(right - at - k)

    return repeats.over_texts(docs, tokens, VERTICES, rows)


def repeated(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The VERTICES rows whose k-mer occurs twice or more."""
    often = scratch.write(found.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v"), "often")
    return scratch.write(found.join(often, "v"), "again")


def compacted(again: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(v, path, offset, total) of the vertices that do not branch.

    path: the path's first such vertex; offset: words from the path's start to v;
    total: words of the path.
    """
    degrees = again.groupBy("v").agg(*[f(c).alias(f"{name}_{c}") for c in ("into", "out") for name, f in (("least", F.min), ("most", F.max))], *[F.min(c).alias(c) for c in ("prev", "before", "after")])
    plain = scratch.write(degrees.filter("least_into = most_into AND least_out = most_out").select("v", "prev", "before", "after"), "plain")
    known = plain.select(F.col("v").alias("prev"), F.lit(True).alias("inner"))
    chain = scratch.write(plain.join(known, "prev", "left").select("v", F.when(F.col("inner"), F.col("prev")).otherwise(F.col("v")).alias("root"), F.when(F.col("inner"), F.col("before")).otherwise(0).cast("long").alias("dist"), F.col("inner").isNull().alias("done")), "chain")
    done, open_ = chain.filter("done"), chain.filter("NOT done")
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            break
        # A pointer of 2**i vertices; one that ends at a root is final, the others take the pointer of where they end.
        up = done.unionByName(open_).select(F.col("v").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"), F.col("done").alias("final"))
        moved = scratch.write(open_.join(up, "root").select("v", F.col("next").alias("root"), (F.col("dist") + F.col("more")).alias("dist"), F.col("final").alias("done")), "chain")
        done, open_ = done.unionByName(moved.filter("done")), moved.filter("NOT done")
    else:
        raise RuntimeError(f"paths did not compact in {MOST_ROUNDS} rounds")
    roots = plain.select(F.col("v").alias("root"), F.col("before").alias("ahead"))
    placed = done.join(roots, "root").join(plain.select("v", "after"), "v").select("v", F.col("root").alias("path"), (F.col("dist") + F.col("ahead")).alias("offset"), "after")
    placed = scratch.write(placed, "placed")
    totals = scratch.write(placed.groupBy("path").agg(F.max(F.col("offset") + k + F.col("after")).alias("total")), "totals")
    return scratch.write(placed.join(totals, "path").select("v", "path", "offset", "total"), "paths")


def to_read(again: DataFrame, paths: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(h, ord, n, whole): what is compared at its coordinates.

    whole: an occurrence of path h, whose n windows start at ord; otherwise n
    windows from ord on that hold vertex h and lie on no path.
    """
    rows = again.select("v", "ord", "lead", "n").join(paths, "v", "left")
    start, end = F.col("ord") - F.col("lead"), F.col("ord") - F.col("lead") + F.col("n")
    lo = F.greatest(start, F.col("ord") - F.col("offset"))
    hi = F.least(end, F.col("ord") - F.col("offset") + F.col("total") - window + 1)
    settled = F.col("path").isNotNull() & (lo < hi)
    piece = lambda h, a, b, whole: F.struct(h.alias("h"), a.cast("long").alias("ord"), (b - a).cast("int").alias("n"), F.lit(whole).alias("whole"))
    some = F.when(settled, F.array(piece(F.col("v"), start, lo, False), piece(F.col("v"), hi, end, False))).otherwise(F.array(piece(F.col("v"), start, end, False)))
    first = F.col("ord") - F.col("offset")
    path = F.when((F.col("v") == F.col("path")) & (F.col("total") >= window), F.array(piece(F.col("path"), first, first + F.col("total") - window + 1, True))).otherwise(F.array().cast("array<struct<h:long,ord:long,n:int,whole:boolean>>"))
    return scratch.write(rows.select(F.explode(F.filter(F.concat(some, path), lambda p: p["n"] > 0)).alias("p")).select("p.*"), "to_read")


def read(docs: DataFrame, wanted: DataFrame, tokens: repeats.Tokens) -> DataFrame:
    """SPANS rows: each window or path occurrence in `wanted`, with a digest of its words read at its coordinates."""
    low = (1 << POSITION_BITS) - 1

    def kernel(batches):
        for batch in batches:
            raw, offsets = grid.buffer_of(batch.column(0))
            bounds = batch.column(1).offsets.to_numpy()
            ords, counts, marks, whole = (batch.column(1).values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for a, b in grid.slices(offsets):
                part = raw[offsets[a] : offsets[b]]
                values, before, starts, ends = tokens.of(part, offsets[a : b + 1] - offsets[a])
                own = slice(bounds[a], bounds[b])
                at = np.repeat(before[:-1], np.diff(bounds[a : b + 1])) + (ords[own] & low)
                h, n, paths = marks[own], counts[own].astype(np.int64), whole[own].astype(bool)
                single = ~paths
                each = np.repeat(np.arange(len(at))[single], n[single])
                step = np.arange(len(each)) - np.repeat(np.cumsum(n[single]) - n[single], n[single])
                w = grid.rolling(values, tokens.window)[at[each] + step] if len(each) else np.zeros(0, np.uint64)
                text, digests = part.tobytes(), []
                for i, count in zip(at[paths].tolist(), n[paths].tolist()):
                    words = text[starts[i] : ends[i + count + tokens.window - 2]].split()  # splits where words end
                    digests.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[each], ~h[paths]])), pa.array(np.concatenate([w.view(np.int64), np.array(digests, np.int64)])),
                        pa.array(np.concatenate([ords[own][each] + step, ords[own][paths]])), pa.array(np.concatenate([np.ones(len(each), np.int32), n[paths].astype(np.int32)])),
                    ],
                    names=["h", "w", "ord", "n"],
                )

    joined = docs.select("key", "text").join(repeats.by_key(wanted, "h", "whole"), "key").select("text", "runs")
    return joined.mapInArrow(kernel, SPANS)


def repeated_runs(docs: DataFrame, scratch: Scratch, tokens: repeats.Tokens) -> DataFrame:
    """(ord, n): runs of windows whose words also start elsewhere."""
    found = scratch.write(vertices(docs, tokens), "vertices")
    again = repeated(found, scratch)
    scratch.drop(found)
    paths = compacted(again, tokens.anchor, scratch)
    wanted = to_read(again, paths, tokens.window, scratch)
    scratch.drop(again)
    spans = scratch.write(read(docs, wanted, tokens), "spans")
    scratch.drop(wanted)
    twice = scratch.write(spans.groupBy("h", "w").agg(F.count("*").alias("c")).filter("c > 1").select("h", "w"), "twice")
    return scratch.write(spans.join(twice, ["h", "w"]).select("ord", "n"), "repeated")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, kept_text) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "substring")
    own = keyed(docs, scratch)
    tokens = repeats.Tokens(window, min(anchor, window), grid.SPACE)
    found = repeats.remove(own, repeated_runs(own, scratch, tokens), tokens, with_text, ("doc_id",))
    return scratch.result(found.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "n_spans", "kept_sha256", "kept_text"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
