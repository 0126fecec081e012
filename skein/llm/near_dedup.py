"""MinHash near-dedup (operator 3).

A document's set is its distinct `words`-word shingles (ASCII lower-cased; with
fewer words the whole sequence is one shingle). Steps:

1. Universal hash minima of each set, banded; equal sets collapse into a class,
   so exact copies never meet again.
2. A band bucket links each class to the least one in it (a star, not all pairs);
   connected components of these candidate links are families.
3. In a family, all pairs that can be similar by their sizes are compared on the
   full sets, whatever its size: the shingles that a document shares with all
   others are counted at once. Pairs already connected are not compared again.
   Families beyond `block_docs` documents or `block_shingles`
   shingles are dealt into blocks: first each block by itself, then only blocks
   of documents outside the family's largest component against the others, so
   a task holds two blocks at most and no pair between components is left out.
4. Connected components of the confirmed links, by large-star and small-star.

A pair at similarity 0.75 shares none of 32 bands of 4 rows with probability
5e-6, and less the more similar it is.

Defined results: null, empty and blank texts have an empty set and stay alone; a
very long text is shingled whole, within one batch; a similarity of exactly
`percent` links;
rows that share a doc_id count as separate documents, of which the first (by
text hash) can stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .components import components
from .repeats import window_starts
from .runtime import Scratch, keyed, rebuilt

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 3_000_000

_RANDOM = np.random.default_rng(20240607)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sets_of(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each; bounds of each text)."""
    raw = grid.LOWER[raw]
    starts, ends, before = grid.word_spans(raw, offsets, grid.SPACE)
    hashes = grid.span_hashes(raw, starts, ends)
    grams = grid.rolling(hashes, words)
    out, bounds = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        lo, hi = before[i], before[i + 1]
        if hi - lo >= words:
            own = np.unique(grams[lo : hi - words + 1])
        elif hi > lo:
            own = grid.rolling(hashes[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo)
        else:
            own = grams[:0]
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def minima_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) 32-bit minima; rows of empty sets are left at 0."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, len(FACTORS)), np.uint32)
    if len(some):
        lead = bounds[some]
        for j, (a, b) in enumerate(zip(FACTORS, SHIFTS)):
            out[some, j] = np.minimum.reduceat(values * a + b, lead) >> np.uint64(32)
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    wide = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(grid.BASE)
    for r in range(ROWS):
        h = grid.mix(h ^ wide[:, :, r]) * np.uint64(grid.BASE)
    return grid.mix(h)


SIGNED = "key long, n long, f1 long, f2 long, bands array<long>"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """SIGNED rows: set size, a 128-bit fingerprint of the set, and its band hashes."""

    def kernel(batches):
        for batch in batches:
            keys = batch.column(0)
            raw, offsets = grid.buffer_of(batch.column(1))
            for a, b in grid.slices(offsets):
                values, bounds = sets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                marks = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(grid.mix(values ^ np.uint64(salt)), out=total[1:])
                    marks.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
                sizes = np.diff(bounds)
                bands = bands_of(minima_of(values, bounds))[sizes > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(sizes), *marks, lists], names=["key", "n", "f1", "f2", "bands"])

    return docs.select("key", "text").mapInArrow(kernel, SIGNED)


def confirm(texts: list[bytes], component: np.ndarray, side: np.ndarray, words: int, percent: int) -> list[tuple[int, int]]:
    """Index pairs that connect components of one group; side 0 with 1 if both are there, else all with all."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    values, bounds = sets_of(np.frombuffer(b"".join(texts), np.uint8), offsets, words)
    sizes, label, links = np.diff(bounds), np.unique(component, return_inverse=True)[1], []
    two, n = len(np.unique(side)) > 1, len(texts)
    distinct, numbers = np.unique(values, return_inverse=True)
    numbers, own = numbers.astype(np.int32), np.zeros(len(distinct), bool)
    for i in range(n - 1):
        other = np.arange(i + 1, n)
        ok = (label[other] != label[i]) & (100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i])) & (sizes[other] > 0)
        if two:
            ok &= side[other] != side[i]
        other = other[ok]
        if not len(other):
            continue
        mine = numbers[bounds[i] : bounds[i + 1]]
        own[mine] = True
        theirs = own[np.concatenate([numbers[bounds[j] : bounds[j + 1]] for j in other.tolist()])]
        lead = np.concatenate([[0], np.cumsum(sizes[other])[:-1]])
        same = np.add.reduceat(theirs, lead, dtype=np.int64)
        own[mine] = False
        for j in other[100 * same >= percent * (sizes[i] + sizes[other] - same)].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def confirmed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links of the groups in `rows` (family, i, j, key, component, side, text)."""

    def close(group):
        keys, component, side, texts = (list(x) for x in zip(*group))
        found = confirm(texts, np.array(component), np.array(side), words, percent) if len(keys) > 1 else []
        return [(keys[x], keys[y]) for x, y in found]

    def kernel(batches):
        group, at = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            texts = batch.column(6).cast(pa.binary()).to_pylist()
            links = []
            for f, i, j, key, component, side, text in zip(*columns, texts):
                if (f, i, j) != at:
                    links += close(group) if group else []
                    group, at = [], (f, i, j)
                group.append((key, component, side, text or b""))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        links = close(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select("family", "i", "j", "key", "component", "side", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "key").mapInArrow(kernel, "a long, b long")


def _blocks(count: str, shingles: str, block_docs: int, block_shingles: int):
    return F.ceil(F.greatest(F.col(count) / block_docs, F.col(shingles) / block_shingles)).cast("int")


def find_links(docs: DataFrame, families: DataFrame, scratch: Scratch, words: int, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(a, b): confirmed links that connect what is similar in each family. families: (key, family, n)."""
    stats = families.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("family", _blocks("c", "s", block_docs, block_shingles).alias("nb"))
    placed = families.join(stats, "family").select("key", "family", "n", "nb", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int").alias("i"))
    placed = scratch.write(placed, "placed")
    texts = docs.select("key", "text").join(placed, "key")
    own = texts.select("family", "i", F.col("i").alias("j"), "key", F.col("key").alias("component"), F.lit(0).alias("side"), "text")
    links = scratch.write(confirmed(own, words, percent), "links")
    large = placed.filter("nb > 1")
    if large.isEmpty():
        return links
    known = large.join(components(links, scratch).withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    known = scratch.write(known, "known")
    sizes = known.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("many")).filter("many > 1")
    split = sizes.join(main, "family").groupBy("family", "main").agg(
        F.sum(F.when(F.col("component") != F.col("main"), F.col("c")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("component") != F.col("main"), F.col("s")).otherwise(0)).alias("s1"),
        F.sum(F.when(F.col("component") == F.col("main"), F.col("c"))).alias("c2"), F.sum(F.when(F.col("component") == F.col("main"), F.col("s"))).alias("s2"),
    )
    split = split.select("family", "main", _blocks("c1", "s1", block_docs, block_shingles).alias("n1"), _blocks("c2", "s2", block_docs, block_shingles).alias("n2"))
    at = F.when(F.col("component") == F.col("main"), F.col("n1") + F.pmod(F.xxhash64("key"), F.col("n2"))).otherwise(F.pmod(F.xxhash64("key"), F.col("n1"))).cast("int")
    cross = known.join(split, "family").withColumn("at", at)
    # A stray block meets every block, itself too; a block of the main component only stray blocks.
    partner = F.explode(F.when(F.col("at") < F.col("n1"), F.sequence(F.lit(0), F.col("n1") + F.col("n2") - 1)).otherwise(F.sequence(F.lit(0), F.col("n1") - 1)))
    cross = cross.withColumn("with", partner).select(
        "key", "family", "component", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), F.when(F.col("at") <= F.col("with"), 0).otherwise(1).alias("side")
    )
    more = docs.select("key", "text").join(cross, "key").select("family", "i", "j", "key", "component", "side", "text")
    return links.unionByName(scratch.write(confirmed(more, words, percent), "links"))


def near_components(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, n_shingles, component) of every row of `docs` (key, doc_id, text)."""
    signed = scratch.write(signatures(docs, words), "signed")
    classes = signed.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")
    copies = signed.select("key", "n", "f1", "f2").join(classes.filter("copies > 1"), ["n", "f1", "f2"]).filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    copies = scratch.write(copies, "copies")
    reps = signed.join(copies.select(F.col("a").alias("key")), "key", "left_anti")
    banded = scratch.write(reps.select("key", F.explode("bands").alias("band")), "banded")
    buckets = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("band", "hub")
    candidates = banded.join(buckets, "band").filter("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    families = components(candidates, scratch).select(F.col("id").alias("key"), F.col("component").alias("family")).join(signed.select("key", "n"), "key")
    families = scratch.write(families, "families")
    scratch.drop(banded)
    links = find_links(docs, families, scratch, words, percent, block_docs, block_shingles)
    groups = components(links.unionByName(copies), scratch).withColumnRenamed("id", "key")
    return signed.select("key", F.col("n").alias("n_shingles")).join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "near")
    own = keyed(docs, scratch)
    found = near_components(own, scratch, **options)
    ids = own.select("key", "doc_id")
    first = own.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return scratch.result(found.join(ids, "key").join(first, "component").select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("component")).alias("kept")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without those whose component holds an earlier document; all columns."""
    scratch = Scratch(docs.sparkSession, "near")
    own = keyed(docs, scratch, whole=True)
    found = near_components(own, scratch, **options)
    kept = scratch.result(found.filter("key = component").select("key"))
    return rebuilt(own.join(kept, "key"), docs, False)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
