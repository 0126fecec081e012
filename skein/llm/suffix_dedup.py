"""Suffix-array dedup: a logarithmic family of sampled suffix arrays (operator 5).

An array holds the suffixes of a batch that start at its anchors (see repeats;
about one byte in forty, and each `window`-byte string contains one, at the same
place in each of its copies) in the order of their first 16 bytes, then of a
fingerprint of the anchor and of the whole run, that is all the anchor's
windows. Equal suffixes that a batch or an older level holds already are left
out, as only the first one decides what is earlier.

`SuffixFamily.add` takes documents in batches of rising key. A new batch gets its
array and is scanned, by a hash join on the anchors, against all existing levels.
A run whose anchor starts no other run there or in the batch is new; only the
others are compared: a run that a level or the batch itself holds already is a
long match, and all of its windows are earlier ones. Suffixes that start alike and then
differ branch; they are set aside. Then the batch's new suffixes become a level of
size one, put in order when the next batch comes or the family is saved, and
levels of equal size merge into one of twice the size: a family
over B batches has at most log2(B)+1 levels, each suffix is rewritten at most
log2(B) times, and no text of an older batch is read.

`SuffixFamily.earlier` settles what was set aside, reading its texts at their
coordinates. A branching anchor is refined by longer contexts: the windows of
a run are taken `STEP` neighbours at a time, whose common core (91 of 100 bytes)
is the anchor of the next round; where cores branch again, windows are
compared one by one. Windows that no other context shares are never written.

A family lives in a folder; `SuffixFamily.reopen` lets a later job add to it.

Defined results: a null or empty text has no bytes and loses none; a very long
text is read in overlapping pieces and behaves as any other, up to 2**27 bytes,
from which on the call raises ValueError; of equal rows the first keeps its
text, and ties in doc_id are broken by a hash of the text; matches may overlap
themselves; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid, repeats
from .runtime import POSITION_BITS, Scratch, keyed, rebuilt

#: Bytes of a string, and bytes of the k-mers that anchor it.
WINDOW, ANCHOR = 100, 24
#: Batches that a one-off call deals its documents into; levels merge at each second, fourth and eighth.
BATCHES = 8
#: Neighbouring windows that are refined together.
STEP = 10
#: a1, a2: the suffix's first 16 bytes, as numbers in byte order; h: its anchor; span: its run; the run's n windows start
#: at `ord`, `lead` bytes before the suffix.
SUFFIXES = "a1 long, a2 long, h long, span long, ord long, n int, lead int"
ORDER = ["a1", "a2", "h", "span"]
#: What tells runs apart: the first bytes follow from the anchor.
RUN = ["h", "span"]
CONTEXTS = "h long, ord long, n int, lead int, context binary"
PARTS = "c long, u long, ord long, n int, owner long"


def suffixes(docs: DataFrame, tokens: repeats.Tokens) -> DataFrame:
    """SUFFIXES rows of (key, text): one for each run of windows."""
    tops = np.uint64(1 << 63)

    def rows(raw, before, keys, first):
        values = grid.BYTE_CODES[raw]
        text, begin, count, at, hashes = repeats.runs_of(values, before, tokens.window, tokens.anchor)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        heads = padded[at[:, None] + np.arange(16)] if len(at) else np.zeros((0, 16), np.uint8)
        heads = (np.ascontiguousarray(heads).view(">u8").astype(np.uint64) ^ tops).view(np.int64)
        if tokens.anchor < 16 and len(at):  # short anchors are all that copies surely share
            heads[:] = 0
        span = repeats.Spans(values).of(begin, begin + count + tokens.window - 1, at - begin)
        ord_ = (keys[text] << POSITION_BITS) | (begin - before[text] + first)
        return heads[:, 0], heads[:, 1], hashes.view(np.int64), span.view(np.int64), ord_, count.astype(np.int32), (at - begin).astype(np.int32)

    return repeats.over_texts(docs, tokens, SUFFIXES, rows)


def contexts(docs: DataFrame, runs: DataFrame, tokens: repeats.Tokens) -> DataFrame:
    """CONTEXTS rows: the bytes of each run in `runs` (h, ord, n, lead), read at its coordinates."""
    low = (1 << POSITION_BITS) - 1

    def kernel(batches):
        for batch in batches:
            raw, offsets = grid.buffer_of(batch.column(0))
            bounds = batch.column(1).offsets.to_numpy()
            ords, counts, hashes, leads = (batch.column(1).values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for a, b in grid.slices(offsets):
                own = slice(bounds[a], bounds[b])
                lo = np.repeat(offsets[a:b] - offsets[a], np.diff(bounds[a : b + 1])) + (ords[own] & low)
                hi = lo + counts[own] + tokens.window - 1
                whole = raw[offsets[a] : offsets[b]].tobytes()
                found = [whole[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (hashes, ords, counts, leads)] + [pa.array(found, pa.binary())], names=["h", "ord", "n", "lead", "context"])

    joined = docs.select("key", "text").join(repeats.by_key(runs, "h", "lead"), "key").select("text", "runs")
    return joined.mapInArrow(kernel, CONTEXTS)


def refined(found: DataFrame, window: int, step: int) -> DataFrame:
    """PARTS rows of CONTEXTS rows: the runs in parts of `step` windows at most.

    c: hash of the anchor, the part's place and its core, the bytes that all
    `step` windows there share; u: hash of all the part's bytes. Windows that are
    equal lie in parts of equal c; parts of equal c and u have equal windows.
    """

    def rows(h, ords, counts, leads, texts):
        raw, bounds = grid.buffer_of(texts)
        spans = repeats.Spans(grid.BYTE_CODES[raw])
        offset = leads  # of the anchor in the first window; in window i it is less by i
        block_hi, block_lo = offset // step, (offset - counts + 1) // step
        many = (block_hi - block_lo + 1).astype(np.int64)
        each = np.repeat(np.arange(len(h)), many)
        block = block_hi[each] - (np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many))
        lo = np.maximum(offset[each] - block * step - step + 1, 0)  # first and last window of the part
        hi = np.minimum(offset[each] - block * step, counts[each] - 1)
        base = bounds[:-1][each]
        core = base + offset[each] - block * step
        c = spans.of(core, core + window - step + 1, block)
        u = spans.of(base + lo, base + hi + window, offset[each] - lo)
        c = grid.mix(c ^ grid.mix(h.view(np.uint64)[each]))
        return c.view(np.int64), u.view(np.int64), ords[each] + lo, (hi - lo + 1).astype(np.int32), ords[each]

    def kernel(batches):
        for batch in batches:
            h, ords, counts, leads = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for a, b in grid.slices(grid.buffer_of(batch.column(4))[1], 1 << 19):
                out = rows(h[a:b], ords[a:b], counts[a:b].astype(np.int64), leads[a:b].astype(np.int64), batch.column(4).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in PARTS.split(",")])

    return found.select("h", "ord", "n", "lead", "context").mapInArrow(kernel, PARTS)


def built(distinct: DataFrame) -> DataFrame:
    """The side of a join that is hashed, one partition at a time: its keys are distinct, so partitions are even and the other side needs no sort."""
    return distinct.hint("shuffle_hash")


class SuffixFamily:
    """Levels of suffix arrays over the documents added so far, in a folder that all executors share."""

    def __init__(self, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, step: int = STEP) -> None:
        self.scratch, self.step = scratch, min(step, window)
        self.tokens = repeats.Tokens(window, min(anchor, window), None)
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []
        self.open: list[DataFrame] = []
        self.last = -1
        self.merges = 0
        self.unsorted: list[DataFrame] = []  # what the last level is read from, if it is not in order yet

    def add(self, batch: DataFrame, final: bool = False) -> None:
        """Adds a batch (key, text), whose keys lie above all keys before; after a final one no level is needed."""
        write, drop = self.scratch.write, self.scratch.drop
        runs = write(suffixes(batch, self.tokens), "runs")
        span = runs.agg(F.min("ord").alias("least"), F.max("ord").alias("most")).first()
        if span.least is None:
            drop(runs)
            return
        if span.least >> POSITION_BITS <= self.last:
            raise ValueError(f"key {span.least >> POSITION_BITS} of a new batch is not above {self.last}")
        self._merge()
        heads = write(runs.groupBy("h").agg(F.count("*").alias("c")), "heads")
        # The merge-scan: the levels' suffixes that start with an anchor of the batch.
        met = write(reduce(DataFrame.unionByName, [level.select("h", "span", "ord", "n", "lead") for _, level in self.levels]).join(built(heads.select("h")), "h", "left_semi"), "met") if self.levels else None
        # A run whose anchor starts no other one, here or in a level, is new and meets nothing: only the rest is compared.
        again = heads.filter("c > 1").select("h")
        again = write((again if met is None else again.unionByName(met.select("h"))).distinct(), "again")
        shared = built(again.select("h", F.lit(True).alias("shared")))
        split = runs.join(shared, "h", "left").withColumn("shared", F.coalesce("shared", F.lit(False))) if not final else runs.join(shared, "h")
        split = write(split.select(*ORDER, "ord", "n", "lead", "shared"), "split")
        drop(runs, heads, again)
        some = split.filter("shared")
        # Equal runs agree in all but their place.
        own = write(some.groupBy(*RUN).agg(*[F.min(c).alias(c) for c in ("ord", "a1", "a2", "n", "lead")], F.count("*").alias("c")), "own")
        if met is None:
            marked = own.withColumn("known", F.lit(False))
        else:
            marked = write(own.join(met.select(*RUN, F.lit(True).alias("known")), RUN, "left").withColumn("known", F.coalesce("known", F.lit(False))), "marked")
        copies = marked.filter("known OR c > 1").select(*RUN, F.col("ord").alias("first"), "known")
        self.found.append(write(some.select(*RUN, "ord", "n").join(copies, RUN).filter("known OR ord > first").select("ord", "n"), "found"))
        new = marked.filter("NOT known").select(*ORDER, "ord", "n", "lead")
        both = new.select("h", "ord", "n", "lead", F.lit(1).alias("fresh"))
        both = both if met is None else both.unionByName(met.select("h", "ord", "n", "lead", F.lit(0).alias("fresh")))
        branching = both.groupBy("h").agg(F.count("*").alias("c"), F.max("fresh").alias("fresh")).filter("c > 1 AND fresh = 1").select("h")
        self.open.append(write(both.join(branching, "h").select("h", "ord", "n", "lead"), "open"))
        held = own if met is None else marked
        if final:
            drop(split, held)
        else:
            self.levels.append((1, split.filter("NOT shared").select(*new.columns).unionByName(new)))
            self.unsorted = [split, held]
        drop(*([] if met is None else [met, own]))
        self.last = span.most >> POSITION_BITS

    def _sorted(self, array: DataFrame, size: int) -> DataFrame:
        """A written array, in suffix order over all of its files."""
        parts = int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.scratch.write(array.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER), f"level-{size}", keep=True)

    def _merge(self) -> None:
        """Levels of equal size become one of twice the size, which is written once; done when the next batch comes.

        The newest array is put in order here, with those it merges with or alone.
        """
        merged = []
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged += [a] if not merged else []  # else the level just made, whose arrays are in already
            merged.append(b)
            self.levels.append((2 * size, b))
            self.merges += 1
        if not merged:
            return self._settle()
        size, _ = self.levels.pop()
        self.levels.append((size, self._sorted(reduce(DataFrame.unionByName, merged), size)))
        self._release(merged)

    def _settle(self) -> None:
        """The newest array by itself, in order."""
        if self.unsorted:
            size, array = self.levels.pop()
            self.levels.append((size, self._sorted(array, size)))
            self._release([])

    def _release(self, arrays: list[DataFrame]) -> None:
        """Deletes written arrays, and what an array that is not in order yet is read from."""
        self.scratch.drop(*[a for a in arrays if hasattr(a, "_skein_path")], *self.unsorted)
        self.unsorted = []

    def close(self) -> None:
        """Deletes all levels, once nothing more is added."""
        self._release([level for _, level in self.levels])
        self.levels = []

    def save(self) -> str:
        """Writes what a later job needs and returns the folder."""
        spark, root = self.scratch.spark, self.scratch.root
        self.scratch.stay()
        self._settle()
        rows = [("level", size, level._skein_path) for size, level in self.levels] + [("state", self.last, f"{self.tokens.window},{self.tokens.anchor},{self.step}")]
        spark.createDataFrame(rows, "kind string, size long, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
        return root

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str) -> SuffixFamily:
        """The family that `save` wrote to this folder."""
        rows = spark.read.parquet(f"{folder}/manifest").collect()  # a row a level
        state = next(r for r in rows if r.kind == "state")
        family = cls(Scratch(spark, "suffix", folder), *map(int, state.value.split(",")))
        family.last = state.size
        for row in sorted((r for r in rows if r.kind == "level"), key=lambda r: -r.size):
            family.levels.append((row.size, family.scratch.open(row.value, SUFFIXES)))
        return family

    def earlier(self, docs: DataFrame) -> DataFrame:
        """(ord, n): runs of windows of the batches added by this object that also start earlier.

        docs: (key, text), all documents added; only those with something set
        aside are read again.
        """
        empty = self.scratch.spark.createDataFrame([], "ord long, n int")
        found = reduce(DataFrame.unionByName, self.found, empty)
        if not self.open:
            return found
        write, drop = self.scratch.write, self.scratch.drop
        aside = write(reduce(DataFrame.unionByName, self.open).groupBy("ord").agg(*[F.first(c).alias(c) for c in ("h", "n", "lead")]), "aside")
        texts = write(contexts(docs, aside, self.tokens), "contexts")
        parts = write(refined(texts, self.tokens.window, self.step), "parts")
        cores = write(parts.groupBy("c").agg(F.count("*").alias("m")).filter("m > 1").select("c"), "cores")
        shared = write(parts.join(cores, "c"), "shared")
        drop(aside, parts, cores)
        classes = write(shared.groupBy("c", "u").agg(F.min("ord").alias("first")), "classes")
        deep = write(classes.groupBy("c").agg(F.count("*").alias("m")).filter("m > 1").select("c"), "deep")
        later = shared.join(classes, ["c", "u"])
        out = found.unionByName(write(later.filter("ord > first").select("ord", "n"), "later"))
        # What branches once more: the first part of each class, window by window.
        last = later.filter("ord = first").join(deep, "c").select("owner", F.struct((F.col("ord") - F.col("owner")).cast("int").alias("at"), "n").alias("part"))
        asked = last.groupBy(F.col("owner").alias("ord")).agg(F.collect_list("part").alias("parts"))  # at most one for each STEP windows of a run
        single = write(windows(texts.join(asked, "ord").select("h", "ord", "lead", "context", "parts"), self.tokens.window), "windows")
        drop(texts, shared, classes, deep)
        twice = write(single.groupBy("c", "u").agg(F.min("ord").alias("first"), F.count("*").alias("m")).filter("m > 1").select("c", "u", "first"), "twice")
        out = out.unionByName(write(single.join(twice, ["c", "u"]).filter("ord > first").select("ord", F.lit(1).alias("n")), "single"))
        drop(single, twice)
        return out


def windows(found: DataFrame, window: int) -> DataFrame:
    """(c, u, ord): each window in the parts of (h, ord, lead, context, parts)."""

    def kernel(batches):
        for batch in batches:
            h, ords, leads = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b in grid.slices(grid.buffer_of(batch.column(3))[1], 1 << 19):
                raw, bounds = grid.buffer_of(batch.column(3).slice(a, b - a))
                lists = batch.column(4).slice(a, b - a)
                ends = lists.offsets.to_numpy()
                at, n = (lists.values.field(i).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64) for i in (0, 1))
                row = np.repeat(np.repeat(np.arange(b - a), np.diff(ends)), n)
                place = np.repeat(at, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                grams = grid.rolling(grid.BYTE_CODES[raw], window)[bounds[:-1][row] + place]
                mark = grid.mix(h[a:b].view(np.uint64)[row] ^ grid.mix((leads[a:b].astype(np.int64)[row] - place).astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(grams.view(np.int64)), pa.array(ords[a:b][row] + place)], names=["c", "u", "ord"])

    return found.mapInArrow(kernel, "c long, u long, ord long")


def deal(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The documents in `batches` ranges of key, about equal."""
    cuts = docs.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)], 1000).alias("q")).first().q if batches > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [docs]
    bounds = [None, *cuts, None]
    parts = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = docs if lo is None else docs.filter(F.col("key") > lo)
        parts.append(part if hi is None else part.filter(F.col("key") <= hi))
    return parts


def earlier_runs(docs: DataFrame, family: SuffixFamily, batches: int) -> DataFrame:
    """(ord, n): runs of windows of (key, text) that also start earlier."""
    parts = deal(docs, batches)
    for i, part in enumerate(parts, 1):
        family.add(part, i == len(parts))
    found = family.earlier(docs)
    family.close()
    return found


def remove_earlier(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, with_text: bool = True, step: int = STEP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "suffix")
    own = keyed(docs, scratch)
    family = SuffixFamily(scratch, window, anchor, step)
    kept = repeats.remove(own, earlier_runs(own, family, batches), family.tokens, with_text, ("doc_id",))
    return scratch.result(kept.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept_text"))


def strip_earlier(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """All rows and columns of `docs`, the texts without bytes of windows that also start earlier."""
    scratch = Scratch(docs.sparkSession, "suffix")
    own = keyed(docs, scratch, whole=True)
    family = SuffixFamily(scratch, window, anchor)
    found = scratch.result(earlier_runs(own, family, batches))
    kept = repeats.remove(own, found, family.tokens, True, ("doc_id", "row"))
    return rebuilt(kept.select("doc_id", F.col("kept_text").alias("text"), "row"), docs, True)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_earlier(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
