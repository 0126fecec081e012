"""Benchmark decontamination through a generalised suffix automaton (operator 8).

The automaton holds every substring of the normalised benchmark items. Training
tokens stream through it and the longest match that ends at each token is
tracked: from `window` tokens on, all of the match lies in benchmark windows.
Items shorter than a window count as one window, found at the automaton states
where they end. Tokens are skipped in numpy where no three of them in a row
occur in the items, as no window can hold them.

Items are collected to the driver only up to about `shard_bytes` of text at
once; a larger benchmark is scanned in shards of that size, one after the other,
whose hits are united, so what is collected and broadcast stays bounded. An
item larger than that is cut into overlapping pieces under its id.

Defined results: null, empty and wordless texts have no words and no hits; a very
long text is scanned whole, within one batch; equal texts under two ids count
with both, and equal items once; a null item text has no windows; items of null
id are one item, which n_items counts and items_sha256 leaves out; an empty
benchmark hits nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid
from .runtime import Scratch, keyed, rebuilt

WINDOW = 10
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES = 4 << 20
BITS = 22


class SuffixAutomaton:
    """All substrings of the items added, each an array of token numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, tokens: list[int]) -> None:
        last = 0
        for c in tokens:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new


class Matcher:
    """The automaton of one shard of items, with the items that pass each long state."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        arrow = pa.array([t for _, t in items], pa.string())
        raw, offsets = grid.buffer_of(arrow)
        hashes, before = tokenize(raw, offsets)[:2]
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes)
        sizes = np.diff(before)
        self.shortest = int(min(window, sizes[sizes > 0].min())) if (sizes > 0).any() else 0
        self.gram = min(3, self.shortest)
        self.automaton, self.items, self.whole = SuffixAutomaton(), {}, {}
        texts = [numbers[before[i] : before[i + 1]].tolist() for i in range(len(items))]
        for t in texts:
            self.automaton.add(t)
        if self.gram:
            grams = [grid.rolling(hashes[before[i] : before[i + 1]], self.gram) for i in range(len(items))]
            self.grams = np.unique(np.concatenate(grams))
            self.bitmap = np.zeros(1 << BITS, bool)
            self.bitmap[self.grams & np.uint64((1 << BITS) - 1)] = True
        for (name, _), t in zip(items, texts):
            self._pass(name, t)
        self.nearest = self._nearest()

    def _long(self, state: int, length: int) -> int:
        a = self.automaton
        while a.length[a.link[state]] >= length:
            state = a.link[state]
        return state

    def _pass(self, name: str, tokens: list[int]) -> None:
        a, state = self.automaton, 0
        if 0 < len(tokens) < self.window:
            for c in tokens:
                state = a.next[state][c]
            self.whole.setdefault(state, []).append((len(tokens), name))
            return
        for i, c in enumerate(tokens):
            state = a.next[state][c]
            if i + 1 >= self.window:
                self.items.setdefault(self._long(state, self.window), set()).add(name)

    def _nearest(self) -> list[int]:
        """For each state the next one on its suffix links (itself included) where a short item ends, or -1."""
        a = self.automaton
        out = [-1] * len(a.next)
        for s in sorted(range(len(a.next)), key=a.length.__getitem__):
            out[s] = s if s in self.whole else (out[a.link[s]] if a.link[s] >= 0 else -1)
        return out

    def scan(self, tokens: list[int], hit: np.ndarray, names: set) -> None:
        """Marks the hit tokens and adds the items whose windows occur."""
        a, window, whole, nearest = self.automaton, self.window, self.whole, self.nearest
        follow, link, size = a.next, a.link, a.length
        state, length = 0, 0
        for i, c in enumerate(tokens):
            while state and c not in follow[state]:
                state = link[state]
                length = size[state]
            if c in follow[state]:
                state = follow[state][c]
                length += 1
            else:
                length = 0
            if length >= window:
                hit[i - window + 1 : i + 1] = True
                names.update(self.items[self._long(state, window)])
            if whole:
                s = nearest[state]
                while s > 0:
                    for n, name in whole[s]:
                        if n <= length:
                            hit[i - n + 1 : i + 1] = True
                            names.add(name)
                    s = nearest[link[s]]

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Token ranges whose every `gram` tokens occur in the items, long enough for a window."""
        if not self.gram or len(hashes) < self.shortest:
            return []
        grams = grid.rolling(hashes, self.gram)
        ok = self.bitmap[grams & np.uint64((1 << BITS) - 1)]
        some = np.flatnonzero(ok)
        place = np.searchsorted(self.grams, grams[some])
        place[place == len(self.grams)] = 0
        ok[some] = self.grams[place] == grams[some]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        return [(lo, hi + self.gram - 1) for lo, hi in edges.reshape(-1, 2).tolist() if hi - lo + self.gram - 1 >= self.shortest]


def tokenize(raw: np.ndarray, offsets: np.ndarray):
    """(word hashes, words before each text, byte starts, byte ends) after ASCII lower-casing."""
    raw = grid.LOWER[raw]
    starts, ends, before = grid.word_spans(raw, offsets, grid.NON_ALNUM)
    return grid.span_hashes(raw, starts, ends), before, starts, ends


HITS = "key long, n_words long, items array<string>, words array<long>, spans array<long>"


def scan(docs: DataFrame, matcher) -> DataFrame:
    """HITS rows: hit word ranges [first, last) and their byte ranges, both flattened. matcher: a broadcast."""

    def kernel(batches):
        known = matcher.value
        for batch in batches:
            keys = batch.column(0)
            raw, offsets = grid.buffer_of(batch.column(1))
            for a, b in grid.slices(offsets):
                base = offsets[a]
                hashes, before, starts, ends = tokenize(raw[base : offsets[b]], offsets[a : b + 1] - base)
                names: list[list] = [[] for _ in range(b - a)]
                words: list[list] = [[] for _ in range(b - a)]
                spans: list[list] = [[] for _ in range(b - a)]
                found: dict[int, tuple[np.ndarray, set]] = {}
                for lo, hi in known.candidates(hashes):
                    i = int(np.searchsorted(before, lo, "right")) - 1
                    while lo < hi:  # a range may run over the ends of texts
                        stop = min(hi, int(before[i + 1]))
                        if stop - lo >= known.shortest:
                            hit, seen = found.setdefault(i, (np.zeros(int(before[i + 1] - before[i]), bool), set()))
                            tokens = np.searchsorted(known.vocabulary, hashes[lo:stop]).tolist()
                            known.scan(tokens, hit[lo - before[i] : stop - before[i]], seen)
                        lo, i = stop, i + 1
                for i, (hit, seen) in found.items():
                    if seen:
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                        names[i], words[i] = sorted(seen, key=lambda x: (x is None, x or "")), edges.tolist()
                        at = before[i] + edges.reshape(-1, 2)
                        text = offsets[a + i] - base
                        spans[i] = np.stack([starts[at[:, 0]] - text, ends[at[:, 1] - 1] - text], 1).ravel().tolist()
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(np.diff(before)), pa.array(names, pa.list_(pa.string())), pa.array(words, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64()))],
                    names=["key", "n_words", "items", "words", "spans"],
                )

    return docs.select("key", "text").mapInArrow(kernel, HITS)


def united(lists: Column) -> Column:
    """The union of lists of flattened ranges as flattened ranges; touching ones are joined."""
    flat = F.flatten(lists)
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)), lambda i: F.struct(F.get(flat, i).alias("lo"), F.get(flat, i + 1).alias("hi"))))
    none = F.array().cast("array<bigint>")

    def step(done: Column, x: Column) -> Column:
        joins = F.coalesce(x["lo"] <= done["hi"], F.lit(False))
        closed = F.when(joins | done["hi"].isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(done["lo"], done["hi"])))
        return F.struct(closed.alias("out"), F.when(joins, done["lo"]).otherwise(x["lo"]).alias("lo"), F.when(joins, F.greatest(done["hi"], x["hi"])).otherwise(x["hi"]).alias("hi"))

    start = F.struct(none.alias("out"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    merged = F.aggregate(pairs, start, step, lambda done: F.concat(done["out"], F.array(done["lo"], done["hi"])))
    return F.when(F.size(flat) < 2, none).otherwise(merged)


def shard_rows(benchmark: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(item_id, text): distinct items; one of more than `shard_bytes` comes in pieces that overlap by a window less a word."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    step = max(window, shard_bytes // 16)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    large = items.filter(F.octet_length("text") > shard_bytes).select("item_id", words.alias("words"))
    pieces = large.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, step + window - 1), " "))).alias("text"))
    return items.filter(F.octet_length("text") <= shard_bytes).unionByName(pieces)


def hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """HITS rows of all documents (key, text) against all items (item_id, text).

    One shard's automaton lives at a time: its hits are written and its broadcast
    is destroyed before the next one is built.
    """
    context = docs.sparkSession.sparkContext
    items = scratch.write(shard_rows(benchmark, window, shard_bytes), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first().b
    shards = max(1, -(-total // shard_bytes))
    parts = []
    for s in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        matcher = context.broadcast(Matcher([(r.item_id, r.text) for r in part.collect()], window))  # about shard_bytes of text
        parts.append(scratch.write(scan(docs, matcher), f"hits-{s}"))
        matcher.destroy(blocking=True)
    scratch.drop(items)
    if shards == 1:
        return parts[0]
    some = reduce(DataFrame.unionByName, [p.filter(F.size("items") > 0) for p in parts])
    grouped = some.groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), united(F.collect_list("words")).alias("words"), united(F.collect_list("spans")).alias("spans"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return parts[0].select("key", "n_words").join(grouped, "key", "left").select("key", "n_words", none("items", "string"), none("words", "bigint"), none("spans", "bigint"))


def report(found: DataFrame) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, spans) from HITS rows."""
    signed = F.transform("words", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    joined = F.array_join(F.array_sort(F.array_distinct("items")), ",")
    return found.select("key", "n_words", n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "spans").withColumn("contaminated", F.col("n_hit") > 0)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its byte spans, which begin and end with words; what stood on both sides of one is kept apart by white space."""
    raw = text.cast("binary")
    odd = lambda n: F.filter(spans, lambda _, i: i % 2 == n)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), odd(1))
    ends = F.concat(odd(0), F.array(F.octet_length(text).cast("bigint")))
    kept = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    return F.when(text.isNotNull() & (F.coalesce(F.size(spans), F.lit(0)) > 0), F.array_join(kept, " ")).otherwise(text)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = keyed(docs, scratch)
    found = scratch.write(report(hits(own, benchmark, scratch, **options)), "found")
    return scratch.result(found.join(own.select("key", "doc_id"), "key").drop("key"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All rows and columns of `docs`, the texts without the spans of benchmark windows."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = keyed(docs, scratch, whole=True)
    spans = hits(own, benchmark, scratch, **options).filter(F.size("spans") > 0).select("key", "spans")
    joined = own.join(scratch.result(spans), "key", "left")
    return rebuilt(joined.select("doc_id", cut_spans(F.col("text"), F.col("spans")).alias("text"), "row"), docs, True)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("spans")
