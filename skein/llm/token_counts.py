"""Edit-aware token counts (operator 9).

Each document keeps a segment tree: its leaves are stretches of text of about
`LEAF` characters that end after white space, and every node holds the tokens
below it, so the root holds the document's count. The tokenizer drops white space
and no token crosses it, hence leaves can be encoded by themselves. An edit
touches the leaves that it overlaps and, where it takes away the white space that
ends a leaf, the next one; only these are encoded again, and the sums on their
paths to the root are updated. Leaves that grow beyond four times `LEAF` are cut
anew.

Defined results: a null text is empty and has no tokens; a very long text has as
many leaves as it needs, but one without white space is a single leaf, so that any
edit encodes all of it again; edits are (start, stop,
insert) in characters of the old text, sorted and disjoint, cut to the text, with
a null insert being empty; equal rows are counted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

LEAF = 400
_SPACE = re.compile(r"[ \t\n\r]+")

TREES = "doc_id long, text string, ends array<int>, tree array<int>"
COUNTED = TREES + ", n_before long, n_tokens long, n_leaves long, n_encoded long"


def leaf_ends(text: str, leaf: int = LEAF) -> list[int]:
    """Where the leaves of a text end; one leaf at least."""
    out, at = [], leaf
    while at < len(text):
        found = _SPACE.search(text, at)
        if not found or found.end() >= len(text):
            break
        out.append(found.end())
        at = found.end() + leaf
    out.append(len(text))
    return out


def tree_of(counts: list[int]) -> list[int]:
    """Heap of sums: node i has children 2i and 2i+1, leaves start at half its length."""
    size = 1 << max(0, (len(counts) - 1).bit_length())
    tree = [0] * size + counts + [0] * (size - len(counts))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def update(tree: list[int], leaf: int, count: int) -> None:
    i = len(tree) // 2 + leaf
    change = count - tree[i]
    while i:
        tree[i] += change
        i //= 2


def touched(ends: list[int], edits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) of leaves that must be encoded together again."""
    out: list[list[int]] = []
    at = 0
    for start, stop in edits:
        while at < len(ends) - 1 and ends[at] <= start:
            at += 1
        first = last = at
        while last < len(ends) - 1 and ends[last] <= stop:  # the white space at its end may go
            last += 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for start, stop, insert in edits:
        parts += [text[last:start], insert]
        last = stop
    return "".join([*parts, text[last:]])


def clean(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits within the text."""
    out = []
    for e in edits or []:
        start = min(max(e["start"] or 0, 0), size)
        out.append((start, min(max(e["stop"] if e["stop"] is not None else start, start), size), e["insert"] or ""))
    return out


def recount(text: str, ends: list[int], tree: list[int], edits: list[tuple[int, int, str]], count, leaf: int = LEAF):
    """(text, ends, tree, leaves encoded) after the edits. count: token counts of a list of texts."""
    if not edits:
        return text, ends, tree, 0
    ranges = touched(ends, [(a, b) for a, b, _ in edits])
    half, base = len(tree) // 2, 0
    pieces, new_ends, counts, jobs = [], [], [], []
    done, e, grown = 0, 0, False
    for first, last in [*ranges, (len(ends), len(ends))]:
        for i in range(done, first):  # untouched leaves keep their counts
            start = ends[i - 1] if i else 0
            pieces.append(text[start : ends[i]])
            base += ends[i] - start
            new_ends.append(base)
            counts.append(tree[half + i])
        if first == len(ends):
            break
        lo, hi, own = (ends[first - 1] if first else 0), ends[last], []
        # The range's last leaf also takes edits at its very end where the text ends there.
        while e < len(edits) and (edits[e][0] < hi or hi == len(text)):
            own.append((edits[e][0] - lo, edits[e][1] - lo, edits[e][2]))
            e += 1
        part = edited(text[lo:hi], own)
        inner = leaf_ends(part, leaf) if len(part) > 4 * leaf * (last - first + 1) else [len(part)]
        grown = grown or len(inner) != last - first + 1
        for k in range(max(len(inner), last - first + 1)):
            a, b = (inner[k - 1] if k else 0, inner[k]) if k < len(inner) else (len(part), len(part))
            pieces.append(part[a:b])
            new_ends.append(base + b)
            jobs.append((len(counts), part[a:b]))
            counts.append(0)
        base += len(part)
        done = last + 1
    some = [(i, t) for i, t in jobs if t]
    for (i, _), n in zip(some, count([t for _, t in some])):
        counts[i] = n
    if len(counts) == len(ends):
        tree = list(tree)
        for i, _ in jobs:
            update(tree, i, counts[i])
    else:
        tree = tree_of(counts)
    return "".join(pieces), new_ends, tree, len(some)


def _counter(known):
    return lambda texts: [len(x) // 4 for x in known.encode(texts)]


def build_trees(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """TREES rows of every row of `docs` (doc_id, text)."""

    def built(count, batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                ends = [leaf_ends(t, leaf) for t in part]
                counts = count([t[a:b] for t, e in zip(part, ends) for a, b in zip([0, *e], e)])
                trees, at = [], 0
                for e in ends:
                    trees.append(tree_of(counts[at : at + len(e)]))
                    at += len(e)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(part)), pa.array(part, pa.string()), pa.array(ends, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int32()))], names=["doc_id", "text", "ends", "tree"])

    def kernel(batches):
        with encoder(path) as known:
            yield from built(_counter(known), batches)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(kernel, TREES)


def apply_edits(trees: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """COUNTED rows: TREES rows with a column edits (start, stop, insert), after those edits."""

    def edited_rows(count, batches):
        for batch in batches:
            ids = batch.column(0)
            rows = zip(*[batch.column(i).to_pylist() for i in range(1, 5)])
            done = [(*recount(t, e, tree, clean(edits, len(t)), count, leaf), len(e), tree[1]) for t, e, tree, edits in rows]
            columns = [[x[k] for x in done] for k in range(6)]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0], pa.string()), pa.array(columns[1], lists), pa.array(columns[2], lists), pa.array(columns[5], pa.int64()), pa.array([t[1] for t in columns[2]], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["doc_id", "text", "ends", "tree", "n_before", "n_tokens", "n_leaves", "n_encoded"],
            )

    def kernel(batches):
        with encoder(path) as known:
            yield from edited_rows(_counter(known), batches)

    return trees.select("doc_id", "text", "ends", "tree", "edits").mapInArrow(kernel, COUNTED)


def revision(text):
    """The query's edits of a text: words put in at a third, ten characters out at half, five replaced at three quarters."""
    n = F.length(text)
    at = lambda share, width, insert: F.struct(F.floor(n * share).cast("int").alias("start"), (F.floor(n * share) + width).cast("int").alias("stop"), F.lit(insert).alias("insert"))
    return F.when(n < 60, F.array(at(0.0, 0, "Revised text. "))).otherwise(F.array(at(1 / 3, 0, "Revised text. "), at(1 / 2, 10, ""), at(3 / 4, 5, "newer")))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_before, n_tokens, n_leaves, n_encoded): counts of all documents before and after `revision`."""
    trees = build_trees(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    after = apply_edits(trees.withColumn("edits", revision(F.col("text"))))
    return after.select("doc_id", "n_before", "n_tokens", "n_leaves", "n_encoded")
