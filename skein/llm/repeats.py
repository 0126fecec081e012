"""Text kernels of the two dedup operators on exact repeats: anchored windows, and taking them out.

Every window of K tokens holds K-k+1 k-mers; its anchor is the leftmost one of
smallest hash. Equal windows have equal anchors at equal offsets, so only the
anchors (about 2/(K-k+2) of the positions) have to meet in a shuffle. The windows
with one anchor are neighbours: they form a run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grid
from .runtime import POSITION_BITS

#: Tokens of a very long text that are looked at together; runs end there, which only makes classes of their own.
SEGMENT, SLICE = 4 << 20, 1 << 20


class Tokens:
    """How a text becomes tokens: bytes, or words by a separator table."""

    def __init__(self, window: int, anchor: int, separators: np.ndarray | None) -> None:
        self.window, self.anchor, self.separators = window, anchor, separators

    def of(self, raw: np.ndarray, offsets: np.ndarray):
        """(token hashes, tokens before each text, byte starts, byte ends)."""
        before, starts, ends = self.places(raw, offsets)
        return (grid.BYTE_CODES[raw] if starts is None else grid.span_hashes(raw, starts, ends)), before, starts, ends

    def places(self, raw: np.ndarray, offsets: np.ndarray):
        """(tokens before each text, byte starts, byte ends); bytes need no starts and ends."""
        if self.separators is None:
            return offsets, None, None
        starts, ends, before = grid.word_spans(raw, offsets, self.separators)
        return before, starts, ends


def window_starts(before: np.ndarray, window: int) -> np.ndarray:
    """True where a whole window of one text starts."""
    total = int(before[-1])
    ok = np.ones(max(total - window + 1, 0), bool)
    if len(ok):
        lengths = np.diff(before)
        mark = np.zeros(total + 1, np.int32)
        lo = np.maximum(before[1:] - window + 1, before[:-1])
        some = lengths > 0
        np.add.at(mark, lo[some], 1)
        np.add.at(mark, before[1:][some], -1)
        ok = np.cumsum(mark)[: len(ok)] == 0
    return ok


def anchors(values: np.ndarray, before: np.ndarray, window: int, k: int):
    """(window starts, anchor hash of each) of all whole windows, and each one's anchor position."""
    ok = window_starts(before, window)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    grams = grid.rolling(values, k)
    low = np.uint64((1 << POSITION_BITS) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (grid.sliding_min(ranked, window - k + 1)[starts] & low).astype(np.int64)
    return starts, grams[at], at


class Spans:
    """Hashes of token ranges of one flat array, each free of its place and told apart by its length."""

    def __init__(self, values: np.ndarray) -> None:
        self.total = np.empty(len(values) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(values * grid.powers(grid.BASE, len(values)), out=self.total[1:])
        self.back = grid.powers(grid.BASE_INV, len(values) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray, salt=0) -> np.ndarray:
        """Hash of [lo, hi) of each pair; `salt` (a number or one for each) keeps kinds of ranges apart."""
        raw = (self.total[hi] - self.total[lo]) * self.back[lo]
        shape = (hi - lo).astype(np.uint64) * np.uint64(0x100000001B3) + np.asarray(salt).astype(np.uint64)
        return grid.mix(raw ^ grid.mix(shape + np.uint64(1)))


def runs_of(values: np.ndarray, before: np.ndarray, window: int, k: int):
    """(text index, first window's start, windows, anchor's start, anchor hash) of every run; starts in `values`."""
    starts, hashes, at = anchors(values, before, window, k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    first = np.ones(len(starts), bool)
    first[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    lead = np.flatnonzero(first)
    begin = starts[lead]
    return np.searchsorted(before, begin, "right") - 1, begin, np.diff(np.append(lead, len(starts))), at[lead], hashes[lead]


def over_texts(docs: DataFrame, tokens: Tokens, schema: str, rows) -> DataFrame:
    """What `rows` makes of the texts of (key, text), as `schema`.

    rows(values, before, keys, first) gets the token hashes of some texts, the
    tokens before each text, their keys and the place of the first token in its
    text: a text of more than SEGMENT tokens comes in pieces, which overlap by
    one token less than a window, so that each window lies in one piece.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def parts(values: np.ndarray, before: np.ndarray):
        if before[-1] <= SEGMENT or len(before) > 2:
            yield 0, values, before
            return
        for at in range(0, int(before[-1]), SEGMENT):
            piece = values[at : at + SEGMENT + tokens.window - 1]
            yield at, piece, np.array([0, len(piece)])

    def kernel(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = grid.buffer_of(batch.column(1))
            for a, b in grid.slices(offsets, SLICE):
                if offsets[a + 1] - offsets[a] >= 1 << POSITION_BITS:
                    raise ValueError(f"a text of {offsets[a + 1] - offsets[a]} bytes is above the limit of 2**{POSITION_BITS}")
                own = raw[offsets[a] : offsets[b]]
                values, before = (own, offsets[a : b + 1] - offsets[a]) if tokens.separators is None else tokens.of(own, offsets[a : b + 1] - offsets[a])[:2]
                for first, piece, bounds in parts(values, before):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(piece, bounds, keys[a:b], first)], names=names)

    return docs.select("key", "text").mapInArrow(kernel, schema)


def by_key(rows: DataFrame, *extra: str) -> DataFrame:
    """One row a document: its ords and window counts as lists (bounded by the document)."""
    return rows.groupBy(F.shiftright("ord", POSITION_BITS).alias("key")).agg(F.collect_list(F.struct("ord", "n", *extra)).alias("runs"))


def covered(count: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """True for the tokens inside any [start, start + length)."""
    mark = np.zeros(count + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + lengths, -1)
    return np.cumsum(mark[:-1]) > 0


RESULT = "key long, n_tokens long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove(docs: DataFrame, runs: DataFrame, tokens: Tokens, with_text: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """RESULT rows of all documents: the windows in `runs` (ord, n) are taken out.

    Columns of `docs` named in `carry` are passed through.

    Words that stay are joined by one space; bytes that stay are concatenated.
    kept_text is null unless asked for or where the text is; the bytes of a
    character that a cut splits are left out of it (not of the digest).
    """
    low = (1 << POSITION_BITS) - 1
    names = [x.split()[0] for x in RESULT.split(",")]

    def kernel(batches):
        for batch in batches:
            keys = batch.column(0)
            raw, offsets = grid.buffer_of(batch.column(1))
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            at, width = (lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            at &= low
            for a, b in grid.slices(offsets):
                part = raw[offsets[a] : offsets[b]]
                before, starts, ends = tokens.places(part, offsets[a : b + 1] - offsets[a])
                whole = part.tobytes()
                out = []
                for i in range(b - a):
                    lo, hi, x, y = before[i], before[i + 1], bounds[a + i], bounds[a + i + 1]
                    gone = covered(hi - lo, at[x:y], width[x:y] + tokens.window - 1) if y > x else np.zeros(hi - lo, bool)
                    edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    if starts is None:
                        kept = part[lo:hi][~gone].tobytes()
                    else:
                        kept = b" ".join([whole[s:e] for s, e in zip(starts[lo:hi][~gone].tolist(), ends[lo:hi][~gone].tolist())])
                    text = kept.decode("utf-8", "ignore") if with_text and not nulls[a + i] else None
                    out.append((hi - lo, int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), text))
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                passed = [batch.column(3 + i).slice(a, b - a) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *columns, *passed], names=[*names, *carry])

    joined = docs.select("key", "text", *carry).join(by_key(runs), "key", "left").select("key", "text", "runs", *carry)
    schema = T.StructType(T.StructType.fromDDL(RESULT).fields + [docs.schema[c] for c in carry])
    return joined.mapInArrow(kernel, schema)
