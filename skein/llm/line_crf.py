"""Quality classifier: a linear-chain conditional random field over lines (operator 6).

Every line of a text is labelled good or bad from features of itself and of the
lines before and after it; transitions tie neighbours together. Forward-backward
marginals, weighted by line length, add up to the share of good text, which a
fitted logistic curve turns into the score.

The field is fitted on about `sample_docs` labelled texts, twice that at most, of
`sample_bytes` bytes or less, whose lines all take the label of their document.

Defined results: null, empty and blank texts have no lines and score the share of
label 1 among the rows learned from (1/2 if there are none); a very long text is
scored whole; equal texts score alike; a score of just the threshold predicts 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .language_id import held_out

SAMPLE_DOCS, SAMPLE_BYTES = 3000, 20_000
THRESHOLD = 0.3
#: Byte classes that are counted in each line.
CLASSES = (b"#*$%&|<>", b"!?", bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b",;:.", b"@/\\_=+~^{}[]()\"'", b" \t")


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES):
        table[list(members)] = i
    return table


CLASS_OF = _class_table()
#: Features of one line; the model sees those of the line and of its two neighbours.
BASE = len(CLASSES) + 8


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines that hold a word, their byte lengths, lines before each text)."""
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    starts, ends, _ = grid.word_spans(raw, offsets, newline)
    words, stops, _ = grid.word_spans(raw, offsets, grid.SPACE)
    hashes = grid.span_hashes(raw, words, stops)
    at = np.searchsorted(words, starts)
    count = np.searchsorted(words, ends) - at
    keep = count > 0
    starts, ends, at, count = starts[keep], ends[keep], at[keep], count[keep]
    before = np.searchsorted(starts, offsets)
    n, size = len(starts), (ends - starts).astype(float)
    out = np.zeros((n, BASE), np.float32)
    if not n:
        return np.zeros((0, 3 * BASE), np.float32), size, before
    kind = CLASS_OF[raw]
    for i in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(kind == i)])
        out[:, i] = (total[ends] - total[starts]) / size

    def per_line(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at + count] - total[at]

    j = len(CLASSES)
    same = np.zeros(len(words), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    line = np.repeat(np.arange(n), count)
    order = np.lexsort((hashes, line))
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    again = np.bincount(line[order], again, n)
    whole = grid.span_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    order = np.lexsort((whole, doc))
    twin = np.zeros(n, bool)
    equal = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    out[:, j] = per_line(same) / count
    out[:, j + 1] = again / count
    out[:, j + 2] = twin
    out[:, j + 3] = np.minimum(count, 40) / 40
    out[:, j + 4] = np.minimum((size / count) / 20, 2)
    out[:, j + 5] = CLASS_OF[raw[ends - 1]] == 4
    out[:, j + 6] = count < 4
    out[:, j + 7] = 1
    left, right = np.zeros_like(out), np.zeros_like(out)
    left[1:], right[:-1] = out[:-1], out[1:]
    left[before[:-1][np.diff(before) > 0]] = 0
    right[before[1:][np.diff(before) > 0] - 1] = 0
    return np.concatenate([out, left, right], 1), size, before


class Chain:
    """Good/bad chain: `weights` for the good label, `move[a, b]` from label a to label b."""

    def __init__(self, features: int) -> None:
        self.weights, self.move = np.zeros(features), np.zeros((2, 2))
        self.curve, self.share = np.array([1.0, 0.0]), 0.5

    def _tables(self, emit: np.ndarray, lengths: np.ndarray):
        """Log forward and backward tables of padded texts (text, line, label), longest text first."""
        texts, steps, _ = emit.shape
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps + 1)]  # texts with more than t lines
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, steps):
            m = live[t]
            ahead[:m, t] = np.logaddexp(ahead[:m, t - 1, 0, None] + self.move[0], ahead[:m, t - 1, 1, None] + self.move[1]) + emit[:m, t]
        for t in range(steps - 2, -1, -1):
            m = live[t + 1]
            onward = emit[:m, t + 1] + behind[:m, t + 1]
            behind[:m, t] = np.logaddexp(onward[:, 0, None] + self.move[:, 0], onward[:, 1, None] + self.move[:, 1])
        last = ahead[np.arange(texts), lengths - 1]
        return ahead, behind, np.logaddexp(last[:, 0], last[:, 1])

    def marginals(self, features: np.ndarray, before: np.ndarray, limit: int = 200_000) -> np.ndarray:
        """Probability that each line is good. Texts of like length are padded together."""
        out, sizes = np.zeros(len(features)), np.diff(before)
        score = features @ self.weights
        order = np.argsort(-sizes, kind="stable")
        order, i = order[sizes[order] > 0], 0
        while i < len(order):
            steps = int(sizes[order[i]])
            some = order[i : i + max(1, limit // steps)]
            i += len(some)
            lengths = sizes[some]
            at = before[some][:, None] + np.arange(steps)
            inside = np.arange(steps) < lengths[:, None]
            emit = np.zeros((*inside.shape, 2))
            emit[inside, 1] = score[at[inside]]
            ahead, behind, total = self._tables(emit, lengths)
            good = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
            out[at[inside]] = good[inside]
        return np.clip(out, 0, 1)

    def fit(self, features: np.ndarray, before: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> None:
        """Maximum conditional likelihood by Adam over all lines (each takes its text's label)."""
        sizes = np.diff(before)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        groups = []
        for some in np.array_split(order, max(1, len(order) // 400)):
            if not len(some):
                continue
            lengths, steps = sizes[some], int(sizes[some[0]])
            at = before[some][:, None] + np.arange(steps)
            inside = np.arange(steps) < lengths[:, None]
            groups.append((lengths, at[inside], inside, labels[some].astype(int)))
        total = max(1, len(features))
        theta = np.concatenate([self.weights, self.move.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)
            slope = np.zeros(len(theta))
            score = features @ self.weights
            for lengths, at, inside, label in groups:
                emit = np.zeros((*inside.shape, 2))
                emit[inside, 1] = score[at]
                ahead, behind, z = self._tables(emit, lengths)
                good = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None])[inside]
                truth = np.broadcast_to(label[:, None], inside.shape)[inside]
                slope[:-4] += features[at].T @ (truth - good)
                pair = ahead[:, :-1, :, None] + self.move + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]
                slope[-4:] -= np.exp(pair[inside[:, 1:]]).sum(0).ravel() if inside.shape[1] > 1 else 0
                for a in (0, 1):
                    slope[-4 + 3 * a] += (lengths[label == a] - 1).sum()
            slope = slope / total - decay * theta
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.move = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()

    def good_share(self, features: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; not a number for texts without lines."""
        good = self.marginals(features, before)
        weight = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(sizes * good)])
        with np.errstate(invalid="ignore", divide="ignore"):
            return (sums[before[1:]] - sums[before[:-1]]) / (weight[before[1:]] - weight[before[:-1]])

    def calibrate(self, share: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve from the share of good text to the probability of label 1, by Newton steps."""
        x = np.stack([_logit(share), np.ones(len(share))], 1)
        beta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            beta = beta + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-3 * (beta - [1.0, 0.0]))
        if beta[0] > 0:
            self.curve = beta

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        share = self.good_share(*line_features(raw, offsets))
        z = _logit(np.nan_to_num(share, nan=0.5)) * self.curve[0] + self.curve[1]
        return np.where(np.isnan(share), self.share, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """A chain fitted on rows (text, quality 0 or 1)."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("quality").cast("int").alias("quality")).filter("text IS NOT NULL AND quality IN (0, 1)").filter(F.octet_length("text") <= sample_bytes)
    count = rows.count()
    chain = Chain(3 * BASE)
    if not count:
        return chain
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(place < min(1.0, sample_docs / count)).orderBy(place, "text", "quality").limit(2 * sample_docs).collect()  # about sample_docs rows; copies of a text come together, hence the limit
    sample.sort(key=lambda r: (r.text, r.quality))
    labels = np.array([r.quality for r in sample], float)
    raw, offsets = grid.buffer_of(pa.array([r.text for r in sample], pa.string()))
    features, sizes, before = line_features(raw, offsets)
    chain.share = float(labels.mean()) if len(labels) else 0.5
    some = np.diff(before) > 0
    if len(set(labels[some])) == 2:
        chain.fit(features, before, labels)
        chain.calibrate(chain.good_share(features, sizes, before)[some], labels[some])
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs` (doc_id, text)."""

    def kernel(batches):
        for batch in batches:
            raw, offsets = grid.buffer_of(batch.column(1))
            for a, b in grid.slices(offsets):
                found = chain.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(kernel, "doc_id long, score double, predicted int")


def op6_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    marked = labels.filter(~held_out(5, 0)).filter("quality IS NOT NULL")
    chain = learn(sampled(docs, marked))
    return score(docs, chain).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "score", "predicted")


def sampled(docs: DataFrame, marked: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, quality): about `sample_docs` labelled rows, drawn by id before the join so that it stays small."""
    count = marked.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < min(1.0, sample_docs / max(count, 1))
    return docs.filter(draw).join(marked.filter(draw), "doc_id").select("text", "quality")
