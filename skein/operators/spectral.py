"""Spectral analysis of the normalised Laplacian of a graph's symmetrised confidence weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import score
from .graph import Graph

#: Nodes up to which the dense eigensolver is used.
MOST_NODES = 4000


class SpectralError(ValueError):
    """EmptyGraph, TooFewNodes (have, need), TooManyNodes (have, need) or NoConvergence."""

    def __init__(self, kind: str, have: int = 0, need: int = 0) -> None:
        self.kind, self.have, self.need = kind, have, need
        super().__init__(kind if not need else f"{kind}: have {have}, need {need}")


def weights(graph: Graph) -> DataFrame:
    """(a, b, weight) with a < b: summed scores (single precision, widened) of edges between known nodes."""
    ids = graph.nodes.select("id")
    inner = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").filter("source <> target")
    w = score(F.col("confidence")).cast("float").cast("double")
    return inner.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("weight"))


def laplacian(graph: Graph) -> DataFrame:
    """(a, b, value): 1 on the diagonal of every node, -w / sqrt(d_a d_b) on both sides of an edge."""
    w = weights(graph)
    ends = w.select("a", "weight").unionByName(w.select(F.col("b").alias("a"), "weight"))
    degree = ends.groupBy("a").agg(F.sum("weight").alias("d"))
    off = w.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    off = off.select("a", "b", (-F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).alias("value"))
    diagonal = graph.nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("value"))
    return diagonal.unionByName(off).unionByName(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def _signed(vector: np.ndarray) -> np.ndarray:
    """The entry of largest magnitude is made positive; of equal ones the first counts."""
    lead = int(np.argmax(np.abs(vector) > np.abs(vector).max() - 1e-12))
    return -vector if vector[lead] < 0 else vector


def _settled(values: np.ndarray, vectors: np.ndarray, trivial: np.ndarray) -> np.ndarray:
    """A fixed basis inside repeated eigenvalues: known null direction first, then unit vectors in node order."""
    out, i, n = vectors.copy(), 0, len(values)
    while i < n:
        j = i + 1
        while j < n and abs(values[j] - values[i]) < 1e-9:
            j += 1
        if j - i > 1:
            space, basis = vectors[:, i:j], []
            starts = [trivial] if abs(values[i]) < 1e-9 else []
            for v in [*starts, *np.eye(n)]:
                v = space @ (space.T @ v)
                for u in basis:
                    v = v - u * (u @ v)
                if np.linalg.norm(v) > 1e-8:
                    basis.append(v / np.linalg.norm(v))
                if len(basis) == j - i:
                    break
            out[:, i:j] = np.stack(basis, 1)
        i = j
    return out


def _solve(graph: Graph, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    count = graph.nodes.count()
    if not count:
        raise SpectralError("EmptyGraph")
    if count < least:
        raise SpectralError("TooFewNodes", count, least)
    if count > MOST_NODES:
        raise SpectralError("TooManyNodes", count, MOST_NODES)
    ids = [r.id for r in graph.nodes.select("id").orderBy("id").collect()]  # at most MOST_NODES rows
    at = {x: i for i, x in enumerate(ids)}
    matrix = np.eye(count)
    strength = np.zeros(count)
    for r in weights(graph).collect():  # at most MOST_NODES squared
        matrix[at[r.a], at[r.b]] = matrix[at[r.b], at[r.a]] = r.weight
        strength[at[r.a]] += r.weight
        strength[at[r.b]] += r.weight
    root = np.sqrt(np.where(strength > 0, strength, 1))
    off = matrix - np.eye(count)
    lap = np.eye(count) - off / np.outer(root, root)
    try:
        values, vectors = np.linalg.eigh(lap)
    except np.linalg.LinAlgError:
        raise SpectralError("NoConvergence") from None
    trivial = np.where(strength > 0, np.sqrt(strength), 0)
    return ids, values, _settled(values, vectors, trivial)


def algebraic_connectivity(graph: Graph) -> float:
    """The second-smallest eigenvalue; 0 if the graph falls apart."""
    return float(_solve(graph, 2)[1][1])


def fiedler_vector(graph: Graph) -> DataFrame:
    """(id, value) of the eigenvector of the second-smallest eigenvalue."""
    ids, _, vectors = _solve(graph, 2)
    return graph.nodes.sparkSession.createDataFrame(list(zip(ids, map(float, _signed(vectors[:, 1])))), "id string, value double")


def spectral_embedding(graph: Graph, k: int) -> tuple[DataFrame, list[float]]:
    """(id, coords) from eigenvectors 1..k, and their eigenvalues in rising order."""
    ids, values, vectors = _solve(graph, k + 1)
    columns = np.stack([_signed(vectors[:, i]) for i in range(1, k + 1)], 1) if k else np.zeros((len(ids), 0))
    rows = [(i, [float(x) for x in c]) for i, c in zip(ids, columns)]
    return graph.nodes.sparkSession.createDataFrame(rows, "id string, coords array<double>"), [float(x) for x in values[1 : k + 1]]
