"""Lists of near vectors: a written vector index deals its rows out by their nearest centroid, and approximate search reads the nearest lists.

Centroids are fitted (k-means) on a bounded sample of vectors; every row is in the list of its nearest one. Rows of a list
stand together in the files, so that statistics of the list's number keep others from being read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.vectors import _matrix

#: Vectors that centroids are fitted on at most; rows of a list on average, and lists at most (of 8 KB each at 1,024 dimensions).
SAMPLED, ROWS_EACH, MOST_LISTS = 20_000, 1_000, 16_384
ROUNDS = 8
#: Rows that are read for each candidate asked for, at least, and lists.
READ_EACH, LEAST_LISTS = 20, 8


@dataclass(frozen=True)
class Lists:
    """Centroids, and how many rows each has."""

    column: str
    centroids: np.ndarray
    sizes: np.ndarray
    cosine: bool

    def nearest(self, query: list[float], candidates: int) -> list[int]:
        """The lists nearest to a query that together have enough rows for so many candidates."""
        q = np.array(query, np.float64)
        q = q / (np.sqrt(q @ q) or 1.0) if self.cosine else q
        order = np.argsort(((self.centroids - q) ** 2).sum(axis=1), kind="stable")
        held = np.cumsum(self.sizes[order])
        n = int(np.searchsorted(held, READ_EACH * candidates)) + 1
        return order[: max(n, LEAST_LISTS)].tolist()


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def closest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = (centroids * centroids).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (m[k : k + 4096] @ centroids.T), axis=1) for k in range(0, len(m), 4096)]) if len(m) else np.zeros(0, np.int64)


def fitted(docs: DataFrame, path: str, dims: int, cosine: bool, n: int) -> np.ndarray:
    """Centroids of about n / ROWS_EACH lists, from SAMPLED vectors at most, in the order of a hash."""
    v = F.col(path)
    rows = docs.where((F.size(v) == dims) & ~F.exists(v, F.isnull)).select(v.cast("array<double>").alias("v"), F.xxhash64(v).alias("h"))
    some = rows.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= 2.0 * SAMPLED / max(n, 1)).orderBy("h").limit(SAMPLED).toArrow()
    if not some.num_rows:
        return np.zeros((0, dims))
    m = np.array(some.column("v").to_pylist(), np.float64).reshape(-1, dims)
    m = unit(m) if cosine else m
    k = min(MOST_LISTS, max(1, round(n / ROWS_EACH)), len(m))
    centroids = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = closest(m, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=k)
        np.add.at(sums, own, m)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def list_of(v: Column, centroids: np.ndarray, cosine: bool) -> Column:
    """The number of the nearest centroid; null for rows without a vector of its dimensions."""

    def run(x: pa.Array) -> pa.Array:
        m, ok = _matrix(x, centroids.shape[1])
        out = np.full(len(x), -1, np.int32)
        out[ok] = closest(unit(m) if cosine else m, centroids)
        return pa.array(out, mask=~ok)

    return F.arrow_udf(run, "int")(v)
