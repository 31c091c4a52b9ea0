"""Vector similarities, quantisation and a deterministic embedder for tests."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(x: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length and without null as a matrix, and where they stand; from Arrow's own buffers."""
    sizes = np.asarray(x.value_lengths().fill_null(-1))
    ok = sizes == dims
    kept = x.filter(pa.array(ok))
    flat = kept.flatten()
    if flat.null_count:
        bad = np.asarray(flat.is_null()).reshape(-1, dims).any(axis=1)
        ok[np.flatnonzero(ok)[bad]] = False
        flat = x.filter(pa.array(ok)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims), ok


def similarity(v: Column, query: list[float], kind: str) -> Column:
    """The score of a vector column against a query vector, as one product per Arrow batch.

    euclidean 1/(1+d²), dotProduct (1+dot)/2, cosine (1+cos)/2. Null for rows without a vector of the query's
    dimensions, and under cosine for zero vectors.
    """
    q = np.array(query, np.float64)
    dims = len(query)

    def run(x: pa.Array) -> pa.Array:
        m, ok = _matrix(x, dims)
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "euclidean":
                s = 1 / (1 + ((m - q) ** 2).sum(axis=1))
            elif kind == "dotProduct":
                s = (1 + m @ q) / 2
            else:
                s = (1 + (m @ q) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt(q @ q))) / 2
        out = np.full(len(x), np.nan)
        out[ok] = s
        return pa.array(out, mask=np.isnan(out))

    return F.arrow_udf(run, "double")(v)


def packed(query: bytes) -> list[int]:
    """Bits as 64-bit words, the last filled up with zeros."""
    raw = query + b"\0" * (-len(query) % 8)
    return [int.from_bytes(raw[k : k + 8], "big", signed=True) for k in range(0, len(raw), 8)]


def bit_similarity(v: Column, query: bytes) -> Column:
    """(dimensions - Hamming distance) / dimensions of packed bits in a binary column; null where lengths differ."""
    bits = 8 * len(query)
    hexed = F.hex(v)
    words = [F.conv(F.rpad(F.substring(hexed, 16 * k + 1, 16), 16, "0"), 16, -10).cast("long") for k in range(-(-len(query) // 8))]
    apart = sum((F.bit_count(w.bitwiseXOR(F.lit(q))) for w, q in zip(words, packed(query), strict=True)), F.lit(0))
    return F.when(F.octet_length(v) == len(query), (F.lit(bits) - apart) / F.lit(float(bits)))


def signs(v: Column, dims: int) -> Column:
    """Binary quantisation: bit k of word w is set if component 64w + k is positive; array<bigint>."""

    def run(x: pa.Array) -> pa.Array:
        m, ok = _matrix(x, dims)
        words = -(-dims // 64)
        bits = np.zeros((len(m), words * 64), np.uint8)
        bits[:, :dims] = m > 0
        packs = np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(len(m), words)
        out: list = [None] * len(x)
        for at, row in zip(np.flatnonzero(ok), packs.tolist(), strict=True):
            out[at] = row
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(v)


def sign_words(query: list[float]) -> list[int]:
    bits = np.zeros(-(-len(query) // 64) * 64, np.uint8)
    bits[: len(query)] = np.array(query) > 0
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def hamming(words: Column, query: list[int]) -> Column:
    """Differing bits, in the JVM."""
    return sum((F.bit_count(F.get(words, F.lit(k)).bitwiseXOR(F.lit(w))) for k, w in enumerate(query)), F.lit(0))


def dequantized_similarity(words: Column, query: list[float], kind: str) -> Column:
    """The query in full against components of plus or minus one."""
    q, dims = np.array(query, np.float64), len(query)

    def run(x: pa.Array) -> pa.Array:
        m, ok = _matrix(x, -(-dims // 64))
        ints = x.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(m), -1)
        bits = np.unpackbits(ints.view(np.uint8), axis=1, bitorder="little")[:, :dims].astype(np.float64) * 2 - 1
        dot = bits @ q
        norm = math.sqrt(dims) * math.sqrt(float(q @ q)) or 1.0
        s = 1 / (1 + dims + float(q @ q) - 2 * dot) if kind == "euclidean" else (1 + dot / norm) / 2 if kind == "cosine" else (1 + dot) / 2
        out = np.full(len(x), np.nan)
        out[ok] = s
        return pa.array(out, mask=np.isnan(out))

    return F.arrow_udf(run, "double")(words)


def component_bounds(docs: DataFrame, path: str) -> tuple[float, float]:
    """The least and largest component of all vectors: one aggregation, two numbers."""
    v = F.col(path)
    r = docs.agg(F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high")).first()
    return (0.0, 1.0) if r["low"] is None else (float(r["low"]), float(r["high"]))


def requantized(v: Column, low: float, high: float) -> Column:
    """The vector with each component at the nearest of 128 steps between two bounds: what seven bits for each keep of it."""
    width = (high - low) / 127 or 1.0

    def run(x: pa.Array) -> pa.Array:
        steps = np.floor((x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) - low) / width + 0.5)
        sizes = np.asarray(x.value_lengths().fill_null(0))
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(low + steps * width), mask=x.is_null() if x.null_count else None)

    return F.arrow_udf(run, "array<double>")(v)


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """Words counted by hash with sign, to length one: the same text has the same vector everywhere."""
    out = np.zeros(dims)
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        out[h % dims] += 1 if h >> 31 else -1
    norm = float(np.sqrt(out @ out))
    return (out / norm if norm else out).tolist()


def embed(text: Column, embedder: Callable[[list[str]], list[list[float]]] | None = None, dims: int = 64) -> Column:
    """Vectors of a text column; the embedder is called once for each Arrow batch. Null text has none."""
    many = embedder or (lambda texts: [hash_embedding(t, dims) for t in texts])

    def run(x: pa.Array) -> pa.Array:
        texts = x.to_pylist()
        vectors = iter(many([t for t in texts if t is not None]))
        return pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)
