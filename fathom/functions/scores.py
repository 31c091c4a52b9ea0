"""Similarities and score expressions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Constants of the corpus-free similarity: probability scale, and its decay by term length.
STABLE_M, STABLE_C = 0.00781, 0.917


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(weight: float, freq: Column, length: Column, mean: float) -> Column:
    """weight is the idf, or the sum of those of a phrase."""
    f = freq.cast("double")
    return F.lit(weight) * f / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean)))


def stable_tfl(term: str, freq: Column, length: Column) -> Column:
    """tf times a rarity that is read off the term's length and the document's: no corpus needed."""
    f = freq.cast("double")
    p = F.lit(1.0) - F.pow(F.lit(1 - STABLE_M * 2 ** (-STABLE_C * len(term))), length.cast("double"))
    return F.log(F.lit(1.0) + (F.lit(1.05) - p) / (p + F.lit(0.05))) * (f / (f + F.lit(K1)))


def quantized_length(length: Column) -> Column:
    """The length as one byte keeps it: exact below 40, then with four significant bits."""
    v = length - 24
    shift = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int") - 3, F.lit(0))
    return F.when(length < 40, length).otherwise(24 + F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))
