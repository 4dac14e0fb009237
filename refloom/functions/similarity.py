"""String and vector similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bit vectors: one big integer operation for each character of the longer string."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """100 x twice the common subsequence over both lengths; 100 for two empty strings."""
    a, b = a or "", b or ""
    return 100.0 * 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, row by row over the shorter string."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    codes = np.array([ord(c) for c in b])
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, c in enumerate(a, 1):
        best = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        # what comes from the left grows by one a step: a running minimum after the steps are taken off
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return int(row[-1])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def norm(v: Column) -> Column:
    """In double precision, at least 1e-12."""
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In double precision, norms at least 1e-12, within [-1, 1]. Norms that are known need not be worked out again."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norms))


def token_overlap(query: Column, title: Column) -> Column:
    """Share of the query's distinct words, three at least, that the title has."""
    q = F.array_distinct(F.split(query, " "))
    return F.least(F.lit(1.0), F.size(F.array_intersect(q, F.split(title, " "))) / F.greatest(F.lit(3), F.size(q)))
