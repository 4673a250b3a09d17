"""Ranked-retrieval measures as column expressions over two arrays: retrieved (in rank order) and relevant.

Definitions that decide results: precision divides by what was returned within k; recall compares sets; the reciprocal
rank looks at the whole list; a document that is returned twice gains twice.  Where a denominator is 0 the value is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(retrieved: Column, k: int) -> Column:
    return F.slice(retrieved, 1, max(k, 0))


def precision_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    top = _top(retrieved, k)
    hits = F.size(F.filter(top, lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(top) > 0, hits / F.size(top)).otherwise(0.0)


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    wanted = F.size(F.array_distinct(relevant))
    return F.when(wanted > 0, F.size(F.array_intersect(_top(retrieved, k), relevant)) / wanted).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    ranks = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def ndcg_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    gains = F.transform(_top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    dcg = F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.size(F.array_distinct(relevant)), F.lit(max(k, 0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return F.when(n > 0, dcg / ideal).otherwise(0.0)


def all_measures(retrieved: Column, relevant: Column, k: int = 10) -> dict[str, Column]:
    """precision, recall, mrr, ndcg; ``k`` below 1 is an error."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return {"precision": precision_at_k(retrieved, relevant, k), "recall": recall_at_k(retrieved, relevant, k), "mrr": reciprocal_rank(retrieved, relevant), "ndcg": ndcg_at_k(retrieved, relevant, k)}


def in_range(*measures: Column) -> Column:
    """Whether all measures lie in 0..1 (a repeated document can lift ndcg above it)."""
    out = F.lit(True)
    for m in measures:
        out = out & m.between(0.0, 1.0)
    return out
