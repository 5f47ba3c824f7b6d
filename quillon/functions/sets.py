"""Similarity of sets and ranked lists as Column expressions. Two empty sides are alike (1), one is not (0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(items: Column) -> Column:
    """A list as a set that compares with =: distinct and sorted, nulls out."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def _guarded(a: Column, b: Column, ratio: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return _guarded(a, b, both / (F.size(a) + F.size(b) - both))


def set_f1(a: Column, b: Column) -> Column:
    """Also the Dice coefficient."""
    return _guarded(a, b, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


dice = set_f1


def exact_match(a: Column, b: Column) -> Column:
    return as_set(a) == as_set(b)


def rank_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Extrapolated rank-biased overlap of two ranked lists; later repeats of an item do not count."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    s, n = F.size(short), F.size(long)
    shared = lambda d: F.size(F.array_intersect(F.slice(short, F.lit(1), F.least(d, s)), F.slice(long, F.lit(1), d)))
    at = lambda d: F.pow(F.lit(p), d)
    terms = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda d: shared(d) / d * at(d) + F.when(
        d > s, shared(s) * (d - s) / (s * d) * at(d)).otherwise(0.0))
    total = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    tail = ((shared(n) - shared(s)) / n + shared(s) / s) * at(n)
    return _guarded(a, b, (1 - p) / p * total + tail)
