"""Vector expressions on arrays of numbers, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; lower is nearer. Null for a zero vector."""
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l1_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def term_counts(text: Column, terms: Sequence[str]) -> Column:
    """How often each term occurs in the lower-cased text, then the text's length."""
    low = F.lower(text)
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms]
    return F.array(*counts, F.length(text).cast("double"))
