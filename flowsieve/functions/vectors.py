"""Expressions over probability and feature arrays (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def at(values: Column, index: Column) -> Column:
    """Element at a zero-based position; NULL outside the array."""
    return F.get(values, index)


def onehot(index: Column, n_classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def in_top_k(values: Column, index: Column, k: int) -> Column:
    """True when fewer than ``k`` entries exceed the entry of the true class; a class outside the array is a miss."""
    true_value = at(values, index)
    hit = F.size(F.filter(values, lambda p: p > true_value)) < k
    return F.when(index.isNotNull(), F.coalesce(hit & true_value.isNotNull(), F.lit(False)))


def cross_entropy(values: Column, index: Column, epsilon: float = 1e-7) -> Column:
    """A class outside the array has probability 0."""
    true_value = F.when(index.isNotNull(), F.coalesce(at(values, index), F.lit(0.0)))
    clipped = F.least(F.greatest(true_value, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.when(true_value.isNotNull(), -F.log(clipped))


def squared_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x)


def mean_squared_error(values: Column, rebuilt: Column) -> Column:
    errors = F.zip_with(values, rebuilt, lambda x, y: (x - y) * (x - y))
    return F.aggregate(errors, F.lit(0.0), lambda total, e: total + e) / F.size(values)
