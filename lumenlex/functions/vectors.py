"""Vector and softmax functions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_from(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors by their product and norms: 0 for a zero vector, and never beyond -1 or 1."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / (norm_a * norm_b))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; raises where the lengths differ or a vector is empty."""
    wrong = F.raise_error(F.lit("vectors must have the same length, at least 1")).cast("double")
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1), wrong).otherwise(cosine_from(dot(a, b), norm(a), norm(b)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once. (An expression inside a lambda runs anew for every element.)"""
    return F.get(F.transform(F.array(value), use), 0)


def exponentials(scores: Column) -> Column:
    """exp(s - max): the unnormalised stable softmax; raises on an empty array."""
    empty = F.raise_error(F.lit("scores must not be empty")).cast("array<double>")
    return F.when(F.size(scores) < 1, empty).otherwise(bound(F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp(s - m))))


def probabilities(scores: Column) -> Column:
    return bound(exponentials(scores), lambda a: bound(total(a), lambda whole: F.transform(a, lambda x: x / whole)))


def _out_of_range(target: Column, size: Column, kind: str, value: Column) -> Column:
    """``value``, or an error where the target is no place of an array."""
    return F.when((target < 0) | (target >= size), F.raise_error(F.lit("target id out of range")).cast(kind)).otherwise(value)


def pair_loss(scores: Column, target: Column) -> Column:
    """(max - s[target]) + ln(sum of exponentials): no logarithm of 0 can occur."""
    own = _out_of_range(target, F.size(scores), "double", F.get(scores, target.cast("int")))
    return (F.array_max(scores) - own) + F.ln(total(exponentials(scores)))


def score_error(p: Column, target: Column) -> Column:
    """Gradient of the loss with respect to the scores: p minus the one-hot target; raises on a target out of range."""
    return _out_of_range(target, F.size(p), "array<double>", F.transform(p, lambda x, j: x - F.when(j == target, 1.0).otherwise(0.0)))


def outer(h: Column, e: Column) -> Column:
    """h[k] * e[j], a row for every k."""
    return F.transform(h, lambda x: F.transform(e, lambda y: x * y))


def matrix_times(matrix: Column, e: Column) -> Column:
    """matrix (rows k) times e."""
    return F.transform(matrix, lambda row: dot(row, e))


def descended(vector: Column, gradient: Column, rate: float) -> Column:
    return F.zip_with(vector, gradient, lambda x, g: x - F.lit(rate) * g)
