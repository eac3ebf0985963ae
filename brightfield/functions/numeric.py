"""Closed forms and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval; (0, 0) without trials."""
    n, p = total.cast("double"), successes / total
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    none = total <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def percent_text(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit("0/0")).otherwise(F.format_string("%d/%d (%.0f%%)", a, b, 100.0 * a / b))


def decile(position: Column, total: Column) -> Column:
    return F.least(F.floor(position * 10 / total), F.lit(9)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def rbf(d2: Column, bandwidth: float) -> Column:
    return F.exp(-d2 / (2 * bandwidth * bandwidth))


def rational_quadratic(d2: Column, bandwidth: float, alpha: float = 1.0) -> Column:
    return F.pow(1 + d2 / (2 * alpha * bandwidth * bandwidth), F.lit(-alpha))


def k3(log_policy: Column, log_reference: Column) -> Column:
    r = log_reference - log_policy
    return F.exp(r) - r - 1


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def round_exact(x: Column, digits: int) -> Column:
    """A double of 0 or more rounded by its exact binary value, ties to even: 4.475 is stored a little below that, so it gives 4.47.

    ``bround`` goes by the shortest decimal text and gives 4.48. Here the error of ``x * 10 ** digits`` (from the two halves
    of x's bits) decides where the product looks like a tie.
    """
    scale = F.lit(float(10**digits))
    wide = x * F.lit(134217729.0)  # 2 ** 27 + 1
    high = wide - (wide - x)
    product, below = x * scale, F.floor(x * scale)
    error = (high * scale - product) + (x - high) * scale
    part = product - below
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (below % 2 == 1))))
    return (below + up.cast("long")) / scale
