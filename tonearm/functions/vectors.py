"""Array maths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tonearm.functions.text import col


def total(values) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a) -> Column:
    a = col(a)
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    a = col(a)
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(F.transform(a, lambda x: x * 0.0))


def cosine(a, b, dims: str = "same") -> Column:
    """Cosine; 0 for a zero vector, null when the sizes differ (dims="same")."""
    a, b = col(a), col(b)
    length = norm(a) * norm(b)
    value = F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)
    return F.when(F.size(a) == F.size(b), value) if dims == "same" else value


def doubles(a) -> Column:
    return F.transform(col(a), lambda x: x.cast("double"))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def bounded_similarity(pairs, scales, sharpness: float) -> Column:
    """exp(-sharpness * mean(|a-b| / scale)) for a list of (Column, Column) pairs."""
    terms = [F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) / float(s) for (a, b), s in zip(pairs, scales)]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return clip(F.exp(out * (-float(sharpness)) / float(len(terms))))


def round_half_even(value: Column) -> Column:
    return F.rint(value)
