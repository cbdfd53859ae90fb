"""Cosine similarity and situation vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def situation_vector(amount: Column, n_candidates: Column, margin: Column, confidence: Column, exact: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(F.log10(F.greatest(F.abs(amount).cast("double"), F.lit(1.0))), n_candidates.cast("double"), F.coalesce(margin, zero), F.coalesce(confidence, zero), exact.cast("double"))
