"""Vector expressions over array<float> or array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms are clamped to this from below, so a zero vector has similarity 0 with everything.
MIN_NORM = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(MIN_NORM)) * F.greatest(norm(b), F.lit(MIN_NORM)))


def l2_normalize(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(MIN_NORM))
    return F.transform(a, lambda x: x.cast("double") / length)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax_second(a: Column, b: Column) -> Column:
    """The probability of the second of two labels, stable for large logits."""
    return sigmoid(b - a)


def mean_pool(rows: DataFrame, group: str, vector: str, mask: str) -> DataFrame:
    """(group, pooled): per dimension the sum of mask * value over max(sum of mask, 1e-9), in dimension order.

    One partial aggregate per group and dimension; a group's vectors are never gathered.
    """
    parts = rows.select(group, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("_dim", "_x"))
    sums = parts.groupBy(group, "_dim").agg((F.sum(F.col("_m") * F.col("_x")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_dim", "_v")))
    return sums.groupBy(group).agg(F.transform(ordered, lambda s: s["_v"]).alias("pooled"))
