"""Vector scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(both, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with guarded norms; an empty vector gives -1."""
    return F.when(F.size(b) == 0, F.lit(-1.0)).otherwise(dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY)))


def mean_pooled(vectors: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """The element-wise mean of each group's vectors, from partial sums by place."""
    places = vectors.select(by, F.posexplode(embedding).alias("place", "x"))
    means = places.groupBy(by, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("pooled"))
