"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or zero, or where the lengths differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(F.coalesce(usable, F.lit(False)), _dot(a, b) / norms).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most similar to a query vector: per partition first, then over all."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_column, cosine(F.col(column), wanted).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def top_k_of(vectors: DataFrame, query: DataFrame, k: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most similar to the one vector that ``query`` holds; without it, none."""
    one = query.select(F.col(column).alias("wanted")).limit(1)
    both = vectors.join(F.broadcast(one)).withColumn("similarity", cosine(F.col(column), F.col("wanted")))
    return both.orderBy(F.desc("similarity"), id_column).limit(k).drop("wanted")
