"""Nearest vectors by cosine, for a bounded set of queries against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: F.Column, b: F.Column) -> F.Column:  # type: ignore[name-defined]
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: F.Column) -> F.Column:  # type: ignore[name-defined]
    """The vector divided by its length; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(v.cast("array<double>"))


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """query, key, cosine, rank: the k nearest other rows of each query.

    Queries come in blocks of at most `block` rows, which are broadcast (their number is bounded, their size known); a
    block meets all rows without moving them, and each task keeps its k best of a query before the shuffle. Ties go to
    the smaller key. Null vectors are left out."""
    left = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), unit(F.col(vector)).alias("q")).orderBy("query")
    n = q.count()
    out = None
    for at in range(0, max(n, 1), block):
        part = q.offset(at).limit(block)
        pairs = left.join(F.broadcast(part), F.col("key") != F.col("query")).select("query", "key", dot(F.col("q"), F.col("v")).alias("cosine"))
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "key"))).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out
