"""Draws that depend on keys and a seed only: the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.operators.batches import numbered
from turnwise.plans.lineage import cut


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts; the same in any engine."""
    text = F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded random order: a top-k by hash, no full sort."""
    return df.withColumn("draw", uniform(F.lit(seed), key)).orderBy("draw", key).limit(n)


def train_test(df: DataFrame, key: str, share: float = 0.02, seed: int = 2025) -> DataFrame:
    """`df` with split: the last int(n * share) rows of a seeded shuffle by a unique key are test; where that is 0, all rows are.

    No row is moved: the counts of 65536 ranges of the draw tell in which range the edge lies, and only the rows of that
    range are ordered to find it."""
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))))
    sizes = {r[0]: r[1] for r in drawn.groupBy(F.substring("_draw", 1, 4)).count().collect()}  # at most 65536 rows
    test = int(sum(sizes.values()) * share)
    if not test:
        return df.withColumn("split", F.lit("test"))
    left = test
    for part in sorted(sizes, reverse=True):
        if sizes[part] >= left:
            break
        left -= sizes[part]
    edge = drawn.where(F.substring("_draw", 1, 4) == part).select("_draw").orderBy(F.desc("_draw")).limit(left).agg(F.min("_draw")).first()[0]
    return drawn.withColumn("split", F.when(F.col("_draw") >= edge, "test").otherwise("train")).drop("_draw")


def weighted_draws(groups: DataFrame, name: str, weight: str, draws: int, seed: int = 7) -> DataFrame:
    """draw, name: names drawn with replacement in proportion to their weight. `groups` has one row a name: a table of bounded size."""
    w = W.orderBy(name)
    edges = groups.select(name, F.sum(weight).over(w).alias("hi"), (F.sum(weight).over(w) - F.col(weight)).alias("lo"), F.sum(weight).over(W.partitionBy()).alias("total"))
    points = groups.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", uniform(F.lit(seed), "draw"))
    return points.join(F.broadcast(edges), (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi"))).select("draw", name)


def top_per_group(df: DataFrame, group: str, score: str, order: str, k: int = 2) -> DataFrame:
    """The k rows with the largest score of each group, with their rank. Spark cuts each task's groups to k before the shuffle."""
    w = W.partitionBy(group).orderBy(F.desc(score), order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def interleaved_by_load(df: DataFrame, load: str, order: str) -> DataFrame:
    """`df` with place: rows by load, small ones at both ends and large ones in the middle."""
    rows = numbered(df.withColumn("_o", F.struct(F.col(load), F.col(order))), "_o", "_pos")
    n = df.count()
    return rows.withColumn("place", F.when(F.col("_pos") % 2 == 0, F.floor(F.col("_pos") / 2)).otherwise(F.lit(n) - 1 - F.floor(F.col("_pos") / 2)).cast("long")).drop("_o", "_pos")


def interleaved_descending(df: DataFrame, load: str, order: str) -> DataFrame:
    """`df` with place: rows from the largest load down, every second one backwards first, then the others: small ones at both ends again, the largest in the middle."""
    n = df.count()
    rows = numbered(df.withColumn("_o", F.struct((-F.col(load)).alias("l"), (-F.col(order)).alias("o"))), "_o", "_pos")
    firsts = (n + 1) // 2
    return rows.withColumn("place", F.when(F.col("_pos") % 2 == 0, firsts - 1 - F.col("_pos") / 2).otherwise(firsts + (F.col("_pos") - 1) / 2).cast("long")).drop("_o", "_pos")


def uniform_draws(pool: DataFrame, key: str, draws: int, seed: int = 11) -> DataFrame:
    """draw and the rows of a pool, drawn with replacement, each alike. The pool is numbered in ranges of its key, and its size is one row."""
    rows = numbered(pool, key, "_k")
    points = pool.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_u", uniform(F.lit(seed), "draw"))
    return points.crossJoin(F.broadcast(pool.agg(F.count("*").alias("_n")))).withColumn("_k", F.floor(F.col("_u") * F.col("_n"))).join(rows, "_k").drop("_u", "_k", "_n")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order; a negative n takes all."""
    return df if n < 0 else df.orderBy(order).limit(n)


def sample_of(df: DataFrame, key: str, n: int, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """At most n rows: by number, or by seeded draw; a negative n takes all."""
    return df if n < 0 else (shuffled_head(df, key, n, seed).drop("draw") if shuffle else head(df, key, n))


def logged_samples(df: DataFrame, text: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows for a log: the order of a seeded draw over their texts, so that the same texts come out each time."""
    return df.withColumn("draw", uniform(F.lit(seed), text)).orderBy("draw", text, key).limit(n).drop("draw")


def resample_weights(score: Column, method: str = "pow", power: float = 2.0, high: Column | None = None, low: Column | None = None) -> Column:
    """Weights of scores: pow, max_min (largest and smallest alone) or max_random (0.4 for the largest, else 0.1); the extremes are given as columns."""
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif method == "max_min" and high is not None and low is not None:
        w = F.when((score == high) | (score == low), 1.0).otherwise(0.0)
    elif method == "max_random" and high is not None:
        w = F.when(score == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"no method {method}")
    return F.greatest(w + 1e-8, F.lit(1e-8))


def resampled(df: DataFrame, key: str, score: str, method: str = "pow", power: float = 2.0, seed: int = 3) -> DataFrame:
    """draw, key: as many draws as rows, with replacement, in proportion to the weights of their scores.

    Weights are summed in ranges of the key; a draw finds its range by the ranges' sums (one row a task), and its row
    within the range by a merge of draws and running sums, so no side is broadcast but the ranges."""
    edges = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    weighed = df.crossJoin(F.broadcast(edges)).select(F.col(key).alias("_key"), resample_weights(F.col(score), method, power, F.col("_hi"), F.col("_lo")).alias("_w"))
    spread = cut(weighed.repartitionByRange("_key").select("_key", "_w", F.spark_partition_id().alias("_part")))
    sums = spread.groupBy("_part").agg(F.sum("_w").alias("_sum"), F.count("*").alias("_n"))
    parts = sums.select("_part", "_n", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_from"), F.sum("_sum").over(W.orderBy("_part")).alias("_to"), F.sum("_sum").over(W.partitionBy()).alias("_total"))
    bounds = F.broadcast(cut(parts))
    n = spread.count()
    points = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", uniform(F.lit(seed), "draw"))
    placed = points.join(bounds, (F.col("_u") * F.col("_total") >= F.col("_from")) & (F.col("_u") * F.col("_total") < F.col("_to"))).select("_part", (F.col("_u") * F.col("_total")).alias("_at"), "draw", F.lit(None).cast(df.schema[key].dataType).alias("_key"))
    running = F.sum("_w").over(W.partitionBy("_part").orderBy("_key")) - F.col("_w") + F.col("_from")
    rows = spread.join(bounds, "_part").select("_part", running.alias("_at"), F.lit(None).cast("long").alias("draw"), "_key")
    merged = W.partitionBy("_part").orderBy("_at", F.col("draw").asc_nulls_first())
    return rows.unionByName(placed).withColumn("_hit", F.last("_key", ignorenulls=True).over(merged)).where("draw IS NOT NULL").select("draw", F.col("_hit").alias(key))
