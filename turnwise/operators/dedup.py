"""Keep-one, duplicate and resume operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_longest(snapshots: DataFrame, key: str = "cid", order: str = "snapshot_id", length: Column | None = None) -> DataFrame:
    """key, kept (order value), length: the first record, replaced by each later valid one that is at least as long.

    That fold is the largest (length, order) among the first record and all valid ones: one aggregation, combined
    before the shuffle, and no window over a hot key."""
    size = length if length is not None else F.coalesce(F.size("curr_messages"), F.lit(0))
    rows = snapshots.select(key, F.col(order).alias("seq"), F.coalesce("valid", F.lit(False)).alias("good"), F.greatest(size, F.lit(0)).alias("len"))
    both = rows.groupBy(key).agg(F.min(F.struct("seq", "len")).alias("first"), F.max(F.when(F.col("good"), F.struct("len", "seq"))).alias("best"))
    head = F.struct(F.col("first.len").alias("len"), F.col("first.seq").alias("seq"))
    top = F.greatest(head, F.coalesce("best", head))
    return both.select(key, top["seq"].alias("kept"), top["len"].alias("length"))


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """digest, copies, first: texts that occur more than once."""
    return df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def unfinished(snapshots: DataFrame, finished: DataFrame, key: str = "cid", attempts: int = 3) -> DataFrame:
    """key, length, attempt of the crawl steps that are still to be done: every attempt of a snapshot length that no finished row has."""
    want = snapshots.where("curr_messages IS NOT NULL").select(key, F.size("curr_messages").alias("length")).distinct().select(key, "length", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    return want.join(finished.select(key, "length", "attempt"), [key, "length", "attempt"], "left_anti")
