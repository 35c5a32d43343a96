"""Data sets that grow by micro-batches, and reports on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def grow(stream: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fits: Column | None = None, every: str | None = None) -> StreamingQuery:
    """After each micro-batch the rows that a generator makes of it, if they fit, join the data set at a path. A batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        new = generate(batch)
        (new if fits is None else new.where(fits)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer).start()


def grown(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def reports(stream: DataFrame, status: str, path: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """The distribution of statuses so far, written anew at intervals."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(path)

    counts = stream.groupBy(status).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()


class AdaptiveWeights:
    """A curriculum: weights of groups of rows that follow how well they went; rows are drawn by them, heavier first."""

    def __init__(self, rate: float = 0.5, start: float = 1.0) -> None:
        self.rate, self.start = rate, start
        self.weights: dict[str, float] = {}

    def update(self, batch: DataFrame, group: str, score: str) -> None:
        """One row a group reaches the driver: groups are few."""
        for r in batch.groupBy(F.col(group).cast("string").alias("g")).agg(F.avg(score).alias("s")).collect():
            old = self.weights.get(r["g"], self.start)
            self.weights[r["g"]] = old + self.rate * ((1 - (r["s"] or 0.0)) - old)

    def weighted(self, df: DataFrame, group: str) -> DataFrame:
        known = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv]) if self.weights else None
        w = F.coalesce(known[F.col(group).cast("string")], F.lit(self.start)) if known is not None else F.lit(self.start)
        return df.withColumn("weight", w)
