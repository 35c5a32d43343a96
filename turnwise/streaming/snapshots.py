"""Streaming ingestion of an append-only snapshot log: the same kept record for each dialogue as the batch operator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = "cid long, kept long, length long"
STATE = "kept long, length long, first_seq long, first_len long"


def source(spark: SparkSession, folder: str, schema: T.StructType, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def _update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first record counts even if it is not valid; a later valid one takes over when it is at least as long. State is four numbers a key."""
    kept, length, first_seq, first_len = state.get if state.exists else (None, -1, None, -1)
    for b in batches:
        seqs, lens, good = b["seq"].tolist(), b["len"].tolist(), b["good"].tolist()
        for s, n, ok in zip(seqs, lens, good):
            if first_seq is None or s < first_seq:
                first_seq, first_len = s, n
            if ok and (kept is None or (n, s) > (length, kept)):
                kept, length = s, n
    state.update((kept, length, first_seq, first_len))
    if kept is None or (first_len, first_seq) > (length, kept):
        kept, length = first_seq, first_len
    yield pd.DataFrame({"cid": [key[0]], "kept": [kept], "length": [length]})


def keep_longest(stream: DataFrame) -> DataFrame:
    """cid, kept, length after each micro-batch (update mode) of snapshots (cid, snapshot_id, valid, curr_messages)."""
    rows = stream.where("cid IS NOT NULL").select("cid", F.col("snapshot_id").alias("seq"), F.greatest(F.coalesce(F.size("curr_messages"), F.lit(0)), F.lit(0)).cast("long").alias("len"), F.coalesce("valid", F.lit(False)).alias("good"))
    return rows.groupBy("cid").applyInPandasWithState(_update, KEPT, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's records to its own folder; `latest` reads the newest of each dialogue. A batch written twice replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return keep_longest(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("cid").agg(F.max_by(F.struct("kept", "length"), "batch").alias("x")).select("cid", "x.kept", "x.length")


def arrivals(stream: DataFrame, time: str = "ingested_at", late: str = "7 days", every: str = "1 day") -> DataFrame:
    """start, worker, n: snapshots by day of arrival and worker, with a watermark for late rows."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), "worker").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "worker", "n")
