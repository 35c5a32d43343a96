"""The queries of this subpackage, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import byte_pairs, conversations, language, leaks, near_records, pairs, quota_sample, repetition, skeleton, survivors
from turnwise.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: survivors.found(table(s, d, "dialogue_snapshots")),
        "p1_survivors": lambda s, d: survivors.survivors(table(s, d, "dialogue_snapshots")),
        "p5_found": lambda s, d: quota_sample.found(table(s, d, "train_records"), table(s, d, "tag_targets")),
        "p5_report": lambda s, d: quota_sample.report(table(s, d, "train_records"), table(s, d, "tag_targets")),
        "p5_sample": lambda s, d: quota_sample.sample(table(s, d, "train_records"), table(s, d, "tag_targets")),
        "p7_found": lambda s, d: conversations.found(table(s, d, "message_rows")),
        "p8_ids": lambda s, d: byte_pairs.encoded(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "ids"),
        "p8_roundtrip": lambda s, d: _roundtrip(table(s, d, "documents")),
        "p2_found": lambda s, d: pairs.found(table(s, d, "dialogues"), table(s, d, "documents"), table(s, d, "eval_items")),
        "p2_pairs": lambda s, d: pairs.pairs(table(s, d, "dialogues"), table(s, d, "documents"), table(s, d, "eval_items")),
        "p3_found": lambda s, d: near_records.found(table(s, d, "train_records")),
        "p3_groups": lambda s, d: near_records.groups(table(s, d, "train_records")),
        "p4_found": lambda s, d: repetition.found(table(s, d, "dialogues")),
        "p4_shares": lambda s, d: repetition.shares(table(s, d, "dialogues")),
        "p6_found": lambda s, d: language.found(table(s, d, "dialogues"), table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_segments": lambda s, d: language.segments(table(s, d, "dialogues"), table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_messages": lambda s, d: language.messages(table(s, d, "dialogues"), table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_near": lambda s, d: leaks.near(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: skeleton.found(table(s, d, "documents")),
        "p10_classes": lambda s, d: skeleton.classes(table(s, d, "documents")),
        "p10_canonical": lambda s, d: skeleton.with_canonical(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "canonical"),
        "p7_conversations": lambda s, d: conversations.conversations(table(s, d, "message_rows")),
    }


def _roundtrip(documents: DataFrame) -> DataFrame:
    """doc_id, n_ids, same: whether decoding the ids gives the text again."""
    ids = byte_pairs.encoded(documents.select("doc_id", "text"))
    back = byte_pairs.decoded(ids, into="back")
    return back.select("doc_id", F.size("ids").alias("n_ids"), (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))
