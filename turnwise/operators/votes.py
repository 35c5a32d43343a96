"""Votes of judges, status ladders and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.batches import numbered


def majority(votes: DataFrame, key: str, label: str, pos: str, quorum: int = 2) -> DataFrame:
    """key, label, n, consensus: the most frequent label; ties go to the one seen first. Two combinable aggregations, no window."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), F.col(label).alias("label"))).alias("b"), F.sum("n").alias("votes"))
    return best.select(key, F.col("b.label").alias(label), F.col("b.n").alias("n"), "votes", (F.col("b.n") >= quorum).alias("consensus"))


def majority_value(votes: DataFrame, key: str, label: str, value: str, pos: str) -> DataFrame:
    """key, value: the first value that goes with the majority label."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"), F.min(F.struct(F.col(pos).alias("pos"), F.col(value).alias("value"))).alias("first"))
    return counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("first.pos")).alias("early"), F.col("first.value").alias("value"))).alias("b")).select(key, F.col("b.value").alias("value"))


def distribution(df: DataFrame, status: str) -> DataFrame:
    """status, n, percent of all rows. The total is taken over the few groups, not over the rows."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(status, "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def consensus_stats(judged: DataFrame) -> DataFrame:
    """votes, n, achieved of rows (votes, consensus)."""
    return judged.groupBy("votes").agg(F.count("*").alias("n"), F.count_if("consensus").alias("achieved"))


def vote_label(raw: Column) -> Column:
    """Label of a raw judgement; when both sides are named, the second response wins in a vote."""
    return F.when(raw.contains("BOTH_INCORRECT"), "BOTH").when(raw.contains("RESPONSE2_INCORRECT"), "RESPONSE2").when(raw.contains("RESPONSE1_INCORRECT"), "RESPONSE1").otherwise("UNKNOWN")


def check_label(raw: Column) -> Column:
    """INCORRECT holds CORRECT, so it is looked for first."""
    return F.when(raw.contains("INCORRECT"), "incorrect").when(raw.contains("CORRECT"), "correct").otherwise("failed")


def compare_status(label: Column, answer: Column, same: Column, judged: Column) -> Column:
    """Status of an answer against its label: equal or equal calls, no calls at all, else what was judged."""
    call = lambda x: F.startswith(F.regexp_replace(x, r"(?U)\A\s+", ""), F.lit("<tool_call>"))
    return F.when(label == answer, "both_correct").when(~call(label) & ~call(answer), "not_function_call").when(same, "both_correct").otherwise(judged)


def errors_to_expand(df: DataFrame) -> DataFrame:
    """Rows (status, consensus, label, answer) whose wrong side can be rewritten: agreed on, and with a call on the right side."""
    return df.where("consensus AND ((status = 'model_incorrect' AND contains(label, '<tool_call>')) OR (status = 'original_incorrect' AND contains(answer, '<tool_call>')))")


def fan_out(df: DataFrame, key: str, times: int) -> DataFrame:
    """Each row `times` over with variant (0 to 3, the last half as often): a draw by hash of key and copy."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))
    return rows.withColumn("variant", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(7)) % 4)


def judge_summary(rows: DataFrame, *by: str) -> DataFrame:
    """errors, agreed, rate (of agreements among the judged rows; null if there are none) of rows (called, wrong, consensus)."""
    return rows.groupBy(*by).agg(F.count_if("wrong").alias("errors"), F.count_if(F.col("consensus") & F.col("called")).alias("agreed"), F.try_divide(F.count_if(F.col("consensus") & F.col("called")).cast("double"), F.count_if("called")).alias("rate"))


def canonical_labels(df: DataFrame, label: str) -> DataFrame:
    """`df` with label numbers from 0 in order of the labels. The distinct labels alone are numbered, in ranges; their table meets the rows in a merge."""
    names = df.select(F.col(label).alias("_l")).distinct()
    return df.join(numbered(names, "_l", "label").hint("merge"), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
