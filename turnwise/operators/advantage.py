"""Group-wise advantages and returns as window expressions: one exchange on the group key each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Add an estimator under a name; names are unique."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"{name} is taken")
        return f

    return add


def estimate(name: str, df: DataFrame, **options: object) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


def _stats(group: str, score: str) -> tuple[Column, Column, Column, Column]:
    w = W.partitionBy(group)
    return F.count("*").over(w), F.avg(score).over(w), F.stddev_samp(score).over(w), F.sum(score).over(w)


def _out(df: DataFrame, advantage: Column) -> DataFrame:
    return df.withColumn("advantage", advantage)


@register("grpo")
def grpo(df: DataFrame, group: str = "uid", score: str = "score", scale: bool = True) -> DataFrame:
    """Distance from the group's mean in sample standard deviations; a single row counts as mean 0, deviation 1."""
    n, mean, std, _ = _stats(group, score)
    s = F.col(score)
    many = (s - mean) / (std + EPS) if scale else s - mean
    return _out(df, F.when(n == 1, s / (1 + EPS) if scale else s).otherwise(many))


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """The same with the variance held above EPS before the root; a single row counts as mean 0, deviation 1."""
    w = W.partitionBy(group)
    n, mean, _, _ = _stats(group, score)
    return _out(df, F.when(n == 1, F.col(score) / (1 + EPS)).otherwise((F.col(score) - mean) / (F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(EPS))) + EPS)))


@register("drgrpo")
def drgrpo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    return grpo(df, group, score, scale=False)


@register("rloo")
def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """Distance from the mean of the group's other rows; a single row keeps its score."""
    n, _, _, total = _stats(group, score)
    return _out(df, F.when(n > 1, (n * F.col(score) - total) / (n - 1)).otherwise(F.col(score)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """The same, but a single row has 0."""
    n, _, _, total = _stats(group, score)
    return _out(df, F.when(n > 1, (n * F.col(score) - total) / (n - 1)).otherwise(F.lit(0.0)))


@register("opo")
def opo(df: DataFrame, group: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Distance from the group's mean weighted by length; a single row keeps its score."""
    w = W.partitionBy(group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return _out(df, F.when(F.count("*").over(w) == 1, F.col(score)).otherwise(F.col(score) - base))


@register("pass_at_k")
def pass_at_k(df: DataFrame, group: str = "uid", score: str = "score", order: str = "pos", scale: bool = True) -> DataFrame:
    """The best row of a group has its lead over the second (in sample deviations), all others 0; groups of one are an error there and null here."""
    w = W.partitionBy(group)
    ranked = w.orderBy(F.desc(score), order)
    lead = F.col(score) - F.lead(score).over(ranked)
    best = lead / (F.stddev_samp(score).over(w) + EPS) if scale else lead
    return _out(df, F.when(F.count("*").over(w) < 2, F.lit(None)).when(F.row_number().over(ranked) == 1, best).otherwise(F.lit(0.0)))


@register("gpg")
def gpg(df: DataFrame, group: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """Distance from the group's mean, times all rows over the rows with a score other than 0. The two totals are one small aggregate."""
    n, mean, _, _ = _stats(group, score)
    totals = df.agg(F.count("*").alias("_rows"), F.count_if(F.col(score) != 0).alias("_hits"))
    alpha = F.col("_rows") / F.greatest(F.col("_hits"), F.lit(1))
    return _out(df.crossJoin(F.broadcast(totals)), alpha * (F.col(score) - F.when(n == 1, 0.0).otherwise(mean)) / f_norm).drop("_rows", "_hits")


@register("reinforce_baseline")
def reinforce_baseline(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """Distance from the group's mean (0 for a single row), then whitened over all rows."""
    n, mean, _, _ = _stats(group, score)
    return whiten(_out(df, F.col(score) - F.when(n == 1, 0.0).otherwise(mean)), "advantage")


def whiten(df: DataFrame, column: str, mask: str | None = None) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) over all masked rows, with Bessel's correction."""
    x = F.when(F.col(mask), F.col(column)) if mask else F.col(column)
    totals = df.agg(F.avg(x).alias("_mean"), F.var_samp(x).alias("_var"))  # one row
    return df.crossJoin(F.broadcast(totals)).withColumn(column, (F.col(column) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_mean", "_var")


def returns_to_go(df: DataFrame, group: str = "uid", order: str = "pos", reward: str = "score") -> DataFrame:
    """Sum of the rewards from each row to the end of its group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return df.withColumn("to_go", F.sum(reward).over(w))


def response_mask(df: DataFrame, group: str = "uid", order: str = "pos", token: str = "token", end: object = 1) -> DataFrame:
    """1 up to and with the first end token of each group, then 0."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("mask", (F.coalesce(F.sum((F.col(token) == end).cast("int")).over(w), F.lit(0)) == 0).cast("int"))


def _matrix(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of a batch as one matrix, padded at the right with 0, and their lengths."""
    n = np.array([len(x) for x in rows], dtype=np.int64)
    out = np.zeros((len(rows), int(n.max()) if len(n) else 0))
    for i, x in enumerate(rows):
        out[i, : len(x)] = np.asarray(x, dtype=np.float64)
    return out, n


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """For an array of token rewards: the discounted sum from each place on; what lies behind a masked token does not count there.

    Linear in the length of a response; a batch of responses is one matrix."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rewards: pd.Series, mask: pd.Series) -> pd.Series:
        r, n = _matrix(rewards)
        m, _ = _matrix(mask)
        out, next_ = np.zeros_like(r), np.zeros(len(r))
        for t in range(r.shape[1] - 1, -1, -1):
            out[:, t] = r[:, t] + gamma * next_
            next_ = out[:, t] * m[:, t]
        return pd.Series([x[:k] for x, k in zip(out, n)])

    return run(rewards, mask)


def generalized_advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """For arrays of one response: advantages by the reverse recurrence delta + gamma * lam * next; masked tokens pass the state on."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rewards: pd.Series, values: pd.Series, mask: pd.Series) -> pd.Series:
        r, n = _matrix(rewards)
        v, _ = _matrix(values)
        m, _ = _matrix(mask)
        inside = np.arange(r.shape[1])[None, :] < n[:, None]
        out, value, last = np.zeros_like(r), np.zeros(len(r)), np.zeros(len(r))
        for t in range(r.shape[1] - 1, -1, -1):
            now = r[:, t] + gamma * value - v[:, t] + gamma * lam * last
            on = inside[:, t] * m[:, t]
            value, last = v[:, t] * on + (1 - on) * value, now * on + (1 - on) * last
            out[:, t] = last
        return pd.Series([x[:k] for x, k in zip(out, n)])

    return run(rewards, values, mask)


def whitened_tokens(df: DataFrame, values: str, mask: str, into: str = "advantage") -> DataFrame:
    """`df` with its array of values whitened over all masked tokens of all rows. The two moments are one small aggregate over the rows' sums."""
    pairs = F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, z: a + f(z["v"]) * z["m"])
    sums = df.select(add(lambda v: F.lit(1.0)).alias("n"), add(lambda v: v).alias("s"), add(lambda v: v * v).alias("q")).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    mean, var = F.col("_s") / F.col("_n"), (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    return df.crossJoin(F.broadcast(sums)).withColumn(into, F.transform(values, lambda v: (v - mean) / F.sqrt(var + 1e-8))).drop("_n", "_s", "_q")


def reinforce_plus_plus(df: DataFrame, gamma: float, rewards: str = "score", mask: str = "mask") -> DataFrame:
    """`df` with returns and advantage of its token arrays: discounted returns, whitened over all masked tokens, 0 where masked."""
    out = whitened_tokens(df.withColumn("returns", discounted_returns(F.col(rewards), F.col(mask), gamma)), "returns", mask)
    return out.withColumn("advantage", F.zip_with("advantage", mask, lambda a, m: a * m))


def generalized(df: DataFrame, gamma: float, lam: float, rewards: str = "score", values: str = "value", mask: str = "mask") -> DataFrame:
    """`df` with returns (advantages plus values) and advantage (whitened over all masked tokens) of its token arrays."""
    raw = df.withColumn("_raw", generalized_advantages(F.col(rewards), F.col(values), F.col(mask), gamma, lam))
    out = whitened_tokens(raw.withColumn("returns", F.zip_with("_raw", values, lambda a, v: a + v)), "_raw", mask)
    return out.drop("_raw")


@register("remax")
def remax(df: DataFrame, group: str = "uid", score: str = "score", order: str = "pos", baseline: str = "baseline", mask: str = "mask") -> DataFrame:
    """Per token: the sum of masked rewards from it to the end of its row, minus the row's baseline where it is not masked."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return _out(df, F.sum(F.col(score) * F.col(mask)).over(w) - F.col(baseline) * F.col(mask))
