"""Metrics of scores, rollouts and validation runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.votes import majority_value


def difficulty(logprobs: Column) -> tuple[Column, Column, Column]:
    """Mean log-probability, its negative and the perplexity of an array of token log-probabilities; null for none or an overflow."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size(logprobs))
    p = F.exp(-mean)
    return mean, -mean, F.when(p < float("inf"), p)


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, mean, std (of the population), low, high over non-null values."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def group_moments(df: DataFrame, group: str, score: str, floor: float = 1e-6) -> DataFrame:
    """group, mean, std, n of each group's scores; a single row has mean 0 and deviation 1, and the variance is held above the floor."""
    m = df.groupBy(group).agg(F.avg(score).alias("m"), F.var_samp(score).alias("v"), F.count("*").alias("n"))
    return m.select(group, F.when(F.col("n") == 1, 0.0).otherwise(F.col("m")).alias("mean"), F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(floor)))).alias("std"), "n")


def all_reduced(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, high, low and std (of the population, by the mean of squares) over all rows of all tasks."""
    x = F.col(value).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.max(x).alias("high"), F.min(x).alias("low"), F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))).alias("std"))


def masked_reduced(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: the masked mean over all rows of all tasks."""
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("mean"))


def mean_of_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """source, mean: the mean over rows of each row's mean."""
    return df.groupBy(source, row).agg(F.avg(score).alias("m")).groupBy(source).agg(F.avg("m").alias("mean"))


def reduce_by_name(metrics: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """name, value: the largest where the name holds "max", the smallest where it holds "min", else the mean; max is looked for first."""
    sums = metrics.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"))
    return sums.select(name, F.when(F.col(name).contains("max"), F.col("hi")).when(F.col(name).contains("min"), F.col("lo")).otherwise(F.col("mean")).alias(value))


def training_metrics(df: DataFrame, score: str, value: str, target: str, length: str, longest: int) -> DataFrame:
    """One row: score mean, max and min, mean length, share of the longest and of empty responses, explained variance."""
    rest = F.col(target) - F.col(value)
    return df.agg(
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.min(score).alias("score_min"), F.avg(length).alias("length_mean"),
        F.avg((F.col(length) >= longest).cast("double")).alias("clip_ratio"), F.avg((F.col(length) == 0).cast("double")).alias("aborted_ratio"),
        (1 - F.var_samp(rest) / (F.var_samp(target) + 1e-5)).alias("explained_variance"),
    )


def correlation(df: DataFrame, new: str, old: str) -> DataFrame:
    """One row: largest, mean and sample deviation of the distance of two probabilities, and their correlation."""
    d = F.abs(F.exp(new) - F.exp(old))
    return df.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr(F.exp(new), F.exp(old)).alias("pearson"))


def group_metrics(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """source, n, mean, std: of each group's size, mean and population deviation, the means over a source's groups of one size."""
    per = df.groupBy(source, uid).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(source, "n").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.count("*").alias("groups"))


@lru_cache(maxsize=64)
def _all_draws(n: int, size: int, rounds: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, (rounds, size), replace=True)


def _draws(n: int, size: int, rounds: int, seed: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Draws of all rounds, in blocks of at most `most` places or labels; the same numbers whatever the blocks."""
    if rounds * size <= 1 << 16 and rounds * max(n, size) <= most:
        yield _all_draws(n, size, rounds, seed)
        return
    random, step = np.random.RandomState(seed), max(1, most // max(n, size))
    for k in range(0, rounds, step):
        yield random.choice(n, (min(step, rounds - k), size), replace=True)


def resampled(values: list[float], labels: list[object], size: int, rounds: int = 1000, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Mean and population deviation over resamples (with replacement) of the best, the worst and the majority's first value, with one set of draws for all three."""
    v = np.asarray(values, dtype=np.float64)
    codes = np.unique(np.array([str(x) for x in labels]), return_inverse=True)[1]
    kinds, out = int(codes.max()) + 1, {"best": [], "worst": [], "majority": []}
    for draws in _draws(len(v), size, rounds, seed):
        # votes of each draw's label within its round; the first place among those with most votes
        cell = codes[draws] + np.arange(len(draws))[:, None] * kinds
        votes = np.bincount(cell.ravel(), minlength=len(draws) * kinds)[cell]
        drawn = v[draws]
        out["best"].append(drawn.max(axis=1))
        out["worst"].append(drawn.min(axis=1))
        out["majority"].append(np.take_along_axis(drawn, votes.argmax(axis=1)[:, None], 1)[:, 0])
    every = {k: np.concatenate(x) for k, x in out.items()}
    return {k: (float(x.mean()), float(x.std())) for k, x in every.items()}


def bootstrap(values: list[float], labels: list[object], size: int, rounds: int = 1000, seed: int = 42) -> dict[str, float]:
    """The means of `resampled`."""
    return {k: mean for k, (mean, _) in resampled(values, labels, size, rounds, seed).items()}


def group_validation(values: list[float], labels: list[object]) -> dict[str, float]:
    """Metrics of one group of N: mean@N; from two on std@N (of the population), and best@n, worst@n and maj@n, each /mean and /std, for n = 2, 4, ... below N and N itself."""
    size = len(values)
    out = {f"mean@{size}": float(np.mean(values))}
    if size > 1:
        out[f"std@{size}"] = float(np.std(values))
        for n in [*(2**k for k in range(1, size.bit_length()) if 2**k < size), size]:
            for k, (mean, std) in resampled(values, labels, n).items():
                name = "maj" if k == "majority" else k
                out |= {f"{name}@{n}/mean": mean, f"{name}@{n}/std": std}
    return out


def validation(df: DataFrame, source: str, uid: str, value: str, label: str, order: str | None = None) -> DataFrame:
    """source, metric, value: the metrics of group_validation, the means over those of a source's groups that have them.

    A group's responses are drawn from in the order of `order`, which decides which label was seen first; without it
    in the order of their values.

    Groups are the responses to one prompt, of any size. The resampling runs where the group is, and only one row a
    group and metric is shuffled on."""
    def one(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batch:
            out = [(s, k, x) for s, vs, ls in zip(b["source"], b["vs"], b["ls"]) for k, x in group_validation(list(vs), list(ls)).items()]
            yield pd.DataFrame(out, columns=["source", "metric", "value"])

    groups = df.groupBy(F.col(source).alias("source"), uid).agg(F.sort_array(F.collect_list(F.struct(*([F.col(order).alias("o")] if order else []), F.col(value).alias("v"), F.col(label).cast("string").alias("l")))).alias("x"))
    lists = groups.select("source", F.transform("x", lambda x: x["v"].cast("double")).alias("vs"), F.transform("x", lambda x: x["l"]).alias("ls"))
    return lists.mapInPandas(one, "source string, metric string, value double").groupBy("source", "metric").agg(F.avg("value").alias("value"))


__all__ = ["bootstrap", "correlation", "difficulty", "group_metrics", "group_validation", "majority_value", "mean_of_means", "reduce_by_name", "resampled", "spread", "training_metrics", "validation"]
