"""Rollout rows: ordinals, assembly, lengths, timing, candidate answers and prompts with meta messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.tensors import placed_score, total


def ordinals(df: DataFrame, index: str = "index", pos: str = "pos", shard: str | None = None) -> DataFrame:
    """`df` with rollout: a count from 0 that starts anew whenever the index differs from that of the row before.

    Rows of one shard are looked at in order; without a shard the whole table is one."""
    w = W.partitionBy(*([shard] if shard else [])).orderBy(pos)
    run = df.withColumn("_new", (~F.lag(index).over(w).eqNullSafe(F.col(index))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return run.withColumn("rollout", F.row_number().over(W.partitionBy(*([shard] if shard else []), "_run").orderBy(pos)) - 1).drop("_new", "_run")


def assembled(df: DataFrame, score: str = "score", mask: str = "mask") -> DataFrame:
    """`df` with token_scores: each row's score at its last valid token, if every row has a score; else null for all."""
    all_ = df.agg((F.count(score) == F.count("*")).alias("_all"))
    return df.crossJoin(F.broadcast(all_)).withColumn("token_scores", F.when(F.col("_all"), placed_score(F.col(score), F.col(mask)))).drop("_all")


def lengths(attention: Column, response: Column) -> tuple[Column, Column]:
    """Valid tokens of the prompt and of the response, from the mask of both and the response's own width."""
    width = F.size(response)
    return total(F.slice(attention, F.lit(1), F.size(attention) - width)), total(F.slice(attention, F.size(attention) - width + 1, width))


def not_aborted(df: DataFrame, length: str = "length") -> DataFrame:
    """Rows with a response. That there are none at all is an error."""
    if df.where(F.col(length) > 0).isEmpty() and not df.isEmpty():
        raise ValueError("all rows are aborted")
    return df.where(F.col(length) > 0)


def data_metrics(df: DataFrame, longest: int, longest_prompt: int, score: str = "score", reward: str = "reward", length: str = "length", prompt: str = "prompt_length", turns: str | None = None, calls: str | None = None) -> DataFrame:
    """One row of the metrics of rollout rows: scores and rewards of rows with a response, lengths of all and of those, shares of cut and aborted rows, turns and calls."""
    live = F.col(length) > 0
    three = lambda name, x: [f(x).alias(f"{name}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    of_live = lambda c: F.when(live, F.col(c))
    share = lambda c: F.avg(c.cast("double"))
    extra = [m for name, c in (("turns", turns), ("calls", calls)) if c for m in three(name, F.col(c))]
    return df.agg(
        *three("score", of_live(score)), *three("reward", of_live(reward)), *three("length", F.col(length)), share(F.col(length) == longest).alias("length_clip"),
        *three("live_length", of_live(length)), share(F.when(live, F.col(length) == longest)).alias("live_length_clip"), share(~live).alias("aborted"),
        *three("prompt", F.col(prompt)), share(F.col(prompt) == longest_prompt).alias("prompt_clip"), *extra,
    )


def token_metrics(tokens: DataFrame, advantage: str = "advantage", returns: str = "returns", value: str = "value", mask: str = "mask") -> DataFrame:
    """One row of the metrics of valid tokens: mean, max and min of advantages, returns and values, and the explained variance of the values."""
    on = lambda c: F.when(F.col(mask) > 0, F.col(c))
    three = [f(on(c)).alias(f"{c}_{k}") for c in (advantage, returns, value) for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return tokens.agg(*three, (1 - F.var_samp(on(returns) - on(value)) / (F.var_samp(on(returns)) + 1e-5)).alias("explained_variance"))


#: Stages whose time is measured over all tokens; generation over those of responses, other stages not at all.
OVER_ALL_TOKENS = ("ref", "values", "adv", "update_critic", "update_actor")


def timings(rows: DataFrame, stages: DataFrame, prompt: str = "prompt_length", response: str = "length") -> DataFrame:
    """stage, seconds, ms_per_token (null for stages without a measure) of stage times (stage, seconds)."""
    sums = rows.agg(F.sum(prompt).alias("_p"), F.sum(response).alias("_r"))
    tokens = F.when(F.col("stage") == "gen", F.col("_r")).when(F.col("stage").isin(*OVER_ALL_TOKENS), F.col("_p") + F.col("_r"))
    return stages.crossJoin(F.broadcast(sums)).select("stage", "seconds", F.try_divide(F.col("seconds") * 1000, tokens).alias("ms_per_token"))


def throughput(rows: DataFrame, seconds: float, devices: int, tokens: str = "tokens") -> DataFrame:
    """tokens, seconds, per_device: tokens a second and device."""
    return rows.agg(F.sum(tokens).alias("tokens")).select("tokens", F.lit(seconds).alias("seconds"), (F.col("tokens") / (seconds * devices)).alias("per_device"))


def loop_times(rows: DataFrame, generation: str = "generation", calls: str = "calls", key: str = "key", length: str = "length", prompt: str = "prompt_length") -> DataFrame:
    """One row: least, greatest and mean time of generation and of tool calls, and the slowest row with its times and lengths."""
    both = F.col(generation) + F.col(calls)
    slow = F.max_by(F.struct(key, generation, calls, prompt, length), F.struct(both, -F.col(key)))
    three = [f(c).alias(f"{name}_{k}") for name, c in (("generation", generation), ("calls", calls)) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return rows.agg(*three, slow.alias("slowest"))


def core_or_auxiliary(metrics: DataFrame, name: str = "metric", source: str = "source", variable: str = "variable") -> DataFrame:
    """`metrics` with section: val-core for the mean, maj and best metrics of the largest n of a source's core variable (acc if it has one, else reward), else val-aux."""
    n = F.regexp_extract(name, r"@(\d+)", 1).try_cast("int")
    largest = metrics.groupBy(source, variable).agg(F.max(n).alias("_n"))
    kinds = largest.groupBy(F.col(source).alias("_s")).agg(F.max((F.col(variable) == "acc").cast("int")).alias("_acc"))
    rows = metrics.join(largest.hint("merge"), [source, variable]).join(kinds.hint("merge"), F.col(source).eqNullSafe(F.col("_s")))
    core = (F.col(variable) == F.when(F.col("_acc") == 1, "acc").otherwise("reward")) & F.col(name).rlike("^(mean|maj|best)") & F.contains(F.col(name), F.concat(F.lit("@"), "_n"))
    return rows.withColumn("section", F.when(core, "val-core").otherwise("val-aux")).drop("_acc", "_n", "_s")


def settled_answer(answers: Column, draw: Column) -> Column:
    """verdict (0: wait for more, 1: accepted, -1: accepted as a wrong turn) and answer of two or three candidate answers (content, tool_usage).

    Two texts, or two equal sets of calls, settle it. Of three, two or more texts win, then any two equal sets of
    calls; otherwise one with calls is taken and marked. Where there is a choice, `draw` (from 0) decides."""
    calls = lambda a: F.coalesce(F.size(a["tool_usage"]) > 0, F.lit(False))
    texts, used = F.filter(answers, lambda a: ~calls(a)), F.filter(answers, calls)
    n = F.size(answers)
    pick = lambda xs: F.get(xs, (draw % F.greatest(F.size(xs), F.lit(1))).cast("int"))
    same = lambda i, j: F.coalesce(F.get(used, F.lit(i))["tool_usage"] == F.get(used, F.lit(j))["tool_usage"], F.lit(False))
    out = lambda verdict, answer: F.struct(F.lit(verdict).alias("verdict"), answer.alias("answer"))
    none = F.get(answers, F.lit(-1) + 0 * n)
    return (
        F.when(n < 2, out(0, none)).when((n == 2) & (F.size(used) == 0), out(1, pick(answers))).when((n == 2) & (F.size(used) == 1), out(0, none))
        .when(n == 2, F.when(same(0, 1), out(1, pick(answers))).otherwise(out(0, none))).when(F.size(used) < 2, out(1, pick(texts)))
        .when(same(0, 1) | F.when(F.size(used) == 3, same(0, 2)).otherwise(same(0, 1)), out(1, F.get(used, F.lit(0)))).when(same(1, 2), out(1, F.get(used, F.lit(2)))).otherwise(out(-1, pick(used)))
    )


def within_budget(df: DataFrame, wrong: str = "wrong_turn_count", most: int = 10) -> DataFrame:
    """Dialogues that have not failed too often."""
    return df.where(F.coalesce(F.col(wrong), F.lit(0)) <= most)


def meta_prompt(persona: Column, day: Column, english: Column, thinks: Column) -> Column:
    """The system messages of a record: a persona, the day in the dialogue's language, and a way of thinking, as far as they are given."""
    told = F.when(day.isNotNull(), F.when(F.coalesce(english, F.lit(True)), F.concat(F.lit("Today is "), day, F.lit("."))).otherwise(F.concat(F.lit("今天是"), day, F.lit("。"))))
    thought = F.when(F.coalesce(thinks, F.lit(False)), F.lit("Think step by step before you answer."))
    return F.filter(F.array(persona, told, thought), lambda x: x.isNotNull())


def generation_rows(df: DataFrame, step: int, given: str = "input", said: str = "output", gold: str = "gold", score: str = "score", *extra: str) -> DataFrame:
    """Rows of a generation log: input, output, gts, score, step and further columns."""
    return df.select(F.col(given).alias("input"), F.col(said).alias("output"), F.col(gold).alias("gts"), F.col(score).alias("score"), F.lit(step).alias("step"), *extra)


def random_days(df: DataFrame, key: str, year: int = 2023, seed: int = 5) -> DataFrame:
    """`df` with day, english and chinese: a seeded day of the year with its weekday, and a time of day."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(366 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 365)).cast("int")
    day = F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), draw)
    names = F.array(*[F.lit(f"星期{c}") for c in "日一二三四五六"])
    second = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(86400))
    return df.withColumn("day", day).withColumn("english", F.date_format("day", "yyyy-MM-dd, EEEE")).withColumn("chinese", F.concat(F.date_format("day", "yyyy年MM月dd日"), F.lit(", "), F.element_at(names, F.dayofweek("day")))).withColumn("moment", F.date_format((F.unix_seconds(F.to_timestamp("day")) + second).cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
