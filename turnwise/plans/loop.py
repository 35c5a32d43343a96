"""The data loop as plans over services: verify labels against responses, write new samples for errors, filter samples.

Services answer batches of prompts (see `plugins`); everything between their calls are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import calls, markup, text
from turnwise.operators import metrics, votes
from turnwise.plans import plugins

Service = Callable[[list[str]], list[str]]


def tokenized(df: DataFrame, column: str, into: str = "ids", tokenizer: Callable[[list[str]], list[list[int]]] = plugins.blank_tokenizer) -> DataFrame:
    """`df` with the token ids of a text, in Arrow batches; null texts have none."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        found = tokenizer(texts[some].tolist())
        for at, x in zip(texts.index[some], found):
            out[at] = x
        return out

    return df.withColumn(into, ids(F.col(column)))


def prompt_rows(df: DataFrame, prompt: str, longest: int, fill: int = 0, truncation: str = "left", tokenizer: Callable[[list[str]], list[list[int]]] = plugins.blank_tokenizer) -> DataFrame:
    """`df` with ids, mask and places of prompts of one length, padded at the left; an index that extra_info lacks is 0."""
    from turnwise.functions.tensors import fitted, position_ids

    rows = tokenized(df, prompt, "_raw", tokenizer)
    both = fitted(F.col("_raw"), F.transform("_raw", lambda _: F.lit(1)), longest, fill, True, truncation)
    out = rows.withColumn("_both", both).withColumn("ids", F.col("_both.ids")).withColumn("mask", F.col("_both.mask")).withColumn("places", position_ids(F.col("mask")))
    index = F.coalesce(F.col("extra_info.index"), F.lit(0)) if "extra_info" in df.columns else F.lit(0)
    return out.withColumn("index", index.cast("long")).drop("_raw", "_both")


def message_ids(df: DataFrame, prefixes: str, tokenizer: Callable[[list[str]], list[list[int]]] = plugins.blank_tokenizer) -> DataFrame:
    """`df` with parts: the ids that each rendered prefix of a dialogue (an array of texts) adds to the one before."""
    @F.pandas_udf("array<array<int>>")
    def added(lists: pd.Series) -> pd.Series:
        def one(texts: list[str]) -> list[list[int]]:
            whole = tokenizer(list(texts))
            return [b[len(a) :] for a, b in zip([[], *whole], whole)]

        return lists.map(one, na_action="ignore")

    return df.withColumn("parts", added(F.col(prefixes)))


def probed(samples: DataFrame, generate: Service, prompt: str = "input") -> DataFrame:
    """Samples with response, its thought and its answer."""
    said = plugins.apply(samples, generate, prompt, "_said")
    return said.withColumn("think", text.thought(F.col("_said"))).withColumn("response", text.after_thought(F.col("_said"))).drop("_said")


def voted(df: DataFrame, judges: list[Service], prompt: str, label: Callable[[Column], Column]) -> DataFrame:
    """`df` with votes (the labels in order), label, raw (the first judgement with it), consensus (two or more agree). Rows without a prompt are not judged."""
    for k, judge in enumerate(judges):
        df = plugins.apply(df, judge, prompt, f"_raw{k}")
    raws = F.array(*[F.col(f"_raw{k}") for k in range(len(judges))])
    labels = F.transform(raws, label)
    times = F.transform(labels, lambda x: F.size(F.filter(labels, lambda y: y == x)))
    at = F.array_position(times, F.array_max(times))
    out = df.withColumn("votes", F.when(F.col(prompt).isNotNull(), labels)).withColumn("_at", F.when(F.col(prompt).isNotNull(), at.cast("int")))
    out = out.withColumn("label", F.get(labels, F.col("_at") - 1)).withColumn("raw", F.get(raws, F.col("_at") - 1)).withColumn("consensus", F.when(F.col(prompt).isNotNull(), F.array_max(times) >= 2))
    return out.drop("_at", *[f"_raw{k}" for k in range(len(judges))])


def verified(probes: DataFrame, judges: list[Service]) -> DataFrame:
    """Probes (instruction, input, output, response) with status, error_message, votes and consensus. Only rows that equality does not settle reach the judges."""
    canon = lambda c: calls.canonical_calls(calls.bodies(F.col(c)))
    called = lambda c: F.startswith(text.trimmed(F.col(c)), F.lit("<tool_call>"))
    settled = F.when(F.col("output") == F.col("response"), "both_correct").when(~called("output") & ~called("response"), "not_function_call").when(calls.same_calls(canon("output"), canon("response")), "both_correct")
    rows = probes.withColumn("_settled", settled)
    asked = markup.render(markup.COMPARE, date=text.date_in(F.col("instruction"), "verify"), tools=markup.tools_text(F.col("instruction")), conversation=F.col("input"), output=F.col("output"), response=F.col("response"))
    judged = voted(rows.withColumn("_prompt", F.when(F.col("_settled").isNull(), asked)), judges, "_prompt", votes.vote_label)
    out = judged.withColumn("status", F.coalesce("_settled", markup.status_label(F.col("raw"))))
    return out.withColumn("error_message", F.when(F.col("_settled").isNull(), markup.error_message(F.col("raw"), F.col("status") == "llm_judge_failed"))).drop("_settled", "_prompt", "raw", "label")


def verification_summary(rows: DataFrame) -> DataFrame:
    """errors, agreed, rate of verified rows."""
    flags = rows.select(F.col("votes").isNotNull().alias("called"), F.coalesce(F.col("status").contains("incorrect"), F.lit(False)).alias("wrong"), F.coalesce("consensus", F.lit(False)).alias("consensus"))
    return votes.judge_summary(flags)


def expanded(errors: DataFrame, generate: Service, key: str, times: int = 3) -> DataFrame:
    """New samples (instruction, input, output, variant) for each error that can be rewritten, with the error they come from as original_sample; texts that are no sample are left out."""
    usable = votes.errors_to_expand(errors.withColumnRenamed("response", "answer").withColumnRenamed("output", "label")).withColumnRenamed("answer", "response").withColumnRenamed("label", "output")
    original = F.struct(*usable.columns)
    rows = votes.fan_out(usable.withColumn("original_sample", original), key, times)
    right, wrong = markup.sides(F.col("status"), F.col("output"), F.col("response"))
    asked = markup.render(markup.EXPAND, date=text.date_in(F.col("instruction")), tools=markup.tools_text(F.col("instruction")), input=F.col("input"), correct=right, incorrect=wrong, error=F.col("error_message"))
    said = plugins.apply(rows.withColumn("_prompt", asked), generate, "_prompt", "_said").withColumn("_new", markup.generated_sample(F.col("_said")))
    fine = said.where(markup.is_valid_sample(F.col("_new")))
    return fine.select("instruction", markup.from_simple_form(F.col("_new.input"), text.tidy_tags).alias("input"), text.tidy_tags(F.col("_new.output")).alias("output"), "variant", "original_sample")


def filtered(samples: DataFrame, judges: list[Service], key: str) -> DataFrame:
    """Samples (key, instruction, input, output) with status and error_message: no call, broken rules of the instruction's own tools, or what the judges say."""
    tools = samples.select(F.col(key).alias("_k"), F.explode(F.filter(F.transform(F.split(markup.tools_text(F.col("instruction")), "\n"), text.trimmed), lambda x: F.get_json_object(x, "$.name").isNotNull())).alias("d"))
    shape = "struct<name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>"
    own = tools.select(F.concat_ws("\x01", "_k", F.get_json_object("d", "$.name")).alias("name"), F.from_json("d", shape)["parameters"].alias("parameters"))
    made = samples.select(F.col(key).alias("_k"), F.posexplode(markup.named_calls(F.col("output"))).alias("_p", "c"))
    checked = calls.rule_checks(made.select(F.concat_ws("\x01", "_k", "_p").alias("call_id"), F.concat_ws("\x01", "_k", "c.name").alias("name"), F.col("c.arguments").alias("parameters")), own)
    broken = checked.where("violation <> 'none'").groupBy(F.substring_index("call_id", "\x01", 1).alias("_k")).agg(F.array_sort(F.collect_list("violation")).alias("_bad"))
    rows = samples.join(broken.hint("merge"), F.col(key).cast("string") == F.col("_k"), "left").drop("_k").withColumn("_bad", F.coalesce("_bad", F.array().cast("array<string>")))
    called = F.startswith(text.trimmed(F.col("output")), F.lit("<tool_call>"))
    asked = markup.render(markup.CHECK, date=text.date_in(F.col("instruction"), "filter"), tools=markup.tools_text(F.col("instruction")), conversation=F.col("input"), output=F.col("output"))
    judged = voted(rows.withColumn("_prompt", F.when(called & (F.size("_bad") == 0), asked)), judges, "_prompt", lambda r: F.upper(votes.check_label(r)))
    out = markup.filter_status(F.col("output"), F.col("_bad"), F.coalesce("label", F.lit("?")), F.coalesce("consensus", F.lit(False)))
    done = judged.withColumn("_out", out).withColumn("status", F.col("_out.status"))
    reason = F.when(F.startswith("status", F.lit("incorrect")), markup.error_message(F.col("raw"), F.lit(False), False)).otherwise(F.col("_out.error_message"))
    return done.withColumn("error_message", reason).drop("_out", "_bad", "_prompt", "raw", "label")


def difficulty_rows(probes: DataFrame, logprobs: str) -> DataFrame:
    """Probes with mean log-probability, its negative and perplexity of their responses' tokens."""
    mean, negative, perplexity = metrics.difficulty(F.col(logprobs))
    return probes.withColumn("avg_log_prob", mean).withColumn("avg_negative_log_likelihood", negative).withColumn("perplexity", perplexity)


def answered(history: Column, message: Column) -> Column:
    """A chat history with one more message."""
    return F.array_append(history, message)


def rule_rows(df: DataFrame, column: str = "reward_model") -> DataFrame:
    """Rows that a rule scores, not a model."""
    return df.where(F.coalesce(F.col(f"{column}.style") != "model", F.lit(True)))
