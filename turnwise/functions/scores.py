"""Scores of responses by data source, and how managers place and shape them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.calls import bodies, canonical_calls, exact_reward, length_reward, prefix_reward
from turnwise.functions.graders import final_scores, located_scores
from turnwise.functions.answers import boxed_scores
from turnwise.functions.tensors import overlong_penalty
from turnwise.functions.text import contains_match, exact_match, final_number, last_answer, trimmed

#: Where the last assistant turn begins and where it ends, by family of models.
ASSISTANT = {"im": ("<|im_start|>assistant", "<|im_end|>"), "header": ("<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>")}


def predicted(text: Column, family: str = "im") -> Column:
    """What the last assistant turn of a rendered dialogue says."""
    start, end = ASSISTANT[family]
    last = F.element_at(F.split(text, _literal(start)), -1)
    return trimmed(F.get(F.split(last, _literal(end)), F.lit(0)))


def _literal(text: str) -> str:
    return rf"\Q{text}\E"


def correctness(label: Column, answer: Column, best: float = 3.0, worst: float = -3.0, partial: bool = False) -> Column:
    """Of a response against its label: without calls on both sides best, with calls on one side worst, else by the calls."""
    tags = answer.contains("<tool_call>"), answer.contains("</tool_call>")
    gold, given = (canonical_calls(bodies(c)) for c in (label, answer))
    by_calls = prefix_reward(gold, given, worst) if partial else exact_reward(gold, given, best, worst)
    plain = F.when(~tags[0] & ~tags[1], F.lit(best)).otherwise(F.lit(worst))
    return F.when(~label.contains("<tool_call>"), plain).when(tags[0] & tags[1], by_calls).otherwise(F.lit(worst))


def call_score(text: Column, label: Column, family: str = "im", best: float = 3.0, worst: float = -3.0, partial: bool = False, with_length: bool = False) -> Column:
    """score, format, correctness, length of a rendered dialogue's last turn; the format counts nothing."""
    said = predicted(text, family)
    right = correctness(label, said, best, worst, partial).cast("double")
    length = length_reward(said).cast("double") if with_length else F.lit(0.0)
    return F.struct((right + length).alias("score"), F.lit(0.0).alias("format"), right.alias("correctness"), length.alias("length"))


def number_score(text: Column, gold: Column, strict: bool = True, wrong: float = 0.0, right: float = 1.0) -> Column:
    """Of the final number: 0 without one, else right or wrong."""
    n = final_number(text, strict)
    return F.when(n.isNull(), 0.0).when(n == gold, right).otherwise(wrong)


def answer_tags(text: Column) -> Column:
    return F.struct(F.regexp_count(text, F.lit("<answer>")).alias("opened"), F.regexp_count(text, F.lit("</answer>")).alias("closed"))


def search_score(text: Column, golds: Column, within: bool = False, wrong: float = 0.0, right: float = 1.0) -> Column:
    """Of the last answer: 0 without one; right if it equals (or, `within`, holds) a gold answer. More than ten tags leave a quarter of an exact match."""
    answer, tags = last_answer(text), answer_tags(text)
    if within:
        return F.when(answer.isNull(), 0.0).when(contains_match(answer, golds), right).otherwise(wrong)
    many = (tags["opened"] > 10) | (tags["closed"] > 10)
    return F.when(answer.isNull(), 0.0).when(exact_match(answer, golds), F.when(many, right / 4).otherwise(right)).otherwise(wrong)


def pass_rate(results: Column, continuous: bool = False) -> Column:
    """Of test results (true, false, null for a crash): whether all of them passed, or the share of the first ten."""
    ok = lambda xs: F.aggregate(F.transform(xs, lambda x: F.coalesce(x, F.lit(False)).cast("double")), F.lit(0.0), lambda a, x: a + x)
    if continuous:
        first = F.slice(results, 1, 10)
        return F.try_divide(ok(first), F.size(first))
    return F.forall(results, lambda x: F.coalesce(x, F.lit(False))).cast("double")


def same_output(output: Column, expected: Column) -> Column:
    """Lines of an output against the expected ones, blanks around the whole aside."""
    joined = lambda xs: trimmed(F.array_join(xs, "\n"))
    return joined(output) == joined(expected)


# ---- dispatch ----------------------------------------------------------------------------------------------------

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(*sources: str) -> Callable:
    """Register a scorer of (response, gold) under the data sources that it serves; a source has one."""

    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        for s in sources:
            if SCORERS.setdefault(s, f) is not f:
                raise ValueError(f"{s} is taken")
        return f

    return add


scorer("calls")(lambda text, gold: call_score(text, gold)["score"])
scorer("numbers")(number_score)
scorer("search")(lambda text, gold: search_score(text, F.array(gold)))
scorer("boxed")(boxed_scores)
scorer("final")(lambda text, gold: final_scores(text, gold)["score"])
scorer("located")(lambda text, gold: located_scores(text, gold)["correct"].cast("double"))


def scored(df: DataFrame, source: str = "data_source", text: str = "response", gold: str = "gold", sources: dict[str, str] | None = None) -> DataFrame:
    """`df` with score by the scorer of each row's source; `sources` maps further names. A source without a scorer is an error when its row is read.

    Only the scorers of sources named by the caller or registered are part of the plan, each behind its condition."""
    names = {s: s for s in SCORERS} | (sources or {})
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(F.col(source), F.lit("null")))).cast("double")
    parts = {}
    for name, kind in names.items():
        parts.setdefault(kind, []).append(name)
    for kind, served in parts.items():
        here = F.col(source).isin(*served)
        value = SCORERS[kind](F.when(here, F.col(text)), F.when(here, F.col(gold)))
        out = F.when(here, value.cast("double")).otherwise(out)
    return df.withColumn("score", out)


# ---- managers ----------------------------------------------------------------------------------------------------

MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def manager(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if MANAGERS.setdefault(name, f) is not f:
            raise ValueError(f"{name} is taken")
        return f

    return add


def managed(name: str, df: DataFrame, **options: object) -> DataFrame:
    if name not in MANAGERS:
        raise ValueError(f"no manager {name}; there are {sorted(MANAGERS)}")
    return MANAGERS[name](df, **options)


@manager("naive")
@manager("batch")
def plain_manager(df: DataFrame, **options: object) -> DataFrame:
    """`df` with score and reward, which are one."""
    return scored(df, **options).withColumn("reward", F.col("score"))


@manager("overlong")
def overlong_manager(df: DataFrame, length: str = "length", longest: int = 1024, buffer: int = 256, factor: float = 1.0, **options: object) -> DataFrame:
    """Rewards fall linearly within the buffer before the longest length."""
    return scored(df, **options).withColumn("penalty", overlong_penalty(F.col(length), longest, buffer, factor)).withColumn("reward", F.col("score") + F.col("penalty"))


@manager("safe")
def safe_manager(df: DataFrame, **options: object) -> DataFrame:
    """A score that cannot be told counts 0."""
    return scored(df, **options).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("reward", F.col("score"))
