"""Best representative of each group of duplicate records: a latent two-sided quality model.

Every source (a crawl worker) asserts facts about an entity: the messages of a dialogue and the elements of
its multi-valued fields. A source that reported on the entity without asserting a fact denies it. Expectation
maximization estimates each source's sensitivity (share of true facts it asserts) and specificity (share of
false facts it leaves out), and with these the probability that each fact is true. A fact that a row with a
true validity flag asserts is known to be true. The surviving value of the message list is the one with most
expected true messages among the rows with the best validity flag, the latest of those, then the one with the
smallest id; scalar fields keep the latest valid value, and multi-valued fields keep every element judged true.

Only who asserts a fact and who reported on its entity matters for its probability. Facts are therefore counted by
pattern (reporting sources, asserting sources, known to be true), and the rounds run over the patterns: their
number follows the sets of sources, not the rows. Facts meet the model again by pattern. Scalar values are facts
too: where no row of an entity is valid, the value most likely to be true survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.visible import is_filled
from turnwise.plans.lineage import cut

SCALARS = ("curr_time", "curr_day", "tgt_turn_num", "use_cot", "use_func_call", "use_plan", "need_chat", "is_en", "plan", "wrong_turn_count")


def _fact(field: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(field), *parts)


def _message_facts(messages: Column) -> Column:
    """The facts of the filled messages: place and whole message."""
    placed = F.transform(messages, lambda m, i: F.struct(is_filled(m).alias("filled"), _fact("message", i, m["role"], m["content"], m["tool_usage"], m["tool_response"]).alias("fact")))
    return F.coalesce(F.transform(F.filter(placed, lambda x: x["filled"]), lambda x: x["fact"]), F.array().cast("array<bigint>"))


def _rows(df: DataFrame, key: str, row_id: str, source: str, scalars: Sequence[str] = ()) -> DataFrame:
    """The columns that the model needs, under its own names. Rows without a key belong to no group."""
    elements = lambda name, values: F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value"), _fact(name, v.cast("string")).alias("fact")))
    lists = [("tool", F.transform(F.col("tools"), lambda t: t["name"])), ("wrong_turn", F.col("possible_wrong_turns")), *((c, F.array(c)) for c in scalars)]
    none = F.array().cast("array<struct<field:string,value:string,fact:bigint>>")
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(row_id).alias("row_id"), F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"),
        F.coalesce(F.col("valid"), F.lit(False)).alias("good"), F.col("snap_time").alias("at"), _message_facts(F.col("curr_messages")).alias("messages"),
        F.concat(*[F.coalesce(elements(name, values), none) for name, values in lists]).alias("elements"),
    )


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """For the right side of a join: broadcast only if a count shows at most `rows` rows, else merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def source_quality(patterns: DataFrame, rounds: int = 12, tolerance: float = 0.002, prior: float = 0.5) -> DataFrame:
    """source, sens, spec: by expectation maximization over patterns (pattern, reporting, asserting, good, n), until no value moves by more than the tolerance."""
    parts = cut(patterns.select("pattern", "good", "n", "asserting", F.explode("reporting").alias("source")).select("pattern", "good", "n", "source", F.array_contains("asserting", F.col("source")).alias("said")))
    sources = cut(parts.select("source").distinct().withColumns({"sens": F.lit(0.8), "spec": F.lit(0.9)}))
    few = sources.limit((1 << 16) + 1).count() <= 1 << 16
    for _ in range(rounds):
        known = F.broadcast(sources) if few else sources.hint("merge")
        p = parts.join(known, "source").groupBy("pattern").agg(_truth(F.first("good"), F.sum(_weight(F.col("said"))), prior).alias("p"))
        share = lambda part, whole, a, b: (F.sum(part) + a) / (F.sum(whole) + a + b)
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        new = parts.join(p.hint("merge"), "pattern").groupBy("source").agg(
            share(F.when(F.col("said"), true).otherwise(0.0), true, 2, 1).alias("new_sens"), (1 - share(F.when(F.col("said"), false).otherwise(0.0), false, 1, 9)).alias("new_spec")
        )
        both = cut(new.join(known, "source"))
        moved = both.agg(F.max(F.greatest(F.abs(F.col("new_sens") - F.col("sens")), F.abs(F.col("new_spec") - F.col("spec"))))).first()[0]
        sources = both.select("source", F.col("new_sens").alias("sens"), F.col("new_spec").alias("spec"))
        if moved is None or moved <= tolerance:
            break
    return sources


def _weight(said: Column) -> Column:
    """What one source adds to the log odds of a fact that it reported on."""
    return F.when(said, F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))


def _truth(good: Column, weight: Column, prior: float) -> Column:
    odds = F.lit(prior / (1 - prior)) * F.exp(F.least(F.greatest(weight, F.lit(-500.0)), F.lit(500.0)))
    return F.when(good, 1.0).otherwise(odds / (1 + odds))


def fact_truth(rows: DataFrame, rounds: int = 12, prior: float = 0.5) -> DataFrame:
    """key, field, value (null for messages), fact, p: the probability that each asserted fact is true."""
    messages = F.transform(F.col("messages"), lambda h: F.struct(F.lit("message").alias("field"), F.lit(None).cast("string").alias("value"), h.alias("fact")))
    claims = (
        rows.select("key", "source", "good", F.explode(F.concat(messages, "elements")).alias("f")).groupBy("key", F.col("f.fact").alias("fact"))
        .agg(F.max("good").alias("good"), F.first("f.field").alias("field"), F.first("f.value").alias("value"), F.array_sort(F.collect_set("source")).alias("asserting"))
    )
    covers = rows.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("reporting"))
    facts = cut(claims.join(covers.hint("merge"), "key").withColumn("pattern", F.xxhash64("reporting", "asserting", "good")))
    patterns = cut(facts.groupBy("pattern").agg(F.first("reporting").alias("reporting"), F.first("asserting").alias("asserting"), F.first("good").alias("good"), F.count("*").alias("n")))
    sources = _beside(source_quality(patterns, rounds, prior=prior), 1 << 16)
    parts = patterns.select("pattern", "good", "asserting", F.explode("reporting").alias("source")).join(sources, "source").withColumn("said", F.array_contains("asserting", F.col("source")))
    p = cut(parts.groupBy("pattern").agg(_truth(F.first("good"), F.sum(_weight(F.col("said"))), prior).alias("p")))
    return facts.select("key", "field", "value", "fact", "pattern").join(_beside(p, 1 << 20), "pattern").drop("pattern")


def surviving_rows(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """key, row_id, n_rows, any_good, expected: the row that gives each key's message list."""
    truths = facts.where("field = 'message'").select("key", "fact", "p")
    scores = rows.select("key", "row_id", F.explode("messages").alias("fact")).join(truths.hint("merge"), ["key", "fact"]).groupBy("row_id").agg(F.sum("p").alias("expected"))
    order = F.struct("good", F.round("expected", 6).alias("expected"), "at", (-F.col("row_id")).alias("low"))
    return (
        rows.select("key", "row_id", "good", "at").join(scores.hint("merge"), "row_id", "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
        .groupBy("key").agg(F.count("*").alias("n_rows"), F.max("good").alias("any_good"), F.max(order).alias("best"))
        .select("key", (-F.col("best.low")).alias("row_id"), "n_rows", "any_good", F.col("best.expected").alias("expected"))
    )


def survivors(df: DataFrame, key: str = "cid", row_id: str = "snapshot_id", source: str = "worker", scalars: Sequence[str] = SCALARS, rounds: int = 12) -> DataFrame:
    """One surviving record per key.

    key, the id of the row that gave curr_messages, curr_messages, n_rows, any_valid, expected_messages, each
    scalar field (latest non-null value of a valid row; without a valid row the value most likely to be true, of
    equals the latest; then ties go to the smallest id) and tool_names and possible_wrong_turns (every element
    judged true, sorted; empty if none).

    Rows with a null key are left out. Null or empty message lists, null sources, flags and times are allowed:
    such rows lose to fuller, valid, dated ones. Row ids must be unique; other columns of `df` are ignored.
    An empty table gives an empty result.
    """
    rows = cut(_rows(df, key, row_id, source, scalars))
    facts = fact_truth(rows, rounds)
    best = surviving_rows(rows, facts)
    # values of valid rows have p = 1, so that the order is: valid, likely, late, small id
    stated = rows.select("key", "row_id", "good", "at", F.explode(F.filter("elements", lambda e: e["field"].isin(*scalars))).alias("e")).select("key", "row_id", "good", "at", "e.field", "e.fact")
    believed = facts.where(F.col("field").isin(*scalars)).select("key", "fact", F.round("p", 6).alias("p"))
    order = F.struct("good", "p", "at", (-F.col("row_id")).alias("low"))
    chosen = stated.join(believed.hint("merge"), ["key", "fact"]).groupBy("key", "field").agg(F.max(order)["low"].alias("low"))
    values = df.where(F.col(key).isNotNull()).select((-F.col(row_id)).alias("low"), F.posexplode(F.array(*[F.col(c).cast("string") for c in scalars])).alias("place", "text"))
    named = chosen.join(values.withColumn("field", F.element_at(F.array(*map(F.lit, scalars)), F.col("place") + 1)).hint("merge"), ["low", "field"])
    fields = named.groupBy("key").agg(*[F.max(F.when(F.col("field") == c, F.col("text"))).cast(df.schema[c].dataType).alias(c) for c in scalars])
    judged = facts.where(F.col("field").isin("tool", "wrong_turn") & (F.col("p") >= 0.5)).groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("field") == "tool", F.col("value")))).alias("tool_names"),
        F.array_sort(F.collect_set(F.when(F.col("field") == "wrong_turn", F.col("value").cast("int")))).alias("possible_wrong_turns"),
    )
    lists = df.where(F.col(key).isNotNull()).select(F.col(row_id).alias("row_id"), "curr_messages")
    return (
        lists.join(best.hint("merge"), "row_id").join(fields.hint("merge"), "key", "left").join(judged.hint("merge"), "key", "left")
        .select(F.col("key").alias(key), F.col("row_id").alias(row_id), "curr_messages", "n_rows", F.col("any_good").alias("any_valid"), F.col("expected").alias("expected_messages"), *scalars, F.coalesce("tool_names", F.array().cast("array<string>")).alias("tool_names"), F.coalesce("possible_wrong_turns", F.array().cast("array<int>")).alias("possible_wrong_turns"))
    )


def found(df: DataFrame, key: str = "cid", row_id: str = "snapshot_id", source: str = "worker", rounds: int = 12) -> DataFrame:
    """key and row id of the surviving message list, for keys with two or more rows and a valid one."""
    rows = cut(_rows(df, key, row_id, source))
    best = surviving_rows(rows, fact_truth(rows, rounds))
    return best.where("n_rows > 1 AND any_good").select(F.col("key").alias(key), F.col("row_id").alias(row_id))
