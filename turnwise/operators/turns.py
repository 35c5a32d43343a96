"""Operators over the ordered turns of dialogues. Arrays of messages stay arrays: no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.markup import quoted
from turnwise.functions.text import normalized_all, trimmed, without_chat_tokens


def explode_turns(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, pos (from 0), role, content, tool_usage, tool_response: one row for each message."""
    return dialogues.select(key, F.posexplode(messages).alias("pos", "m")).select(key, "pos", "m.role", "m.content", "m.tool_usage", "m.tool_response")


def collect_turns(turns: DataFrame, key: str = "cid", pos: str = "pos") -> DataFrame:
    """The inverse: messages in order of `pos`, one row for each key."""
    rest = [c for c in turns.columns if c not in (key, pos)]
    packed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, F.struct(*rest).alias("m")))).alias("x"))
    return packed.select(key, F.transform("x", lambda x: x["m"]).alias("curr_messages"))


def _positions(messages: Column, keep) -> Column:  # noqa: ANN001
    """Places (from 0) of the messages for which `keep` holds."""
    return F.filter(F.transform(messages, lambda m, i: F.when(keep(m), i)), lambda i: i.isNotNull())


def history_start(messages: Column, until: Column, max_turns: int) -> Column:
    """First place of the window of the last `max_turns` user turns before `until`; with no more user turns than that, 0."""
    users = F.filter(_positions(messages, lambda m: m["role"] == "user"), lambda i: i < until)
    return F.when(F.size(users) <= max_turns, F.lit(0)).otherwise(F.get(users, F.size(users) - max_turns))


def call_blocks(usage: Column) -> Column:
    """Calls (name, parameters as JSON text) as call blocks, one below the other."""
    return F.array_join(F.transform(usage, lambda u: F.concat(F.lit('<tool_call>\n{"name": '), quoted(F.coalesce(u["name"], F.lit(""))), F.lit(', "arguments": '), F.coalesce(u["parameters"], F.lit("{}")), F.lit("}\n</tool_call>"))), "\n")


def response_blocks(responses: Column) -> Column:
    """Responses (name, results as JSON text) as response blocks, one below the other."""
    return F.array_join(F.transform(responses, lambda r: F.concat(F.lit("<tool_response>\n"), F.coalesce(r["results"], F.lit("null")), F.lit("\n</tool_response>"))), "\n")


def render_message(m: Column) -> Column:
    """A message as chat markup: calls as blocks, tool messages as a user's response blocks. Other roles than user, assistant and tool give null."""
    said = trimmed(F.coalesce(m["content"], F.lit("")))
    body = F.when(m["role"] == "tool", response_blocks(F.coalesce(m["tool_response"], F.array().cast("array<struct<name:string,results:string>>"))))
    body = body.when((m["role"] == "assistant") & F.coalesce(F.size(m["tool_usage"]) > 0, F.lit(False)), call_blocks(m["tool_usage"])).otherwise(said)
    speaker = F.when(m["role"] == "tool", "user").otherwise(m["role"])
    return F.when(m["role"].isin("user", "assistant", "tool"), F.concat(F.lit("<|im_start|>"), speaker, F.lit("\n"), body, F.lit("<|im_end|>\n")))


def history_samples(dialogues: DataFrame, max_turns: int = 2, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, pos, n_history, history, output: a training sample for each assistant message that says something in words.

    The history is the window of the last `max_turns` user turns before it as chat markup, without other roles and
    without the first user token and the last end token."""
    m = F.col(messages)
    answers = _positions(m, lambda x: (x["role"] == "assistant") & ~F.coalesce(F.size(x["tool_usage"]) > 0, F.lit(False)) & (F.length(F.trim(x["content"])) > 0))
    rows = dialogues.select(key, m.alias("m"), F.explode(answers).alias("pos"))
    start = history_start(F.col("m"), F.col("pos"), max_turns)
    window = F.slice("m", start + 1, F.col("pos") - start)
    lines = F.filter(F.transform(window, render_message), lambda x: x.isNotNull())
    return rows.select(key, "pos", F.size(lines).alias("n_history"), without_chat_tokens(F.array_join(lines, "")).alias("history"), F.get("m", F.col("pos"))["content"].alias("output"))


def call_samples(dialogues: DataFrame, max_turns: int = 2, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, pos, n_history, output: a sample for each assistant message with calls that a tool message follows whose results hold no "error".

    A dialogue in which a call is followed by anything else gives no samples at all; a call at the end passes."""
    m = F.col(messages)
    called = lambda x: (x["role"] == "assistant") & F.coalesce(F.size(x["tool_usage"]) > 0, F.lit(False))
    after = F.transform(m, lambda x, i: F.struct(called(x).alias("call"), i.alias("i"), F.get(m, i + 1).alias("next")))
    broken = F.exists(after, lambda a: a["call"] & a["next"].isNotNull() & (F.coalesce(a["next"]["role"], F.lit("")) != "tool"))
    fine = F.filter(after, lambda a: a["call"] & (a["next"].isNull() | ~F.contains(F.lower(F.coalesce(F.to_json(a["next"]["tool_response"]), F.lit(""))), F.lit("error"))))
    rows = dialogues.where(~broken).select(key, m.alias("m"), F.explode(F.transform(fine, lambda a: a["i"])).alias("pos"))
    start = history_start(F.col("m"), F.col("pos"), max_turns)
    return rows.select(key, "pos", (F.col("pos") - start).alias("n_history"), F.to_json(F.get("m", F.col("pos"))["tool_usage"]).alias("output"))


def turn_buckets(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, user_turns, bucket: invalid, only_query, no_usage, then lt3, lt5 or extreme by user turns; the first that applies."""
    m = F.col(messages)
    users = F.size(F.filter(m, lambda x: x["role"] == "user"))
    usage = F.exists(m, lambda x: F.coalesce(F.size(x["tool_usage"]) > 0, F.lit(False)))
    all_masked = F.forall(loss_mask(m, F.col("possible_wrong_turns")), lambda x: x == 1)
    bucket = (
        F.when(~F.coalesce(F.col("valid"), F.lit(False)) | m.isNull(), "invalid").when(F.size(m) <= 1, "only_query").when(all_masked, "invalid").when(~usage, "no_usage")
        .when(users < 3, "lt3").when(users < 5, "lt5").otherwise("extreme")
    )
    return dialogues.select(key, F.coalesce(users, F.lit(0)).alias("user_turns"), bucket.alias("bucket"))


def loss_mask(messages: Column, wrong_turns: Column) -> Column:
    """0 for assistant messages that are not among the wrong turns (counted from 1), else 1."""
    wrong = F.coalesce(wrong_turns, F.array().cast("array<int>"))
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & ~F.array_contains(wrong, i + 1), 0).otherwise(1))


def loss_masks(dialogues: DataFrame, key: str = "cid") -> DataFrame:
    mask = loss_mask(F.col("curr_messages"), F.col("possible_wrong_turns"))
    return dialogues.where("curr_messages IS NOT NULL").select(key, F.size(mask).alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("masked"), F.array_join(mask.cast("array<string>"), "").alias("mask"))


def trim_trailing(dialogues: DataFrame, *roles: str, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, kept, trimmed, valid: messages up to the last one with one of the roles; without any the dialogue is not valid."""
    last = F.coalesce(F.array_max(_positions(F.col(messages), lambda m: m["role"].isin(*roles))) + 1, F.lit(0))
    return dialogues.where(F.col(messages).isNotNull()).select(key, last.alias("kept"), (F.size(messages) - last).alias("trimmed"), (last > 0).alias("valid"))


def last_user_turn(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, last_user: place of the last user message that carries no tool responses; the last place if there is none."""
    real = _positions(F.col(messages), lambda m: (m["role"] == "user") & ~F.coalesce(F.size(m["tool_response"]) > 0, F.lit(False)))
    return dialogues.where(F.col(messages).isNotNull()).select(key, F.coalesce(F.array_max(real), F.size(messages) - 1).alias("last_user"))


def next_turns(turns: DataFrame, key: str = "cid", pos: str = "pos") -> DataFrame:
    """`turns` with next_role: the role of the following message."""
    return turns.withColumn("next_role", F.lead("role").over(W.partitionBy(key).orderBy(pos)))


def role_runs(turns: DataFrame, key: str = "cid", pos: str = "pos") -> DataFrame:
    """key, role, first, n: maximal runs of messages of one role (gaps and islands)."""
    w = W.partitionBy(key).orderBy(pos)
    island = turns.withColumn("island", F.row_number().over(w) - F.row_number().over(W.partitionBy(key, "role").orderBy(pos)))
    return island.groupBy(key, "role", "island").agg(F.min(pos).alias("first"), F.count("*").alias("n")).drop("island")


def merged_exchanges(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, pos, n_calls, n_responses, same_names: each call message with the tool message right after it; orphan tool messages are dropped."""
    m = F.col(messages)
    both = F.transform(m, lambda x, i: F.struct(i.alias("pos"), x["tool_usage"].alias("u"), F.get(m, i + 1)["tool_response"].alias("r"), (x["role"] == "assistant").alias("a"), F.coalesce(F.get(m, i + 1)["role"] == "tool", F.lit(False)).alias("t")))
    rows = dialogues.select(key, F.explode(F.filter(both, lambda b: b["a"] & b["t"] & F.coalesce(F.size(b["u"]) > 0, F.lit(False)))).alias("b"))
    names = lambda c: F.transform(F.coalesce(c, F.lit(None)), lambda x: x["name"])
    return rows.select(key, "b.pos", F.size("b.u").alias("n_calls"), F.coalesce(F.size("b.r"), F.lit(0)).alias("n_responses"), F.coalesce(names(F.col("b.u")) == names(F.col("b.r")), F.lit(False)).alias("same_names"))


def valid_turn_rate(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, n_calls, unknown_tools: calls, and calls of tools that the dialogue does not list."""
    names = F.coalesce(F.transform("tools", lambda t: t["name"]), F.array().cast("array<string>"))
    called = F.flatten(F.transform(F.filter(messages, lambda m: m["tool_usage"].isNotNull()), lambda m: F.transform(m["tool_usage"], lambda u: u["name"])))
    return dialogues.where(F.col(messages).isNotNull()).select(key, F.size(called).alias("n_calls"), F.size(F.filter(called, lambda n: ~F.array_contains(names, n))).alias("unknown_tools"))


#: How tools are announced and calls are asked for.
TOOLS_ANNOUNCED = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
CALLS_ASKED_FOR = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>.'


def tool_json(tool: Column) -> Column:
    """A tool (name, description, parameters as JSON text) as a JSON object."""
    return F.concat(F.lit('{"name": '), quoted(F.coalesce(tool["name"], F.lit(""))), F.lit(', "description": '), F.when(tool["description"].isNull(), "null").otherwise(quoted(tool["description"])), F.lit(', "parameters": '), F.coalesce(tool["parameters"], F.lit("null")), F.lit("}"))


def tool_lines(tools: Column) -> Column:
    """One tool a line."""
    return F.array_join(F.transform(F.coalesce(tools, F.array().cast("array<struct<name:string,description:string,parameters:string>>")), tool_json), "\n")


def system_prompt(tools: Column, day: Column, instruction: str = "You answer questions and may call functions.") -> Column:
    """The instruction, the time, one tool a line and how to call them; no tools leave the list empty."""
    lines = tool_lines(tools)
    return F.concat(F.lit(f"{instruction}\n\nThe current time is "), F.coalesce(day, F.lit("None")), F.lit(".\n" + TOOLS_ANNOUNCED), F.when(lines == "", "").otherwise(F.concat(F.lit("\n"), lines)), F.lit(CALLS_ASKED_FOR))


def new_turn_validity(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, pos, valid of each message after the first, as if it had just been added.

    An assistant message must make the number of messages even and call known tools only; a tool message must make it
    odd and answer the calls of the assistant message right before it, as many and with the same names in the same
    order; user messages are always valid."""
    names = F.coalesce(F.transform("tools", lambda t: t["name"]), F.array().cast("array<string>"))
    called = lambda m, part: F.transform(F.coalesce(m[part], F.array().cast(f"array<struct<name:string,{'parameters' if part == 'tool_usage' else 'results'}:string>>")), lambda u: u["name"])

    def fits(m: Column, i: Column) -> Column:
        before = F.get(F.col(messages), i - 1)
        assistant = ((i + 1) % 2 == 0) & (F.size(F.array_except(called(m, "tool_usage"), names)) == 0)
        tool = F.coalesce((i % 2 == 0) & (before["role"] == "assistant") & (F.size(called(before, "tool_usage")) > 0) & (called(before, "tool_usage") == called(m, "tool_response")), F.lit(False))
        return F.when(m["role"] == "assistant", assistant).when(m["role"] == "tool", tool).otherwise(F.lit(True))

    rows = F.transform(messages, lambda m, i: F.struct(i.alias("pos"), fits(m, i).alias("valid")))
    return dialogues.where(F.size(messages) > 1).select(key, F.inline(F.slice(rows, 2, F.size(rows) - 1)))


def without_empty(dialogues: DataFrame, messages: str = "curr_messages", key: str = "cid", least: int = 2) -> DataFrame:
    """key, n, digest: the messages that say something in plain form or carry calls or responses, of dialogues with at least `least` of them; digest is over their plain contents."""
    rows = dialogues.where(F.col(messages).isNotNull()).select(key, F.col(messages).alias("m"), normalized_all(F.transform(messages, lambda m: m["content"])).alias("plain"))
    full = F.filter(F.arrays_zip("m", "plain"), lambda z: (F.coalesce(F.length(z["plain"]), F.lit(0)) > 0) | F.coalesce(F.size(z["m"]["tool_usage"]) > 0, F.lit(False)) | F.coalesce(F.size(z["m"]["tool_response"]) > 0, F.lit(False)))
    return rows.select(key, full.alias("x")).where(F.size("x") >= least).select(key, F.size("x").alias("n"), F.transform("x", lambda z: z["plain"]).alias("contents"))


def incomplete(dialogues: DataFrame, messages: str = "curr_messages", target: str = "tgt_turn_num", key: str = "cid") -> DataFrame:
    """key, lacking: dialogues with fewer messages than wanted."""
    size = F.greatest(F.coalesce(F.size(messages), F.lit(0)), F.lit(0))
    return dialogues.where(size < F.col(target)).select(key, (F.col(target) - size).alias("lacking"))


def first_tool_tag(dialogues: DataFrame, catalog: DataFrame, messages: str = "curr_messages", key: str = "cid") -> DataFrame:
    """key, tag: the category of the first tool that the first message with calls names and the catalogue knows; null without one.

    The last definition of a name counts; the catalogue's side of the join is left to the planner."""
    used = F.filter(messages, lambda m: F.coalesce(F.size(m["tool_usage"]) > 0, F.lit(False)))
    calls = dialogues.select(key, F.posexplode_outer(F.transform(F.get(used, F.lit(0))["tool_usage"], lambda u: u["name"])).alias("place", "name"))
    tags = catalog.groupBy("name").agg(F.max("category").alias("tag"))
    best = calls.join(tags, "name", "left").groupBy(key).agg(F.min_by("tag", F.when(F.col("tag").isNotNull(), F.col("place"))).alias("tag"))
    return best


def bucket_counts(dialogues: DataFrame) -> DataFrame:
    """bucket, n, user_turns: how many dialogues fall into each bucket, and their user turns."""
    return turn_buckets(dialogues).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("user_turns").alias("user_turns"))


def in_buckets(dialogues: DataFrame, *buckets: str, key: str = "cid") -> DataFrame:
    """key of the dialogues in any of the buckets, for buckets that are kept together."""
    return turn_buckets(dialogues, key=key).where(F.col("bucket").isin(*buckets)).select(key)


def transcript(messages: Column) -> Column:
    """Messages as lines of tagged text: calls as name|parameters and responses inside their messages."""
    usage = lambda m: F.array_join(F.transform(F.coalesce(m["tool_usage"], F.array().cast("array<struct<name:string,parameters:string>>")), lambda u: F.concat(F.lit("<tool_usage>"), u["name"], F.lit("|"), u["parameters"], F.lit("</tool_usage>"))), "")
    answers = lambda m: F.array_join(F.transform(F.coalesce(m["tool_response"], F.array().cast("array<struct<name:string,results:string>>")), lambda r: F.concat(F.lit("<tool_response>"), r["results"], F.lit("</tool_response>"))), "")
    said = lambda m: F.coalesce(m["content"], F.lit(""))
    line = lambda m: F.when(m["role"] == "user", F.concat(F.lit("<user>"), said(m), F.lit("</user>"))).when(m["role"] == "assistant", F.concat(F.lit("<assistant>"), said(m), usage(m), F.lit("</assistant>"))).when(m["role"] == "tool", F.concat(F.lit("<tool>"), answers(m), F.lit("</tool>")))
    return F.array_join(F.transform(messages, line), "\n")
