"""Parsers and renderers of call formats, instructions, judge texts and role outputs, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.answers import call_syntax
from turnwise.functions.calls import bodies, strict_json
from turnwise.functions.text import trimmed

CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def extract_first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match, unlike an empty one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# ---- calls -------------------------------------------------------------------------------------------------------


def named_calls(text: Column) -> Column:
    """name and arguments (JSON text) of each call block of a text, on lines of their own or not; bodies that are no object with both are skipped."""
    parsed = F.transform(bodies(text, False), lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    both = F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    return F.when(text.contains("<tool_call>") & text.contains("</tool_call>"), both).otherwise(F.array().cast(CALLS))


#: The analysis channel, which is removed first, and a call in the channel format.
ANALYSIS = (r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", r"(?s)<\|channel\|>analysis<\|message\|>(.*?)<\|end\|>")
CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def _without_analysis(text: Column, padding: str | None = None) -> Column:
    text = F.replace(text, F.lit(padding)) if padding else text
    for pattern in ANALYSIS:
        text = F.regexp_replace(text, pattern, "")
    return text


def channel_calls(text: Column, padding: str | None = None) -> Column:
    """name and arguments of each call in the channel format, whatever the arguments are; calls inside the analysis channel don't count."""
    plain = _without_analysis(text, padding)
    part = lambda k: F.regexp_extract_all(plain, F.lit(CHANNEL_CALL), F.lit(k))
    return F.zip_with(part(1), part(2), lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def without_channel_calls(text: Column, padding: str | None = None) -> Column:
    return F.regexp_replace(_without_analysis(text, padding), CHANNEL_CALL, "")


def blocks_of(value: str) -> str:
    """A JSON list of calls (or one call) as call blocks; what is no object is left out."""
    calls = json.loads(value)
    calls = calls if isinstance(calls, list) else [calls]
    return "\n".join(f"<tool_call>\n{json.dumps({'name': c.get('name', ''), 'arguments': c.get('arguments', {})})}\n</tool_call>" for c in calls if isinstance(c, dict))


@F.pandas_udf(T.StringType())
def json_calls_as_blocks(texts: pd.Series) -> pd.Series:
    """Blocks of JSON lists of calls, with the spacing and escapes of the plain JSON writer; null where a text is no JSON."""

    def one(t: str) -> str | None:
        try:
            return blocks_of(t)
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore")


def usage_list(usage: Column) -> Column:
    """Calls (name, parameters as JSON text) as one JSON list of name and arguments; empty text without any."""
    return _json_list(usage, "parameters", "arguments")


def response_list(responses: Column) -> Column:
    """Responses (name, results as JSON text) as one JSON list; empty text without any."""
    return _json_list(responses, "results", "results")


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    packed = F.to_json(F.array(text))
    return F.substring(packed, 2, F.length(packed) - 2)


def _json_list(items: Column, part: str, into: str) -> Column:
    one = lambda u: F.concat(F.lit('{"name": '), quoted(F.coalesce(u["name"], F.lit(""))), F.lit(f', "{into}": '), F.coalesce(u[part], F.lit("null")), F.lit("}"))
    return F.when(F.coalesce(F.size(items) > 0, F.lit(False)), F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))).otherwise(F.lit(""))


def function_calls(usage: Column, turn: Column) -> Column:
    """Calls (name, parameters) in the form id, type, function(name, parameters); ids are unique for turn and place and the same in every run."""
    place = lambda i: F.concat(F.lpad(turn.cast("string"), 3, "0"), F.lpad(i.cast("string"), 3, "0"))
    return F.transform(usage, lambda u, i: F.struct(F.concat(F.xxhash64(u["name"], u["parameters"]).cast("string"), place(i)).alias("id"), F.lit("function").alias("type"), F.struct(u["name"].alias("name"), u["parameters"].alias("parameters")).alias("function")))


def usages(calls: Column) -> Column:
    """The inverse of `function_calls`."""
    return F.transform(calls, lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["parameters"].alias("parameters")))


def safe_call(call: Column) -> Column:
    """name, arguments, failed of a function call (name, arguments as text): arguments that are no JSON object become {} and are flagged."""
    parsed = strict_json(call["arguments"])
    good = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    return F.struct(call["name"].alias("name"), F.when(good, call["arguments"]).otherwise(F.lit("{}")).alias("arguments"), (~good).alias("failed"))


def argument_maps(text: Column) -> Column:
    """[{name: arguments}] of a response's call blocks as maps of JSON text; empty if any body is no object with a name and arguments."""
    parsed = F.transform(bodies(text), lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    whole = F.forall(parsed, lambda c: c["name"].isNotNull() & F.startswith(F.coalesce(c["arguments"], F.lit("")), F.lit("{")))
    return F.when(whole, F.transform(parsed, lambda c: F.create_map(c["name"], c["arguments"]))).otherwise(F.array().cast("array<map<string,string>>"))


def python_call(name: str, arguments: dict) -> str:
    return f"{name}({','.join(f'{k}={v!r}' for k, v in arguments.items())})"


@F.pandas_udf(T.ArrayType(T.StringType()))
def executable_calls(lists: pd.Series) -> pd.Series:
    """Call bodies as calls in the syntax f(a=1); empty if any body is no object with a name and an object of arguments. Nothing is evaluated."""

    def one(texts: list[str]) -> list[str]:
        try:
            parsed = [json.loads(t) for t in texts]
            return [python_call(c["name"], c["arguments"]) for c in parsed] if all(isinstance(c, dict) for c in parsed) else []
        except (ValueError, KeyError, TypeError, AttributeError):
            return []

    return lists.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def syntax_calls(texts: pd.Series) -> pd.Series:
    """Calls in the syntax f(a=1), g.h(b=[2]) as JSON objects {name: arguments}; what is not literal gives none."""
    return texts.map(lambda t: [json.dumps(c, default=str) for c in call_syntax(t)], na_action="ignore")


def parsed_response(text: Column) -> Column:
    """answer, reasoning and calls (bodies) of a model response. Without a thought the answer is all of it."""
    open_ = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.get(F.split(text, "</think>"), F.lit(0)), r"\n+\z", ""), "<think>"), -1), r"\A\n+", "")
    answer = F.when(text.contains("</think>"), F.regexp_replace(F.element_at(F.split(text, "</think>"), -1), r"\A\n+", "")).otherwise(text)
    return F.struct(answer.alias("answer"), F.when(text.contains("</think>"), open_).otherwise(F.lit("")).alias("reasoning"), bodies(answer).alias("calls"))


# ---- instructions ------------------------------------------------------------------------------------------------


def tools_text(instruction: Column) -> Column:
    """What stands inside the tags of the tool list, trimmed; empty without them."""
    return trimmed(F.regexp_extract(instruction, r"(?s)<tools>\n(.*?)\n</tools>", 1))


def tools_map(instruction: Column) -> Column:
    """name -> definition (JSON text) of the tool list, one a line; lines that are no object with a name are skipped, the last of a name wins.

    Needs spark.sql.mapKeyDedupPolicy LAST_WIN where names repeat."""
    lines = F.transform(F.split(tools_text(instruction), "\n"), trimmed)
    named = F.transform(lines, lambda x: F.struct(F.get_json_object(x, "$.name").alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(named, lambda e: e["key"].isNotNull()))


#: Fixed value: the sentence that announces a JSON list of functions.
LISTED = r"(?s)Here is a list of functions in JSON format that you can invoke\.\s*\n(.+?)(?=\n\n|\z)"


def listed_functions(system: Column) -> Column:
    """name -> definition (JSON text) of an announced JSON list of functions; empty without one."""
    items = F.from_json(F.regexp_extract(system, LISTED, 1), "array<string>")
    named = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(F.get_json_object(x, "$.name").alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(named, lambda e: e["key"].isNotNull()))


def function_schema(tool: Column) -> Column:
    """A tool (name, description, parameters as JSON text) as type and function; an interpreter takes code alone."""
    code = F.lit('{"type": "object", "properties": {"code": {"type": "string", "description": "Python code that can be run"}}}')
    function = F.struct(tool["name"].alias("name"), tool["description"].alias("description"), F.when(tool["name"] == "python_interpreter", code).otherwise(tool["parameters"]).alias("parameters"))
    return F.struct(F.lit("function").alias("type"), function.alias("function"))


# ---- chat forms --------------------------------------------------------------------------------------------------


def from_simple_form(text: Column, tidy) -> Column:  # noqa: ANN001
    """Paragraphs of ROLE and text as chat markup; `tidy` cleans each text. Only what stands before the next blank line belongs to a paragraph, and other roles are dropped."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: (F.length(trimmed(p)) > 0) & p.contains("\n"))
    cut = F.transform(parts, lambda p: F.struct(trimmed(F.substring_index(p, "\n", 1)).alias("role"), tidy(trimmed(F.substring(p, F.instr(p, "\n") + 1, F.length(p)))).alias("text")))
    known = F.filter(cut, lambda x: x["role"].isin("USER", "ASSISTANT"))
    return F.concat(F.array_join(F.transform(known, lambda x: F.concat(F.lit("<|im_start|>"), F.lower(x["role"]), F.lit("\n"), x["text"], F.lit("<|im_end|>"))), "\n"), F.lit("\n"))


def eval_prompt(messages: Column, last_query: Column, system: Column | None = None) -> Column:
    """Messages (role, content, calls as text or null) as an evaluation prompt that ends with the assistant's turn.

    Thoughts of assistant messages are kept only after the last query, and always at the very end; runs of tool
    messages share one user turn."""
    content = lambda m: F.coalesce(m["content"], F.lit(""))

    def assistant(m: Column, i: Column) -> Column:
        thought = parsed_response(content(m))["reasoning"]
        said = parsed_response(content(m))["answer"]
        thinks = (i > last_query) & ((i == F.size(messages) - 1) | (thought != ""))
        body = F.when(thinks, F.concat(F.lit("<think>\n"), F.regexp_replace(thought, r"\A\n+|\n+\z", ""), F.lit("\n</think>\n\n"), F.regexp_replace(said, r"\A\n+", ""))).otherwise(said)
        calls = F.coalesce(m["calls"], F.lit(""))
        return F.concat(F.lit("<|im_start|>assistant\n"), body, F.when((said != "") & (calls != ""), "\n").otherwise(""), calls, F.lit("<|im_end|>\n"))

    def tool(m: Column, i: Column) -> Column:
        before, after = F.get(messages, i - 1)["role"], F.get(messages, i + 1)["role"]
        opened = F.when((i == 0) | (F.coalesce(before, F.lit("")) != "tool"), "<|im_start|>user").otherwise("")
        closed = F.when(F.coalesce(after, F.lit("")) != "tool", "<|im_end|>\n").otherwise("")
        return F.concat(opened, F.lit("\n<tool_response>\n"), content(m), F.lit("\n</tool_response>"), closed)

    def line(m: Column, i: Column) -> Column:
        plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), content(m), F.lit("<|im_end|>\n"))
        return F.when((m["role"] == "user") | ((m["role"] == "system") & ((i > 0) | F.lit(system is None))), plain).when(m["role"] == "assistant", assistant(m, i)).when(m["role"] == "tool", tool(m, i)).otherwise("")

    head = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n")) if system is not None else F.lit("")
    return F.concat(head, F.array_join(F.transform(messages, line), ""), F.lit("<|im_start|>assistant\n"))


def placeholder_parts(text: Column) -> Column:
    """A text cut at <image> and <video>: type and text of each part that is not empty."""
    marked = F.regexp_replace(text, r"(<image>|<video>)", "\x00$1\x00")
    parts = F.filter(F.split(marked, "\x00"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def passages_text(passages: Column) -> Column:
    """Passages whose first line is the title, as numbered paragraphs."""
    title = lambda p: F.substring_index(p, "\n", 1)
    rest = lambda p: F.when(p.contains("\n"), F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise(F.lit(""))
    return trimmed(F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title(p), F.lit(")\n"), rest(p), F.lit("\n\n"))), ""))


# ---- judges and generators ---------------------------------------------------------------------------------------


def render(template: str, **values: Column) -> Column:
    """A prompt template with {name} for each value; nulls become empty texts. Other braces stay as they are."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


#: Prompts of judges and of the generator of new samples; callers may give their own.
COMPARE = "Judge two answers to one conversation on {date}. Tools:\n<tools>\n{tools}\n</tools>\n\n{conversation}\n\nResponse 1\n{output}\n\nResponse 2\n{response}\n\nReply with RESPONSE1_INCORRECT, RESPONSE2_INCORRECT, BOTH_CORRECT or BOTH_INCORRECT, then 'Error Analysis:' and the cause."
CHECK = "Judge the last calls of this conversation on {date}. Tools:\n<tools>\n{tools}\n</tools>\n\n{conversation}\n\n{output}\n\nReply with INCORRECT or CORRECT, then 'Error Analysis:' and the cause."
EXPAND = "Write a new sample for the same kind of error on {date}. Tools:\n<tools>\n{tools}\n</tools>\n\nInput:\n{input}\n\nCorrect:\n{correct}\n\nIncorrect:\n{incorrect}\n\nCause:\n{error}\n\nReply with INPUT: and OUTPUT:."


def sides(status: Column, output: Column, response: Column) -> tuple[Column, Column]:
    """The correct and the incorrect side of a verified row; other states than the three of wrong rows are an error."""
    wrong = F.raise_error(F.concat(F.lit("no side for status "), F.coalesce(status, F.lit("null")))).cast("string")
    right = F.when(status == "model_incorrect", output).when(status == "original_incorrect", response).when(status == "both_incorrect", "").otherwise(wrong)
    return right, F.when(status == "model_incorrect", response).when(status == "original_incorrect", output).when(status == "both_incorrect", response)


def generated_sample(text: Column) -> Column:
    """input and output of a generated text, trimmed; null for a part that is missing."""
    return F.struct(trimmed(extract_first(text, r"(?s)INPUT:\s*(.*?)(?=OUTPUT:|\z)")).alias("input"), trimmed(extract_first(text, r"(?s)OUTPUT:\s*(.*?)\z")).alias("output"))


def is_valid_sample(sample: Column) -> Column:
    """Both parts say something and the output holds a call block."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return filled(sample["input"]) & filled(sample["output"]) & F.coalesce(sample["output"].contains("<tool_call>"), F.lit(False))


def error_message(judged: Column, failed: Column, whole: bool = True) -> Column:
    """The judgement from "Error Analysis" on; without that the whole of it or (not `whole`) null; for failed judgements a note."""
    at = F.instr(judged, "Error Analysis")
    tail = F.when(at > 0, F.substring(judged, at, F.length(judged)))
    return F.when(failed, F.concat(F.lit("Unexpected judge result: "), judged)).otherwise(F.coalesce(tail, judged) if whole else tail)


def status_label(raw: Column) -> Column:
    """Status of a raw judgement; when both sides are named, the first response wins here."""
    return (
        F.when(raw.contains("RESPONSE1_INCORRECT"), "original_incorrect").when(raw.contains("RESPONSE2_INCORRECT"), "model_incorrect")
        .when(raw.contains("BOTH_CORRECT"), "both_correct").when(raw.contains("BOTH_INCORRECT"), "both_incorrect").otherwise("llm_judge_failed")
    )


def filter_status(output: Column, violations: Column, label: Column, consensus: Column) -> Column:
    """status and error_message of a label: no call, then broken rules (all messages joined), then what was judged, marked where the votes disagree."""
    call = F.startswith(trimmed(output), F.lit("<tool_call>"))
    broken = F.size(violations) > 0
    judged = F.when(label == "INCORRECT", "incorrect").when(label == "CORRECT", "correct").otherwise("llm_judge_failed")
    status = F.when(~call, "not_function_call").when(broken, "rule_violation").otherwise(F.concat(judged, F.when(consensus, "").otherwise("_no_consensus")))
    message = F.when(~call, "").when(broken, F.array_join(violations, "")).otherwise(F.when(judged == "llm_judge_failed", F.concat(F.lit("Unexpected judge result: "), label)).otherwise(F.lit("")))
    return F.struct(status.alias("status"), message.alias("error_message"))


# ---- outputs of roles --------------------------------------------------------------------------------------------


def user_output(text: Column) -> Column:
    """What a user says inside <continuation><user>; missing inner tags are added, and anything else gives null."""
    inner = trimmed(extract_first(trimmed(text), r"(?s)<continuation>(.*?)</continuation>"))
    said = F.regexp_replace(F.regexp_replace(inner, r"\A<user>", ""), r"</user>\z", "")
    return trimmed(F.get(F.split(F.get(F.split(said, "</user>"), F.lit(0)), "<user>"), F.lit(0)))


def tool_output(text: Column) -> Column:
    """The JSON list of responses that a tool gives, inside a fence or not; null if it is no list."""
    plain = trimmed(F.regexp_replace(trimmed(text), r"\A```json\s*|```\z", ""))
    return F.when(F.coalesce(F.startswith(F.schema_of_variant(strict_json(plain)), F.lit("ARRAY")), F.lit(False)), plain)


def assistant_output(text: Column) -> Column:
    """content and calls (name, arguments) of calls written as name|{json} in call tags; null where tags or arguments are broken.

    `broken` texts can be handed to a repair service and parsed again."""
    plain = trimmed(F.coalesce(text, F.lit("")))
    items = F.transform(bodies(plain, False), lambda b: F.struct(F.substring_index(b, "|", 1).alias("name"), F.when(b.contains("|"), F.substring(b, F.instr(b, "|") + 1, F.length(b))).alias("arguments")))
    tagged = plain.contains("<tool_call>") | plain.contains("</tool_call>")
    fine = plain.contains("<tool_call>") & plain.contains("</tool_call>") & F.forall(items, lambda c: strict_json(c["arguments"]).isNotNull())
    none = F.array().cast(CALLS)
    return F.when(~tagged, F.struct(plain.alias("content"), none.alias("calls"))).when(fine, F.struct(trimmed(F.get(F.split(plain, "<tool_call>"), F.lit(0))).alias("content"), items.cast(CALLS).alias("calls")))


def is_text_only(response: Column) -> Column:
    """A tool response (text, image, video) that holds a text and nothing else."""
    return F.coalesce(F.length(response["text"]) > 0, F.lit(False)) & F.coalesce(F.size(response["image"]) <= 0, F.lit(True)) & F.coalesce(F.size(response["video"]) <= 0, F.lit(True))


def is_empty_response(response: Column) -> Column:
    return ~F.coalesce(F.length(response["text"]) > 0, F.lit(False)) & F.coalesce(F.size(response["image"]) <= 0, F.lit(True)) & F.coalesce(F.size(response["video"]) <= 0, F.lit(True))
