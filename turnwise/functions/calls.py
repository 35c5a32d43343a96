"""Tool calls in texts: extraction, canonical form, equality, rule checks and rewards."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Call blocks on lines of their own, and anywhere.
BODY = r"(?s)<tool_call>\n(.*?)\n</tool_call>"
LOOSE_BODY = r"(?s)<tool_call>(.*?)</tool_call>"


def bodies(text: Column, strict: bool = True) -> Column:
    """The bodies of the call blocks of a text; strict ones stand on lines of their own."""
    return F.regexp_extract_all(text, F.lit(BODY if strict else LOOSE_BODY), F.lit(1))


def strict_json(text: Column) -> Column:
    """A JSON text as VARIANT; null where anything but blanks stands before or after the one value. The parser alone would stop after the first value."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))


def without_calls(text: Column) -> Column:
    return F.regexp_replace(text, LOOSE_BODY, "")


def canonical(value: Any) -> str:
    """One text for all values that count as equal: order and repetition never matter, 1, 1.0 and true are one, {} and [] are one."""
    if isinstance(value, dict):
        parts = sorted({f"{json.dumps(str(k))}:{canonical(v)}" for k, v in value.items()})
        return "{" + ",".join(parts) + "}" if parts else "[]"
    if isinstance(value, list):
        return "[" + ",".join(sorted({canonical(v) for v in value})) + "]"
    if isinstance(value, (bool, int)):
        return repr(int(value))
    if isinstance(value, float):
        return repr(int(value)) if value == value and abs(value) != float("inf") and value == int(value) else repr(value)
    return json.dumps(value)


def canonical_text(body: str | None) -> str | None:
    """Of a call body; text that is no JSON stands for itself."""
    if body is None:
        return None
    try:
        return canonical(json.loads(body))
    except (ValueError, RecursionError):
        return json.dumps(body)


@F.pandas_udf(T.StringType())
def canonical_call(body: pd.Series) -> pd.Series:
    return body.map(canonical_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_calls(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [canonical_text(x) for x in xs], na_action="ignore")


def same_calls(a: Column, b: Column) -> Column:
    """Lists of canonical calls are equal if they have one length and one set of calls."""
    return (F.size(a) == F.size(b)) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def exact_reward(label: Column, answer: Column, best: float = 1.0, worst: float = 0.0) -> Column:
    return F.when(same_calls(label, answer), F.lit(best)).otherwise(F.lit(worst))


def prefix_reward(label: Column, answer: Column, worst: float = 0.0) -> Column:
    """The worst reward and a share of 1 for each call that matches in place, up to the first that does not."""
    matched = F.aggregate(
        F.zip_with(label, answer, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, ok: F.struct((s["n"] + F.when(s["on"] & ok, 1).otherwise(0)).alias("n"), (s["on"] & ok).alias("on")),
    )["n"]
    return F.when(F.size(label) > 0, F.lit(worst) + matched / F.size(label)).otherwise(F.lit(worst))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared elements with multiplicity over all elements; equal lists give 1, an empty side 0."""
    keys = F.array_distinct(F.concat(a, b))
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    shared = F.aggregate(keys, F.lit(0), lambda n, k: n + F.least(times(a, k), times(b, k)))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def length_reward(text: Column, words: int = 512, best: float = 1.0, worst: float = 0.0) -> Column:
    """Words of the last thought over the wanted number, to two digits (half to even), at most one, between worst and best; worst without a thought."""
    last = F.get(F.split(F.element_at(F.split(text, "<think>"), -1), "</think>"), F.lit(0))
    n = F.size(F.filter(F.split(last, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    share = F.least(F.lit(1.0), F.bround(n / F.lit(words), 2))
    return F.when(text.contains("<think>") & text.contains("</think>"), share * (best - worst) + worst).otherwise(F.lit(worst))


#: What a response must look like, by what its label holds: (response, call).
TEMPLATES = {
    (True, False): r"(?s)\A<think>.*?</think>\n<response>.*?</response>\n?\z",
    (False, True): r"(?s)\A<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n?\z",
    (True, True): r"(?s)\A<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>\n?\z",
    (False, False): r"(?s)\A<think>.*?</think>\n?\z",
}


def format_reward(text: Column, label: Column, best: float = 1.0, worst: float = 0.0) -> Column:
    """Whether a response is a thought and then what its label holds: a response, a call block, both or neither, each at most once."""
    once = lambda tag: (F.regexp_count(text, F.lit(f"<{tag}>")) == 1) & (F.regexp_count(text, F.lit(f"</{tag}>")) == 1)
    fits = F.lit(False)
    for (response, call), template in TEMPLATES.items():
        ok = text.rlike(template)
        for wanted, tag in ((response, "response"), (call, "tool_call")):
            ok = ok & once(tag) if wanted else ok
        fits = F.when((label.contains("<response>") == response) & (label.contains("<tool_call>") == call), ok).otherwise(fits)
    return F.when(fits, F.lit(best)).otherwise(F.lit(worst))


#: JSON types of Python values, by declared type; a boolean counts as an integer and a number.
JSON_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def type_fits(value: Any, declared: str | None) -> bool:
    """Whether a JSON value has the declared type; unknown types accept everything."""
    wanted = JSON_TYPES.get((declared or "").lower())
    return True if wanted is None else isinstance(value, wanted)


def fits_natively(value: Column, declared: Column) -> Column:
    """The same for a JSON value as VARIANT."""
    whole_kind = F.schema_of_variant(value)
    kind = F.regexp_extract(whole_kind, r"^[A-Z]+", 0)
    whole = kind.isin("BIGINT", "BOOLEAN") | whole_kind.rlike(r"^DECIMAL\(\d+,0\)$")
    number = whole | kind.isin("DOUBLE", "DECIMAL", "FLOAT")
    d = F.lower(F.coalesce(declared, F.lit("")))
    return (
        F.when(d == "string", kind == "STRING").when(d == "integer", whole).when(d == "number", number).when(d == "boolean", kind == "BOOLEAN")
        .when(d == "array", kind == "ARRAY").when(d == "object", kind == "OBJECT").otherwise(F.lit(True))
    )


def rule_checks(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """call_id, name, violation of each call (call_id, name, parameters as JSON text): none, or the first of unknown_tool, bad_parameters,
    missing_parameter, extra_parameter, wrong_type.

    The catalog is joined by name; its size is left to the planner. Types are looked at through VARIANT, without Python."""
    empty = F.array().cast("array<string>")
    known = catalog.select("name", F.col("parameters.required").alias("required"), F.col("parameters.properties").alias("properties"), F.lit(True).alias("known"))
    joined = calls.join(known.dropDuplicates(["name"]), "name", "left").withColumn("values", strict_json(F.col("parameters")).try_cast("map<string,variant>")).withColumn("given", F.map_keys("values"))
    missing = F.size(F.array_except(F.coalesce("required", empty), F.coalesce("given", empty))) > 0
    extra = F.size(F.array_except(F.coalesce("given", empty), F.coalesce(F.map_keys("properties"), empty))) > 0
    wrong = F.exists(F.map_entries("values"), lambda e: ~F.coalesce(fits_natively(e["value"], F.col("properties")[e["key"]]["type"]), F.lit(False)))
    step = F.when(F.col("known").isNull(), "unknown_tool").when(F.col("given").isNull(), "bad_parameters").when(missing, "missing_parameter").when(extra, "extra_parameter").when(F.coalesce(wrong, F.lit(False)), "wrong_type")
    return joined.select("call_id", "name", step.otherwise("none").alias("violation"))


def type_checks(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """call_id, parameter, declared, fits: each given parameter of known calls against the declared type, without Python."""
    declared = catalog.select("name", F.explode("parameters.properties").alias("parameter", "p")).select("name", "parameter", F.col("p.type").alias("declared"))
    values = strict_json(F.col("parameters")).try_cast("map<string,variant>")
    given = calls.where("parameters IS NOT NULL").select("call_id", "name", F.explode(values).alias("parameter", "value"))
    return given.join(declared, ["name", "parameter"]).select("call_id", "parameter", "declared", fits_natively(F.col("value"), F.col("declared")).alias("fits"))
