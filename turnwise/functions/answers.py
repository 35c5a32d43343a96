"""Mathematical answers: the boxed expression of a solution and equality of LaTeX forms. Nothing is ever evaluated as code."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced(text: str, at: int) -> str | None:
    """What stands inside the first brace from `at` on, up to the brace that closes it; null if none does."""
    start, depth = text.find("{", at), 0
    for m in re.finditer(r"[{}]", text[start:]) if start >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start + 1 : start + m.start()]
    return None


def last_boxed(text: str, frames: tuple[str, ...] = ("\\boxed", "\\fbox")) -> str | None:
    r"""What the last \boxed{...} holds, with balanced braces, or else \fbox{...}; null without one.

    The spelling with a blank instead of braces takes precedence and holds everything up to the next $."""
    if "\\boxed " in text and "\\boxed" in frames:
        return text[text.rfind("\\boxed ") + 7 :].partition("$")[0]
    at = next((k for k in (text.rfind(f) for f in frames) if k >= 0), -1)
    return balanced(text, at) if at >= 0 else None


#: Spellings that are dropped or replaced, in this order, before and after units are cut off.
BEFORE_UNITS = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
AFTER_UNITS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))


def plain_math(text: str) -> str:
    """Spacing, units, signs and common spellings of fractions and roots brought to one form."""
    for old, new in BEFORE_UNITS:
        text = text.replace(old, new)
    if text.count("\\text{ ") > 1:
        raise ValueError("more than one unit")
    text = text.partition("\\text{ ")[0]
    for old, new in AFTER_UNITS:
        text = text.replace(old, new)
    text = re.sub(r"\A\.", "0.", text)
    if text.count("=") == 1 and text.index("=") <= 2:
        text = text.partition("=")[2]
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    if not re.search(r"\\frac[^{]\Z", text):  # a fraction without a second part leaves all as they are
        text = re.sub(r"\\frac([^{])(?:(\{)|(.))", lambda m: f"\\frac{{{m[1]}}}" + (m[2] or f"{{{m[3]}}}"), text)
    text = "\\frac{1}{2}" if text == "0.5" else text
    return re.sub(r"\A(0|-?[1-9]\d*)/(0|-?[1-9]\d*)\Z", r"\\frac{\1}{\2}", text)


def same_math(a: str | None, b: str | None) -> bool:
    """Equal as plain forms, or as they are where one has none; two nulls are equal."""
    if a is None or b is None:
        return a is b
    try:
        return plain_math(a) == plain_math(b)
    except ValueError:
        return a == b


def boxed_score(solution: str, gold: str) -> float:
    r"""1 if the last \boxed answer equals the gold one, else 0; an \fbox counts as none."""
    answer = last_boxed(solution, ("\\boxed",))
    return float(answer is not None and same_math(answer, gold))


@F.pandas_udf(T.StringType())
def boxed_answer(texts: pd.Series) -> pd.Series:
    return texts.map(last_boxed, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def equal_answers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_math(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def boxed_scores(solutions: pd.Series, golds: pd.Series) -> pd.Series:
    """Of batches of solutions; 0 where a side is null."""
    return pd.Series([0.0 if s is None or g is None else boxed_score(s, g) for s, g in zip(solutions, golds)])


def call_syntax(text: str) -> list[dict]:
    """Calls written as `f(a=1), g.h(b=[2])`, in brackets or not, as [{name: arguments}]; anything that is not literal gives []."""
    t = text.strip()
    try:
        tree = ast.parse(t if t.startswith("[") else f"[{t}]", mode="eval").body
        out = []
        for node in tree.elts:
            name, parts = node.func, []
            while isinstance(name, ast.Attribute):
                parts.append(name.attr)
                name = name.value
            out.append({".".join([name.id, *reversed(parts)]): {k.arg: ast.literal_eval(k.value) for k in node.keywords}})
        return out
    except (SyntaxError, ValueError, AttributeError, RecursionError):
        return []
