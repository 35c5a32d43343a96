"""Graders of mathematical solutions: final-answer lines, boxed answers, and equality of expressions.

Expressions are compared by a small evaluator of arithmetic that knows numbers, letters, roots and pi: two forms are
equal if their values agree at several fixed points for the letters. No text is ever run as code."""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.answers import last_boxed, plain_math

# ---- arithmetic --------------------------------------------------------------------------------------------------

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_POINTS = ((0.731, 1.37, 2.113), (1.219, 0.457, 3.331), (2.903, 1.861, 0.619))


def _value(node: ast.AST, env: Mapping[str, float]) -> float:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return float(node.value)
    if isinstance(node, ast.Name):
        return env[node.id]
    if isinstance(node, ast.UnaryOp):
        return _OPS[type(node.op)](_value(node.operand, env))
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left, env), _value(node.right, env)
        if isinstance(node.op, ast.Pow) and abs(b) > 512:
            raise ValueError("exponent")
        out = _OPS[type(node.op)](a, b)
        if isinstance(out, complex):
            raise ValueError("complex")
        return out
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "sqrt" and len(node.args) == 1:
        return math.sqrt(_value(node.args[0], env))
    raise ValueError("not arithmetic")


def arithmetic(text: str) -> ast.AST:
    """The tree of an expression in plain or LaTeX spelling; ValueError if it is none."""
    t = text
    for _ in range(8):
        t, before = re.sub(r"\\?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", re.sub(r"\\?sqrt\{([^{}]*)\}", r"sqrt(\1)", t)), t
        if t == before:
            break
    t = t.replace("\\cdot", "*").replace("\\times", "*").replace("\\pi", "pi").replace("^", "**").replace("{", "(").replace("}", ")")
    t = re.sub(r"(?<=[0-9)])\s*(?=[A-Za-z(])|(?<=\))\s*(?=[0-9])", "*", t)
    try:
        return ast.parse(t.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ValueError("not arithmetic") from e


def same_value(a: str, b: str, tolerance: float = 1e-9) -> bool:
    """Whether two expressions have equal values wherever their letters are put."""
    try:
        x, y = arithmetic(a), arithmetic(b)
        letters = sorted({n.id for tree in (x, y) for n in ast.walk(tree) if isinstance(n, ast.Name)} - {"pi", "sqrt"})
        if len(letters) > 3:
            return False
        for point in _POINTS if letters else _POINTS[:1]:
            env = {"pi": math.pi, "inf": math.inf} | dict(zip(letters, point))
            if not math.isclose(_value(x, env), _value(y, env), rel_tol=tolerance, abs_tol=tolerance):
                return False
        return True
    except (ValueError, KeyError, ArithmeticError, RecursionError, TypeError):
        return False


# ---- final-answer lines ------------------------------------------------------------------------------------------

#: Replacements and removals in a final answer, in this order.
REPLACED = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def final_form(answer: str) -> str:
    """A final answer after its last equals sign, without units, markup and thousands marks, with braces after roots and fractions."""
    t = answer.rpartition("=")[2]
    for old, new in (*REPLACED, *((x, "") for x in REMOVED)):
        t = t.replace(old, new)
    t = re.sub(r"(.*?)\$(.*?)\$(.*)", r"$\2$", t)
    t = re.sub(r"\\(?:text|textbf|overline)\{(.*?)\}", r"\1", t)
    t = re.sub(r"\\boxed\{(.*)\}", r"\1", t)
    t = re.sub(r"sqrt([^{])", r"sqrt{\1}", re.sub(r"frac([^{])(.)", r"frac{\1}{\2}", t)).replace("$", "")
    return (t.replace(",", "") if t.replace(",", "").isdigit() else t).strip()


def named_answer(solution: str) -> str:
    """The final form of the last line that begins an answer, or of a mark for none."""
    found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", solution)
    return final_form(found[-1] if found else "[INVALID]")


def final_score(solution: str, gold: str, boxed: bool = False) -> tuple[float, bool, str | None]:
    """score (1 or -1), acc and pred: by the named answer of the last 300 characters, or (boxed) by the boxed one of the last 100 as it is."""
    tail = solution[-300:]
    if boxed:
        pred = last_boxed(tail[-100:].replace("\\boxed ", ""), ("\\boxed",))
        right = pred == gold
    else:
        pred = named_answer(tail)
        right = pred == final_form(gold)
    return (1.0 if right else -1.0), right, pred


# ---- located answers ---------------------------------------------------------------------------------------------

#: Marks before and after an answer, and words that lead to it.
MARKS_BEFORE, MARKS_AFTER = ("answer:", "answer is", "answers are"), ("is answer", "is the answer", "are answers", "are the answers")
LEADS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def located_answer(text: str) -> tuple[bool, str]:
    """Whether an answer with a digit was found, and its text: narrowed by marks, then to a boxed expression, the first sentences and what follows a leading word."""
    found = False

    def narrowed(marks: tuple[str, ...], after: bool) -> None:
        nonlocal text, found
        for mark in marks:
            at = text.lower().rfind(mark)
            if at >= 0:
                found, text = True, (text[at + len(mark) :] if after else text[:at]).strip()

    narrowed(MARKS_BEFORE, True)
    narrowed(MARKS_AFTER, False)
    if boxed := (last_boxed(text.replace("\\boxed ", "\\boxed")) or "").strip():
        found, text = True, boxed
    if ". " in text:
        text = text[: text.rfind(". ")].strip()
    narrowed(LEADS, True)
    return found and any(c.isdigit() for c in text), text


#: Units that are dropped, and words for large factors.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
FACTORS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
SEPARATORS = ((" or ", " , "), (" and ", " , "))


def without_commas(text: str) -> str:
    """Without the commas between groups of three digits."""
    while (shorter := re.sub(r"(\d),(\d\d\d)(?!\d)", r"\1\2", text)) != text:
        text = shorter
    return text


def as_integer(text: str) -> int | None:
    try:
        x = float(without_commas(text))
        return round(x) if abs(x - round(x)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


def graded_form(text: str) -> str:
    """An answer without units, percent and dollar signs, large factors as powers of ten, mixed numbers as sums, in lower case; whole numbers as such."""
    t = m[1] if (m := re.search(r"^\\text\{(.+?)\}$", text)) else text
    for old, new in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), *SEPARATORS, *FACTORS):
        t = t.replace(old, new)
    for unit in UNITS:
        t = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", t)
    t = re.sub(r"\^ *\\circ", "", t)
    t = t[1:-1] if t.startswith("{") and t.endswith("}") else t
    t = re.sub(r",\\! *", "", t)
    if "\\" in t:
        for old, new in (("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac"), ("\\pi", "pi"), ("\\cdot", "*"), ("\\times", "*")):
            t = t.replace(old, new)
        for _ in range(8):
            t, before = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", t)), t
            if t == before:
                break
        t = re.sub(r"\((-?\d+)\)/\((\d+)\)", r"\1/\2", t).strip()
    t = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub(r"- *", "-", t)).lower()
    return t if (n := as_integer(t)) is None else str(n)


def elements(text: str) -> list[str]:
    """The elements of a tuple or interval; of anything else the text itself."""
    t = without_commas(text)
    if len(t) > 2 and t[0] in "([" and t[-1] in ")]" and not re.search(r"[()\[\]]", t[1:-1]):
        return [x.strip() for x in t[1:-1].split(",")]
    return [t] if t else []


def same_answer(given: str | None, gold: str) -> bool:
    """Equal plain or graded forms, or tuples of the same brackets whose elements have equal values; unreduced fractions and whole numbers must be equal as written."""
    if given is None:
        return False

    def textual(t: str) -> str:
        t = t.strip()
        t = m[1].strip() if (m := re.search(r"^\\text\{(.+?)\}$", t)) else t
        try:
            return plain_math(t)
        except ValueError:
            return t

    if textual(gold) == textual(given):
        return True
    a, b = graded_form(gold), graded_form(given)
    if a == b:
        return True
    xs, ys = elements(a), elements(b)
    if not b or len(xs) != len(ys) or (len(xs) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False
    fraction = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")

    def same(x: str, y: str) -> bool:
        if fraction.search(x) and fraction.search(y):
            return x == y
        if (as_integer(x) is None) != (as_integer(y) is None):
            return False
        return same_value(x, y)

    return all(map(same, xs, ys))


#: Names of intervals and their brackets.
INTERVALS = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()"}


def bracketed(text: str) -> str:
    """A named interval in brackets; anything else as it is."""
    if (m := re.match(r"^(Interval(?:\.(?:Ropen|Lopen|open))?)\((.*)\)$", text)) and m[1] in INTERVALS:
        return INTERVALS[m[1]][0] + m[2] + INTERVALS[m[1]][1]
    return text


def as_number(text: str) -> float | None:
    """A number with thousands commas of either spelling; null for anything else."""
    try:
        return float(text.replace("{,}", "") if "{,}" in text else text.replace(",", ""))
    except ValueError:
        return None


def _plain_number(text: str, pi: float) -> str:
    if re.match(r"\$\d+(\.\d+)?", text):
        return text[1:]
    if re.match(r"^\d+(\.\d+)?\\?%$", text):
        return re.sub(r"\\?%", "", text)
    if "_" in text:
        text = str(int(float(text.split("_")[0])))
    if "\\pi" in text:
        text = re.sub(r"\\pi", f"*{pi}", re.sub(r"(?<!\d)\\pi", f"1*{pi}", text))
        try:
            text = repr(_value(arithmetic(text), {}))
        except (ValueError, KeyError, ArithmeticError):
            pass
    return text


def close_answer(given: str, gold: str, percent: bool = True, tolerance: float = 1e-4, pi: float = math.pi) -> bool:
    """Equal as text, as numbers (also a hundredth or a hundred times, if `percent`), element by element, or in value."""
    try:
        a, b = _plain_number(given, pi), _plain_number(gold, pi)
    except (ValueError, OverflowError):
        return False
    if a.strip().lower() == b.strip().lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = as_number(a), as_number(b)
    if x is not None and y is not None:
        return any(math.isclose(t, x, rel_tol=tolerance) for t in ((y / 100, y, y * 100) if percent else (y,)))
    if not a:
        return False
    a, b = bracketed(a.strip()), b.strip()
    bare = lambda t: re.sub(r"[{}()\[\]]", "", t) if a[:1] in "([" and a[-1:] in ")]" else re.sub(r"[{}()]", "", t)
    if bare(a) == bare(b):
        return True
    if "," in a and "," in b:
        inner = lambda t: t[1:-1] if t[0] in "([" and t[-1] in ")]" else t
        xs, ys = ([p.strip() for p in (inner(t) if (a[0], a[-1]) == (b[0], b[-1]) else t).split(",")] for t in (a, b))
        if len(xs) == len(ys):
            return all(close_answer(p, q, percent, tolerance) for p, q in zip(xs, ys))
    return same_value(a, b, tolerance)


def located_score(solution: str, gold: str) -> tuple[bool, bool, str]:
    """correct, well formed, answer: the located answer graded by form, or else by value (pi exact or as 3.14)."""
    _, answer = located_answer(solution)
    if same_answer(answer, gold):
        return True, True, answer
    values = (math.pi, 3.14) if "\\pi" in answer or "\\pi" in gold else (math.pi,)
    return any(close_answer(answer, gold, pi=p) for p in values), "Step 2:" in solution and "\\box" in solution, answer


def figure_score(solution: str, gold: str, share: float = 0.1, boxed: bool = True) -> float:
    """The answer's correctness and, with the given share, that a thought comes before a boxed answer."""
    well = re.fullmatch(r"(?s)<think>.*</think>.*\\boxed\{.*\}.*", solution) is not None
    answer = last_boxed(solution, ("\\boxed",)) if boxed else solution
    return (1 - share) * float(same_answer(answer, gold)) + share * float(well)


# ---- columns -----------------------------------------------------------------------------------------------------

_FINAL = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("acc", T.BooleanType()), T.StructField("pred", T.StringType())])
_LOCATED = T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("well_formed", T.BooleanType()), T.StructField("answer", T.StringType())])


def _rows(f, schema: T.StructType, a: pd.Series, b: pd.Series) -> pd.DataFrame:  # noqa: ANN001
    none = (None,) * len(schema.names)
    return pd.DataFrame([none if x is None or y is None else f(x, y) for x, y in zip(a, b)], columns=schema.names).astype(object)


@F.pandas_udf(_FINAL)
def final_scores(solutions: pd.Series, golds: pd.Series) -> pd.DataFrame:
    return _rows(final_score, _FINAL, solutions, golds)


@F.pandas_udf(_FINAL)
def strict_scores(solutions: pd.Series, golds: pd.Series) -> pd.DataFrame:
    return _rows(lambda s, g: final_score(s, g, boxed=True), _FINAL, solutions, golds)


@F.pandas_udf(_LOCATED)
def located_scores(solutions: pd.Series, golds: pd.Series) -> pd.DataFrame:
    return _rows(located_score, _LOCATED, solutions, golds)


@F.pandas_udf(T.DoubleType())
def figure_scores(solutions: pd.Series, golds: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or g is None else figure_score(s, g) for s, g in zip(solutions, golds)], dtype="float64")
