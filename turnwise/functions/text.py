"""Text scalars: reasoning splits, markup, clean-up, dates and answers."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of symbols that are deleted. The last one holds all CJK characters, kana and hangul.
SYMBOLS = regex.compile(r"[\U0001F600-\U0001F64F]|[\U0001F300-\U0001F5FF]|[\U0001F680-\U0001F6FF]|[\U0001F1E0-\U0001F1FF]|[\U00002702-\U000027B0]|[\U000024C2-\U0001F251]")
#: Punctuation and its plain form, for what the compatibility form leaves as it is.
PUNCTUATION = {
    "‚": "'", "„": '"', "‹": "<", "›": ">", "«": '"', "»": '"', "’": "'",
    "—": "-", "–": "-", "−": "-", "‒": "-", "―": "-",
    "•": "*", "‧": ".", "·": ".", "※": "*", "§": "S", "¶": "P", "†": "+", "‡": "+",
    "°": "deg", "′": "'", "¿": "?", "¡": "!",
    "€": "EUR", "£": "GBP", "¥": "JPY", "¢": "c",
    "×": "x", "÷": "/", "±": "+/-", "∞": "inf", "≤": "<=", "≥": ">=", "≈": "~",
    "→": "->", "←": "<-", "↑": "^", "↓": "v", "⇒": "=>", "⇐": "<=", "⇔": "<=>",
    "。": ".",
}
#: Quotes that only the second form makes plain.
CURLY = {"‘": "'", "”": '"', "“": '"'}
#: Fixed value: both forms also shorten this text.
SHORTENED = (": \"'\", ", "'")
_BOTH, _FIRST = str.maketrans(PUNCTUATION | CURLY), str.maketrans(PUNCTUATION)


def plain_text(text: str, drop_symbols: bool = True) -> str:
    """Decomposed compatibility form with plain punctuation and blanks and without control characters but line ends and tabs.

    With `drop_symbols` (the first form) also without emoji and all characters from U+24C2 to U+1F251, and with curly
    quotes kept but for U+2019; without it (the second form) curly quotes become plain. Letters stay decomposed."""
    t = unicodedata.normalize("NFKD", text).replace(*SHORTENED).translate(_FIRST if drop_symbols else _BOTH)
    kinds = [unicodedata.category(c) for c in t]
    t = "".join(" " if k == "Zs" else c for c, k in zip(t, kinds) if k[0] != "C" or c in "\n\t\r")
    return (SYMBOLS.sub("", t) if drop_symbols else t).strip()


def plain_leaves(value: object) -> object:
    """A JSON value with every text leaf in the second plain form; keys stay as they are."""
    if isinstance(value, dict):
        return {k: plain_leaves(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_leaves(v) for v in value]
    return plain_text(value, False) if isinstance(value, str) and value else value


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalized_keeping_symbols(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: plain_text(t, False), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalized_all(lists: pd.Series) -> pd.Series:
    """The first plain form of each text of a list."""
    return lists.map(lambda xs: [None if x is None else plain_text(x) for x in xs], na_action="ignore")


@F.pandas_udf(T.StringType())
def normalized_json(texts: pd.Series) -> pd.Series:
    """JSON texts with all their text leaves in plain form; null where a text is no JSON."""

    def one(t: str) -> str | None:
        try:
            return json.dumps(plain_leaves(json.loads(t)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def thought(text: Column) -> Column:
    """What stands between the first <think> and </think>; null without both."""
    t = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    return F.when(text.contains("<think>") & text.contains("</think>"), t)


def after_thought(text: Column) -> Column:
    """What stands after the last </think>, without line ends around it; the whole text without one."""
    return F.when(text.contains("</think>"), F.regexp_replace(F.element_at(F.split(text, "</think>"), -1), r"\A\n+|\n+\z", "")).otherwise(text)


def after_cot(text: Column) -> Column:
    return F.when(text.contains("<cot>") & text.contains("</cot>"), F.trim(F.element_at(F.split(text, "</cot>"), -1))).otherwise(text)


def chat_markup(messages: Column) -> Column:
    """Messages (role, content) as chat markup."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>"))), "\n")


def simple_form(markup: Column) -> Column:
    """Chat markup of users and assistants as paragraphs of ROLE and trimmed text."""
    roles = F.regexp_extract_all(markup, F.lit(r"(?s)<\|im_start\|>(user|assistant)\n(.*?)<\|im_end\|>"), F.lit(1))
    texts = F.regexp_extract_all(markup, F.lit(r"(?s)<\|im_start\|>(user|assistant)\n(.*?)<\|im_end\|>"), F.lit(2))
    return F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat(F.upper(r), F.lit("\n"), trimmed(t))), "\n\n")


def trimmed(text: Column) -> Column:
    """Without blanks and line ends of any kind around it."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def without_chat_tokens(text: Column) -> Column:
    """Without one leading user token and one trailing end token."""
    return F.regexp_replace(F.regexp_replace(text, r"\A<\|im_start\|>user\n", ""), r"<\|im_end\|>\n\z", "")


def tidy_tags(text: Column) -> Column:
    """No blank lines or blanks next to the inner edges and after the ends of call and response tags, and no blanks at line ends."""
    for tag in ("tool_call", "tool_response"):
        text = F.regexp_replace(text, rf"(?U)<{tag}>\s*\n", f"<{tag}>\n")
        text = F.regexp_replace(text, rf"(?U)\n\s*</{tag}>", f"\n</{tag}>")
        text = F.regexp_replace(text, rf"(?U)</{tag}>\s*\n", f"</{tag}>\n")
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")


def answer_words(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, single blanks."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def exact_match(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: answer_words(g) == answer_words(answer))


def contains_match(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(answer_words(answer), answer_words(g)))


def last_answer(text: Column) -> Column:
    """The last <answer> of a text, trimmed; null without one."""
    return trimmed(F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))), F.lit(0)))


def final_number(text: Column, strict: bool = True) -> Column:
    """The last `#### n` of the last 300 characters without commas, or (not strict) the last run of digits, commas and points that isn't a point alone; null without one."""
    tail = F.substring(text, -300, 300)
    found = F.regexp_extract_all(tail, F.lit(r"#### (\-?[0-9\.\,]+)" if strict else r"(\-?[0-9\.\,]+)"), F.lit(1))
    if strict:
        return F.regexp_replace(F.get(F.reverse(found), F.lit(0)), ",", "")
    return F.get(F.reverse(F.filter(found, lambda x: ~x.isin("", "."))), F.lit(0))


#: Phrases that name the day, by the place that reads them, each in its order.
DAY_NAMED = {
    "expand": (r"The current time is (\d{4}-\d{2}-\d{2})", r"Today is (\d{4}-\d{2}-\d{2})", r"Today is (\d{2}/\d{2}/\d{4})", r"Today is (\d{2}-\d{2}-\d{4})"),
    "verify": (r"The current time is (\d{4}-\d{2}-\d{2})",),
    "filter": (r"Today is (\d{4}-\d{2}-\d{2})", r"Today is (\d{2}/\d{2}/\d{4})", r"Today is (\d{2}-\d{2}-\d{4})"),
}
#: What stands for a day that is not named.
NO_DAY = {"expand": "2024-04-14", "verify": "Unknown", "filter": None}


def date_in(text: Column, reader: str = "expand") -> Column:
    """The date that the first phrase found names, else what the reader takes by default."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DAY_NAMED[reader]]
    return F.coalesce(*found, F.lit(NO_DAY[reader]))
