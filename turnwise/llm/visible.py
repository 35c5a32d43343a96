"""What counts as visible in a text, for Spark (Java) and Python alike."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks, line ends and characters without width: separators, controls, formats, variation selectors and fillers.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
INVISIBLE_PY = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m[1].zfill(8), INVISIBLE))


def has_visible(text: Column) -> Column:
    """True where something of the text is left without invisible characters; false for null."""
    return F.coalesce(F.length(F.regexp_replace(text, INVISIBLE, "")) > 0, F.lit(False))


def is_filled(message: Column) -> Column:
    """A message with visible content, or with a non-empty tool_usage or tool_response; false for a null message."""
    some = lambda name: F.coalesce(F.size(message[name]) > 0, F.lit(False))
    return has_visible(message["content"]) | some("tool_usage") | some("tool_response")
