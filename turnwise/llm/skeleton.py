"""One consistent form of texts that look the same: the confusables skeleton.

A text is decomposed, every character is replaced by its prototype from a look-alike table, and the result is
decomposed again; originals with equal skeletons look the same. Full-width and half-width forms, blanks of any
kind, ligatures and CJK radicals have the prototypes that the character database gives; letters of other scripts
that look like Latin ones are in LOOKALIKES. Characters without width have the empty prototype, except a joiner
between two pictographs, which changes what is seen. Case, accents and digits stay.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.visible import INVISIBLE_PY
from turnwise.plans.lineage import cut

#: Letters and marks that look alike, each followed by its prototype.
LOOKALIKES = {
    pair[0]: pair[1:]
    for pair in (
        # Cyrillic
        "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҮY ԚQ ԜW ԌG аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv үy ӏl "
        # Greek
        "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX νv οo ϳj ͿJ ϲc ϹC "
        # Armenian, and letters of the Latin extensions
        "օo հh սu ցg ոn ՏS ՕO ɡg ɩi ıi ȷj ɑa "
        # Cherokee
        "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
        # Coptic
        "ⲀA ⲂB ⲈE ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc "
        # Lisu
        "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ "
        # hyphens, quotes and other marks
        "‐- ‑- ‒- −- ﹣- ‘' ’' ʼ' ′' “\" ”\" ″\" ‚, ․. …... ⁄/ ∕/ ∶: ꞉: ǃ! ∗* ∣| ‹< ›>"
    ).split()
}
#: The character database's tags of compatibility forms that look the same.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
LINE_ENDS = frozenset("\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029")
UNSEEN_BLANKS = regex.compile(r" +\n")
PICTOGRAPH_JOINER = regex.compile(r"(?<=[\p{Extended_Pictographic}\p{Emoji_Modifier}\uFE0F])‍(?=\p{Extended_Pictographic})")
JOINER = "\U000F0001"


def _compatible(ch: str) -> str:
    """What the database says a form stands for, where both look the same."""
    d = unicodedata.decomposition(ch)
    ligature, radical = "ﬀ" <= ch <= "ﬆ", "⺀" <= ch <= "⿕"
    if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and (ligature or radical or unicodedata.category(ch) == "Zs")):
        return "".join(chr(int(x, 16)) for x in d.split()[1:])
    return ch


class _Prototypes(dict):
    """Prototype of each code point, found when first asked for."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        if ch in LINE_ENDS:
            out = "\n"
        elif ch == JOINER:
            out = ch
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out = " "
        elif INVISIBLE_PY.fullmatch(ch):
            out = ""
        else:
            out = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", _compatible(ch)))
        self[point] = out
        return out


PROTOTYPES = _Prototypes()


def skeleton(text: str) -> str:
    """Blanks before a line end and at the end of the text are not seen either."""
    if not text.isascii():
        text = PICTOGRAPH_JOINER.sub(JOINER, unicodedata.normalize("NFD", text))
    elif text.isprintable():
        return text.rstrip()
    text = text.replace("\r\n", "\n").translate(PROTOTYPES)
    return UNSEEN_BLANKS.sub("\n", unicodedata.normalize("NFD", text)).rstrip()


def canonical(text: str) -> str:
    """The skeleton, composed and with its joiners: the one form in which equal-looking texts are equal strings."""
    return unicodedata.normalize("NFC", skeleton(text)).replace(JOINER, "‍")


def with_canonical(df: DataFrame, text: str = "text", into: str = "canonical") -> DataFrame:
    """`df` with the consistent form of the text; null stays null, blank texts become empty."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action="ignore")

    return df.withColumn(into, form(F.col(text)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s1, s2 (128 bits of the skeleton), t1, t2 (of the text) of every text with visible characters.

    Only the fixed-size digests come back from Python. Null, empty and blank texts look like nothing and have no row."""

    @F.pandas_udf("struct<s1:long,s2:long,seen:boolean>")
    def digest(s: pd.Series) -> pd.DataFrame:
        forms = [skeleton(t) for t in s]
        h = np.frombuffer(b"".join(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest() for f in forms), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"s1": h[:, 0], "s2": h[:, 1], "seen": [bool(f.strip()) for f in forms]})

    rows = df.where(F.length(text) > 0).select(F.col(key).alias("id"), digest(F.col(text)).alias("d"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    return rows.where("d.seen").select("id", "d.s1", "d.s2", "t1", "t2")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest key with that look), n_docs of the class and n_forms, the number of different strings, for each text with visible characters."""
    rows = cut(fingerprints(df, key, text))
    forms = rows.groupBy("s1", "s2", "t1", "t2").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    looks = forms.groupBy("s1", "s2").agg(F.min("low").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_forms"))
    return rows.join(looks.hint("merge"), ["s1", "s2"]).select(F.col("id").alias(key), "class_id", "n_docs", "n_forms")


def found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key_a, key_b, smaller first: all pairs of documents that look the same without being equal strings.

    Pairs are formed between the different strings of a look and then handed to their documents, so exact copies
    are never compared with each other and the work follows the result."""
    rows = cut(fingerprints(df, key, text))
    forms = rows.select("s1", "s2", "t1", "t2").distinct()
    several = forms.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2").hint("merge")
    rows = cut(rows.join(several, ["s1", "s2"], "left_semi"))  # those that look like another string
    form = rows.select("s1", "s2", "t1", "t2").distinct()
    other = form.select("s1", "s2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    links = form.join(other.hint("merge"), ["s1", "s2"]).where("struct(t1, t2) < struct(u1, u2)").drop("s1", "s2")
    a = rows.select("t1", "t2", F.col("id").alias("a"))
    b = rows.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("b"))
    return links.join(a.hint("merge"), ["t1", "t2"]).join(b.hint("merge"), ["u1", "u2"]).select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
