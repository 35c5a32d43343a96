"""Byte-level BPE ids of a whole corpus by Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern (JVM regular expression). A word that is a token is one
lookup in a literal table. Any other word becomes its bytes (one character a byte, ISO-8859-1), is cut where no
token holds the two bytes beside the cut, so that no merge can cross it, and each piece that is no token is
folded: again and again the adjacent pair of lowest rank, leftmost first, is merged. Decoding joins the tokens'
bytes.

The literal tables are hash tables: an array of buckets by CRC-32, each a map of about one entry. Besides the
vocabulary they hold the ids of at most `cache` frequent words and pieces of the corpus, folded once by the
same functions. This cache only saves work: words that are not in it are folded where they stand, with the
same result, so its words come from a bounded sample (`cache_rows` rows). Nothing is shuffled but the
distinct words of that sample, and every task needs the same fixed memory at any corpus size.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable, Mapping
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The words of the vocabulary, as a Java pattern; (?U) makes \s and \S follow Unicode.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1 << 16
IDS = "array<int>"


@lru_cache(maxsize=4)
def read_ranks(path: str = VOCABULARY) -> Mapping[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bytes(text: Column) -> Column:
    """A string with one character for each byte of the text's UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _literal_tables(*tables: Mapping[str, list[int]]) -> Column:
    """One literal for all tables, each an array of buckets; an entry's bucket is the CRC-32 of its key, modulo BUCKETS."""
    out = []
    for entries in tables:
        buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
        for key, ids in entries.items():
            buckets[zlib.crc32(key.encode()) % BUCKETS][key] = ids
        out.append(buckets)
    return F.from_json(F.lit(json.dumps(out)), f"array<array<map<string,{IDS}>>>")


def _find(table: Column, key: Column) -> Column:
    return F.element_at(F.get(table, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is bound to a variable, so that it stands in the plan, and is computed, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cuts(ranks: Mapping[bytes, int]) -> str:
    """A pattern for the places inside a byte string where no token can lie across: before a byte that starts a
    wide character, if no token of the vocabulary holds the bytes on both sides next to each other."""
    inside = {token[i : i + 2] for token in ranks for i in range(len(token) - 1)}
    parts = []
    for lead in (*range(0xE3, 0xEA), 0xEF):
        free = "".join(f"\\x{b:02X}" for b in range(0x80, 0xC0) if bytes([b, lead]) not in inside)
        if free:
            parts.append(f"(?<=[{free}])(?=\\x{lead:02X})")
    return "|".join(parts) or r"\z(?!\z)"


#: Stands at a cut; no byte's character.
MARK = "\u0100"


def _pieces(word: Column, cut: str) -> Column:
    """A byte string at its cuts. The marks are set first: a replacement keeps its compiled pattern, a split does not."""
    return F.split(F.regexp_replace(word, cut, MARK), MARK)


def _fold(piece: Column, table: Column) -> Column:
    """The tokens of a byte string that is no token itself, by ranked merges."""
    rank = lambda left, right: F.get(_find(table, F.concat(left, right)), F.lit(0))
    start = lambda single: F.struct(single.alias("parts"), F.transform(single, lambda c, i: rank(c, F.get(single, i + 1))).alias("ranks"))

    def merged_at(state: Column, at: Column) -> Column:
        parts, ranks = state["parts"], state["ranks"]
        part = lambda k: F.get(parts, at + (k - 1))
        none = F.array().cast(IDS)

        def with_joined(joined: Column) -> Column:
            new = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, F.size(parts)))
            before = F.when(at > 1, F.concat(F.slice(ranks, F.lit(1), at - 2), F.array(rank(part(-1), joined)))).otherwise(none)
            return F.struct(new.alias("parts"), F.concat(before, F.array(rank(joined, part(2))), F.slice(ranks, at + 2, F.size(ranks))).alias("ranks"))

        return _with(F.concat(part(0), part(1)), with_joined)

    def merge(state: Column, _: Column) -> Column:
        at = F.array_position(state["ranks"], F.array_min(state["ranks"])).cast("int")
        return _with(at, lambda at: F.when(at.isNull() | (at < 1), state).otherwise(merged_at(state, at)))

    def folded(single: Column) -> Column:
        end = F.aggregate(F.slice(single, 2, F.size(single)), start(single), merge)  # a step for each pair, at most
        return F.transform(end["parts"], lambda p: F.get(_find(table, p), F.lit(0)))

    return _with(F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.substring(piece, i, F.lit(1))), folded)


#: The fold of a word of this many characters would be long: its text takes the heap instead.
LONG_WORD = 200
_WORDS_PY = regex.compile(WORDS.removeprefix("(?U)"))


def merged(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same merges for a word of any length, with a heap of adjacent pairs: lowest rank first, then leftmost."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:  # one side has been merged since
            continue
        part[i] += part[j]
        part[j] = None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p is not None]


def _valid_words(ranks: Mapping[bytes, int]) -> dict[str, list[int]]:
    out = {}
    for token, i in ranks.items():
        try:
            out[token.decode()] = [i]
        except UnicodeDecodeError:
            pass
    return out


def encoded(df: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY, cache: int = 32768, cache_rows: int = 4096) -> DataFrame:
    """`df` with the token ids of the text (array<int>), without special tokens; strings that spell special tokens are ordinary text.

    Null and empty texts have no ids: an empty array. Texts of any length are encoded whole. Other columns pass unchanged;
    a column named as `into` is replaced. Texts with a word of LONG_WORD characters are merged with a heap in Python, with the
    same result: the fold's work grows as the square of a word's length."""
    ranks = read_ranks(vocabulary)
    cut = cuts(ranks)
    words = _valid_words(ranks)
    pieces = {token.decode("latin-1"): [i] for token, i in ranks.items()}
    folded: dict[str, list[int]] = {}
    if cache:
        sample = df.select(F.col(text).alias("t")).where("t IS NOT NULL").limit(cache_rows)
        counted = sample.select(F.explode(F.regexp_extract_all("t", F.lit(WORDS), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        frequent = [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(cache).collect()]  # at most `cache` words
        cut_words = {w: re.split(cut, w.encode().decode("latin-1")) for w in frequent if w not in words}
        odd = sorted({p for ps in cut_words.values() for p in ps if p not in pieces})
        if odd:
            ids = _with(_literal_tables(pieces), lambda t: _fold(F.col("p"), F.get(t, F.lit(0))))
            folded = {r["p"]: list(r["ids"]) for r in df.sparkSession.createDataFrame([(p,) for p in odd], "p string").select("p", ids.alias("ids")).collect()}
        words |= {w: [i for p in ps for i in (pieces.get(p) or folded[p])] for w, ps in cut_words.items()}

    def all_ids(tables: Column) -> Column:
        known, token, more = (F.get(tables, F.lit(k)) for k in range(3))
        piece = lambda p: F.coalesce(_find(token, p), _find(more, p), _fold(p, token))
        fold = lambda w: F.when(F.length(w) < LONG_WORD, F.flatten(F.transform(_pieces(_bytes(w), cut), piece)))
        word = lambda w: F.coalesce(_find(known, w), fold(w))
        return F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), word))  # null if any word has no ids

    @F.pandas_udf(IDS)
    def long_ids(texts: pd.Series) -> pd.Series:
        ranks = read_ranks(vocabulary)
        return texts.map(lambda t: [i for w in _WORDS_PY.findall(t) for i in merged(w.encode(), ranks)], na_action="ignore")

    some = F.coalesce(F.length(text) > 0, F.lit(False))
    both = df.withColumn("_ids", _with(_literal_tables(words, pieces, folded), all_ids))  # null for texts with a long word
    both = both.withColumn("_long_ids", long_ids(F.when(some & F.col("_ids").isNull(), F.col(text))))
    return both.withColumn(into, F.when(some, F.coalesce("_ids", "_long_ids")).otherwise(F.array().cast(IDS))).drop("_ids", "_long_ids")


def decoded(df: DataFrame, ids: str = "ids", into: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids give null, no ids the empty text, unknown ids are skipped."""
    ranks = read_ranks(vocabulary)
    tokens: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), "")
    return df.withColumn(into, F.try_validate_utf8(F.encode(joined, "ISO-8859-1").cast("string")))
