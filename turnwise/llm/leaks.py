"""Evaluation passages inside corpus documents: q-gram lemma filtering and banded alignment.

Both sides are reduced to letters and digits in one case and one encoding. A stretch of a passage with at most
`edits` edits and length L shares at least L - q + 1 - q * edits q-grams with its passage within a band of
2 * edits + 1 diagonals (document position minus passage position). Of a document every `stride`-th q-gram is
looked up among all q-grams of all passages, so at least that many, divided by the stride and rounded down, are
counted in one of two overlapping grids of bands. Bands that reach the bound are verified by alignment within the band.

The passages are a table of fixed size (their number is checked and they are taken in blocks of at most
`block` rows); their index is a plain array, the same for each task. Documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.skeleton import PROTOTYPES, skeleton

CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_UNSEEN, _MANY = 0xFFFFFFFF, 0xFFFFFFFE
_PLAIN = np.full(0x110000, _UNSEEN, dtype=np.uint32)  # of each code point: its plain letter or digit, 0 for none; filled when first seen


def plain(text: str) -> str:
    """Letters and digits only, in one case and encoding; accents go with the marks."""
    return "".join(c for c in unicodedata.normalize("NFD", skeleton(text).casefold()) if c.isalnum())


def plain_codes(text: str) -> np.ndarray:
    """The same as code points; by table for characters that become at most one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _PLAIN[codes]
    if (out == _UNSEEN).any():
        for point in np.unique(codes[out == _UNSEEN]).tolist():
            p = plain(chr(point))
            _PLAIN[point] = _MANY if len(p) > 1 else ord(p) if p else 0
        out = _PLAIN[codes]
    if (out == _MANY).any():
        long = "".join(plain(c) if v == _MANY else chr(v) if v else "" for c, v in zip(text, out.tolist()))
        return np.frombuffer(long.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out[out != 0]


@dataclass
class Passages:
    """Index of a block of passages."""

    ids: np.ndarray
    codes: np.ndarray  # all passages, one after the other
    start: np.ndarray  # where each begins, and the end
    word: np.ndarray  # for each code, the number of its word within all passages
    wide: np.ndarray  # for each passage, whether its letters are counted instead of its words
    least: np.ndarray  # for each passage, the letters of its shortest stretch that counts
    grams: np.ndarray  # sorted hashes
    places: np.ndarray  # and where each begins
    seen: np.ndarray  # which hash prefixes occur


def _hashes(codes: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def index(items: Iterable[tuple[int, str]], q: int, words: int, letters: int) -> Passages:
    ids, codes, numbers, wide, least, grams, places = [], [], [], [], [], [], []
    at = word = 0
    starts = [0]
    for i, text in items:
        form = skeleton(text or "").casefold()
        parts = [plain_codes(w) for w in form.split()]
        parts = [p for p in parts if len(p)]
        own = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ids.append(i)
        wide.append(len(CJK.findall(form)) * 2 > len(own))
        ends = np.cumsum([0, *map(len, parts)])
        least.append(letters if wide[-1] else int((ends[words:] - ends[:-words]).min()) if len(parts) >= words else len(own) + 1)
        codes.append(own)
        numbers.append(np.concatenate([np.full(len(p), word + k) for k, p in enumerate(parts)]) if parts else np.zeros(0, np.int64))
        word += len(parts) + 1
        if len(own) >= q:
            a = np.arange(len(own) - q + 1)
            grams.append(_hashes(own, a, q))
            places.append(a + at)
        at += len(own)
        starts.append(at)
    cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
    g, p = cat(grams, np.uint64), cat(places, np.int64)
    order = np.argsort(g, kind="stable")
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(g >> np.uint64(42)).astype(np.int64)] = True
    return Passages(np.array(ids, dtype=np.int64), cat(codes, np.uint32), np.array(starts), cat(numbers, np.int64), np.array(wide, dtype=bool), np.array(least, dtype=np.int64), g[order], p[order], seen)


def _reach(a: np.ndarray, b: np.ndarray, edits: int) -> list[int]:
    """Furthest index into a that an alignment of prefixes of a and b reaches with 0, 1, ... edits, within the band of that many diagonals."""
    def slide(i: int, j: int) -> int:
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            return i
        differs = a[i : i + n] != b[j : j + n]
        k = int(differs.argmax())
        return i + (k if differs[k] else n)

    front = {0: slide(0, 0)}
    out = [front[0]]
    for _ in range(edits):
        new: dict[int, int] = {}
        for d, i in front.items():
            for step, diagonal in ((1, d), (1, d - 1), (0, d + 1)):  # substitution, letter of a left out, letter of b left out
                x = min(i + step, len(a))
                j = x + diagonal
                if 0 <= j <= len(b):
                    new[diagonal] = max(new.get(diagonal, 0), slide(x, j))
        front = new or front
        out.append(max(out[-1], *front.values()))
    return out


def matches(codes: np.ndarray, x: Passages, q: int, stride: int, edits: int, words: int, letters: int) -> Iterator[tuple[int, int, int]]:
    """passage id, aligned letters and whole words of the best stretch of each passage that lies in a document: by letters where they are counted, else by words."""
    if len(codes) < q or not len(x.grams):
        return
    at = np.arange(0, len(codes) - q + 1, stride)
    h = _hashes(codes, at, q)
    hit = x.seen[(h >> np.uint64(42)).astype(np.int64)]
    h, at = h[hit], at[hit]
    if not len(h):
        return
    lo, hi = np.searchsorted(x.grams, h, "left"), np.searchsorted(x.grams, h, "right")
    n = hi - lo
    if not n.any():
        return
    pos = np.repeat(at, n)
    place = x.places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    item = np.searchsorted(x.start, place, "right") - 1
    diagonal = pos - (place - x.start[item])
    width = 2 * edits + 1
    need = np.maximum(1, (x.least[item] - q + 1 - q * edits) // stride)
    keep = np.zeros(len(pos), dtype=bool)
    for shift in (0, edits + 1) if edits else (0,):
        band = np.floor_divide(diagonal + shift, width)
        _, inverse, count = np.unique((item << 40) + band, return_inverse=True, return_counts=True)
        keep |= count[inverse] >= need
    best: dict[int, tuple[int, int]] = {}
    done: dict[tuple[int, int], int] = {}  # of each passage and diagonal, how far into the passage it is aligned
    for k in np.flatnonzero(keep).tolist():
        i, d, p = int(item[k]), int(diagonal[k]), int(pos[k])
        s, e = int(x.start[i]), int(x.start[i + 1])
        own, inside = x.codes[s:e], p - d
        if inside < done.get((i, d), 0):
            continue
        right = _reach(own[inside:], codes[p:], edits)
        left = _reach(own[:inside][::-1], codes[:p][::-1], edits)
        done[i, d] = inside + right[0]
        for given in range(edits + 1):
            a, b = inside - left[given], inside + right[edits - given]
            inner = x.word[s + a : s + b]
            cut = int(a > 0 and x.word[s + a - 1] == inner[0]) + int(s + b < e and x.word[s + b] == inner[-1])
            full = len(np.unique(inner)) - cut
            rank = (b - a, full) if x.wide[i] else (full, b - a)
            if rank > best.get(i, (0, 0)):
                best[i] = rank
    for i, rank in best.items():
        if rank[0] >= (letters if x.wide[i] else words):
            length, full = rank if x.wide[i] else rank[::-1]
            yield int(x.ids[i]), length, full


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = 12, stride: int = 4, edits: int = 0, words: int = 15, letters: int = 30, block: int = 2000) -> DataFrame:
    """key, item key, letters and words of the best stretch (by what is counted), for each document with `words` words in a row of a passage (`letters` letters and
    digits where the passage is mostly of CJK characters), with at most `edits` edits.

    Case, spacing, punctuation and encoding do not count. Null and empty texts on either side match nothing; passages shorter than the bounds
    cannot match. A document or passage id that comes twice gives a row for each pair of rows."""
    spark = docs.sparkSession
    own = items.where(F.length(item_text) > 0).select(item_key, item_text)
    n = own.count()
    schema = f"{key} long, {item_key} long, letters int, words int"
    bodies = docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spark.createDataFrame([], schema)
    ordered = own.orderBy(item_key)
    for offset in range(0, n, block):
        x = index([(r[0], r[1]) for r in ordered.offset(offset).limit(block).collect()], q, words, letters)  # at most `block` passages
        share = spark.sparkContext.broadcast(x)

        def search(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            x = share.value
            for b in batches:
                rows: list[tuple[int, int, int, int]] = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows += [(k, *m) for m in matches(plain_codes(t), x, q, stride, edits, words, letters)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], [key, item_key, "letters", "words"])

        out = out.unionByName(bodies.mapInArrow(search, schema))
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).select("doc_id", "item_id")


def near(docs: DataFrame, items: DataFrame, edits: int = 2) -> DataFrame:
    """The same with passages that were edited: q-grams short enough that the bound leaves some, counted in bands of diagonals, then banded alignment."""
    return leaks(docs, items, q=8, stride=2, edits=edits)
