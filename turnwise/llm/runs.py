"""Word runs of many records at once: 64-bit tokens by numpy over whole batches of texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: An odd multiplier for the rolling value of a word, and its inverse modulo 2^64.
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
#: A word of its own: each character of scripts that are written without blanks.
OWN = r"[\p{Han}\p{Hiragana}\p{Katakana}]"


def shake(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


@cache
def kinds() -> np.ndarray:
    """For each code point 1 if it is part of words, 2 if it is a word of its own, else 0."""
    out = np.zeros(0x110000, np.int8)
    low, high = (np.arange(a, b, dtype=np.uint32).tobytes().decode("utf-32-le") for a, b in ((0, 0xD800), (0xE000, 0x110000)))
    for kind, pattern in ((1, r"[\p{L}\p{N}\p{M}]+"), (2, OWN + "+")):
        for text, base in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(pattern, text):
                out[base + m.start() : base + m.end()] = kind
    return out


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def joined(texts: list[str]) -> np.ndarray:
    """Code points of all texts with a 0 between them. Case, and forms that NFKC makes equal, don't count."""
    whole = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    whole = whole.lower() if whole.isascii() else unicodedata.normalize("NFKC", whole).casefold()
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def split_words(c: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of code points by their kinds, and a 64-bit value of each."""
    inside = kind > 0
    part = kind == 1
    start = np.flatnonzero(inside & ~(np.r_[False, part[:-1]] & part))
    end = np.flatnonzero(inside & ~(np.r_[part[1:], False] & part)) + 1
    rolled = np.r_[np.uint64(0), np.cumsum((c + np.uint32(1)).astype(np.uint64) * _powers(_BASE, len(c)), dtype=np.uint64)]
    return start, end, shake((rolled[end] - rolled[start]) * _powers(_BACK, len(c) + 1)[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each word of the texts, and the number of the text it stands in. Punctuation doesn't count."""
    c = joined(texts)
    start, _, value = split_words(c, kinds()[c])
    return value, np.searchsorted(np.flatnonzero(c == 0), start, side="left")


def _runs(texts: list[str], owner: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all runs and the owners of their texts. A text with fewer words than a run is one run."""
    value, text = words(texts)
    n = len(value)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if n else np.zeros(0, np.int64)
    left = np.repeat(np.r_[first[1:], n] if n else first, np.diff(np.r_[first, n])) - np.arange(n)  # words of the text from here on
    starts = (left >= run) | np.isin(np.arange(n), first)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        more = np.flatnonzero(starts & (left > k))
        h[more] = shake((h[more] + value[more + k]) * _MIX)
    return h[starts], owner[text[starts]]


def blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of the texts into blocks of about `size` characters."""
    a, total = 0, 0
    for b, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def grouped(h: np.ndarray, whose: np.ndarray, count: int) -> np.ndarray:
    """An order that brings equal values of one owner together, owner after owner."""
    bits = max(1, int(count).bit_length())
    key = (whose.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():  # the bits left out decide
        return np.lexsort((h, whose))
    return order


def run_tokens(texts: list[str], owner: np.ndarray, count: int, run: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit tokens of all runs of each owner's texts, owner after owner, and the offsets of the `count` owners.

    The k-th repetition of a run has a token of its own, so that set overlap is overlap with multiplicity."""
    parts = [_runs(texts[a:b], owner[a:b], run) for a, b in blocks(texts)]
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    whose = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = grouped(h, whose, count)
    h, whose = h[order], whose[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])]) if len(h) else np.zeros(0, np.int64)
    again = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    return shake(h + again.astype(np.uint64) * _MIX).view(np.int64), np.searchsorted(whose, np.arange(count + 1))
