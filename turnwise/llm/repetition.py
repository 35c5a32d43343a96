"""Share of repeated content in each message, and the messages that are mostly repetition.

What counts are letters. Words (runs of letters, digits left out) and characters of CJK scripts are tokens; a run
of at least three words, or six CJK characters, that stood earlier in the same message is repeated. The share is
the letters in such runs over all letters.

Messages are scored by gradient-boosted trees over statistics of the message. The trees are grown here, on a
bounded sample (the dialogues whose keys hash lowest), with monotonic constraints (more repetition never lowers the score), and flattened into node
arrays, so that a batch is scored by a few array look-ups for each level. The score chooses nothing: the share of
every message is measured exactly, from the same tokens as its statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.runs import blocks, grouped, joined, kinds, shake, split_words
from turnwise.llm.sentences import lowest

_BASE = np.uint64(0x9E3779B97F4A7C15)
FULL = 6  # a window must reach this weight: a word weighs 2, a character of a script without blanks 1
#: Signs at which a sentence or line ends.
STOPS = tuple(map(ord, ".!?。！？\n"))
FEATURES = ("tokens", "distinct_tokens", "distinct_pairs", "distinct_triples", "repeated_tokens", "distinct_windows", "repeated_lines", "top_token")
#: Direction in which a feature may move the score: 1 up, -1 down, 0 either way.
DIRECTION = (0, -1, -1, -1, 1, -1, 1, 0)


@cache
def _digits() -> np.ndarray:
    """Whether a code point is a digit or another number."""
    out = np.zeros(0x110000, bool)
    low, high = (np.arange(a, b, dtype=np.uint32).tobytes().decode("utf-32-le") for a, b in ((0, 0xD800), (0xE000, 0x110000)))
    for text, base in ((low, 0), (high, 0xE000)):
        for m in regex.finditer(r"\p{N}+", text):
            out[base + m.start() : base + m.end()] = True
    return out


def _again(value: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which values stood earlier in the same text, and each text's number of distinct values and of the commonest one."""
    if not len(value):
        return np.zeros(0, bool), np.zeros(count, np.int64), np.zeros(count, np.int64)
    order = grouped(value, text, count)
    # equal values of a text are together, but not in order: the earliest of each group is the first
    v, t = value[order], text[order]
    first = np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])]
    group = np.cumsum(first) - 1
    earliest = np.minimum.reduceat(order, np.flatnonzero(first))
    again = np.ones(len(value), bool)
    again[earliest] = False
    most = np.zeros(count, np.int64)
    np.maximum.at(most, t[first], np.bincount(group))
    return again, np.bincount(t[first], minlength=count), most


def _measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text and its repeated share, for a block of texts at once."""
    count = len(texts)
    c = joined(texts)
    c = c[~_digits()[c]]
    kind = kinds()[c]
    start, end, value = split_words(c, kind)
    text = np.searchsorted(np.flatnonzero(c == 0), start, side="left")
    letters, weight = end - start, np.where(kind[start] == 2, 1, 2)
    n = np.bincount(text, minlength=count)
    over = np.maximum(n, 1)
    # the shortest full window from each token on, if it ends in the same text
    before = np.concatenate([[0], np.cumsum(weight)])
    stop = np.searchsorted(before, before[:-1] + FULL)
    last = np.cumsum(n)[text]  # first token of the next text
    at = np.flatnonzero(stop <= last)
    length = stop[at] - at
    h = np.zeros(len(at), np.uint64)
    for k in range(FULL):
        on = np.flatnonzero(length > k)
        h[on] = shake((h[on] + value[at[on] + k]) * _BASE)
    again, windows, _ = _again(h, text[at], count)
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, stop[at][again], -1)
    repeated = np.cumsum(change[:-1]) > 0
    total = np.bincount(text, letters, count)
    share = np.where(total > 0, np.bincount(text[repeated], letters[repeated], count) / np.maximum(total, 1), 0.0)

    _, tokens, top = _again(value, text, count)
    same2 = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    pairs = shake((shake(value[:-1] * _BASE) + value[1:]) * _BASE)
    same3 = same2[1:] & same2[:-1]
    triples = shake((pairs[:-1] + value[2:]) * _BASE)
    distinct = lambda v, t: _again(v, t, count)[1] / np.maximum(np.bincount(t, minlength=count), 1) + (np.bincount(t, minlength=count) == 0)
    # a line is the sum of its words' values by their places in it; short ones don't count
    line = np.searchsorted(np.flatnonzero(np.isin(c, (0, *STOPS))), start, side="left")
    head = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
    heads = np.flatnonzero(head)
    place = np.arange(len(line)) - np.repeat(heads, np.diff(np.r_[heads, len(line)])) if len(line) else line
    sums = np.add.reduceat(shake(value + place.astype(np.uint64) * _BASE), heads) if len(heads) else np.zeros(0, np.uint64)
    size = np.add.reduceat(letters, heads) if len(heads) else np.zeros(0, np.int64)
    lines_of = text[heads][size > 3]
    lines = np.bincount(lines_of, minlength=count)
    repeats = np.where(lines > 0, 1 - _again(sums[size > 3], lines_of, count)[1] / np.maximum(lines, 1), 0.0)
    x = np.stack(
        [n, np.where(n > 0, tokens / over, 1.0), distinct(pairs[same2], text[1:][same2]), distinct(triples[same3], text[2:][same3]), np.bincount(text[repeated], minlength=count) / over, np.where(np.bincount(text[at], minlength=count) > 0, windows / np.maximum(np.bincount(text[at], minlength=count), 1), 1.0), repeats, top / over], axis=1
    )
    return x.astype(np.float64), share


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text and its repeated share, in blocks of bounded size but for texts that are longer themselves."""
    parts = [_measured(texts[a:b]) for a, b in blocks(texts)]
    if not parts:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


def repeated_share(text: str | None) -> float:
    """Share of letters in repeated runs; 0 for texts without letters."""
    return float(statistics([text])[1][0]) if text else 0.0


@dataclass
class Trees:
    """All trees' nodes one after the other; a leaf points to itself."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.bound[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, split at quantiles. A split must keep its feature's direction, and the values of
    both sides bound what lies below them, so that the score is monotonic in each constrained feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rate0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(len(y), base)
    feature, bound, left, right, value, roots = [], [], [], [], [], []

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(feature)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        for column, start in ((feature, 0), (bound, np.inf), (left, at), (right, at), (value, own * rate)):
            column.append(start)
        if level == depth or len(rows) < 8:
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            sg = np.bincount(binned[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
            sh = np.bincount(binned[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
            rg, rh = total_g - sg, total_h - sh
            vl, vr = np.clip(-sg / (sh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
            gain = sg**2 / (sh + ridge) + rg**2 / (rh + ridge) - total_g**2 / (total_h + ridge)
            gain[(sh < 1e-3) | (rh < 1e-3) | ((vr - vl) * DIRECTION[j] < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            return at
        middle = (vl + vr) / 2
        down, up = ((low, middle), (middle, high)) if DIRECTION[j] > 0 else ((middle, high), (low, middle)) if DIRECTION[j] < 0 else ((low, high), (low, high))
        to_left = binned[rows, j] <= k
        feature[at], bound[at] = j, float(edges[j][k])
        left[at] = node(rows[to_left], g, h, level + 1, *down)
        right[at] = node(rows[~to_left], g, h, level + 1, *up)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
        t = Trees(np.array(feature), np.array(bound), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), depth, 0.0)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(len(x)), t.feature[at]] <= t.bound[at], t.left[at], t.right[at])
        margin += t.value[at]
    return Trees(np.array(feature), np.array(bound), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def fit(texts: list[str], least: float = 0.5) -> Trees:
    """Train on texts, on each third of them with a part said again, and on their measured shares."""
    rng = np.random.default_rng(11)
    more = []
    for t in texts[:: 3]:
        words = t.split(" ") if " " in t else list(t)
        a = int(rng.integers(0, max(1, len(words) // 2)))
        part = words[a : a + int(rng.integers(2, 3 + len(words) // 2))]
        joint = " " if " " in t else ""
        more.append(joint.join([*words, *(part * int(rng.integers(1, 9)))]))
    every = [t for t in [*texts, *more] if t.strip()]
    x, y = statistics(every) if every else (np.zeros((1, len(FEATURES))), np.zeros(1))
    return grow(x, (y >= least).astype(np.float64))


def shares(dialogues: DataFrame, messages: str = "curr_messages", least: float = 0.5, train_rows: int = 600) -> DataFrame:
    """cid, turn_no, score (chance of a share of at least `least`), repeated (the share) of each message with content.

    Null and empty contents have no row; a content without letters has share 0. The trees learn from at most `train_rows`
    dialogues; every message is scored and measured, and whole."""
    spark = dialogues.sparkSession
    some = lowest(dialogues.where(F.col("cid").isNotNull() & F.col(messages).isNotNull()).select("cid", F.transform(messages, lambda m: m["content"]).alias("c")), "cid", train_rows)
    share = spark.sparkContext.broadcast(fit([t for r in some for t in r["c"] if t], least))
    rows = dialogues.where("cid IS NOT NULL").select("cid", F.posexplode(messages).alias("place", "m")).select("cid", (F.col("place") + 1).alias("turn_no"), F.col("m.content").alias("content")).where(F.length("content") > 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = share.value
        for b in batches:
            x, exact = statistics(b.column(2).to_pylist())
            score = trees.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array(exact, pa.float64())], ["cid", "turn_no", "score", "repeated"])

    return rows.mapInArrow(measure, "cid long, turn_no int, score double, repeated double")


def found(dialogues: DataFrame, least: float = 0.5) -> DataFrame:
    return shares(dialogues, least=least).where(F.col("repeated") >= least).select("cid", "turn_no")
