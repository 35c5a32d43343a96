"""Language of each message and each of its sentences: a byte convolutional network trained in numpy.

Filters of several widths over byte embeddings, the largest response of each filter in a window, and a softmax.
It is trained on a bounded sample of labelled sentences, with variants in upper case and without accents, and
applied to batches of fixed-length windows that cover every sentence to its end. For use, each filter's weights
are multiplied into the embeddings once, so that a window costs look-ups and sums only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.sentences import LANGS, labelled, sentences

WINDOW, WIDTHS, FILTERS, EMBED = 64, (2, 3, 4, 5), 24, 12


def windows(text: str) -> np.ndarray:
    """Rows of WINDOW bytes that cover the text in lower case; the last one ends with the text. Short texts are padded with zeros."""
    b = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    if len(b) <= WINDOW:
        return np.pad(b, (0, WINDOW - len(b)))[None]
    starts = [*range(0, len(b) - WINDOW, WINDOW), len(b) - WINDOW]
    return np.stack([b[s : s + WINDOW] for s in starts])


@dataclass
class Network:
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS), the filters' responses to each byte
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def log_probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        out = []
        for k in range(0, len(x), batch):
            part, pooled = x[k : k + batch], []
            for table, bias in zip(self.tables, self.bias):
                n = part.shape[1] - len(table) + 1
                response = table[0][part[:, :n]]
                for j in range(1, len(table)):
                    response = response + table[j][part[:, j : j + n]]
                pooled.append(np.maximum(response.max(axis=1) + bias, 0))
            z = np.concatenate(pooled, axis=1) @ self.weights + self.offset
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(LANGS)), np.float32)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Of each language for each text, from the mean over its windows."""
        rows = [windows(t) for t in texts]
        if not rows:
            return np.zeros((0, len(LANGS)))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        logs = self.log_probabilities(np.concatenate(rows))
        total = np.zeros((len(rows), len(LANGS)))
        np.add.at(total, owner, logs)
        total /= np.bincount(owner)[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def with_neighbours(p: np.ndarray, owner: np.ndarray, floor: float = 0.05) -> np.ndarray:
    """Each sentence's probabilities, weighted by the mean of the other sentences of its message; a sentence alone keeps its own."""
    if not len(p):
        return p
    total, count = np.zeros((owner.max() + 1, p.shape[1])), np.bincount(owner)
    np.add.at(total, owner, p)
    others = (total[owner] - p) / np.maximum(1, count[owner] - 1)[:, None]
    out = np.where((count[owner] > 1)[:, None], p * (floor + others), p)
    return out / out.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 3, seed: int = 3, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "w": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(LANGS))), "o": np.zeros(len(LANGS))}
    for w in WIDTHS:
        p[f"c{w}"], p[f"b{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at_row in range(0, len(x), batch):
            rows = order[at_row : at_row + batch]
            bx, n = x[rows], len(rows)
            e = p["e"][bx]
            pooled, kept = [], []
            for w in WIDTHS:
                view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
                response = view @ p[f"c{w}"] + p[f"b{w}"]
                at = response.argmax(axis=1)
                top = np.take_along_axis(response, at[:, None], 1)[:, 0]
                pooled.append(np.maximum(top, 0))
                kept.append((view, at, top > 0))
            h = np.concatenate(pooled, axis=1)
            z = h @ p["w"] + p["o"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y[rows]] -= 1
            q /= n
            g = {"w": h.T @ q, "o": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = q @ p["w"].T
            for j, w in enumerate(WIDTHS):
                view, at, on = kept[j]
                d = back[:, j * FILTERS : (j + 1) * FILTERS] * on
                used = view[np.arange(n)[:, None], at]  # batch, filter, width * EMBED
                g[f"c{w}"], g[f"b{w}"] = np.einsum("bf,bfd->df", d, used), d.sum(axis=0)
                to_bytes = (d[:, :, None] * p[f"c{w}"].T[None]).reshape(-1, EMBED)
                which = bx[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)].reshape(-1)
                for k in range(EMBED):
                    g["e"][:, k] += np.bincount(which, to_bytes[:, k], 256)
            step += 1
            now = rate * (1 - 0.9 * step * batch / (rounds * len(x) + batch))  # falls to a tenth
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                p[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tables = [np.stack([p["e"] @ p[f"c{w}"].reshape(w, EMBED, FILTERS)[j] for j in range(w)]) for w in WIDTHS]
    return Network(tables, [p[f"b{w}"] for w in WIDTHS], p["w"], p["o"])


#: How umlauts and ligatures are written without accents.
PLAIN_LETTERS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "œ": "oe", "æ": "ae"})
MARKS = regex.compile(r"\p{Mn}+")


def without_accents(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    return MARKS.sub("", unicodedata.normalize("NFD", text.translate(PLAIN_LETTERS)))


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Network:
    """Train, leave out what contradicts the first model surely, and train again."""
    def rows(ts: list[str], ls: list[int]) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = [], []
        for t, label in zip(ts, ls):
            for variant in dict.fromkeys((t, without_accents(t))):
                w = windows(variant)
                xs.append(w)
                ys += [label] * len(w)
        return np.concatenate(xs), np.array(ys)

    if not texts:
        raise ValueError("no labelled sentences to learn from")
    net = train(*rows(texts, labels), rounds=1, seed=seed)
    p = net.probabilities(texts)
    keep = [k for k, best in enumerate(p.argmax(axis=1).tolist()) if best == labels[k] or p[k, best] < 0.9]
    return train(*rows([texts[k] for k in keep], [labels[k] for k in keep]), rounds=3, seed=seed)


@lru_cache(maxsize=2)
def fitted(texts: tuple[str, ...], labels: tuple[int, ...]) -> Network:
    """`fit`, once for each sample in a session."""
    return fit(list(texts), list(labels))


def english(dialogues: DataFrame, messages: str = "curr_messages") -> DataFrame:
    """cid, text, lang of the dialogues that are labelled as English: their contents, a line each."""
    return dialogues.where("is_en").select("cid", F.array_join(F.transform(messages, lambda m: m["content"]), "\n").alias("text"), F.lit("en").alias("lang"))


def segments(dialogues: DataFrame, *labelled_texts: DataFrame, messages: str = "curr_messages", docs_a_language: int = 300, sentences_a_language: int = 2000) -> DataFrame:
    """cid, is_en, turn_no, part, start, end, lang, confidence, whole: each sentence with a language of each message content.

    start and end are places in the content; neighbouring sentences of one language are separate parts. Messages without
    prose (empty, null, code, codes, placeholders) have no row. Contents of any length are judged to their end. Rows with a
    null cid or null messages have no row. The network is trained on a bounded sample of tables with text and lang."""
    own = english(dialogues, messages)
    texts, labels = labelled(*labelled_texts, own, docs_a_language=docs_a_language, sentences_a_language=sentences_a_language)
    net = fitted(tuple(texts), tuple(labels))
    spark = dialogues.sparkSession
    share = spark.sparkContext.broadcast(net)
    rows = dialogues.where("cid IS NOT NULL").select("cid", "is_en", F.posexplode(messages).alias("place", "m")).select("cid", "is_en", (F.col("place") + 1).alias("turn_no"), F.col("m.content").alias("content")).where(F.length("content") > 0)
    schema = "cid long, is_en boolean, turn_no int, part int, start int, end int, lang string, confidence double, whole boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = share.value
        for b in batches:
            cid, en, turn, contents = (b.column(k).to_pylist() for k in range(4))
            found = [(k, j, s) for k, c in enumerate(contents) for j, s in enumerate(sentences(c))]
            once: dict[str, int] = {}  # sentences are compared without their codes, so many are equal
            at = [once.setdefault(s.text, len(once)) for _, _, s in found]
            p = with_neighbours(net.probabilities(list(once))[at], np.array([k for k, _, _ in found], dtype=np.int64))
            cols = list(zip(*((cid[k], en[k], turn[k], j, s.start, s.end, LANGS[lang], q, s.whole) for (k, j, s), lang, q in zip(found, p.argmax(axis=1).tolist(), p.max(axis=1).tolist())))) or [()] * 9
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["cid", "is_en", "turn_no", "part", "start", "end", "lang", "confidence", "whole"])

    return rows.mapInArrow(judge, schema)


def messages(dialogues: DataFrame, *labelled_texts: DataFrame) -> DataFrame:
    """cid, turn_no, lang (of most of its sentences by length), confidence, langs (all, sorted) for each message with prose."""
    parts = segments(dialogues, *labelled_texts).withColumn("n", F.col("end") - F.col("start"))
    by = parts.groupBy("cid", "turn_no", "lang").agg(F.sum("n").alias("n"), F.avg("confidence").alias("confidence"))
    return by.groupBy("cid", "turn_no").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("confidence", F.struct("n", "lang")).alias("confidence"), F.array_sort(F.collect_set("lang")).alias("langs"))


def found(dialogues: DataFrame, *labelled_texts: DataFrame, sure: float = 0.5) -> DataFrame:
    """cid, turn_no, lang of whole sentences that the dialogue's label is missing for or contradicts."""
    s = segments(dialogues, *labelled_texts).where(F.col("whole") & (F.col("confidence") >= sure))
    return s.where("is_en IS NULL OR is_en = (lang <> 'en')").select("cid", "turn_no", "lang").distinct()
