"""Defective prompt and response pairs of dialogues.

Two models judge the texts. A naive Bayes classifier over hashed character n-grams gives language posteriors of
the sentences of prompt and response; a response that is wholly in languages the prompt does not contain is
`other_language`. An n-gram model with an end symbol gives the likelihood that a text ends where it does; a
response whose end is far less likely than its continuation is `truncated`, as is one with an unclosed tag or
fence, or a call whose parameters are cut JSON. Empty responses, refusals and copies of the prompt are told by
what is left of the text. Both models are trained here: the classifier on a bounded sample of labelled sentences,
the n-gram model on the texts of all dialogues.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.language import english, with_neighbours, without_accents
from turnwise.llm.leaks import plain_codes
from turnwise.llm.sentences import END, LANGS, PLACEHOLDERS, TAGS, labelled, sentences

GRAMS, ORDER, BITS = 1 << 15, 4, 17


def _grams(text: str, low: int = 2, high: int = ORDER) -> np.ndarray:
    """Hashed character n-grams of a text in lower case."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h, out = np.zeros(len(c), dtype=np.uint64), []
    for n in range(1, high + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if len(h) and n >= low:
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64))
        if len(h) <= 1:
            break
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class NaiveBayes:
    logs: np.ndarray  # GRAMS x languages

    def posteriors(self, texts: list[str], block: int = 1 << 18) -> np.ndarray:
        """Of each language for each text, in blocks of about `block` characters. The log likelihood is scaled down, as overlapping n-grams are not independent."""
        out = np.zeros((len(texts), len(LANGS)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < block:
                size += len(texts[end]) + 2
                end += 1
            part = [f" {t.lower()} " for t in texts[start:end]]
            c = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            owner = np.repeat(np.arange(end - start), [len(t) for t in part])
            h = np.zeros(len(c), dtype=np.uint64)
            for n in range(1, ORDER + 1):
                h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
                if n > 1:
                    inside = owner[: len(h)] == owner[n - 1 :]
                    at = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)[inside]
                    whose = owner[: len(h)][inside]
                    logs = self.logs[at]
                    for k in range(len(LANGS)):
                        out[start:end, k] += np.bincount(whose, logs[:, k], end - start)
            start = end
        out /= ORDER
        p = np.exp(out - out.max(axis=1, keepdims=True)) if len(texts) else out
        return p / p.sum(axis=1, keepdims=True)


def fit_bayes(texts: list[str], labels: list[int], smooth: float = 0.3) -> NaiveBayes:
    """Count n-grams by language, leave out texts that contradict the first counts surely, and count again."""
    y, keep, model = np.array(labels), np.ones(len(labels), dtype=bool), NaiveBayes(np.zeros((GRAMS, len(LANGS))))
    grams = [np.unique(np.concatenate([_grams(t), _grams(without_accents(t))])) for t in texts]
    for _ in range(2):
        counts = np.full((GRAMS, len(LANGS)), smooth)
        for k in np.flatnonzero(keep).tolist():
            counts[grams[k], y[k]] += 1
        model = NaiveBayes(np.log(counts / counts.sum(axis=0)).astype(np.float32))
        p = model.posteriors(texts)
        keep = (p.argmax(axis=1) == y) | (p.max(axis=1) < 0.9)
    return model


#: The longest context in characters, and in words and signs from the start of a line; both at one level each.
ENDS, LINE = 7, 8
LEVELS, CHUNK = ENDS + 2, 1 << 14

_PIECES = regex.compile(r"[\p{L}\p{N}_-]*[\p{L}\p{N}_]|\s+|.", regex.DOTALL)
_LETTERS_ONLY, _DIGITS_ONLY = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
_CAPITALS, _DIGITS = regex.compile(r"\p{Lu}"), regex.compile(r"\d")


def _shape(text: str) -> np.ndarray:
    """Code points with all digits as 0 and all capitals as A, after a start sign for each place before the text."""
    t = _CAPITALS.sub("A", _DIGITS.sub("0", text))
    return np.frombuffer(("\x02" * ENDS + t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _cells(shape: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the hashed context of n characters that ends at each place from the first after the start signs."""
    h = np.zeros(len(shape) - ENDS, dtype=np.uint64)
    for n in range(1, ENDS + 1):
        h = (h + shape[ENDS + 1 - n : len(shape) + 1 - n]) * np.uint64(0x9E3779B97F4A7C15)
        yield n, ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def _line_cells(line: str) -> tuple[list[int], bool]:
    """The hashed shape of a line up to each of its first pieces (words as a, numbers as 0, codes as w, other signs as they are), and whether they are the whole line."""
    cells, h, count = [], 0, 0
    for m in _PIECES.finditer(line.rstrip()):
        piece = m[0]
        if piece.isspace():
            continue
        if count == LINE:
            return cells, False
        kind = "a" if _LETTERS_ONLY.fullmatch(piece) else "0" if _DIGITS_ONLY.fullmatch(piece) else "w" if len(piece) > 1 or piece.isalnum() else piece
        h = ((h + ord(kind) + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        cells.append(((h * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS))
        count += 1
    return cells, True


def _counts(text: str) -> bool:
    """Whether a text counts for the model of ends."""
    return len(text.strip()) > 20


@dataclass
class EndModel:
    """Counts of contexts (the last n characters, hashed) and of those at which a sentence, a line or a text ended; the last level has the shapes of lines that another line follows."""

    seen: np.ndarray  # LEVELS x 2^BITS
    ended: np.ndarray

    @classmethod
    def empty(cls) -> EndModel:
        return cls(np.zeros((LEVELS, 1 << BITS), np.int64), np.zeros((LEVELS, 1 << BITS), np.int64))

    def add(self, texts: list[str], block: int = 1 << 18) -> None:
        """Count the contexts and ends of texts without blanks at their ends, in blocks of about `block` characters."""
        for text in texts:
            for line in text.split("\n")[:-1]:
                cells, whole = _line_cells(line)
                np.add.at(self.seen[-1], cells, 1)
                if whole and cells:
                    self.ended[-1, cells[-1]] += 1
        start = 0
        while start < len(texts):
            end, size, stops = start, 0, []
            while end < len(texts) and size < block:
                stops += [size + x - 1 for x in _ends(texts[end])]
                size += len(texts[end]) + ENDS
                end += 1
            part = texts[start:end]
            inside = np.ones(size, dtype=bool)  # from the first character on, without the start signs of the next texts
            for at in np.cumsum([len(t) + ENDS for t in part]).tolist():
                inside[at - ENDS : at] = False
            inside, last = inside[: size - ENDS], np.array(stops, dtype=np.int64)
            self.seen[0, 0] += inside.sum()
            self.ended[0, 0] += len(last)
            for n, at in _cells(_shape(("\x02" * ENDS).join(part))):
                self.seen[n] += np.bincount(at[inside], minlength=1 << BITS)
                self.ended[n] += np.bincount(at[last], minlength=1 << BITS)
            start = end

    def chance(self, text: str, included: bool = True) -> float:
        """That a text ends after its last characters: from short contexts to long ones, each weighed by how often it was seen.

        What the text itself added is left out, if it is `included` in the counts."""
        own, stops = included and _counts(text), np.array(_ends(text)) - 1
        p = float((self.ended[0, 0] - own * len(stops)) / max(1, self.seen[0, 0] - own * len(text)))
        for n, at in _cells(_shape(text)):
            mine = at == at[-1]
            p = (self.ended[n, at[-1]] - own * mine[stops].sum() + 2 * p) / (self.seen[n, at[-1]] - own * mine.sum() + 2)
        return float(p)

    def whole_line(self, text: str, sightings: int = 10) -> bool:
        """Whether the last of several lines has a shape at which most lines end, as the items of a list have."""
        if "\n" not in text:
            return False
        cells, whole = _line_cells(text[text.rfind("\n") + 1 :])
        return whole and bool(cells) and bool(self.seen[-1, cells[-1]] >= sightings and 2 * self.ended[-1, cells[-1]] > self.seen[-1, cells[-1]])

    def last(self, text: str) -> float:
        """The same from the last character alone, which few cut texts cannot blur."""
        with np.errstate(over="ignore"):
            h = _shape(text[-1:])[-1] * np.uint64(0x9E3779B97F4A7C15)
            at = int((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
        return float((self.ended[1, at] + 1) / (self.seen[1, at] + 20))


def _ends(text: str) -> list[int]:
    """Where a sentence, a line or the text ends."""
    out, before = set(), 0
    for m in END.finditer(text):
        at = m.end()
        while at > before and text[at - 1].isspace():
            at -= 1
        before = at
        out.add(at)
    return sorted(out - {0} | {len(text)})


def _role(message: dict | None) -> str:
    return ((message or {}).get("role") or "").strip().lower()


def fit_ends(dialogues: DataFrame, messages: str = "curr_messages") -> EndModel:
    """Count over all assistant texts. Each task sums in arrays of fixed size and hands on what isn't 0; 2 x LEVELS x 2^BITS sums reach the driver."""
    some = F.filter(messages, lambda m: F.lower(m["role"]).contains("assistant"))
    rows = dialogues.where(F.col(messages).isNotNull()).select(F.transform(some, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = EndModel.empty()
        for b in batches:
            model.add([m["content"].rstrip() for ms in b.column(0).to_pylist() for m in ms if _role(m) == "assistant" and m["content"] and _counts(m["content"])])
        cells = np.flatnonzero(model.seen)
        for k in range(0, len(cells), 1 << 16):
            at = cells[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(model.seen.flat[at], pa.int64()), pa.array(model.ended.flat[at], pa.int64())], ["cell", "seen", "ended"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, cell, seen, ended = (b.column(k).to_numpy() for k in range(4))
            for k in np.unique(chunk).tolist():
                sums, mine = chunks.setdefault(k, np.zeros((2, CHUNK), np.int64)), chunk == k
                for row, values in zip(sums, (seen, ended)):
                    np.add.at(row, cell[mine] % CHUNK, values[mine])
        for k, sums in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["chunk", "sums"])

    cells = rows.mapInArrow(count, "cell int, seen long, ended long").select(F.expr(f"cell div {CHUNK}").cast("int").alias("chunk"), "cell", "seen", "ended")
    model = EndModel.empty()
    for r in cells.repartition("chunk").mapInArrow(add_up, "chunk int, sums binary").collect():  # bounded
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        model.seen.flat[at], model.ended.flat[at] = np.frombuffer(r["sums"], np.int64).reshape(2, CHUNK)
    return model


#: Ways to decline, in five languages, without accents and in lower case. What someone is reported to have said or done declines nothing.
REFUSALS = regex.compile(
    "|".join(
        (
            # English
            r"\bi('m| am)? (sorry,? but i )?(can't|cannot|can not|won't|will not|am unable to|am not able to|'m unable to|'m not able to|must decline|have to decline|refuse|would rather not|don't feel comfortable|do not feel comfortable|am not allowed|am not permitted)\b",
            r"\b(something|anything) i (won't|will not|can't|cannot) (do|take on|help|handle|discuss)|isn't something i can|is not something i can|outside of what i am allowed|beyond what i (can|am)|request will not be (handled|answered)|no answer can be given|as an? (ai|language model|assistant),? i",
            r"(?<!was )(?<!were )(?<!been )\bunable to (assist|help|comply|answer)|(?<!was )(?<!were )\bnot able to (assist|help|comply|answer)|can't help with|cannot help with|against my (rules|guidelines|policy)",
            # German
            r"ihnen (leider )?nicht (weiter)?helfen|(leider )?ablehnen|nicht aeussern|als (sprachmodell|ki|assistent)|darf ich (leider )?nicht|kann ich (leider )?nicht (beantworten|helfen|tun)|werde ich nicht (beantworten|tun|ausfuehren)|moechte ich (lieber )?nicht",
            # French
            r"je (ne peux|ne suis pas|ne vais pas|n'ai pas le droit|prefere ne pas|dois (malheureusement )?(refuser|decliner)|refuse)|je regrette,? mais|en tant que (modele|assistant)|impossible de (vous aider|repondre)",
            # Spanish
            r"\bno (puedo|podre|voy a|tengo permitido|estoy autorizado|me es posible)|prefiero no|debo (rechazar|declinar)|como (modelo|asistente)|me niego|lamento no poder",
            # Chinese
            r"(?<!说)(无法|不能|不会|没法|不便)(为您|给您|帮您|继续)?(协助|回答|处理|提供|帮|做|讨论|完成|满足)|没有办法完成|得不到答复|超出了?我|还是不谈|作为(一个)?(语言模型|人工智能|ai)|恕我|恕难|拒绝(回答|处理|提供)|请另找|不予",
        )
    )
)
OPENERS = regex.compile(r"<(response|think|answer)>", regex.IGNORECASE)


_SEEN = regex.compile(r"[\p{L}\p{N}\p{So}]")
_SPLIT = regex.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_NUMBER_STOP = regex.compile(r"\p{N}.\z")


def is_empty(content: str) -> bool:
    """Nothing but invisible characters, bare punctuation, empty tags or a placeholder for nothing."""
    bare = TAGS.sub(" ", content) if "<" in content else content
    if not _SEEN.search(bare):
        return True
    if len(bare.strip()) > 40:
        return False
    words = regex.sub(r"[^\p{L}\p{N}/.]+", " ", bare).strip().lower().strip(". ")
    return words in PLACEHOLDERS or regex.sub(r"[^\p{L}/.]+", " ", bare).strip().lower() in PLACEHOLDERS


def is_refusal(content: str) -> bool:
    """A sentence that declines, and no answer beside it: other sentences with digits make up at most half of the text.

    Of three or more sentences those with digits are taken as answers at once if they make up more than that."""
    lines = [x for x in _SPLIT.split(TAGS.sub(" ", content) if "<" in content else content) if x.strip()]
    dated = [_DIGITS.search(x) is not None for x in lines]
    total = sum(map(len, lines))
    if len(lines) > 2 and 2 * sum(len(x) for x, d in zip(lines, dated) if d) > total:
        return False
    declines = [REFUSALS.search(without_accents(x.replace("’", "'"))) is not None for x in lines]
    return any(declines) and 2 * sum(len(x) for x, d, r in zip(lines, dated, declines) if d and not r) <= total


def _plain(text: str) -> str:
    return plain_codes(TAGS.sub(" ", text) if "<" in text else text).tobytes().decode("utf-32-le", "surrogatepass")


def is_copy(content: str, prompt: str, extra: int = 30) -> bool:
    """The prompt, and at most `extra` letters around it."""
    a, b = _plain(content), _plain(prompt)
    return len(b) >= 4 and len(a) - len(b) <= min(extra, max(8, len(b))) and b in a


def is_cut_json(parameters: str | None) -> bool:
    if parameters is None:
        return False
    try:
        json.loads(parameters)
    except ValueError:
        return bool(parameters.strip())
    return False


def is_cut(content: str, ends: EndModel, least: float = 0.01) -> bool:
    text = content.rstrip()
    if text.count("```") % 2:
        return True
    if "<" in text and any(f"</{m[1].lower()}>" not in text[m.end() :].lower() for m in OPENERS.finditer(text)):
        return True
    if ends.whole_line(text):
        return False
    last = ends.last(text)
    if last > 0.8 and not _NUMBER_STOP.search(text[-2:]):  # a clear end sign, unless it may belong to a number as in a German date
        return False
    return last < least / 2 or ends.chance(text) < least


def languages(texts: list[str], bayes: NaiveBayes, sure: float = 0.6) -> list[set[int]]:
    """The languages of each text's sentences."""
    parts = [(k, s.text) for k, t in enumerate(texts) for s in sentences(t)]
    owner = np.array([k for k, _ in parts], dtype=np.int64)
    once: dict[str, int] = {}
    at = [once.setdefault(t, len(once)) for _, t in parts]
    p = with_neighbours(bayes.posteriors(list(once))[at], owner)
    out: list[set[int]] = [set() for _ in texts]
    for k, lang, q in zip(owner.tolist(), p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
        if q >= sure:
            out[k].add(lang)
    return out


def own_defect(content: str | None, parameters: list[str | None], prompt: str, ends: EndModel) -> str | None:
    """The defect of a response to a prompt that shows without their languages: None if there is none, "?" if they are still to be compared."""
    content = content or ""
    if not parameters and is_empty(content):
        return "empty"
    if any(map(is_cut_json, parameters)):
        return "truncated"
    if not content.strip() or is_empty(content):
        return None
    if is_copy(content, prompt):
        return "copy"
    if not parameters and is_refusal(content):
        return "refusal"
    return "truncated" if is_cut(content, ends) else "?"


def pairs(dialogues: DataFrame, *labelled_texts: DataFrame, messages: str = "curr_messages") -> DataFrame:
    """cid, turn_no, defect (null if there is none), hinted (turn_no is in possible_wrong_turns) of each assistant message after a user message.

    An assistant message answers the last user message before it; without one it has no row. Null contents count as
    empty, null parameters as given whole. Rows with a null cid or null messages have no pairs. Training takes
    the texts of all dialogues and the bounded sample of labelled sentences; every pair is judged on its whole texts."""
    spark = dialogues.sparkSession
    bayes = fit_bayes(*labelled(*labelled_texts, english(dialogues, messages)))
    ends = fit_ends(dialogues, messages)
    share = spark.sparkContext.broadcast((bayes, ends))
    slim = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.transform(m["tool_usage"], lambda t: t["parameters"]).alias("calls")))
    rows = dialogues.where(F.col("cid").isNotNull() & F.col(messages).isNotNull()).select("cid", slim.alias("m"), F.col("possible_wrong_turns").alias("hints"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, ends = share.value
        for b in batches:
            out: list[tuple[int, int, str | None, bool]] = []
            texts: dict[str, int] = {}
            open_: list[tuple[int, int, int]] = []
            for cid, ms, hints in zip(*(b.column(k).to_pylist() for k in range(3))):
                prompt = None
                for turn, m in enumerate(ms, 1):
                    role = _role(m)
                    if role == "user":
                        prompt = m["content"] or ""
                    elif role == "assistant" and prompt is not None:
                        defect = own_defect(m["content"], m["calls"] or [], prompt, ends)
                        if defect == "?":
                            open_.append((len(out), texts.setdefault(m["content"], len(texts)), texts.setdefault(prompt, len(texts))))
                        out.append((cid, turn, defect, turn in (hints or [])))
            spoken = languages(list(texts), bayes)
            for at, mine, theirs in open_:
                other = bool(spoken[mine] and spoken[theirs] and not spoken[mine] & spoken[theirs])
                out[at] = (*out[at][:2], "other_language" if other else None, out[at][3])
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], ["cid", "turn_no", "defect", "hinted"])

    return rows.mapInArrow(judge, "cid long, turn_no int, defect string, hinted boolean")


def found(dialogues: DataFrame, *labelled_texts: DataFrame) -> DataFrame:
    return pairs(dialogues, *labelled_texts).where("defect IS NOT NULL").select("cid", "turn_no", "defect")
