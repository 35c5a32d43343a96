"""Sentences of chat texts, without what has no language: code, JSON, tags, codes and placeholders."""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

LANGS = ("en", "zh", "de", "fr", "es")
HAN = r"\p{Han}"
BLOCKS = regex.compile(r"```.*?(?:```|\z)|<(tool_call|obs)>.*?(?:</\1>|\z)", regex.DOTALL)
TAGS = regex.compile(r"</?[\w-]*(?:>|\z)")
BRACES = regex.compile(r"\{[^{}]*\}|\[[^\[\]]*\]")
OPEN_BRACE = regex.compile(r'[\[{]\s*["{\[].*\z', regex.DOTALL)
#: Words that stand for no content.
PLACEHOLDERS = ("n/a", "na", "null", "none", "nil", "nan", "undefined", "empty", "tbd", "no answer", "no response", "keine", "keine angabe", "k.a.", "aucun", "aucune", "ninguno", "ninguna", "vacío", "vide", "leer", "无", "空", "暂无", "没有内容", "无内容")
#: Codes hold a digit or _; characters of scripts without blanks beside them are no part of them.
CODES = regex.compile(r"[\w--[\p{Han}\p{Hiragana}\p{Katakana}]-]*[\d_][\w--[\p{Han}\p{Hiragana}\p{Katakana}]-]*|\b[A-Za-z]+(?:[A-Z][a-z]+)+\b", regex.V1)
END = regex.compile(rf"[.!?…]+[\"'»”)]*(?=\s|\z|{HAN})|[。！？]+[\"”）]*|\n+")
LATIN_RUN = regex.compile(r"(?:[\p{Latin}'’-]+[\s,;:]+){3,}[\p{Latin}'’-]+[,.;:!?]*")

#: Everyday phrases that are added to the training sentences, for words that the corpus lacks.
EVERYDAY = {
    "en": "Please wait a moment. | Thank you very much for your help. | I am sorry, but that is not possible. | Could you tell me more about this? | Let me check that for you. | We will get back to you soon. | What would you like to do next? | This is the best answer that I have. | Yes, of course, no problem. | Have a nice day and see you tomorrow. | I do not know where they went. | It was a long time ago that she left the house.",
    "zh": "请稍等一下。 | 非常感谢您的帮助。 | 对不起，这是不可能的。 | 您能告诉我更多吗？ | 让我为您查一下。 | 我们会尽快回复您。 | 接下来您想做什么？ | 正在查询，请稍候。 | 好的，没问题。 | 祝您愉快，明天见。 | 我不知道他们去了哪里。 | 她很久以前就离开了家。",
    "de": "Bitte warten Sie einen Moment. | Vielen Dank für Ihre Hilfe. | Es tut mir leid, aber das ist nicht möglich. | Können Sie mir mehr darüber sagen? | Ich prüfe das gerne für Sie. | Wir melden uns bald bei Ihnen. | Was möchten Sie als Nächstes tun? | Das ist die beste Antwort, die ich habe. | Ja, natürlich, kein Problem. | Einen schönen Tag noch und bis morgen. | Ich weiß nicht, wohin sie gegangen sind. | Es ist lange her, dass sie das Haus verlassen hat.",
    "fr": "Veuillez patienter un instant s'il vous plaît. | Merci beaucoup pour votre aide. | Je suis désolé, mais ce n'est pas possible. | Pouvez-vous m'en dire plus à ce sujet ? | Laissez-moi vérifier cela pour vous. | Nous reviendrons bientôt vers vous. | Que souhaitez-vous faire ensuite ? | C'est la meilleure réponse que j'ai. | Oui, bien sûr, pas de problème. | Bonne journée et à demain. | Je ne sais pas où ils sont allés. | Il y a longtemps qu'elle a quitté la maison.",
    "es": "Por favor, espere un momento. | Muchas gracias por su ayuda. | Lo siento, pero no es posible. | ¿Puede decirme algo más sobre esto? | Déjeme comprobarlo para usted. | Le responderemos muy pronto. | ¿Qué le gustaría hacer ahora? | Esta es la mejor respuesta que tengo. | Sí, claro, no hay problema. | Que tenga un buen día y hasta mañana. | No sé adónde han ido ellos. | Hace mucho tiempo que ella dejó la casa.",
}


@dataclass
class Sentence:
    start: int
    end: int
    text: str  # without codes and tags
    whole: bool  # ends by punctuation or a line end


_NOT_LINE_END = regex.compile(r"[^\n]")
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}/]+")
_BLANKS = regex.compile(r"\s+")
_HAN = regex.compile(HAN)
_TWO_HAN = regex.compile(rf"{HAN}{{2}}")
_TWO_WORDS = regex.compile(r"\p{L}{2,}[^\p{L}]+(?:\p{L}[^\p{L}]+)*\p{L}{2,}")


def _blank(m: regex.Match) -> str:
    """As many blanks as the match has characters, so that places stay."""
    return _NOT_LINE_END.sub(" ", m[0])


def prose(text: str) -> str:
    """The text with code, JSON, calls and tags blanked out; the same length."""
    if "<" in text or "```" in text:
        text = TAGS.sub(_blank, BLOCKS.sub(_blank, text))
    if "{" in text or "[" in text:
        for _ in range(8):
            shorter = BRACES.sub(_blank, text)
            if shorter == text:
                break
            text = shorter
        text = OPEN_BRACE.sub(_blank, text)
    return text


def _has_language(text: str) -> bool:
    if _HAN.search(text):
        return _NOT_WORD.sub(" ", text).strip() not in PLACEHOLDERS
    if not _TWO_WORDS.search(text):
        return False
    return len(text) > 20 or _NOT_WORD.sub(" ", text).strip().lower() not in PLACEHOLDERS


def sentences(text: str | None) -> list[Sentence]:
    """The sentences that can have a language. A last piece that breaks off counts as whole only if it is all there is."""
    if not text:
        return []
    body = prose(text)
    mixed = not body.isascii() and _TWO_HAN.search(body) is not None and LATIN_RUN.search(body) is not None
    out = []
    a = 0
    for b in [*(m.end() for m in END.finditer(body)), -1]:
        ended = b >= 0
        if not ended:
            b = len(body)
        piece = body[a:b]
        if not piece.strip():
            a = b
            continue
        # a run of Latin words inside a Chinese sentence is a part of its own, and the other way round
        parts = [(0, len(piece))]
        if mixed and _TWO_HAN.search(piece) and (runs := [m.span() for m in LATIN_RUN.finditer(piece)]):
            marks = sorted({0, len(piece), *(x for r in runs for x in r)})
            parts = list(zip(marks, marks[1:]))
        for s, e in parts:
            clean = _BLANKS.sub(" ", CODES.sub(" ", piece[s:e])).strip()
            if _has_language(clean):
                out.append(Sentence(a + s, a + e, clean, ended or e < len(piece)))
        a = b
    if len(out) == 1:
        out[0].whole = True
    return out


def lowest(table: DataFrame, key: str, n: int, group: str | None = None, groups: tuple[str, ...] = ()) -> list[Row]:
    """At most n rows (of each group): those whose keys hash lowest, in order of the hash, whatever files and tasks the table is cut into.

    A count of each group gives a bound of the hash below which little more than n rows are expected; only those are read out."""
    counts = {r[0]: r[1] for r in (table.where(F.col(group).isin(*groups)).groupBy(group).count() if group else table.agg(F.lit("").alias("g"), F.count("*"))).collect()}
    mixed = F.shiftrightunsigned(F.xxhash64(key), 2)
    bound = lambda count: min(1 << 62, int((n + 6 * n**0.5 + 10) / max(count, 1) * 2**62))
    near = F.lit(False)
    for g, count in counts.items():
        near = near | ((mixed < F.lit(bound(count))) & (F.col(group) == g if group else F.lit(True)))
    rows = sorted(table.where(near).withColumn("_mixed", mixed).collect(), key=lambda r: (r["_mixed"], str(r[key])))  # bounded
    kept: dict[object, list[Row]] = {}
    for r in rows:
        mine = kept.setdefault(r[group] if group else None, [])
        if len(mine) < n:
            mine.append(r)
    return [r for g in sorted(kept, key=str) for r in kept[g]]


def labelled(*tables: DataFrame, docs_a_language: int = 300, sentences_a_language: int = 2000) -> tuple[list[str], list[int]]:
    """A bounded sample for training from tables with text and lang, whose first column is their key: at most `sentences_a_language`
    sentences of at most `docs_a_language` labelled rows of each table for each language, and the everyday phrases.

    Some labels are wrong: sentences in a script that their label excludes are left out here, and the trainers leave
    out what contradicts a first model."""
    texts: list[str] = []
    labels: list[int] = []
    for k, lang in enumerate(LANGS):
        for phrase in EVERYDAY[lang].split("|"):
            texts += [phrase.strip()] * 3
            labels += [k] * 3
    for table in tables:
        key = table.columns[0]
        seen = dict.fromkeys(range(len(LANGS)), 0)
        for r in lowest(table.select(F.col(key).alias("key"), "lang", "text"), "key", docs_a_language, "lang", LANGS):
            k = LANGS.index(r["lang"])
            for s in sentences(r["text"]):
                fits = bool(regex.search(HAN, s.text)) == (r["lang"] == "zh")
                if s.whole and fits and len(s.text) >= 12 and seen[k] < sentences_a_language:
                    texts.append(s.text)
                    labels.append(k)
                    seen[k] += 1
    return texts, labels
