"""Array math of token rows: padding, truncation, masks, logits and schedules, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(xs: Column, start: float, f) -> Column:  # noqa: ANN001
    return F.aggregate(xs, F.lit(start), f)


def total(xs: Column) -> Column:
    return _fold(F.transform(xs, lambda x: x.cast("double")), 0.0, lambda a, x: a + x)


# ---- logits ------------------------------------------------------------------------------------------------------


def log_sum_exp(logits: Column) -> Column:
    """Held by the largest logit, so that nothing overflows."""
    top = F.array_max(logits).cast("double")
    return top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))


def entropy(logits: Column) -> Column:
    """Of the distribution that an array of logits gives."""
    norm = log_sum_exp(logits)
    return norm - total(F.transform(logits, lambda x: x * F.exp(x - norm)))


def label_logprob(logits: Column, label: Column) -> Column:
    """Log-probability of the label (from 0); null outside the array."""
    return F.get(logits, label) - log_sum_exp(logits)


def gathered(values: Column, labels: Column) -> Column:
    """For arrays of arrays: the value at each place's label."""
    return F.zip_with(values, labels, lambda v, k: F.get(v, k))


def response_part(values: Column, length: Column) -> Column:
    """The last `length` elements: mask or log-probabilities of the response."""
    return F.slice(values, F.size(values) - length + 1, length)


def held(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


# ---- padding and truncation --------------------------------------------------------------------------------------


def padded(values: Column, to: int, fill: object, left: bool = False) -> Column:
    """An array brought to at least one length; longer ones stay as they are."""
    padding = F.array_repeat(F.lit(fill), F.greatest(F.lit(to) - F.size(values), F.lit(0)))
    return F.concat(padding, values) if left else F.concat(values, padding)


def fitted(ids: Column, mask: Column, to: int, fill: int, left: bool = True, truncation: str = "error") -> Column:
    """ids and mask of exactly one length: padded at one side, or cut: left and right keep the other end, middle keeps both ends, error raises."""

    def cut(x: Column) -> Column:
        n = F.size(x)
        if truncation == "left":
            return F.slice(x, F.greatest(n - to + 1, F.lit(1)), F.lit(to))
        if truncation == "right":
            return F.slice(x, 1, to)
        if truncation == "middle":
            head = to // 2
            return F.when(n > to, F.concat(F.slice(x, 1, head) if head else F.array().cast("array<int>"), F.slice(x, n - (to - head) + 1, F.lit(to - head)))).otherwise(x)
        if truncation == "error":
            return F.when(n > to, F.raise_error(F.lit(f"longer than {to}")).cast("array<int>")).otherwise(x)
        raise ValueError(f"no truncation {truncation}")

    return F.struct(padded(cut(ids), to, fill, left).alias("ids"), padded(cut(mask), to, 0, left).alias("mask"))


def without_padding(ids: Column, mask: Column) -> Column:
    return F.filter(ids, lambda x, i: F.get(mask, i) == 1)


def left_truncated(ids: Column, longest: int, reserve: int = 1024) -> Column:
    """The last `longest - reserve` tokens of a prompt; shorter prompts stay whole."""
    room = max(longest - reserve, 0)
    return F.when(F.size(ids) > room, F.slice(ids, F.size(ids) - room + 1, room) if room else F.array().cast("array<int>")).otherwise(ids)


def position_ids(mask: Column) -> Column:
    """Running places of the masked tokens from 0; places before the first count 0."""
    return F.transform(mask, lambda _, i: F.greatest(F.lit(0), F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1))


def running_lengths(lengths: Column) -> Column:
    """0 and the running sums of an array of lengths: where each sequence starts in a packed row."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.cast("int"))))


# ---- training rows -----------------------------------------------------------------------------------------------


def supervised_row(prompt: Column, response: Column, to: int, fill: int, truncation: str = "error") -> Column:
    """ids, mask, loss_mask of a prompt and its response: the loss counts from the prompt's last token to the last but one of the whole."""
    ids = F.concat(prompt, response)
    ones = F.transform(ids, lambda _: F.lit(1))
    n, p = F.size(ids), F.size(prompt)
    both = fitted(ids, ones, to, fill, False, truncation)
    loss = F.transform(both["mask"], lambda m, i: F.when(((p > 1) & (i < p - 1)) | (i == F.least(n, F.lit(to)) - 1), 0).otherwise(m))
    return F.struct(both["ids"].alias("ids"), both["mask"].alias("mask"), loss.alias("loss_mask"))


def dialogue_row(messages: Column, prompt_tokens: int = 0) -> Column:
    """ids and loss_mask of messages (role, ids, and loss_mask as an override or null): 1 for the tokens of assistant messages but for their first `prompt_tokens`."""
    ids = F.flatten(F.transform(messages, lambda m: m["ids"]))
    own = lambda m: F.when(m["role"] == "assistant", 1).otherwise(0)
    mask = F.flatten(F.transform(messages, lambda m: F.transform(m["ids"], lambda _, i: F.when(i < F.when(m["role"] == "assistant", prompt_tokens).otherwise(0), 0).otherwise(F.coalesce(m["loss_mask"], own(m))))))
    return F.struct(ids.alias("ids"), mask.alias("loss_mask"))


def checked_concat(whole: Column, parts: Column) -> Column:
    """ids and agrees: the concatenation of the parts, and whether the whole was encoded alike."""
    joined = F.flatten(parts)
    return F.struct(joined.alias("ids"), (joined == whole).alias("agrees"))


def preference_pair(chosen: Column, rejected: Column, to: int, fill: int) -> Column:
    """Two rows of ids and mask of one length, the chosen one first; longer ones are cut at the right."""
    ones = lambda x: F.transform(x, lambda _: F.lit(1))
    return F.array(fitted(chosen, ones(chosen), to, fill, False, "right"), fitted(rejected, ones(rejected), to, fill, False, "right"))


def placed_score(score: Column, mask: Column) -> Column:
    """A row's score at its last valid token, 0 elsewhere."""
    last = total(mask).cast("int") - 1
    return F.transform(mask, lambda _, i: F.when(i == last, score.cast("double")).otherwise(0.0))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to the buffer before the longest length, then linearly down."""
    return F.least(-(length - (longest - buffer)) / F.lit(buffer) * factor, F.lit(0.0))


def mismatched(a: Column, b: Column, mask: Column) -> Column:
    """Masked places at which two token rows differ."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda z: (z["m"] > 0) & ~z["a"].eqNullSafe(z["b"])))


# ---- schedules ---------------------------------------------------------------------------------------------------


def cosine_rate(step: Column, warmup: int, steps: int, lowest: float = 0.0, cycles: float = 0.5, start: float = 0.0) -> Column:
    """Share of the learning rate: linear from `start` to 1 over the warm-up, then a cosine down to the lowest share."""
    up = F.lit(start) + (1 - start) * step / F.lit(max(1, warmup))
    progress = (step - warmup) / F.lit(max(1, steps - warmup))
    wave = F.cos(F.lit(math.pi * cycles * 2) * progress) * ((1 - lowest) / 2) + (1 + lowest) / 2
    return F.when(step < warmup, up).otherwise(F.greatest(F.lit(lowest), wave))


def constant_rate(step: Column, warmup: int) -> Column:
    return F.when(step < warmup, step / F.lit(max(1.0, float(warmup)))).otherwise(F.lit(1.0))


def stable_rate(step: Column, warmup: int, steps: int, stable: float = 0.9, lowest: float = 0.0, cycles: float = 0.5) -> Column:
    """Warm-up, then 1 for the stable share of the rest, then a cosine down to the lowest share."""
    edge = warmup + int((steps - warmup) * stable)
    progress = (step - edge) / F.lit(max(1, steps - edge))
    return F.when(step < warmup, step / F.lit(max(1, warmup))).when(step < edge, 1.0).when(step < steps, lowest + (1 - lowest) * F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi * cycles * 2) * progress)))).otherwise(F.lit(lowest))


def nucleus(logits: Column, k: int = 0, p: float = 1.0) -> Column:
    """Places (from 0) that a filter keeps: the k largest logits (0: all), then the fewest largest whose probability reaches p."""
    norm = log_sum_exp(logits)
    ranked = F.reverse(F.array_sort(F.transform(logits, lambda x, i: F.struct(x.cast("double").alias("x"), (-i).alias("i")))))
    top = F.slice(ranked, 1, k) if k else ranked
    kept = F.aggregate(
        top, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("out")),
        lambda a, z: F.struct((a["s"] + F.exp(z["x"] - norm)).alias("s"), F.when(a["s"] < p, F.concat(a["out"], F.array((-z["i"]).cast("int")))).otherwise(a["out"]).alias("out")),
    )["out"]
    return F.array_sort(kept)
