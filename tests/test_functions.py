from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwise.functions import answers, calls, text
from turnwise.operators import advantage, batches, dedup, frames, losses, metrics, rollouts, sampling, turns

LEAVES = st.one_of(st.booleans(), st.integers(-3, 3), st.floats(-3, 3, allow_nan=False), st.sampled_from(["a", "b", ""]))
VALUES = st.recursive(LEAVES, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("xyz"), x, max_size=3)), max_leaves=8)


def frozen(v):
    """The model of equality: unordered, without repetition; numbers by value."""
    if isinstance(v, dict):
        return frozenset((k, frozen(x)) for k, x in v.items())
    return frozenset(map(frozen, v)) if isinstance(v, list) else v


@settings(max_examples=300, deadline=None)
@given(VALUES, VALUES)
def test_canonical_form_is_the_equality(a, b):
    assert (calls.canonical(a) == calls.canonical(b)) == (frozen(a) == frozen(b))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [('{"a": [1, 2]}', '{"a": [2, 1]}', True), ('{"a": 1}', '{"a": true}', True), ('{"a": 1.0}', '{"a": 1}', True), ('{"a": {}}', '{"a": []}', True), ("{bad", "{bad", True), ("{bad", "{worse", False)],
)
def test_canonical_cases(a, b, same):
    assert (calls.canonical_text(a) == calls.canonical_text(b)) is same


def test_call_lists(spark):
    rows = spark.createDataFrame([(["f", "f", "g"], ["f", "g", "g"]), (["f", "f"], ["f"]), (["f", "g"], ["f", "h"]), ([], [])], "a array<string>, b array<string>")
    got = rows.select(calls.same_calls(F.col("a"), F.col("b")).alias("e"), calls.prefix_reward(F.col("a"), F.col("b")).alias("p"), calls.multiset_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.e for r in got] == [True, False, False, True]
    assert [round(r.p, 4) for r in got] == [round(1 / 3, 4), 0.5, 0.5, 0.0]
    assert [round(r.j, 4) for r in got] == [0.5, 0.5, round(1 / 3, 4), 1.0]


def test_types():
    assert calls.type_fits(True, "integer") and not calls.type_fits(1.0, "Integer") and calls.type_fits("x", "colour") and not calls.type_fits([], "object")


def test_format_reward(spark):
    call, said = "<tool_call>\n{}\n</tool_call>", "<response>b</response>"
    good = f"<think>a</think>\n{call}"
    cases = [(good, call, 1.0), (good, said, 0.0), (f"<think>a</think>\n{said}", said, 1.0), (good + good, call, 0.0), ("", call, 0.0), (f"{good}\n{said}", call + said, 1.0), (f"{good} tail", call, 0.0), ("<think>a</think>", "x", 1.0), (f"{good}\n", call, 1.0)]
    rows = spark.createDataFrame(cases, "t string, l string, want double")
    assert all(r[0] == r[1] for r in rows.select(calls.format_reward(F.col("t"), F.col("l")), "want").collect())


def test_length_reward(spark):
    cases = [("no thought " * 99, 0.0), ("<think>" + "w " * 256 + "</think> x", 0.5), ("<think>" + "w " * 999 + "</think>", 1.0), ("<think>a</think><think>" + "w " * 128 + "</think>", 0.25), ("<think>", 0.0)]
    rows = spark.createDataFrame(cases, "t string, want double")
    assert all(float(r[0]) == r[1] for r in rows.select(calls.length_reward(F.col("t")), "want").collect())


def test_text_scalars(spark):
    row = spark.createDataFrame([("<think>why</think>\n\nso\n", "no tags", "a <cot>b</cot> c ", "x <answer> 1 </answer><answer> 2 </answer>", "it is #### 1,234 or #### 5", None)], "a string, b string, c string, d string, e string, n string")
    got = row.select(
        text.thought(F.col("a")), text.after_thought(F.col("a")), text.after_thought(F.col("b")), text.after_cot(F.col("c")), text.last_answer(F.col("d")), text.final_number(F.col("e")), text.thought(F.col("n")), text.date_in(F.lit("Today is 2024-05-06, Monday")), text.date_in(F.lit("Today is 05/06/2024")), text.date_in(F.lit("on 2024-05-06")), text.date_in(F.lit("Today is 2024-05-06"), "verify"), text.date_in(F.lit("none"), "filter")
    ).first()
    assert list(got) == ["why", "so", "no tags", "c", "2", "5", None, "2024-05-06", "05/06/2024", "2024-04-14", "Unknown", None]


def test_normalizers():
    assert text.plain_text(" Ａｂ，\u2019x… \u00a0€5 ±1→ ") == "Ab,'x...  EUR5 +/-1->" and text.plain_text("“x”", False) == '"x"' and text.plain_text("“x”") == "“x”"
    assert text.plain_text("\u00e9中😀") == "e\u0301" and text.plain_text("中😀", False) == "中😀"
    assert text.plain_text("") == "" and text.plain_text("a\x00\u200b\tb") == "a\tb"
    assert text.plain_leaves({"ｋ": ["ｖ", 1, None, {"x": "。"}]}) == {"ｋ": ["v", 1, None, {"x": "."}]}


def test_answer_matching(spark):
    row = spark.createDataFrame([("The  Cat!", ["a cat", "dog"]), ("the cat sat", ["cat"]), ("", [])], "a string, g array<string>")
    got = row.select(text.exact_match(F.col("a"), F.col("g")), text.contains_match(F.col("a"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False)]


@pytest.mark.parametrize(("a", "b", "same"), [("\\dfrac12", "\\frac{1}{2}", True), ("0.5", "1/2", True), ("1,000", "1000", False), ("\\frac1{72}", "\\frac{1}{72}", True), (".5", "0.5", True), ("\\\\frac{1}2", "\\\\frac{1}{2}", False), ("\\sqrt2", "\\sqrt{2}", True), ("x=3", "3", True), ("3", "4", False), ("5\\text{ cm}", "5", True), (None, None, True), (None, "1", False)])
def test_same_math(a, b, same):
    assert answers.same_math(a, b) is same


def test_boxed():
    assert answers.last_boxed("\\boxed{1} and \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert answers.last_boxed("none") is None and answers.last_boxed("\\boxed{1") is None


def test_call_syntax():
    assert answers.call_syntax("f(a=1), g.h(b=[2])") == [{"f": {"a": 1}}, {"g.h": {"b": [2]}}]
    assert answers.call_syntax("f(a=__import__('os'))") == [] and answers.call_syntax("][") == []


def test_advantages_of_small_groups(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 5), (2, 1, 1.0, 5), (2, 2, 0.0, 5), (3, 1, 3.0, 1), (3, 2, 1.0, 1), (3, 3, 2.0, 1)], "uid long, pos int, score double, length int")
    of = lambda name: [round(r.advantage, 4) if r.advantage is not None else None for r in advantage.estimate(name, rows).orderBy("uid", "pos").collect()]
    assert of("grpo")[:3] == [2.0, 0.7071, -0.7071]
    assert of("rloo")[:3] == [2.0, 1.0, -1.0] and of("rloo_vectorized")[0] == 0.0
    assert of("pass_at_k") == [None, round(1 / (math.sqrt(0.5) + 1e-6), 4), 0.0, round(1 / (1 + 1e-6), 4), 0.0, 0.0]
    with pytest.raises(ValueError):
        advantage.estimate("none", rows)


def test_recurrences(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5], [1.0, 1.0, 1.0])], "r array<double>, v array<double>, m array<double>")
    got = row.select(advantage.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("d"), advantage.generalized_advantages(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g")).first()
    assert got.d == [2.75, 3.5, 3.0]
    want, nxt, last = [], 0.0, 0.0
    for r, v in reversed(list(zip([1.0, 2.0, 3.0], [0.5] * 3))):
        last = r + 0.9 * nxt - v + 0.9 * 0.8 * last
        nxt = v
        want.insert(0, last)
    assert np.allclose(got.g, want)


def test_eos_mask(spark):
    for tokens, ends, want in (([20, 10, 34, 1, 0, 0, 0], 1, [1, 1, 1, 1, 0, 0, 0]), ([78, 0, 76, 2, 1, 0, 0], 1, [1, 1, 1, 1, 1, 0, 0])):
        rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "uid int, pos int, token int")
        assert [r.mask for r in advantage.response_mask(rows, end=ends).orderBy("pos").collect()] == want


def test_reduce_by_name(spark):
    rows = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)], "metric string, value double")
    assert {r.metric: r.value for r in metrics.reduce_by_name(rows).collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}


def test_bootstrap_bounds():
    out = metrics.bootstrap([0.0, 1.0, 0.5], ["a", "b", "a"], 2)
    assert 0 <= out["worst"] <= out["majority"] <= out["best"] <= 1
    assert metrics.bootstrap([0.3], ["a"], 4) == {k: pytest.approx(0.3) for k in ("best", "worst", "majority")}


def validated(values, labels):
    """The rule, one draw after the other."""
    out, size = {f"mean@{len(values)}": np.mean(values)}, len(values)
    if size > 1:
        out[f"std@{size}"] = np.std(values)
        for n in sorted({2**k for k in range(1, 10) if 2**k < size} | {size}):
            np.random.seed(42)
            kept = {"best": [], "worst": [], "maj": []}
            for _ in range(1000):
                at = np.random.choice(size, size=n, replace=True).tolist()
                drawn, votes = [values[i] for i in at], [labels[i] for i in at]
                kept["best"].append(max(drawn))
                kept["worst"].append(min(drawn))
                kept["maj"].append(drawn[votes.index(max(dict.fromkeys(votes), key=votes.count))])
            out |= {f"{k}@{n}/{f.__name__}": f(x) for k, x in kept.items() for f in (np.mean, np.std)}
    return out


def test_validation_has_every_size_and_deviation(spark):
    rng = np.random.default_rng(3)
    groups = {f"u{n}": [(float(x), "abc"[int(y)]) for x, y in sorted(zip(rng.random(n).round(3), rng.integers(0, 3, n)))] for n in (1, 2, 3, 7, 16, 17, 40)}
    groups["v3"] = [(0.1, "a"), (0.2, "b"), (0.9, "b")]
    df = spark.createDataFrame([("s", u, x, y) for u, xs in groups.items() for x, y in xs], "source string, uid string, v double, l string")
    want = {}
    for xs in groups.values():
        for k, x in validated([v for v, _ in xs], [y for _, y in xs]).items():
            want.setdefault(k, []).append(x)
    got = {r.metric: r.value for r in metrics.validation(df, "source", "uid", "v", "l").collect()}
    assert got == {k: pytest.approx(np.mean(x)) for k, x in want.items()}
    assert {"mean@1", "std@3", "best@3/mean", "maj@7/std", "worst@32/mean", "best@40/std"} <= set(got) and "std@1" not in got


def test_draws_are_the_same_in_blocks():
    whole = np.random.RandomState(42).choice(9, (50, 7), replace=True)
    assert (np.concatenate(list(metrics._draws(9, 7, 50, 42, most=20))) == whole).all()


def test_difficulty(spark):
    rows = spark.createDataFrame([([-1.0, -1.0, 0.0, 0.0],), ([],)], "x array<double>")
    m, _, p = metrics.difficulty(F.col("x"))
    got = rows.select(m.alias("m"), p.alias("p")).collect()
    assert got[0].m == -0.5 and abs(got[0].p - math.exp(0.5)) < 1e-9 and got[1].m is None and got[1].p is None


def test_adaptive_kl():
    assert losses.adaptive_kl(0.1, 100.0, 1.0, 100, 10) == pytest.approx(0.102)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_covers_all_rows(lengths, k):
    parts = batches.differencing(lengths, k)
    assert len(parts) == k and sorted(itertools.chain(*parts)) == list(range(len(lengths)))
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= max(lengths)


def test_differencing_equal_sizes():
    parts = batches.differencing([9, 8, 7, 3, 2, 1], 3, equal=True)
    assert {len(p) for p in parts} == {2}
    with pytest.raises(ValueError):
        batches.differencing([1, 2, 3], 2, equal=True)


def test_checked_parts():
    assert sorted(i for p in batches.checked_parts([3, 1, 2, 9], 2) for i in p) == [0, 1, 2, 3]
    for bad in (([1], 2, False), ([1, 2, 3], 2, True)):
        with pytest.raises(ValueError):
            batches.checked_parts(*bad)


def test_padding(spark):
    rows = spark.range(5).withColumnRenamed("id", "pos")
    padded = batches.pad_to_divisor(rows, 4)
    assert padded.count() == 8 and batches.unpad(padded).count() == 5
    assert batches.pad_to_divisor(rows.limit(0), 4).count() == 0
    got = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>").select(batches.pad_array(F.col("x"), 4, 0).alias("r"), batches.pad_array(F.col("x"), 2, 0, left=True).alias("l")).collect()
    assert (got[0].r, got[0].l, got[1].r) == ([1, 2, 3, 0], [2, 3], [0, 0, 0, 0])


def test_numbered_is_dense_on_a_large_table(spark):
    wide = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(1_000_000, numPartitions=8).select(((F.col("id") * 7919) % 1_000_003).alias("k"))
        got = batches.numbered(rows, "k").agg(F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.corr("k", "pos")).first()
        assert got[:3] == (1_000_000, 0, 999_999) and got[3] > 0.999999
        assert {r["split"]: r["count"] for r in sampling.train_test(rows, "k").groupBy("split").count().collect()} == {"train": 980_000, "test": 20_000}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).distinct()
    got = [r.pos for r in batches.numbered(rows, "k").orderBy("k").collect()]
    assert got == list(range(len(got)))


def test_keep_longest_is_the_fold(spark):
    cases = [x for n in range(1, 5) for x in itertools.product([(v, k) for v in (True, False) for k in (0, 1, 2)], repeat=n)]
    data, want = [], {}
    for c, case in enumerate(cases):
        keep = 0
        for i, (good, n) in enumerate(case):
            if i and good and n >= case[keep][1]:
                keep = i
        want[c] = keep
        data += [(c, i, good, n) for i, (good, n) in enumerate(case)]
    rows = spark.createDataFrame(data, "cid long, snapshot_id long, valid boolean, n int")
    assert {r.cid: r.kept for r in dedup.keep_longest(rows, length=F.col("n")).collect()} == want


def messages(*roles):
    return [(r, "x", None, None) for r in roles]


DIALOGUE = "cid long, curr_messages array<struct<role:string,content:string,tool_usage:array<struct<name:string,parameters:string>>,tool_response:array<struct<name:string,results:string>>>>"


def test_history_window(spark):
    row = spark.createDataFrame([(1, messages("assistant", "user", "assistant", "user", "assistant"))], DIALOGUE)
    by = lambda n: {r.pos: r.n_history for r in turns.history_samples(row, n).collect()}
    assert by(2)[4] == 4 and by(1)[4] == 1 and by(1)[2] == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DIALOGUE + ", valid boolean, possible_wrong_turns array<int>")
    assert turns.history_samples(none).count() == turns.turn_buckets(none).count() == turns.loss_masks(none).count() == 0
