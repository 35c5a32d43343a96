from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import answers, graders, markup, scores, tensors, text
from turnwise.operators import advantage, frames, losses, rollouts, sampling, turns
from turnwise.plans import plugins


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return df.select(column.alias("x")).first().x


# ---- markup ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "want"),
    [("<continuation>\n<user>hi</user>\n</continuation>", "hi"), ("<continuation> hi </continuation>", "hi"), ("x <continuation><user>a</user></continuation> y", "a"), ("no tags", None), (None, None)],
)
def test_user_output(spark, raw, want):
    assert one(spark, markup.user_output(F.col("t").cast("string")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "content", "names"),
    [("plain", "plain", []), ('so <tool_call>f|{"a": 1}</tool_call><tool_call>g|[]</tool_call>', "so", ["f", "g"]), ("<tool_call>f|{bad</tool_call>", None, None), ("<tool_call>f", None, None), (None, "", []), ('<tool_call>f|{"a": 1} x</tool_call>', None, None)],
)
def test_assistant_output(spark, raw, content, names):
    got = one(spark, markup.assistant_output(F.col("t").cast("string")), t=raw)
    assert (got and got.content, got and [c.name for c in got.calls]) == (content, names)


def test_other_outputs(spark):
    for raw, want in (('```json\n[{"a": 1}]\n```', '[{"a": 1}]'), ("[1]", "[1]"), ('{"a": 1}', None), ("bad", None)):
        assert one(spark, markup.tool_output(F.col("t")), t=raw) == want
    g = one(spark, markup.generated_sample(F.col("t")), t="x INPUT:  USER\na \nOUTPUT: <tool_call>\n{}\n</tool_call> ")
    assert (g.input, g.output) == ("USER\na", "<tool_call>\n{}\n</tool_call>")
    g = one(spark, markup.generated_sample(F.col("t")), t="nothing")
    assert g.input is None and g.output is None
    assert not one(spark, markup.is_valid_sample(markup.generated_sample(F.col("t"))), t="INPUT: a OUTPUT: b")


def test_call_forms(spark):
    assert markup.blocks_of('{"name": "f", "arguments": {"a": "é"}}') == '<tool_call>\n{"name": "f", "arguments": {"a": "\\u00e9"}}\n</tool_call>'
    assert markup.blocks_of('[1, {"name": "g"}]') == '<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call>'
    t = "<|start|>assistant<|channel|>analysis<|message|><|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>PAD<|start|>assistant<|channel|>commentary to=functions.f.g <|constrain|>json<|message|>{bad<|call|>rest"
    assert [tuple(c) for c in one(spark, markup.channel_calls(F.col("t"), "PAD"), t=t)] == [("f.g", "{bad")] and one(spark, markup.without_channel_calls(F.col("t"), "PAD"), t=t) == "rest"
    assert markup.python_call("f", {"a": 1, "b": "x"}) == "f(a=1,b='x')"
    rows = spark.createDataFrame([(['{"name": "f", "arguments": {"a": [1]}}'],), (["bad"],), (['{"name": "f"}'],)], "x array<string>")
    assert [r[0] for r in rows.select(markup.executable_calls("x")).collect()] == [["f(a=[1])"], [], []]
    text_ = '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>bad</tool_call><tool_call>{"name": "g"}</tool_call> end'
    assert [tuple(c) for c in one(spark, markup.named_calls(F.col("t")), t=text_)] == [("f", '{"a":1}')]


def test_instructions(spark):
    assert one(spark, F.map_keys(markup.tools_map(F.col("t"))), t='x <tools>\n{"name": "a"}\nbad\n {"name": "b", "d": 1} \n{"no": 1}\n</tools>') == ["a", "b"]
    assert one(spark, F.map_keys(markup.listed_functions(F.col("t"))), t='Here is a list of functions in JSON format that you can invoke.\n[{"name": "a"}, {"name": "b"}]\n\nmore') == ["a", "b"]
    assert one(spark, markup.tools_text(F.col("t")), t="none") == ""
    assert one(spark, markup.render("{a} {b} {a} {c}", a=F.lit("1"), b=F.lit(None).cast("string"))) == "1  1 {c}"
    with pytest.raises(Exception, match="no side"):
        one(spark, markup.sides(F.lit("both_correct"), F.lit("a"), F.lit("b"))[0])


def test_chat_forms(spark):
    simple = "USER\nhello \n\nmore\n\nASSISTANT\n<tool_call>  \n{}\n </tool_call>\n\nSYSTEM\nx"
    assert one(spark, markup.from_simple_form(F.col("t"), text.tidy_tags), t=simple) == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\n<tool_call>\n{}\n</tool_call><|im_end|>\n"
    assert one(spark, text.tidy_tags(F.col("t")), t="a \t\n<tool_call>\n\n{}\n\n</tool_call> \n b ") == "a\n<tool_call>\n{}\n</tool_call>\n b"
    assert one(spark, text.without_chat_tokens(F.col("t")), t="<|im_start|>user\na<|im_end|>\n") == "a"
    rows = [("user", "q", None), ("assistant", "<think>\nt\n</think>\n\na", None), ("tool", "r", None), ("tool", "s", None), ("assistant", "b", "CALL")]
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"), F.lit(k).cast("string").alias("calls")) for r, c, k in rows])
    got = one(spark, markup.eval_prompt(m, F.lit(0), F.lit("sys")))
    assert got == (
        "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\na<|im_end|>\n<|im_start|>user\n<tool_response>\nr\n</tool_response>\n<tool_response>\ns\n</tool_response><|im_end|>\n"
        "<|im_start|>assistant\n<think>\n\n</think>\n\nb\nCALL<|im_end|>\n<|im_start|>assistant\n"
    )
    assert [tuple(p) for p in one(spark, markup.placeholder_parts(F.col("t")), t="a<image>b<video>")] == [("text", "a"), ("image", None), ("text", "b"), ("video", None)]


# ---- graders -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b", "same"), [("2x+3", "3+2x", True), ("(x+1)^2", "x^2+2x+1", True), ("\\frac{1}{3}", "0.3333333", False), ("sqrt(8)", "2*sqrt(2)", True), ("__import__('os')", "1", False), ("9**9**9**9", "1", False), ("x", "y", False), ("", "", False)])
def test_same_value(a, b, same):
    assert graders.same_value(a, b) is same


@pytest.mark.parametrize(
    ("given", "gold", "same"),
    [("1,234", "1234", True), ("5 meters", "5", True), ("(1,2)", "(1, 2)", True), ("[1,2)", "(1,2)", False), ("2/4", "1/2", False), ("7 3/4", "7+3/4", True), ("\\text{East}", "east", True), ("3.0", "3", True), ("x+x", "2x", True), ("2 million", "2*10^6", True), (None, "1", False), ("", "1", False)],
)
def test_same_answer(given, gold, same):
    assert graders.same_answer(given, gold) is same


@pytest.mark.parametrize(("given", "gold", "same"), [("50%", "0.5", True), ("0.33333", "\\frac{1}{3}", True), ("2\\pi", "6.28319", True), ("Interval.open(1, 2)", "(1,2)", True), ("1, 2", "1,2", True), ("$5", "5", True), ("101_2", "101", True), ("abc", "abd", False), ("", "5", False), ("x_", "1", False)])
def test_close_answer(given, gold, same):
    assert graders.close_answer(given, gold) is same


def test_final_and_located():
    assert graders.final_score("so\nAnswer: $\\frac12$ units", "\\frac{1}{2}") == (1.0, True, "\\frac{1}{2}") and graders.final_score("none", "7") == (-1.0, False, "[INVALID]")
    assert graders.final_score("x \\boxed{7}", "7", True)[1] and not graders.final_score("\\boxed{7}" + " " * 200, "7", True)[1]
    assert graders.located_answer("We add. The answer is 42") == (True, "42") and graders.located_answer("no digits here: none")[0] is False
    assert graders.located_score("Step 2: \\boxed{42}", "42") == (True, True, "42")
    assert answers.boxed_score("\\fbox{3}", "3") == 0.0 and answers.boxed_score("\\boxed 5$ x", "5") == 1.0 and answers.boxed_score("none", "5") == 0.0


# ---- scores ------------------------------------------------------------------------------------------------------


def test_scores(spark):
    call = lambda n: f'<tool_call>\n{{"name": "{n}", "arguments": {{}}}}\n</tool_call>'
    chat = lambda s: f"<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n{s}<|im_end|>"
    rows = spark.createDataFrame([("calls", chat(call("f")), call("f"), 9), ("calls", chat("text"), call("f"), 10), ("calls", chat("text"), "text", 12), ("numbers", "#### 1,000", "1000", 9), ("search", "<answer>The cat</answer>", "cat", 9), ("boxed", "\\boxed{1}", "1", 9), ("final", "Answer: 2", "3", 9)], "data_source string, response string, gold string, length int")
    assert [r.score for r in scores.scored(rows).collect()] == [3.0, -3.0, 3.0, 1.0, 1.0, 1.0, -1.0]
    over = scores.managed("overlong", rows, longest=12, buffer=4)
    assert [r.penalty for r in over.collect()][:3] == [-0.25, -0.5, -1.0]
    assert scores.managed("naive", rows).where("reward <> score").count() == 0
    with pytest.raises(Exception, match="no scorer"):
        scores.scored(rows.withColumn("data_source", F.lit("x"))).collect()
    with pytest.raises(ValueError):
        scores.managed("none", rows)
    many = spark.createDataFrame([("<answer>a</answer>" * 11,)], "t string")
    assert many.select(scores.search_score(F.col("t"), F.array(F.lit("a")))).first()[0] == 0.25
    assert one(spark, scores.pass_rate(F.col("r"), True), r=F.array(F.lit(True), F.lit(None).cast("boolean"))) == 0.5 and one(spark, scores.pass_rate(F.col("r")), r=F.array(F.lit(True), F.lit(True))) == 1.0


# ---- losses ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    rng = np.random.default_rng(4)
    n, t = 12, 9
    mask = (np.arange(t)[None, :] < rng.integers(2, t + 1, n)[:, None]).astype(float)
    return {"new": -rng.random((n, t)), "old": -rng.random((n, t)), "advantage": np.repeat(rng.normal(size=(n, 1)), t, axis=1), "mask": mask}


def frame(spark, x):
    n, t = x["mask"].shape
    rows = [(i, j, i * t + j, *(float(x[c][i, j]) for c in ("new", "old", "advantage", "mask"))) for i in range(n) for j in range(t)]
    return spark.createDataFrame(rows, "uid int, pos int, event_id int, new double, old double, advantage double, mask double")


def test_losses_equal_matrices(spark, tokens):
    df = frame(spark, tokens)
    new, old, a, m = (tokens[c] for c in ("new", "old", "advantage", "mask"))
    mean = lambda x: (x * m).sum() / m.sum()
    r = np.exp(new - old)
    held = np.maximum(-a * r, -a * np.clip(r, 0.8, 1.2))
    loss = lambda name, **o: losses.loss_named(name)(df, **o).first()
    assert loss("vanilla").loss == pytest.approx(mean(np.where(a < 0, np.minimum(-a * 3, held), held)))
    s = np.exp(np.minimum(((new - old) * m).sum(1) / m.sum(1), 10))[:, None]
    g = np.maximum(-a * s, -a * np.clip(s, 0.8, 1.2))
    assert loss("gspo").loss == pytest.approx(((g * m).sum(1) / m.sum(1)).mean())
    assert loss("gpg").loss == pytest.approx(mean(-new * a))
    gap = new - old
    worse = np.sign(a) * np.minimum(np.sign(a) * gap, np.sign(a) * np.clip(gap, -0.2, 0.2))
    assert loss("geo_mean").loss == pytest.approx((-(a * m).sum(1) / m.sum(1) * np.exp((worse * m).sum(1) / m.sum(1))).mean())
    cov = (a - mean(a)) * (new - mean(new))
    k = max(1, int(m.sum() * 0.1))
    top = np.sort(np.where(m > 0, cov, -np.inf).ravel())[-k]
    assert loss("kl_cov", share=0.1).loss == pytest.approx(mean(-a * r + np.where(cov >= top, np.abs(gap), 0)))
    got = loss("clip_cov", share=0.1, bounds=(-9.0, 9.0))
    assert got.clip_share == pytest.approx(k / m.sum()) and got.kl == pytest.approx(mean(-gap))
    with pytest.raises(ValueError):
        losses.loss_named("none")


def test_weights_equal_matrices(spark, tokens):
    df = frame(spark, tokens)
    new, old, m = (tokens[c] for c in ("new", "old", "mask"))
    r = np.exp(new - old)
    w = {(x.uid, x.pos): x for x in losses.importance_weights(df, "new", "old", "uid", "token", 1.5, mode="mask", mask="mask", veto=0.5).collect()}
    veto = ((new - old < np.log(0.5)) & (m > 0)).any(axis=1)
    for (i, j), x in w.items():
        inside = 1 / 1.5 <= r[i, j] <= 1.5
        assert x.weight == pytest.approx(r[i, j] if inside and m[i, j] and not veto[i] else 0) and x.vetoed == veto[i]
    rows = {x.uid: x for x in losses.importance_weights(df, "new", "old", "uid", "sequence", 1.5, mask="mask").collect()}
    assert all(x.weight == pytest.approx(min(1.5, math.exp(((new - old) * m)[i].sum()))) for i, x in rows.items())
    got = losses.weight_metrics(df, "new", "old", "uid", "mask", 1.5, veto=0.5).first()
    clipped = np.clip(r, 1 / 1.5, 1.5)
    assert got.weight_mean == pytest.approx((r * m).sum() / m.sum()) and got.vetoed_rows == pytest.approx(veto.mean())
    assert got.effective_share == pytest.approx(1 / ((((clipped / ((clipped * m).sum() / m.sum())) ** 2) * m).sum() / m.sum()))
    mm = losses.mismatch(df, "new", "old", "uid", "mask").first()
    assert mm.kl == pytest.approx(((old - new) * m).sum() / m.sum()) and mm.ppl_new == pytest.approx(np.exp(-(new * m).sum(1) / m.sum(1)).mean())


def test_control_of_divergence(spark, tokens):
    df = frame(spark, tokens).withColumn("score", F.lit(1.0))
    control = losses.kl_control("adaptive", 0.1, 0.05, 100.0)
    out, metrics = losses.with_kl_penalty(df, control)
    m, gap = tokens["mask"], tokens["new"] - tokens["old"]
    now = ((gap * m).sum(1) / m.sum(1)).mean()
    assert metrics["reward_kl_penalty"] == pytest.approx(now) and control.value == pytest.approx(0.1 * (1 + max(-0.2, min(0.2, now / 0.05 - 1)) * 12 / 100))
    assert out.where("mask = 0 AND reward <> 1.0").count() == 0
    fixed = losses.kl_control("fixed", 0.1)
    fixed.update(9.0, 5)
    assert fixed.value == 0.1
    with pytest.raises(ValueError):
        losses.kl_control("none", 0.1)


def test_whitened_recurrences(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(n).tolist(), rng.random(n).tolist(), (np.arange(n) < max(2, n - 2)).astype(float).tolist()) for i, n in enumerate((3, 7, 5, 2))]
    df = spark.createDataFrame(rows, "uid int, score array<double>, value array<double>, mask array<double>")
    got = {r.uid: r for r in advantage.reinforce_plus_plus(df, 0.9).collect()}
    want = {}
    for i, r, _, m in rows:
        run, out = 0.0, []
        for x, on in zip(reversed(r), reversed(m)):
            run = x + 0.9 * run
            out.insert(0, run)
            run *= on
        want[i] = out
    flat = np.array([x for i, _, _, m in rows for x, on in zip(want[i], m) if on])
    for i, _, _, m in rows:
        assert np.allclose(got[i].returns, want[i]) and np.allclose(got[i].advantage, (np.array(want[i]) - flat.mean()) / np.sqrt(flat.var(ddof=1) + 1e-8) * np.array(m))
    gae = {r.uid: r for r in advantage.generalized(df, 0.9, 0.8).collect()}
    assert all(len(gae[i].advantage) == len(r) and np.isfinite(gae[i].returns).all() for i, r, _, _ in rows)


# ---- arrays ------------------------------------------------------------------------------------------------------


def test_padding_and_truncation(spark):
    ids = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    ones = F.transform(ids, lambda _: F.lit(1))
    fit = lambda to, how, left=False: one(spark, tensors.fitted(ids, ones, to, 0, left, how))
    assert fit(3, "left").ids == [3, 4, 5] and fit(3, "right").ids == [1, 2, 3] and fit(3, "middle").ids == [1, 4, 5]
    assert tuple(fit(7, "error", True)) == ([0, 0, 1, 2, 3, 4, 5], [0, 0, 1, 1, 1, 1, 1])
    with pytest.raises(Exception, match="longer than 3"):
        fit(3, "error")
    with pytest.raises(ValueError):
        fit(3, "none")
    row = one(spark, tensors.supervised_row(F.array(*map(F.lit, (1, 2, 3))), F.array(F.lit(4), F.lit(5)), 7, 0))
    assert row.ids == [1, 2, 3, 4, 5, 0, 0] and row.loss_mask == [0, 0, 1, 1, 0, 0, 0]
    assert one(spark, tensors.placed_score(F.lit(2.0), F.array(*map(F.lit, (1, 1, 0))))) == [0.0, 2.0, 0.0]
    checked = one(spark, tensors.checked_concat(ids, F.array(F.array(F.lit(1), F.lit(2)), F.array(*map(F.lit, (3, 4, 5))))))
    assert checked.agrees and checked.ids == [1, 2, 3, 4, 5]
    assert one(spark, tensors.position_ids(F.array(*map(F.lit, (0, 0, 1, 1, 1))))) == [0, 0, 0, 1, 2] and one(spark, tensors.gathered(F.array(ids, ids), F.array(F.lit(0), F.lit(4)))) == [1, 5]
    assert one(spark, tensors.overlong_penalty(F.lit(90), 100, 20)) == -0.5 and one(spark, tensors.overlong_penalty(F.lit(50), 100, 20)) == 0


def test_logits(spark):
    x = np.array([0.5, -1.0, 900.0, 899.0])
    p = np.exp(x - x.max())
    p /= p.sum()
    col = F.array(*map(F.lit, x.tolist()))
    assert one(spark, tensors.entropy(col)) == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum()) and one(spark, tensors.label_logprob(col, F.lit(3))) == pytest.approx(np.log(p[3]))
    assert one(spark, tensors.nucleus(col, 0, 0.5)) == [2] and one(spark, tensors.nucleus(col, 3, 1.5)) == [0, 2, 3]


# ---- frames ------------------------------------------------------------------------------------------------------


def test_frames(spark):
    df = spark.range(10).withColumnRenamed("id", "pos").withColumn("x", (F.col("pos") * 10).cast("int"))
    assert [r.pos for r in frames.sliced(df, 1, 8, 3).collect()] == [1, 4, 7] and frames.rows_at(df, [2, 5]).count() == 2
    a, b = frames.pop_columns(df, "x")
    assert a.columns == ["pos", "x"] and b.columns == ["pos"] and frames.rename_columns(df, ["x"], ["y"]).columns == ["pos", "y"]
    for bad in (lambda: frames.select_columns(df, "z"), lambda: frames.rename_columns(df, ["x"], ["pos"]), lambda: frames.chunked(df, 3), lambda: frames.sliced(df, -1), lambda: frames.concatenated(df, meta=({"a": 1}, {"a": 2})), lambda: frames.ordered_for(df, "none")):
        with pytest.raises((KeyError, ValueError)):
            bad()
    assert frames.described(df) == [("pos", "bigint"), ("x", "int")] and frames.planned_bytes(df) > 0 and frames.common_columns(df, ["x", "q"]) == ["x"]
    assert frames.same_rows(df, df.orderBy(F.desc("pos"))) and not frames.same_rows(df, df.union(df))
    folded = frames.folded(df, 4, "x")
    assert sorted((r.pos, r.x) for r in folded.collect()) == [(0, [0, 10, 20, 30]), (1, [40, 50, 60, 70]), (2, [80, 90])]
    assert frames.appended(df, df, F.col("x") > 50).count() == 14 and frames.padded_with(df, 0).count() == 10
    epochs = frames.mini_batches(df, 4, 2, 7, drop_last=True).collect()
    assert len(epochs) == 16 and {r.batch for r in epochs} == {0, 1}
    assert [r.pos for r in frames.mini_batches(df, 4).orderBy("pos").collect()] == list(range(10))


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(4000)], "k long, s double")
    for method, share in (("pow", [0, 1 / 14, 4 / 14, 9 / 14]), ("max_min", [0.5, 0, 0, 0.5]), ("max_random", [1 / 7, 1 / 7, 1 / 7, 4 / 7])):
        got = sampling.resampled(df, "k", "s", method)
        assert got.count() == 4000 and got.select("draw").distinct().count() == 4000
        counts = {r["r"]: r["count"] / 4000 for r in got.groupBy((F.col("k") % 4).alias("r")).count().collect()}
        assert all(abs(counts.get(k, 0) - x) < 0.03 for k, x in enumerate(share))
    assert sampling.resampled(df.limit(0), "k", "s").count() == 0


# ---- rollouts and services ---------------------------------------------------------------------------------------


def answer(spark, *kinds):
    usage = lambda k: F.when(F.lit(k is not None), F.array(F.struct(F.lit(k).alias("name"), F.lit("{}").alias("parameters"))))
    xs = F.array(*[F.struct(F.lit(str(i)).alias("content"), usage(k).alias("tool_usage")) for i, k in enumerate(kinds)])
    got = one(spark, rollouts.settled_answer(xs, F.lit(0)))
    return got.verdict, got.answer and got.answer.content


def test_settled_answers(spark):
    assert answer(spark, "f") == (0, None) and answer(spark, None, None) == (1, "0") and answer(spark, "f", None) == (0, None) and answer(spark, "f", "g") == (0, None) and answer(spark, "f", "f") == (1, "0")
    assert answer(spark, None, "f", None) == (1, "0") and answer(spark, "f", None, "f") == (1, "0") and answer(spark, "f", "g", "f") == (1, "0") and answer(spark, "f", "g", "g") == (1, "2") and answer(spark, "f", "g", "h")[0] == -1


def test_rollouts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aabba")], "pos int, index string")
    assert [r.rollout for r in rollouts.ordinals(df).orderBy("pos").collect()] == [0, 1, 0, 1, 0]
    rows = spark.createDataFrame([(1.0, [1, 1, 0], 2), (None, [1], 0)], "score double, mask array<int>, length int")
    assert [r.token_scores for r in rollouts.assembled(rows).collect()] == [None, None] and rollouts.not_aborted(rows).count() == 1
    assert rollouts.assembled(rows.limit(1)).first().token_scores == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        rollouts.not_aborted(rows.where("length = 0"))
    p, r = rollouts.lengths(F.array(*map(F.lit, (0, 1, 1, 1, 0))), F.array(F.lit(7), F.lit(8)))
    assert (one(spark, p), one(spark, r)) == (2.0, 1.0)


def test_patience_and_limits():
    asked, slept = [], []

    def flaky(prompts):
        asked.append(prompts)
        if len(asked) < 3:
            raise ConnectionError
        return ["ok"]

    assert plugins.patient(flaky, 5, 1.0, slept.append)(["p"]) == ["ok"] and slept == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        plugins.patient(lambda p: 1 / 0, 2, 0.0)(["p"])
    now = [0.0]
    ask = plugins.limited(lambda p: p, 2.0, lambda: now[0], lambda s: slept.append(s))
    ask(["a", "b"])
    ask(["c"])
    assert slept[-1] == 0.5
    import time

    assert plugins.timed(lambda: time.sleep(5), 0.05, "late")() == "late" and plugins.timed(lambda x: x + 1, 5)(1) == 2
    turn = plugins.spread_over(lambda p: ["a"], lambda p: ["b"])
    assert [turn([""])[0] for _ in range(3)] == ["a", "b", "a"]


def test_registries_and_loops(spark, tmp_path):
    with pytest.raises(ValueError):
        plugins.PARSERS.named("none")
    with pytest.raises(ValueError):
        plugins.PARSERS.register("tags")(lambda c: c)
    (tmp_path / "r.py").write_text("def mine(x):\n    return x * 2\n")
    assert plugins.function_from(str(tmp_path / "r.py"), "mine")(4) == 8
    with pytest.raises(AttributeError):
        plugins.function_from(str(tmp_path / "r.py"), "other")

    def generate(prompts):
        return ["done"] if "<tool_response>" in prompts[0] else ['<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>\n<tool_call>\nbad\n</tool_call>']

    df = spark.createDataFrame([(1, "go"), (2, None)], "k long, p string")
    got = {r.k: r for r in plugins.run_loops(df, generate, [{"schema": {"name": "f"}}], "p", "k").collect()}
    assert got[1].turns == 2 and got[1].calls == 2 and 0 in got[1].mask and got[1].mask[-1] == 1 and "error: JSONDecodeError" in got[1].text
    assert json.loads(got[1].text.split("<tool_response>\n")[1].split("\n")[0]) == {"arguments": {"a": 1}, "name": "f"}
    assert [plugins.agent_loop(generate, {}, "go", "1", most_turns=1)["turns"], plugins.agent_loop(generate, {}, "go", "1", most_words=5)["turns"]] == [1, 1]
    fixed = plugins.repaired(spark.createDataFrame([("bad",), ("good",)], "t string"), lambda ps: ["good" for _ in ps], "t", lambda c: c == "good")
    assert [r.t for r in fixed.collect()] == ["good", "good"]
    spread = plugins.dispatched(spark.range(10).withColumnRenamed("id", "pos"), 2, lambda bs: bs, "pos long")
    assert spread.count() == 10 and one(spark, plugins.length_budget(F.lit(10), 100)) == 88 and one(spark, plugins.length_budget(F.lit(99), 100)) == 1000


def test_new_turn_validity(spark):
    schema = "cid long, tools array<struct<name:string>>, curr_messages array<struct<role:string,content:string,tool_usage:array<struct<name:string,parameters:string>>,tool_response:array<struct<name:string,results:string>>>>"
    m = [("user", "q", None, None), ("assistant", "", [("f", "{}")], None), ("tool", None, None, [("f", "1")]), ("assistant", "", [("g", "{}")], None), ("tool", None, None, [("f", "1")]), ("user", "x", None, None)]
    df = spark.createDataFrame([(1, [("f",)], m)], schema)
    assert [r.valid for r in turns.new_turn_validity(df).orderBy("pos").collect()] == [True, True, False, False, True]


# ---- the loop ----------------------------------------------------------------------------------------------------


def test_data_loop(spark):
    from turnwise.plans import loop

    call = lambda n, a="{}": f'<tool_call>\n{{"name": "{n}", "arguments": {a}}}\n</tool_call>'
    instruction = 'The current time is 2024-05-06.\n<tools>\n{"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}, "required": []}}\n{"name": "g", "parameters": {"properties": {}, "required": []}}\n</tools>'
    rows = [(1, call("f"), call("f")), (2, "plain", "other"), (3, call("f", '{"a": 1}'), call("f", '{"a": 1.0}')), (4, call("f"), call("g")), (5, call("g"), call("f"))]
    samples = spark.createDataFrame([(k, instruction, f"q{k}", o, r) for k, o, r in rows], "id long, instruction string, input string, output string, response string")
    asked = []

    def judge(prompts):
        asked.extend(prompts)
        return ["RESPONSE1_INCORRECT" if "q5" in p else "RESPONSE2_INCORRECT. Error Analysis: wrong tool" for p in prompts]

    got = {r.id: r for r in loop.verified(samples, [judge, judge, lambda ps: ["?" for _ in ps]]).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "both_correct", 2: "not_function_call", 3: "both_correct", 4: "model_incorrect", 5: "original_incorrect"}
    assert got[4].consensus and got[4].votes == ["RESPONSE2", "RESPONSE2", "UNKNOWN"] and got[4].error_message == "Error Analysis: wrong tool" and got[1].votes is None
    s = loop.verification_summary(loop.verified(samples, [judge, judge])).first()
    assert (s.errors, s.agreed, s.rate) == (2, 2, 1.0)
    verified = loop.verified(samples, [judge, judge])
    new = loop.expanded(verified, lambda ps: ["INPUT: USER\nnew OUTPUT: <tool_call>\n{}\n </tool_call>" if "q4" in p else "no sample" for p in ps], "id", 2).collect()
    assert len(new) == 2 and {r.original_sample.id for r in new} == {4} and new[0].input == "<|im_start|>user\nnew<|im_end|>\n" and new[0].output == "<tool_call>\n{}\n</tool_call>"
    checks = spark.createDataFrame([(1, instruction, "q", call("f", '{"a": 1}')), (2, instruction, "q", call("h")), (3, instruction, "q", "text"), (4, instruction, "q", call("f", '{"a": "x"}')), (5, instruction, "r", call("g"))], "id long, instruction string, input string, output string")
    verdict = lambda ps: ["INCORRECT. Error Analysis: no" if "\nr\n" in p else "CORRECT" for p in ps]
    out = {r.id: (r.status, r.error_message) for r in loop.filtered(checks, [verdict, verdict, lambda ps: ["?" for _ in ps]], "id").collect()}
    assert out == {1: ("correct", ""), 2: ("rule_violation", "unknown_tool"), 3: ("not_function_call", ""), 4: ("rule_violation", "wrong_type"), 5: ("incorrect", "Error Analysis: no")}
    split = {r.id: r.status for r in loop.filtered(checks, [verdict, lambda ps: ["?" for _ in ps]], "id").collect()}
    assert split[1] == "correct_no_consensus"


def test_tokens_of_prompts(spark):
    from turnwise.plans import loop

    df = spark.createDataFrame([("one three", 7), (None, None)], "p string, i int").withColumn("extra_info", F.struct(F.col("i").alias("index")))
    got = loop.prompt_rows(df, "p", 3).collect()
    assert (got[0].ids, got[0].mask, got[0].places, got[0]["index"]) == ([0, 3, 5], [0, 1, 1], [0, 0, 1], 7) and got[1].ids is None and got[1]["index"] == 0
    parts = loop.message_ids(spark.createDataFrame([(["a", "a bb", "a bb ccc d"],)], "x array<string>"), "x").first().parts
    assert parts == [[1], [2], [3, 1]]
    assert loop.probed(spark.createDataFrame([("q",)], "input string"), lambda ps: ["<think>why</think>\nso"]).first()[1:] == ("why", "so")


def test_curriculum_and_growth(spark, tmp_path):
    from turnwise.streaming import growth

    w = growth.AdaptiveWeights()
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "g string, s double")
    w.update(df, "g", "s")
    assert {r.g: r.weight for r in w.weighted(df.union(df.selectExpr("'c'", "s")), "g").collect()} == {"a": 0.5, "b": 1.0, "c": 1.0}
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = growth.grow(stream, lambda b: b.selectExpr("id", "id * 2 AS twice"), str(tmp_path / "out"), str(tmp_path / "state"), F.col("twice") < 8)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.twice for r in growth.grown(spark, str(tmp_path / "out"), "twice").collect()) == [0, 2, 4, 6]
    q = growth.reports(spark.readStream.schema("id long").parquet(str(tmp_path / "in")).withColumn("status", F.col("id") % 2), "status", str(tmp_path / "rep"), str(tmp_path / "state2"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert {r.status: r.n for r in spark.read.parquet(str(tmp_path / "rep")).collect()} == {0: 3, 1: 3}


def test_reductions(spark):
    from turnwise.operators import metrics
    from turnwise.plans import loop

    df = spark.createDataFrame([(1.0, 1.0), (3.0, 0.0), (5.0, 1.0)], "x double, m double")
    r = metrics.all_reduced(df, "x").first()
    assert (r.mean, r.high, r.low) == (3.0, 5.0, 1.0) and r.std == pytest.approx(np.std([1, 3, 5])) and metrics.masked_reduced(df, "x", "m").first().mean == 3.0
    styles = spark.createDataFrame([("rule",), ("model",), (None,)], "style string").select(F.struct("style").alias("reward_model"))
    assert loop.rule_rows(styles).count() == 2
