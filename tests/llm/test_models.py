from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL

from turnwise.llm import language, pairs, repetition, sentences
from turnwise.sources.tables import table

MESSAGE = "struct<role:string,content:string,tool_usage:array<struct<name:string,parameters:string>>,tool_response:array<struct<name:string,results:string>>>"
DIALOGUE = f"cid long, curr_messages array<{MESSAGE}>, is_en boolean, possible_wrong_turns array<int>, turn_no string, content int, m string, lang int"


def dialogue(cid, *messages, is_en=None, wrong=None):
    return (cid, [None if m is None else (m[0], m[1], m[2] if len(m) > 2 else None, None) for m in messages], is_en, wrong, "t", 1, "m", 2)


@pytest.fixture(scope="module")
def texts(spark):
    return table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents"), table(spark, SMALL, "eval_items")


def test_sentences():
    got = sentences.sentences('Hello there, my friend. <tool_call>f|{"a": "some text here"}</tool_call>\n- 919-2245: 407\nWas würde das kosten? 我查了天气。 And the')
    assert [s.text for s in got] == ["Hello there, my friend.", "Was würde das kosten?", "我查了天气。", "And the"] and [s.whole for s in got] == [True, True, True, False]
    assert sentences.sentences("vor dem 02.01.2024 weglassen")[0].whole
    assert [s.text for s in sentences.sentences("请帮我查一下栖朔桥在2025年1月27日的花粉指数。编号是C2134CY。")] == ["请帮我查一下栖朔桥在 年 月 日的花粉指数。", "编号是 。"]
    assert all(not sentences.sentences(x) for x in (None, "", "n/a", "null", "{}", "12:30", "<response></response>", "x9 K123", "..."))
    assert len(sentences.prose("a {b} <c> ```d``` e")) == len("a {b} <c> ```d``` e")


def test_language_accuracy_on_held_out_sentences(spark, texts):
    xs, ys = sentences.labelled(*texts)
    order = np.random.default_rng(0).permutation(len(xs))
    train, held = order[: len(xs) * 4 // 5], order[len(xs) * 4 // 5 :]
    net = language.fit([xs[i] for i in train], [ys[i] for i in train])
    p = net.probabilities([xs[i] for i in held]).argmax(axis=1)
    assert (p == np.array(ys)[held]).mean() > 0.95  # some labels are wrong
    bayes = pairs.fit_bayes([xs[i] for i in train], [ys[i] for i in train])
    assert (bayes.posteriors([xs[i] for i in held]).argmax(axis=1) == np.array(ys)[held]).mean() > 0.95


def test_language_of_messages(spark, texts):
    rows = [
        dialogue(1, ("user", "Could you please check the weather for tomorrow? 请帮我查一下明天的天气。"), ("assistant", None), ("assistant", ""), None, ("tool", "{}"), is_en=True),
        dialogue(2, ("user", "Ich brauche bitte einen Platz im Zug, vielen Dank für Ihre Hilfe."), is_en=False), dialogue(3, ("user", "n/a")), dialogue(4, is_en=True), (5, None, None, None, "t", 1, "m", 2), (None, [("user", "Hello my friend.", None, None)], None, None, "t", 1, "m", 2),
        dialogue(6, ("user", "Thank you very much for your help. " * 2000), is_en=False),
    ]
    df = spark.createDataFrame(rows, DIALOGUE)
    found = {tuple(r) for r in language.found(df, *texts).collect()}
    assert found == {(1, 1, "zh"), (6, 1, "en")}
    parts = language.segments(df, *texts).collect()
    assert sum(r.cid == 6 for r in parts) == 2000 and all(0 <= r.confidence <= 1 and r.start < r.end for r in parts)
    assert {r.cid: r.langs for r in language.messages(df, *texts).collect()}[1] == ["en", "zh"]
    assert language.found(df.limit(0), *texts).count() == 0


def test_pair_defects(spark, texts):
    ask = ("user", "Could you please check the weather in the town for tomorrow?")
    cases = [
        (("assistant", "The weather in the town is fine tomorrow, and it stays warm."), None), (("assistant", ""), "empty"), (("assistant", None), "empty"), (("assistant", "<think></think>"), "empty"), (("assistant", "N/A"), "empty"), (("assistant", "​ ..."), "empty"),
        (("assistant", "", [("f", "{}")]), None), (("assistant", "", [("f", '{"a": ')]), "truncated"), (("assistant", None, [("f", None)]), None), (("assistant", "The weather in the town is fine tomor"), "truncated"), (("assistant", "<response>The weather is fine."), "truncated"),
        (("assistant", "I'm sorry, but I can't help with that request."), "refusal"), (("assistant", "对不起，这超出了我可以讨论的范围。"), "refusal"), (("assistant", "I'm sorry, but I can't help with that request. Please call 555-1234."), "refusal"), (("assistant", "The clerk was unable to answer before 10:30."), None), (("assistant", "柜员起初说无法处理，后来送来了路由器。"), "other_language"), (("assistant", 'You asked: "could you please CHECK the weather in the town for tomorrow"'), "copy"),
        (("assistant", "Das Wetter ist morgen sehr schön, und ich habe alles für Sie geprüft."), "other_language"), (("assistant", "Please wait a moment for the weather. Please wait a moment for the weather."), None), (("assistant", "The clerk could not help at first, yet the tickets arrived at 11:30."), None),
    ]
    rows = [dialogue(i, ask, m, wrong=[2] if i == 0 else None) for i, (m, _) in enumerate(cases)]
    rows += [dialogue(100, ("assistant", "")), dialogue(101, None, ask, None), (102, None, None, None, "t", 1, "m", 2), dialogue(None, ask, ("assistant", ""))]
    big = table(spark, SMALL.replace("sf0.001", "sf0.01"), "dialogues").select("cid", "curr_messages", "is_en", "possible_wrong_turns")
    df = spark.createDataFrame(rows, DIALOGUE).unionByName(big, allowMissingColumns=True)
    got = {r.cid: r for r in pairs.pairs(df, *texts).where("cid IS NULL OR cid < 1000").collect()}
    assert {i: got[i].defect for i in range(len(cases))} == {i: d for i, (_, d) in enumerate(cases)}
    assert set(got) == set(range(len(cases))) and got[0].hinted and got[0].turn_no == 2
    assert pairs.found(df.limit(0), *texts).count() == 0


def test_text_ends_are_counted_over_all_dialogues(spark, texts):
    ask = ("user", "Could you please check the weather in the town for tomorrow?")
    rows = [dialogue(i, ask, ("assistant", f"I looked at the book of week {i} and the clerk took a walk in the park.")) for i in range(3000)]
    rows += [dialogue(i, ask, ("assistant", f"The weather of week {i} is fine. Kind regards, your help desk")) for i in range(3000, 3300)]
    rows += [dialogue(9000, ask, ("assistant", "I looked at the book of week 8 and the clerk took a wal"))]
    df = spark.createDataFrame(rows, DIALOGUE).coalesce(1)
    assert {tuple(r) for r in pairs.found(df, *texts).collect()} == {(9000, 2, "truncated")}


def test_own_sightings_are_left_out_exactly(spark):
    all_ = ["The box is here. The box is there. The box", "A short one", "Please wait for the box.\n\n  \n And then\nwait 12 more days", "正在为您查询请稍候。好的，没问题，请您稍等一下好吗？谢谢", "The box is red and the box is blue, the box"]
    df = spark.createDataFrame([dialogue(1, *(("assistant", t) for t in all_[:2])), dialogue(None, (" Assistant ", all_[2]), ("user", "This is not an answer, so it does not count. Yes"), None, ("assistant", None)), dialogue(3, *(("assistant", f"{t}  ") for t in all_[3:])), (5, None, None, None, "t", 1, "m", 2)], DIALOGUE).repartition(3)
    model = pairs.fit_ends(df)
    assert model.seen[0, 0] == sum(len(t) for t in all_ if len(t) > 20) and (model.seen[1:-1].sum(axis=1) == model.seen[0, 0]).all()
    assert model.ended[0, 0] == sum(len({len(t[: m.end()].rstrip()) for m in sentences.END.finditer(t)} | {len(t)}) for t in all_ if len(t) > 20) == 10 and (model.ended <= model.seen).all()
    assert model.ended[-1].sum() == 2  # the lines that another line follows
    for k, t in enumerate(all_):
        others = pairs.EndModel.empty()
        for x in all_[:k] + all_[k + 1 :]:
            if len(x) > 20:
                others.add([x])
        assert model.chance(t) == others.chance(t, included=False)
    assert pairs.fit_ends(df.limit(0)).seen.sum() == 0


def test_whole_items_of_a_list_are_ends():
    model = pairs.EndModel.empty()
    model.add([f"Here is what the clerk found in week {i}.\n- K{i}-77: {i * 3}\n- 40-{i}: {i}\nPlease tell me which of the two you would rather have, thank you" for i in range(20)])
    assert model.whole_line("The tool found these.\n- Z9-12: 41") and model.whole_line("x\n - aa_7: 8")
    assert not any(model.whole_line(t) for t in ("The tool found these.\n- Z9-12", "The tool found these.\n- Z9-12:", "- Z9-12: 41", "One.\nPlease tell me", "One.\n", ""))
    assert not pairs.is_cut("The clerk found this.\n- Z9-12: 41", model) and pairs.is_cut("The clerk found this.\n- Z9-12: 41, but then he took a wal", model)


def brute_share(text):
    """The rule, one window after the other."""
    import unicodedata

    import regex

    words = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}])+", regex.sub(r"\p{N}+", "", unicodedata.normalize("NFKC", text or "").casefold()))
    weight = [1 if regex.fullmatch(r"[\p{Han}\p{Hiragana}\p{Katakana}]", w) else 2 for w in words]
    seen, again = set(), [False] * len(words)
    for i in range(len(words)):
        j = i
        while j < len(words) and sum(weight[i:j]) < 6:
            j += 1
        if sum(weight[i:j]) >= 6:
            if tuple(words[i:j]) in seen:
                again[i:j] = [True] * (j - i)
            seen.add(tuple(words[i:j]))
    total = sum(map(len, words))
    return sum(len(w) for w, a in zip(words, again) if a) / total if total else 0.0


def test_repetition_of_whole_batches_equals_the_rule(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["a", "bb", "ccc", "查", "询", "ß", "1", "x9y", "ド", "...", "\n", "。", "\0", "é"]
    texts = ["", " ", "12 34", "查询"] + [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(200)] + ["".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(200)]
    x, share = repetition.statistics(texts)
    assert np.allclose(share, [brute_share(t) for t in texts]) and np.isfinite(x).all() and (x[:, 1:] >= 0).all() and (x[:, 1:] <= 1).all()
    alone = [repetition.statistics([t]) for t in texts[:40]]
    assert np.allclose(np.concatenate([a for a, _ in alone]), x[:40])
    real = [m.content for r in table(spark, SMALL, "dialogues").collect() for m in r.curr_messages or [] if m and m.content]
    assert np.allclose(repetition.statistics(real)[1], [brute_share(t) for t in real])
    assert repetition.statistics([])[0].shape == (0, len(repetition.FEATURES))


def test_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'en' WHEN id % 3 = 0 THEN 'zh' END AS lang", "concat('t', id) AS text")
    a, b = (sentences.lowest(x, "id", 40, "lang", sentences.LANGS) for x in (df.repartition(7), df.orderBy("id").coalesce(1)))
    assert a == b and len(a) == 80 and len(sentences.lowest(df.limit(20), "id", 40)) == 20 and sentences.lowest(df.limit(0), "id", 40) == []


def test_repetition_measure():
    assert repetition.repeated_share("one two three four one two three four") == 0.5
    assert repetition.repeated_share("请稍候正在为您查询" * 4) == 0.75
    assert repetition.repeated_share("one two one two") == 0.0 and repetition.repeated_share(None) == repetition.repeated_share("12 34 ...") == 0.0
    assert repetition.repeated_share("1. Same words here now. 2. SAME words here, now!") == 0.5


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(repetition.FEATURES)))
    y = ((x[:, 4] + 0.3 * rng.random(600) - 0.5 * x[:, 2]) > 0.5).astype(float)
    trees = repetition.grow(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    for j, way in enumerate(repetition.DIRECTION):
        if way:
            rows = np.repeat(x[:50], 40, axis=0)
            rows[:, j] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(trees.score(rows).reshape(50, 40), axis=1) * way
            assert (steps >= -1e-12).all()


def test_repetition_found(spark):
    again = "please wait for a moment " * 5000
    rows = [dialogue(1, ("user", "a plain question about the weather of today"), ("assistant", again), ("assistant", None), ("assistant", ""), None), dialogue(2, ("assistant", "正在为您查询请稍候，" * 9)), (3, None, None, None, "t", 1, "m", 2)]
    big = table(spark, SMALL, "dialogues").select("cid", "curr_messages", "is_en", "possible_wrong_turns")
    df = spark.createDataFrame(rows, DIALOGUE).unionByName(big, allowMissingColumns=True)
    got = {tuple(r) for r in repetition.found(df).collect()}
    brute = {(r.cid, i) for r in df.collect() for i, m in enumerate(r.curr_messages or [], 1) if m and brute_share(m.content) >= 0.5}
    assert got == brute and {(1, 2), (2, 1)} <= got
    assert repetition.found(df.limit(0)).count() == 0


def test_repetition_share_of_every_message(spark):
    part = "please wait for a moment while the clerk looks for your parcel in the store"
    bare = [dialogue(-1 - i) for i in range(600)]  # nothing to learn from
    rows = [dialogue(1, ("user", "a plain question about the weather of today"), ("assistant", f"{part} and then {part}")), dialogue(2, ("assistant", f"{part}, thank you very much indeed for all the kind help today, {part}"), ("assistant", "12 34")), dialogue(3, ("assistant", part), ("assistant", f"{part} " * 9))]
    big = table(spark, SMALL, "dialogues").select("cid", "curr_messages", "is_en", "possible_wrong_turns")
    for df in (spark.createDataFrame(rows, DIALOGUE).unionByName(big, allowMissingColumns=True), spark.createDataFrame(bare + rows, DIALOGUE).coalesce(1)):
        got = {(r.cid, r.turn_no): r.repeated for r in repetition.shares(df).collect()}
        assert got == {(r.cid, i): pytest.approx(brute_share(m.content)) for r in df.collect() for i, m in enumerate(r.curr_messages or [], 1) if m and m.content}
        assert 0 < got[1, 2] < 0.5 and 0 < got[2, 1] < 0.5 and got[1, 1] == got[2, 2] == 0.0
        assert {tuple(r) for r in repetition.found(df).collect()} == {k for k, x in got.items() if x >= 0.5} and got[3, 2] > 0.5
