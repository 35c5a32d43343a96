from __future__ import annotations

import itertools
import random
import unicodedata
from collections import Counter

import pytest
import regex
import tiktoken
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import byte_pairs, leaks, near_records, skeleton
from turnwise.sources.tables import table

DOCS = "doc_id long, text string, id int, s1 string, h1 int, k int, t string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "don't  stop\t\n  now ", "中文，标点。ドラゴン龍喚士", "👩‍💻 🏽 é é ﬁ", "2024年3月28日 x9 ' 's", "​﻿\xa0", "<|endoftext|>", "a" * 50_000, "x \r\n y", "ＡＢＣ ４３", "ñandú übergrößen", "한국어 텍스트"]


def test_ids_equal_the_tokenizer(spark):
    from public_tokenizers import PATTERN

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(byte_pairs.read_ranks()), special_tokens={})
    whole = [r.text for r in table(spark, SMALL, "documents").collect()]
    for cache in (0, 64):
        rows = byte_pairs.encoded(docs(spark, ODD + whole), cache=cache, cache_rows=20)
        got = rows.collect()
        for r in got:
            assert r.ids == (enc.encode_ordinary(r.text) if r.text else []), r.text
    back = byte_pairs.decoded(rows, into="back").collect()
    assert all(r.back == (r.text or "") for r in back)
    assert byte_pairs.encoded(docs(spark, []), cache=8).count() == 0


def test_cuts_never_split_a_token():
    import re

    ranks = byte_pairs.read_ranks()
    cut = re.compile(byte_pairs.cuts(ranks))
    assert all(len(cut.split(t.decode("latin-1"))) == 1 for t in ranks)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(t):
    s = skeleton.skeleton(t)
    assert skeleton.skeleton(s) == s and skeleton.skeleton(skeleton.canonical(t)) == s


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ａｂ１", "Ab1", True), ("é", "é", True), ("a​b", "ab", True), ("a\xa0b", "a b", True), ("pаypаl", "paypal", True), ("ﬁn", "fin", True), ("⼀", "一", True), ("a\r\nb", "a\nb", True), ("end \n", "end", True), ("co\xadop", "coop", True),
        ("é", "e", False), ("A", "a", False), ("1", "l", False), ("0", "O", False), ("I", "l", False), ("👩‍💻", "👩💻", False), ("a b", "ab", False), ("x²", "x2", False),
    ],
)
def test_looks(a, b, same):
    assert (skeleton.skeleton(a) == skeleton.skeleton(b)) is same


def test_look_pairs(spark):
    texts = ["abc", "abc", "аbc", "ａbc", "abd", None, "", " ", "​", "abc"]
    df = docs(spark, texts)
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and texts[i] != texts[j] and skeleton.skeleton(texts[i]).strip() and skeleton.skeleton(texts[i]) == skeleton.skeleton(texts[j])}
    assert {tuple(r) for r in skeleton.found(df).collect()} == want and want
    by = {r.doc_id: r for r in skeleton.classes(df).collect()}
    assert set(by) == {0, 1, 2, 3, 4, 9} and by[3].class_id == 0 and by[3].n_docs == 5 and by[3].n_forms == 3
    assert skeleton.found(df.limit(0)).count() == 0 and skeleton.classes(df.limit(0)).count() == 0
    forms = {r.doc_id: r.canonical for r in skeleton.with_canonical(df).collect()}
    assert forms[2] == forms[3] == "abc" and forms[5] is None and forms[7] == ""


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ZH = "位于砚云港的仓库每逢星期三要发出六十八箱毛毯合同号码已经登记在案并且需要在月底之前完成全部交付手续"


def test_leaks(spark):
    words = ITEM.split()
    texts = [
        "x " * 40 + ITEM.upper() + " tail", " - ".join(words[2:17]), " ".join(words[2:16]), ITEM.replace("e", "е"), "".join(words), None, "", ZH[3:33], ZH[3:32], "，".join(ZH), "ｏｎｅ " + " ".join(words[1:15]), " ".join([*words[:10], "x", *words[10:]]),
    ]
    items = spark.createDataFrame([(1, ITEM, "a"), (2, ZH, "b"), (3, None, "c"), (4, "", "d"), (5, "short", "e"), (1, ITEM, "again")], "item_id long, text string, ids string")
    got = sorted({tuple(r) for r in leaks.found(docs(spark, texts), items).collect()})
    assert got == [(0, 1), (1, 1), (3, 1), (4, 1), (7, 2), (9, 2), (10, 1)]
    assert leaks.found(docs(spark, []), items).count() == leaks.found(docs(spark, texts), items.limit(0)).count() == 0
    blocks = leaks.leaks(docs(spark, texts), items, block=2).select("doc_id", "item_id").distinct()
    assert sorted(tuple(r) for r in blocks.collect()) == got
    edited = {tuple(r)[:2] for r in leaks.leaks(docs(spark, texts), items, edits=1).collect()}
    assert edited >= set(got) | {(11, 1)}


def test_edited_passages_need_an_edit_budget(spark):
    words = ITEM.split()
    once, twice = (" ".join([*words[:7], "eigt", *words[8:11], *ws, *words[12:17]]) for ws in ([words[11]], ["twelves"]))
    texts = [" ".join(words[1:17]), once, twice, twice.replace("thirteen", "thirteeeeen"), "nothing of the kind " * 30, ZH[:15] + "旧" + ZH[15:40]]
    items = spark.createDataFrame([(1, ITEM), (2, ZH)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.near(docs(spark, texts), items).collect()} == {(0, 1), (1, 1), (2, 1), (5, 2)}
    assert {tuple(r) for r in leaks.found(docs(spark, texts), items).collect()} == {(0, 1)}


def test_leaks_equal_brute_force():
    rng = random.Random(5)
    words = ["ab", "cde", "fg", "hij", "klm", "no", "pq"]
    passages = [(i, " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(30))) for i in range(20)]
    x = leaks.index(passages, 6, 5, 30)
    for _ in range(200):
        i, text = rng.choice(passages)
        a = rng.randint(0, 25)
        n = rng.randint(3, 8)
        doc = " ".join([rng.choice(words), *text.split()[a : a + n], rng.choice(words)])
        body = leaks.plain(doc)
        want = {j for j, t in passages if any(leaks.plain(" ".join(t.split()[k : k + 5])) in body for k in range(26))}
        assert {m[0] for m in leaks.matches(leaks.plain_codes(doc), x, 6, 2, 0, 5, 30)} == want


RECORDS = "record_id long, data array<struct<role:string,content:string>>, tools array<struct<name:string>>, n int, rep int, id long, df string"


def plain_tokens(texts):
    """The runs of three words with their numbers, one text and word at a time."""
    out = Counter()
    for t in texts:
        words = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{N}\p{M}])+", unicodedata.normalize("NFKC", t).casefold())
        out.update(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2)) if words)
    return out


def near(a, b, share):
    return sum((a & b).values()) >= share * max(a.total(), b.total())


def record_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            _, data, tools, *_ = rng.choice(rows)
            words = (data[0][1] if data else "").split()
            for _ in range(rng.randint(0, 6)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            tools = list(tools or [])[: rng.randint(0, 4)]
            rows.append((i, [("user", " ".join(words))], tools, 1, 2, 3, "x"))
        else:
            text = rng.choice([" ", "中", "ß ", "\0", ". "]).join(rng.choice(vocabulary[: rng.choice([5, 60])]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 20, 60])))
            rows.append((i, [("user", text)] if rng.random() < 0.95 else None, rng.choices([(f"t{k}",) for k in range(4)], k=rng.randint(0, 5)) if rng.random() < 0.9 else None, 1, 2, 3, "x"))
    return rows


def brute_pairs(rows):
    tokens = [plain_tokens([m[1] for m in r[1] or [] if m and m[1]]) for r in rows]
    tools = [Counter(t[0] for t in r[2] or []) for r in rows]
    out = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if tokens[i] and tokens[j] and near(tokens[i], tokens[j], 0.6) and near(tools[i], tools[j], 0.5):
            out.add((rows[i][0], rows[j][0]))
    return out


@pytest.mark.parametrize(("seed", "common"), [(1, 512), (2, 6), (3, 1), (4, 0)])
def test_record_pairs_equal_brute_force(spark, seed, common):
    rows = record_rows(seed, 120)
    df = spark.createDataFrame(rows, RECORDS)
    texts, membership, reps = near_records._classes(df, "record_id", "data", "tools")
    got = {tuple(r) for r in near_records._expand(membership, near_records.rep_links(texts, reps, common=common)).collect()}
    want = brute_pairs(rows)
    assert got == want and want
    if seed == 1:
        assert {tuple(r) for r in near_records.found(df).collect()} == want
        group = {r.record_id: r.class_id for r in near_records.groups(df).collect()}
        assert set(group) == {r[0] for r in rows} and all(group[a] == group[b] for a, b in want)
        joined = {frozenset(p) for p in want}
        for a, c in group.items():  # a class is connected: its smallest record is reached by links
            reach, todo = {a}, [a]
            while todo:
                x = todo.pop()
                for p in joined:
                    if x in p:
                        todo += [y for y in p if y not in reach]
                        reach |= p
            assert c == min(reach)


def test_large_buckets_are_compared_in_blocks(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(i, [("u", " ".join([*words, f"x{i // 2}"] if i % 7 else [f"y{i}-{k}" for k in range(20)]))], [("f",)], 1, 2, 3, "x") for i in range(1400)]
    texts, membership, reps = near_records._classes(spark.createDataFrame(rows, RECORDS), "record_id", "data", "tools")
    links = near_records.rep_links(texts, reps)
    n = len({" ".join(r[1][0][1].split()) for r in rows if r[0] % 7})
    assert n > 512 and links.count() == links.distinct().count() == n * (n - 1) // 2


def test_records_with_frequent_names_take_a_bounded_number_of_rows(spark):
    rng = random.Random(7)
    names = [f"t{k}" for k in range(6)]
    rows = []
    for i in range(400):
        text = " ".join(f"w{rng.randrange(400)}" for _ in range(60)) if i % 4 else rows[i - 1][1][0][1] + " and more" if i else "one two three"
        rows.append((i, [("u", text)], [(x,) for x in rng.sample(names, rng.randint(2, 6))], 1, 2, 3, "x"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    texts, membership, reps = near_records._classes(spark.createDataFrame(rows, RECORDS), "record_id", "data", "tools")
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    got = {tuple(r) for r in near_records._expand(membership, near_records.rep_links(texts, reps, common=16)).collect()}
    after = [stages().apply(k) for k in range(stages().size())]
    written = sum(s.shuffleWriteRecords() for s in after if s.stageId() not in before)
    assert got == brute_pairs(rows) and got
    assert written < 60 * len(rows)  # the runs of these records alone, once for each key, would be 100 to 200 times as many


def test_record_edges(spark):
    none = spark.createDataFrame([], RECORDS)
    assert near_records.found(none).count() == 0 and near_records.groups(none).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, [("u", long)], [("f",)], 1, 2, 3, "x"), (2, [("u", long.upper() + "!")], [("f",)], 1, 2, 3, "x"), (3, None, None, 1, 2, 3, "x"), (None, [("u", long)], [("f",)], 1, 2, 3, "x"), (4, [("u", None), None], [None], 1, 2, 3, "x")]
    df = spark.createDataFrame(rows, RECORDS)
    assert [tuple(r) for r in near_records.found(df).collect()] == [(1, 2)]
    assert {r.record_id: r.class_id for r in near_records.groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_leak_of_more_words_but_fewer_letters(spark):
    short = "we saw the old man go by the sea at six on a hot day"
    long_ = "extraordinarily complicated international negotiations concerning agricultural subsidies repeatedly demonstrated irreconcilable philosophical disagreements between governments"
    assert len(short.split()) == 15 and len(long_.split()) == 14
    items = spark.createDataFrame([(1, f"{short} while {long_} followed.")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"First {long_} ended. Then {short} again."), (2, f"First {short} again. Then {long_} ended."), (3, f"Only {long_} ended.")], "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.words) for r in leaks.leaks(df, items).collect()}
    assert got == {1: (1, 15), 2: (1, 15)}
