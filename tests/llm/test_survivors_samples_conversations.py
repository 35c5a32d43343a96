from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from compare import same_rows
from conftest import SMALL

from turnwise.llm import conversations, queries, quota_sample, sql, survivors

MESSAGE = "struct<role:string,content:string,tool_usage:array<struct<name:string,parameters:string>>,tool_response:array<struct<name:string,results:string>>>"
SNAPSHOT = f"""snapshot_id long, cid long, curr_messages array<{MESSAGE}>, curr_time string, curr_day string, tools array<struct<name:string,description:string,parameters:string>>, tgt_turn_num int, use_cot boolean,
 use_func_call boolean, use_plan boolean, need_chat boolean, is_en boolean, valid boolean, plan string, possible_wrong_turns array<int>, wrong_turn_count int, worker string, snap_time timestamp, key string, row_id int, p double, source string"""
ROW = f"row_id long, cid long, turn_no int, role string, content string, tool_usage array<struct<name:string,parameters:string>>, tool_response array<struct<name:string,results:string>>, valid boolean, is_en boolean, worker string, sent_at timestamp, ingested_at timestamp, symbol string, messages int, kept string, n int"
T0 = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SMALL), duck, sql.oracle_sql()[name])


def said(*texts):
    return [("user", t, None, None) for t in texts]


def snap(i, cid, messages, valid, worker="w", hours=0, plan=None, wrong=None, tools=None):
    return (i, cid, messages, None, None, tools, 4, None, None, None, None, None, valid, plan, wrong, 0, worker, T0 + dt.timedelta(hours=hours) if hours is not None else None, "x", 1, 0.5, "y")


def test_survivor_rule(spark):
    rows = [
        snap(1, 1, said("a", "b"), True), snap(2, 1, said("a", "b", " ", "​"), True, hours=1), snap(3, 1, said("a", "b", "c"), False, hours=2), snap(4, 1, None, None, hours=3),
        snap(5, 2, said("a"), True), snap(6, 2, said("a"), True),  # a tie in everything: the smaller id
        snap(7, 3, [], None), snap(8, 3, said("z"), False),  # no valid row
        snap(9, 4, said("z"), True), snap(10, None, said("z"), True), snap(11, None, said("z"), True),
        snap(12, 5, said("z"), True, hours=None), snap(13, 5, said("y"), True, hours=5),
        snap(14, 6, [("assistant", None, [("f", "{}")], None), None], True), snap(15, 6, said("x" * 200_000), True, hours=1),
    ]
    df = spark.createDataFrame(rows, SNAPSHOT)
    assert {r.cid: r.snapshot_id for r in survivors.found(df).collect()} == {1: 2, 2: 5, 5: 13, 6: 15}
    full = {r.cid: r for r in survivors.survivors(df).collect()}
    assert set(full) == {1, 2, 3, 4, 5, 6} and not full[3].any_valid and full[3].n_rows == 2 and full[4].snapshot_id == 9
    assert survivors.found(df.limit(0)).count() == 0 and survivors.survivors(df.limit(0)).count() == 0


def test_fields_survive_one_by_one(spark):
    rows = [snap(1, 1, said("a"), True, plan="old", wrong=[1]), snap(2, 1, said("a"), True, hours=1, plan=None, wrong=[1, 2], tools=[("f", None, None), (None, None, None)]), snap(3, 1, said("a"), False, hours=2, plan="bad")]
    r = survivors.survivors(spark.createDataFrame(rows, SNAPSHOT)).first()
    assert (r.plan, r.possible_wrong_turns, r.tool_names, r.tgt_turn_num) == ("old", [1, 2], ["f"], 4)


def test_sources_are_told_apart(spark):
    """Facts of a reliable source's invalid rows are believed more than those of a source that invents messages."""
    rows = [snap(i, i // 3, said(*(["t%d" % (i // 3), "u"] if i % 3 < 2 else ["lie%d" % i])), i % 3 == 0, worker=["good", "fair", "bad"][i % 3]) for i in range(60)]
    rows += [snap(1000, 500, said("only good"), False, worker="fair"), snap(1001, 500, said("only bad"), False, worker="bad")]
    df = spark.createDataFrame(rows, SNAPSHOT)
    facts = survivors.fact_truth(survivors._rows(df, "cid", "snapshot_id", "worker")).where("key = 500").collect()
    assert len(facts) == 2 and survivors.survivors(df).where("cid = 500").first().snapshot_id == 1000


def test_scalars_of_unreliable_sources_lose(spark):
    """Without a valid row the later value of a source that is mostly wrong loses to the earlier one of a reliable source; the plain rule would take the latest."""
    rows = [snap(i, i // 3, said(*(["t%d" % (i // 3), "u"] if i % 3 < 2 else ["lie%d" % i])), i % 3 == 0, worker=["good", "fair", "bad"][i % 3], plan="p%d" % (i // 3) if i % 3 < 2 else "wrong%d" % i) for i in range(60)]
    rows += [snap(1000, 500, said("m"), False, worker="fair", plan="likely"), snap(1001, 500, said("m"), False, worker="bad", plan="unlikely", hours=9)]
    got = survivors.survivors(spark.createDataFrame(rows, SNAPSHOT)).where("cid = 500").first()
    assert got.plan == "likely" and got.tgt_turn_num == 4


def test_pattern_model_equals_plain_expectation_maximization(spark):
    rng = random.Random(5)
    rows = [snap(i, rng.randrange(30), said(*(f"f{k}" for k in range(6) if rng.random() < 0.5)), rng.random() < 0.2, worker=f"w{rng.randrange(4)}") for i in range(150)]
    r = survivors._rows(spark.createDataFrame(rows, SNAPSHOT), "cid", "snapshot_id", "worker")
    got = {(x.key, x.fact): x.p for x in survivors.fact_truth(r, rounds=3).collect()}
    said_by, covers, good = defaultdict(set), defaultdict(set), defaultdict(bool)
    for x in r.collect():
        covers[x.key].add(x.source)
        for f in x.messages:
            said_by[x.key, f].add(x.source)
            good[x.key, f] |= x.good
    quality = {s: (0.8, 0.9) for ss in covers.values() for s in ss}

    def truth():
        out = {}
        for (k, f), ss in said_by.items():
            o = 1.0
            for s in covers[k]:
                a, b = quality[s]
                o *= a / (1 - b) if s in ss else (1 - a) / b
            out[k, f] = 1.0 if good[k, f] else o / (1 + o)
        return out

    for _ in range(3):
        p, sums = truth(), defaultdict(lambda: [0.0] * 4)
        for (k, f), x in p.items():
            for s in covers[k]:
                hit = s in said_by[k, f]
                for j, v in enumerate((x * hit, x, (1 - x) * hit, 1 - x)):
                    sums[s][j] += v
        quality = {s: ((a + 2) / (t + 3), 1 - (w + 1) / (n + 10)) for s, (a, t, w, n) in sums.items()}
    assert got == pytest.approx(truth(), abs=1e-6)


def test_hot_key(spark):
    rows = [snap(i, 1, said(str(i % 7), "b"), i % 2 == 0, hours=i) for i in range(300)]
    assert [tuple(r) for r in survivors.found(spark.createDataFrame(rows, SNAPSHOT)).collect()] == [(1, 298)]


def test_allocation_goes_to_siblings_then_cousins():
    tree = {"a": "x", "b": "x", "c": "y", "d": "y"}
    assert quota_sample.allocate({"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 2, "b": 13, "c": 100, "d": 10}, tree) == {"a": 2, "b": 13, "c": 15, "d": 10}
    assert quota_sample.allocate({"a": 5, "b": 5}, {"a": 0, "b": 0}, tree) == {"a": 0, "b": 0}
    assert quota_sample.allocate({}, {}, tree) == {}


def test_quotas_stay_within_the_sample(spark):
    assert quota_sample.within({"a": 4, "b": 4, "c": 3}, {"a": 3, "b": 3, "c": 3}, 10) == {"a": 3, "b": 4, "c": 3}
    assert quota_sample.within({"a": 5, "b": 5}, {"a": 5, "b": 5}, 3) == {"a": 5, "b": 5} and quota_sample.within({}, {}, 0) == {}
    records = spark.createDataFrame([record(i, [f"t{i % 3}"]) for i in range(55)], RECORDS)
    targets = spark.createDataFrame([("t0", 334, 1), ("t1", 333, 1), ("t2", 333, 1)], "tag string, target_permille int, min_rows int")
    rep = quota_sample.report(records, targets).collect()
    assert sum(r.taken for r in rep) == 11 and {r.target_rows for r in rep} == {4} and quota_sample.sample(records, targets).count() == 11


RECORDS = "record_id long, tag array<string>, plain string, rank int, slice int, mix long, key string"


def record(i, tag):
    return (i, tag, "p", 1, 2, 3, "k")


def test_sample(spark):
    tags = [["A b"], [" a_B "], [None, "", "a-b"], ["c"], None, [], [None], ["other"]]
    records = spark.createDataFrame([record(i, tags[i % len(tags)]) for i in range(800)], RECORDS)
    targets = spark.createDataFrame([("a b", 500, 1), ("C", 300, 1), ("none", 200, 2), (None, 1, 1)], "tag string, target_permille int, min_rows int")
    rep = {r.tag: r for r in quota_sample.report(records, targets).collect()}
    assert (rep["a b"].available, rep["a b"].target_rows, rep["C"].target_rows, rep["none"].short) == (300, 80, 48, 32)
    assert sum(r.taken for r in rep.values()) == 160
    drawn = quota_sample.sample(records, targets).collect()
    assert Counter(r.tag for r in drawn) == {t: r.taken for t, r in rep.items() if r.taken} and len({r.record_id for r in drawn}) == 160
    assert sorted(r["rank"] for r in drawn if r.tag == "C") == list(range(1, rep["C"].taken + 1))
    assert {r.record_id for r in quota_sample.sample(records.repartition(7), targets).collect()} == {r.record_id for r in drawn}
    assert [r.tag for r in quota_sample.found(records, targets).collect()] == ["none"]
    assert quota_sample.report(records.limit(0), targets).where("short > 0").count() == 3 and quota_sample.sample(records.limit(0), targets).count() == 0
    assert quota_sample.found(records, targets.limit(0)).count() == 0


def brute_kept(rows):
    seen, out = set(), []
    for r in rows:
        role = next((n for n, ss in conversations.ROLES.items() if (r[3] or "").strip().lower() in ss), "other")
        k = (r[1], r[2], role, r[4], str(r[5]), str(r[6]), r[7], r[8], r[10])
        if k not in seen:
            seen.add(k)
            out.append((r, role))
    if any(r[7] is False for r, _ in out):
        return False
    turns = [r[2] for r, _ in out]
    if any(t is None for t in turns) and any(t is not None for t in turns):
        return False
    out.sort(key=lambda x: (x[0][2] or 0, x[0][10], x[0][0]))
    turns = [r[2] for r, _ in out]
    if turns[0] is not None and (turns[0] not in (0, 1) or any(b - a != 1 for a, b in zip(turns, turns[1:]))):
        return False
    state = 0
    for r, role in out:
        filled = bool((r[4] or "").strip("​ \n\t")) or bool(r[5]) or bool(r[6])
        sym = 4 if not filled else {"user": 0, "tool": 2, "assistant": 1 if r[5] else 3}.get(role, 4)
        state = conversations.STEP[state][sym]
    return state == 0


def conversation_rows(seed):
    rng = random.Random(seed)
    rows, rid = [], 0
    for cid in range(60):
        numbered, first = rng.random() < 0.7, rng.choice([0, 1])
        t = 0
        for _ in range(rng.randint(1, 4)):
            parts = [("user", "q", None, None)]
            for _ in range(rng.randint(0, 2)):
                parts += [("assistant", "", [("f", "{}")], None), ("tool", None, None, [("f", "1")])]
            parts.append(("assistant", "answer", [] if rng.random() < 0.5 else None, None))
            for role, content, usage, response in parts:
                if rng.random() < 0.02:
                    t += 1
                    continue
                if rng.random() < 0.01:
                    content, usage, response = rng.choice(["", " ", "​", None]), None, None
                for copy in range(1 + (rng.random() < 0.2)):
                    spelt = rng.choice([role, role.upper(), f" {role}"])
                    rows.append((rid, cid, first + t if numbered else None, spelt, content, usage, response, rng.choice([True, True, None]) if copy == 0 else rows[-1][7], None if copy == 0 else rows[-1][8], f"w{copy}", T0 + dt.timedelta(seconds=t), T0, "s", 1, "k", 2))
                    rid += 1
                t += 1
        if rng.random() < 0.05:
            rows.append((rid, cid, first, "system", "x", None, None, False, None, "w", T0, T0, "s", 1, "k", 2))
            rid += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_equal_brute_force(spark, seed):
    rows = conversation_rows(seed)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    want = {c for c, rs in by.items() if not brute_kept(rs)}
    df = spark.createDataFrame(rows, ROW)
    assert {r.cid for r in conversations.found(df).collect()} == want and 0 < len(want) < len(by)
    kept = {r.cid: r for r in conversations.conversations(df).collect()}
    assert set(kept) == set(by) - want
    assert all([m.role for m in r.curr_messages][0] == "user" and r.curr_messages[-1].role == "assistant" and len(r.curr_messages) == r.n_messages for r in kept.values())


def test_conversation_edges(spark):
    def row(i, cid, turn, role, content, **k):
        return (i, cid, turn, role, content, k.get("usage"), None, k.get("valid", True), None, "w", T0 + dt.timedelta(seconds=i), T0, "s", 1, "k", 2)

    rows = [row(1, 1, 0, "human", "q"), row(2, 1, 1, "GPT", "a" * 300_000)]  # kept
    rows += [row(3, 2, 2, "user", "q"), row(4, 2, 3, "assistant", "a")]  # starts at 2
    rows += [row(5, 3, 1, "user", "q"), row(6, 3, None, "assistant", "a")]  # half numbered
    rows += [row(7, 4, 1, "user", "q"), row(8, 4, 1, "assistant", "a")]  # two at one number
    rows += [row(9, 5, 1, "user", "q")] + [row(10, None, 1, "user", "q")]  # no answer; no conversation
    rows += [row(11, 6, None, None, "q"), row(12, 6, None, "assistant", "a")]  # no role
    df = spark.createDataFrame(rows, ROW)
    assert {r.cid for r in conversations.found(df).collect()} == {2, 3, 4, 5, 6}
    assert conversations.found(df.limit(0)).count() == 0 and conversations.conversations(df.limit(0)).count() == 0


def test_delivery_without_label_is_the_same_message(spark):
    at = [T0 + dt.timedelta(seconds=k) for k in range(3)]
    rows = [(k, 1, k, "user" if k == 0 else "assistant", f"m{k}", None, None, True, True, "w", at[k], T0, "s", 1, "k", 2) for k in range(2)]
    again = [(7, 1, 1, "gpt", "m1", None, None, True, label, "v", at[1], at[2], "s", 1, "k", 2) for label in (None,)]
    assert conversations.found(spark.createDataFrame(rows + again, ROW)).count() == 0
    (whole,) = conversations.conversations(spark.createDataFrame(rows + again, ROW)).collect()
    assert [m.content for m in whole.curr_messages] == ["m0", "m1"]
    other = [(8, 1, 1, "gpt", "another", None, None, True, True, "v", at[1], at[2], "s", 1, "k", 2)]
    assert conversations.found(spark.createDataFrame(rows + other, ROW)).count() == 1


def test_long_conversation_is_spread(spark):
    rows = [(i, 1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", None, None, True, None, "w", T0, T0, "s", 1, "k", 2) for i in range(30_000)]
    df = spark.createDataFrame(rows, ROW).repartition(8)
    assert conversations.judged(df).first().kept
    assert not conversations.judged(df.where("row_id <> 12345")).first().kept
