"""Every query with SQL gives the rows that DuckDB gives; the others have the properties that their results must have."""

from __future__ import annotations

from collections import defaultdict

import pytest
from compare import same_rows
from conftest import SMALL

from turnwise.functions import calls
from turnwise.operators import batches, metrics
from turnwise.plans import catalogue
from turnwise.sources.tables import table

WITH_SQL = sorted(catalogue.oracle_sql())
WITHOUT = {"balanced_partitions", "partition_imbalance", "micro_batches", "validation_metrics", "canonical_calls", "nfkd_normalize", "rl_rows", "executable_calls", "without_empty", "greedy_parts", "balanced_ranks"}


def rows(spark, name):
    return catalogue.queries()[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SMALL), duck, catalogue.oracle_sql()[name])


def test_the_others_are_named():
    assert set(catalogue.queries()) - set(WITH_SQL) == WITHOUT


def lengths(spark):
    return {r.doc_id: r.n_chars for r in table(spark, SMALL, "documents").where("n_chars IS NOT NULL").collect()}


def test_balanced_partitions(spark):
    n, sums, seen = lengths(spark), defaultdict(int), defaultdict(dict)
    for r in rows(spark, "balanced_partitions"):
        sums[r.group, r.part] += r.length
        seen[r.group][r.key] = r.part
    assert {k for g in seen.values() for k in g} == set(n)
    for g, part in seen.items():
        assert set(part.values()) == set(range(8)) and max(sums[g, p] for p in range(8)) - min(sums[g, p] for p in range(8)) <= max(n[k] for k in part)
    gaps = {r.group: (r.low, r.high, r.gap) for r in rows(spark, "partition_imbalance")}
    assert gaps == {g: (min(s := [sums[g, p] for p in range(8)]), max(s), max(s) - min(s)) for g in seen}


def test_micro_batches(spark):
    n, by = lengths(spark), defaultdict(list)
    got = rows(spark, "micro_batches")
    assert {r.key for r in got} == set(n)
    for r in got:
        by[r.group].append(r)
    for g in by.values():
        k = max(r.batch for r in g) + 1
        assert k == min(len(g), -(-sum(r.length for r in g) // 200000)) and sorted(r.place for r in g) == list(range(len(g))) and [r.batch for r in sorted(g, key=lambda r: r.place)] == sorted(r.batch for r in g)
    parts = batches.micro_batch_rows([5, 1, 9, 3, 7, 7, 2], 12)
    loads = [sum(24576 * x + x * x for x in ([5, 1, 9, 3, 7, 7, 2][i] for i in p)) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(7)) and len(parts) == 3 and max(loads) == loads[1]


def test_greedy_and_ranks(spark):
    n = lengths(spark)
    sums = defaultdict(int)
    for r in sorted(rows(spark, "greedy_parts"), key=lambda r: r.doc_id):
        assert sums[r.part] == min(sums[p] for p in range(8))
        sums[r.part] += n[r.doc_id]
    by = defaultdict(list)
    for r in rows(spark, "balanced_ranks"):
        by[r.group, r["rank"]].append(r)
    assert by and {len(g) for g in by.values()} == {8}
    for g in by.values():
        x = [r.length for r in sorted(g, key=lambda r: r.place)]
        top = x.index(max(x))
        assert x[:top] == sorted(x[:top]) and x[top:] == sorted(x[top:], reverse=True)


def test_validation_metrics(spark):
    groups = defaultdict(list)
    for e in table(spark, SMALL, "events").orderBy("event_id").collect():
        groups[e.event_type, e.user_id, e.ts.date()].append((e.value, e.props))
    want = defaultdict(list)
    for (kind, _, _), g in groups.items():
        for k, x in metrics.group_validation([v for v, _ in g], [p for _, p in g]).items():
            want[kind, k].append(x)
    assert {(r.source, r.metric): r.value for r in rows(spark, "validation_metrics")} == {k: pytest.approx(sum(x) / len(x)) for k, x in want.items()}


def test_texts_without_sql(spark):
    from turnwise.functions.text import plain_text

    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in rows(spark, "nfkd_normalize"):
        assert (r.plain, r.kept) == ((None, None) if docs[r.doc_id] is None else (plain_text(docs[r.doc_id]), plain_text(docs[r.doc_id], False)))
    forms = {r.call_id: r.form for r in rows(spark, "canonical_calls")}
    given = {f"{d.cid}-{p}-{k}": u.parameters for d in table(spark, SMALL, "dialogues").collect() for p, m in enumerate(d.curr_messages or []) if m for k, u in enumerate(m.tool_usage or [])}
    assert forms == {k: calls.canonical_text(v) for k, v in given.items()}
    said = {r.cid: (r.n, r.contents) for r in rows(spark, "without_empty")}
    for d in table(spark, SMALL, "dialogues").collect():
        kept = [None if m.content is None else plain_text(m.content) for m in d.curr_messages or [] if m and ((m.content and plain_text(m.content)) or m.tool_usage or m.tool_response)]
        assert said.get(d.cid) == ((len(kept), kept) if len(kept) >= 2 else None)
    texts = {(r.cid, r.pos): r.calls for r in rows(spark, "executable_calls")}
    assert any(texts.values()) and all(c.endswith(")") for cs in texts.values() for c in cs)
    histories = {(r.cid, r.pos): r.history for r in catalogue.queries()["history_text"](spark, SMALL).collect()}
    assert len(rows(spark, "rl_rows")) == len(histories)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
