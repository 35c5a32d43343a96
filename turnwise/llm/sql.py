"""SQL that gives the same rows as the queries of the same names."""

from __future__ import annotations

#: Blanks, line ends and characters without width, as a pattern of DuckDB.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"


def filled(m: str = "") -> str:
    return f"(length(regexp_replace(coalesce({m}content, ''), '{INVISIBLE}', '', 'g')) > 0 OR coalesce(len({m}tool_usage), 0) > 0 OR coalesce(len({m}tool_response), 0) > 0)"


P1_FOUND = f"""
WITH r AS (SELECT cid, snapshot_id, coalesce(valid, false) AS good, snap_time,
             len(list_filter(coalesce(curr_messages, []), lambda m: {filled("m.")})) AS filled FROM dialogue_snapshots WHERE cid IS NOT NULL),
k AS (SELECT cid FROM r GROUP BY cid HAVING count(*) > 1 AND bool_or(good)),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY filled DESC, snap_time DESC NULLS LAST, snapshot_id) AS place FROM r WHERE good)
SELECT o.cid, o.snapshot_id FROM o JOIN k USING (cid) WHERE place = 1
"""

_TAG = "nullif(trim(regexp_replace(lower(x), '[\\s\\p{Z}_-]+', ' ', 'g')), '')"
_P5 = f"""
WITH r AS (SELECT list_filter(list_transform(coalesce(tag, []), lambda x: {_TAG}), lambda x: x IS NOT NULL)[1] AS plain FROM train_records),
n AS (SELECT count(*) // 5 AS n FROM r),
c AS (SELECT plain, count(*) AS available FROM r GROUP BY plain),
t AS (SELECT tag, {_TAG.replace("(x)", "(tag)")} AS plain, greatest(min_rows, (target_permille * n + 999) // 1000) AS target_rows FROM tag_targets, n)
"""
P5_FOUND = _P5 + "SELECT t.tag FROM t LEFT JOIN c USING (plain) WHERE coalesce(available, 0) < target_rows"

P7_FOUND = f"""
WITH r AS (SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'u' WHEN lower(trim(role)) IN ('assistant', 'gpt', 'bot', 'model', 'ai', 'chatbot') THEN 'a'
             WHEN lower(trim(role)) IN ('tool', 'function', 'observation', 'obs', 'ipython', 'tool_response') THEN 't' ELSE 'x' END AS who FROM message_rows WHERE cid IS NOT NULL),
d AS (SELECT cid, turn_no, who, content, tool_usage, tool_response, valid, sent_at, min(row_id) AS row_id FROM r GROUP BY ALL),
s AS (SELECT *, CASE WHEN NOT {filled()} THEN 'x' WHEN who = 'a' AND coalesce(len(tool_usage), 0) > 0 THEN 'c' ELSE who END AS sym,
        turn_no - lag(turn_no) OVER (PARTITION BY cid ORDER BY turn_no NULLS LAST, sent_at NULLS FIRST, row_id) AS step FROM d),
g AS (SELECT cid, bool_or(valid = false) AS refused, bool_or(step <> 1) AS jumps, count(turn_no) AS numbered, count(*) AS n, min(turn_no) AS first,
        string_agg(sym, '' ORDER BY turn_no NULLS LAST, sent_at NULLS FIRST, row_id) AS line FROM s GROUP BY cid)
SELECT cid FROM g WHERE coalesce(refused, false) OR coalesce(jumps, false) OR numbered NOT IN (0, n) OR coalesce(first, 0) NOT IN (0, 1) OR NOT regexp_full_match(line, '(u(ct)*a)+')
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p5_found": P5_FOUND, "p7_found": P7_FOUND}
