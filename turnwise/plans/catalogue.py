"""Queries over the engine's own operators, with the SQL that gives the same rows. All run over whole tables.

Scores and token streams come from `events`: a user's events in order of time are a response, event types its
tokens, values its scores and log-probabilities -ln(1 + value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions import answers, calls, text
from turnwise.operators import advantage, batches, dedup, losses, metrics, retrieval, sampling, turns, votes
from turnwise.sources import files
from turnwise.plans.registry import QUERIES, SQL, Query, queries, oracle_sql, query, r6
from turnwise.sources.tables import table

__all__ = ["oracle_sql", "queries"]


# ---- turns -------------------------------------------------------------------------------------------------------

_TURNS = "turns AS (SELECT cid, unnest(curr_messages) AS m, unnest(range(len(curr_messages))) AS pos FROM dialogues)"
_USED = "coalesce(len(m.tool_usage), 0) > 0"


@query(
    "sample_history",
    f"""WITH {_TURNS}, t AS (SELECT *, count(*) FILTER (WHERE m.role = 'user') OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS users FROM turns),
    a AS (SELECT cid, pos, users, m.content AS output FROM t WHERE m.role = 'assistant' AND NOT {_USED} AND length(trim(m.content, ' ')) > 0),
    u AS (SELECT cid, pos, row_number() OVER (PARTITION BY cid ORDER BY pos) AS k FROM turns WHERE m.role = 'user'),
    s AS (SELECT a.*, CASE WHEN users <= 2 THEN 0 ELSE u.pos END AS start FROM a LEFT JOIN u ON u.cid = a.cid AND u.k = a.users - 1)
    SELECT s.cid, s.pos, count(t.pos) AS n_history, s.output FROM s LEFT JOIN turns t ON t.cid = s.cid AND t.pos >= s.start AND t.pos < s.pos AND t.m.role IN ('user', 'assistant', 'tool') GROUP BY s.cid, s.pos, s.output""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.history_samples(table(s, d, "dialogues")).drop("history")


_BLOCKS = """CASE WHEN m.role = 'tool' THEN coalesce(array_to_string(list_transform(m.tool_response, lambda r: '<tool_response>' || chr(10) || coalesce(r.results, 'null') || chr(10) || '</tool_response>'), chr(10)), '')
      WHEN m.role = 'assistant' AND coalesce(len(m.tool_usage), 0) > 0 THEN array_to_string(list_transform(m.tool_usage, lambda u: '<tool_call>' || chr(10) || '{"name": ' || to_json(coalesce(u.name, ''))::VARCHAR || ', "arguments": ' || coalesce(u.parameters, '{}') || '}' || chr(10) || '</tool_call>'), chr(10))
      ELSE regexp_replace(coalesce(m.content, ''), '^[\\s\\v\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+|[\\s\\v\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+$', '', 'g') END"""


@query(
    "history_text",
    f"""WITH {_TURNS}, t AS (SELECT *, count(*) FILTER (WHERE m.role = 'user') OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS users FROM turns),
    a AS (SELECT cid, pos, users, m.content AS output FROM t WHERE m.role = 'assistant' AND NOT {_USED} AND length(trim(m.content, ' ')) > 0),
    u AS (SELECT cid, pos, row_number() OVER (PARTITION BY cid ORDER BY pos) AS k FROM turns WHERE m.role = 'user'),
    s AS (SELECT a.*, CASE WHEN users <= 3 THEN 0 ELSE u.pos END AS start FROM a LEFT JOIN u ON u.cid = a.cid AND u.k = a.users - 2),
    r AS (SELECT cid, pos, '<|im_start|>' || CASE WHEN m.role = 'tool' THEN 'user' ELSE m.role END || chr(10) || {_BLOCKS} || '<|im_end|>' || chr(10) AS line FROM turns WHERE m.role IN ('user', 'assistant', 'tool')),
    h AS (SELECT s.cid, s.pos, count(r.pos) AS n_history, coalesce(string_agg(r.line, '' ORDER BY r.pos), '') AS h, s.output FROM s LEFT JOIN r ON r.cid = s.cid AND r.pos >= s.start AND r.pos < s.pos GROUP BY s.cid, s.pos, s.output)
    SELECT cid, pos, n_history, regexp_replace(regexp_replace(h, '^<\\|im_start\\|>user\n', ''), '<\\|im_end\\|>\n$', '') AS history, output FROM h""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.history_samples(table(s, d, "dialogues"), max_turns=3)


@query(
    "call_samples",
    f"""WITH {_TURNS}, t AS (SELECT *, lead(m.role) OVER w AS nr, lead(m.tool_response) OVER w AS nt FROM turns WINDOW w AS (PARTITION BY cid ORDER BY pos)),
    bad AS (SELECT DISTINCT cid FROM t WHERE m.role = 'assistant' AND {_USED} AND nr IS NOT NULL AND nr <> 'tool')
    SELECT cid, pos, len(m.tool_usage) AS calls FROM t WHERE m.role = 'assistant' AND {_USED} AND cid NOT IN (SELECT cid FROM bad) AND NOT contains(lower(coalesce(CAST(to_json(nt) AS VARCHAR), '')), 'error')""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.call_samples(table(s, d, "dialogues")).select("cid", "pos", F.json_array_length("output").cast("long").alias("calls"))


@query(
    "turn_buckets",
    """WITH b AS (SELECT cid, coalesce(valid, false) AND curr_messages IS NOT NULL AS good, len(curr_messages) AS n, coalesce(len(list_filter(curr_messages, lambda m: m.role = 'user')), 0) AS user_turns,
      len(list_filter(list_zip(curr_messages, range(1, len(curr_messages) + 1)), lambda z: z[1].role = 'assistant' AND NOT coalesce(list_contains(possible_wrong_turns, z[2]::INT), false))) AS open,
      len(list_filter(curr_messages, lambda m: coalesce(len(m.tool_usage), 0) > 0)) AS used FROM dialogues)
    SELECT cid, user_turns, CASE WHEN NOT good THEN 'invalid' WHEN n <= 1 THEN 'only_query' WHEN open = 0 THEN 'invalid' WHEN used = 0 THEN 'no_usage' WHEN user_turns < 3 THEN 'lt3' WHEN user_turns < 5 THEN 'lt5' ELSE 'extreme' END AS bucket FROM b""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.turn_buckets(table(s, d, "dialogues"))


@query(
    "loss_mask",
    f"""WITH {_TURNS}, x AS (SELECT t.cid, pos, CASE WHEN m.role = 'assistant' AND NOT coalesce(list_contains(possible_wrong_turns, (pos + 1)::INT), false) THEN 0 ELSE 1 END AS k FROM turns t JOIN dialogues d ON d.cid = t.cid)
    SELECT cid, count(*) AS n, sum(k)::BIGINT AS masked, string_agg(k::VARCHAR, '' ORDER BY pos) AS mask FROM x GROUP BY cid""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.loss_masks(table(s, d, "dialogues").where("size(curr_messages) > 0")).select("cid", F.col("n").cast("long").alias("n"), F.col("masked").cast("long").alias("masked"), "mask")


@query(
    "trim_trailing",
    f"""WITH {_TURNS}, k AS (SELECT cid, count(*) AS n, coalesce(max(pos) FILTER (WHERE m.role IN ('assistant', 'tool')) + 1, 0) AS kept FROM turns GROUP BY cid) SELECT cid, kept, n - kept AS trimmed, kept > 0 AS valid FROM k""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.trim_trailing(table(s, d, "dialogues").where("size(curr_messages) > 0"), "assistant", "tool")


@query("last_user_turn", f"WITH {_TURNS} SELECT cid, coalesce(max(pos) FILTER (WHERE m.role = 'user' AND coalesce(len(m.tool_response), 0) = 0), count(*) - 1) AS last_user FROM turns GROUP BY cid")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.last_user_turn(table(s, d, "dialogues").where("size(curr_messages) > 0"))


@query("next_turn_peek", f"WITH {_TURNS}, x AS (SELECT m.role AS role, lead(m.role) OVER (PARTITION BY cid ORDER BY pos) AS next_role FROM turns) SELECT role, next_role, count(*) AS n FROM x GROUP BY role, next_role")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.next_turns(turns.explode_turns(table(s, d, "dialogues"))).groupBy("role", "next_role").agg(F.count("*").alias("n"))


@query(
    "role_runs",
    f"""WITH {_TURNS}, x AS (SELECT cid, m.role AS role, pos, row_number() OVER (PARTITION BY cid ORDER BY pos) - row_number() OVER (PARTITION BY cid, m.role ORDER BY pos) AS g FROM turns)
    SELECT cid, role, min(pos) AS first, count(*) AS n FROM x GROUP BY cid, role, g""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.role_runs(turns.explode_turns(table(s, d, "dialogues")))


@query(
    "merged_exchanges",
    f"""WITH {_TURNS}, t AS (SELECT *, lead(m.role) OVER w AS nr, lead(m.tool_response) OVER w AS nt FROM turns WINDOW w AS (PARTITION BY cid ORDER BY pos))
    SELECT cid, pos, len(m.tool_usage) AS n_calls, coalesce(len(nt), 0) AS n_responses, coalesce(list_transform(m.tool_usage, lambda u: u.name) = list_transform(nt, lambda u: u.name), false) AS same_names FROM t WHERE m.role = 'assistant' AND nr = 'tool' AND {_USED}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.merged_exchanges(table(s, d, "dialogues"))


@query(
    "unknown_tools",
    """WITH x AS (SELECT cid, coalesce(list_transform(tools, lambda t: t.name), []) AS names, flatten(list_transform(list_filter(curr_messages, lambda m: m.tool_usage IS NOT NULL), lambda m: list_transform(m.tool_usage, lambda u: u.name))) AS called FROM dialogues WHERE curr_messages IS NOT NULL)
    SELECT cid, len(called) AS n_calls, len(list_filter(called, lambda n: NOT list_contains(names, n))) AS unknown_tools FROM x""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.valid_turn_rate(table(s, d, "dialogues"))


@query("chat_render", f"""WITH {_TURNS} SELECT cid, md5(string_agg('<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>', chr(10) ORDER BY pos)) AS digest FROM turns GROUP BY cid""")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dialogues").where("size(curr_messages) > 0").select("cid", F.md5(text.chat_markup(F.col("curr_messages"))).alias("digest"))


@query(
    "system_prompt",
    """SELECT cid, md5('You answer questions and may call functions.' || chr(10) || chr(10) || 'The current time is ' || coalesce(curr_day, 'None') || '.' || chr(10) || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10)
      || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || coalesce(array_to_string(list_transform(tools, lambda t: chr(10) || '{"name": ' || to_json(coalesce(t.name, ''))::VARCHAR || ', "description": ' || coalesce(to_json(t.description)::VARCHAR, 'null') || ', "parameters": ' || coalesce(t.parameters, 'null') || '}'), ''), '')
      || chr(10) || '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10) || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call>.') AS digest FROM dialogues""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dialogues").select("cid", F.md5(turns.system_prompt(F.col("tools"), F.col("curr_day"))).alias("digest"))


@query("collected_turns", f"WITH {_TURNS} SELECT cid, count(*) AS n FROM turns GROUP BY cid")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.collect_turns(turns.explode_turns(table(s, d, "dialogues"))).select("cid", F.size("curr_messages").cast("long").alias("n"))


# ---- duplicates, resume, sources ---------------------------------------------------------------------------------


@query(
    "dedup_keep_longest",
    """WITH r AS (SELECT cid, snapshot_id AS seq, greatest(coalesce(len(curr_messages), 0), 0) AS n, coalesce(valid, false) AS good, min(snapshot_id) OVER (PARTITION BY cid) AS f FROM dialogue_snapshots),
    o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, seq DESC) AS k FROM r WHERE good OR seq = f) SELECT cid, seq AS kept, n AS length FROM o WHERE k = 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.keep_longest(table(s, d, "dialogue_snapshots"))


@query("exact_dup_groups", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(table(s, d, "documents"))


@query(
    "crawl_resume",
    """WITH w AS (SELECT DISTINCT cid, len(curr_messages) AS length FROM dialogue_snapshots WHERE curr_messages IS NOT NULL), a AS (SELECT cid, length, unnest(range(3)) AS attempt FROM w),
    f AS (SELECT cid, len(curr_messages) AS length, unnest(range(2)) AS attempt FROM dialogue_snapshots WHERE valid) SELECT cid, length, attempt FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cid = a.cid AND f.length = a.length AND f.attempt = a.attempt)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    snaps = table(s, d, "dialogue_snapshots")
    done = snaps.where("valid").select("cid", F.size("curr_messages").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("attempt"))
    return dedup.unfinished(snaps, done)


@query("tool_groups", "SELECT category AS tag, count(*) AS n_tools, string_agg(name, ',' ORDER BY name) AS names FROM tool_catalog GROUP BY category")
def _(s: SparkSession, d: str) -> DataFrame:
    return files.catalogue_groups(table(s, d, "tool_catalog"))


@query("rl_rows")
def _(s: SparkSession, d: str) -> DataFrame:
    samples = turns.history_samples(table(s, d, "dialogues")).select(F.col("pos").alias("index"), F.lit("").alias("instruction"), F.col("history").alias("input"), "output")
    return files.rl_rows(samples, "train", "dialogues")


# ---- calls -------------------------------------------------------------------------------------------------------

_EVENTS = """e AS (SELECT *, '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": {"k": ' || json_extract_string(props, '$.k') || '}}' || chr(10) || '</tool_call>' AS label FROM events),
 x AS (SELECT *, lead(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS response, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, lead(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_k, json_extract_string(props, '$.k') AS k FROM e)"""


def labelled_events(s: SparkSession, d: str) -> DataFrame:
    """events with label (a call text) and response (the label of the user's next event)."""
    k = F.get_json_object("props", "$.k")
    label = F.concat(F.lit('<tool_call>\n{"name": "'), "event_type", F.lit('", "arguments": {"k": '), k, F.lit("}}\n</tool_call>"))
    e = table(s, d, "events").withColumn("label", label)
    return e.withColumn("response", F.lead("label").over(W.partitionBy("user_id").orderBy("ts", "event_id")))


@query("tool_call_extract", f"""WITH {_EVENTS} SELECT event_id, 1 AS n_calls, '{{"name": "' || event_type || '", "arguments": {{"k": ' || k || '}}}}' AS body FROM x""")
def _(s: SparkSession, d: str) -> DataFrame:
    found = calls.bodies(F.col("label"))
    return labelled_events(s, d).select("event_id", F.size(found).alias("n_calls"), F.get(found, F.lit(0)).alias("body"))


@query("call_exact_reward", f"WITH {_EVENTS} SELECT event_id, CASE WHEN next_type = event_type AND next_k = k THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM x WHERE response IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = labelled_events(s, d).where("response IS NOT NULL")
    canon = lambda c: calls.canonical_calls(calls.bodies(F.col(c)))
    return rows.select("event_id", calls.exact_reward(canon("label"), canon("response")).alias("reward"))


_DAYS = "days AS (SELECT user_id, date_trunc('day', ts) AS day, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY 1, 2), p AS (SELECT user_id, day, types, lead(types) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM days)"


def daily(s: SparkSession, d: str) -> DataFrame:
    """user_id, day, types and those of the user's next day with events."""
    e = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return e.select("user_id", "day", F.transform("x", lambda x: x["event_type"]).alias("types")).withColumn("nxt", F.lead("types").over(W.partitionBy("user_id").orderBy("day"))).where("nxt IS NOT NULL")


@query(
    "call_prefix_reward",
    f"""WITH {_DAYS}, z AS (SELECT user_id, day, len(types) AS n, unnest(range(1, len(types) + 1)) AS i, types, nxt FROM p WHERE nxt IS NOT NULL),
    m AS (SELECT user_id, day, n, min(CASE WHEN types[i] IS DISTINCT FROM nxt[i] THEN i END) AS miss FROM z GROUP BY ALL) SELECT user_id, day, round(coalesce(miss - 1, n) / n, 6) AS reward FROM m""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).select("user_id", "day", r6(calls.prefix_reward(F.col("types"), F.col("nxt"))).alias("reward"))


@query(
    "multiset_jaccard",
    f"""WITH {_DAYS}, a AS (SELECT user_id, day, t, count(*) AS n FROM (SELECT user_id, day, unnest(types) AS t FROM p WHERE nxt IS NOT NULL) GROUP BY ALL), b AS (SELECT user_id, day, t, count(*) AS n FROM (SELECT user_id, day, unnest(nxt) AS t FROM p WHERE nxt IS NOT NULL) GROUP BY ALL),
    c AS (SELECT user_id, day, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (user_id, day, t) GROUP BY ALL)
    SELECT p.user_id, p.day, CASE WHEN types = nxt THEN 1.0 ELSE round(coalesce(shared, 0) / (len(types) + len(nxt) - coalesce(shared, 0)), 6) END::DOUBLE AS similarity FROM p LEFT JOIN c USING (user_id, day) WHERE nxt IS NOT NULL""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).select("user_id", "day", r6(calls.multiset_jaccard(F.col("types"), F.col("nxt"))).alias("similarity"))


_CALLS = f"""{_TURNS}, c AS (SELECT cid, pos, unnest(m.tool_usage) AS u, unnest(range(len(m.tool_usage))) AS k FROM turns WHERE {_USED}), n AS (SELECT cid || '-' || pos || '-' || k AS call_id, u.name AS name, u.parameters AS parameters FROM c)"""


def dialogue_calls(s: SparkSession, d: str) -> DataFrame:
    t = turns.explode_turns(table(s, d, "dialogues")).select("cid", "pos", F.posexplode("tool_usage").alias("k", "u"))
    return t.select(F.concat_ws("-", "cid", "pos", "k").alias("call_id"), "u.name", "u.parameters")


_KINDS = """CASE lower(coalesce(k, '')) WHEN 'string' THEN t = 'VARCHAR' WHEN 'integer' THEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'BOOLEAN') WHEN 'number' THEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'BOOLEAN', 'DOUBLE') WHEN 'boolean' THEN t = 'BOOLEAN' WHEN 'array' THEN t = 'ARRAY' WHEN 'object' THEN t = 'OBJECT' ELSE true END"""
_GIVEN = f"""o AS (SELECT call_id, name, parameters FROM n WHERE CASE WHEN json_valid(parameters) THEN json_type(parameters) = 'OBJECT' ELSE false END), e AS (SELECT call_id, name, unnest(json_keys(parameters)) AS p, parameters FROM o),
    y AS (SELECT e.call_id, e.name, p, json_type(e.parameters, '$."' || p || '"') AS t, c.parameters.properties[p].type AS k, c.parameters.properties[p] IS NOT NULL AS declared FROM e JOIN tool_catalog c ON c.name = e.name)"""


@query(
    "call_rule_check",
    f"""WITH {_CALLS}, {_GIVEN}, w AS (SELECT DISTINCT call_id FROM y WHERE declared AND NOT {_KINDS}),
    g AS (SELECT n.*, t.name IS NOT NULL AS known, coalesce(t.parameters.required, []) AS required, coalesce(map_keys(t.parameters.properties), []) AS allowed, CASE WHEN o.call_id IS NOT NULL THEN json_keys(n.parameters) END AS given, w.call_id IS NOT NULL AS wrong FROM n LEFT JOIN tool_catalog t ON t.name = n.name LEFT JOIN o ON o.call_id = n.call_id LEFT JOIN w ON w.call_id = n.call_id)
    SELECT call_id, name, CASE WHEN NOT known THEN 'unknown_tool' WHEN given IS NULL THEN 'bad_parameters' WHEN len(list_filter(required, lambda r: NOT list_contains(given, r))) > 0 THEN 'missing_parameter' WHEN len(list_filter(given, lambda r: NOT list_contains(allowed, r))) > 0 THEN 'extra_parameter' WHEN wrong THEN 'wrong_type' ELSE 'none' END AS violation FROM g""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return calls.rule_checks(dialogue_calls(s, d), table(s, d, "tool_catalog"))


@query("call_type_check", f"WITH {_CALLS}, {_GIVEN} SELECT call_id, p AS parameter, k AS declared, {_KINDS} AS fits FROM y WHERE declared")
def _(s: SparkSession, d: str) -> DataFrame:
    return calls.type_checks(dialogue_calls(s, d), table(s, d, "tool_catalog"))


@query("canonical_calls")
def _(s: SparkSession, d: str) -> DataFrame:
    return dialogue_calls(s, d).select("call_id", calls.canonical_call("parameters").alias("form"))


@query(
    "length_reward",
    r"""WITH t AS (SELECT doc_id, text, string_split(list_last(string_split(text, '<think>')), '</think>')[1] AS thought FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN round_even(least(1.0, len(list_filter(regexp_split_to_array(thought, '[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]+'), lambda w: w <> '')) / 64.0), 2)::DOUBLE ELSE 0.0 END AS reward FROM t""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", calls.length_reward(F.col("text"), 64).cast("double").alias("reward"))


@query(
    "format_reward",
    r"""WITH t AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS label FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, contains(label, '<response>') AS r, contains(label, '<tool_call>') AS c, (length(text) - length(replace(text, '<response>', ''))) // 10 AS r1, (length(text) - length(replace(text, '</response>', ''))) // 11 AS r2, (length(text) - length(replace(text, '<tool_call>', ''))) // 11 AS c1, (length(text) - length(replace(text, '</tool_call>', ''))) // 12 AS c2 FROM t WHERE label IS NOT NULL)
    SELECT doc_id, CASE WHEN r AND NOT c THEN regexp_matches(text, '(?s)^<think>.*?</think>
<response>.*?</response>
?$') AND r1 = 1 AND r2 = 1 WHEN c AND NOT r THEN regexp_matches(text, '(?s)^<think>.*?</think>
<tool_call>
.*?
</tool_call>
?$') AND c1 = 1 AND c2 = 1
      WHEN r AND c THEN regexp_matches(text, '(?s)^<think>.*?</think>
<tool_call>
.*?
</tool_call>
<response>.*?</response>
?$') AND r1 = 1 AND r2 = 1 AND c1 = 1 AND c2 = 1 ELSE regexp_matches(text, '(?s)^<think>.*?</think>
?$') END::INT::DOUBLE AS reward FROM n""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    pos = batches.numbered(docs, "doc_id")
    labels = pos.select((F.col("pos") - 1).alias("pos"), F.col("text").alias("label"))
    return pos.join(labels, "pos").select("doc_id", calls.format_reward(F.col("text"), F.col("label")).alias("reward"))


# ---- text --------------------------------------------------------------------------------------------------------


@query("clean_text_ascii", r"SELECT doc_id, md5(regexp_replace(text, '[^\x20-\x7E]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.ascii_only(F.col("text"))).alias("digest"))


@query("nfkd_normalize")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.normalized("text").alias("plain"), text.normalized_keeping_symbols("text").alias("kept"))


@query(
    "split_thought",
    r"""SELECT doc_id, CASE WHEN contains(text, '<think>') AND contains(text, '</think>') THEN regexp_extract(text, '(?s)<think>(.*?)</think>', 1) END AS thought,
    CASE WHEN contains(text, '</think>') THEN trim(list_last(string_split(text, '</think>')), chr(10)) ELSE text END AS answer FROM documents WHERE text IS NOT NULL""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.thought(t).alias("thought"), text.after_thought(t).alias("answer"))


@query("loose_calls", r"SELECT doc_id, len(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS n_calls, length(regexp_replace(text, '(?s)<tool_call>(.*?)</tool_call>', '', 'g')) AS rest FROM documents WHERE text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(calls.bodies(F.col("text"), False)).alias("n_calls"), F.length(calls.without_calls(F.col("text"))).alias("rest"))


@query(
    "date_extract",
    r"""WITH p AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT cid, CASE cid % 4 WHEN 0 THEN 'The current time is ' WHEN 1 THEN 'Today is ' ELSE 'On ' END || coalesce(curr_day, '?') FROM dialogues),
    f AS (SELECT doc_id, nullif(regexp_extract(t, 'The current time is (\d{4}-\d{2}-\d{2})', 1), '') AS c, coalesce(nullif(regexp_extract(t, 'Today is (\d{4}-\d{2}-\d{2})', 1), ''), nullif(regexp_extract(t, 'Today is (\d{2}/\d{2}/\d{4})', 1), ''), nullif(regexp_extract(t, 'Today is (\d{2}-\d{2}-\d{4})', 1), '')) AS d FROM p)
    SELECT doc_id, coalesce(c, d, '2024-04-14') AS expand, coalesce(c, 'Unknown') AS verify, d AS filter FROM f""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    phrase = F.when(F.col("cid") % 4 == 0, "The current time is ").when(F.col("cid") % 4 == 1, "Today is ").otherwise("On ")
    said = table(s, d, "dialogues").select(F.col("cid").alias("doc_id"), F.concat(phrase, F.coalesce("curr_day", F.lit("?"))).alias("t"))
    rows = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("t")).union(said)
    return rows.select("doc_id", *[text.date_in(F.col("t"), reader).alias(reader) for reader in ("expand", "verify", "filter")])


_WORDS = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[\s\v\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'), ' ')"""


@query(
    "qa_em",
    rf"WITH t AS (SELECT lang, kind, doc_id, text, lag(text) OVER (ORDER BY doc_id) AS other FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '(?s)[\x00-\x7F]*')) SELECT doc_id, {_WORDS.format('text')} = {_WORDS.format('other')} OR {_WORDS.format('text')} = {_WORDS.format('upper(text)')} AS em, contains({_WORDS.format('text')}, {_WORDS.format('substr(text, 1, 60)')}) AS within FROM t WHERE other IS NOT NULL",
)
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("doc_id", "text")
    pos = batches.numbered(docs, "doc_id")
    both = pos.join(pos.select((F.col("pos") + 1).alias("pos"), F.col("text").alias("other")), "pos")
    t = F.col("text")
    return both.select("doc_id", text.exact_match(t, F.array("other", F.upper(t))).alias("em"), text.contains_match(t, F.array(F.substring(t, 1, 60))).alias("within"))


@query(
    "final_number",
    r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(right(text, 300), '#### (-?[0-9.,]+)', 1) AS s, list_filter(regexp_extract_all(right(text, 300), '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.')) AS l FROM (SELECT doc_id, replace(text, ' - ', ' #### ') AS text FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, replace(s[-1], ',', '') AS strict, l[-1] AS loose FROM t""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    t = F.replace("text", F.lit(" - "), F.lit(" #### "))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.final_number(t).alias("strict"), text.final_number(t, False).alias("loose"))


@query("math_equal", "SELECT event_id, floor(value)::INT % 5 = user_id % 5 AS same, (floor(value)::INT % 5 = user_id % 5)::INT::DOUBLE AS score FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = F.floor("value").cast("int") % 5, F.col("user_id") % 5
    e = table(s, d, "events").select("event_id", F.concat(F.lit("thus $\\boxed{\\dfrac{"), a, F.lit("}{7}}$")).alias("solution"), F.concat(b, F.lit("/7")).alias("gold"))
    return e.select("event_id", answers.equal_answers(answers.boxed_answer("solution"), "gold").alias("same"), answers.boxed_scores("solution", "gold").alias("score"))


# ---- votes and status --------------------------------------------------------------------------------------------

_VOTES = "v AS (SELECT user_id AS uid, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), c AS (SELECT uid, event_type, count(*) AS n, min(pos) AS first, arg_min(value, pos) AS value FROM v GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY uid) AS votes FROM c)"


def ordered(s: SparkSession, d: str) -> DataFrame:
    """events as rows of responses: uid, pos (from 1), type, score, new and old log-probabilities, length."""
    e = table(s, d, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select(
        "event_id", F.col("user_id").alias("uid"), "pos", "event_type", F.col("value").alias("score"), (-F.log(1 + F.abs("value"))).alias("new"), (-F.log(1.5 + F.abs("value"))).alias("old"),
        (F.length("event_type")).alias("length"), (F.col("event_type") != "error").cast("int").alias("mask"),
    )


_TOKENS = "t AS (SELECT event_id, user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type, value AS score, -ln(1 + abs(value)) AS new, -ln(1.5 + abs(value)) AS old, length(event_type) AS length, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask FROM events)"


@query("judge_vote", f"WITH {_VOTES} SELECT uid, event_type, n, votes::BIGINT AS votes, n >= 2 AS consensus FROM b WHERE k = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.majority(ordered(s, d), "uid", "event_type", "pos")


@query("majority_value", f"WITH {_VOTES} SELECT uid, value FROM b WHERE k = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.majority_value(ordered(s, d), "uid", "event_type", "score", "pos")


@query("vote_consensus_stats", f"WITH {_VOTES} SELECT votes::BIGINT AS votes, count(*) AS n, count(*) FILTER (WHERE n >= 2) AS achieved FROM b WHERE k = 1 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.consensus_stats(votes.majority(ordered(s, d), "uid", "event_type", "pos"))


_LADDER = "CASE WHEN label = response THEN 'both_correct' WHEN next_type = event_type THEN 'model_incorrect' ELSE 'original_incorrect' END"


def ladder(s: SparkSession, d: str) -> DataFrame:
    rows = labelled_events(s, d).where("response IS NOT NULL")
    same = calls.same_calls(calls.canonical_calls(calls.bodies(F.col("label"))), calls.canonical_calls(calls.bodies(F.col("response"))))
    name = lambda c: F.get_json_object(F.get(calls.bodies(F.col(c)), F.lit(0)), "$.name")
    judged = F.when(name("label") == name("response"), "model_incorrect").otherwise("original_incorrect")
    return rows.select("event_id", "label", "response", votes.compare_status(F.col("label"), F.col("response"), same, judged).alias("status"))


@query("status_ladder", f"WITH {_EVENTS} SELECT event_id, {_LADDER} AS status FROM x WHERE response IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return ladder(s, d).select("event_id", "status")


@query("status_distribution", f"WITH {_EVENTS} SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM (SELECT {_LADDER} AS status FROM x WHERE response IS NOT NULL) GROUP BY status")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.distribution(ladder(s, d), "status").withColumn("percent", r6("percent"))


@query("error_selection", f"WITH {_EVENTS} SELECT event_id, status FROM (SELECT event_id, {_LADDER} AS status FROM x WHERE response IS NOT NULL) WHERE status <> 'both_correct'")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.errors_to_expand(ladder(s, d).withColumn("consensus", F.lit(True)).withColumnRenamed("response", "answer")).select("event_id", "status")


@query("expansion_fanout", "SELECT event_id, copy, (('0x' || substr(md5(event_id || '-' || copy), 1, 8))::BIGINT % 7) % 4 AS variant FROM (SELECT event_id, unnest(range(3)) AS copy FROM events WHERE event_type = 'error')")
def _(s: SparkSession, d: str) -> DataFrame:
    return votes.fan_out(table(s, d, "events").where("event_type = 'error'").select("event_id"), "event_id", 3)


@query("label_mapping", "SELECT event_type, CASE WHEN event_type IN ('error') THEN 'incorrect' WHEN event_type = 'click' THEN 'correct' ELSE 'failed' END AS label, count(*) AS n FROM events GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "it is INCORRECT").when(F.col("event_type") == "click", "CORRECT").otherwise("?")
    return table(s, d, "events").groupBy("event_type", votes.check_label(raw).alias("label")).agg(F.count("*").alias("n"))


# ---- advantages and returns --------------------------------------------------------------------------------------


#: Values with two decimals over group sizes often end in exactly half a millionth; both sides are shifted off such halves before rounding.
OFF_HALF = 3e-8


def _advantage(name: str, **options: object) -> Query:
    return lambda s, d: advantage.estimate(name, ordered(s, d), **options).select("event_id", r6(F.col("advantage") + OFF_HALF).alias("advantage"))


def _adv_sql(expression: str) -> str:
    return f"WITH {_TOKENS} SELECT event_id, round({expression} + {OFF_HALF}, 6) AS advantage FROM t WINDOW w AS (PARTITION BY uid), r AS (PARTITION BY uid ORDER BY score DESC, pos)"


for _name, _estimator, _expression in (
    ("adv_grpo", "grpo", "CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) END"),
    ("adv_grpo_vec", "grpo_vectorized", "CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER w) / (sqrt(greatest(var_samp(score) OVER w, 1e-6)) + 1e-6) END"),
    ("adv_drgrpo", "drgrpo", "CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END"),
    ("adv_rloo", "rloo", "CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * score - sum(score) OVER w) / (count(*) OVER w - 1) ELSE score END"),
    ("adv_rloo_vec", "rloo_vectorized", "CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * score - sum(score) OVER w) / (count(*) OVER w - 1) ELSE 0 END"),
    ("adv_opo", "opo", "CASE WHEN count(*) OVER w = 1 THEN score ELSE score - sum(length * score) OVER w / sum(length) OVER w END"),
    ("adv_passk", "pass_at_k", "CASE WHEN count(*) OVER w < 2 THEN NULL WHEN row_number() OVER r = 1 THEN (score - lead(score) OVER r) / (stddev_samp(score) OVER w + 1e-6) ELSE 0 END"),
    ("adv_gpg", "gpg", "(count(*) OVER ())::DOUBLE / greatest(count(*) FILTER (WHERE score <> 0) OVER (), 1) * (score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END)"),
):
    QUERIES[_name], SQL[_name] = _advantage(_estimator), _adv_sql(_expression)


@query("adv_reinforce_baseline", f"WITH {_TOKENS}, a AS (SELECT event_id, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS x FROM t WINDOW w AS (PARTITION BY uid)) SELECT event_id, round((x - avg(x) OVER ()) / sqrt(var_samp(x) OVER () + 1e-8) + 3e-8, 6) AS advantage FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    return _advantage("reinforce_baseline")(s, d)


@query("return_to_go", f"WITH {_TOKENS} SELECT event_id, round(sum(score) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS to_go FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return advantage.returns_to_go(ordered(s, d)).select("event_id", F.round("to_go", 5).alias("to_go"))


@query("eos_mask", f"WITH {_TOKENS} SELECT event_id, CASE WHEN coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return advantage.response_mask(ordered(s, d).drop("mask"), token="event_type", end="purchase").select("event_id", "mask")


def responses(s: SparkSession, d: str) -> DataFrame:
    """uid, pos and arrays of a user's rewards, values and masks in order."""
    g = ordered(s, d).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "new", "mask"))).alias("x"))
    part = lambda c: F.transform("x", lambda x: x[c].cast("double")).alias(c)
    return g.select("uid", part("score"), part("new"), part("mask"))


_BACKWARD = f"""RECURSIVE {_TOKENS}, z AS (SELECT *, max(pos) OVER (PARTITION BY uid) AS n FROM t)"""


@query(
    "discounted_return",
    f"""WITH {_BACKWARD}, g AS (SELECT uid, pos, mask, score AS value FROM z WHERE pos = n UNION ALL SELECT t.uid, t.pos, t.mask, t.score + 0.5 * g.value * g.mask FROM g JOIN t ON t.uid = g.uid AND t.pos = g.pos - 1)
    SELECT uid, pos, round(value + 3e-7, 5) AS value FROM g""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = responses(s, d).select("uid", F.posexplode(advantage.discounted_returns(F.col("score"), F.col("mask"), 0.5)).alias("p", "v"))
    return rows.select("uid", (F.col("p") + 1).alias("pos"), F.round(F.col("v") + 3e-7, 5).alias("value"))


@query(
    "reinforce_plus_plus",
    f"""WITH {_BACKWARD}, g AS (SELECT uid, pos, mask, score AS value FROM z WHERE pos = n UNION ALL SELECT t.uid, t.pos, t.mask, t.score + 0.5 * g.value * g.mask FROM g JOIN t ON t.uid = g.uid AND t.pos = g.pos - 1)
    SELECT uid, pos, round(mask * (value - avg(value) FILTER (WHERE mask = 1) OVER ()) / sqrt(var_samp(value) FILTER (WHERE mask = 1) OVER () + 1e-8) + 3e-8, 5) AS advantage FROM g""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = advantage.reinforce_plus_plus(responses(s, d), 0.5).select("uid", F.posexplode("advantage").alias("p", "v"))
    return rows.select("uid", (F.col("p") + 1).alias("pos"), F.round(F.col("v") + 3e-8, 5).alias("advantage"))


@query(
    "gae",
    f"""WITH {_BACKWARD}, g AS (SELECT uid, pos, n, new AS v, mask, CASE WHEN mask = 1 THEN score - new ELSE 0 END AS a, CASE WHEN mask = 1 THEN new ELSE 0 END AS carried FROM z WHERE pos = n
      UNION ALL SELECT t.uid, t.pos, g.n, t.new, t.mask, CASE WHEN t.mask = 1 THEN t.score + 0.99 * g.carried - t.new + 0.99 * 0.95 * g.a ELSE g.a END, CASE WHEN t.mask = 1 THEN t.new ELSE g.carried END FROM g JOIN t ON t.uid = g.uid AND t.pos = g.pos - 1)
    SELECT uid, pos, round(a + v + 3e-8, 5) AS returns, round((a - avg(a) FILTER (WHERE mask = 1) OVER ()) / sqrt(var_samp(a) FILTER (WHERE mask = 1) OVER () + 1e-8) + 3e-8, 5) AS advantage FROM g""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = advantage.generalized(responses(s, d).withColumnRenamed("new", "value"), 0.99, 0.95)
    cells = rows.select("uid", F.posexplode(F.arrays_zip("returns", "advantage")).alias("p", "x"))
    return cells.select("uid", (F.col("p") + 1).alias("pos"), F.round(F.col("x.returns") + 3e-8, 5).alias("returns"), F.round(F.col("x.advantage") + 3e-8, 5).alias("advantage"))


@query("adv_remax", f"WITH {_TOKENS} SELECT event_id, round(sum(score * mask) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 50 * mask + 3e-8, 5) AS advantage FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return advantage.estimate("remax", ordered(s, d).withColumn("baseline", F.lit(50.0))).select("event_id", F.round(F.col("advantage") + 3e-8, 5).alias("advantage"))


# ---- losses and metrics ------------------------------------------------------------------------------------------


@query("masked_stats", f"WITH {_TOKENS}, a AS (SELECT uid, sum(mask)::DOUBLE AS n, sum(score * mask) AS s, sum(score * score * mask) AS q FROM t GROUP BY uid) SELECT uid, n, round(s, 4) AS masked_sum, round(s / (n + 1e-8), 5) AS masked_mean, round(CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) END, 3) AS masked_var FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    m = losses.masked_stats(ordered(s, d), "score", "mask", "uid")
    return m.select("uid", "n", F.round("masked_sum", 4).alias("masked_sum"), F.round("masked_mean", 5).alias("masked_mean"), F.round("masked_var", 3).alias("masked_var"))


@query("masked_whiten", f"WITH {_TOKENS} SELECT event_id, round((score - avg(score) FILTER (WHERE mask = 1) OVER ()) / sqrt(var_samp(score) FILTER (WHERE mask = 1) OVER () + 1e-8), 6) AS score FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return advantage.whiten(ordered(s, d).withColumn("on", F.col("mask") == 1), "score", "on").select("event_id", r6("score").alias("score"))


@query(
    "kl_estimators",
    f"""WITH {_TOKENS} SELECT event_id, round(new - old, 6) AS k1, round(abs(new - old), 6) AS k_abs, round(0.5 * (new - old) * (new - old), 6) AS k2,
    round(greatest(least(exp(greatest(least(old - new, 20), -20)) - greatest(least(old - new, 20), -20) - 1, 10), -10), 6) AS k3 FROM t""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    k = lambda kind: r6(losses.kl(F.col("new"), F.col("old"), kind))
    return ordered(s, d).select("event_id", k("k1").alias("k1"), k("abs").alias("k_abs"), k("k2").alias("k2"), k("k3").alias("k3"))


_RATIO = "exp(greatest(least(new - old, 20), -20))"
_LOSS = f"CASE WHEN score - 50 < 0 THEN least((50 - score) * 3, greatest((50 - score) * {_RATIO}, (50 - score) * greatest(least({_RATIO}, 1.2), 0.8))) ELSE greatest((50 - score) * {_RATIO}, (50 - score) * greatest(least({_RATIO}, 1.2), 0.8)) END"


def _policy(s: SparkSession, d: str) -> DataFrame:
    return ordered(s, d).withColumn("loss", losses.clipped_policy_loss(F.col("new"), F.col("old"), F.col("score") - 50))


@query("ppo_clip_loss", f"WITH {_TOKENS} SELECT event_id, round({_LOSS}, 6) AS loss FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return _policy(s, d).select("event_id", r6("loss").alias("loss"))


@query(
    "loss_modes",
    f"""WITH {_TOKENS}, l AS (SELECT uid, mask, {_LOSS} AS loss FROM t), p AS (SELECT uid, sum(loss * mask) AS s, sum(mask) AS n FROM l GROUP BY uid)
    SELECT 'token-mean' AS mode, round(sum(loss * mask) / sum(mask), 5) AS loss FROM l UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 4) FROM p UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / nullif(n, 0)), 5) FROM p""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    parts = [losses.aggregate_loss(_policy(s, d), "loss", "mask", "uid", m).select(F.lit(m).alias("mode"), F.round("loss", 4 if m.endswith("sum") else 5).alias("loss")) for m in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean")]
    return parts[0].union(parts[1]).union(parts[2])


@query("value_loss", f"WITH {_TOKENS} SELECT event_id, round(0.5 * greatest((new - score) * (new - score), (greatest(least(new, old + 0.5), old - 0.5) - score) * (greatest(least(new, old + 0.5), old - 0.5) - score)), 5) AS loss FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered(s, d).select("event_id", F.round(losses.value_loss(F.col("new"), F.col("old"), F.col("score")), 5).alias("loss"))


@query("is_weights", f"WITH {_TOKENS} SELECT uid, round(least(exp(greatest(least(sum(new - old) / count(*), 20), -20)), 2.0), 6) AS weight, true AS kept FROM t GROUP BY uid")
def _(s: SparkSession, d: str) -> DataFrame:
    return losses.importance_weights(ordered(s, d), "new", "old", "uid", "geometric").select("uid", r6("weight").alias("weight"), "kept")


@query(
    "mismatch_metrics",
    f"""WITH {_TOKENS}, p AS (SELECT sum(mask) AS n, sum(new * mask) / sum(mask) AS mn, sum(old * mask) / sum(mask) AS mo, sum((old - new) * mask) AS kl, sum((exp(new - old) - (new - old) - 1) * mask) AS k3 FROM t GROUP BY uid)
    SELECT round(sum(kl) / sum(n), 6) AS kl, round(sum(k3) / sum(n), 6) AS k3, round(avg(exp(-mn)), 5) AS ppl_new, round(avg(exp(-mo)), 5) AS ppl_old, round(avg(-mn), 6) AS log_ppl_new, round(avg(-mo), 6) AS log_ppl_old, round(avg(mo - mn), 6) AS log_ppl_diff, round(avg(abs(mo - mn)), 6) AS log_ppl_abs_diff,
      round(max(mo - mn), 6) AS log_ppl_diff_max, round(min(mo - mn), 6) AS log_ppl_diff_min, round(avg(exp(mo - mn)), 6) AS ppl_ratio, round(sum(exp(mn - mo)) * sum(exp(mn - mo)) / (count(*) * sum(exp(mn - mo) * exp(mn - mo))), 6) AS ess FROM p""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    m = losses.mismatch(ordered(s, d), "new", "old", "uid", "mask")
    return m.select(*[F.round(c, 5 if c.startswith("ppl_n") or c.startswith("ppl_o") else 6).alias(c) for c in m.columns])


@query("pearson_probs", f"WITH {_TOKENS} SELECT round(max(abs(exp(new) - exp(old))), 6) AS diff_max, round(avg(abs(exp(new) - exp(old))), 6) AS diff_mean, round(stddev_samp(abs(exp(new) - exp(old))), 6) AS diff_std, round(corr(exp(new), exp(old)), 6) AS pearson FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    m = metrics.correlation(ordered(s, d), "new", "old")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("difficulty_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    m = metrics.spread(table(s, d, "events"), "value", "event_type")
    return m.select("event_type", "n", r6("mean").alias("mean"), F.round("std", 5).alias("std"), "low", "high")


@query("perplexity", f"WITH {_TOKENS} SELECT uid, round(avg(new), 6) AS mean, round(exp(-avg(new)), 4) AS perplexity FROM t GROUP BY uid")
def _(s: SparkSession, d: str) -> DataFrame:
    mean, _, ppl = metrics.difficulty(F.col("new"))
    return responses(s, d).select("uid", r6(mean).alias("mean"), F.round(ppl, 4).alias("perplexity"))


@query("eval_mean_of_means", "SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.mean_of_means(table(s, d, "events"), "event_type", "user_id", "value").select("event_type", r6("mean").alias("mean"))


@query("batch_metrics", f"WITH {_TOKENS} SELECT round(avg(score), 6) AS score_mean, max(score) AS score_max, min(score) AS score_min, round(avg(length), 6) AS length_mean, round(avg(CASE WHEN length >= 8 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS clip_ratio, 0.0::DOUBLE AS aborted_ratio, round(1 - var_samp(score - new) / (var_samp(score) + 1e-5), 6) AS explained_variance FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    m = metrics.training_metrics(ordered(s, d), "score", "new", "score", "length", 8)
    return m.select(r6("score_mean").alias("score_mean"), "score_max", "score_min", r6("length_mean").alias("length_mean"), r6("clip_ratio").alias("clip_ratio"), r6("aborted_ratio").alias("aborted_ratio"), r6("explained_variance").alias("explained_variance"))


@query("reduce_by_name", "SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM (SELECT event_type || '/' || k AS metric, value FROM events, (VALUES ('max'), ('min_err'), ('loss')) x(k)) GROUP BY metric")
def _(s: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*[F.concat("event_type", F.lit(f"/{k}")) for k in ("max", "min_err", "loss")])).alias("metric")
    return metrics.reduce_by_name(table(s, d, "events").select(names, "value")).select("metric", r6("value").alias("value"))


@query("group_metrics", "SELECT event_type, n, round(avg(m), 6) AS mean, round(avg(sd), 5) AS std, count(*) AS groups FROM (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY ALL) GROUP BY event_type, n")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.group_metrics(table(s, d, "events"), "event_type", "user_id", "value").select("event_type", "n", r6("mean").alias("mean"), F.round("std", 5).alias("std"), "groups")


@query("validation_metrics")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("hour", F.date_trunc("day", "ts")).withColumn("uid", F.concat_ws("-", "user_id", "hour"))
    return metrics.validation(e, "event_type", "uid", "value", "props", "event_id")


# ---- batches, sampling, retrieval --------------------------------------------------------------------------------


@query("repeat_interleave", "SELECT o_orderkey, copy FROM orders, range(3) r(copy)")
def _(s: SparkSession, d: str) -> DataFrame:
    return batches.repeat(table(s, d, "orders").select("o_orderkey"), 3).withColumn("copy", F.col("copy").cast("long"))


@query("chunk_k", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 4)::INT AS chunk FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    return batches.chunks(batches.numbered(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), 4).drop("pos")


@query("pad_to_divisor", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS k FROM orders) SELECT o_orderkey, pos, false AS padded FROM n UNION ALL SELECT o_orderkey, pos + k, true FROM n WHERE pos < (64 - k % 64) % 64")
def _(s: SparkSession, d: str) -> DataFrame:
    return batches.pad_to_divisor(batches.numbered(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), 64)


@query("batch_union_conflict", "SELECT count(*) AS rows, 'o_totalprice' AS column, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS conflicts FROM orders UNION ALL SELECT count(*), 'o_custkey', 0 FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return batches.union_columns(a, b, "o_orderkey")[1]


@query("balanced_partitions")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("n_chars IS NOT NULL").withColumn("batch", F.floor(F.col("doc_id") / 500))
    return batches.balanced(docs, "batch", "doc_id", "n_chars", 8)


@query("partition_imbalance")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("n_chars IS NOT NULL").withColumn("batch", F.floor(F.col("doc_id") / 500))
    return batches.imbalance(batches.balanced(docs, "batch", "doc_id", "n_chars", 8))


@query("micro_batches")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("n_chars IS NOT NULL").withColumn("mini", F.floor(F.col("doc_id") / 500))
    return batches.micro_batches(docs, "mini", "doc_id", "n_chars", 200000)


@query("workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS cost FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", batches.workload(F.col("n_chars")).alias("cost"))


@query("interleaved_by_load", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER () AS k FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, CASE WHEN pos % 2 = 0 THEN pos // 2 ELSE k - 1 - pos // 2 END AS place FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.interleaved_by_load(table(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "place")


@query("train_test_split", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2025-' || doc_id)) - 1 AS pos, count(*) OVER () AS k FROM documents) SELECT doc_id, CASE WHEN floor(k * 0.02) = 0 OR pos >= k - floor(k * 0.02) THEN 'test' ELSE 'train' END AS split FROM n")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.train_test(table(s, d, "documents").select("doc_id"), "doc_id")


@query("shuffled_head", "SELECT doc_id FROM documents ORDER BY substr(md5('42-' || doc_id), 1, 8), doc_id LIMIT 50")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled_head(table(s, d, "documents").select("doc_id"), "doc_id", 50).select("doc_id")


@query(
    "weighted_tag_sample",
    """WITH g AS (SELECT category, ln(count(*) + 1) AS w FROM tool_catalog GROUP BY category), c AS (SELECT category, sum(w) OVER (ORDER BY category) AS hi, w, sum(w) OVER () AS total FROM g),
    u AS (SELECT range AS draw, ('0x' || substr(md5('7-' || range), 1, 8))::BIGINT / 4294967296.0 AS u FROM range(500)) SELECT draw, category FROM u JOIN c ON u * total >= hi - w AND u * total < hi""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "tool_catalog").groupBy("category").agg(F.log(F.count("*") + 1).alias("w"))
    return sampling.weighted_draws(g, "category", "w", 500)


@query("top_per_group", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.top_per_group(table(s, d, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "rank")


@query(
    "retrieve_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT q.vec_id AS query, r.vec_id AS key, list_dot_product(q.e, r.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(r.e, r.e))) AS cosine FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
    SELECT query, key, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS rank FROM c) WHERE rank <= 5""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return retrieval.top_k(v, v.where("vec_id % 100 = 0"), 5).select("query", "key", r6("cosine").alias("cosine"), "rank")


from turnwise.plans import catalogue_rows, catalogue_text  # noqa: E402, F401  register their queries
