"""Queries over texts, calls and prompts of the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import calls, graders, markup, scores, text
from turnwise.operators import rollouts, turns
from turnwise.plans.registry import query, r6
from turnwise.sources.tables import table

_TURNS = "turns AS (SELECT cid, unnest(curr_messages) AS m, unnest(range(len(curr_messages))) AS pos FROM dialogues)"
_USED = "coalesce(len(m.tool_usage), 0) > 0"
#: Blanks of any kind around a text, for DuckDB.
_S = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text", "kind")


def messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dialogues").where("size(curr_messages) > 0")


def used(s: SparkSession, d: str) -> DataFrame:
    """cid, pos, usage of messages with calls."""
    return turns.explode_turns(table(s, d, "dialogues")).where("size(tool_usage) > 0").select("cid", "pos", F.col("tool_usage").alias("usage"))


# ---- calls -------------------------------------------------------------------------------------------------------


@query(
    "listed_calls",
    r"""WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)<tool_call>\n(.*?)\n</tool_call>', 1)[1] AS body FROM documents WHERE contains(text, '<tool_call>'))
    SELECT doc_id, coalesce(array_to_string(json_extract_string(body, '$[*].name'), ','), '') AS names FROM b WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'ARRAY' ELSE false END""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    body = F.get(calls.bodies(F.col("text")), F.lit(0))
    lists = documents(s, d).select("doc_id", body.alias("body")).where(F.startswith(F.schema_of_variant(calls.strict_json(F.col("body"))), F.lit("ARRAY")))
    named = markup.named_calls(markup.json_calls_as_blocks("body"))
    return lists.select("doc_id", F.array_join(F.transform(named, lambda c: c["name"]), ",").alias("names"))


@query(
    "piped_calls",
    r"""WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1) AS bodies FROM documents WHERE kind = 'dialogue' AND text IS NOT NULL)
    SELECT doc_id, CASE WHEN NOT contains(text, '<tool_call>') AND NOT contains(text, '</tool_call>') THEN '' WHEN contains(text, '<tool_call>') AND contains(text, '</tool_call>') AND len(list_filter(bodies, lambda x: NOT contains(x, '|') OR NOT json_valid(substr(x, instr(x, '|') + 1)))) = 0
      THEN array_to_string(list_transform(bodies, lambda x: split_part(x, '|', 1)), ',') END AS names FROM b""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("kind = 'dialogue'").select("doc_id", F.array_join(F.transform(markup.assistant_output(F.col("text"))["calls"], lambda c: c["name"]), ",").alias("names"))


@query(
    "loose_call_names",
    r"""WITH b AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda x: CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END) AS bodies FROM (SELECT doc_id, regexp_replace(text, '(?s)<tool_call>\n\[(.*?)\]\n</tool_call>', '<tool_call>\1</tool_call>', 'g') AS text FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, len(list_filter(bodies, lambda x: CASE WHEN json_valid(x) THEN json_extract_string(x, '$.name') IS NOT NULL AND json_extract(x, '$.arguments') IS NOT NULL ELSE false END)) AS n FROM b""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    opened = F.regexp_replace("text", r"(?s)<tool_call>\n\[(.*?)\]\n</tool_call>", "<tool_call>$1</tool_call>")
    return documents(s, d).select("doc_id", F.size(markup.named_calls(opened)).alias("n"))


_CHANNEL = "'<|start|>assistant<|channel|>analysis<|message|>to=functions.none<|end|>' || array_to_string(list_transform(u, lambda x: '<|start|>assistant<|channel|>commentary to=functions.' || x.name || ' <|constrain|>json<|message|>' || coalesce(x.parameters, '') || '<|call|>'), '') || 'rest'"


@query("channel_calls", f"WITH {_TURNS} SELECT cid, pos, array_to_string(list_transform(m.tool_usage, lambda x: x.name), ',') AS names, sum(1)::BIGINT AS n, 'rest' AS rest FROM turns WHERE {_USED} AND m.role IS NOT NULL GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    said = F.array_join(F.transform("usage", lambda u: F.concat(F.lit("<|start|>assistant<|channel|>commentary to=functions."), u["name"], F.lit(" <|constrain|>json<|message|>"), F.coalesce(u["parameters"], F.lit("")), F.lit("<|call|>"))), "")
    rows = used(s, d).select("cid", "pos", F.concat(F.lit("<|start|>assistant<|channel|>analysis<|message|>to=functions.none<|end|>"), said, F.lit("rest")).alias("t"))
    found = markup.channel_calls(F.col("t"))
    return rows.select("cid", "pos", F.array_join(F.transform(found, lambda c: c["name"]), ",").alias("names"), F.lit(1).cast("long").alias("n"), markup.without_channel_calls(F.col("t")).alias("rest"))


@query(
    "usage_lists",
    f"""WITH {_TURNS} SELECT cid, pos, '[' || array_to_string(list_transform(m.tool_usage, lambda u: '{{"name": ' || to_json(coalesce(u.name, ''))::VARCHAR || ', "arguments": ' || coalesce(u.parameters, 'null') || '}}'), ', ') || ']' AS calls FROM turns WHERE {_USED}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return used(s, d).select("cid", "pos", markup.usage_list(F.col("usage")).alias("calls"))


@query("response_lists", f"""WITH {_TURNS} SELECT cid, pos, CASE WHEN coalesce(len(m.tool_response), 0) = 0 THEN '' ELSE '[' || array_to_string(list_transform(m.tool_response, lambda u: '{{"name": ' || to_json(coalesce(u.name, ''))::VARCHAR || ', "results": ' || coalesce(u.results, 'null') || '}}'), ', ') || ']' END AS responses FROM turns WHERE m.role = 'tool'""")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.explode_turns(table(s, d, "dialogues")).where("role = 'tool'").select("cid", "pos", markup.response_list(F.col("tool_response")).alias("responses"))


@query("function_calls", f"WITH {_TURNS} SELECT cid, pos, len(m.tool_usage) AS n, len(m.tool_usage) AS different, true AS round_trip, lpad(pos::VARCHAR, 3, '0') || '000' AS place FROM turns WHERE {_USED}")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = used(s, d).withColumn("c", markup.function_calls(F.col("usage"), F.col("pos")))
    ids = F.transform("c", lambda x: x["id"])
    return rows.select("cid", "pos", F.size("c").alias("n"), F.size(F.array_distinct(ids)).alias("different"), (markup.usages(F.col("c")) == F.col("usage")).alias("round_trip"), F.substring(F.get(ids, F.lit(0)), -6, 6).alias("place"))


@query(
    "argument_maps",
    f"""WITH {_TURNS} SELECT cid, pos, CASE WHEN len(list_filter(m.tool_usage, lambda u: u.name IS NULL OR NOT CASE WHEN json_valid(coalesce(u.parameters, '{{}}')) THEN json_type(coalesce(u.parameters, '{{}}')) = 'OBJECT' ELSE false END)) > 0 THEN '' ELSE array_to_string(list_transform(m.tool_usage, lambda u: u.name), ',') END AS names FROM turns WHERE {_USED}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    maps = markup.argument_maps(turns.call_blocks(F.col("usage")))
    return used(s, d).select("cid", "pos", F.array_join(F.flatten(F.transform(maps, F.map_keys)), ",").alias("names"))


@query("executable_calls")
def _(s: SparkSession, d: str) -> DataFrame:
    return used(s, d).select("cid", "pos", markup.executable_calls(calls.bodies(turns.call_blocks(F.col("usage")))).alias("calls"))


@query("syntax_calls", f"WITH {_TURNS} SELECT cid, pos, len(m.tool_usage) AS n FROM turns WHERE {_USED} AND len(list_filter(m.tool_usage, lambda u: NOT regexp_full_match(u.name, '[A-Za-z_][A-Za-z_0-9.]*'))) = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    plain = used(s, d).where(F.forall("usage", lambda u: u["name"].rlike(r"\A[A-Za-z_][A-Za-z_0-9.]*\z")))
    said = F.array_join(F.transform("usage", lambda u: F.concat(u["name"], F.lit("(key='v', other=[1, 2])"))), ", ")
    return plain.select("cid", "pos", F.size(markup.syntax_calls(said)).alias("n"))


@query("safe_calls", f"WITH {_TURNS}, c AS (SELECT cid, pos, unnest(m.tool_usage) AS u, unnest(range(len(m.tool_usage))) AS k FROM turns WHERE {_USED}), f AS (SELECT *, NOT coalesce(CASE WHEN json_valid(u.parameters) THEN json_type(u.parameters) = 'OBJECT' END, false) AS failed FROM c) SELECT cid, pos, k, failed, CASE WHEN failed THEN '{{}}' ELSE u.parameters END AS arguments FROM f")
def _(s: SparkSession, d: str) -> DataFrame:
    one = used(s, d).select("cid", "pos", F.posexplode("usage").alias("k", "u")).select("cid", "pos", F.col("k").cast("long").alias("k"), F.struct(F.col("u.name").alias("name"), F.col("u.parameters").alias("arguments")).alias("c"))
    safe = markup.safe_call(F.col("c"))
    return one.select("cid", "pos", "k", safe["failed"].alias("failed"), safe["arguments"].alias("arguments"))


@query(
    "parsed_responses",
    r"""WITH t AS (SELECT doc_id, text, string_split(text, '</think>') AS p FROM documents WHERE kind = 'think' AND text IS NOT NULL),
    r AS (SELECT doc_id, CASE WHEN contains(text, '</think>') THEN ltrim(list_last(p), chr(10)) ELSE text END AS answer, CASE WHEN contains(text, '</think>') THEN ltrim(list_last(string_split(rtrim(p[1], chr(10)), '<think>')), chr(10)) ELSE '' END AS reasoning FROM t)
    SELECT doc_id, answer, reasoning, len(regexp_extract_all(answer, '(?s)<tool_call>\n(.*?)\n</tool_call>', 1)) AS n_calls FROM r""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    r = documents(s, d).where("kind = 'think'").select("doc_id", markup.parsed_response(F.col("text")).alias("r"))
    return r.select("doc_id", "r.answer", "r.reasoning", F.size("r.calls").alias("n_calls"))


# ---- instructions ------------------------------------------------------------------------------------------------


@query(
    "tools_maps",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE kind = 'tool_doc' AND length(text) > 0),
    n AS (SELECT doc_id, json_extract_string(line, '$.name') AS name FROM l WHERE json_valid(line)) SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE name IS NOT NULL))), ','), '') AS names FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    whole = documents(s, d).where("kind = 'tool_doc' AND length(text) > 0").select("doc_id", F.concat(F.lit("<tools>\n"), "text", F.lit("\n</tools>")).alias("t"))
    named = F.transform(F.split(markup.tools_text(F.col("t")), "\n"), lambda x: F.get_json_object(text.trimmed(x), "$.name"))
    return whole.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda n: n.isNotNull()))), ",").alias("names"))


@query("tools_by_name", "SELECT cid, len(list_distinct(list_transform(tools, lambda t: t.name))) AS n FROM dialogues WHERE len(tools) > 0 AND len(list_filter(tools, lambda t: t.name IS NULL)) = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "dialogues").where(F.size("tools") > 0).where(F.forall("tools", lambda t: t["name"].isNotNull()))
    distinct = F.filter("tools", lambda t, i: F.array_position(F.transform("tools", lambda x: x["name"]), t["name"]) == i + 1)
    said = F.concat(F.lit("Tools:\n<tools>\n"), turns.tool_lines(distinct), F.lit("\nnot a tool\n</tools>"))
    return rows.select("cid", F.size(F.map_keys(markup.tools_map(said))).alias("n"))


@query("listed_functions", "SELECT cid, len(list_distinct(list_transform(tools, lambda t: t.name))) AS n FROM dialogues WHERE len(tools) > 0 AND len(list_filter(tools, lambda t: t.name IS NULL)) = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "dialogues").where(F.size("tools") > 0).where(F.forall("tools", lambda t: t["name"].isNotNull()))
    distinct = F.filter("tools", lambda t, i: F.array_position(F.transform("tools", lambda x: x["name"]), t["name"]) == i + 1)
    said = F.concat(F.lit("Here is a list of functions in JSON format that you can invoke.\n["), F.array_join(F.transform(distinct, turns.tool_json), ", "), F.lit("]\n\nDo it."))
    return rows.select("cid", F.size(F.map_keys(markup.listed_functions(said))).alias("n"))


@query("function_schemas", "SELECT name, 'function' AS type, description, CASE WHEN name = 'python_interpreter' THEN 1 ELSE 0 END AS interpreter FROM tool_catalog")
def _(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tool_catalog").select(F.struct("name", "description", F.to_json("parameters").alias("parameters")).alias("t"))
    schema = t.select(markup.function_schema(F.col("t")).alias("f"))
    return schema.select("f.function.name", "f.type", "f.function.description", F.coalesce(F.col("f.function.parameters").contains('"code"').cast("int") * (F.col("f.function.name") == "python_interpreter").cast("int"), F.lit(0)).alias("interpreter"))


@query("tool_lines", """SELECT cid, md5(coalesce(array_to_string(list_transform(tools, lambda t: '{"name": ' || to_json(coalesce(t.name, ''))::VARCHAR || ', "description": ' || coalesce(to_json(t.description)::VARCHAR, 'null') || ', "parameters": ' || coalesce(t.parameters, 'null') || '}'), chr(10)), '')) AS digest FROM dialogues""")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dialogues").select("cid", F.md5(turns.tool_lines(F.col("tools"))).alias("digest"))


# ---- turns -------------------------------------------------------------------------------------------------------


@query(
    "new_turn_validity",
    f"""WITH {_TURNS}, p AS (SELECT t.*, lag(m) OVER (PARTITION BY t.cid ORDER BY pos) AS b, list_transform(d.tools, lambda x: x.name) AS names FROM turns t JOIN dialogues d ON d.cid = t.cid)
    SELECT cid, pos, CASE m.role WHEN 'assistant' THEN (pos + 1) % 2 = 0 AND len(list_filter(coalesce(m.tool_usage, []), lambda u: NOT list_contains(coalesce(names, []), u.name))) = 0
      WHEN 'tool' THEN coalesce(pos % 2 = 0 AND b.role = 'assistant' AND len(b.tool_usage) > 0 AND list_transform(b.tool_usage, lambda u: u.name) = list_transform(coalesce(m.tool_response, []), lambda u: u.name), false) ELSE true END AS valid FROM p WHERE pos > 0""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.new_turn_validity(table(s, d, "dialogues"))


@query("without_empty")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.without_empty(table(s, d, "dialogues"))


@query("incomplete_dialogues", "SELECT cid, tgt_turn_num - coalesce(len(curr_messages), 0) AS lacking FROM dialogues WHERE coalesce(len(curr_messages), 0) < tgt_turn_num")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.incomplete(table(s, d, "dialogues"))


@query(
    "first_tool_tag",
    f"""WITH {_TURNS}, f AS (SELECT cid, min(pos) AS pos FROM turns WHERE {_USED} GROUP BY cid), u AS (SELECT t.cid, unnest(t.m.tool_usage).name AS name, unnest(range(len(t.m.tool_usage))) AS k FROM turns t JOIN f ON f.cid = t.cid AND f.pos = t.pos),
    c AS (SELECT u.cid, arg_min(category, k) AS tag FROM u JOIN tool_catalog c ON c.name = u.name GROUP BY u.cid) SELECT d.cid, c.tag FROM dialogues d LEFT JOIN c ON c.cid = d.cid""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.first_tool_tag(table(s, d, "dialogues"), table(s, d, "tool_catalog"))


_BUCKET = """b AS (SELECT cid, coalesce(valid, false) AND curr_messages IS NOT NULL AS good, len(curr_messages) AS n, coalesce(len(list_filter(curr_messages, lambda m: m.role = 'user')), 0) AS user_turns,
      len(list_filter(list_zip(curr_messages, range(1, len(curr_messages) + 1)), lambda z: z[1].role = 'assistant' AND NOT coalesce(list_contains(possible_wrong_turns, z[2]::INT), false))) AS open, len(list_filter(curr_messages, lambda m: coalesce(len(m.tool_usage), 0) > 0)) AS used FROM dialogues),
    k AS (SELECT cid, user_turns, CASE WHEN NOT good THEN 'invalid' WHEN n <= 1 THEN 'only_query' WHEN open = 0 THEN 'invalid' WHEN used = 0 THEN 'no_usage' WHEN user_turns < 3 THEN 'lt3' WHEN user_turns < 5 THEN 'lt5' ELSE 'extreme' END AS bucket FROM b)"""


@query("bucket_counts", f"WITH {_BUCKET} SELECT bucket, count(*) AS n, sum(user_turns)::BIGINT AS user_turns FROM k GROUP BY bucket")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.bucket_counts(table(s, d, "dialogues"))


@query("merged_buckets", f"WITH {_BUCKET} SELECT cid FROM k WHERE bucket IN ('extreme', 'lt3', 'lt5')")
def _(s: SparkSession, d: str) -> DataFrame:
    return turns.in_buckets(table(s, d, "dialogues"), "extreme", "lt3", "lt5")


_TRANSCRIPT = """CASE m.role WHEN 'user' THEN '<user>' || coalesce(m.content, '') || '</user>' WHEN 'assistant' THEN '<assistant>' || coalesce(m.content, '') || coalesce(array_to_string(list_transform(m.tool_usage, lambda u: '<tool_usage>' || u.name || '|' || u.parameters || '</tool_usage>'), ''), '') || '</assistant>'
  WHEN 'tool' THEN '<tool>' || coalesce(array_to_string(list_transform(m.tool_response, lambda r: '<tool_response>' || r.results || '</tool_response>'), ''), '') || '</tool>' END"""


@query("transcripts", f"WITH {_TURNS} SELECT cid, md5(string_agg({_TRANSCRIPT}, chr(10) ORDER BY pos)) AS digest FROM turns GROUP BY cid")
def _(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select("cid", F.md5(turns.transcript(F.col("curr_messages"))).alias("digest"))


@query(
    "eval_prompts",
    f"""WITH {_TURNS}, q AS (SELECT cid, coalesce(max(pos) FILTER (WHERE m.role = 'user'), count(*) - 1) AS lastq, count(*) AS n FROM turns GROUP BY cid),
    t AS (SELECT t.cid, t.pos, m.role AS role, coalesce(m.content, '') AS c, lag(m.role) OVER w AS br, lead(m.role) OVER w AS ar, lastq, n FROM turns t JOIN q ON q.cid = t.cid WINDOW w AS (PARTITION BY t.cid ORDER BY t.pos)),
    p AS (SELECT *, CASE WHEN contains(c, '</think>') THEN ltrim(list_last(string_split(c, '</think>')), chr(10)) ELSE c END AS said, CASE WHEN contains(c, '</think>') THEN ltrim(list_last(string_split(rtrim(string_split(c, '</think>')[1], chr(10)), '<think>')), chr(10)) ELSE '' END AS thought FROM t),
    l AS (SELECT cid, pos, CASE role WHEN 'user' THEN '<|im_start|>user' || chr(10) || c || '<|im_end|>' || chr(10)
      WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) || CASE WHEN pos > lastq AND (pos = n - 1 OR thought <> '') THEN '<think>' || chr(10) || trim(thought, chr(10)) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(said, chr(10)) ELSE said END || '<|im_end|>' || chr(10)
      WHEN 'tool' THEN CASE WHEN br IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || c || chr(10) || '</tool_response>' || CASE WHEN ar IS DISTINCT FROM 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END ELSE '' END AS line FROM p)
    SELECT cid, md5(string_agg(line, '' ORDER BY pos) || '<|im_start|>assistant' || chr(10)) AS digest FROM l GROUP BY cid""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = messages(s, d).select("cid", F.transform("curr_messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("calls"))).alias("m"))
    users = F.filter(F.transform("m", lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    last = rows.withColumn("last", F.coalesce(F.array_max(users), F.size("m") - 1))
    return last.select("cid", F.md5(markup.eval_prompt(F.col("m"), F.col("last"))).alias("digest"))


@query(
    "simple_form",
    f"WITH {_TURNS} SELECT cid, md5(coalesce(string_agg(upper(m.role) || chr(10) || {trimmed('coalesce(m.content, chr(32))')}, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE m.role IN ('user', 'assistant')), '')) AS digest FROM turns GROUP BY cid",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select("cid", F.md5(text.simple_form(text.chat_markup(F.col("curr_messages")))).alias("digest"))


@query(
    "from_simple_form",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS part, unnest(range(len(string_split(t, chr(10) || chr(10))))) AS k FROM (SELECT doc_id, 'USER' || chr(10) || text || chr(10) || chr(10) || 'ASSISTANT' || chr(10) || text || chr(10) || chr(10) || 'OTHER' || chr(10) || 'x' AS t FROM documents WHERE kind = 'plan' AND length(text) > 0)),
    r AS (SELECT doc_id, k, {trimmed('split_part(part, chr(10), 1)')} AS role, {trimmed('substr(part, instr(part, chr(10)) + 1)')} AS said FROM p WHERE contains(part, chr(10)) AND length({trimmed('part')}) > 0)
    SELECT doc_id, md5(coalesce(string_agg('<|im_start|>' || lower(role) || chr(10) || said || '<|im_end|>', chr(10) ORDER BY k) FILTER (WHERE role IN ('USER', 'ASSISTANT')), '') || chr(10)) AS digest FROM r GROUP BY doc_id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    simple = F.concat(F.lit("USER\n"), "text", F.lit("\n\nASSISTANT\n"), "text", F.lit("\n\nOTHER\nx"))
    return documents(s, d).where("kind = 'plan' AND length(text) > 0").select("doc_id", F.md5(markup.from_simple_form(simple, lambda c: c)).alias("digest"))


def _tidy_sql() -> str:
    x = "text"
    for tag in ("tool_call", "tool_response"):
        x = rf"regexp_replace({x}, '<{tag}>{_S}*\n', '<{tag}>' || chr(10), 'g')"
        x = rf"regexp_replace({x}, '\n{_S}*</{tag}>', chr(10) || '</{tag}>', 'g')"
        x = rf"regexp_replace({x}, '</{tag}>{_S}*\n', '</{tag}>' || chr(10), 'g')"
    blank = r"[\t\f\r\v\p{Z}\x{85}\x{1c}-\x{1f}]"
    return f"regexp_replace(regexp_replace({x}, '{blank}+\\n', chr(10), 'g'), '{blank}+$', '')"


@query("strip_tag_ws", f"SELECT doc_id, {_tidy_sql()} AS tidy FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(10)) AS text FROM documents WHERE text IS NOT NULL)")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", text.tidy_tags(F.replace("text", F.lit(". "), F.lit(".  \n"))).alias("tidy"))


@query("placeholder_parts", "WITH t AS (SELECT doc_id, string_split(replace(text, '<response>', '<image>'), '<image>') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(p) - 1 AS images, len(list_filter(p, lambda x: x <> '')) AS texts FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    p = documents(s, d).select("doc_id", markup.placeholder_parts(F.replace("text", F.lit("<response>"), F.lit("<image>"))).alias("p"))
    count = lambda k: F.size(F.filter("p", lambda x: x["type"] == k)).cast("long")
    return p.select("doc_id", count("image").alias("images"), count("text").alias("texts"))


@query(
    "passages_text",
    f"SELECT kind, md5({trimmed('''string_agg('Doc ' || k || ' (Title: ' || split_part(text, chr(10), 1) || ')' || chr(10) || CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END || chr(10) || chr(10), '' ORDER BY k)''')}) AS digest FROM (SELECT kind, text, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k <= 3 GROUP BY kind",
)
def _(s: SparkSession, d: str) -> DataFrame:
    first = documents(s, d).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return first.select("kind", F.md5(markup.passages_text(F.transform(F.slice("x", 1, 3), lambda x: x["text"]))).alias("digest"))


# ---- judges and generators ---------------------------------------------------------------------------------------


@query("check_prompts", "SELECT doc_id, md5('Judge the last calls of this conversation on ' || coalesce(added_at::DATE::VARCHAR, '') || '. Tools:' || chr(10) || '<tools>' || chr(10) || coalesce(source, '') || chr(10) || '</tools>' || chr(10) || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Reply with INCORRECT or CORRECT, then ''Error Analysis:'' and the cause.') AS digest FROM documents WHERE coalesce(text, '') NOT LIKE '%{%'")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("coalesce(text, '') NOT LIKE '%{%'")
    return docs.select("doc_id", F.md5(markup.render(markup.CHECK, date=F.col("added_at").cast("date").cast("string"), tools=F.col("source"), conversation=F.col("lang"), output=F.col("text"))).alias("digest"))


@query("expansion_prompts", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN kind ELSE '' END AS correct, CASE doc_id % 3 WHEN 0 THEN kind WHEN 1 THEN text ELSE kind END AS incorrect FROM documents WHERE text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "model_incorrect").when(F.col("doc_id") % 3 == 1, "original_incorrect").otherwise("both_incorrect")
    right, wrong = markup.sides(status, F.col("text"), F.col("kind"))
    return documents(s, d).select("doc_id", right.alias("correct"), wrong.alias("incorrect"))


@query(
    "generated_samples",
    f"""WITH g AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'INPUT: ' || text ELSE 'INPUT: ' || kind || ' OUTPUT: ' || text || '  ' END AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {trimmed("split_part(substr(t, 7), 'OUTPUT:', 1)")} ELSE {trimmed("substr(t, 7, instr(t, 'OUTPUT:') - 7)")} END AS input, CASE WHEN contains(t, 'OUTPUT:') THEN {trimmed("substr(t, instr(t, 'OUTPUT:') + 7)")} END AS output FROM g)
    SELECT doc_id, input, output, coalesce(input <> '' AND output <> '' AND contains(output, '<tool_call>'), false) AS valid FROM p""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("INPUT: "), "text")).otherwise(F.concat(F.lit("INPUT: "), "kind", F.lit(" OUTPUT: "), "text", F.lit("  ")))
    g = documents(s, d).select("doc_id", markup.generated_sample(t).alias("g"))
    return g.select("doc_id", "g.input", "g.output", markup.is_valid_sample(F.col("g")).alias("valid"))


@query(
    "judgements",
    """WITH j AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'RESPONSE1_INCORRECT. Error Analysis: ' || text WHEN 1 THEN 'RESPONSE2_INCORRECT and RESPONSE1_INCORRECT' WHEN 2 THEN 'BOTH_INCORRECT. Error Analysis: both' WHEN 3 THEN 'BOTH_CORRECT' ELSE text END AS raw FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN contains(raw, 'BOTH_INCORRECT') THEN 'BOTH' WHEN contains(raw, 'RESPONSE2_INCORRECT') THEN 'RESPONSE2' WHEN contains(raw, 'RESPONSE1_INCORRECT') THEN 'RESPONSE1' ELSE 'UNKNOWN' END AS vote,
      CASE WHEN contains(raw, 'RESPONSE1_INCORRECT') THEN 'original_incorrect' WHEN contains(raw, 'RESPONSE2_INCORRECT') THEN 'model_incorrect' WHEN contains(raw, 'BOTH_CORRECT') THEN 'both_correct' WHEN contains(raw, 'BOTH_INCORRECT') THEN 'both_incorrect' ELSE 'llm_judge_failed' END AS status,
      CASE WHEN contains(raw, 'Error Analysis') THEN substr(raw, instr(raw, 'Error Analysis')) ELSE raw END AS message, CASE WHEN contains(raw, 'Error Analysis') THEN substr(raw, instr(raw, 'Error Analysis')) END AS tail FROM j""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    from turnwise.operators import votes

    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("RESPONSE1_INCORRECT. Error Analysis: "), "text")).when(k == 1, "RESPONSE2_INCORRECT and RESPONSE1_INCORRECT").when(k == 2, "BOTH_INCORRECT. Error Analysis: both").when(k == 3, "BOTH_CORRECT").otherwise(F.col("text"))
    j = documents(s, d).select("doc_id", raw.alias("raw"))
    r = F.col("raw")
    return j.select("doc_id", votes.vote_label(r).alias("vote"), markup.status_label(r).alias("status"), markup.error_message(r, F.lit(False)).alias("message"), markup.error_message(r, F.lit(False), False).alias("tail"))


@query(
    "filter_status",
    f"""WITH {_TURNS}, c AS (SELECT cid, pos, unnest(m.tool_usage).name AS name FROM turns WHERE {_USED}), k AS (SELECT cid, pos, list('no ' || c.name ORDER BY c.name) FILTER (WHERE t.name IS NULL) AS bad FROM c LEFT JOIN tool_catalog t ON t.name = c.name GROUP BY cid, pos),
    x AS (SELECT t.cid, t.pos, {_USED} AS called, coalesce(bad, []) AS bad, t.pos % 3 AS r, t.pos % 2 = 0 AS agreed FROM turns t LEFT JOIN k ON k.cid = t.cid AND k.pos = t.pos WHERE m.role = 'assistant')
    SELECT cid, pos, CASE WHEN NOT called THEN 'not_function_call' WHEN len(bad) > 0 THEN 'rule_violation' ELSE CASE r WHEN 0 THEN 'incorrect' WHEN 1 THEN 'correct' ELSE 'llm_judge_failed' END || CASE WHEN agreed THEN '' ELSE '_no_consensus' END END AS status,
      CASE WHEN NOT called THEN '' WHEN len(bad) > 0 THEN array_to_string(bad, '') WHEN r = 2 THEN 'Unexpected judge result: ?' ELSE '' END AS message FROM x""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "tool_catalog").select("name", F.lit(True).alias("known"))
    rows = turns.explode_turns(table(s, d, "dialogues")).where("role = 'assistant'").select("cid", "pos", "tool_usage")
    one = rows.select("cid", "pos", F.explode("tool_usage.name").alias("name")).join(names, "name", "left")
    bad = one.groupBy("cid", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.concat(F.lit("no "), "name")))).alias("bad"))
    label = F.when(F.col("pos") % 3 == 0, "INCORRECT").when(F.col("pos") % 3 == 1, "CORRECT").otherwise("?")
    output = F.when(F.size("tool_usage") > 0, turns.call_blocks(F.col("tool_usage"))).otherwise("")
    st = markup.filter_status(output, F.coalesce("bad", F.array().cast("array<string>")), label, F.col("pos") % 2 == 0)
    return rows.join(bad, ["cid", "pos"], "left").select("cid", "pos", st["status"].alias("status"), st["error_message"].alias("message"))


@query("user_outputs", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL ELSE {trimmed('text')} END AS said FROM documents WHERE kind = 'plan' AND text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("so <continuation>\n<user>"), "text", F.lit("</user>\n</continuation> x"))).otherwise(F.concat(F.lit("<continuation>"), "text", F.lit("</continuation>")))
    return documents(s, d).where("kind = 'plan'").select("doc_id", markup.user_output(raw).alias("said"))


@query("tool_outputs", f"WITH {_TURNS}, r AS (SELECT cid, pos, unnest(m.tool_response).results AS results, unnest(range(len(m.tool_response))) AS k FROM turns WHERE m.role = 'tool') SELECT cid, pos, k, CASE WHEN json_valid(results) THEN CASE WHEN json_type(results) = 'ARRAY' THEN results END END AS list FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = turns.explode_turns(table(s, d, "dialogues")).where("role = 'tool'").select("cid", "pos", F.posexplode("tool_response").alias("k", "r"))
    fenced = F.concat(F.lit("```json\n"), "r.results", F.lit("\n```"))
    return rows.select("cid", "pos", F.col("k").cast("long").alias("k"), markup.tool_output(fenced).alias("list"))


@query("response_predicates", "SELECT doc_id, length(text) > 0 AND doc_id % 2 = 0 AS only_text, NOT length(text) > 0 AND doc_id % 2 = 0 AS nothing FROM documents WHERE text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    image = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    r = documents(s, d).select("doc_id", F.struct("text", image.alias("image"), F.lit(None).cast("array<string>").alias("video")).alias("r"))
    return r.select("doc_id", markup.is_text_only(F.col("r")).alias("only_text"), markup.is_empty_response(F.col("r")).alias("nothing"))


@query("meta_prompts", "SELECT cid, 1 + (curr_day IS NOT NULL)::INT + coalesce(use_cot, false)::INT AS n, CASE WHEN curr_day IS NOT NULL THEN CASE WHEN coalesce(is_en, true) THEN 'Today is ' || curr_day || '.' ELSE '今天是' || curr_day || '。' END END AS told FROM dialogues")
def _(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "dialogues").select("cid", F.col("curr_day").isNotNull().alias("dated"), rollouts.meta_prompt(F.lit("You help."), F.col("curr_day"), F.col("is_en"), F.col("use_cot")).alias("p"))
    return p.select("cid", F.size("p").alias("n"), F.when(F.col("dated"), F.get("p", F.lit(1))).alias("told"))


# ---- scores ------------------------------------------------------------------------------------------------------


@query("number_scores", r"WITH t AS (SELECT doc_id, regexp_extract_all(right(text, 300), '#### (-?[0-9.,]+)', 1) AS s FROM (SELECT doc_id, replace(text, ' - ', ' #### ') AS text FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.0 WHEN replace(s[-1], ',', '') = (doc_id % 10)::VARCHAR THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", scores.number_score(F.replace("text", F.lit(" - "), F.lit(" #### ")), (F.col("doc_id") % 10).cast("string"), wrong=0.1).cast("double").alias("score"))


@query(
    "search_scores",
    r"""WITH t AS (SELECT doc_id, replace(replace(text, '<response>', '<answer>'), '</response>', '</answer>') AS t FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1) AS a, (length(t) - length(replace(t, '<answer>', ''))) // 8 AS o, (length(t) - length(replace(t, '</answer>', ''))) // 9 AS c FROM t)
    SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 WHEN doc_id % 2 = 0 THEN CASE WHEN o > 10 OR c > 10 THEN 0.25 ELSE 1.0 END ELSE 0.1 END::DOUBLE AS score, CASE WHEN len(a) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS within, o AS opened, c AS closed FROM a""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit("<response>"), F.lit("<answer>")), F.lit("</response>"), F.lit("</answer>"))
    rows = documents(s, d).select("doc_id", t.alias("t")).withColumn("a", text.last_answer(F.col("t")))
    golds = F.array(F.when(F.col("doc_id") % 2 == 0, F.concat("a", F.lit("!"))).otherwise(F.concat("a", F.lit(" more"))))
    tags = scores.answer_tags(F.col("t"))
    return rows.select("doc_id", scores.search_score(F.col("t"), golds, wrong=0.1).cast("double").alias("score"), scores.search_score(F.col("t"), F.array(F.lit("")), within=True).cast("double").alias("within"), tags["opened"].cast("long").alias("opened"), tags["closed"].cast("long").alias("closed"))


def _solutions(s: SparkSession, d: str) -> DataFrame:
    n = F.floor("value").cast("int")
    return table(s, d, "events").select("event_id", "value", "user_id", n.alias("n"), (F.col("user_id") % 7).cast("string").alias("gold"))


@query("final_scores", "SELECT event_id, CASE WHEN floor(value)::INT % 7 = user_id % 7 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, floor(value)::INT % 7 = user_id % 7 AS acc, (floor(value)::INT % 7)::VARCHAR AS pred, floor(value)::INT % 7 = user_id % 7 AS boxed FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _solutions(s, d).withColumn("k", (F.col("n") % 7).cast("string"))
    named = graders.final_scores(F.concat(F.lit("12 apples\nAnswer: 1\nanswer :  $x = "), "k", F.lit("$ units")), "gold")
    boxed = graders.strict_scores(F.concat(F.lit("so \\boxed{"), "k", F.lit("}")), "gold")
    return rows.select("event_id", named["score"].alias("score"), named["acc"].alias("acc"), named["pred"].alias("pred"), boxed["acc"].alias("boxed"))


@query("located_scores", "SELECT event_id, floor(value)::INT IN (user_id, user_id * 100) OR floor(value)::INT * 100 = user_id AS correct, floor(value)::INT::VARCHAR AS answer, (0.9 * (floor(value)::INT = user_id)::INT + 0.1)::DOUBLE AS figure FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _solutions(s, d).withColumn("said", F.concat(F.lit("We add. The answer is "), F.col("n").cast("string")))
    gold = F.concat(F.col("user_id").cast("string"), F.lit(".0"))
    located = graders.located_scores("said", gold)
    return rows.select("event_id", located["correct"].alias("correct"), located["answer"].alias("answer"), graders.figure_scores(F.concat(F.lit("<think>x</think> \\boxed{"), F.col("n").cast("string"), F.lit("}")), gold).alias("figure"))


_CALL_TEXT = "e AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events)"


def call_pairs(s: SparkSession, d: str) -> DataFrame:
    """event_id, label, rendered response, length: a call for each event, and a response for the user's next one; errors stand for plain texts."""
    from pyspark.sql import Window as W

    e = table(s, d, "events").withColumn("nt", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("nt IS NOT NULL")
    said = lambda c: F.when(F.col(c) == "error", "no call").otherwise(F.concat(F.lit('<tool_call>\n{"name": "'), c, F.lit('", "arguments": {}}\n</tool_call>')))
    return e.select("event_id", "event_type", "nt", said("event_type").alias("gold"), F.concat(F.lit("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"), said("nt"), F.lit("<|im_end|>")).alias("response"), F.length("event_type").alias("length"))


@query("call_scores", f"WITH {_CALL_TEXT} SELECT event_id, CASE WHEN event_type = nt THEN 3.0 ELSE -3.0 END::DOUBLE AS score, CASE WHEN event_type = nt THEN 1.0 ELSE 0.0 END::DOUBLE AS partial FROM e WHERE nt IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    t, g = F.col("response"), F.col("gold")
    return call_pairs(s, d).select("event_id", scores.call_score(t, g)["score"].alias("score"), scores.call_score(t, g, best=1.0, worst=0.0, partial=True)["correctness"].alias("partial"))


@query("scored_by_source", f"WITH {_CALL_TEXT} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type = nt THEN 3.0 ELSE -3.0 END ELSE 0.0 END::DOUBLE AS score, least(-(length(event_type) - 4.0) / 4, 0)::DOUBLE AS penalty FROM e WHERE nt IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = call_pairs(s, d).withColumn("data_source", F.when(F.col("event_id") % 2 == 0, "calls").otherwise("gsm"))
    out = scores.managed("overlong", rows, longest=8, buffer=4, sources={"gsm": "numbers"})
    return out.select("event_id", "score", F.col("penalty").cast("double").alias("penalty"))


@query("pass_rates", "WITH r AS (SELECT user_id, list(event_type <> 'error' ORDER BY ts, event_id) AS ok FROM events GROUP BY user_id) SELECT user_id, (len(list_filter(ok, lambda x: NOT x)) = 0)::INT::DOUBLE AS whole, round(len(list_filter(ok[1:10], lambda x: x)) / least(len(ok), 10), 6) AS share FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") != "error").alias("ok")))).alias("x"))
    ok = F.transform("x", lambda x: x["ok"])
    return r.select("user_id", scores.pass_rate(ok).alias("whole"), r6(scores.pass_rate(ok, True)).alias("share"))


@query("same_outputs", f"SELECT doc_id, {trimmed('text')} = {trimmed('lower(text)')} AS same FROM documents WHERE text IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", scores.same_output(F.split(F.concat(F.lit("\n "), "text"), "\n"), F.array(F.lower("text"))).alias("same"))
