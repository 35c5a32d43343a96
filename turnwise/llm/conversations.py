"""Rebuilding conversations from message rows: partition, secondary sort, finite-state automaton.

Rows are range-partitioned by (conversation, sequence), so one huge conversation is spread over as many tasks
as its rows need. Each task runs the automaton over its sorted rows from every start state at once and emits one
summary for each piece of a conversation (the piece's transition map and its ends); the pieces of a
conversation are then composed in order. A summary has a fixed size, whatever the piece holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.visible import is_filled

#: Spellings of the three roles, in lower case without outer blanks.
ROLES = {"user": ("user", "human", "customer", "prompter"), "assistant": ("assistant", "gpt", "bot", "model", "ai", "chatbot"), "tool": ("tool", "function", "observation", "obs", "ipython", "tool_response")}
#: Symbols: a user message, an assistant message with tool calls, a tool message, an assistant message without, anything else.
USER, CALL, TOOL, ANSWER, BAD = range(5)
#: States: 0 between exchanges (start, accepting), 1 an assistant message is due, 2 a tool message is due, 3 dead. STEP[state][symbol].
STEP = np.array([[1, 3, 3, 3, 3], [3, 2, 3, 0, 3], [3, 3, 1, 3, 3], [3, 3, 3, 3, 3]], dtype=np.int8)
PIECE = "cid long, first_turn int, first_at timestamp_ntz, first_row long, last_turn int, n long, numbered long, flaw boolean, to0 int, to1 int, to2 int"


def plain_role(role: Column) -> Column:
    r = F.regexp_replace(F.lower(role), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    out = F.lit("other")
    for name, spellings in ROLES.items():
        out = F.when(r.isin(*spellings), name).otherwise(out)
    return out


def deliveries(rows: DataFrame) -> DataFrame:
    """One slim row for each message, however often it was delivered: the row with the smallest row_id stands for all.

    Deliveries of one message are equal in everything but row_id, ingested_at, worker, the spelling of role and
    is_en, a label that may be missing in one of them. Texts are compared by 128 bits of hash within
    (cid, turn_no, sent_at). Rows without cid belong to no conversation."""
    body = [F.col(c) for c in ("content", "tool_usage", "tool_response")]
    role = plain_role(F.col("role"))
    calls = F.coalesce(F.size("tool_usage") > 0, F.lit(False))
    symbol = (
        F.when(~is_filled({c: F.col(c) for c in ("content", "tool_usage", "tool_response")}), BAD).when(role == "user", USER).when(role == "tool", TOOL)
        .when((role == "assistant") & calls, CALL).when(role == "assistant", ANSWER).otherwise(BAD)
    )
    slim = rows.where("cid IS NOT NULL").select(
        "cid", "turn_no", "sent_at", "valid", symbol.cast("tinyint").alias("symbol"), role.alias("role"), F.xxhash64(*body).alias("h1"), F.xxhash64(F.lit(7), *body).alias("h2"), "row_id"
    )
    return slim.groupBy("cid", "turn_no", "sent_at", "valid", "symbol", "role", "h1", "h2").agg(F.min("row_id").alias("row_id"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The summary of each run of rows with one cid in a batch of sorted rows."""
    for b in batches:
        n = len(b)
        if not n:
            continue
        cid, symbol = b["cid"].to_numpy(), b["symbol"].to_numpy()
        turn = b["turn_no"].to_numpy(dtype="float64", na_value=np.nan)
        start = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
        end = np.r_[start[1:], n]
        same = np.r_[False, cid[1:] == cid[:-1]]
        # a row after the first of its piece must come one number later; rows without numbers are judged by the counts
        jump = same & ~np.isnan(turn) & ~np.isnan(np.r_[np.nan, turn[:-1]]) & (turn - np.r_[0, turn[:-1]] != 1)
        flaw = np.add.reduceat((jump | b["refused"].to_numpy(dtype=bool)).astype(np.int64), start) > 0
        numbered = np.add.reduceat((~np.isnan(turn)).astype(np.int64), start)
        maps = np.empty((len(start), 3), dtype=np.int32)
        for i, (s, e) in enumerate(zip(start, end)):
            f = (0, 1, 2)
            for x in symbol[s:e].tolist():
                f = (STEP[f[0], x], STEP[f[1], x], STEP[f[2], x])
                if f[0] == f[1] == f[2] == 3:
                    break
            maps[i] = f
        whole = lambda at: pd.array([None if np.isnan(x) else int(x) for x in turn[at]], dtype="Int32")
        yield pd.DataFrame(
            {"cid": cid[start], "first_turn": whole(start), "first_at": b["sent_at"].to_numpy()[start], "first_row": b["row_id"].to_numpy()[start], "last_turn": whole(end - 1), "n": end - start, "numbered": numbered, "flaw": flaw, "to0": maps[:, 0], "to1": maps[:, 1], "to2": maps[:, 2]}
        )


def judged(rows: DataFrame) -> DataFrame:
    """cid, messages, kept for each conversation.

    Kept: no row has valid false, every message has visible content or calls or responses, the numbers (if given)
    start at 0 or 1 and have neither gaps nor two messages at one number, and the roles form whole exchanges.
    A conversation with some messages numbered and others not counts as one with gaps. Without numbers the order
    is sent_at, then row_id; a null sent_at comes first. Null valid counts as valid. An empty table gives no rows.
    """
    slim = deliveries(rows).select("cid", "turn_no", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), "row_id", "symbol", (~F.coalesce("valid", F.lit(True))).alias("refused"))
    keys = ["cid", F.col("turn_no").asc_nulls_last(), "sent_at", "row_id"]
    pieces = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_pieces, PIECE)
    order = F.struct(F.coalesce("first_turn", F.lit(2147483647)).alias("t"), "first_at", "first_row", "last_turn", "first_turn", "flaw", F.array("to0", "to1", "to2", F.lit(3)).alias("to"))
    joined = pieces.groupBy("cid").agg(F.sum("n").alias("messages"), F.sum("numbered").alias("numbered"), F.array_sort(F.collect_list(order)).alias("p"))
    end = F.aggregate("p", F.lit(0), lambda state, x: F.get(x["to"], state))
    gaps = F.aggregate(
        "p", F.struct(F.lit(None).cast("int").alias("last"), F.lit(False).alias("bad")),
        lambda a, x: F.struct(x["last_turn"].alias("last"), (a["bad"] | x["flaw"] | (F.coalesce(x["first_turn"] - a["last"], F.lit(1)) != 1)).alias("bad")),
    )["bad"]
    first = F.col("p")[0]["first_turn"]
    return joined.select("cid", "messages", ((end == 0) & ~gaps & F.col("numbered").isin(0, F.col("messages")) & (first.isNull() | first.isin(0, 1))).alias("kept"))


def conversations(rows: DataFrame) -> DataFrame:
    """cid, n_messages, curr_messages of each kept conversation, in order, with plain role names."""
    kept = judged(rows).where("kept").select("cid")
    one = deliveries(rows).select("row_id")
    parts = rows.join(one, "row_id", "left_semi").join(kept, "cid", "left_semi")
    place = F.struct("turn_no", "sent_at", "row_id", F.struct(plain_role(F.col("role")).alias("role"), "content", "tool_usage", "tool_response").alias("message"))
    whole = parts.groupBy("cid").agg(F.array_sort(F.collect_list(place)).alias("m"))
    return whole.select("cid", F.size("m").alias("n_messages"), F.transform("m", lambda x: x["message"]).alias("curr_messages"))


def found(rows: DataFrame) -> DataFrame:
    """cid of each conversation that must be dropped."""
    return judged(rows).where("NOT kept").select("cid")
