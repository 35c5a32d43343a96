"""Declared schemas of the JSON inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CALL = struct(name=S, parameters=S)
RESPONSE = struct(name=S, results=S)
MESSAGE = struct(role=S, content=S, tool_usage=T.ArrayType(CALL), tool_response=T.ArrayType(RESPONSE))
TOOL = struct(name=S, description=S, parameters=S)
SNAPSHOT = struct(cid=L, curr_messages=T.ArrayType(MESSAGE), curr_time=S, curr_day=S, tools=T.ArrayType(TOOL), tgt_turn_num=I, use_cot=B, use_func_call=B, use_plan=B, need_chat=B, is_en=B, valid=B, plan=S, possible_wrong_turns=T.ArrayType(I), possible_assistant_answers=T.ArrayType(MESSAGE), wrong_turn_count=I)
SAMPLE = struct(instruction=S, input=S, output=S)
TURN = struct(**{"from": S, "value": S})
CONVERSATION = struct(tools=T.ArrayType(TOOL), date=S, user_turns=I, plan=S, conversations=T.ArrayType(TURN))
RL_ROW = struct(data_source=S, prompt=T.ArrayType(struct(role=S, content=S)), ability=S, reward_model=struct(style=S, ground_truth=S), extra_info=struct(split=S, instruction=S, index=L, input=S, output=S))
