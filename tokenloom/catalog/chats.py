"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.common import query, sql_byte_list, table
from tokenloom.functions import chat
from tokenloom.functions import tokens as T
from tokenloom.operators import conversations as C
from tokenloom.operators import packing
from tokenloom.operators.offsets import dense_index, integer_levels
from tokenloom.session import scratch_path
from tokenloom.sources import records

CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)"
TEXT = "array_to_string(list_transform({m}, lambda x: x.role || ':' || x.content), chr(10))"
MERGED = """merged AS (SELECT conv_id, CASE WHEN m[1].role <> 'system' THEN m WHEN m[2].role = 'user'
  THEN list_prepend({'role': 'user', 'content': m[1].content || chr(10) || chr(10) || m[2].content}, m[3:]) END AS m FROM conv)"""
_ORDER_OK = "len(list_filter(list_zip({m}, range(len({m}))), lambda z: z[1].role <> CASE WHEN z[2] % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0"


def convs(spark, sf):
    return C.conversations_from_turns(table(spark, sf, "conversations"))


@query("S7_conversations_from_turns", f"WITH {CONV} SELECT conv_id, len(m)::INTEGER AS n, {TEXT.format(m='m')} AS body FROM conv")
def s7(spark, sf):
    return convs(spark, sf).select("conv_id", F.size("messages").alias("n"), C.messages_text(F.col("messages")).alias("body"))


_REASON = """CASE WHEN len(rest) < 2 THEN 'too_few_messages' WHEN NOT (""" + _ORDER_OK.format(m="rest") + """) THEN 'bad_role_order' ELSE 'valid' END"""


@query("P5_validate_conversations", f"WITH {CONV}, r AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS rest FROM conv) SELECT conv_id, {_REASON} AS verdict FROM r")
def p5(spark, sf):
    good, bad = C.validate_conversations(convs(spark, sf))
    return good.select("conv_id", F.lit("valid").alias("verdict")).unionByName(bad.select("conv_id", F.col("reason").alias("verdict")))


@query("S6_conversations_jsonl", f"WITH {CONV} SELECT CASE WHEN len(rest) < 2 THEN 'too_few_messages' WHEN NOT ({_ORDER_OK.format(m='rest')}) THEN 'bad_role_order' ELSE 'valid' END AS verdict, count(*)::BIGINT AS n, sum(len(rest))::BIGINT AS messages FROM (SELECT m AS rest FROM conv) GROUP BY 1")
def s6(spark, sf):
    path = scratch_path(spark, "chats")
    slim = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    # A blank line after each conversation must not matter.
    convs(spark, sf).select(F.concat(F.to_json(slim), F.lit("\n")).alias("value")).write.text(path)
    good, bad = records.read_conversations_jsonl(spark, path)
    count = F.size(F.from_json("line", "array<struct<role:string>>"))
    both = good.select(F.lit("valid").alias("verdict"), F.size("messages").alias("k")).unionByName(
        bad.select(F.col("reason").alias("verdict"), count.alias("k")))
    return both.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("k").alias("messages"))


@query("P6_filter_chat_limits", f"""WITH {CONV} SELECT conv_id, CASE
   WHEN len(m) > 500 THEN 'too_many_messages'
   WHEN len(list_filter(m, lambda x: length(x.content) > 8000)) > 0 THEN 'message_too_long'
   WHEN list_sum(list_transform(m, lambda x: length(x.content))) > 32000 THEN 'conversation_too_long'
   WHEN len(list_filter(m, lambda x: x.role NOT IN ('user', 'assistant'))) > 0 THEN 'invalid_role' ELSE 'accepted' END AS verdict FROM conv""")
def p6(spark, sf):
    good, bad = C.filter_chat_limits(convs(spark, sf))
    return good.select("conv_id", F.lit("accepted").alias("verdict")).unionByName(bad.select("conv_id", F.col("reason").alias("verdict")))


@query("P7_merge_system_message", f"WITH {CONV}, {MERGED} SELECT conv_id, {TEXT.format(m='m')} AS body FROM merged WHERE m IS NOT NULL")
def p7(spark, sf):
    good, _ = C.merge_system_message(convs(spark, sf))
    return good.select("conv_id", C.messages_text(F.col("messages")).alias("body"))


@query("P8_prompt_only", f"WITH {CONV} SELECT conv_id, {TEXT.format(m='m[:-2]')} AS body FROM conv WHERE m[-1].role = 'assistant'")
def p8(spark, sf):
    good, _ = C.prompt_only(convs(spark, sf))
    return good.select("conv_id", C.messages_text(F.col("messages")).alias("body"))


def _rendered(source: str) -> str:
    b = sql_byte_list("c")
    return f"""msgs AS (SELECT conv_id, i, m[i].role AS role, m[i].content AS c FROM (SELECT conv_id, m, unnest(range(1, len(m) + 1)) AS i FROM {source} WHERE m IS NOT NULL AND len(m) > 0 AND {_ORDER_OK.format(m='m')})),
    coded AS (SELECT conv_id, i, role, {b} AS b FROM msgs),
    seg AS (SELECT conv_id, i, CASE role WHEN 'user' THEN list_concat([259], list_append(b, 260)) ELSE list_concat([261], list_append(b, 262)) END AS ids,
      CASE role WHEN 'user' THEN list_transform(range(len(b) + 2), lambda z: 0) ELSE list_concat([0], list_transform(range(len(b) + 1), lambda z: 1)) END AS mask FROM coded),
    rendered AS (SELECT conv_id, list_prepend(258, flatten(list(ids ORDER BY i)))[1:2048] AS ids, list_prepend(0, flatten(list(mask ORDER BY i)))[1:2048] AS mask FROM seg GROUP BY 1)"""


def _render(spark, sf):
    merged, _ = C.merge_system_message(convs(spark, sf))
    good, _ = C.validate_conversations(merged, min_messages=1, allow_system=False)
    return C.render_conversations(good, markers=False)


_R = f"WITH {CONV}, {MERGED}, {_rendered('merged')}"


@query("F5_render_conversation", f"{_R} SELECT conv_id, array_to_string(ids, ',') AS ids, array_to_string(mask, ',') AS mask FROM rendered")
def f5(spark, sf):
    return _render(spark, sf).select("conv_id", T.ids_text(F.col("ids")).alias("ids"), T.ids_text(F.col("mask")).alias("mask"))


@query("F6_render_for_completion", f"""WITH {CONV.replace('conv AS', 'conv0 AS')}, conv AS (SELECT conv_id, m[:-2] AS m FROM conv0 WHERE m[-1].role = 'assistant'), {MERGED}, {_rendered('merged')}
  SELECT conv_id, array_to_string(list_append(ids, 261), ',') AS ids FROM rendered""")
def f6(spark, sf):
    good, _ = C.validate_conversations(convs(spark, sf), min_messages=1)
    return C.render_for_completion(good, markers=False).select("conv_id", T.ids_text(F.col("ids")).alias("ids"))


@query("F7_supervision_rate", f"{_R} SELECT conv_id, list_sum(mask) / len(mask) AS rate FROM rendered")
def f7(spark, sf):
    return _render(spark, sf).select("conv_id", chat.supervision_rate(F.col("mask")).alias("rate"))


@query("O5_truncate_tokens", f"{_R} SELECT conv_id, array_to_string(ids[1:256], ',') AS ids, array_to_string(mask[1:256], ',') AS mask FROM rendered")
def o5(spark, sf):
    r = _render(spark, sf)
    return r.select("conv_id", T.ids_text(T.truncate_tokens(F.col("ids"), 256)).alias("ids"),
                    T.ids_text(T.truncate_tokens(F.col("mask"), 256)).alias("mask"))


_SHIFT = "list_transform(list_zip(ids[2:], mask[2:]), lambda z: CASE WHEN z[2] = 0 THEN -1 ELSE z[1] END)"


@query("W3_shift_targets", f"{_R} SELECT conv_id, array_to_string(ids[:-2], ',') AS inputs, array_to_string({_SHIFT}, ',') AS targets FROM rendered")
def w3(spark, sf):
    inputs, targets = packing.shift_targets(F.col("ids"), F.col("mask"))
    return _render(spark, sf).select("conv_id", T.ids_text(inputs).alias("inputs"), T.ids_text(targets).alias("targets"))


@query("A16_supervised_tokens", f"{_R}, n AS (SELECT (row_number() OVER (ORDER BY conv_id) - 1) // 16 AS step, len(list_filter({_SHIFT}, lambda t: t >= 0)) AS k FROM rendered) SELECT step::BIGINT AS step, sum(k)::BIGINT AS num_tokens FROM n GROUP BY 1")
def a16(spark, sf):
    _, targets = packing.shift_targets(F.col("ids"), F.col("mask"))
    rows = _render(spark, sf).select("conv_id", packing.supervised_tokens(targets).alias("k"))
    indexed = dense_index(rows, [F.col("conv_id")], integer_levels(F.col("conv_id")))
    return indexed.groupBy(F.floor(F.col("idx") / 16).alias("step")).agg(F.sum("k").alias("num_tokens"))


# Samples of one example: the replies of a conversation stand in for sampled completions.
_ROLL = f"""s AS (SELECT conv_id, turn, {sql_byte_list('text')} AS b FROM conversations WHERE role = 'assistant'),
  r AS (SELECT conv_id, turn, list_concat([258, 261], b) AS ids, list_concat([0, 0], list_transform(b, lambda z: 1)) AS mask FROM s),
  w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM r),
  p AS (SELECT conv_id, turn, list_concat(ids, list_transform(range(width - len(ids)), lambda z: 262)) AS ids, list_concat(mask, list_transform(range(width - len(mask)), lambda z: 0)) AS mask FROM w)"""


@query("W3b_shift_rollout_targets", f"WITH {_ROLL} SELECT conv_id, turn, array_to_string(ids[:-2], ',') AS inputs, array_to_string({_SHIFT}, ',') AS targets FROM p")
def w3b(spark, sf):
    replies = table(spark, sf, "conversations").where("role = 'assistant'")
    body = T.text_byte_ids(F.col("text"))
    rolls = replies.select("conv_id", "turn", body.alias("b")).select(
        "conv_id", "turn", F.concat(F.array(F.lit(258), F.lit(261)), "b").alias("ids"),
        F.concat(F.array(F.lit(0), F.lit(0)), F.transform("b", lambda x: F.lit(1))).alias("mask"))
    out = packing.shift_rollout_targets(rolls, "conv_id", T.ASSISTANT_END_ID)
    return out.select("conv_id", "turn", T.ids_text(F.col("inputs")).alias("inputs"), T.ids_text(F.col("targets")).alias("targets"))


@query("F20_flatten_game", f"""WITH {CONV} SELECT conv_id, CASE WHEN ok THEN 'tic-tac-toe' ELSE 'calculator' END AS kind, CASE WHEN ok THEN m[1].content END AS prompt,
   CASE WHEN ok THEN array_to_string(list_transform(m[2:], lambda x: x.content), chr(10)) END AS json FROM (SELECT *, len(m) >= 2 AND m[-1].role = 'assistant' AS ok FROM conv)""")
def f20(spark, sf):
    return C.flatten_games(convs(spark, sf))
