"""Checks and rewrites of a ``messages`` column, as Catalyst expressions.

A message is ``STRUCT<role, content, parts>``; exactly one of ``content`` and ``parts``
(``ARRAY<STRUCT<type, text>>``) is set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions import tokens as T

PARTS_TYPE = "array<struct<type:string,text:string>>"
MESSAGE_TYPE = f"struct<role:string,content:string,parts:{PARTS_TYPE}>"
MESSAGES_TYPE = f"array<{MESSAGE_TYPE}>"

# Limits of a chat request.
MAX_MESSAGES = 500
MAX_MESSAGE_CHARS = 8_000
MAX_TOTAL_CHARS = 32_000


def message(role, content: Column | None = None, parts: Column | None = None) -> Column:
    return F.struct(
        (role if isinstance(role, Column) else F.lit(role)).alias("role"),
        (F.lit(None) if content is None else content).cast("string").alias("content"),
        (F.lit(None) if parts is None else parts).cast(PARTS_TYPE).alias("parts"),
    )


def starts_with_system(messages: Column) -> Column:
    return F.coalesce(F.get(messages, 0)["role"] == "system", F.lit(False))


def _bad_order(rest: Column) -> Column:
    expected = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    flags = F.transform(rest, lambda m, i: ~m["role"].eqNullSafe(expected(i)))
    return F.exists(flags, lambda f: f)


def validation_reason(messages: Column, min_messages: int = 2, allow_system: bool = True) -> Column:
    """Null for a valid conversation, otherwise the first rule it breaks."""
    def check(rest):
        return (F.when(F.size(rest) < min_messages, "too_few_messages")
                .when(_bad_order(rest), "bad_role_order")
                .when(F.exists(rest, lambda m: m["content"].isNull() & m["parts"].isNull()), "missing_content"))

    rest = messages
    if allow_system:
        rest = F.when(starts_with_system(messages), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.when(messages.isNull() | (F.size(messages) < 1), "no_messages").otherwise(T.let(rest, check))


def chat_limit_reason(messages: Column) -> Column:
    """Null for a request within the limits, otherwise the first limit it breaks."""
    per_message = F.transform(messages, lambda m: F.when(F.coalesce(F.length(m["content"]), F.lit(0)) == 0, "empty_content")
                              .when(F.length(m["content"]) > MAX_MESSAGE_CHARS, "message_too_long"))
    first = F.get(F.filter(per_message, lambda r: r.isNotNull()), 0)
    total = F.aggregate(messages, F.lit(0).cast("bigint"), lambda s, m: s + F.length(m["content"]))
    strange = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)))
    return (F.when(F.size(messages) <= 0, "no_messages")
            .when(F.size(messages) > MAX_MESSAGES, "too_many_messages")
            .otherwise(F.coalesce(first, F.when(total > MAX_TOTAL_CHARS, "conversation_too_long"),
                                  F.when(strange, "invalid_role"))))


def merge_system(messages: Column) -> Column:
    """System text in front of the first user message; null when no user message follows it."""
    first, second = F.get(messages, 0), F.get(messages, 1)
    joined = message("user", F.concat(first["content"], F.lit("\n\n"), second["content"]))
    merged = F.concat(F.array(joined), F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0))))
    return F.when(~starts_with_system(messages), messages).when(second["role"] == "user", merged)


def without_reply(messages: Column) -> Column:
    """All but the last message; null unless the last one is from the assistant."""
    last = F.get(messages, F.size(messages) - 1)
    return F.when(last["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1))


# ---------------------------------------------------------------- rendering

_SEGMENT = "struct<pre:string,text:string,mask:string,post:string,pre_mask:string,post_mask:string>"
# Between segments: a character that no token has (see ``T.MAX_TOKENS``).
_SEPARATOR = "\U0010ffff"


def _segment(pre: str, text: Column, mask: str, post: str, pre_mask: str, post_mask: str) -> Column:
    return F.struct(F.lit(pre).alias("pre"), text.alias("text"), F.lit(mask).alias("mask"), F.lit(post).alias("post"),
                    F.lit(pre_mask).alias("pre_mask"), F.lit(post_mask).alias("post_mask"))


def _part_segment(part: Column) -> Column:
    c = T.token_char
    return (F.when(part["type"] == "python", _segment(c(T.PYTHON_START_ID), part["text"], "1", c(T.PYTHON_END_ID), "1", "1"))
            .when(part["type"] == "python_output", _segment(c(T.OUTPUT_START_ID), part["text"], "0", c(T.OUTPUT_END_ID), "0", "0"))
            .otherwise(_segment("", part["text"], "1", "", "", "")))


def segments(messages: Column) -> Column:
    """The encodable pieces of a conversation with their fixed tokens and supervision flags."""
    c, nothing = T.token_char, F.lit("")

    def of(m):
        user = F.array(_segment(c(T.USER_START_ID), m["content"], "0", c(T.USER_END_ID), "0", "0"))
        plain = F.array(_segment(c(T.ASSISTANT_START_ID), m["content"], "1", c(T.ASSISTANT_END_ID), "0", "1"))
        parts = F.concat(F.array(_segment(c(T.ASSISTANT_START_ID), nothing, "1", "", "0", "")),
                         F.transform(m["parts"], _part_segment),
                         F.array(_segment("", nothing, "1", c(T.ASSISTANT_END_ID), "", "1")))
        return F.when(m["role"] == "user", user).when(m["parts"].isNull(), plain).otherwise(parts)

    return F.flatten(F.transform(messages, of)).cast(f"array<{_SEGMENT}>")


def framed_segments(segs: Column) -> Column:
    """All segment texts as one framed token string, so one pass of merging serves them all."""
    return F.array_join(F.transform(segs, lambda s: T.framed_token_string(F.coalesce(s["text"], F.lit("")))), _SEPARATOR)


def assemble(segs: Column, merged: Column, markers: bool) -> Column:
    """``STRUCT<tokens, mask>`` strings from segments and their merged texts, begin mark included."""
    def one(seg, body):
        done = T.finish_token_string(body, F.coalesce(seg["text"], F.lit("")), markers)
        return F.struct(F.concat(seg["pre"], done, seg["post"]).alias("t"),
                        F.concat(seg["pre_mask"], F.repeat(seg["mask"], F.length(done)), seg["post_mask"]).alias("m"))

    pieces = F.zip_with(segs, F.split(merged, _SEPARATOR, -1), one)
    join = lambda ps, f: F.array_join(F.transform(ps, lambda p: p[f]), "")
    return T.let(pieces, lambda ps: F.struct(
        F.concat(F.lit(T.token_char(T.BOS_ID)), join(ps, "t")).alias("tokens"),
        F.concat(F.lit("0"), join(ps, "m")).alias("mask")))


def mask_array(mask: Column) -> Column:
    return F.transform(F.split(mask, ""), lambda c: c.cast("tinyint"))


def supervision_rate(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, m: s + m) / F.size(mask)
