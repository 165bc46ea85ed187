"""Conversations as tables: building, checking, rewriting and rendering to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import chat
from tokenloom.functions import tokens as T
from tokenloom.operators import bpe


def conversations_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                             text: str = "text") -> DataFrame:
    """One ``messages`` array per conversation in turn order, of any length.

    A conversation is one row, as its readers need it; ``filter_chat_limits`` sets aside long ones with a reason.
    """
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, role, text))).alias("t"))
    return rows.select(conv, F.transform("t", lambda m: chat.message(m[role], m[text])).alias("messages"))


def _split_by(rows: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def validate_conversations(rows: DataFrame, min_messages: int = 2, allow_system: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with a ``reason``)."""
    return _split_by(rows, chat.validation_reason(F.col("messages"), min_messages, allow_system))


def filter_chat_limits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split_by(rows, chat.chat_limit_reason(F.col("messages")))


def merge_system_message(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    merged = chat.merge_system(F.col("messages"))
    good, bad = _split_by(rows.withColumn("__m", merged), F.when(F.col("__m").isNull(), "system_without_user"))
    return good.withColumn("messages", F.col("__m")).drop("__m"), bad.drop("__m")


def prompt_only(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = chat.without_reply(F.col("messages"))
    good, bad = _split_by(rows.withColumn("__m", cut), F.when(F.col("__m").isNull(), "last_not_assistant"))
    return good.withColumn("messages", F.col("__m")).drop("__m"), bad.drop("__m")


def render_conversations(rows: DataFrame, merges=(), markers: bool = True, max_tokens: int = 2048) -> DataFrame:
    """Adds ``ids`` and ``mask`` (1 = supervised); rows must have passed the two checks above.

    Row by row and without a shuffle, for any vocabulary.
    """
    merges = list(merges)
    staged = rows.withColumn("__segs", chat.segments(F.col("messages")))
    staged = bpe.with_merged(staged, chat.framed_segments(F.col("__segs")), merges)
    out = staged.withColumn("__r", chat.assemble(F.col("__segs"), F.col("__merged"), markers))
    return out.select(
        *rows.columns,
        T.truncate_tokens(T.token_string_ids(F.col("__r.tokens"), T.FIRST_MERGE_ID + len(merges)), max_tokens).alias("ids"),
        T.truncate_tokens(chat.mask_array(F.col("__r.mask")), max_tokens).alias("mask"))


def render_for_completion(rows: DataFrame, merges=(), markers: bool = True, max_tokens: int = 2048) -> DataFrame:
    """Prompt tokens that end with the opening mark of the assistant."""
    prompts, _ = prompt_only(rows)
    merged, _ = merge_system_message(prompts)
    rendered = render_conversations(merged, merges, markers, max_tokens)
    return rendered.withColumn("ids", F.concat("ids", F.array(F.lit(T.ASSISTANT_START_ID)))).drop("mask")


def flatten_games(rows: DataFrame) -> DataFrame:
    """Game dialogues as ``prompt, json``; dialogues that do not end on a reply get null fields
    and ``kind = calculator``, to be filled by a generated expression problem."""
    n = F.size("messages")
    usable = (n >= 2) & (F.get("messages", n - 1)["role"] == "assistant")
    rest = F.array_join(F.transform(F.slice("messages", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda m: m["content"]), "\n")
    return rows.select(
        *[c for c in rows.columns if c != "messages"],
        F.when(usable, "tic-tac-toe").otherwise("calculator").alias("kind"),
        F.when(usable, F.get("messages", 0)["content"]).alias("prompt"),
        F.when(usable, rest).alias("json"))


def messages_text(messages):
    """Messages as one text, for reports and comparison."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
