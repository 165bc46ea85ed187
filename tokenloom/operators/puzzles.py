"""Tool-call puzzles as tables: goal checks, call checks, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.functions.fuzzy import partial_ratio


def goal_state_diff(states: DataFrame, fuzzy_at: float | None = None, key: str = "puzzle_id") -> DataFrame:
    """``key, path, verdict`` for every goal file: ``ok``, ``missing`` or ``differs``.

    ``states`` holds the maps ``goal`` and ``actual``; files beyond the goal do not matter.
    With ``fuzzy_at`` a file that differs still passes from that similarity on; only such
    files reach the fuzzy comparison.
    """
    goal = states.select(key, F.explode("goal").alias("path", "expected"))
    actual = states.select(key, F.explode("actual").alias("path", "content"))
    joined = goal.join(actual, [key, "path"], "left")
    same = F.col("content") == F.col("expected")
    verdict = F.when(F.col("content").isNull(), "missing").when(same, "ok")
    if fuzzy_at is not None:
        open_pair = F.col("content").isNotNull() & ~same
        ratio = partial_ratio(F.when(open_pair, F.col("expected")), F.when(open_pair, F.col("content")))
        verdict = verdict.when(ratio >= fuzzy_at, "ok")
    return joined.select(key, "path", verdict.otherwise("differs").alias("verdict"))


def goal_scores(states: DataFrame, fuzzy_at: float | None = None, key: str = "puzzle_id") -> DataFrame:
    """1 per puzzle whose whole goal is met; an empty goal is met."""
    diff = goal_state_diff(states, fuzzy_at, key)
    failed = diff.groupBy(key).agg(F.count_if(F.col("verdict") != "ok").alias("failed"))
    return states.select(key).join(failed, key, "left").select(
        key, (F.coalesce("failed", F.lit(0)) == 0).cast("int").alias("score"))


def check_tool_calls(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``error``: ``missing_type``, ``unknown_tool``, ``missing_argument`` or null.

    ``calls`` carry ``tool`` and the map ``args``; the catalogue has ``name, template``.
    Arguments a template does not mention are allowed.
    """
    known = catalogue.select(F.col("name").alias("tool"), "template")
    joined = calls.join(known, "tool", "left")
    wanted = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))
    lacking = F.size(F.array_except(wanted, F.map_keys("args"))) > 0
    error = (F.when(F.col("tool").isNull(), "missing_type").when(F.col("template").isNull(), "unknown_tool")
             .when(lacking, "missing_argument"))
    return joined.withColumn("error", error).drop("template")


def with_puzzle_id(puzzles: DataFrame, content: str = "content") -> DataFrame:
    return puzzles.withColumn("puzzle_id", text.puzzle_id(F.col(content)))


def parse_solutions(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Model replies as ``calls``, an array of argument maps with canonical keys; null when unusable."""
    salvaged = text.json_array_salvage(F.col(raw))
    calls = F.from_json(salvaged, "array<map<string,string>>")
    return replies.withColumn("calls", F.transform(calls, text.canonical_keys))
