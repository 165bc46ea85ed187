"""Readers for conversations, tasks, word lists and evaluation bundles; writers for results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import chat, text
from tokenloom.operators.conversations import validate_conversations


def read_conversations_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON array of messages per line; (valid, rejects with ``reason`` and the raw line)."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    # Content must be a JSON string; numbers and objects are told apart by their raw text.
    raw = F.from_json("line", "array<struct<role:string,content:variant>>")
    typed = F.transform(raw, lambda m: chat.message(
        m["role"], F.when(F.schema_of_variant(m["content"]) == "STRING", F.try_variant_get(m["content"], "$", "string"))))
    rows = lines.select("line", typed.alias("messages"))
    valid, rejects = validate_conversations(rows, allow_system=False)
    return valid.select("messages"), rejects.select("line", F.when(
        F.col("messages").isNull(), "not_an_array").otherwise(F.col("reason")).alias("reason"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word"))


# Fixed value: letters of four-way questions.
FOUR_LETTERS = ["A", "B", "C", "D"]


def load_multiple_choice(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Normalise to ``question, letters, choices, answer, subject``; (valid, rejects with ``reason``).

    ``indexed``: four choices, the answer is an index, rows may sit inside a ``train`` struct.
    ``labelled``: letters come with the choices, the answer must be one of them.
    """
    if kind == "indexed":
        if "train" in rows.columns:
            rows = rows.select("train.*")
        letters = F.array(*[F.lit(x) for x in FOUR_LETTERS])
        answer = F.get(letters, F.col("answer"))
        reason = F.when(F.size("choices") != 4, "not_four_choices").when(answer.isNull(), "answer_out_of_range")
        out = rows.select("question", letters.alias("letters"), "choices", answer.alias("answer"), "subject", reason.alias("reason"))
    elif kind == "labelled":
        letters = F.col("choices.label")
        reason = F.when(~F.coalesce(F.array_contains(letters, F.col("answerKey")), F.lit(False)), "answer_not_a_letter")
        out = rows.select("question", letters.alias("letters"), F.col("choices.text").alias("choices"),
                          F.col("answerKey").alias("answer"), F.lit(None).cast("string").alias("subject"), reason.alias("reason"))
    else:
        raise ValueError("kind must be indexed or labelled")
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


# The splits each question set offers.
SPLITS = {
    "word_problems": {"subset": ["main", "socratic"], "split": ["train", "test"]},
    "chat": {"split": ["train", "test"]},
    "code": {"split": ["test"]},
}


def load_question_answer(rows: DataFrame, kind: str, split: str = "test", subset: str = "main") -> DataFrame:
    """Word problems (``question, answer``), code tasks (``prompt, canonical_solution, entry_point, test``)
    or chats (``messages``, those that keep the rules of a chat set) as conversations."""
    allowed = SPLITS.get(kind)
    if allowed is None:
        raise ValueError(f"kind must be one of {sorted(SPLITS)}")
    if split not in allowed["split"] or subset not in allowed.get("subset", [subset]):
        raise ValueError(f"{kind} offers {allowed}")
    if kind == "chat":
        return rows.where(chat.validation_reason(F.col("messages")).isNull())
    if kind == "word_problems":
        messages = F.array(chat.message("user", F.col("question")), chat.message("assistant", parts=text.tool_parts(F.col("answer"))))
        return rows.withColumn("messages", messages)
    solution = F.concat("prompt", F.lit("\n"), "canonical_solution")
    messages = F.array(chat.message("user", F.col("prompt")), chat.message("assistant", solution))
    keep = [c for c in rows.columns if c not in ("prompt", "canonical_solution")]
    return rows.select(*keep, messages.alias("messages"))


ITEM_SCHEMA = ("query string, choices array<string>, gold int, context_options array<string>, continuation string, "
               "context string")


def read_eval_bundle(spark: SparkSession, tasks: list[dict], data_dir: str, baselines_csv: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(task metadata, items of all tasks, random baselines).

    ``tasks`` is the short task list of a bundle: label, icl_task_type, dataset_uri, num_fewshot
    and an optional continuation_delimiter.
    """
    meta_rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]),
                  t.get("continuation_delimiter", " ")) for t in tasks]
    meta = spark.createDataFrame(meta_rows, "task string, task_type string, dataset_uri string, num_fewshot int, delimiter string")
    items = [spark.read.schema(ITEM_SCHEMA).json(f"{data_dir}/{uri}").select(
        F.lit(label).alias("task"), F.lit(kind).alias("task_type"), "*") for label, kind, uri, *_ in meta_rows]
    baselines = spark.read.option("header", True).csv(baselines_csv).select(
        F.trim("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline_pct"))
    return meta, reduce(DataFrame.unionByName, items), baselines


def eval_csv_lines(results: DataFrame) -> DataFrame:
    """One padded line per task (``task, accuracy, centered``) and a last CORE line."""
    pad = lambda c, n: F.rpad(c, n, " ")
    num = lambda c: pad(text.fixed(c, 6), 10)
    line = lambda a, b, c: F.concat(a, F.lit(", "), b, F.lit(", "), c)
    wide = lambda c: F.when(F.length(c) < 35, pad(c, 35)).otherwise(c)
    body = results.select(F.lit(1).alias("part"), F.col("task").alias("k"), line(wide(F.col("task")), num(F.col("accuracy")), num(F.col("centered"))).alias("line"))
    core = results.agg(F.avg("centered").alias("c")).select(
        F.lit(2).alias("part"), F.lit("").alias("k"), line(wide(F.lit("CORE")), pad(F.lit(""), 10), num(F.col("c"))).alias("line"))
    head = results.sparkSession.range(1).select(
        F.lit(0).alias("part"), F.lit("").alias("k"),
        line(wide(F.lit("Task")), pad(F.lit("Accuracy"), 10), pad(F.lit("Centered"), 10)).alias("line"))
    return head.unionByName(body).unionByName(core)


def write_eval_csv(results: DataFrame, path: str) -> None:
    """A handful of lines, one per task."""
    eval_csv_lines(results).coalesce(1).sortWithinPartitions("part", "k").select("line").write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """``pos, line`` of a report as text; a report is a few hundred lines."""
    lines.coalesce(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)


def write_verified_puzzles(puzzles: DataFrame, path: str) -> None:
    """``puzzle_id, puzzle, solution``; puzzles that are equal in all their content collapse to one; the id is a label. 256 folders."""
    unique = puzzles.dropDuplicates(["puzzle", "solution"]).withColumn("prefix", F.substring("puzzle_id", 1, 2))
    unique.write.mode("overwrite").partitionBy("prefix").json(path)
