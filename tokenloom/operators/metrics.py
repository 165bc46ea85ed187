"""Metric logs: steps, smoothing, throughput, budgets and report tables.

A log row is ``run, step, metric, value, ts``; ``step`` is dense from 0 inside a run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import format_metric
from tokenloom.operators.offsets import dense_index, integer_levels, running_value


def number_steps(log: DataFrame, ts: str = "ts", tie: str = "event_id", run: str = "run") -> DataFrame:
    """Adds a dense ``step`` per run in time order."""
    return dense_index(log, [F.col(ts), F.col(tie)], group=[run], out="step")


def ema_debiased(log: DataFrame, beta: float = 0.9, value: str = "value", run: str = "run") -> DataFrame:
    """Adds ``smooth`` and ``debiased``; the exponent is the number of values seen.

    Steps are cut into chunks over which ``beta`` decays by 1e-12.  A chunk is summed in
    closed form on its own, and the three chunks before it carry over; older ones weigh less
    than 1e-36, below what a double can show.  No run is folded in one task.
    """
    chunk = max(1, int(math.log(1e12) / -math.log(beta)))
    b = F.lit(beta)
    rows = log.withColumn("__c", F.floor(F.col("step") / chunk)).withColumn("__i", F.col("step") % chunk)
    x = F.col(value)
    # Value of the chunk's own average at its last step, and its share in the next three chunks.
    ends = rows.groupBy(run, "__c").agg(F.sum((1 - b) * x * F.pow(b, F.lit(chunk - 1) - F.col("__i"))).alias("__e"))
    carried = ends.select(run, "__e", "__c", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("m"))
    carry = carried.groupBy(run, (F.col("__c") + F.col("m")).alias("__c")).agg(
        F.sum(F.col("__e") * F.pow(b, F.lit(chunk) * (F.col("m") - 1))).alias("__carry"))
    w = Window.partitionBy(run, "__c").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__s", (1 - b) * F.pow(b, F.col("__i")) * F.sum(x * F.pow(b, -F.col("__i"))).over(w))
    joined = local.join(carry, [run, "__c"], "left")
    smooth = F.col("__s") + F.coalesce("__carry", F.lit(0.0)) * F.pow(b, F.col("__i") + 1)
    out = joined.withColumn("smooth", smooth)
    return out.withColumn("debiased", F.col("smooth") / (1 - F.pow(b, F.col("step") + 1))).drop("__c", "__i", "__s", "__carry")


def running_best(log: DataFrame, value: str = "value", run: str = "run") -> DataFrame:
    """Adds ``best``, the lowest value up to and including the step."""
    step = F.col("step")
    return running_value(log, F.col(value), [step], integer_levels(step), "min", [run], out="best")


def step_times(log: DataFrame, run: str = "run", ts: str = "ts") -> DataFrame:
    """Adds ``dt_us``, microseconds since the step before; an equi-join on (run, step)."""
    before = log.select(run, (F.col("step") + 1).alias("step"), F.col(ts).alias("__t"))
    joined = log.join(before, [run, "step"], "left")
    return joined.withColumn("dt_us", F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp"))).drop("__t")


def throughput_eta(log: DataFrame, tokens_per_step: int, num_iterations: int, run: str = "run") -> DataFrame:
    """Adds tokens per second, total time without the first two steps, mean step time and time left."""
    timed = step_times(log, run)
    counted = F.when(F.col("step") > 1, F.col("dt_us")).otherwise(0)
    step = F.col("step")
    total = running_value(timed, counted, [step], integer_levels(step), "sum", [run], out="total_us")
    mean = F.when(step > 1, F.col("total_us") / (step - 1) / 1e6)
    return total.select(
        "*", F.floor(F.lit(tokens_per_step) / (F.nullif(F.col("dt_us"), F.lit(0)) / 1e6)).alias("tok_per_sec"),
        mean.alias("mean_step_s"), ((num_iterations - step) * mean).alias("eta_s"))


# ---------------------------------------------------------------- budgets

def corpus_budget(ratios: DataFrame, params: float, chars_per_shard: float, tokens_per_param: float = 20.0) -> DataFrame:
    """Adds ``shards``: files needed to train ``params`` weights; rows carry ``chars, tokens``."""
    per_token = F.col("chars") / F.col("tokens")
    return ratios.withColumn("shards", F.ceil(F.lit(float(params * tokens_per_param)) * per_token / F.lit(float(chars_per_shard))))


def sft_steps(rows: DataFrame, examples_per_step: int, epochs: int) -> DataFrame:
    return rows.agg((F.floor(F.count("*") / examples_per_step) * epochs).alias("num_iterations"))


# ---------------------------------------------------------------- reports

# Stages of a run and the metrics of the chat stages.
STAGES = ["base", "mid", "sft", "rl"]
CHAT_METRICS = ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE"]


def metric_order(metric: Column) -> Column:
    return F.when(metric == "CORE", 0).when(metric == "ChatCORE", 2).otherwise(1)


def report_pivot(log: DataFrame, order: str) -> DataFrame:
    """Metric by stage as text, ``-`` where missing; the entry with the highest ``order`` counts."""
    latest = log.groupBy("metric", "stage").agg(F.max_by("value", order).alias("value"))
    wide = latest.groupBy("metric").pivot("stage", STAGES).agg(F.first("value"))
    return wide.select("metric", metric_order(F.col("metric")).alias("sort_key"),
                       *[F.coalesce(F.col(s).cast("string"), F.lit("-")).alias(s) for s in STAGES])


def wall_clock(sections: DataFrame, run: str = "run") -> DataFrame:
    """Hours and minutes from ``started`` to the time of the last section that is not RL."""
    ends = sections.groupBy(run).agg(F.min("started").alias("s"), F.max_by("ts", F.when(~F.col("is_rl"), F.col("pos"))).alias("e"))
    seconds = F.unix_seconds(F.col("e").cast("timestamp")) - F.unix_seconds(F.col("s").cast("timestamp"))
    return ends.select(run, F.floor(seconds / 3600).alias("hours"), F.floor(seconds % 3600 / 60).alias("minutes"))


def report_lines(pivot: DataFrame) -> DataFrame:
    """``pos, line`` of the summary table in markdown, CORE first and ChatCORE last."""
    cell = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    body = pivot.select(F.concat((F.col("sort_key") + 2).cast("string"), F.col("metric")).alias("pos"),
                        row([cell(F.col("metric"), 15)] + [cell(F.col(s), 8) for s in STAGES]).alias("line"))
    head = pivot.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit("0").alias("pos"), row([cell(F.lit("Metric"), 15)] + [cell(F.lit(s.upper()), 8) for s in STAGES]).alias("line")),
        F.struct(F.lit("1").alias("pos"), F.lit("|" + "|".join(["-" * 17] + ["-" * 10] * 4) + "|").alias("line")))).alias("h")).select("h.*")
    return head.unionByName(body)


def section_text(entries: DataFrame, section: str = "section", ts: str | None = None) -> DataFrame:
    """Markdown of a report section from ``pos, key, value, kind`` rows: ``- key: value`` lines.

    ``ts`` names the time of an entry; the latest one of a section is written below its title, where
    ``report_timestamp`` finds it.  A section lists some dozens of entries."""
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), format_metric(F.col("value"), F.col("kind")))
    latest = F.lit("") if ts is None else F.concat(F.lit("timestamp: "), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    rows = entries.groupBy(section).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"), latest.alias("at"))
    return rows.select(section, F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.col("at"),
                                         F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
