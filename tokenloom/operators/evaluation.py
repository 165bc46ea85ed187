"""Evaluation: few-shot requests, spans, and everything that turns scores into metrics.

A score table has one row per scored token: ``example_id, option_idx, pos, token, nll,
argmax``.  Model runs stay outside; their output comes in as such a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import tokens as T
from tokenloom.functions.draws import draw_index
from tokenloom.operators import bpe


# Chat tasks and the accuracy of guessing.
CHAT_BASELINES = {"ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0, "SpellingBee": 0.0}


# ---------------------------------------------------------------- requests

def few_shot_indices(idx: Column, n: Column, k: int, seed: int = 1234) -> Column:
    """``k`` positions other than ``idx`` among ``n``, drawn without replacement.

    Floyd's sampling over the n - 1 other positions: k draws, no retries, no pairing of
    items.  Tasks with fewer than k other items give all of them.
    """
    others = (n - 1).cast("bigint")
    take = F.least(F.lit(k).cast("bigint"), others)

    def step(drawn, j):
        t = draw_index(j + 1, F.lit(seed) + idx, j)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, t), j).otherwise(t)))

    empty = F.array().cast("array<bigint>")
    steps = F.when(take > 0, F.sequence(others - take, others - 1)).otherwise(empty)
    drawn = F.aggregate(steps, empty, step)
    return F.transform(drawn, lambda p: F.when(p >= idx, p + 1).otherwise(p))


def _few(sizes: DataFrame, rows: int = 10_000) -> DataFrame:
    """Broadcast if a count shows a row per task to be few; otherwise joined by shuffle."""
    return F.broadcast(sizes) if sizes.count() <= rows else sizes


def few_shot_examples(items: DataFrame, k: int, seed: int = 1234, fields: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``shots``, an array of ``fields`` of k other items of the same task.

    Items carry a dense ``idx`` per ``task``.  Drawn positions meet their items in an
    equi-join on (task, idx); each item gathers k rows.
    """
    sizes = items.groupBy("task").agg(F.count("*").alias("__n"))
    drawn = items.join(_few(sizes), "task").select(
        "task", "idx", F.posexplode(few_shot_indices(F.col("idx"), F.col("__n"), k, seed)).alias("at", "pick"))
    source = items.select("task", F.col("idx").alias("pick"), F.struct(*fields).alias("shot"))
    shots = (drawn.join(source, ["task", "pick"]).groupBy("task", "idx")
             .agg(F.array_sort(F.collect_list(F.struct("at", "shot"))).alias("s"))
             .select("task", "idx", F.transform("s", lambda x: x["shot"]).alias("shots")))
    joined = items.join(shots, ["task", "idx"], "left")
    none = F.array().cast(shots.schema["shots"].dataType)
    return joined.withColumn("shots", F.coalesce("shots", none))


def common_length(seqs: DataFrame, key: str = "example_id", ids: str = "ids", suffix: bool = False, out: str = "common") -> DataFrame:
    """Length of the longest common prefix (or suffix) of all arrays with one key.

    It is that of the least and the greatest array, which are partial aggregates: no token is exploded.
    """
    order = F.reverse(ids) if suffix else F.col(ids)
    ends = seqs.groupBy(key).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    return ends.select(key, common_length_of(F.array("__lo", "__hi")).alias(out))


def common_length_of(arrays: Column, suffix: bool = False) -> Column:
    """The same for the options of one item held in one array."""
    seqs = F.transform(arrays, lambda a: F.reverse(a)) if suffix else arrays

    def measure(ss):
        shortest, first = F.array_min(F.transform(ss, lambda s: F.size(s))), F.get(ss, 0)
        others = F.slice(ss, F.lit(2), F.greatest(F.size(ss) - 1, F.lit(0)))
        # Length of agreement with the first array, the smallest over all arrays.
        return T.let(shortest, lambda n: F.coalesce(F.array_min(F.transform(others, lambda s: _agreement(first, s, n))), n))

    return T.let(seqs, measure).cast("int")


CHUNK = 64   # tokens that are compared at once


def _agreement(a: Column, b: Column, upto: Column) -> Column:
    """Number of tokens before the first difference, at most ``upto``; tokens are looked at singly in unequal chunks only."""
    def difference(k):
        x, y = (F.slice(s, k * CHUNK + 1, F.least(F.lit(CHUNK), upto - k * CHUNK)) for s in (a, b))
        place = F.nullif(F.array_position(F.zip_with(x, y, lambda t, u: t != u), F.lit(True)), F.lit(0))
        return F.when(x != y, (place + k * CHUNK - 1).cast("int"))

    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(upto / CHUNK).cast("int") - 1, F.lit(0)))
    found = F.aggregate(chunks, F.lit(None).cast("int"), lambda at, k: F.coalesce(at, difference(k)))
    return F.coalesce(found, upto)


def continuation_spans(items: DataFrame, kind: Column, prompts: str = "prompt_ids") -> DataFrame:
    """One row per option with ``ids, span_start, span_end``; items that break the rules get a ``reason``.

    Choices share a prefix, schema contexts share a suffix, and for plain continuation the
    first prompt must be a strict prefix of the second, which alone is scored.
    """
    p = F.col(prompts)
    without, full = F.get(p, 0), F.get(p, 1)
    is_lm, is_schema = kind == "language_modeling", kind == "schema"
    strict = (F.size(without) < F.size(full)) & (F.slice(full, F.lit(1), F.size(without)) == without)
    shared = F.when(is_lm, F.size(without)).when(is_schema, common_length_of(p, suffix=True)).otherwise(common_length_of(p))
    judged = items.withColumn("reason", F.when(is_lm & ~strict, "not_a_prefix"))
    keep = [c for c in judged.columns if c != prompts]
    judged = judged.select(*keep, shared.alias("__n"), is_schema.alias("__schema"), F.when(is_lm, F.array(full)).otherwise(p).alias("__o"))
    # Outer, because the filter that Spark infers for an inner one makes the options several times.
    options = judged.select(*keep, "__n", "__schema", F.posexplode_outer("__o").alias("option_idx", "ids")).where("option_idx IS NOT NULL")
    start = F.when(F.col("__schema"), F.size("ids") - F.col("__n")).otherwise(F.col("__n"))
    return options.select(*keep, "option_idx", "ids", start.alias("span_start"), F.size("ids").alias("span_end"))


def span_crop(rows: DataFrame, max_len: int) -> DataFrame:
    """The last ``max_len`` tokens, spans shifted along; a span that would start before 0 gets a ``reason``."""
    cut = F.greatest(F.size("ids") - max_len, F.lit(0))
    out = rows.withColumn("__cut", cut).withColumn("ids", F.slice("ids", F.col("__cut") + 1, F.lit(max_len)))
    out = out.withColumn("span_start", F.col("span_start") - F.col("__cut")).withColumn("span_end", F.col("span_end") - F.col("__cut"))
    lost = F.when(F.col("span_start") < 0, "span_cut_off")
    reason = F.coalesce(F.col("reason"), lost) if "reason" in rows.columns else lost
    return out.withColumn("reason", reason).drop("__cut")


# ---------------------------------------------------------------- scores to metrics

def attach_token_bytes(scores: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``n_bytes``; ignored targets and unknown ids count 0."""
    lengths = vocab.select(F.col("id").alias("token"), "n_bytes")
    return scores.join(lengths, "token", "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))


def bits_per_byte(scores: DataFrame, vocab: DataFrame, *group: str) -> DataFrame:
    """Nats of counted targets over ln 2 times their bytes; no bytes gives infinity."""
    counted = attach_token_bytes(scores, vocab)
    sums = counted.groupBy(*group).agg(
        F.sum(F.when(F.col("n_bytes") > 0, F.col("nll")).otherwise(0.0)).alias("total_nats"),
        F.sum("n_bytes").cast("bigint").alias("total_bytes"))
    bpb = F.when(F.col("total_bytes") == 0, F.lit(float("inf"))).otherwise(F.col("total_nats") / (F.log(F.lit(2.0)) * F.col("total_bytes")))
    return sums.withColumn("bpb", bpb)


def choose_option(scores: DataFrame, key: str = "example_id") -> DataFrame:
    """``pred``: option with the lowest mean nll; ties go to the lowest index."""
    means = scores.groupBy(key, "option_idx").agg(F.avg("nll").alias("mean_nll"))
    return means.groupBy(key).agg(F.min_by("option_idx", F.struct("mean_nll", "option_idx")).alias("pred"),
                                  F.min("mean_nll").alias("mean_nll"))


def exact_continuation(scores: DataFrame, key: str = "example_id") -> DataFrame:
    """``correct``: every predicted token equals the actual one."""
    return scores.groupBy(key).agg(F.bool_and(F.col("argmax") == F.col("token")).cast("int").alias("correct"))


def restrict_to_options(scores: DataFrame, items: DataFrame, key: str = "example_id") -> DataFrame:
    """Best letter among those the item offers; ``scores`` has ``key, letter, score``."""
    offered = items.select(key, F.explode("letters").alias("letter"))
    order = items.select(key, "letters")
    live = scores.join(offered, [key, "letter"], "left_semi").join(order, key)
    place = F.array_position("letters", F.col("letter"))
    return live.groupBy(key).agg(F.max_by("letter", F.struct(F.col("score"), -place)).alias("pred"))


def letter_token_ids(letters: DataFrame, merges=(), letter: str = "letter") -> DataFrame:
    """First id of every distinct letter's encoding that is not a marker."""
    coded = bpe.encode_words(letters.select(F.col(letter).alias("word")).distinct(), list(merges))
    return coded.select(F.col("word").alias(letter), F.get("ids", 0).alias("token"))


def score_completions(completions: DataFrame, gold: DataFrame, extract, key: str = "example_id") -> DataFrame:
    """``is_correct`` per completion; two unreadable answers count as equal."""
    wanted = gold.select(key, extract(F.col("reference")).alias("expected"))
    got = completions.withColumn("answer", extract(F.col("completion")))
    joined = got.join(wanted, key)
    return joined.withColumn("is_correct", F.col("answer").eqNullSafe(F.col("expected")).cast("int"))


def task_accuracy(correct: DataFrame, *group: str, value: str = "correct") -> DataFrame:
    return correct.groupBy(*(group or ("task",))).agg(F.avg(value).alias("accuracy"), F.count("*").alias("n"))


def accuracy_by_subject(correct: DataFrame, value: str = "correct") -> DataFrame:
    """Per task and subject, with task totals and a grand total (null keys)."""
    return correct.rollup("task", "subject").agg(F.avg(value).alias("accuracy"), F.count("*").alias("n"))


def centered_accuracy(accuracy: DataFrame, baselines: DataFrame) -> DataFrame:
    """Accuracy on a scale where guessing is 0; baselines are percentages."""
    base = F.lit(0.01) * F.col("baseline_pct")
    return accuracy.join(baselines, "task").withColumn("centered", (F.col("accuracy") - base) / (F.lit(1.0) - base))


def core_metric(centered: DataFrame) -> DataFrame:
    return centered.agg(F.avg("centered").alias("core_metric"))


def chatcore(accuracy: DataFrame) -> DataFrame:
    """Mean centred accuracy over all six chat tasks; no row unless every task is there."""
    base = F.lit(0.0)
    for task, b in CHAT_BASELINES.items():
        base = F.when(F.col("task") == task, b).otherwise(base)
    centered = (F.col("accuracy") - base) / (F.lit(1.0) - base)
    known = F.countDistinct(F.when(F.col("task").isin(*CHAT_BASELINES), F.col("task")))
    out = accuracy.agg(F.avg(centered).alias("chatcore"), known.alias("__k"))
    return out.where(F.col("__k") == len(CHAT_BASELINES)).drop("__k")


def any_pass(outcomes: DataFrame, idx: str = "idx") -> DataFrame:
    return outcomes.groupBy(idx).agg(F.max("is_correct").alias("passed"))


def pass_at_k(outcomes: DataFrame, k_max: int, idx: str = "idx") -> DataFrame:
    """Share of problems solved within the first k samples, for k = 1..k_max.

    Problems are first reduced to a histogram of the first success, which has at most
    one row per sample position.
    """
    first = outcomes.groupBy(idx).agg(F.min(F.when(F.col("is_correct") == 1, F.col("sample_idx"))).alias("first"))
    histogram = first.groupBy("first").agg(F.count("*").alias("n"))
    ks = histogram.select("first", "n", F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
    solved = F.sum(F.when(F.col("first") < F.col("k"), F.col("n")).otherwise(0))
    return ks.groupBy("k").agg((solved / F.sum("n")).alias("pass_at_k"))


def advantages(rewards: DataFrame, example: str = "example_id", reward: str = "reward") -> DataFrame:
    """Reward minus the mean reward of the example."""
    means = rewards.groupBy(example).agg(F.avg(reward).alias("__mu"))
    return rewards.join(means, example).withColumn("advantage", F.col(reward) - F.col("__mu")).drop("__mu")


def rollout_summary(rollouts: DataFrame, example: str = "example_id") -> DataFrame:
    """Mean over examples of the mean reward; mean sequence length over all samples."""
    per = rollouts.groupBy(example).agg(F.avg("reward").alias("r"), F.sum("length").alias("l"), F.count("*").alias("n"))
    return per.agg(F.avg("r").alias("mean_reward"), (F.sum("l") / F.sum("n")).alias("mean_sequence_length"))


def tool_metrics(scored: DataFrame) -> DataFrame:
    n = F.count("*") + F.lit(1e-6)
    return scored.agg((F.sum("corr") / n).alias("tool_correctness"), (F.sum("score") / n).alias("tool_score"))


def rank_predictions(scored: DataFrame, *tie: str) -> DataFrame:
    """Correct ones first, then by score."""
    return scored.orderBy(F.desc("corr"), F.desc("score"), *tie)


def validation_loss(losses: DataFrame) -> DataFrame:
    """Mean of the batch means of each rank, then over ranks; rows are ``rank, batch, loss``."""
    batches = losses.groupBy("rank", "batch").agg(F.avg("loss").alias("loss"))
    ranks = batches.groupBy("rank").agg(F.avg("loss").alias("loss"))
    return ranks.agg(F.avg("loss").alias("val_loss"))
