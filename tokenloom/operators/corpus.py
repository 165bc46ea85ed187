"""Cropping, budgets, slices, orders, mixtures and shard cuts over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.draws import digest, draw_unit
from tokenloom.functions import tokens as T
from tokenloom.operators.offsets import dense_index, digest_levels, global_offsets, integer_levels
from tokenloom.session import materialise

STRETCH = 1 << 16   # neighbouring blocks of a shard cut that one task walks


# ---------------------------------------------------------------- crops, budgets, slices

def crop_documents(docs: DataFrame, cap: int = 10_000, text: str = "text") -> DataFrame:
    """First ``cap`` code points of every document."""
    return docs.withColumn(text, F.substring(text, 1, cap))


def char_budget(docs: DataFrame, max_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in key order until the total exceeds ``max_chars``; the crossing document stays.

    The cut-off key comes from the lengths alone; the text is filtered by it where it is read, never shuffled.
    Null keys come first, and documents that share the cut-off key all stay.
    """
    sized = docs.select(key, F.length(text).alias("n"))
    kept = global_offsets(sized, F.coalesce("n", F.lit(0)), [F.col(key)], integer_levels(F.col(key))).where(F.col("start") <= max_chars)
    last = kept.agg(F.max(key)).first()[0]
    return docs.where(F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last)))


def slice_task(task: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows ``start, start + step, ...`` below ``stop``, numbered anew."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("need start >= 0, step >= 1, stop >= start")
    keep = (F.col("idx") >= start) & (F.pmod(F.col("idx") - start, F.lit(step)) == 0)
    if stop is not None:
        keep &= F.col("idx") < stop
    return task.where(keep).withColumn("idx", F.floor((F.col("idx") - start) / step).cast("bigint"))


def cap_per_task(items: DataFrame, n: int, seed: int = 1337, task: str = "task", item: str = "idx") -> DataFrame:
    """The first ``n`` items of every task in a seeded order; ``n <= 0`` keeps all.

    The rank limit is applied before the shuffle as well, so a hot task sends few rows.
    """
    if n <= 0:
        return items
    order = Window.partitionBy(task).orderBy(digest(seed, F.col(task), F.col(item)))
    return items.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def limit_problems(task: DataFrame, n: int | None) -> DataFrame:
    return task if n is None else task.where(F.col("idx") < n)


def rank_stride(rows: DataFrame, rank: int, world: int, idx: str = "idx") -> DataFrame:
    return rows.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def drop_unparsed(rows: DataFrame, prompt: str = "prompt", expected: str = "expected") -> DataFrame:
    return rows.dropna(subset=[prompt, expected])


def valid_problems(rows: DataFrame, answer: str = "answer") -> DataFrame:
    a = F.col(answer)
    return rows.where(a.isNotNull() & ~F.isnan(a) & (F.abs(a) < 1e100))


def split_decoded_stream(rows: DataFrame, text: str = "text", out: str = "problem") -> DataFrame:
    """Fragments between begin-of-sequence marks; the first and last are cut off and left out."""
    parts = F.split(text, r"<\|bos\|>")
    inner = T.let(parts, lambda p: F.when(
        F.size(p) > 2, F.slice(p, F.lit(2), F.size(p) - 2)).otherwise(F.array().cast("array<string>")))
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(inner).alias("pos", out))


def problem_text(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, response)


def problem_tokens(rows: DataFrame, merges=(), markers: bool = True, out: str = "ids") -> DataFrame:
    """Training order of a problem: begin mark, prompt, response, each part encoded by itself."""
    from tokenloom.operators.bpe import encode_corpus

    coded = encode_corpus(rows, merges, markers, "prompt", "__p", prepend=T.BOS_ID)
    coded = encode_corpus(coded, merges, markers, "json", "__r")
    return coded.withColumn(out, F.concat("__p", "__r")).drop("__p", "__r")


# ---------------------------------------------------------------- orders

def seeded_shuffle(rows: DataFrame, seed: int, *ids: str) -> DataFrame:
    """A global order that depends on the seed and the ids only."""
    return rows.withColumn("shuffle_key", digest(seed, *[F.col(i) for i in ids])).orderBy("shuffle_key", *ids)


def shuffle_index(rows: DataFrame, seed: int, *ids: Column, group: Sequence[str] = ()) -> DataFrame:
    """Dense position ``idx`` in the seeded order, without sorting the whole table in one place."""
    keyed = rows.withColumn("shuffle_key", digest(seed, *ids))
    key = F.col("shuffle_key")
    return dense_index(keyed, [key, *ids], digest_levels(key), group).drop("shuffle_key")


def multi_epoch(rows: DataFrame, epochs: int, seed: int, id_col: str) -> DataFrame:
    """Every row once per epoch, each epoch in its own order; the very last row is flagged."""
    repeated = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = digest(seed, F.col("epoch"), F.col(id_col))
    keyed = repeated.withColumn("__k", key)
    local = dense_index(keyed, [F.col("__k"), F.col(id_col)], digest_levels(F.col("__k")), ["epoch"], out="pos")
    n = rows.count()   # the same in each epoch, so no join on the epoch
    return (local.withColumn("step", (F.col("epoch") * F.lit(n).cast("bigint") + F.col("pos")))
            .withColumn("is_last", (F.col("epoch") == epochs - 1) & (F.col("pos") == n - 1))
            .drop("__k"))


# ---------------------------------------------------------------- unions

def _tagged(tasks: Sequence[DataFrame]) -> DataFrame:
    tagged = [t.withColumnRenamed("idx", "local_idx").withColumn("task_idx", F.lit(i)) for i, t in enumerate(tasks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def mixture(tasks: Sequence[DataFrame], seed: int = 42) -> DataFrame:
    """Bag union of tasks in one seeded order; list a task twice to oversample it."""
    return shuffle_index(_tagged(tasks), seed, F.col("task_idx"), F.col("local_idx"))


def task_sequence(tasks: Sequence[DataFrame]) -> DataFrame:
    """Tasks one after the other; each must have a dense ``idx``."""
    rows = _tagged(tasks)
    # One number per listed task, as small as the call: rows are not shuffled on the task.
    sizes = {r["task_idx"]: r["n"] for r in rows.groupBy("task_idx").agg(F.count("*").alias("n")).collect()}
    starts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(tasks))]
    start = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("task_idx"))
    return rows.withColumn("idx", start + F.col("local_idx"))


def weighted_source(weights: dict[str, float], *ids: Column, seed: int = 0) -> Column:
    """A source name drawn with probability weight / total; weight 0 is never drawn."""
    live = [(n, float(w)) for n, w in weights.items() if w > 0]
    if not live:
        raise ValueError("at least one weight must be above 0")
    total, acc, pick = sum(w for _, w in live), 0.0, None
    u = draw_unit(seed, *ids)
    for name, w in live:
        acc += w
        hit = u < acc / total
        pick = F.when(hit, F.lit(name)) if pick is None else pick.when(hit, F.lit(name))
    return pick.otherwise(F.lit(live[-1][0]))


def mixture_composition(rows: DataFrame, task: str = "task") -> DataFrame:
    """Rows and share per source task."""
    counts = rows.groupBy(task).agg(F.count("*").alias("n_rows"))
    # One row per task; the window sees as many rows as there are tasks.
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))


# ---------------------------------------------------------------- greedy shard cut

def _next_starts(spans: DataFrame, limit: int, n_blocks: int, total: int, group_rows: int) -> DataFrame:
    """For each block, the block at which the next shard starts if a shard starts here.

    A shard from block i ends at the block whose character span contains
    ``start(i) + limit``.  Blocks and targets meet in buckets of the character line about
    one block wide; inside a bucket one ordered window finds the block, so no pair is formed.
    """
    width = max(1, total // max(1, n_blocks))
    spans = spans.where("chars > 0")
    ends = spans.select("full", F.col("end").alias("pos"), F.floor(F.col("end") / width).alias("bucket"),
                        F.col("block").alias("hit"))
    # The block that reaches past a bucket answers the targets behind the bucket's last block.
    crossing = spans.select("full", "block", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bucket"), "end")
    crossing = crossing.where(F.floor(F.col("end") / width) > F.col("bucket")).select(
        "full", ((F.col("bucket") + 1) * width).alias("pos"), "bucket", F.col("block").alias("hit"))
    hits = ends.unionByName(crossing).select("pos", "bucket", "hit", F.lit(1).alias("kind"),
                                             F.lit(None).cast("bigint").alias("from"))
    probes = spans.select((F.col("start") + limit).alias("pos"), F.floor((F.col("start") + limit) / width).alias("bucket"),
                          F.lit(None).cast("bigint").alias("hit"), F.lit(0).alias("kind"), F.col("block").alias("from"))
    # Read backwards, the last block seen is the first one at or behind the target.
    ahead = Window.partitionBy("bucket").orderBy(F.desc("pos"), F.desc("kind"), F.desc("hit")).rowsBetween(
        Window.unboundedPreceding, 0)
    found = hits.unionByName(probes).withColumn("close", F.last("hit", ignorenulls=True).over(ahead))
    return found.where("kind = 0").select(F.col("from").alias("block"), (F.col("close") + 1).alias("next"))


def _walk(start: int, jump: dict[int, int]) -> list[int]:
    """Blocks that a walk from ``start`` comes to, as long as they have a jump here."""
    seen = []
    while start in jump:
        start = jump[start]
        seen.append(start)
    return seen


def _leaving(group: pa.Table) -> pa.Table:
    """Where a walk from each block of a stretch first comes to a block without a jump in it."""
    jump = dict(zip(group.column("block").to_pylist(), group.column("next").to_pylist()))
    last: dict[int, int] = {}
    for block in sorted(jump, reverse=True):   # jumps go forward, so the later blocks are known
        last[block] = last.get(jump[block], jump[block])
    return pa.table({"block": pa.array(list(last), pa.int64()), "next": pa.array(list(last.values()), pa.int64())})


def _within(group: pa.Table) -> pa.Table:
    """All blocks of a stretch that walks come to from the ones it is entered at."""
    jump, entered = {}, []
    for block, following in zip(group.column("block").to_pylist(), group.column("next").to_pylist()):
        if following is None:
            entered.append(block)
        else:
            jump[block] = following
    return pa.table({"start": pa.array([x for e in entered for x in _walk(e, jump)], pa.int64())})


def _reached(jump: DataFrame) -> DataFrame:
    """``start``: the blocks that jumps ``block, next`` come to from block 0, and 0.

    A stretch of ``STRETCH`` blocks is walked in one task.  From stretch to stretch the walk is found by doubling the
    jumps out of them, so it takes log2(stretches) joins, none if there is one.
    """
    stretch = F.expr(f"block div {STRETCH}")
    schema = "block long, next long"
    out = jump.withColumn("stretch", stretch).groupBy("stretch").applyInArrow(_leaving, schema)
    # A jump that stays within its stretch ends the walk.
    out = materialise(out.where(F.expr(f"block div {STRETCH} <> next div {STRETCH}")), "jump")
    entered = jump.sparkSession.range(1).select(F.col("id").alias("start"))
    while not out.isEmpty():
        step = entered.join(out.withColumnRenamed("block", "start"), "start").select(F.col("next").alias("start"))
        entered = entered.unionByName(step).distinct()
        out = materialise(out.select("block", F.col("next").alias("mid")).join(
            out.select(F.col("block").alias("mid"), "next"), "mid").select("block", "next"), "jump")
    entered = materialise(entered, "entered")
    marks = entered.select(F.col("start").alias("block"), F.lit(None).cast("bigint").alias("next"))
    inner = jump.select("block", "next").unionByName(marks).withColumn("stretch", stretch).groupBy("stretch").applyInArrow(_within, "start long")
    return entered.unionByName(inner).distinct()


def greedy_shards(blocks: DataFrame, limit: int, group_rows: int) -> DataFrame:
    """``block, shard, closed`` for a block table (``block`` dense from 0, ``chars``, ``docs``).

    A shard closes at the first block end with at least ``limit`` characters since its start.
    The cut is a chain of jumps ``start -> next start``, walked by stretches (see ``_reached``).
    """
    spans = materialise(global_offsets(blocks, F.col("chars"), [F.col("block")], integer_levels(F.col("block")))
                        .withColumn("full", F.col("docs") == group_rows), "spans")
    facts = spans.agg(F.count("*").alias("n"), F.max("end").alias("total"),
                      F.max(F.when(F.col("full"), F.col("block"))).alias("last_full")).first()
    if not facts.n:
        return blocks.select("block", F.lit(0).cast("bigint").alias("shard"), F.lit(False).alias("closed"))
    last_full = -1 if facts.last_full is None else facts.last_full
    jump = _next_starts(spans, limit, facts.n, facts.total, group_rows)
    # Blocks without characters start a shard that behaves like the next block with some.
    firsts = spans.groupBy("start").agg(F.max(F.when(F.col("chars") > 0, F.col("block"))).alias("carrier"))
    alias_of = spans.where("chars = 0").join(firsts, "start").where("carrier is not null").select("block", "carrier")
    jump = jump.unionByName(alias_of.join(jump.withColumnRenamed("block", "carrier"), "carrier").select("block", "next"))
    # A partial block cannot close a shard, so only jumps over full blocks count.
    jump = materialise(jump.where(F.col("next").isNotNull() & (F.col("next") - 1 <= last_full)), "jump")
    reached = _reached(jump)
    grown = materialise(reached, "starts")
    starts = grown.where(F.col("start") < facts.n)
    numbered = dense_index(starts, [F.col("start")], integer_levels(F.col("start")), out="shard")
    following = numbered.select((F.col("shard") - 1).alias("shard"), F.col("start").alias("stop"))
    ranges = numbered.join(following, "shard", "left")
    closed_at_end = grown.agg(F.max("start").alias("m")).first().m == facts.n
    return ranges.select(
        F.explode(F.sequence("start", F.coalesce(F.col("stop"), F.lit(facts.n)) - 1)).alias("block"), "shard",
        (F.col("stop").isNotNull() | F.lit(closed_at_end)).alias("closed"))
