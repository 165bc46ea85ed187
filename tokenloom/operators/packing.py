"""Token rows for trainers: packing, shifted targets, padding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tokens import IGNORED_TARGET, token_string_ids
from tokenloom.operators.offsets import Ranges, floor_div, global_offsets
from tokenloom.session import materialise

OUT = 4 << 20   # tokens of rows after which an Arrow batch is passed on


def _cut(width: int):
    """Rows of ``width`` tokens as far as a run of neighbouring documents holds them, and the fragments at its ends."""
    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        row, at, part = zip(*out) if out else ((), (), ())
        return pa.record_batch({"row_id": pa.array(row, pa.int64()), "at": pa.array(at, pa.int32()), "part": pa.array(part, pa.string()),
                                "whole": pa.array([len(p) == width for p in part], pa.bool_())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, end, out = [], 0, None, []   # parts of the open row, the stream's number of its first token, and of the next
        for batch in batches:
            for start, tokens in zip(batch.column("start").to_numpy(), batch.column("tokens")):
                start, text = int(start), tokens.as_py()
                if start != end:
                    if held:
                        out.append((begin // width, begin % width, "".join(held)))
                    held, begin, end = [], start, start
                i, room = 0, width - end % width
                while len(text) - i >= room:
                    held.append(text[i:i + room])
                    out.append((begin // width, begin % width, "".join(held)))
                    i, end = i + room, end + room
                    held, begin, room = [], end, width
                if i < len(text):
                    held.append(text[i:])
                    end += len(text) - i
                if len(out) * width >= OUT:
                    yield batch_of(out)
                    out = []
        if held:
            out.append((begin // width, begin % width, "".join(held)))
        yield batch_of(out)
    return task


def cut_stream(docs: DataFrame, width: int, key: str = "doc_id", tokens: str = "tokens",
               order: Sequence[Column] | None = None, levels: Ranges | None = None,
               size: str | None = None) -> DataFrame:
    """Concatenate documents in key order and cut every ``width`` tokens: ``row_id, tokens``.

    Documents are token strings.  They are stored in order with the place of each in the stream; a task that reads
    neighbouring documents cuts the rows that lie within them, and only the fragments at its two ends are exchanged.
    The incomplete tail is held back.  Null texts have no tokens.  Encoded documents should be stored
    before packing, as the ranges are found from a sample; a stored length column is ``size``.
    """
    order = order or [F.col(key)]
    n = F.col(size) if size else F.length(tokens)
    kept = docs.where(n > 0)
    placed = global_offsets(kept, n, order, levels).select("start", F.col(tokens).alias("tokens"))
    pieces = materialise(placed.mapInArrow(_cut(width), "row_id long, at int, part string, whole boolean"), "pieces")
    edges = pieces.where("not whole").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    ends = edges.select("row_id", joined.alias("tokens")).where(F.length("tokens") == width)
    return pieces.where("whole").select("row_id", F.col("part").alias("tokens")).union(ends)


def cut_arrays(docs: DataFrame, width: int, key: str = "doc_id", ids: str = "ids",
               order: Sequence[Column] | None = None, levels: Ranges | None = None) -> DataFrame:
    """The same for tokens that come as arrays: ``row_id, ids``."""
    order = order or [F.col(key)]
    placed = global_offsets(docs, F.size(ids), order, levels).where(F.col("end") > F.col("start"))
    w = F.lit(width).cast("bigint")

    def piece(row):
        lo = F.greatest(row * w, F.col("start"))
        hi = F.least((row + 1) * w, F.col("end"))
        return F.struct(row.alias("row_id"), lo.alias("at"),
                        F.slice(ids, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    overlapped = F.sequence(floor_div(F.col("start"), width), floor_div(F.col("end") - 1, width))
    pieces = placed.select(F.explode(F.transform(overlapped, piece)).alias("p")).select("p.*")
    rows = pieces.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: p["part"]))
    return rows.select("row_id", joined.alias("ids")).where(F.size("ids") == width)


def pack_rows(docs: DataFrame, T: int, key: str = "doc_id", tokens: str = "tokens", vocab_size: int = 0, **order) -> DataFrame:
    """Rows of T + 1 tokens that do not overlap: inputs are the first T, targets the last T."""
    rows = cut_stream(docs, T + 1, key, tokens, **order).select("row_id", token_string_ids(F.col("tokens"), vocab_size).alias("ids"))
    return rows.select("row_id", F.slice("ids", 1, T).alias("inputs"), F.slice("ids", 2, T).alias("targets"))


def pack_flat(docs: DataFrame, B: int, T: int, key: str = "doc_id", tokens: str = "tokens", vocab_size: int = 0, **order) -> DataFrame:
    """Batches of B * T + 1 tokens, cut into B rows of T inputs and the T targets one further on."""
    batches = cut_stream(docs, B * T + 1, key, tokens, **order)
    rows = batches.select(F.col("row_id").alias("batch"), "tokens", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("b"))
    ids = token_string_ids(F.substring("tokens", F.col("b") * T + 1, F.lit(T + 1)), vocab_size)
    return rows.select("batch", "b", ids.alias("ids")).select(
        "batch", "b", F.slice("ids", 1, T).alias("inputs"), F.slice("ids", 2, T).alias("targets"))


def shift_targets(ids: Column, mask: Column) -> tuple[Column, Column]:
    """Inputs without the last token; targets without the first, -1 where the mask is 0."""
    n = F.size(ids)
    targets = F.zip_with(F.slice(ids, F.lit(2), n - 1), F.slice(mask, F.lit(2), n - 1),
                         lambda t, m: F.when(m == 0, IGNORED_TARGET).otherwise(t))
    empty = F.array().cast("array<int>")
    return (F.when(n > 1, F.slice(ids, F.lit(1), n - 1)).otherwise(empty), F.when(n > 1, targets).otherwise(empty))


def pad_right(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (width - F.size(ids)).cast("int")))


def pad_left(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), (width - F.size(ids)).cast("int")), ids)


def pad_batch(rows: DataFrame, batch_size: int, pad: int, idx: str = "idx", ids: str = "ids",
              left: bool = False, width: int | None = None) -> DataFrame:
    """Pad to the longest row of each batch of ``batch_size`` consecutive rows."""
    batched = rows.withColumn("batch", F.floor(F.col(idx) / batch_size).cast("bigint"))
    fill = pad_left if left else pad_right
    if width is not None:
        return batched.withColumn(ids, fill(F.col(ids), F.lit(width), pad))
    # Width as a partial aggregate; a batch never has more than batch_size rows.
    widths = batched.groupBy("batch").agg(F.max(F.size(ids)).alias("width"))
    return batched.join(widths, "batch").withColumn(ids, fill(F.col(ids), F.col("width"), pad))


def shift_rollout_targets(rollouts: DataFrame, example: str, pad: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Samples of one example padded to equal length, then shifted; padding is never a target."""
    widths = rollouts.groupBy(example).agg(F.max(F.size(ids)).alias("width"))
    wide = rollouts.join(widths, example)
    wide = wide.withColumn(ids, pad_right(F.col(ids), F.col("width"), pad)).withColumn(
        mask, pad_right(F.col(mask), F.col("width"), 0))
    inputs, targets = shift_targets(F.col(ids), F.col(mask))
    return wide.withColumn("inputs", inputs).withColumn("targets", targets).drop("width")


def supervised_tokens(targets: Column) -> Column:
    return F.size(F.filter(targets, lambda t: t >= 0))
