"""Running values in a total order, without a one-partition window and without a pass to find its parts.

Rows are cut into ranges of the order, sorted and written once; a task carries the running value of its own rows.
What a task has to add is the value of the group it begins with in the tasks before it, so one figure a task: these are
joined on read.  Ranges follow the rows, so they are even whatever the keys are: dense, sparse or hashes; a hot group is
cut like any other.  Null keys and null groups count like any other; nulls come first, and equal keys share a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tokenloom.session import materialise

PLACE_BITS = 33   # of a row's number within its task


@dataclass
class Ranges:
    """How many ranges the order is cut into; None leaves it to the session."""

    number: int | None = None


def integer_levels(key: Column, buckets: int | None = None) -> Ranges:
    """Ranges of a numeric key of any distribution."""
    return Ranges(buckets)


def floor_div(value: Column, width: int) -> Column:
    """Whole number of ``width`` in a BIGINT, without a rounded quotient."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def digest_levels(key: Column, digits: int | None = None) -> Ranges:
    """Ranges of a hex digest."""
    return Ranges(None if digits is None else 16**digits)


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def _join(acc: Column, other: Column, how: str) -> Column:
    if how in ("sum", "count"):
        return F.coalesce(acc, F.lit(0)) + F.coalesce(other, F.lit(0))
    return F.least(acc, other) if how == "min" else F.greatest(acc, other)


def _sortable(values: pa.Array) -> np.ndarray:
    """Numbers, dates and times without nulls as integers of the same order; NaN is the largest."""
    if pa.types.is_floating(values.type):
        bits = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        return bits ^ ((bits >> 63) & np.int64(2**63 - 1))
    wide = pa.int32() if pa.types.is_date32(values.type) else pa.int64()
    return values.cast(wide).to_numpy(zero_copy_only=False).astype(np.int64)


def _unsorted(keys: np.ndarray, like: pa.DataType) -> pa.Array:
    if pa.types.is_floating(like):
        return pa.array((keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)).cast(like)
    wide = pa.int32() if pa.types.is_date32(like) else pa.int64()
    return pa.array(keys).cast(wide).cast(like)


def _running(how: str, group: list[str]):
    """Adds ``__local`` and ``__before``: the running value of a task's rows up to each row, with and without it."""
    def run_starts(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        for g in group:
            code = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        new[0] = last is None or last != tuple(batch.column(g)[0].as_py() for g in group)
        return new

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, acc = None, None   # group and value of the last row; no value yet
        for batch in batches:
            if not batch.num_rows:
                continue
            new, column = run_starts(batch, last), batch.column("__v")
            run = np.cumsum(new) - new[0]
            carried = run == 0 if not new[0] else np.zeros(len(run), dtype=bool)
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            if how in ("sum", "count"):
                own = column.fill_null(0).to_numpy(zero_copy_only=False)
                local = pd.Series(own).groupby(run).cumsum().to_numpy()
                local = np.where(carried, local + (acc or 0), local)
                before = local - own
                value, earlier, acc = pa.array(local, column.type), pa.array(before, column.type), local[-1]
            else:
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                worst = np.iinfo(np.int64).max if how == "min" else np.iinfo(np.int64).min
                best = np.minimum if how == "min" else np.maximum
                own = np.full(len(run), worst)
                own[valid] = _sortable(column.drop_null())
                grouped = pd.Series(own).groupby(run)
                local = (grouped.cummin() if how == "min" else grouped.cummax()).to_numpy()
                seen = pd.Series(valid).groupby(run).cumsum().to_numpy() > 0
                before, was = np.append(worst, local[:-1]), np.append(False, seen[:-1])
                before[first], was[first] = worst, False
                if acc is not None:
                    local, before = (np.where(carried, best(x, acc), x) for x in (local, before))
                    seen, was = seen | carried, was | carried
                value, earlier = (pa.compute.if_else(pa.array(k), _unsorted(np.where(k, x, 0), column.type), pa.scalar(None, column.type))
                                  for k, x in ((seen, local), (was, before)))
                acc = local[-1] if seen[-1] else None
            last = tuple(batch.column(g)[-1].as_py() for g in group)
            yield pa.record_batch([*batch.columns, value, earlier], names=[*batch.schema.names, "__local", "__before"])
    return task


def _ordered(df: DataFrame, order: Sequence[Column], ranges: Ranges | None) -> DataFrame:
    cut = df.repartitionByRange(ranges.number, *order) if ranges and ranges.number else df.repartitionByRange(*order)
    return cut.sortWithinPartitions(*order)


def running_value(df: DataFrame, value: Column, order: Sequence[Column], levels: Ranges | None = None,
                  how: str = "sum", group: Sequence[str] = (), out: str = "running",
                  before: str | None = None) -> DataFrame:
    """Inclusive running ``sum``, ``min`` or ``max`` of ``value`` in ``order`` inside each ``group``.

    ``value`` is a number, for ``min`` and ``max`` also a date or time.  ``before`` names a column for the value up to, not
    including, the row.  The result comes in stored order, range by range.
    """
    combine, group = _COMBINE[how], list(group)
    keyed = df.withColumn("__v", value)
    given = keyed.schema["__v"].dataType
    if how in ("sum", "count"):
        kept = given if isinstance(given, (S.DoubleType, S.FloatType)) else S.LongType()
        keyed = keyed.withColumn("__v", F.col("__v").cast("double" if isinstance(kept, S.FloatType) else kept.simpleString()))
    kind = keyed.schema["__v"].dataType
    ranged = _ordered(keyed, [*[F.col(g) for g in group], *order], levels)
    schema = S.StructType([*keyed.schema.fields, S.StructField("__local", kind), S.StructField("__before", kind)])
    ranged = ranged.mapInArrow(_running(how, group), schema).drop("__v")
    return _with_carry(ranged, combine, how, group, out, before)


def _with_carry(ranged: DataFrame, combine, how: str, group: list[str], out: str, before: str | None) -> DataFrame:
    """Stores the rows with their task and adds what the tasks before it hold of the group that it begins with."""
    stored = materialise(ranged.withColumn("__row", F.monotonically_increasing_id()), "ordered").withColumn("__task", F.shiftright("__row", PLACE_BITS))
    own = F.struct(F.lit(0).alias("__0"), *group)
    tasks = stored.groupBy("__task").agg(F.min_by(own, "__row").alias("__first"), F.max_by(own, "__row").alias("__last"),
                                         F.max_by("__local", "__row").alias("__tail"))
    upto = Window.partitionBy("__last").orderBy("__task").rowsBetween(Window.unboundedPreceding, 0)
    summed = tasks.withColumn("__held", combine("__tail").over(upto))
    # A row for each task, so this window and the broadcast are as large as the number of tasks, whatever the rows.
    previous = F.lag(F.struct("__last", "__held")).over(Window.partitionBy(F.lit(0)).orderBy("__task"))
    starts = summed.withColumn("__p", previous).select(
        F.col("__task").alias("__at"), "__first", F.when(F.col("__p.__last").eqNullSafe(F.col("__first")), F.col("__p.__held")).alias("__carry"))
    joined = stored.join(F.broadcast(starts), F.col("__task") == F.col("__at"))
    carry = F.when(own.eqNullSafe(F.col("__first")), F.col("__carry"))
    joined = joined.withColumn(out, _join(F.col("__local"), carry, how))
    if before:
        joined = joined.withColumn(before, _join(F.col("__before"), carry, how))
    return joined.drop("__row", "__task", "__at", "__first", "__carry", "__local", "__before")


def global_offsets(df: DataFrame, n: Column, order: Sequence[Column], levels: Ranges | None = None,
                   group: Sequence[str] = ()) -> DataFrame:
    """Adds ``start`` and ``end`` (BIGINT) of a length in a total order."""
    sized = df.withColumn("__n", n.cast("bigint"))
    out = running_value(sized, F.col("__n"), order, levels, "sum", group, out="end")
    return out.withColumn("start", F.col("end") - F.col("__n")).drop("__n")


def dense_index(df: DataFrame, order: Sequence[Column], levels: Ranges | None = None,
                group: Sequence[str] = (), out: str = "idx") -> DataFrame:
    """Adds a dense 0-based BIGINT position in ``order`` inside each ``group``."""
    if group:
        counted = running_value(df, F.lit(1).cast("bigint"), order, levels, "sum", group, out=out)
    else:
        # The place in the task is in the row's number.
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
        counted = _with_carry(_ordered(df, order, levels).withColumn("__local", place), F.sum, "sum", [], out, None)
    return counted.withColumn(out, F.col(out) - 1)
