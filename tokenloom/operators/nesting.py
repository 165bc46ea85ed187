"""Nesting coordinates of token sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tokenloom.functions.merging import BATCH, code_points, portions
from tokenloom.functions.tokens import DOWN_ID, UP_ID

PORTION = 1 << 20   # coordinates that are made at once


def coordinates(ids: np.ndarray, dims: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """State after every token, as a (length, dims) array; of several sequences, one behind the other, if ``bounds`` has their ends.

    The pointer moves one dimension on at DOWN and back at UP; every token counts in the
    dimension it ends up in, and UP clears the dimension it leaves.  So a coordinate is a
    running count minus that count at the last clearing.  Between two markers one dimension counts
    and the others stand, so all that runs is found once a stretch and not once a token.
    """
    bounds = np.array([0, len(ids)]) if bounds is None else np.asarray(bounds)
    if not len(ids):
        return np.empty((0, dims), dtype=np.int32)
    begins = np.zeros(len(ids), dtype=bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    down, up = ids == DOWN_ID, ids == UP_ID
    start = np.flatnonzero(begins | down | up)   # of the stretches
    first, down, up = begins[start], down[start], up[start]
    size, k = np.diff(start, append=len(ids)), np.arange(len(start))
    moved = np.cumsum(down.astype(np.int64) - up)
    origin = (moved - down + up)[first][np.cumsum(first) - 1]
    pointer = (dims - 1 + moved - origin) % dims
    before = np.where(first, dims - 1, np.append(dims - 1, pointer[:-1]))
    seen = np.zeros((len(start) + 1, dims), dtype=np.int32)
    seen[k + 1, pointer] = size
    seen = np.cumsum(seen, axis=0, dtype=np.int32, out=seen)[:-1]
    # With one dimension UP clears first and counts afterwards.
    cleared = np.where(first[:, None], seen, 0)
    cleared[k[up], before[up]] = seen[k[up], before[up]]
    out = np.repeat(seen - np.maximum.accumulate(cleared, axis=0), size, axis=0)
    at = np.arange(len(ids))
    out.reshape(-1)[at * dims + np.repeat(pointer, size)] += (at + 1 - np.repeat(start, size)).astype(np.int32)
    return out


def batch_coordinates(batch: pa.Array, dims: int, limit: int) -> pa.Array:
    """A list array of ids as lists of ``dims`` counts per token."""
    offsets = batch.offsets.to_numpy().astype(np.int64)
    values = batch.values.to_numpy(zero_copy_only=False)
    flat = np.minimum(coordinates(values[offsets[0]:offsets[-1]], dims, offsets - offsets[0]), np.int32(limit - 1))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * dims, pa.int32()), pa.array(flat.ravel(), pa.int32()))
    starts = pa.array(offsets - offsets[0], pa.int32())
    return pa.ListArray.from_arrays(starts, inner, mask=batch.is_null() if batch.null_count else None)


def nesting_udf(dims: int = 8, limit: int = 2048):
    """Arrow function from ids to coordinates, a portion of a batch at a time."""
    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def state(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for portion in portions(batch, PORTION // dims):
                yield batch_coordinates(portion, dims, limit)

    return state


def nesting_coordinates(rows: DataFrame, dims: int = 8, limit: int = 2048, ids: str = "ids") -> DataFrame:
    """Adds ``coords``, one array of ``dims`` counts per token, cut off at ``limit - 1``."""
    return rows.withColumn("coords", nesting_udf(dims, limit)(F.col(ids)))


def _spelled(top: int, _kept: list[pa.Array] = []) -> pa.Array:  # noqa: B006
    """Numbers up to ``top`` at least, each with a blank and then with a semicolon behind it; kept, and doubled when larger ones come."""
    if not _kept or len(_kept[0]) <= 2 * top + 1:
        numbers = np.arange(1 << max(10, (top + 1).bit_length()))
        text = np.char.add(np.repeat(numbers.astype("S"), 2), np.tile(np.array([b" ", b";"]), len(numbers)))
        _kept[:] = [pa.array(text.tolist(), pa.large_binary())]
    return _kept[0]


def batch_digests(tokens: pa.Array, dims: int, limit: int) -> pa.Array:
    """MD5 of the coordinates of each token string, written as numbers with blanks and tokens with semicolons between.

    The text of a whole array is one ``take`` from spelled numbers; a long one is made and hashed in parts.
    """
    points, bounds = code_points(tokens)
    flat = np.minimum(coordinates(points, dims, bounds), np.int32(limit - 1)).ravel()
    spelled = _spelled(int(flat.max(initial=0)))
    hashes = [hashlib.md5(usedforsecurity=False) for _ in bounds[1:]]
    row = 0
    for low in range(0, len(points), PORTION // dims):
        high = min(len(points), low + PORTION // dims)
        at = flat[low * dims:high * dims] * 2
        at[dims - 1::dims] += 1
        text = spelled.take(pa.array(at))
        ends, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2])
        while row < len(hashes) and bounds[row] < high:
            a, b = max(low, int(bounds[row])), min(high, int(bounds[row + 1]))
            last = b == bounds[row + 1]
            if b > a:
                hashes[row].update(data[ends[(a - low) * dims]:ends[(b - low) * dims] - last])
            if not last:
                break
            row += 1
    return pa.array([h.hexdigest() for h in hashes], pa.string())


def digest_udf(dims: int = 8, limit: int = 2048):
    """Arrow function from token strings without nulls to the digests of their coordinates, a portion of a batch at a time."""
    @F.arrow_udf("string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for portion in portions(batch, PORTION // dims):
                yield batch_digests(portion, dims, limit)

    return digest


def nesting_digests(rows: DataFrame, dims: int = 8, limit: int = 2048, tokens: str = "tokens") -> DataFrame:
    """Adds ``downs``, the number of opening markers, and ``coords_md5``, the digest of the coordinates as text.

    Takes token strings; coordinates are hashed where they are made, as their text is some hundred times as long as the digest.
    A null sequence counts as empty.  Batches are kept short, and the setting stays: a DataFrame is planned when it is run.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    whole = F.coalesce(F.col(tokens), F.lit(""))
    downs = F.length(whole) - F.length(F.replace(whole, F.lit(chr(DOWN_ID)), F.lit("")))
    return rows.withColumns({"downs": downs.cast("bigint"), "coords_md5": digest_udf(dims, limit)(whole)})


def nesting_profile(rows: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Deepest nesting per sequence, in the JVM: opening minus closing markers so far."""
    walk = F.aggregate(
        ids, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda s, t: F.struct((s["now"] + F.when(t == DOWN_ID, 1).when(t == UP_ID, -1).otherwise(0)).alias("now"),
                              F.greatest(s["top"], s["now"] + F.when(t == DOWN_ID, 1).otherwise(0)).alias("top")),
        lambda s: s["top"])
    return rows.select(key, walk.alias("max_depth"))
