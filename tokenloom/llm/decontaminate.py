"""Benchmark decontamination as a prefix-filtered set join.

A window of a benchmark item (13 words, or the whole of a shorter item) is the set of its shingles with
their places.  It occurs in a document only if all of them do, so the necessary prefix in the order of
rarity is the one shingle that the corpus holds least often.  Documents are scanned for prefix shingles
only; a find brings the words around it.  The place of the shingle in the window gives where the window
has to start (positional bound) and how many words must follow (length bound); what is left is compared
word by word.  The text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, ready, row_key
from tokenloom.llm.words import ALNUM, STEP, span, words_of, runs
from tokenloom.session import materialise

WINDOW = 13
SHINGLE = 3
FILTER_BITS = 22          # of the bitmap that a scan tests first: 512 KB, however many items there are
BROADCAST_ROWS = 50_000   # windows up to this number (about 10 MB) are broadcast, more are joined by shuffle
FINDS = 20_000            # finds of one Arrow batch: about 5 MB, however many a text has


def _windows(size: int, shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"item_id": [], "words": [], "shingles": []}
            ids = batch.column("item_id").to_pylist()
            for words in words_of(batch.column("text"), ALNUM):
                bounds = np.searchsorted(words.row, np.arange(words.rows + 1))
                for r in range(words.rows):
                    own = words.hash[bounds[r]:bounds[r + 1]]
                    for i in range(max(1, len(own) - size + 1) if len(own) else 0):
                        window = own[i:i + size]
                        k = min(shingle, len(window))
                        at = np.arange(len(window) - k + 1)
                        out["item_id"].append(ids[words.first + r])
                        out["words"].append(window.view(np.int64))
                        out["shingles"].append(span(runs(window, STEP), at, at + k, STEP).view(np.int64))
            yield pa.record_batch([pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.list_(pa.int64())),
                                   pa.array(out["shingles"], pa.list_(pa.int64()))], names=list(out))
    return task


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Bits of the hashes in column ``token``; ``2 ** FILTER_BITS`` of them, whatever the input."""
    bit = F.col("token").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (tokens.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(token & 63 AS INT))")).alias("v"))).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out


def _found(words, sizes: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that pass the bitmap."""
    places, hashes = [], []
    for k in sizes:
        grams = words.grams(k)
        low = (grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        passed = (bitmap[low >> 6] >> (low & 63)) & 1
        at = np.flatnonzero((passed == 1) & words.within(k))
        places.append(at)
        hashes.append(grams[at].view(np.int64))
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.int64)])


def _count(sizes: list[int], bitmap):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_found(w, sizes, bitmap.value)[1] for w in words_of(batch.column("text"), ALNUM)]
            token, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.record_batch({"token": pa.array(token), "c": pa.array(n.astype(np.int64))})
    return task


SCANNED = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                     ("token", pa.int64()), ("at", pa.int64()), ("left", pa.int64()), ("around", pa.list_(pa.int64()))])


def _scan(sizes: list[int], bitmap, size: int):
    """A row for each document with its words, and one for each find with the words that any window over it can reach."""
    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in SCANNED], schema=SCANNED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, rows = np.zeros(batch.num_rows, np.int64), batch.column("row").to_numpy()
            for words in words_of(batch.column("text"), ALNUM):
                bounds = np.searchsorted(words.row, np.arange(words.rows + 1))
                n_words[words.first:words.first + words.rows] = np.diff(bounds)
                place, token = _found(words, sizes, bitmap.value)
                for k in range(0, len(place), FINDS):
                    i = place[k:k + FINDS]
                    r = words.row[i]
                    a, b = np.maximum(bounds[r], i - size + 1), np.minimum(bounds[r + 1], i + size)
                    ends = np.append(0, np.cumsum(b - a))
                    within = np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)
                    yield batch_of(row=pa.array(rows[words.first + r]), token=pa.array(token[k:k + FINDS]), at=pa.array(i - bounds[r]),
                                   left=pa.array(i - a), around=pa.ListArray.from_arrays(
                                       pa.array(ends.astype(np.int32)), pa.array(words.hash[within].view(np.int64))))
            yield batch_of(**{c: batch.column(c) for c in ("row", "doc", "tag", "doc_id")}, n_words=pa.array(n_words))
    return task


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """Finds windows of ``items`` (``item_id, text``) in ``docs`` and the words they cover.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, the ``items`` and the row key
    ``doc, tag``, a row per row of ``docs``; contaminated if ``n_hit > 0`` and ``share * n_hit >= n_words``.  Null and empty texts have no
    words, items without words no windows.  The words of an item with a null id are hit as those of others, but it is
    in no list of items; items that repeat an id count as one.  Other columns are ignored.
    """
    spark = ready(docs)
    texts = keyed_texts(docs)
    given = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    windows = materialise(given.mapInArrow(
        _windows(size, shingle), "item_id string, words array<long>, shingles array<long>"), "windows")
    # Equal windows of several items are looked for once.
    distinct = materialise(windows.groupBy("words").agg(F.first("shingles").alias("shingles"))
                           .withColumn("window", F.monotonically_increasing_id()), "distinct")
    owners = windows.join(distinct.select("words", "window"), "words").select("window", "item_id").distinct()
    sizes = [r[0] for r in distinct.select(F.least(F.lit(shingle), F.size("words"))).distinct().collect()]
    each = distinct.select("window", "words", F.posexplode("shingles").alias("offset", "token"))
    bitmap = spark.sparkContext.broadcast(_bitmap(each.select("token").distinct()))
    counts = texts.select("text").mapInArrow(_count(sizes, bitmap), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    ranked = each.join(counts, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token", "offset", "words")).alias("p"))
    # A shingle that no document holds rules its window out.
    keys = materialise(ranked.where("p.c > 0").select("window", "p.token", "p.offset", "p.words"), "keys")
    needed = spark.sparkContext.broadcast(_bitmap(keys.select("token").distinct()))
    scanned = materialise(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _scan(sizes, needed, size), "row long, doc long, tag long, doc_id long, n_words long, token long, at long, left long, around array<long>"), "finds")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    hits = scanned.where("token is not null").select("row", "token", "at", "left", "around")
    n, first = F.size("words"), F.col("left") - F.col("offset")
    spans = materialise(
        hits.join(keys, "token").where((first >= 0) & (first + n <= F.size("around")))
        .where(F.slice("around", first + 1, n) == F.col("words"))
        .select("row", "window", (F.col("at") - F.col("offset")).alias("a"), (F.col("at") - F.col("offset") + n).alias("b")), "spans")
    # Words of a span beyond the end of all before it; spans of a row are sorted by a window, not held in one array.
    before = F.coalesce(F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = (spans.select("row", "a", "b").distinct().select("row", F.greatest(F.lit(0), F.col("b") - F.greatest(before, "a")).alias("new"))
             .groupBy("row").agg(F.sum("new").cast("bigint").alias("n_hit")))
    named = (spans.select("row", "window").distinct().join(owners.where("item_id is not null"), "window").select("row", "item_id").distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    joined = scanned.where("n_words is not null").select("row", "doc", "tag", "doc_id", "n_words").join(words, "row", "left").join(named, "row", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), found.alias("items"), "doc", "tag")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` with all their columns that are not contaminated by ``items``."""
    bad = contaminated(docs, items).where("contaminated").select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).distinct()
    return docs.withColumns(dict(zip(("__doc", "__tag"), row_key()))).join(bad, ["__doc", "__tag"], "left_anti").select(*docs.columns)
