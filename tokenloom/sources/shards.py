"""Corpus shards: listing, splits, strided scans, re-sharding, packed rows, tokenizer files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tokenloom.operators import bpe
from tokenloom.operators.corpus import greedy_shards, shuffle_index
from tokenloom.session import materialise

READERS = 10_000   # reading tasks of a strided scan, at most


def shard_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, bytes`` of every Parquet file; a listing only, no file is opened."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(path))
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("bytes")).orderBy("file_path")


def read_corpus(spark: SparkSession, path: str, split: str, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``val`` is the last file by name, ``train`` all others; only ``columns`` are read."""
    if split not in ("train", "val"):
        raise ValueError("split must be train or val")
    # Files are read by name, so train opens nothing of val; names stand for themselves, not for patterns.
    files = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", r.file_path) for r in shard_catalog(spark, path).select("file_path").collect()]
    wanted = files[-1:] if split == "val" else files[:-1]
    if not wanted:
        return spark.read.parquet(path).select(*columns).limit(0)
    return spark.read.option("basePath", path).parquet(*wanted).select(*columns)


def _open(uri: str):
    """The file behind a path that Spark lists, through pyarrow's file systems."""
    scheme, _, rest = uri.partition(":")
    if "://" not in uri and scheme == "file":
        uri = f"file://{rest}"
    if uri.startswith("file://"):
        return pq.ParquetFile(pafs.LocalFileSystem().open_input_file(uri.removeprefix("file://")))
    store, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(store.open_input_file(path))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, first row and rows of each row group; only footers are read."""
    for batch in batches:
        for path in batch.column("file_path").to_pylist():
            with _open(path) as file:
                rows = np.array([file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)], dtype=np.int64)
            yield pa.record_batch({"file_path": pa.array([path] * len(rows), pa.string()), "row_group": pa.array(np.arange(len(rows), dtype=np.int32)),
                                   "first": pa.array(np.append(0, np.cumsum(rows))[:len(rows)]), "rows": pa.array(rows)})


def _strided(start: int, step: int, group_rows: int, schema: StructType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        for batch in batches:
            for path, group, first in zip(*(batch.column(c).to_pylist() for c in ("file_path", "row_group", "first"))):
                with _open(path) as file:
                    for part in file.iter_batches(batch_size=group_rows, row_groups=[group], columns=wanted.names):
                        mine = (first + np.arange(part.num_rows)) // group_rows % step == start
                        first += part.num_rows
                        if mine.any():
                            table = pa.Table.from_batches([part]).select(wanted.names).filter(pa.array(mine)).cast(wanted)
                            yield from table.to_batches()
    return task


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, row_group, first, rows`` of every Parquet file, from the footers."""
    return shard_catalog(spark, path).select("file_path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(
        _footers, "file_path string, row_group int, first long, rows long")


def strided_scan(spark: SparkSession, path: str, start: int, step: int, group_rows: int = 1024,
                 columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Groups ``g`` of ``group_rows`` rows of each file with ``g % step == start``.

    A task reads row groups of the files; those that hold no row of a wanted group are known from the footers and not
    read.  Where files are written in row groups of ``group_rows``, a scan reads a ``step``-th of their bytes.  The
    columns are those of the files, not of their folders.
    """
    schema = spark.read.parquet(path).select(*columns).schema
    low, high = (F.call_function("div", F.col("first") + more, F.lit(group_rows).cast("bigint")) for more in (F.lit(0), F.col("rows") - 1))
    held = row_groups(spark, path).where((F.col("rows") > 0) & (low + F.pmod(F.lit(start) - low, F.lit(step)) <= high))
    found = materialise(held, "groups")
    tasks = max(1, min(found.count(), READERS))
    return found.repartition(tasks).mapInArrow(_strided(start, step, group_rows, schema), schema)


def assign_shards(docs: DataFrame, chars_per_shard: int, group_rows: int, seed: int, doc_id: str = "doc_id",
                  drop_tail: bool = False) -> DataFrame:
    """Shuffled documents with ``idx`` and ``shard``; a shard ends at the first full row group
    at which it holds ``chars_per_shard`` characters."""
    keyed = shuffle_index(docs.select(doc_id, F.length("text").alias("chars")), seed, F.col(doc_id))
    keyed = keyed.withColumn("block", F.floor(F.col("idx") / group_rows).cast("bigint"))
    blocks = keyed.groupBy("block").agg(F.sum("chars").cast("bigint").alias("chars"), F.count("*").alias("docs"))
    shards = greedy_shards(blocks, chars_per_shard, group_rows)
    if drop_tail:
        shards = shards.where("closed")
    return keyed.join(shards.select("block", "shard"), "block").select(doc_id, "idx", "shard", "chars")


def repackage_corpus(docs: DataFrame, out: str, chars_per_shard: int = 250_000_000, group_rows: int = 1024,
                     seed: int = 42, doc_id: str = "doc_id", drop_tail: bool = False) -> DataFrame:
    """Shuffle, cut into shards and write zstd Parquet; returns the shard assignment.

    One shard is one file under ``shard=NNNNN/``.  The text moves once, in the final write.
    """
    assigned = materialise(assign_shards(docs, chars_per_shard, group_rows, seed, doc_id, drop_tail), "shards")
    placed = docs.select(doc_id, "text").join(assigned.select(doc_id, "idx", "shard"), doc_id)
    named = placed.withColumn("shard", F.format_string("%05d", "shard"))
    (named.repartition("shard").sortWithinPartitions("shard", "idx").select("text", "shard")
     .write.mode("overwrite").partitionBy("shard")
     .option("compression", "zstd").option("parquet.compression.codec.zstd.level", 3)
     .option("parquet.enable.dictionary", "false").option("parquet.column.statistics.enabled", "false")
     .option("parquet.block.row.count.limit", group_rows).parquet(out))
    return assigned


def write_packed_rows(rows: DataFrame, out: str, by: str | None = "split") -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in rows.columns else writer).parquet(out)


def save_tokenizer(spark: SparkSession, merges: list[tuple[int, int, int]], path: str, pattern: str = "",
                   markers: bool = True) -> None:
    """Merges as Parquet, settings as one JSON row; the vocabulary size is the last id plus one."""
    rows = [(a, b, i) for a, b, i, *_ in merges]
    spark.createDataFrame(rows, "a int, b int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    size = max([i for _, _, i in rows], default=bpe.T.FIRST_MERGE_ID - 1) + 1
    meta = [(pattern, size, markers)]
    (spark.createDataFrame(meta, "pattern string, n_vocab int, use_recursive_markers boolean")
     .coalesce(1).write.mode("overwrite").json(f"{path}/settings"))


def load_tokenizer(spark: SparkSession, path: str) -> dict:
    meta = spark.read.schema("pattern string, n_vocab int, use_recursive_markers boolean").json(f"{path}/settings").first()
    merges = bpe.merge_list(spark.read.parquet(f"{path}/merges"))
    # Settings written before markers existed mean markers on.
    markers = True if meta.use_recursive_markers is None else meta.use_recursive_markers
    return {"merges": merges, "pattern": meta.pattern, "n_vocab": meta.n_vocab, "markers": markers}


def write_token_bytes(vocab: DataFrame, path: str) -> None:
    bpe.token_bytes_table(vocab).write.mode("overwrite").parquet(path)
