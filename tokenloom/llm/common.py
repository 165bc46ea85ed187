"""What the operators of this subpackage share: row keys, written tables, gapless numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.session import materialise, ship_package

#: Rows and bytes of one Arrow batch.  Texts can be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on the Python workers and short Arrow batches.

    The two settings stay: a DataFrame is planned when it is run, long after its operator has returned.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def row_key() -> tuple[Column, Column]:
    """A key of rows with ``doc_id`` and ``text`` that any later scan of the same rows yields again.

    First the id (a fixed value for null), then a 64-bit hash of the text, which tells apart rows that
    repeat an id.  Rows that are equal in both share a key and so a result.  A key made of partition and
    row numbers would change when a scan is split otherwise after executors were lost.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63) + 1)), F.xxhash64(text)


def keyed_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc, tag, doc_id, text)`` and ``more``: the row key, the id as BIGINT, the text with null as empty."""
    doc, tag = row_key()
    return docs.select(doc.alias("doc"), tag.alias("tag"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def numbered(df: DataFrame, group: str, out: str, label: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps in every ``group``.

    The rows are written once with the task that wrote them; a number is the rows of earlier tasks
    plus the place within the task.  So a window sees the rows of one group in one task, or one
    number per task, and a group of any size is split.
    """
    stored = materialise(df.withColumn("__row", F.monotonically_increasing_id()), label)
    stored = stored.withColumn("__task", F.shiftright("__row", 33))
    sizes = stored.groupBy(group, "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("__group"), F.col("__task").alias("__at"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, "__task").orderBy("__row")
    placed = stored.withColumn("__place", F.row_number().over(within) - 1)
    return (placed.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__task") == F.col("__at")))
            .withColumn(out, (F.col("__start") + F.col("__place")).cast("bigint"))
            .drop("__row", "__task", "__place", "__start", "__group", "__at"))
