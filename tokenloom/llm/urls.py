"""URL filter: a blocked Bloom filter over the listed canonical URLs, then an exact hash join.

A listed URL is a host and the start of a path; it fits the host, its subdomains and all paths that
start so.  A page can only be listed under the ends of its host with as many labels as some listed host
and under the starts of its path as long as some listed path.  Each such candidate is tested in one block
of the Bloom filter (four words, one bit in each).  The filter has a block for 16 listed URLs, so it stays selective
however long the list is; it is broadcast up to ``BLOCKS`` blocks, and beyond that candidates are dealt by block and
joined.  What passes is joined by host and path, so a false positive finds no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import ascii_lower
from tokenloom.session import materialise

LISTED = 16       # URLs of one block of the filter, with 256 bits
BLOCKS = 1 << 18  # blocks that are broadcast, at most: 262,144 rows of 40 bytes, for 4 million URLs


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path of a url; both empty without ``://`` or for null."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_replace(text, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _bits(host: Column, path: Column, blocks: int) -> list[Column]:
    """Block number and the bit in each of its four words."""
    h = F.xxhash64(host, path)
    return [F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)).cast("int")] + [
        F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w3)`` of the listed ``(host, path)``."""
    block, *bit = _bits(F.col("host"), F.col("path"), blocks)
    one = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bit)])
    return one.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(4)])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges each page by the longest of ``rules`` (``host, path, verdict``) that fits its url.

    Returns ``page_id, host, path, rule, verdict``, a row per row of ``pages``; without a fitting rule
    ``rule`` is null and ``verdict`` is ``default``, as the page isn't listed.  Of rules that fit with equal
    length the longer host wins; of equal rules, block.  A null url has an empty host and path.  Other
    columns, and rules with a null part, are ignored.
    """
    spark = pages.sparkSession
    listed = materialise(
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    # Different label counts and path lengths: as many as a host or path has, not as many as rules.
    labels = [r[0] for r in listed.select(F.size(F.split("host", r"\."))).distinct().collect()]
    lengths = [r[0] for r in listed.select(F.length("path")).distinct().collect()]
    blocks = 1 << (listed.count() // LISTED).bit_length()
    host, path = host_and_path(F.col("url"))
    rows = materialise(pages.select("page_id", host.alias("host"), path.alias("path"))
                       .withColumn("row", F.monotonically_increasing_id()), "pages")
    if not labels:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    candidates = F.array(*[
        F.when((F.size(F.split("host", r"\.")) >= k) & (F.length("path") >= n),
               F.struct(F.substring_index("host", ".", -k).alias("host"), F.substring("path", 1, n).alias("path")))
        for k in labels for n in lengths])
    tried = rows.select("row", F.explode(F.filter(candidates, lambda c: c.isNotNull())).alias("c")).select("row", "c.*")
    block, *bit = _bits(F.col("host"), F.col("path"), blocks)
    bloom = bloom_blocks(listed, blocks)
    bloom = F.broadcast(bloom) if blocks <= BLOCKS else bloom.hint("merge")
    tested = tried.withColumns({"block": block} | {f"b{i}": b for i, b in enumerate(bit)}).join(bloom, "block")
    for i in range(4):
        tested = tested.where(F.expr(f"shiftright(w{i}, b{i}) & 1L") == 1)
    rule = F.concat("host", "path")
    best = tested.select("row", "host", "path").join(listed, ["host", "path"]).groupBy("row").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from a short list, without Python on the executors."""
    quoted = ", ".join("('" + "', '".join(p.replace("\\", "\\\\").replace("'", "\\'") for p in r) + "')" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, verdict)")
