"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard.  At each node every child draws
``-ln(u) / weight`` with u from a hash of the row's key and the child's name, and the least draw wins, so a
child gets its share of the weight.  Raising a weight moves rows only into that child; everything outside
the changed subtree stays.  A new shard comes as a region of its own, so it takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import numbered, ready

Tree = dict  # name -> weight of a shard, or Tree of a subtree; shards are named by their number


def shard_tree(shards: int, regions: int = 2, racks: int = 2, base: int = 8) -> Tree:
    """Regions of racks of shards: the first ``base`` shards evenly, each later one in a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tree: Tree = {}
    for s in range(min(shards, base)):
        region = s * regions // base
        rack = s * regions * racks // base % racks
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"region-of-{s}"] = {"rack0": {s: 1.0}}
    return tree


def weight(tree) -> float:
    return sum(map(weight, tree.values())) if isinstance(tree, dict) else float(tree)


def draw(key: Column, name: str, share: float) -> Column:
    """``-ln(u) / share`` with u in (0, 1) from 52 bits of a hash of name and key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 52)) / share


def place(key: Column, tree: Tree, path: str = "") -> Column:
    """Number of the shard that ``key`` falls to; children without weight get nothing."""
    children = [(n, sub) for n, sub in tree.items() if weight(sub) > 0]
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    below = {n: place(key, sub, f"{path}/{n}") if isinstance(sub, dict) else F.lit(int(n)) for n, sub in children}
    if len(children) == 1:
        return below[children[0][0]]
    # The child's index breaks ties between equal draws.
    best = F.array_min(F.array(*[F.struct(draw(key, f"{path}/{n}", weight(sub)).alias("d"), F.lit(i).alias("i"))
                                 for i, (n, sub) in enumerate(children)]))["i"]
    out = below[children[-1][0]]
    for i, (n, _) in reversed(list(enumerate(children[:-1]))):
        out = F.when(best == i, below[n]).otherwise(out)
    return out


def shard_rows(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """Shard, place within it and content figures of every row; ``grown`` adds where the row would go then.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  The id alone decides, so rows that
    repeat an id stay together and rows with a null id share one shard.  Null texts count as empty: size 1.
    Other columns are ignored.
    """
    ready(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("bigint")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    return numbered(rows, "shard", "slot", "shards").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
