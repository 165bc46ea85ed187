"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated by a random orthogonal matrix and kept as its signs, a bit for each dimension, with the inner
product of the vector and its code as a correction factor.  The product of a rotated query with a code, divided by
the factor, is an unbiased estimate of the cosine, and its error is bounded by the factor and the number of dimensions.
A query is kept too, in 4 bits a dimension with the length of what that loses.  For pairs at or above the threshold
the bound is certain (``certain``), so a pair whose upper bound stays below the threshold has no link; all others are
recomputed exactly in double precision.

Codes are made and stored once.  All vectors of a label meet: a label is cut into blocks, bounded by bytes, and a task
compares the codes of two of them; five eighths of a byte a dimension travel, as often as the label has blocks.  A task
names the vectors that have a partner their code doesn't rule out; only these are fetched and compared exactly, by
tasks for the same two blocks.  Equal vectors are one vector with a number of copies, and a task returns link counts and
a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ready
from tokenloom.llm.components import components
from tokenloom.session import materialise

THRESHOLD = 0.93
BUCKET = 2048      # vectors of a block; of a large label a sixteenth, up to
LARGEST = 8        # so many times that, and
BYTES = 1 << 25    # so many bytes of its vectors
QUERIES = 256      # rows of one product
ROUNDING = 1e-3    # more than single precision can be off


@lru_cache(maxsize=8)
def rotation(dimensions: int) -> np.ndarray:
    random = np.random.Generator(np.random.PCG64(dimensions))
    q, r = np.linalg.qr(random.standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes as +-1, and the correction factors."""
    turned = (unit @ rotation(unit.shape[1])).astype(np.float32)
    signs = np.where(turned > 0, np.float32(1), np.float32(-1))
    return turned, signs, np.abs(turned).sum(axis=1) / np.float32(math.sqrt(unit.shape[1]))


def bounds(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries and coded vectors, and the half-width of their interval for each coded vector."""
    n = turned.shape[1]
    estimate = turned @ signs.T / math.sqrt(n) / factor
    return estimate, confidence * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(n - 1, 1))


def certain(dimensions: int, threshold: float) -> float:
    """The confidence with which ``bounds`` loses no pair of cosine ``threshold`` or more.

    A vector is ``f`` times its code and ``sqrt(1 - f^2)`` times a unit vector across it; so the product of a query
    and the code, divided by ``f``, is less than a cosine ``s`` by ``sqrt(1 - f^2) / f * sqrt(1 - s^2)`` at most
    (Cauchy and Schwarz), and that is largest at the threshold.
    """
    return math.sqrt(max(dimensions - 1, 1)) * math.sqrt(max(0.0, 1 - max(threshold, 0.0) ** 2))


@dataclass
class Codes:
    """Vectors as they are stored and sent: bits of their signs, 4-bit numbers of their places, and four figures."""

    bits: np.ndarray      # uint8, a bit for each dimension
    halves: np.ndarray    # uint8, two dimensions each
    low: np.ndarray       # what the 4-bit number 0 stands for
    step: np.ndarray      # and the distance of two neighbours
    lost: np.ndarray      # length of the difference between the vector and what its 4-bit numbers stand for
    factor: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray) -> Codes:
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        turned, signs, factor = codes(unit)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / np.float32(15), np.float32(1e-30))
        number = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
        lost = np.linalg.norm(turned - (low[:, None] + step[:, None] * number), axis=1)
        number = np.pad(number, ((0, 0), (0, number.shape[1] % 2)))
        return Codes(np.packbits(signs > 0, axis=1), number[:, ::2] << 4 | number[:, 1::2], low, step, lost.astype(np.float32), factor)

    def signs(self, dimensions: int) -> np.ndarray:
        # numpy multiplies unpacked signs faster than it counts bits.
        return np.unpackbits(self.bits, axis=1, count=dimensions).astype(np.float32) * 2 - 1

    def turned(self, dimensions: int) -> np.ndarray:
        number = np.stack([self.halves >> 4, self.halves & 15], axis=2).reshape(len(self.halves), -1)[:, :dimensions]
        return self.low[:, None] + self.step[:, None] * number.astype(np.float32)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(*(getattr(self, f.name)[at] for f in fields(self)))


def candidates(coded: Codes, dimensions: int, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``left x right`` that their codes don't rule out, some queries at a time."""
    confidence, other = certain(dimensions, threshold), coded.take(right)
    signs = other.signs(dimensions)
    for a in range(0, len(left), QUERIES):
        i = left[a:a + QUERIES]
        own = coded.take(i)
        estimate, width = bounds(own.turned(dimensions), signs, other.factor, confidence)
        x, y = np.nonzero(estimate + width + own.lost[:, None] / other.factor >= threshold - ROUNDING)
        yield i[x], right[y]


def links(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, coded: Codes | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``left x right`` of one block or two with an exact cosine of ``threshold`` or more, some queries at a time."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    for x, y in candidates(coded or Codes.of(vectors), vectors.shape[1], left, right, threshold):
        for b in range(0, len(x), 1 << 14):
            p, q = x[b:b + (1 << 14)], y[b:b + (1 << 14)]
            exact = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norm[p] * norm[q])
            yield p[exact >= threshold], q[exact >= threshold]


CODED = "label string, size int, node long, copies long, bits binary, halves binary, low float, step float, lost float, factor float"


def _vectors(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy() for c in chunks]).reshape(-1, size)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == size))
            c = Codes.of(_vectors(own.column("embedding"), size))
            yield pa.record_batch([
                *[own.column(k) for k in ("label", "size", "node", "copies")],
                *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (c.bits, c.halves)],
                *[pa.array(v.astype(np.float32)) for v in (c.low, c.step, c.lost, c.factor)]],
                names=["label", "size", "node", "copies", "bits", "halves", "low", "step", "lost", "factor"])


def _codes_of(group: pa.Table) -> Codes:
    rows = lambda c: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.uint8).reshape(len(group), -1)
    return Codes(rows("bits"), rows("halves"), *(group.column(c).to_numpy() for c in ("low", "step", "lost", "factor")))


def _sides(group: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    side = group.column("side").to_numpy()
    same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    return same, left, left if same else np.flatnonzero(side == 1)


def _open(threshold: float):
    """Rows of two blocks that have a partner which the codes leave open."""
    def task(group: pa.Table) -> pa.Table:
        same, left, right = _sides(group)
        found = np.zeros(len(group), dtype=bool)
        for p, q in candidates(_codes_of(group), group.column("size")[0].as_py(), left, right, threshold):
            if same:
                p, q = p[p != q], q[p != q]
            found[p] = found[q] = True
        return group.select([*TASK, "side", "node"]).filter(pa.array(found))
    return task


TASK = ["label", "size", "i", "j"]


def _compare(threshold: float):
    def task(group: pa.Table) -> pa.Table:
        node, copies = (group.column(c).to_numpy() for c in ("node", "copies"))
        vectors = _vectors(group.column("embedding"), group.column("size")[0].as_py())
        same, left, right = _sides(group)
        count, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for p, q in links(vectors, left, right, threshold, _codes_of(group)):
            if same:
                p, q = p[p < q], q[p < q]
            np.add.at(count, p, copies[q])
            np.add.at(count, q, copies[p])
            while True:   # both ends of each link to the lesser root, and roots to their roots
                low = np.minimum(root[p], root[q])
                before = root.copy()
                np.minimum.at(root, root[p], low)
                np.minimum.at(root, root[q], low)
                root = np.minimum(root, root[root])
                if (root == before).all():
                    break
        hit = np.flatnonzero(count)
        return pa.table({"node": node[hit], "n": count[hit], "root": node[root[hit]]})
    return task


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """Links vectors (``vec_id, embedding, label``) of one label with a cosine of ``threshold`` or more.

    Returns ``vec_id, n_links, component_id, kept``, a row per row of ``vectors``.  Null labels, and vectors that
    are null, empty, zero or hold null or non-finite components, link with nothing; so do vectors of different
    sizes.  Rows that repeat an id are vectors of their own.  ``component_id`` is the least id that is not null.
    Other columns are ignored.
    """
    ready(vectors)
    good = (F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    rows = materialise(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                                      F.col("embedding").cast("array<double>").alias("embedding"))
                       .withColumns({"good": F.coalesce(good, F.lit(False)), "size": F.size("embedding"), "row": F.monotonically_increasing_id(),
                                     "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    # Equal vectors share a label, a size and a hash of 128 bits; beyond that everything goes by the number of one row of them.
    same = ["label", "size", "h1", "h2"]
    nodes = materialise(rows.where("good").groupBy(*same).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("row").alias("node")), "nodes")
    whole = rows.select(F.col("row").alias("node"), "embedding")
    coded = materialise(nodes.select("label", "size", "node", "copies").join(whole, "node").select("label", "size", "node", "copies", "embedding")
                        .mapInArrow(_encode, CODED), "codes")
    sizes = nodes.groupBy("label", "size").agg(F.count("*").alias("n")).where("n > 1")
    block = F.least(F.greatest(F.lit(bucket), F.least(F.lit(LARGEST * bucket), F.ceil(F.col("n") / 16))),
                    F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.col("size")))))
    cuts = materialise(sizes.select("label", "size", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "blocks")
    own = coded.join(cuts, ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    code = ["bits", "halves", "low", "step", "lost", "factor"]
    tasks = own.select("label", "size", "node", *code, F.explode(F.expr(
        "transform(sequence(0, blocks - 1), o -> named_struct('i', least(own, o), 'j', greatest(own, o), 'side', if(own <= o, 0, 1)))")).alias("t"))
    left = materialise(tasks.select("label", "size", "t.*", "node", *code).groupBy(*TASK)
                       .applyInArrow(_open(threshold), "label string, size int, i int, j int, side int, node long"), "open")
    found = materialise(left.join(coded.select("node", "copies", *code), "node").join(whole, "node")
                        .select(*TASK, "side", "node", "copies", *code, "embedding")
                        .groupBy(*TASK).applyInArrow(_compare(threshold), "node long, n long, root long"), "links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # A forest's own roots are in ``found`` as well: each has a link.
    named = nodes.join(counted, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named.select(*same, "copies", "least", "root", F.coalesce("n", F.lit(0)).alias("n")), "named")
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    result = materialise(named.join(least, "root").select(*same, (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "result")
    linked = rows.where("good").select("vec_id", *same).join(result, same).select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
