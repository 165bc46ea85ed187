"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams in hashed buckets, and of word pairs that repeat a word, by number
and by share of the words.  Each is scaled by the log-count ratio of the two
classes, counted over all labelled training rows; a linear hinge-loss model is fitted to the scaled,
length-normalised rows by dual coordinate descent, on a sample of them that is bounded in rows and in features.
A logistic curve fitted to margins of sample rows that the model did not see turns a margin into a score.
The sample goes to one task, which holds it as one flat array; only counts and weights reach the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, ready
from tokenloom.llm.words import FOLDED, chunks, string_parts, words_of
from tokenloom.session import materialise

BITS = 16
GRAMS = (2, 3)
REPEATS = (1, 2, 4, 8, 16, 32)              # word pairs "x x" of a text, at least
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)   # of its words, at least
SIZE = (1 << BITS) + len(REPEATS) + len(SHARES)
WIDTH = BITS + 1   # bits of a bucket's number
SHORT = 0.2        # of the mean squared norm, added to each: short texts lean to the bias
SAMPLE = 8192      # labelled rows the hinge-loss model is fitted to, at most,
HELD = 1 << 24     # and features of these rows: 64 MB
EPOCHS = 8
COST = 1.0
SMOOTHING = 1.0
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk: first row, rows, and the distinct ``(row, bucket)`` in order of rows."""
    data, bounds = string_parts(column)
    for (i, j), words in zip(chunks(bounds), words_of(column, FOLDED)):
        raw, own = data[bounds[i]:bounds[j]].astype(np.uint32), bounds[i:j + 1] - bounds[i]
        size = np.diff(own)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), size)
        left = np.repeat(own[1:], size) - np.arange(len(raw))
        keys = []
        for n in GRAMS:
            m = len(raw) - n + 1
            if m <= 0:
                continue
            gram = np.full(m, n, dtype=np.uint32)
            for k in range(n):
                gram = gram * np.uint32(0x01000193) ^ raw[k:k + m]
            bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            keys.append((row[:m] << np.uint64(WIDTH) | bucket)[left[:m] >= n])
        twice = words.row[:-1][words.within(2) & (words.hash[1:] == words.hash[:-1])] if len(words.row) > 1 else words.row[:0]
        number = np.bincount(twice, minlength=j - i)
        share = number / np.maximum(words.counts, 1)
        for k, held in enumerate([number >= c for c in REPEATS] + [share >= c for c in SHARES]):
            keys.append(np.flatnonzero(held).astype(np.uint64) << np.uint64(WIDTH) | np.uint64((1 << BITS) + k))
        key = np.sort(np.concatenate(keys or [np.zeros(0, np.uint64)]))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        yield i, j - i, (key >> np.uint64(WIDTH)).astype(np.int64), (key & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def _learn(share: float):
    """Counts of the features in each class, and the rows of the sample."""
    cut = int(share * 2**32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), dtype=np.int64)
        names = ["bucket", "bad", "good", "h", "label", "row"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            label, h = batch.column("label").to_numpy(), batch.column("h").to_numpy()
            out = {"h": [], "label": [], "row": []}
            for first, rows, row, bucket in features(batch.column("text")):
                for y in (0, 1):
                    counts[y] += np.bincount(bucket[label[first + row] == y], minlength=SIZE)
                cuts = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    if h[first + r] < cut:
                        out["h"].append(int(h[first + r]))
                        out["label"].append(int(label[first + r]))
                        out["row"].append(bucket[cuts[r]:cuts[r + 1]].astype("<u4").tobytes())
            if out["h"]:
                none = pa.nulls(len(out["h"]))
                yield pa.record_batch([none.cast(types[0]), none.cast(types[1]), none.cast(types[2]),
                                       *[pa.array(out[c], t) for c, t in zip(names[3:], types[3:])]], names=names)
        used = np.flatnonzero(counts.any(axis=0))
        none = pa.nulls(len(used))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[0][used]), pa.array(counts[1][used]),
                               *[none.cast(t) for t in types[3:]]], names=names)
    return task


@dataclass
class Sample:
    """Rows of distinct buckets as one flat array; values are looked up in the ratios when they are needed."""

    label: np.ndarray    # of each row, 0 or 1
    bounds: np.ndarray   # where rows begin in ``bucket``, and the end
    bucket: np.ndarray   # int32

    def row(self, i: int) -> np.ndarray:
        return self.bucket[self.bounds[i]:self.bounds[i + 1]]


def descend(sample: Sample, rows: np.ndarray, ratio: np.ndarray, norm: np.ndarray, cost: np.ndarray, epochs: int) -> np.ndarray:
    """Weights of the L1-loss support vector machine by dual coordinate descent; the last weight is the bias.

    Row ``i`` has the value ``ratio[b] / norm[i]`` in each of its buckets ``b``.
    """
    w, alpha, bias = np.zeros(len(ratio)), np.zeros(len(norm)), 0.0
    y, diagonal = np.where(sample.label == 1, 1.0, -1.0), np.zeros(len(norm))
    for i in rows:
        value = ratio[sample.row(i)] / norm[i]
        diagonal[i] = float(value @ value) + 1.0
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in rows[order.permutation(len(rows))]:
            own = sample.row(i)
            value = ratio[own] / norm[i]
            gradient = y[i] * (w[own] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[own] += step * value
                bias += step
                alpha[i] = new
    return np.append(w, bias)


@dataclass
class Model:
    ratio: np.ndarray    # log-count ratio of each bucket
    weight: np.ndarray   # of each scaled bucket
    bias: float
    floor: float         # added to each squared norm
    slope: float         # of the logistic curve over margins
    shift: float

    def margins(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        r = self.ratio[bucket]
        norm = np.sqrt(np.bincount(row, r * r, rows) + self.floor)
        return np.bincount(row, self.weight[bucket] * r, rows) / norm + self.bias

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def log_count_ratio(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    p, q = SMOOTHING + good, SMOOTHING + bad
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(ratio: np.ndarray, sample: Sample) -> Model:
    """The model from the ratios of all training rows and a sample of them.

    With one class only, or none, every text gets the share of label 1 (1 without labels).
    """
    label = sample.label
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n1 or not n0:
        return Model(ratio, np.zeros(len(ratio)), 0.0, 1.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))) if len(label) else 40.0)
    square = np.array([float(ratio[b] @ ratio[b]) for b in map(sample.row, range(len(label)))])
    floor = SHORT * float(square.mean()) + 1e-12
    norm = np.sqrt(square + floor)
    cost = COST * len(label) / (2 * np.where(label == 1, n1, n0))
    apart = np.arange(len(label)) % 4 == 0
    if min(label[apart].sum(), (1 - label[apart]).sum(), label[~apart].sum(), (1 - label[~apart]).sum()) == 0:
        apart = np.zeros(len(label), dtype=bool)
    seen = np.flatnonzero(~apart)
    w = descend(sample, seen, ratio, norm, cost, EPOCHS)
    unseen = np.flatnonzero(apart) if apart.any() else seen
    margin = np.array([w[sample.row(i)] @ ratio[sample.row(i)] / norm[i] + w[-1] for i in unseen])
    slope, shift = logistic(margin, label[unseen] == 1)
    return Model(ratio, w[:-1], float(w[-1]), floor, slope, shift)


def _fit(ratio, held: int):
    """The model of the sample rows that come, in their order, as long as they have ``held`` features at most."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, sizes, parts, n = [], [], [], 0
        for batch in batches:
            for y, b in zip(batch.column("label").to_pylist(), batch.column("row")):
                own = np.frombuffer(b.as_buffer(), dtype="<i4").copy()
                n += len(own)
                if n > held:
                    break
                label.append(y)
                sizes.append(len(own))
                parts.append(own)
            if n > held:
                break
        bucket = np.concatenate(parts or [np.zeros(0, np.int32)])
        del parts
        model = fit(ratio.value, Sample(np.array(label, dtype=np.int64), np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int64), bucket))
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})
    return task


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD) -> Model:
    """Learns ``quality`` from rows outside the held-out fold.

    Labels that are neither 0 nor 1 are left out; of several labels of an id the more frequent holds, 0 on a
    tie.  All labelled rows are counted; the hinge-loss model sees at most ``sample`` of them, picked by hash, and
    of these the first that have ``held`` features together.
    """
    ready(docs)
    gold = (labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id").cast("bigint")))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("int").alias("label")))
    gold = materialise(gold, "labels")
    known = gold.count()
    texts = keyed_texts(docs).where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    # Sorted and shuffled at every size: labels grow with the corpus.
    rows = texts.join(gold.hint("merge"), "doc_id").select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2**32)).alias("h"))
    learned = materialise(rows.mapInArrow(_learn(min(1.0, sample / max(known, 1))),
                                          "bucket int, bad long, good long, h long, label int, row binary"), "features")
    table = learned.where("bucket is not null").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    bad, good = np.zeros(SIZE), np.zeros(SIZE)
    at = table.column("bucket").to_numpy()
    bad[at], good[at] = table.column("bad").to_numpy(), table.column("good").to_numpy()
    ratio = docs.sparkSession.sparkContext.broadcast(log_count_ratio(bad, good))
    picked = learned.where("bucket is null").orderBy("h", "label", "row").limit(sample).select("label", "row").coalesce(1)
    return pickle.loads(picked.mapInArrow(_fit(ratio, held), "model binary").first()["model"])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns ``keep``, a row per row of ``docs``.

    Only the text decides; null and empty texts have no features and get the score of a zero margin's bias.
    """
    spark = ready(docs)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *keep)
    schema = rows.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.full(batch.num_rows, shared.value.bias)
            for first, n, row, bucket in features(batch.column("__text")):
                margin[first:first + n] = shared.value.margins(n, row, bucket)
            score = shared.value.scores(margin)
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                  names=[*names, "score", "predicted"])

    return rows.mapInArrow(task, schema)


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with all their columns whose score reaches ``threshold``."""
    spark = ready(docs)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.full(batch.num_rows, shared.value.bias)
            for first, n, row, bucket in features(batch.column("text")):
                margin[first:first + n] = shared.value.margins(n, row, bucket)
            yield batch.filter(pa.array(shared.value.scores(margin) >= threshold))

    return docs.mapInArrow(task, docs.schema)
