"""Source divergence audit: how far the sources of a language are from each other, and the terms that set one apart.

Terms are counted by length-bucketed packing.  A term of up to 8 bytes is one uint64, of up to 16 bytes two, so that
order of numbers is order of bytes; they are sorted by a radix sort on 16-bit digits and counted as runs.  Longer
terms go to buckets of twice the width of the one before and are sorted as bytes.  The sort is stable and terms
come in order of documents, so a run also tells in how many documents its term stands.  A task passes on a row
for each term of a source, and the rows of a term meet once, in one shuffle.

Shares are integers of a thousand millionth.  The distances of all pairs of sources are taken from matrices of
sources by terms: a task has two tiles of ``TILE`` sources and about ``TERMS`` terms of a language and returns,
for each pair, what its terms add beyond the distance of a term that neither source holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import ready
from tokenloom.llm.words import chunks, string_parts
from tokenloom.session import materialise

DOCUMENTS = 3         # of a language that hold a term, at least
RANKS = 200           # of the terms of a source
HELD = 1 << 22        # terms, and bytes of long ones, that a task counts at once
ROWS = 1 << 16        # of one Arrow batch of counts
TILE, TERMS = 256, 2048
ONE = 1_000_000_000

#: Bytes of a term in lower case (ASCII letters and all of non-ASCII characters); 0 elsewhere.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 0x7F else 0 for b in range(256)], dtype=np.uint8)
#: The first k bytes of a word.
MASKS = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], dtype=np.uint64)


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: its first row, row, start and length of each term, and the folded bytes with 16 more behind."""
    data, bounds = string_parts(column)
    for i, j in chunks(bounds):
        own, n = bounds[i:j + 1] - bounds[i], int(bounds[j] - bounds[i])
        folded = np.zeros(n + 16, dtype=np.uint8)
        folded[:n] = LETTERS[data[bounds[i]:bounds[j]]]
        inside = folded[:n] != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # A row's first and last bytes touch no other row.
        edge = own[:-1][own[:-1] < own[1:]]
        first[edge] = inside[edge]
        edge = own[1:][own[:-1] < own[1:]] - 1
        last[edge] = inside[edge]
        start = np.flatnonzero(first)
        yield i, np.searchsorted(own[1:], start, "right"), start, np.flatnonzero(last) + 1 - start, folded


def packed(folded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each term, fewer where it is shorter, as one number whose order is that of the bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(folded, 8)[np.minimum(start, len(folded) - 8)]
    return eight.view(">u8").ravel().astype(np.uint64) & MASKS[np.clip(length, 0, 8)]


def wide(folded: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Terms as byte strings of one width, filled up with zeros."""
    at = np.arange(width)
    out = folded[np.minimum(start[:, None] + at, len(folded) - 1)]
    out[at >= length[:, None]] = 0
    return out.view(f"S{width}").ravel()


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned keys, the first the most significant: one pass for each 16-bit digit that varies."""
    order = None
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if (digit == digit[0]).all():
                continue
            # numpy sorts 16-bit numbers by radix.
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys[0])) if order is None else order


def run_counts(code: np.ndarray, doc: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Group, key, occurrences and documents of every run of equal (group, key); ``doc`` is ascending."""
    if keys[0].dtype.kind == "S":
        order = np.argsort(keys[0], kind="stable")
        order = order[radix_order([code[order]])]
    else:
        order = radix_order([code, *keys])
    code, doc, keys = code[order], doc[order], [k[order] for k in keys]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return code[first], [k[first] for k in keys], np.diff(np.append(first, len(code))), np.add.reduceat(fresh.astype(np.int64), first)


def _strings(keys: list[np.ndarray]) -> pa.Array:
    """The terms that keys stand for.  No term holds a zero byte, so all zeros are filling."""
    n = len(keys[0])
    if keys[0].dtype.kind == "S":
        raw = keys[0].view(np.uint8).reshape(n, -1)
    else:
        raw = np.stack(keys, axis=1).astype(">u8").view(np.uint8).reshape(n, -1)
    used = raw != 0
    offsets = np.append(0, np.cumsum(used.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[used])))


class _Counter:
    """Terms of some documents in their length buckets, until they are counted."""

    def __init__(self):
        self.codes: dict[tuple[str, str], int] = {}
        self.docs = self.held = 0
        self.buckets: dict[int, list[tuple]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        code = np.array([self.codes.setdefault(g, len(self.codes)) for g in groups], dtype=np.uint32)
        for i, row, start, length, folded in terms_of(batch.column("text")):
            row = row + i
            bucket = np.where(length <= 8, 1, 2)
            long = np.flatnonzero(length > 16)
            if len(long):
                # Twice the width from one bucket to the next, so filling at most doubles the bytes.
                bucket[long] = 1 << np.ceil(np.log2(length[long])).astype(np.int64)
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                s, n = start[at], length[at]
                keys = [wide(folded, s, n, b)] if b > 2 else [packed(folded, s + 8 * k, n - 8 * k) for k in range(b)]
                self.buckets.setdefault(b, []).append((code[row[at]], (row[at] + self.docs).astype(np.uint32), *keys))
                self.held += len(at) * (1 if b <= 2 else b)
        self.docs += batch.num_rows

    def counted(self) -> Iterator[pa.RecordBatch]:
        for parts in self.buckets.values():
            code, doc, *keys = (np.concatenate(p) for p in zip(*parts))
            code, keys, n, documents = run_counts(code, doc, keys)
            for a in range(0, len(code), ROWS):
                at = slice(a, a + ROWS)
                yield self._rows(code[at], _strings([k[at] for k in keys]), n[at], documents[at])
        self.buckets, self.held, self.docs = {}, 0, 0

    def groups(self) -> pa.RecordBatch:
        n = len(self.codes)
        return self._rows(np.arange(n), pa.array([""] * n, pa.string()), np.zeros(n, np.int64), np.zeros(n, np.int64))

    def _rows(self, code, term, n, documents) -> pa.RecordBatch:
        lang, source = (pa.array([g[k] for g in self.codes], pa.string()).take(pa.array(code)) for k in (0, 1))
        return pa.record_batch([lang, source, term, pa.array(n), pa.array(documents)], names=["lang", "source", "term", "n", "documents"])


def _count(held: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            counter.add(batch)
            if counter.held >= held:
                yield from counter.counted()
        yield from counter.counted()
        yield counter.groups()
    return task


def term_counts(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``lang, source, term, n`` and ``n_lang`` of every term that ``documents`` rows of its language hold, and a
    row with the term '' for each (lang, source).

    Null text, lang and source are ''.  Every row is a document, whatever its id; other columns are ignored.
    """
    ready(docs)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source")).mapInArrow(
        _count(HELD), "lang string, source string, term string, n long, documents long")
    # One shuffle for sums by source and by language; the rows of groups are spread by source.
    key = F.when(F.col("term") == "", F.col("source"))
    sums = (rows.withColumn("key", key).repartition("lang", "term", "key").groupBy("lang", "term", "key", "source")
            .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    all_ = Window.partitionBy("lang", "term", "key")
    totals = sums.withColumns({"n_lang": F.sum("n").over(all_), "held": F.sum("documents").over(all_)})
    return totals.where((F.col("term") == "") | (F.col("held") >= documents)).select("lang", "source", "term", "n", "n_lang")


def share(x: Column, whole: Column) -> Column:
    """``1 + floor(ONE * x / whole)`` for ``x <= whole``, by long division in steps of 1,000: exact up to 9e15."""
    out, rest = F.lit(0).cast("bigint"), x
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return out + 1


def shares(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` for arrays."""
    out, rest = np.zeros_like(x), x
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) ** 2 / q)``; shares are at most 1e9 + 1, so it stays below 2^63."""
    return (p - q) ** 2 // q


def _pairs(tile: int):
    """What the terms of a block add to the distance of every two sources of two tiles."""
    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        s, whole, x = (group.column(c).to_numpy() for c in ("s", "whole", "x"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        head = x == 0
        source, where = np.unique(s[head], return_index=True)
        whole = whole[head][where]
        term = group.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode()
        term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
        m = len(term.dictionary)
        none = shares(np.ones_like(whole), whole)
        p = np.repeat(none[:, None], m, axis=1)
        at = np.searchsorted(source, s[~head])
        p[at, term.indices.to_numpy()] = shares(x[~head] + 1, whole[at])
        left, right = np.flatnonzero(source // tile == i), np.flatnonzero(source // tile == j)
        a, b, value = [], [], []

        def add(k, l, found):
            a.append(k)
            b.append(l)
            value.append(found)

        for k in left:
            add(np.full(len(right), source[k]), source[right],
                distances(p[k], p[right]).sum(axis=1) - m * distances(none[k], none[right]))
            if i != j:
                add(source[right], np.full(len(right), source[k]),
                    distances(p[right], p[k]).sum(axis=1) - m * distances(none[right], none[k]))
        a, b, value = (np.concatenate(x) for x in (a, b, value))
        apart = a != b
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * int(apart.sum()), pa.string()),
                         "a": a[apart], "b": b[apart], "value": value[apart]})
    return task


def audit_sources(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Distances between the sources of each language, and the terms that a source holds more of than its language.

    Returns ``lang, source, part, item, value, rank``.  Of part ``pair`` is a row for every other source of the
    language: the sum over kept terms (``term_counts``) of ``floor((p - q)^2 / q)``, p the source's share of a term
    and q the other's, 0 without kept terms.  Of part ``term`` are the ``ranks`` terms of a source with the
    largest value against the language's share, among those whose share is larger there.  Shares are
    ``1 + floor(1e9 * (count + 1) / (counts of all kept terms + number of kept terms))``.  Ranks go by value, then by
    item in order of its bytes.  Null text, lang and source are ''; a table without rows gives none.
    """
    counts = materialise(term_counts(docs, documents), "terms")
    terms = counts.where("term <> ''")
    langs = terms.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("n").alias("all"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    numbers = Window.partitionBy("lang").orderBy("source")
    groups = (counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), (F.col("all") + F.col("kept")).alias("whole_lang"),
                      F.coalesce(F.coalesce("n", F.lit(0)) + F.col("kept"), F.lit(1).cast("bigint")).alias("whole"),
                      (F.row_number().over(numbers) - 1).cast("bigint").alias("s"), F.count("*").over(Window.partitionBy("lang")).alias("sources")))
    groups = materialise(groups, "sources")

    rows = terms.join(groups, ["lang", "source"])
    p, q = share(F.col("n") + 1, F.col("whole")), share(F.col("n_lang") + 1, F.col("whole_lang"))
    far = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")
    heads = groups.select("lang", "s", "whole", "sources", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("x"),
                          F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    cells = rows.select("lang", "s", "whole", "sources", "term", F.col("n").alias("x"), F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"))
    tasks = heads.union(cells).select("lang", "block", "s", "whole", "term", "x", F.explode(F.expr(
        f"transform(sequence(0L, (sources - 1) div {TILE}), o -> named_struct('i', least(s div {TILE}, o), 'j', greatest(s div {TILE}, o)))")).alias("t"))
    sums = (tasks.select("lang", "block", "t.i", "t.j", "s", "whole", "term", "x").groupBy("lang", "block", "i", "j")
            .applyInArrow(_pairs(TILE), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("more")))
    one, other = (groups.select("lang", F.col("s").alias(k), F.col("source").alias(name), share(F.lit(1).cast("bigint"), F.col("whole")).alias(f"none_{k}"),
                                *more) for k, name, more in (("a", "source", ["kept"]), ("b", "item", [])))
    none = F.call_function("div", (F.col("none_a") - F.col("none_b")) * (F.col("none_a") - F.col("none_b")), F.col("none_b"))
    pairs = sums.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("more") + F.col("kept") * none).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).union(top)
