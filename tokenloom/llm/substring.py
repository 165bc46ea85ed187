"""Substring dedup: suffix trees over groups of suffixes, cut apart by variable-length prefixes.

A suffix here is a document's text from some word on, cut after ``WINDOW`` words; two suffixes that
agree in all of them meet in an internal node of that depth, which makes their windows repeats.

1. Every suffix is filed under an *anchor* in its window: the start of the ``PREFIX`` words with
   the least hash.  Equal windows have equal anchors, and neighbouring suffixes mostly share one, so
   about 7 % as many rows as suffixes travel, one *segment* (an anchor with the suffixes filed there).
2. The prefix of a group is first these ``PREFIX`` words.  A prefix that occurs once is a leaf and is
   dropped: nothing there can repeat.  Equal segments are counted before their words are fetched.
3. A prefix with more than ``GROUP`` different segments doesn't fit in memory and is lengthened to the
   whole window, so each of its suffixes goes to a group of its own, a node of full depth.
4. Each remaining group is one task's subtree: suffixes are ranked by 1, 2, 4, ... words (prefix
   doubling over exact words) up to the window; ranks held by several suffixes are its deep nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, ready
from tokenloom.llm.words import PLAIN, STEP, mix, runs, span, words_of
from tokenloom.session import materialise

WINDOW = 35   # words of a repeat
PREFIX = 8    # words of a group's prefix
GROUP = 4096  # different segments of one group in a task's memory

SEGMENTS = "doc long, tag long, key long, seg long, at int, n int"


def segments(words, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Segments of some rows: first suffix, number of suffixes, key and hash.

    The anchor is the leftmost least hash among the prefixes inside the window.
    """
    width, n = window - prefix + 1, len(words.hash) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    gram = words.grams(prefix)
    best, where, size = gram, np.arange(len(gram)), 1

    def merge(shift: int):
        left, right = best[:-shift], best[shift:]
        keep = left <= right
        return np.where(keep, left, right), np.where(keep, where[:-shift], where[shift:])

    while 2 * size <= width:
        best, where = merge(size)
        size *= 2
    if size < width:
        best, where = merge(width - size)
    inside = words.within(window)
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (where[1:] == where[:-1]))
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    anchor = where[first]
    whole = span(runs(words.hash, STEP), first, last + window, STEP)
    whole = mix(whole ^ mix((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return first, last - first + 1, gram[anchor], whole


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _scan(window: int, prefix: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for words in words_of(batch.column("text"), PLAIN):
                first, n, key, whole = segments(words, window, prefix)
                row = words.row[first] if len(first) else first
                starts = np.searchsorted(words.row, np.arange(words.rows))
                yield pa.record_batch({
                    "doc": pa.array(doc[words.first + row]), "tag": pa.array(tag[words.first + row]), "key": _signed(key),
                    "seg": _signed(whole), "at": pa.array((first - starts[row]).astype(np.int32)),
                    "n": pa.array(n.astype(np.int32))})
    return task


def _count_keys(window: int, prefix: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(w, window, prefix)[2] for w in words_of(batch.column("text"), PLAIN)]
            key, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch({"key": _signed(key), "c": pa.array(n.astype(np.int64))})
    return task


def _fetch(window: int):
    """Words of the wanted segments of each document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "seg": [], "copies": [], "words": [], "n": []}
            wanted = batch.column("wanted").to_pylist()
            for words in words_of(batch.column("text"), PLAIN):
                starts = np.searchsorted(words.row, np.arange(words.rows))
                for r in range(words.rows):
                    for w in wanted[words.first + r]:
                        i = starts[r] + w["at"]
                        out["key"].append(w["key"])
                        out["seg"].append(w["seg"])
                        out["copies"].append(w["copies"])
                        out["n"].append(w["n"])
                        out["words"].append(words.bytes_of(i, i + w["n"] + window - 1))
            yield pa.record_batch([pa.array(out["key"], pa.int64()), pa.array(out["seg"], pa.int64()), pa.array(out["copies"], pa.int64()),
                                   pa.array(out["words"], pa.binary()), pa.array(out["n"], pa.int32())], names=list(out))
    return task


def deep_nodes(groups: np.ndarray, texts: list[bytes], sizes: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """For each segment the bits of its suffixes that share a node of depth ``window`` in their group's tree.

    Prefix doubling: names of 2k words from two names of k words; equal names are equal words.
    """
    lists = [t.split() for t in texts]
    length = np.array([len(x) for x in lists])
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(w, len(names)) for x in lists for w in x], dtype=np.int64)
    start = np.cumsum(length) - length
    segment = np.repeat(np.arange(len(texts)), sizes)
    suffix = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = start[segment] + suffix

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    size = 1
    while 2 * size <= window:
        name, size = paired(name[:-size], name[size:]), 2 * size
    if size < window:
        name = paired(name[:size - window], name[window - size:])
    node = paired(groups[segment], name[place])
    leaves = np.bincount(node, weights=copies[segment])
    shared = leaves[node] >= 2
    bits = np.zeros(len(texts), dtype=np.int64)
    np.bitwise_or.at(bits, segment[shared], np.int64(1) << suffix[shared])
    return bits


def _subtrees(window: int):
    """Trees of the groups of one task, which come sorted; the last group of a batch waits for its rest."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            key = table.column("key").to_numpy()
            group = np.unique(key, return_inverse=True)[1]
            bits = deep_nodes(group, table.column("words").to_pylist(), table.column("n").to_numpy(),
                              table.column("copies").to_numpy(), window)
            return pa.record_batch({"key": pa.array(key), "seg": pa.array(table.column("seg").to_numpy()), "bits": pa.array(bits)})

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            key = rest.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if cut > 2000:
                yield solve(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield solve(rest)
    return task


def _suffixes(window: int):
    """Each suffix of a segment under its longest prefix, the whole window."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("words").cast(pa.string()), PLAIN):
                first = np.flatnonzero(words.within(window))
                row = words.first + words.row[first]
                starts = np.searchsorted(words.row, np.arange(words.rows))
                take = lambda c: batch.column(c).to_numpy()[row]
                other = span(runs(mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)), STEP), first, first + window, STEP)
                yield pa.record_batch({
                    "key": pa.array(take("key")), "seg": pa.array(take("seg")), "copies": pa.array(take("copies")),
                    "bit": pa.array((first - starts[words.row[first]]).astype(np.int32)),
                    "h1": _signed(words.grams(window)[first]), "h2": _signed(other)})
    return task


def _remove(window: int):
    """Counts and the hash of what stays."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            gone, digest, kept_text = total.copy(), [""] * batch.num_rows, [""] * batch.num_rows
            marks = batch.column("marks").to_pylist()
            for words in words_of(batch.column("text"), PLAIN):
                bounds = np.searchsorted(words.row, np.arange(words.rows + 1))
                total[words.first:words.first + words.rows] = words.counts
                for r in range(words.rows):
                    a, b = bounds[r], bounds[r + 1]
                    cover = np.zeros(b - a + 1, np.int64)
                    for m in marks[words.first + r] or ():
                        bits, i = m["bits"], m["at"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            cover[i + low] += 1
                            cover[i + low + window] -= 1
                            bits &= bits - 1
                    stay = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                    tokens = words.data[words.start[a]:words.end[b - 1]].tobytes().split() if b > a else []
                    kept = b" ".join(tokens if len(stay) == b - a else [tokens[i] for i in stay])
                    gone[words.first + r] = b - a - len(stay)
                    digest[words.first + r] = hashlib.sha256(kept).hexdigest()
                    kept_text[words.first + r] = kept.decode()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total), "n_removed": pa.array(gone),
                                   "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept_text, pa.string())})
    return task


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``(doc, tag, at, bits)``: bit b set means that the window at word ``at + b`` also starts elsewhere."""
    if window - prefix > 62:
        raise ValueError("a segment's suffixes must fit 63 bits")
    ready(docs)
    keyed = keyed_texts(docs)
    text = keyed.select("text")
    shared = materialise(text.mapInArrow(_count_keys(window, prefix), "key long, c long").groupBy("key")
                         .agg(F.sum("c").alias("c")).where("c > 1").select("key"), "prefixes")
    places = materialise(keyed.select("doc", "tag", "text").mapInArrow(_scan(window, prefix), SEGMENTS)
                         .join(shared, "key"), "segments")
    # One row for each different segment, with one place to read it from.
    unique = materialise(places.groupBy("key", "seg").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "tag", "at", "n")).alias("p")), "unique")
    sizes = materialise(unique.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"), "sizes")
    alone = (unique.where("copies > 1").join(sizes, "key", "left_anti")
             .select("key", "seg", F.expr("shiftleft(1L, p.n) - 1L").alias("bits")))
    wanted = (unique.join(sizes, "key").groupBy(F.col("p.doc").alias("doc"), F.col("p.tag").alias("tag"))
              .agg(F.collect_list(F.struct("key", "seg", "copies", F.col("p.at").alias("at"), F.col("p.n").alias("n"))).alias("wanted")))
    # Rows that repeat a document give the same words again; one of them is enough.
    read = materialise(keyed.select("doc", "tag", "text").join(wanted, ["doc", "tag"]).select("text", "wanted")
                       .mapInArrow(_fetch(window), "key long, seg long, copies long, words binary, n int")
                       .join(sizes, "key"), "words")
    small = (read.where(F.col("different") <= group).drop("different").dropDuplicates(["key", "seg"])
             .repartition("key").sortWithinPartitions("key")
             .mapInArrow(_subtrees(window), "key long, seg long, bits long"))
    leaves = (read.where(F.col("different") > group).select("key", "seg", "copies", "words")
              .mapInArrow(_suffixes(window), "key long, seg long, copies long, bit int, h1 long, h2 long")
              .dropDuplicates(["key", "seg", "bit"]))
    leaves = materialise(leaves, "leaves")
    nodes = materialise(leaves.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).where("c > 1").drop("c"), "nodes")
    large = (leaves.join(nodes, ["h1", "h2"]).groupBy("key", "seg")
             .agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("bits")))
    bits = materialise(alone.union(small).union(large).where("bits <> 0"), "bits")
    return places.join(bits, ["key", "seg"]).select("doc", "tag", "at", "bits")


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Removes every word that a repeated window covers; windows are judged on the text as given.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept``, one row per row of ``docs``.  A null or
    empty text has no words; rows with a null id are documents like any other; equal rows repeat
    each other, so all their windows go, first occurrence included.  Other columns are ignored.
    """
    marks = (repeated_windows(docs, window, prefix, group).groupBy("doc", "tag")
             .agg(F.collect_set(F.struct("at", "bits")).alias("marks")))
    joined = keyed_texts(docs).join(marks, ["doc", "tag"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
