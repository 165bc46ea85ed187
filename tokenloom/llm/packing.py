"""Pattern packing by non-negative least squares.

Pieces are numbered within their length, so only the histogram of lengths is planned: 2,048 numbers, whatever
the input.  Patterns are one to three lengths that fill a sequence; how often each is repeated is fitted to the
histogram by least squares without negative values (coordinate descent, longest pattern first), rounded down
and held to what is there.  What the rounding leaves is packed by best fit, longest first, on counts.  The plan is
a list of ranges of piece numbers, which each piece looks up.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ARROW_ROWS, keyed_texts, numbered, ready

LIMIT = 2048
SWEEPS = 3       # of the coordinate descent
END = 0          # id after each document
RUN = 1 << 16    # blanks on end that tiktoken is trusted with, twice over; it panics between 500,000 and 1,000,000


def patterns(present: list[int], limit: int) -> list[tuple[int, ...]]:
    """One to three present lengths that fill ``limit``, longest first length first, fewest first."""
    have = set(present)
    out: list[tuple[int, ...]] = []
    for a in sorted(present, reverse=True):
        rest = limit - a
        if rest == 0:
            out.append((a,))
            continue
        if rest in have and rest <= a:
            out.append((a, rest))
        out += [(a, b, rest - b) for b in present if rest - b <= b <= a and rest - b in have]
    return out


def fit(counts: dict[int, int], found: list[tuple[int, ...]]) -> list[float]:
    """Repeats ``x >= 0`` of the patterns that bring ``sum(x * lengths in pattern)`` close to the counts.

    Minimises the squared differences by coordinate descent: each step is exact for one pattern.
    """
    left = {k: float(v) for k, v in counts.items()}
    x = [0.0] * len(found)
    for _ in range(SWEEPS):
        for j, p in enumerate(found):
            # A pattern may hold a length twice; its column then has a 2.
            norm = sum(p.count(k) for k in p)
            new = max(0.0, x[j] + sum(left[k] for k in p) / norm)
            if (change := new - x[j]):
                for k in p:
                    left[k] -= change
                x[j] = new
    return x


class Plan:
    """Which place a piece gets: ranges of numbers within a length, with sequence and offset of the first."""

    def __init__(self, limit: int):
        self.limit, self.sequences, self.used = limit, 0, {}
        self.rows: list[tuple[int, int, int, int]] = []   # length, first number, first sequence, offset

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.rows.append((length, at, sequence, offset))
        self.used[length] = at + n

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 4)
        return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def plan(counts: dict[int, int], limit: int = LIMIT) -> Plan:
    out, left = Plan(limit), dict(counts)
    found = patterns(sorted(counts), limit)
    for p, x in zip(found, fit(counts, found)):
        n = min([int(x + 1e-6), *(left[k] // p.count(k) for k in p)])
        if n <= 0:
            continue
        offset = 0
        for k in p:
            out.put(k, n, out.sequences, offset)
            left[k] -= n
            offset += k
        out.sequences += n
    # Best fit on counts: the open sequences with the least room that is enough.
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}   # room -> (first sequence, number)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                # As many new sequences as fill up with this length alone.
                each = limit // k
                new = n // each or 1
                first, take = out.sequences, min(n, each)
                out.sequences += new
                for e in range(take):
                    out.put(k, new, first, e * k)
                n -= take * new
                room, group = limit - take * k, (first, new)
            else:
                room = rooms[i]
                first, have = open_[room].pop()
                new = min(have, n)
                if have > new:
                    open_[room].append((first + new, have - new))
                if not open_[room]:
                    del open_[room], rooms[i]
                out.put(k, new, first, limit - room)
                n -= new
                room, group = room - k, (first, new)
            if room:
                if room not in open_:
                    insort(rooms, room)
                    open_[room] = []
                open_[room].append(group)
    return out


def _long_run(text: str) -> bool:
    """Whether ``text`` may hold ``RUN`` blanks on end; those that pass hold fewer than ``2 * RUN``."""
    return len(text) >= RUN and any(text[a:a + RUN].isspace() for a in range(0, len(text), RUN))


def _encoder(path: str, ranks_path: str | None):
    """Texts to ids by the vocabulary at ``path``.

    The same vocabulary as ranks, where it is given, is encoded by tiktoken, which returns the same ids
    about four times as fast; its pattern is the one of byte-level BPE.  It keeps a state for each blank of a
    run and panics at a million, so texts with a very long run go through tokenizers.
    """
    @lru_cache(maxsize=1)
    def tokenizer():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    if ranks_path:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: (tokenizer().encode(t, add_special_tokens=False).ids if _long_run(t) else coder.encode_ordinary(t)
                              for t in texts)
    return lambda texts: (e.ids for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False))


def _pieces(path: str, ranks_path: str | None, limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path, ranks_path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, found in zip(ids, encode(batch.column("text").to_pylist())):
                tokens = np.append(np.asarray(found, dtype="<u4"), np.uint32(END)).astype("<u4")
                n = -(-len(tokens) // limit)
                first = len(tokens) - limit * (n - 1)
                cuts = [0, *(first + limit * i for i in range(n))]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    out["doc_id"].append(doc)
                    out["piece"].append(i)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(tokens[a:b].tobytes()))
            yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                                   *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]], names=list(out))
    return task


def _placed(table):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, number, sequence, offset = table.value
        span = int(number.max(initial=0)) + 1
        for batch in batches:
            own, at = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            # Python integers would be exact beyond 2^63; lengths are below 2^20 and numbers below 2^43.
            i = np.searchsorted(length * span + number, own * span + np.minimum(at, span - 1), "right") - 1
            i = np.where(at >= span, np.searchsorted(length, own, "right") - 1, i)
            yield pa.record_batch([
                *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                pa.array(sequence[i] + at - number[i]), pa.array(offset[i])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return task


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Packs the ids of all texts into sequences of at most ``limit`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece.  A document is
    its ids and the id 0; one that is longer than ``limit`` is cut, the first piece being the shorter.  Null and
    empty texts are the id 0 alone.  Rows that repeat an id are documents of their own; other columns are ignored.
    """
    spark = ready(docs)
    pieces = keyed_texts(docs).select("doc_id", "text").mapInArrow(
        _pieces(path, ranks_path, limit), "doc_id long, piece int, start long, length long, ids_crc32 long")
    ranked = numbered(pieces, "length", "number", "pieces")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan(counts, limit).arrays())
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
