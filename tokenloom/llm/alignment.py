"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the ids that end together.

Both tokenizers cut the same bytes, so a token is a range of them.  The ends of both are ascending arrays, and where
they hold the same number both tokens end.  Most tokens stand one to one, so equal stretches lie on a diagonal: at
the current shift between the two indices, stretches of 4, 8, 16, ... ends are compared at once, and one that is equal is
jumped.  Behind its break the smaller end moves on until both are equal again: an irregular group, after which the
shift is another.

Two tokens that end together are bytes of which one ends the other.  So the pairs that can occur follow from the two
vocabularies: a token has fewer suffixes than bytes, and a vocabulary few ids of the same bytes.  This bounds the table
of pair counts, whatever the corpus, and its size is checked before it is broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, ready
from tokenloom.llm.packing import _encoder
from tokenloom.session import materialise

PAIRS = 4 << 20      # pairs that the vocabularies allow, at most: 64 MB of ids and counts
OUT = 8 << 20        # bytes of links after which an Arrow batch is passed on
TABLE = 1 << 21      # links counted at once
PROBE = 4            # ends of the first stretch that is compared along a diagonal


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the
    others for the characters from 256 on, in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; an added token is its text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    known = byte_level()
    table = {i: bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t, i in model["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a blank, ``<0xHH>`` the byte HH."""
    model = _pieces(path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All ``a id << 32 | b id`` of which the bytes of one end the other's, ascending."""
    def endings(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    whole_a, whole_b = endings(a), endings(b)
    found = [x << 32 | y for x, t in enumerate(a) for k in range(len(t)) for y in whole_b.get(t[k:], ())]
    found += [x << 32 | y for y, t in enumerate(b) for k in range(1, len(t)) for x in whole_a.get(t[k:], ())]
    return np.array(sorted(found), dtype=np.int64)


def common_runs(a: list[int], b: list[int]) -> list[int]:
    """Runs ``i, j, k`` of ends that both ascending lists hold one to one, one after the other, by skipping along diagonals.

    Both lists end with the same number.
    """
    runs, i, j, n, m = [], 0, 0, len(a), len(b)
    while i < n and j < m:
        # One to one: stretches of ends at this shift, each twice as long as the one before.
        x, y, k = i, j, PROBE
        while x + k <= n and y + k <= m and a[x:x + k] == b[y:y + k]:
            x, y, k = x + k, y + k, 2 * k
        # The stretch that broke, up to its break.
        while x < n and y < m and a[x] == b[y]:
            x, y = x + 1, y + 1
        if x > i:
            runs += (i, j, x - i)
        # An irregular group: its tokens up to the next end that both have.
        while x < n and y < m and a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        i, j = x, y
    return runs


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends that both ascending lists hold."""
    i, j, k = np.array(common_runs(a, b), dtype=np.int64).reshape(-1, 3).T
    within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(i, k) + within, np.repeat(j, k) + within


def group_text(a: list[str], b: list[str], left: np.ndarray, right: np.ndarray, linked: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, which ends at the given indices; ``linked`` are their last pairs as text."""
    i, j = np.append(-1, left[:-1]) + 1, np.append(-1, right[:-1]) + 1   # where groups begin
    odd = np.flatnonzero((i != left) | (j != right))
    for g, p, q, r, s in zip(*(x.tolist() for x in (odd, i[odd], left[odd] + 1, j[odd], right[odd] + 1))):
        linked[g] = f"{','.join(a[p:q])}|{','.join(b[r:s])}"
    return ";".join(linked)


class PairTable:
    """Places of pairs in their ascending table: one look at a hash slot, and a search for the few that share one."""

    BITS = 21

    def __init__(self, pairs: np.ndarray):
        self.pairs, self.slots = pairs, np.zeros(1 << self.BITS, dtype=np.int32)
        self.slots[self._slot(pairs)] = np.arange(len(pairs), dtype=np.int32)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def places(self, pair: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(pair)]
        shared = np.flatnonzero(self.pairs[at] != pair)
        at[shared] = np.searchsorted(self.pairs, pair[shared])
        return at


class _Aligner:
    """Ids of a text by both tokenizers, and the groups in which their ends meet."""

    def __init__(self, byte_path: str, piece_path: str, ranks_path: str | None, pairs: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encode = _encoder(byte_path, ranks_path)
        self.model = _pieces(piece_path)
        self.bytes_a, self.bytes_b = byte_tokens(byte_path), piece_tokens(piece_path)
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        # Byte-pair merging by ranks gives its bytes back, so a length that is right is a text that is right.
        self.lossless = ranks_path is not None
        self.pairs = PairTable(pairs)
        self.names = [f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()]

    def align(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """Numbers of tokens, digest of the groups and the linked pairs, as places in the table; None without tokens."""
        if not text:
            return None
        given = " " + text
        whole = given.encode()
        a, b = list(next(iter(self.encode([given])))), self.model.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        if not self.lossless and b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        ids_a, ids_b = np.fromiter(a, np.int32, len(a)), np.fromiter(b, np.int32, len(b))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        if ends_a[-1] != len(whole):
            return None
        left, right = common_ends(ends_a.tolist(), ends_b.tolist())
        links = self.pairs.places(ids_a[left].astype(np.int64) << 32 | ids_b[right])
        groups = group_text(list(map(self.name_a.__getitem__, a)), list(map(self.name_b.__getitem__, b)), left, right,
                            list(map(self.names.__getitem__, links.tolist())))
        return len(a), len(b), hashlib.sha256(groups.encode()).hexdigest(), links


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"


def _align(pairs, byte_path: str, piece_path: str, ranks_path: str | None):
    def rows_of(out: dict) -> pa.RecordBatch:
        ends = np.append(0, np.cumsum([len(x) for x in out["links"]])).astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out["links"]])))
        return pa.record_batch([*[pa.array(out[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")],
                                pa.array(out["groups_sha256"], pa.string()), links], names=list(out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(byte_path, piece_path, ranks_path, pairs.value)
        gc.freeze()   # its tables live as long as the task; collections need not walk them
        new = lambda: {c: [] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")}
        for batch in batches:
            out, held = new(), 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = aligner.align(text.as_py())
                n_a, n_b, digest, links = found or (0, 0, "", np.zeros(0, np.int32))
                for c, v in zip(out, (doc, n_a, n_b, len(links), digest, links)):
                    out[c].append(v)
                held += links.nbytes
                if held >= OUT:
                    yield rows_of(out)
                    out, held = new(), 0
            yield rows_of(out)
    return task


def _count(size: int):
    """How often each pair is linked in a task's rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            links = batch.column("links").flatten().to_numpy()
            for k in range(0, len(links), TABLE):
                counts += np.bincount(links[k:k + TABLE], minlength=size)
        pair = np.flatnonzero(counts)
        yield pa.record_batch({"pair": pa.array(pair.astype(np.int32)), "n": pa.array(counts[pair])})
    return task


def _judge(table):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = table.value
        for batch in batches:
            links = batch.column("links").combine_chunks() if isinstance(batch.column("links"), pa.ChunkedArray) else batch.column("links")
            ends = links.offsets.to_numpy() - links.offsets[0].as_py()
            own = links.flatten().to_numpy()
            sums = lambda v: np.diff(np.append(0, np.cumsum(v, dtype=np.int64))[ends])
            yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], batch.column("n_groups"),
                                   pa.array(sums(best[own])), pa.array(sums(counts[own])), batch.column("groups_sha256")],
                                  names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return task


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None) -> tuple[DataFrame, Callable[[], np.ndarray]]:
    """Stored alignment of every text: numbers of tokens, groups, their digest and the linked pairs as places in the table of pairs.

    Returns it with a function that gives that table, ``a id << 32 | b id``.  A text is read with a blank before it.
    """
    spark = ready(docs)
    pairs = possible_pairs(byte_tokens(byte_path), piece_tokens(piece_path))
    if len(pairs) > PAIRS:
        raise ValueError(f"the vocabularies allow {len(pairs)} pairs, more than {PAIRS}")
    shared = spark.sparkContext.broadcast(pairs)
    aligned = keyed_texts(docs).select("doc_id", "text").mapInArrow(_align(shared, byte_path, piece_path, ranks_path), ALIGNED)
    return materialise(aligned, "aligned"), lambda: pairs


def compare_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None) -> DataFrame:
    """How a byte-level (A) and a piece (B) vocabulary cut each text, and how common the pairs of ids are that end together.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row per row of ``docs``.  Tokens
    are never empty, so the tokens that end at a byte are one of each and a group has one link, that of its last tokens.
    ``count_sum`` adds up how many links of the corpus hold the pair of each link; a link is among ``n_best`` if its pair
    is the most frequent one of its B id, or ties with it.  Texts that are null, empty or not given back byte for byte by
    both tokenizers have no tokens: zeros and ''.  Rows that repeat an id are texts of their own; other columns are ignored.
    """
    aligned, pairs = align_documents(docs, byte_path, piece_path, ranks_path)
    size = len(pairs())
    counts, best = np.zeros(size, dtype=np.int64), np.zeros(len(piece_tokens(piece_path)), dtype=np.int64)
    # At most a row for each possible pair.
    found = aligned.select("links").mapInArrow(_count(size), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    piece = pairs() & 0xFFFFFFFF
    np.maximum.at(best, piece, counts)
    table = docs.sparkSession.sparkContext.broadcast((counts, counts == best[piece]))
    return aligned.mapInArrow(_judge(table), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
