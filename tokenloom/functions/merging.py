"""Merges over whole Arrow batches: distinct words as arrays of code points, a merge table as sorted arrays.

A token is the code point that stands for it in a token string (see ``functions/tokens.py``), a pair is
``left << 21 | right``, so that pairs sort like their token ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tokenloom.functions.tokens import DOWN_ID, UP_ID, token_char

SHIFT = 21
NONE = np.iinfo(np.int64).max


def pair_code(a: int, b: int) -> int:
    return ord(token_char(a)) << SHIFT | ord(token_char(b))


@dataclass
class MergeTable:
    """Pairs in ascending order, with the token each becomes; a lower token was learned earlier."""

    code: np.ndarray
    new: np.ndarray

    @staticmethod
    def of(merges: Iterable[tuple[int, int, int]]) -> MergeTable:
        rows = np.array([(pair_code(a, b), ord(token_char(i))) for a, b, i in merges], dtype=np.int64).reshape(-1, 2)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.append(True, rows[1:, 0] != rows[:-1, 0])[:len(rows)]
        return MergeTable(rows[first, 0], rows[first, 1])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the pairs become; ``NONE`` where there is no merge."""
        code = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.new[at], NONE)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string array without nulls, one after the other, and the bounds of its rows."""
    data, offsets = utf8(words)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64), lead[offsets]


def strings(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The string array that has these code points in its rows."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.append(0, np.cumsum(size, dtype=np.int64))[bounds]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the bounds of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


PORTION = 1 << 19   # bytes of text that are worked on at once
BATCH = 1 << 22     # bytes of an Arrow batch of texts


def portions(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of a string or list array with ``most`` bytes or values each; more only in a row of its own.

    What is computed from a batch takes many times its size, and a batch of long texts has up to 64 MB.
    """
    offsets = column.offsets.to_numpy() if hasattr(column, "offsets") else np.frombuffer(
        column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + most, side="right")) - 1)
        yield column.slice(start, end - start)
        start = end


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, each once.  The values come as a few ascending runs, which a stable sort only merges."""
    values = np.sort(values, kind="stable")
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def merge_words(tokens: np.ndarray, bounds: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """All words merged: in each the earliest learned pair first, its places from the left, until none is left.

    One pass makes the next merge of every word that has one; words that are done leave the pass.
    """
    size = np.diff(bounds)
    word = np.repeat(np.arange(len(size)), size)
    if not len(table.code) or not len(tokens):
        return tokens, bounds
    tok = tokens.astype(np.int64)
    rank = np.full(len(tok), NONE)
    inside = word[1:] == word[:-1]
    rank[:-1][inside] = table.look_up(tok[:-1][inside], tok[1:][inside])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(tok):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(tok))))
        live = best < NONE
        if not live.all():
            done.append((word[~live], tok[~live]))
            tok, word, rank, best = tok[live], word[live], rank[live], best[live]
            if not len(tok):
                break
        at = np.flatnonzero(rank == best)
        # Places overlap only where a token is paired with itself: every other one of such a run counts.
        if len(at) > 1 and (at[1:] - at[:-1] == 1).any():
            order = np.arange(len(at))
            begins = np.append(True, at[1:] - at[:-1] != 1)
            at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
        tok[at] = rank[at]
        keep = np.ones(len(tok), dtype=bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))   # where the new tokens stand after their right halves went
        tok, word, rank = tok[keep], word[keep], rank[keep]
        # Only pairs with a new token changed.
        left = distinct(np.concatenate([now, now[now > 0] - 1]))
        rank[left] = NONE
        left = left[left + 1 < len(tok)]
        left = left[word[left] == word[left + 1]]
        rank[left] = table.look_up(tok[left], tok[left + 1])
    words, toks = np.concatenate([w for w, _ in done]), np.concatenate([t for _, t in done])
    return toks[np.argsort(words, kind="stable")], np.append(0, np.cumsum(np.bincount(words, minlength=len(size))))


_MARK = chr(DOWN_ID).encode()[0]


def merge_framed(framed: pa.Array, table: MergeTable) -> pa.Array:
    """Token strings with their framed words merged.

    The distinct words of the batch are a dictionary; each is merged once and its codes are scattered back.
    """
    data, bounds = utf8(framed)
    mark = np.flatnonzero(data[:-1] == _MARK) if len(data) else np.zeros(0, np.int64)
    start = mark[data[mark + 1] == chr(DOWN_ID).encode()[1]] + 2
    ups = np.append(mark[data[mark + 1] == chr(UP_ID).encode()[1]], len(data))
    end = np.minimum(ups[np.searchsorted(ups, start)], bounds[1:][np.searchsorted(bounds[1:], start)] if len(start) else start)
    # A word goes on to the end of its frame; what is framed once more inside it is no word of its own.
    own = np.append(True, start[1:] >= np.maximum.accumulate(end)[:-1])[:len(start)] & (end > start)
    start, end = start[own], end[own]
    cuts = distinct(np.concatenate([start, end, bounds]))
    pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data.tobytes()))
    is_word = np.isin(cuts[:-1], start, assume_unique=True)
    words = pieces.filter(pa.array(is_word)).dictionary_encode()
    merged = strings(*merge_words(*code_points(words.dictionary), table))
    index = np.empty(len(pieces), dtype=np.int64)
    index[is_word] = words.indices.to_numpy()
    index[~is_word] = len(merged) + np.arange(int((~is_word).sum()))
    whole = pa.concat_arrays([merged, pieces.filter(pa.array(~is_word))]).take(pa.array(index))
    out, offsets = utf8(whole)
    result = pa.LargeStringArray.from_buffers(len(framed), pa.py_buffer(offsets[np.searchsorted(cuts, bounds)]), pa.py_buffer(out.tobytes())).cast(pa.string())
    return pa.compute.if_else(framed.is_null(), pa.scalar(None, pa.string()), result) if framed.null_count else result


def pair_sums(tokens: np.ndarray, bounds: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring pairs within words, and the sum of their words' weights."""
    word = np.repeat(np.arange(len(weight)), np.diff(bounds))
    inside = np.flatnonzero(word[1:] == word[:-1])
    return summed(tokens[inside] << SHIFT | tokens[inside + 1], weight[word[inside]])


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.add.reduceat(value, first) if len(first) else value[:0]
