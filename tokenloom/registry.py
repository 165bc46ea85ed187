"""Named tasks, generators and evaluators, and the SQL functions for ad-hoc use."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fuzzy, text
from tokenloom.functions import tokens as T
from tokenloom.functions.merging import portions
from tokenloom.operators import bpe, corpus, synthesis
from tokenloom.operators.conversations import flatten_games

PORTION = 1 << 18   # bytes of text, or ids, that the SQL functions turn into Python objects at once


# ---------------------------------------------------------------- tasks

@dataclass(frozen=True)
class Task:
    """How to load a task and how to judge an answer.

    ``load(spark, path)`` gives rows with ``messages``; ``score(rows)`` is a 0/1 column over
    ``completion`` and ``reference``; ``eval_type`` is ``generative`` or ``categorical``.
    """
    name: str
    eval_type: str
    load: Callable[[SparkSession, str], DataFrame]
    score: Callable[[], Column]

    def reward(self) -> Column:
        return self.score().cast("double")


def _same_number() -> Column:
    return text.extract_answer(F.col("completion")).eqNullSafe(text.extract_answer(F.col("reference"))).cast("int")


def _same_letter() -> Column:
    return (F.col("completion") == F.col("reference")).cast("int")


class Registry(dict):
    """Names to entries; an unknown name lists what there is."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def __missing__(self, name):
        raise KeyError(f"unknown {self.kind}: {name}; available: {sorted(self)}")


tasks: Registry = Registry("task")


def register_task(task: Task) -> None:
    if task.eval_type not in ("generative", "categorical"):
        raise ValueError("eval_type must be generative or categorical")
    tasks[task.name] = task


_parquet = lambda spark, path: spark.read.parquet(path)
for _name in ("GSM8K", "SpellingBee"):
    register_task(Task(_name, "generative", _parquet, _same_number))
for _name in ("ARC-Easy", "ARC-Challenge", "MMLU"):
    register_task(Task(_name, "categorical", _parquet, _same_letter))


def num_examples(task: Task, spark: SparkSession, path: str) -> int:
    return task.load(spark, path).count()


def evaluate(task: Task, completions: DataFrame) -> DataFrame:
    return completions.withColumn("is_correct", task.score())


# ---------------------------------------------------------------- generators

@dataclass
class Generators:
    """Weighted row generators: each maps a seed table to ``prompt, json`` rows."""
    makers: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def register(self, name: str, maker: Callable[[DataFrame, str], DataFrame], weight: float = 1.0) -> None:
        self.makers[name], self.weights[name] = maker, weight

    def configure(self, weights: dict[str, float]) -> None:
        for name, weight in weights.items():
            if name in self.makers:
                self.weights[name] = weight
            else:
                warnings.warn(f"unknown generator {name}", stacklevel=2)

    def list(self) -> list[str]:
        return list(self.makers)

    def generate(self, seeds: DataFrame, seed: str = "seed", salt: int = 7) -> DataFrame:
        """One problem per seed row from a source drawn by weight: ``seed, source, prompt, json``."""
        tagged = seeds.select(seed, corpus.weighted_source(self.weights, F.col(seed), seed=salt).alias("source"))
        live = [n for n in self.makers if self.weights[n] > 0]
        parts = [self.makers[n](tagged.where(F.col("source") == n), seed).select(seed, "source", "prompt", "json") for n in live]
        return reduce(DataFrame.unionByName, parts)


def calculator_rows(seeds: DataFrame, seed: str) -> DataFrame:
    rows = synthesis.expression_problems(seeds, seed)
    return rows.withColumn("json", text.calc_record(F.col("json"), F.col("answer")))


def game_rows(seeds: DataFrame, seed: str) -> DataFrame:
    """Flattened dialogues; those that do not end on a reply are replaced by expressions."""
    games = flatten_games(synthesis.game_dialogues(seeds, seed).select(*seeds.columns, "messages"))
    # One pass: branches that filter by kind play every game again.
    open_rows = games.select(*seeds.columns, F.struct("prompt", "json").alias("__game"), (F.col("kind") == "calculator").alias("__open"))
    filled = synthesis.expression_problems(open_rows, seed, wanted="__open")
    either = lambda made, name: F.when(F.col("__open"), made).otherwise(F.col("__game")[name]).alias(name)
    return filled.select(*seeds.columns, either(F.col("prompt"), "prompt"), either(text.calc_record(F.col("json"), F.col("answer")), "json"))


def default_generators() -> Generators:
    g = Generators()
    g.register("calculator", calculator_rows, 1.0)
    g.register("tic-tac-toe", game_rows, 0.5)
    return g


# ---------------------------------------------------------------- evaluators

@dataclass(frozen=True)
class Evaluator:
    """``parse(text)`` gives ``STRUCT<prompt, expected>``, ``score(expected, predicted)`` ``STRUCT<score, corr, ...>``."""
    parse: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]


evaluators: Registry = Registry("evaluator")
evaluators["calculator"] = Evaluator(text.calc_parse, fuzzy.calc_score)
evaluators["tictactoe"] = Evaluator(text.game_parse, text.game_score)


# ---------------------------------------------------------------- SQL functions

def register_functions(spark: SparkSession, merges=(), markers: bool = True) -> None:
    """SQL functions ``bpe_encode(text)``, ``bpe_decode(ids)`` and the table function ``bpe_tokens(text)``.

    For ad-hoc queries; whole corpora go through ``encode_corpus``.
    """
    rank = {T.token_char(a) + T.token_char(b): T.token_char(i) for a, b, i in merges}
    table = bpe.token_bytes(list(merges))
    hidden = (T.DOWN_ID, T.UP_ID)

    def encode_one(text_value):
        out = []
        rest = text_value
        while (name := next((n for n in T.SPECIAL_TOKENS if rest.startswith(n)), None)):
            out.append(T.SPECIAL_IDS[name])
            rest = rest[len(name):]
        for is_word, piece in scan_text(rest):
            toks = bpe.merge_word("".join(map(chr, piece.encode())), rank) if is_word else piece
            ids = [T.char_token(c) for c in toks]
            out += [T.DOWN_ID, *ids, T.UP_ID] if is_word and markers else ids
        while out and out[-1] == T.UP_ID:
            out.pop()
        return out

    def decode_one(row):
        raw = b"".join(table.get(i, b"") for i in row if i not in hidden)
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return bpe.INVALID_TEXT

    # Rows are Python objects here, so only a portion of a batch is held as such.
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for portion in portions(batch, PORTION):
                coded = [None if t is None else np.array(encode_one(t), dtype=np.int32) for t in portion.to_pylist()]
                yield pa.array(coded, pa.list_(pa.int32()))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for portion in portions(batch, PORTION):
                bounds, ids = portion.offsets.to_numpy(), portion.values.to_numpy(zero_copy_only=False)
                rows = (ids[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:]))
                yield pa.array([decode_one(r) if known else None for r, known in zip(rows, portion.is_valid().to_pylist())], pa.string())

    @F.udtf(returnType="pos: int, id: int")
    class Tokens:
        def eval(self, value: str):
            yield from enumerate(encode_one(value or ""))

    spark.udf.register("bpe_encode", encode)
    spark.udf.register("bpe_decode", decode)
    spark.udtf.register("bpe_tokens", Tokens)


_SEPARATOR = re.compile(r"([()\[\]{}\n\t=:., ])")
_CLOSER_OF = {"(": ")", "[": "]", "{": "}"}


def scan_text(value: str):
    """(is_word, piece) of one text, for the ad-hoc functions."""
    awaited, head = [], ""
    # Separators sit at the odd places of the split.
    for place, piece in enumerate(_SEPARATOR.split(value)):
        if place % 2 == 0:
            if head + piece:
                yield True, head + piece
            head = ""
        elif piece in ")]}" and awaited[-1:] != [piece]:
            head = piece
        else:
            if piece in _CLOSER_OF:
                awaited.append(_CLOSER_OF[piece])
            elif piece in ")]}":
                awaited.pop()
            yield False, piece


def encode_column(col: Column, merges=(), markers: bool = True, prepend=None, append=None) -> Column:
    """Ad-hoc encoding of one column; ids or special-token names may be put around it."""
    special = lambda x: T.SPECIAL_IDS[x] if isinstance(x, str) else x
    return T.encode_text(col, merges, markers, special(prepend), special(append))
