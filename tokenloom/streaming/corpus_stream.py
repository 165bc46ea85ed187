"""Streams over growing corpora: documents, counts, packed rows, problems, metrics, text output."""

from __future__ import annotations

import heapq
import itertools
import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tokenloom.functions import tokens as T
from tokenloom.operators import bpe

# Stateful processors start in a Python process that does not get added files, so they
# travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def corpus_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1,
                  glob: str = "*.parquet") -> DataFrame:
    """Documents file by file as they arrive; a checkpoint remembers the files already read.

    ``path`` is a folder that files arrive in, or a pattern of folders and files.
    """
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", glob).parquet(path))


def stream_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Running word counts; the final state equals the batch count."""
    return bpe.word_counts(docs, text)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop.  Restarting with the same checkpoint resumes exactly.

    ``append`` writes through the file sink (exactly once); ``complete`` and ``update`` write
    every batch to its own folder, so a repeated batch replaces itself.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()


def latest_result(spark: SparkSession, out: str, *key: str) -> DataFrame:
    """Last value of every key from batches written in update mode: a batch holds only the keys it changed."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*key, "last.*")


# ---------------------------------------------------------------- packing

def lane_of(key: str, lanes: int):
    """Lane of a document.  More lanes mean more parallel buffers; a hot source spreads over all."""
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


PACK_ROWS = 1024   # documents joined at once
PIECE = 64         # documents of a sorted run that are held at once
APART = "\U0010ffff"   # no token


class _Packer(StatefulProcessor):
    """Leftover tokens of one lane, always fewer than one row.

    A lane's share of a micro-batch is put in key order by an external sort: each Arrow frame is a sorted run in map
    state, in pieces, and the runs are merged with one piece of each in memory.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("leftover", "tokens string, row bigint")
        self.pieces = handle.getMapState("runs", "run int, piece int", "keys string, tokens string")

    @staticmethod
    def _sorted(frame: pd.DataFrame) -> list[tuple]:
        """Documents in key order, null keys first, null tokens as none."""
        rows = ((None if k is None or k != k else k, t or "") for k, t in zip(frame["key"].tolist(), frame["tokens"]))
        return sorted(rows, key=_Packer._place)

    @staticmethod
    def _place(row: tuple) -> tuple:
        return (row[0] is not None, row[0] if row[0] is not None else 0, row[1])

    def _store(self, run: int, rows: list[tuple]) -> None:
        for piece in range(0, len(rows), PIECE):
            keys, tokens = zip(*rows[piece:piece + PIECE])
            self.pieces.updateValue((run, piece // PIECE), (json.dumps(keys), APART.join(tokens)))

    def _read(self, run: int) -> Iterator[tuple]:
        piece = 0
        while self.pieces.containsKey((run, piece)):
            keys, tokens = self.pieces.getValue((run, piece))
            self.pieces.removeKey((run, piece))
            yield from zip(json.loads(keys), tokens.split(APART))
            piece += 1

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held, runs = None, 0
        for frame in frames:
            if held is not None:
                self._store(runs, held)
                runs += 1
            held = self._sorted(frame)
        # The last frame, often the only one, needs no store.
        return heapq.merge(*[self._read(r) for r in range(runs)], held or [], key=self._place)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, row = self.state.get() if self.state.exists() else ("", 0)
        arrived = self._in_order(rows)
        while some := list(itertools.islice(arrived, PACK_ROWS)):
            joined = kept + "".join(t for _, t in some)
            full = len(joined) // self.width
            cut = [joined[r * self.width:(r + 1) * self.width] for r in range(full)]
            kept = joined[full * self.width:]
            if cut:
                yield pd.DataFrame({"lane": key[0], "row": range(row, row + full), "tokens": cut})
            row += full
        self.state.update((kept, row))

    def close(self) -> None:
        pass


def stream_packer(coded: DataFrame, T_len: int, lanes: int = 64, key: str = "doc_id", vocab_size: int = 0,
                  lane: Column | None = None) -> DataFrame:
    """Rows of T + 1 ids per lane from a stream of ``key, tokens`` (token strings); leftovers wait in state.

    Documents of one lane keep the order of their micro-batches, and inside one that of ``key``.
    """
    laned = coded.select((lane_of(key, lanes) if lane is None else lane).cast("int").alias("lane"), F.col(key).alias("key"), "tokens")
    rows = laned.groupBy("lane").transformWithStateInPandas(
        _Packer(T_len + 1), outputStructType="lane int, row bigint, tokens string", outputMode="Append", timeMode="None")
    return rows.select("lane", "row", T.token_string_ids(F.col("tokens"), vocab_size).alias("ids"))


# ---------------------------------------------------------------- problems

def problem_stream(spark: SparkSession, rate: int, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Endless problems: the counter of the rate source is the seed of a row generator."""
    seeds = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("seed"))
    return make(seeds, "seed")


# ---------------------------------------------------------------- metrics

BLOCK = 512   # positions that wait under one key of the map state


class _InOrder(StatefulProcessor):
    """Folds dense positions in order, frame by frame; what arrives early waits in map state, what comes twice is left out.

    Each call to the state goes to the JVM and back.  So the positions of a block wait together, the numbers of the blocks
    are kept with the value of the key, and a block is read when its turn comes.
    """

    def waiting(self, handle: StatefulProcessorHandle, *types: str) -> None:
        columns = ", ".join(f"v{i} array<{t}>" for i, t in enumerate(types))
        self.early = handle.getMapState("early", "block bigint", f"pos array<bigint>, {columns}")

    def _held(self, block: int, blocks: set[int]) -> dict[int, tuple]:
        """Values by position that wait in a block."""
        if block not in blocks:
            return {}
        pos, *values = self.early.getValue((block,))
        return dict(zip(pos, zip(*values)))

    def _keep(self, block: int, rows: dict[int, tuple], blocks: set[int]) -> None:
        if rows:
            self.early.updateValue((block,), (list(rows), *map(list, zip(*rows.values()))))
            blocks.add(block)
        elif block in blocks:
            self.early.removeKey((block,))
            blocks.remove(block)

    def ready(self, frame: pd.DataFrame, names: list[str], due: int, blocks: set[int]) -> Iterator[tuple]:
        """``(position, values)`` from position ``due`` on, as far as they have come; ``blocks`` hold what waits."""
        early: dict[int, dict[int, tuple]] = {}
        block, held, count = due // BLOCK, None, 0
        for pos, *values in sorted(zip(*(frame[n].tolist() for n in names)), key=lambda r: r[0]):
            if pos > due:
                early.setdefault(int(pos) // BLOCK, {})[int(pos)] = tuple(values)
            if pos != due:
                continue
            while values is not None:
                yield due, tuple(values)
                due += 1
                if not blocks:
                    values = None
                    continue
                if held is None or due // BLOCK != block:
                    if held is not None and len(held) < count:
                        self._keep(block, held, blocks)
                    block = due // BLOCK
                    held = self._held(block, blocks)
                    count = len(held)
                values = held.pop(due, None)
        if held is not None and len(held) < count:
            self._keep(block, held, blocks)
        for number, rows in early.items():
            self._keep(number, self._held(number, blocks) | rows, blocks)


class _Smoother(_InOrder):
    """Average, best value and time of one run."""

    def __init__(self, beta: float):
        self.beta = beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "smooth double, seen bigint, best double, last_us bigint, total_us bigint, blocks array<bigint>")
        self.waiting(handle, "double", "bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        smooth, seen, best, last, total, waits = self.state.get() or (0.0, 0, None, None, 0, [])
        blocks = set(waits)
        for frame in rows:
            out = []
            for step, (value, us) in self.ready(frame, ["step", "value", "us"], seen, blocks):
                smooth = self.beta * smooth + (1 - self.beta) * value
                best = value if best is None else min(best, value)
                total += int(us - last) if step > 1 else 0
                seen, last = seen + 1, int(us)
                out.append((key[0], step, smooth / (1 - self.beta ** seen), best, total))
            if out:
                yield pd.DataFrame(out, columns=["run", "step", "debiased", "best", "total_us"])
        if seen or blocks:
            self.state.update((float(smooth), int(seen), best if best is None else float(best), last, int(total), sorted(blocks)))

    def close(self) -> None:
        pass


def stream_metrics(log: DataFrame, beta: float = 0.9) -> DataFrame:
    """Smoothed and best value and time so far from a stream of ``run, step, value, ts``.

    Steps are dense from 0 in a run and may arrive in any order; a step is given out when all before
    it have come.  The batch twins are ``ema_debiased``, ``running_best`` and ``throughput_eta``.
    """
    rows = log.select("run", "step", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("run").transformWithStateInPandas(
        _Smoother(beta), outputStructType="run bigint, step bigint, debiased double, best double, total_us bigint",
        outputMode="Append", timeMode="None")


# ---------------------------------------------------------------- text output

def split_complete(raw: bytes) -> tuple[str, bytes]:
    """Text of the complete characters and the bytes of an unfinished last one."""
    for held in range(0, min(4, len(raw) + 1)):
        head = raw[:len(raw) - held]
        try:
            return head.decode("utf-8"), raw[len(raw) - held:]
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace"), b""


class _Speaker(_InOrder):
    """Bytes of a session that do not end a character yet, and the position that is due."""

    def __init__(self, table: dict[int, bytes]):
        self.table = table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "raw binary, due bigint, blocks array<bigint>")
        self.waiting(handle, "bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        raw, due, waits = self.state.get() or (b"", 0, [])
        pending, blocks = bytes(raw), set(waits)
        for frame in rows:
            out = []
            for pos, (token,) in self.ready(frame, ["pos", "token"], due, blocks):
                due = pos + 1
                text, pending = split_complete(pending + self.table.get(int(token), b""))
                if text:
                    out.append((key[0], pos, text))
            if out:
                yield pd.DataFrame(out, columns=["session", "pos", "text"])
        self.state.update((pending, int(due), sorted(blocks)))

    def close(self) -> None:
        pass


def incremental_detokenize(tokens: DataFrame, merges=()) -> DataFrame:
    """New text per token from a stream of ``session, pos, token``; only whole characters are given out."""
    table = bpe.token_bytes(list(merges))
    table[T.DOWN_ID] = table[T.UP_ID] = b""
    return tokens.groupBy("session").transformWithStateInPandas(
        _Speaker(table), outputStructType="session bigint, pos bigint, text string", outputMode="Append", timeMode="None")
