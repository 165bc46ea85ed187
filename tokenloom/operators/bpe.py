"""Byte-pair vocabulary: counting, training, encoding, decoding."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import merging as M
from tokenloom.functions import tokens as T
from tokenloom.session import materialise

# Pairs and tokens of chains that a round of training brings to the driver, at most.
PAIRS, CHAINS = 1 << 16, 1 << 20

Merge = tuple[int, int, int]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the scan yields fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- counting

def word_counts(docs: DataFrame, text: str = "text", group: tuple[str, ...] = ()) -> DataFrame:
    """``word, cnt`` over a corpus; counting is partial before the shuffle, so hot words are cheap."""
    words = docs.select(*group, F.explode(T.split_words(F.col(text))).alias("word"))
    return words.groupBy(*group, "word").agg(F.count("*").alias("cnt"))


def word_tokens(words: DataFrame) -> DataFrame:
    """``tok, cnt``: every word as a token string of its UTF-8 bytes."""
    return words.select(T.byte_string(F.col("word")).alias("tok"), "cnt")


def _pair_strings(tok: DataFrame) -> DataFrame:
    """Adjacent pairs as two-character strings: those at even places, then those at odd ones.

    Each match takes whole code points, so tokens above U+FFFF count as one character.
    """
    pairs = F.concat(*[F.regexp_extract_all(t, F.lit("(?s).."), F.lit(0)) for t in (F.col("tok"), F.expr("substring(tok, 2)"))])
    long_enough = tok.where(F.length("tok") >= 2)
    return long_enough.select(F.explode(pairs).alias("pair"), "cnt").groupBy("pair").agg(F.sum("cnt").alias("c"))


def _char_id(char: Column) -> Column:
    point = F.ascii(char)
    return F.when(point >= 0xE000, point - 0x800).otherwise(point).cast("int")


def pair_counts(words: DataFrame) -> DataFrame:
    """``a, b, c``: occurrences of adjacent byte pairs, weighted by the word counts."""
    return _pair_strings(word_tokens(words)).select(
        _char_id(F.substring("pair", 1, 1)).alias("a"), _char_id(F.substring("pair", 2, 1)).alias("b"), "c")


def top_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the smallest."""
    return pairs.orderBy(F.desc("c"), "a", "b").limit(1)


# ---------------------------------------------------------------- training

def _rewrite(table: M.MergeTable, first: bool):
    """Words after merging, and what that changes in the pair counts: rows ``tok, cnt`` and rows ``pair, c``.

    The first pass, which merges nothing, counts the pairs of all words.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cnt = batch.column("cnt").to_numpy()
            tok, bounds = M.code_points(batch.column("tok"))
            new, ends = M.merge_words(tok, bounds, table)
            if first:
                pair, c = M.pair_sums(tok, bounds, cnt)
            else:
                changed = np.diff(bounds) != np.diff(ends)
                parts = [M.pair_sums(t[np.repeat(changed, np.diff(e))], np.append(0, np.cumsum(np.diff(e)[changed])), sign * cnt[changed])
                         for t, e, sign in ((tok, bounds, -1), (new, ends, 1))]
                pair, c = M.summed(*(np.concatenate(x) for x in zip(*parts)))
                pair, c = pair[c != 0], c[c != 0]
            left = np.diff(ends) >= 2
            words = M.strings(new[np.repeat(left, np.diff(ends))], np.append(0, np.cumsum(np.diff(ends)[left]))).cast(pa.string())
            n, k = int(left.sum()), len(pair)
            yield pa.record_batch({
                "tok": pa.concat_arrays([words, pa.nulls(k, pa.string())]), "cnt": pa.concat_arrays([pa.array(cnt[left]), pa.nulls(k, pa.int64())]),
                "pair": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pair)]), "c": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c)])})
    return task


def _chains(pairs: np.ndarray):
    """Runs of tokens in which all neighbours are one of ``pairs``, with the sums of their words' counts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, bounds = M.code_points(batch.column("tok"))
            word = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            code = tok[:-1] << M.SHIFT | tok[1:]
            linked = (word[1:] == word[:-1]) & (pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
            start, end = edge[::2], edge[1::2] + 1
            size = end - start
            ends = np.append(0, np.cumsum(size))
            found = M.strings(tok[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends).dictionary_encode()
            weight = np.zeros(len(found.dictionary), dtype=np.int64)
            np.add.at(weight, found.indices.to_numpy(), batch.column("cnt").to_numpy()[word[start]])
            yield pa.record_batch({"chain": found.dictionary.cast(pa.string()), "cnt": pa.array(weight)})
    return task


def learn_from_chains(chains: list[tuple[str, int]], floor: int, first_id: int, wanted: int) -> list[tuple[int, int, int, int]]:
    """Merges one at a time, as long as the best pair is more frequent than ``floor``; the first merge always.

    ``chains`` hold every occurrence of the pairs above ``floor``.  A merge of (a, b) makes pairs (x, ab) and (ab, y)
    that are at most as frequent as the (x, a) and (b, y) they came from.  So a pair above ``floor`` stands in a chain
    with all its occurrences, however many merges went before.
    """
    toks, count, where = [list(s) for s, _ in chains], defaultdict(int), defaultdict(set)
    for i, (own, (_, n)) in enumerate(zip(toks, chains)):
        for x, y in zip(own, own[1:]):
            count[x + y] += n
            where[x + y].add(i)
    heap = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(heap)
    found: list[tuple[int, int, int, int]] = []
    while heap and len(found) < wanted:
        n, pair = heapq.heappop(heap)
        if count.get(pair) != -n:
            continue   # an entry from before the count changed
        if -n <= floor and found:
            break
        new = T.token_char(first_id + len(found))
        found.append((T.char_token(pair[0]), T.char_token(pair[1]), first_id + len(found), -n))
        change: dict[str, int] = defaultdict(int)
        for i in where.pop(pair):
            own, n = toks[i], chains[i][1]
            for x, y in zip(own, own[1:]):
                change[x + y] -= n
            out, k = [], 0
            while k < len(own):
                if k + 1 < len(own) and own[k] + own[k + 1] == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(own[k])
                    k += 1
            toks[i] = out
            for x, y in zip(out, out[1:]):
                change[x + y] += n
                where[x + y].add(i)
        for p, d in change.items():
            if d:
                count[p] += d
                if count[p] > 0:
                    heapq.heappush(heap, (-count[p], p))
        del count[pair]
    return found


def bpe_train(words: DataFrame, vocab_size: int, batch: int = 256, rebase_every: int = 8) -> list[tuple[int, int, int, int]]:
    """Learn merges as ``(a, b, id, count)``; ties go to the smallest pair, counts are exact.

    A round looks at the ``batch`` best pairs and brings the chains of tokens that hang together by them, counted over
    all words, to the driver.  These hold all occurrences of every pair that can come up before the counts fall to
    that of the last pair fetched, so the round learns all merges down to there, often hundreds (see
    ``learn_from_chains``).  Then one pass merges the words and yields the change of the pair table: the pairs of the
    words that changed.  The table is a base and such changes, folded after every ``rebase_every`` rounds.

    What reaches the driver is bounded: by ``PAIRS`` pairs, and chains of ``CHAINS`` tokens.  Beyond that a round takes fewer
    pairs; it takes more where the chains leave room.  Words, changes and chains are written to the shared folder, so
    lineage stays short and a lost executor costs a round at most.  Words that became one token drop out.
    """
    if vocab_size <= T.FIRST_MERGE_ID:
        raise ValueError(f"vocab_size must be above {T.FIRST_MERGE_ID}")
    if vocab_size > T.MAX_TOKENS:
        raise ValueError(f"a token string holds {T.MAX_TOKENS} tokens")
    schema, found, tables = "tok string, cnt long, pair long, c long", [], []
    current = word_tokens(words).where(F.length("tok") >= 2)
    learned: list[tuple[int, int, int, int]] = []
    while True:
        table = M.MergeTable.of(m[:3] for m in learned)
        stored = materialise(current.mapInArrow(_rewrite(table, not tables), schema), "words")
        tables.append(stored.where("pair is not null").select("pair", "c"))
        base = current = stored.where("tok is not null").select("tok", "cnt")
        pairs = reduce(DataFrame.union, tables).groupBy("pair").agg(F.sum("c").alias("c")).where("c > 0")
        if len(tables) > rebase_every:
            pairs = materialise(pairs, "pairs")
            tables = [pairs]
        top = [tuple(r) for r in pairs.orderBy(F.desc("c"), "pair").limit(batch).collect()]
        if not top:
            return found
        complete = len(top) < batch
        while True:
            size = Observation()
            codes = np.array(sorted(p for p, _ in top), dtype=np.int64)
            chains = base.mapInArrow(_chains(codes), "chain string, cnt long").groupBy("chain").agg(F.sum("cnt").alias("cnt"))
            chains = materialise(chains.observe(size, F.sum(F.length("chain")).alias("n")), "chains")
            if size.get["n"] <= CHAINS or len(top) == 1:
                break
            top, complete = top[:len(top) // 2], False
        learned = learn_from_chains([tuple(r) for r in chains.collect()], 0 if complete else top[-1][1],
                                    T.FIRST_MERGE_ID + len(found), vocab_size - T.FIRST_MERGE_ID - len(found))
        found += learned
        if len(found) >= vocab_size - T.FIRST_MERGE_ID:
            return found
        batch = min(PAIRS, 2 * batch if 4 * size.get["n"] <= CHAINS else max(len(top), 2))


MERGE_SCHEMA = "a int, b int, id int, c bigint"


def merges_frame(spark: SparkSession, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in merges], MERGE_SCHEMA)


def merge_list(merges: DataFrame) -> list[Merge]:
    """A stored merge table as a list; its size is that of the vocabulary, which is model metadata."""
    rows = merges.select("a", "b", "id").orderBy("id").collect()
    return [(r.a, r.b, r.id) for r in rows]


# ---------------------------------------------------------------- vocabulary

def token_bytes(merges: list[Merge]) -> dict[int, bytes]:
    table = {i: bytes([i]) for i in range(256)}
    table[T.DOWN_ID], table[T.UP_ID] = "↘".encode(), "↗".encode()
    table.update({i: name.encode() for name, i in T.SPECIAL_IDS.items()})
    for a, b, new_id in sorted(merges, key=lambda m: m[2]):
        table[new_id] = table[a] + table[b]
    return table


def vocab_table(spark: SparkSession, merges: list[Merge]) -> DataFrame:
    """``id, bytes, kind, n_bytes``; markers and special tokens count 0 bytes."""
    def kind(i):
        if i < 256:
            return "byte"
        return "marker" if i < T.BOS_ID else "special" if i < T.FIRST_MERGE_ID else "merge"

    rows = [(i, bytearray(b), kind(i), len(b) if kind(i) in ("byte", "merge") else 0)
            for i, b in sorted(token_bytes(merges).items())]
    return spark.createDataFrame(rows, "id int, bytes binary, kind string, n_bytes int")


def token_bytes_table(vocab: DataFrame) -> DataFrame:
    return vocab.select("id", "n_bytes")


def token_bytes_stats(vocab: DataFrame) -> DataFrame:
    """Count of special tokens; min, max, mean and sample deviation of the lengths above 0."""
    n = F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return vocab.agg(
        F.count_if(F.col("kind") == "special").alias("num_special_tokens"),
        F.min(n).alias("token_bytes_min"),
        F.max(n).alias("token_bytes_max"),
        F.avg(n).alias("token_bytes_mean"),
        F.stddev_samp(n).alias("token_bytes_std"),
    )


# ---------------------------------------------------------------- encoding

def merge_word(word: str, rank: dict[str, str]) -> str:
    """Merge the lowest-id pair, leftmost first, until none is left."""
    toks = list(word)
    while len(toks) > 1:
        best = min((rank.get(x + y, "\U0010ffff") for x, y in zip(toks, toks[1:])))
        if best == "\U0010ffff":
            break
        out, i = [], 0
        while i < len(toks):
            if i + 1 < len(toks) and rank.get(toks[i] + toks[i + 1]) == best:
                out.append(best)
                i += 2
            else:
                out.append(toks[i])
                i += 1
        toks = out
    return "".join(toks)


def merge_udf(spark: SparkSession, merges: list[Merge]):
    """Arrow function that merges the framed words of token strings, a portion at a time (``merging.merge_framed``).

    A worker holds a batch and what comes of a portion of it, so batches are kept short, whatever rows a task has.
    The setting stays: a DataFrame is planned when it is run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", M.BATCH)
    shared = spark.sparkContext.broadcast(M.MergeTable.of(merges))

    @F.arrow_udf("string")
    def merge_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for portion in M.portions(batch, M.PORTION):
                yield M.merge_framed(portion, shared.value)

    return merge_words


def with_merged(rows: DataFrame, framed: Column, merges: list[Merge], out: str = "__merged") -> DataFrame:
    """Adds the framed token string after merging."""
    if not merges:
        return rows.withColumn(out, framed)
    merge = merge_udf(rows.sparkSession, merges)
    # Read twice, the framed string stays a projection of its own below the Arrow step;
    # folded into its argument, array functions with lambdas keep Spark from planning it.
    staged = rows.withColumn("__framed", framed)
    f = F.col("__framed")
    return staged.withColumn(out, F.when(F.length(f) > 0, merge(f)).otherwise(f)).drop("__framed")


def encode_tokens(docs: DataFrame, merges: list[Merge] = (), markers: bool = True, text: str = "text",
                  out: str = "tokens", prepend: int | None = None, append: int | None = None) -> DataFrame:
    """Adds the encoding of every document as a token string; no shuffle, any vocabulary size.

    Merging is one Arrow function that gets the merge table as a broadcast (bounded by the
    vocabulary) and merges each distinct word of a batch once.
    A token string takes 1-3 bytes per token, so it is also the cheap form to store and shuffle.
    """
    merges = list(merges)
    staged = with_merged(docs, T.framed_token_string(F.col(text)), merges)
    tokens = T.finish_token_string(F.col("__merged"), F.col(text), markers)
    if prepend is not None:
        tokens = F.concat(F.lit(T.token_char(prepend)), tokens)
    if append is not None:
        tokens = F.concat(tokens, F.lit(T.token_char(append)))
    return staged.withColumn(out, tokens).drop("__merged")


def encode_corpus(docs: DataFrame, merges: list[Merge] = (), markers: bool = True, text: str = "text",
                  out: str = "ids", prepend: int | None = None, append: int | None = None) -> DataFrame:
    """Adds ``ids`` (``ARRAY<INT>``) to every document."""
    merges = list(merges)
    coded = encode_tokens(docs, merges, markers, text, "__tokens", prepend, append)
    return coded.withColumn(out, T.token_string_ids(F.col("__tokens"), T.FIRST_MERGE_ID + len(merges))).drop("__tokens")


def encode_words(words: DataFrame, merges: list[Merge], word: str = "word") -> DataFrame:
    """Adds ``ids`` (no markers) to a table of distinct words."""
    framed = F.concat(F.lit(chr(T.DOWN_ID)), T.byte_string(F.col(word)), F.lit(chr(T.UP_ID)))
    bare = F.translate("__merged", chr(T.DOWN_ID) + chr(T.UP_ID), "")
    merged = with_merged(words, framed, list(merges))
    return merged.withColumn("ids", T.token_string_ids(bare, T.FIRST_MERGE_ID + len(merges))).drop("__merged")


def attach_encodings(counted: DataFrame, merges: list[Merge]) -> DataFrame:
    """``word`` counts of any grouping with the encoding of each distinct word joined on.

    Every distinct word is encoded once.  The input is counted, so a hot word is one row per
    group and the join cannot skew on it.
    """
    encodings = encode_words(counted.select("word").distinct(), merges)
    return counted.join(encodings, "word")


def decode_ids(ids: Column, merges: list[Merge] = ()) -> Column:
    """Ids to text: markers vanish, unknown ids vanish, broken UTF-8 gives a fixed marker text."""
    return decode_hex(_token_hex(ids, merges))


def _token_hex(ids: Column, merges: list[Merge]) -> Column:
    table = token_bytes(list(merges))
    table[T.DOWN_ID] = table[T.UP_ID] = b""
    # One folded literal instead of one expression per token.
    spelled = F.split(F.lit(",".join(table.get(i, b"").hex() for i in range(max(table) + 1))), ",")
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(spelled, i), F.lit(""))), "")


# Fixed value: what broken UTF-8 decodes to.
INVALID_TEXT = "<invalid utf‑8>"


def decode_hex(hexed: Column) -> Column:
    raw = F.unhex(hexed)
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(INVALID_TEXT))


def decode_corpus(rows: DataFrame, merges: list[Merge] = (), ids: str = "ids", out: str = "text") -> DataFrame:
    return rows.withColumn(out, decode_ids(F.col(ids), merges))


def compression_ratio(docs: DataFrame, group: str, merges: list[Merge], text: str = "text") -> DataFrame:
    """UTF-8 bytes per token and group, markers off: one scan, only sums are shuffled."""
    coded = encode_tokens(docs.select(group, text), merges, markers=False, text=text, out="__tokens")
    sums = coded.groupBy(group).agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.length("__tokens")).cast("bigint").alias("tokens"))
    return sums.select(group, "bytes", "tokens", (F.col("bytes") / F.col("tokens")).alias("ratio"))


def compare_tokenizers(ours: DataFrame, baseline: DataFrame, group: str, names=("Ours", "Baseline")) -> DataFrame:
    """Two ratio tables side by side; positive difference means fewer tokens on our side."""
    b = baseline.select(group, F.col("tokens").alias("base_tokens"), F.col("ratio").alias("base_ratio"))
    joined = ours.join(b, group)
    better = (F.when(F.col("base_ratio") > F.col("ratio"), names[1])
              .when(F.col("ratio") > F.col("base_ratio"), names[0]).otherwise("Tie"))
    diff = (F.col("base_tokens") - F.col("tokens")) / F.col("base_tokens") * 100
    return joined.select(group, "bytes", "base_tokens", "base_ratio", "tokens", "ratio",
                         diff.alias("relative_diff_pct"), better.alias("better"))
