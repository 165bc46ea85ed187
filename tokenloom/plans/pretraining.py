"""Whole jobs before the model: vocabulary, token rows, evaluation requests; and after it: metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import tokens as T
from tokenloom.operators import bpe, corpus, evaluation, packing
from tokenloom.session import materialise
from tokenloom.sources import shards


def frequent_pairs(docs: DataFrame, n: int = 100, cap: int | None = None) -> DataFrame:
    """The ``n`` most frequent byte pairs of a corpus: split whole texts (or ``cap`` characters of each), count words, count pairs."""
    counted = bpe.word_counts(docs if cap is None else corpus.crop_documents(docs, cap))
    return bpe.pair_counts(counted).orderBy(F.desc("c"), "a", "b").limit(n)


def train_tokenizer(docs: DataFrame, vocab_size: int, out: str, max_chars: int | None = None, cap: int | None = None,
                    markers: bool = True) -> list[tuple[int, int, int, int]]:
    """Count words, learn merges, store tokenizer and byte table; crop and character budget only if asked for."""
    spark = docs.sparkSession
    kept = docs if cap is None else corpus.crop_documents(docs, cap)
    kept = kept if max_chars is None else corpus.char_budget(kept, max_chars)
    merges = bpe.bpe_train(bpe.word_counts(kept), vocab_size)
    shards.save_tokenizer(spark, merges, out, markers=markers)
    shards.write_token_bytes(bpe.vocab_table(spark, [m[:3] for m in merges]), f"{out}/token_bytes")
    return merges


def packed_corpus(docs: DataFrame, merges, T_len: int, markers: bool = True) -> DataFrame:
    """Documents to trainer rows.  Encoded documents are stored once, because packing reads
    their lengths first and their tokens second."""
    merges = list(merges)
    coded = bpe.encode_tokens(docs.select("doc_id", "text"), merges, markers, prepend=T.BOS_ID).select(
        "doc_id", "tokens", F.length("tokens").alias("n_tokens"))
    return packing.pack_rows(materialise(coded, "coded"), T_len, size="n_tokens", vocab_size=T.FIRST_MERGE_ID + len(merges))


def score_report(scores: DataFrame, gold: DataFrame, baselines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centred accuracy per task, CORE) from option scores and ``example_id, task, gold``."""
    chosen = evaluation.choose_option(scores).join(gold, "example_id")
    correct = chosen.withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))
    centered = evaluation.centered_accuracy(evaluation.task_accuracy(correct), baselines)
    return centered, evaluation.core_metric(centered)
