"""Words, encodings and the vocabulary, against fixed arrays and a plain single-process version."""

import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import registry
from tokenloom.catalog import load
from tokenloom.functions import merging as M
from tokenloom.functions import tokens as T
from tokenloom.operators import bpe, nesting
from tokenloom.operators.nesting import coordinates, nesting_profile
from tokenloom.registry import encode_column, register_functions

D, U = T.DOWN_ID, T.UP_ID
GOLDEN = {
    "foo (bar [baz])": [D, 102, 111, 111, U, 32, 40, D, 98, 97, 114, U, 32, 91, D, 98, 97, 122, U, 93, 41],
    "foo (bar ]": [D, 102, 111, 111, U, 32, 40, D, 98, 97, 114, U, 32, D, 93],
    "((foo))": [40, 40, D, 102, 111, 111, U, 41, 41],
    " \t=:.,": [32, 9, 61, 58, 46, 44],
    "": [],
    "foo bar ": [D, 102, 111, 111, U, 32, D, 98, 97, 114, U, 32],
    "<|bos|><|output_end|>a": [258, 266, D, 97],
    "a <|bos|>": [D, 97, U, 32, D, 60, 124, 98, 111, 115, 124, 62],
    "x]]y}": [D, 120, U, D, 93, U, D, 93, 121, U, D, 125],
    "([)]": [40, 91, D, 41, U, 93],
}
TEXTS = list(GOLDEN) + ["Hello world! Numbers: 123, 4567, 89\nI'm, you're @#$%^&*(something)", "你好世界 🌍 (é[ï}]) café naïve", "ĐđĒē ĀāĔ ) ]"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def by_id(df, col="ids"):
    return {r.doc_id: r[col] for r in df.select("doc_id", col).collect()}


def test_golden_arrays(spark):
    got = by_id(bpe.encode_corpus(frame(spark, GOLDEN)))
    assert [got[i] for i in range(len(GOLDEN))] == list(GOLDEN.values())


def naive_train(counts, k):
    words = {tuple(w.encode()): c for w, c in counts.items()}
    merges = []
    for new in range(267, 267 + k):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((*best, new, pairs[best]))
        rewritten = Counter()
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i:i + 2] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            rewritten[tuple(out)] += c
        words = rewritten
    return merges


@pytest.mark.parametrize("case", ["runs", "ties", "random", "all"])
def test_training_equals_one_merge_at_a_time(spark, case):
    rng = random.Random(case)
    counts = {
        "runs": {"aaaa": 3, "aaaaaa": 10, "xababy": 2, "aab": 5},
        "ties": {"abcd": 2, "cdab": 2, "efgh": 2, "bc": 2},
        "random": {"".join(rng.choices("abcdefgh", k=rng.randint(1, 7))): rng.randint(1, 6) for _ in range(150)},
        "all": {"ab": 1},
    }[case]
    words = spark.createDataFrame(list(counts.items()), "word string, cnt bigint")
    got = bpe.bpe_train(words, 267 + 40, batch=16, rebase_every=7)
    assert got == naive_train(counts, 40)


def test_vocabulary_must_leave_room_for_merges(spark):
    with pytest.raises(ValueError):
        bpe.bpe_train(spark.createDataFrame([("ab", 1)], "word string, cnt bigint"), 267)


@pytest.mark.parametrize("markers", [True, False])
def test_native_and_arrow_encoding_agree_and_decode_back(spark, markers):
    counts = Counter(w for t in TEXTS for w in t.split())
    merges = [m[:3] for m in naive_train(counts, 30)]
    docs = frame(spark, TEXTS)
    arrow = bpe.encode_corpus(docs, merges, markers, prepend=T.BOS_ID, append=T.ASSISTANT_END_ID)
    native = docs.select("doc_id", T.encode_text(F.col("text"), merges, markers, T.BOS_ID, T.ASSISTANT_END_ID).alias("ids"))
    assert by_id(native) == by_id(arrow)
    back = by_id(bpe.decode_corpus(native.select("doc_id", "ids"), merges), "text")
    assert back == {i: f"<|bos|>{t}<|assistant_end|>" for i, t in enumerate(TEXTS)}
    words = docs.select(F.explode(T.split_words(F.col("text"))).alias("word")).distinct()
    plain = {r.word: r.ids for r in bpe.encode_words(words, merges).collect()}
    words = words.where("word NOT LIKE '<|%'")
    plain = {w: ids for w, ids in plain.items() if not w.startswith("<|")}
    assert plain == {r.word: r.ids for r in words.select("word", T.encode_text(F.col("word"), merges, False).alias("ids")).collect()}


def test_ad_hoc_functions_equal_the_bulk_path(spark):
    merges = [(116, 104, 267), (267, 101, 268)]
    texts = TEXTS + ["the then (th]e"]
    register_functions(spark, merges)
    docs = frame(spark, texts)
    docs.createOrReplaceTempView("t")
    sql = {r.doc_id: r.ids for r in spark.sql("SELECT doc_id, bpe_encode(text) AS ids FROM t").collect()}
    assert sql == by_id(bpe.encode_corpus(docs, merges))
    assert sql == by_id(docs.withColumn("ids", encode_column(F.col("text"), merges)))
    rows = spark.sql("SELECT doc_id, pos, id FROM t, LATERAL bpe_tokens(text)").collect()
    assert {(r.doc_id, r.pos): r.id for r in rows} == {(d, p): i for d, ids in sql.items() for p, i in enumerate(ids)}


def test_broken_utf8_decodes_to_the_marker_text(spark):
    rows = spark.createDataFrame([(0, [255, 97]), (1, [256, 97, 257, 99999]), (2, [])], "doc_id bigint, ids array<int>")
    assert by_id(bpe.decode_corpus(rows), "text") == {0: bpe.INVALID_TEXT, 1: "a", 2: ""}


def test_ids_past_the_surrogates(spark):
    ids = [0xD7FF, 0xD800, 0xDFFF, 0xE000, 70000]
    text = "".join(T.token_char(i) for i in ids)
    row = spark.createDataFrame([(text,)], "t string").select(T.token_string_ids(F.col("t"), 80000).alias("ids")).first()
    assert row.ids == ids and [T.char_token(c) for c in text] == ids


def test_vocabulary_statistics(spark):
    vocab = bpe.vocab_table(spark, [(97, 98, 267), (267, 267, 268)])
    rows = {r.id: r for r in vocab.collect()}
    assert len(rows) == 269 and bytes(rows[268].bytes) == b"abab" and rows[255].n_bytes == 1
    stats = bpe.token_bytes_stats(vocab).first()
    assert (stats.num_special_tokens, stats.token_bytes_min, stats.token_bytes_max) == (9, 1, 4)


def plain_coordinates(ids, dims):
    at, coords, out = dims - 1, [0] * dims, []
    for t in ids:
        if t == D:
            at = (at + 1) % dims
        elif t == U:
            coords[at] = 0
            at = (at - 1) % dims
        coords[at] += 1
        out.append(list(coords))
    return out


@pytest.mark.parametrize("dims", [1, 2, 8])
def test_nesting_coordinates(dims):
    import numpy as np

    rng = random.Random(dims)
    for n in (0, 1, 50, 400):
        ids = rng.choices([D, U, 5, 9], k=n)
        assert coordinates(np.array(ids, dtype=np.int64), dims).tolist() == plain_coordinates(ids, dims)


def test_coordinates_of_several_sequences():
    import numpy as np

    rng = random.Random(7)
    own = [rng.choices([D, U, 5, 9], k=n) for n in (0, 3, 40, 0, 1, 200, 0)]
    bounds = np.append(0, np.cumsum([len(x) for x in own]))
    for dims in (1, 3, 8):
        assert coordinates(np.array(sum(own, []), dtype=np.int64), dims, bounds).tolist() == [c for x in own for c in plain_coordinates(x, dims)]


@pytest.mark.parametrize("portion", [1 << 20, 80])
def test_digests_are_made_where_the_coordinates_are(spark, monkeypatch, portion):
    """The texts of a batch are made and hashed in parts, also within one long row; no list of coordinates is returned."""
    monkeypatch.setattr(nesting, "PORTION", portion)
    rng = random.Random(3)
    own = [rng.choices([D, U, 5, 9], k=n) for n in (0, 1, 9, 10, 11, 0, 4000, 30)]
    got = pa.concat_arrays(nesting.digest_udf(8, 1000).func(iter([pa.array(["".join(map(chr, x)) for x in own])])))
    texts = [";".join(" ".join(str(min(c, 999)) for c in row) for row in plain_coordinates(x, 8)) for x in own]
    assert got.to_pylist() == [hashlib.md5(t.encode()).hexdigest() for t in texts]


def test_nesting_query_leaves_no_coordinates_to_spark(spark, tmp_path):
    """It answers like its SQL twin for null and empty texts too, and only strings come back from Python."""
    texts = [None, "", "a", "foo (bar [baz]) x]]y} " * 300, " \t=:.,", "<|bos|>a é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = load()[0]["W12_nesting_coordinates"](spark, str(tmp_path))
    got = {r.doc_id: (r.downs, r.coords_md5) for r in query.collect()}
    for i, text in enumerate(texts):
        ids = bpe.encode_corpus(spark.createDataFrame([(text or "",)], "text string")).first().ids
        assert got[i] == (ids.count(D), hashlib.md5(";".join(" ".join(map(str, c)) for c in plain_coordinates(ids, 8)).encode()).hexdigest())
    assert "md5(" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_nesting_profile(spark):
    rows = spark.createDataFrame([(1, [D, D, 5, U, D, U, U]), (2, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.max_depth for r in nesting_profile(rows).collect()} == {1: 2, 2: 0}


def test_pairs_of_tokens_beyond_the_surrogates(spark):
    ids = [63_480, 63_487, 63_488, 63_489, 65_535, 97, 70_000]
    tok = "".join(T.token_char(i) for i in ids)
    found = bpe._pair_strings(spark.createDataFrame([(tok, 2)], "tok string, cnt bigint")).collect()
    assert sorted((T.char_token(r.pair[0]), T.char_token(r.pair[1]), r.c) for r in found) == sorted((a, b, 2) for a, b in zip(ids, ids[1:]))


def test_encoding_with_thousands_of_merges(spark):
    """A vocabulary of 5,000 merges and more: equal to merging word by word, and decoded back."""
    rng = random.Random(7)
    pool, merges, seen = list(range(97, 123)), [], set()
    while len(merges) < 5000:
        a, b = rng.choice(pool), rng.choice(pool)
        if (a, b) not in seen:
            seen.add((a, b))
            merges.append((a, b, T.FIRST_MERGE_ID + len(merges)))
            pool.append(merges[-1][2])
    rank = {T.token_char(a) + T.token_char(b): T.token_char(i) for a, b, i in merges}
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 14))) for _ in range(200)) for _ in range(20)]
    texts += ["", "x" * 3000, "é " + "ab" * 500]
    docs = frame(spark, texts)
    coded = bpe.encode_corpus(docs, merges, markers=False)
    got = by_id(coded)
    for i, text in enumerate(texts):
        want = [T.char_token(c) for w in text.split(" ") for c in bpe.merge_word("".join(map(chr, w.encode())), rank) + " "][:-1]
        assert got[i] == want
    assert by_id(bpe.decode_corpus(coded.select("doc_id", "ids"), merges), "text") == dict(enumerate(texts))


def test_training_with_few_pairs_at_a_time(spark, monkeypatch):
    """However little a round may take, the merges are those of one at a time."""
    rng = random.Random(9)
    counts = {"".join(rng.choices("abcde", k=rng.randint(1, 9))): rng.randint(1, 60) for _ in range(80)}
    words = spark.createDataFrame(list(counts.items()), "word string, cnt bigint")
    want = naive_train(counts, 12)
    for batch, chains in ((1, 1 << 20), (6, 30), (64, 1 << 20)):
        monkeypatch.setattr(bpe, "CHAINS", chains)
        assert bpe.bpe_train(words, 267 + 12, batch=batch) == want


def test_portions_hold_all_rows():
    rng = random.Random(3)
    texts = [None if n == 7 else "é" * n for n in rng.choices([0, 1, 7, 40, 900], k=300)]
    lists = [None if t is None else [1] * len(t) for t in texts]
    for column, size in ((pa.array(texts).slice(3), 2), (pa.array(texts, pa.large_string()).slice(5, 200), 2), (pa.array(lists, pa.list_(pa.int32())).slice(4), 1)):
        parts = list(M.portions(column, 100))
        assert pa.concat_arrays(parts).equals(column)
        assert len(parts) > 20 and all(len(p) == 1 or size * sum(len(v or "") for v in p.to_pylist()) <= 100 for p in parts)
    assert list(M.portions(pa.array([], pa.string()), 100)) == []


def test_coordinates_of_a_large_batch_come_in_portions(monkeypatch):
    """Eight counts a token: a batch of ids must not be answered by one batch of coordinates."""
    monkeypatch.setattr(nesting, "PORTION", 8 * 1000)
    ids = pa.array([[D, 5, U, 9] * 50] * 100 + [None, []], pa.list_(pa.int32()))
    parts = list(nesting.nesting_udf().func(iter([ids])))
    assert max(len(p.flatten()) for p in parts) <= 1000
    assert pa.concat_arrays(parts).equals(nesting.batch_coordinates(ids, 8, 2048))


def test_merging_a_large_batch_comes_in_portions(spark, monkeypatch):
    monkeypatch.setattr(M, "PORTION", 1000)
    merges = [(97, 98, 267)]
    framed = pa.array([f"{chr(D)}abab{chr(U)} "] * 500 + [None, ""])
    parts = list(bpe.merge_udf(spark, merges).func(iter([framed])))
    assert max(p.nbytes for p in parts) < 5000
    assert pa.concat_arrays(parts).to_pylist() == M.merge_framed(framed, M.MergeTable.of(merges)).to_pylist()


def test_texts_reach_the_merging_workers_in_short_batches(spark, monkeypatch):
    """What a worker holds must not grow with the rows of its task, whatever the session allows: a batch ends with the row that fills it."""
    monkeypatch.setattr(bpe, "M", SimpleNamespace(
        MergeTable=M.MergeTable, PORTION=0, BATCH=4 << 20, portions=lambda batch, most: [batch],
        merge_framed=lambda batch, table: pa.array([f"{len(batch)} {batch.nbytes}"] * len(batch))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    text = F.expr("repeat('a', if(id = 39, 6, 1) * 1048576)")
    merged = bpe.with_merged(spark.range(0, 40, 1, 1), text, [(97, 98, 267)]).collect()
    sizes = [tuple(map(int, r["__merged"].split())) for r in merged]
    assert len(sizes) == 40 and max(rows for rows, _ in sizes) > 1
    assert max(size for _, size in sizes[:30]) <= 5 << 20 and sizes[39][1] <= 11 << 20


@pytest.mark.parametrize("name", ["F2_encode_corpus", "A20_corpus_budget", "J5_compare_tokenizers"])
def test_queries_merge_short_batches(spark, monkeypatch, tmp_path, name):
    """No batch of a registered query grows with the rows of its task, and short batches change no row."""
    n = F.col("id")
    spark.range(0, 400, 1, 1).select(
        n.alias("doc_id"), F.concat(F.lpad(n.cast("string"), 4, "0"), F.expr("repeat(' then [one of them', 500)")).alias("text"),
        F.concat(F.lit("l"), n % 3).alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    whole = load()[0][name](spark, str(tmp_path)).collect()
    seen = str(tmp_path / "sizes")

    def portions(batch, most):
        with open(seen, "a") as f:
            f.write(f"{batch.nbytes}\n")
        return [batch]

    monkeypatch.setattr(bpe, "M", SimpleNamespace(
        MergeTable=M.MergeTable, PORTION=0, BATCH=1 << 16, portions=portions, merge_framed=M.merge_framed))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    assert sorted(load()[0][name](spark, str(tmp_path)).collect()) == sorted(whole)
    with open(seen) as f:
        sizes = [int(line) for line in f]
    assert max(sizes) <= 3 << 15 and sum(sizes) > 400 * 9_000


def test_portions_use_little_memory_beside_their_text():
    """The arrays a portion is merged on take many times its size."""
    framed = pa.array([f"{chr(D)}word{n}{chr(U)} " * 40 for n in range(20_000)])
    table = M.MergeTable.of([(97, 98, 267)])
    tracemalloc.start()
    try:
        for portion in M.portions(framed, M.PORTION):
            M.merge_framed(portion, table)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_sql_functions_answer_in_portions(spark, monkeypatch):
    monkeypatch.setattr(registry, "PORTION", 100)
    made = {}
    monkeypatch.setattr(type(spark.udf), "register", lambda self, name, f, *more: made.setdefault(name, f))
    register_functions(spark, [(97, 98, 267)])
    texts = pa.array([*TEXTS, None] * 20)
    ids = list(made["bpe_encode"].func(iter([texts])))
    said = list(made["bpe_decode"].func(iter([pa.concat_arrays(ids)])))
    assert len(ids) > 20 and len(said) > 20 and pa.concat_arrays(ids).null_count == 20
    assert pa.concat_arrays(said).to_pylist() == texts.to_pylist()
