"""Orders, offsets, cuts, packing and mixtures, against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import tokens as T
from tokenloom.operators import corpus, packing
from tokenloom.operators.offsets import dense_index, global_offsets, integer_levels, running_value
from tokenloom.session import scratch_path
from tokenloom.sources import shards


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_offsets_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 9)) for k in rng.sample(range(-50, 5_000_000), 400)]
    df = spark.createDataFrame(rows, "k bigint, n int").repartition(parts)
    got = global_offsets(df, F.col("n"), [F.col("k")], integer_levels(F.col("k"))).select("k", "start", "end").collect()
    at, want = 0, []
    for k, n in sorted(rows):
        want.append((k, at, at + n))
        at += n
    assert sorted(map(tuple, got)) == want


def test_running_minimum_in_groups(spark):
    rng = random.Random(1)
    rows = [(g, s, rng.random()) for g in (0, 1, 2) for s in range(0, 5000, 37)]
    df = spark.createDataFrame(rows, "run bigint, step bigint, v double")
    got = running_value(df, F.col("v"), [F.col("step")], integer_levels(F.col("step"), 16), "min", ["run"], "best", "before")
    best = {}
    want = {}
    for g, s, v in sorted(rows):
        want[g, s] = (min(best.get(g, 9), v), best.get(g))
        best[g] = want[g, s][0]
    assert {(r.run, r.step): (r.best, r.before) for r in got.collect()} == want


def plain_cut(chars, docs, limit, group):
    shard, acc, out, closed = 0, 0, [], set()
    for b, (c, d) in enumerate(zip(chars, docs)):
        acc += c
        out.append(shard)
        if acc >= limit and d == group:
            closed.add(shard)
            shard, acc = shard + 1, 0
    return {b: (s, s in closed) for b, s in enumerate(out)}


@pytest.mark.parametrize("seed", range(6))
def test_greedy_cut_equals_the_plain_walk(spark, seed):
    rng = random.Random(seed)
    n = [1, 7, 40, 300, 120, 64][seed]
    sizes = [rng.choice([0, 0, 1, 5, 10, 900]) if seed % 2 else rng.randint(1, 12) for _ in range(n)]
    full = [8] * (n - 1) + [rng.choice([8, 3])]
    blocks = spark.createDataFrame([(b, c, d) for b, (c, d) in enumerate(zip(sizes, full))], "block bigint, chars bigint, docs bigint")
    limit = [5, 20, 25, 30, 1000, 1][seed]
    got = {r.block: (r.shard, r.closed) for r in corpus.greedy_shards(blocks, limit, 8).collect()}
    assert got == plain_cut(sizes, full, limit, 8)


def test_repackaging_keeps_every_document_and_can_drop_the_tail(spark):
    rows = [(i, "x" * (i % 17)) for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = scratch_path(spark, "re")
    shards.repackage_corpus(docs, out, 300, 10)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == sorted(t for _, t in rows)
    kept = shards.assign_shards(docs, 300, 10, 42, drop_tail=True)
    whole = shards.assign_shards(docs, 300, 10, 42)
    assert kept.count() < whole.count() and kept.agg(F.max("shard")).first()[0] == whole.agg(F.max("shard")).first()[0] - 1


def test_splits_and_strides(spark):
    out = scratch_path(spark, "dir")
    for f in range(3):
        (spark.createDataFrame([(f * 10 + i, str(f * 10 + i)) for i in range([10, 10, 3][f])], "n int, text string").coalesce(1)
         .write.parquet(f"{out}/shard={f}"))
    val = [r.n for r in shards.read_corpus(spark, out, "val", ("n",)).collect()]
    train = [r.n for r in shards.read_corpus(spark, out, "train", ("n",)).collect()]
    assert sorted(val) == [20, 21, 22] and sorted(train) == list(range(20))
    got = sorted(r.n for r in shards.strided_scan(spark, out, 1, 2, 4, ("n",)).collect())
    assert got == [4, 5, 6, 7, 14, 15, 16, 17]
    assert shards.shard_catalog(spark, out).count() == 3
    with pytest.raises(ValueError):
        shards.read_corpus(spark, out, "test")


def test_budget_keeps_the_crossing_document(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "doc_id bigint, text string")
    ids = lambda limit: sorted(r.doc_id for r in corpus.char_budget(docs, limit).collect())
    assert ids(29) == [0, 1, 2] and ids(30) == [0, 1, 2, 3] and len(ids(1000)) == 10


@pytest.mark.parametrize("width", [2, 5, 64])
def test_packing_loses_nothing(spark, width):
    rng = random.Random(width)
    docs = [(k, [258] + [rng.randint(0, 300) for _ in range(rng.choice([0, 1, 4, 33, 200]))]) for k in range(60)]
    stream = [t for _, ids in docs for t in ids]
    want = {r: stream[r * width:(r + 1) * width] for r in range(len(stream) // width)}
    strings = spark.createDataFrame([(k, "".join(map(T.token_char, ids))) for k, ids in docs], "doc_id bigint, tokens string").repartition(3)
    got = packing.cut_stream(strings, width).select("row_id", T.token_string_ids(F.col("tokens")).alias("ids"))
    assert {r.row_id: r.ids for r in got.collect()} == want
    arrays = spark.createDataFrame(docs, "doc_id bigint, ids array<int>").repartition(5)
    assert {r.row_id: r.ids for r in packing.cut_arrays(arrays, width).collect()} == want


def test_flat_batches(spark):
    stream = list(range(100))
    docs = spark.createDataFrame([(0, "".join(map(chr, stream)))], "doc_id bigint, tokens string")
    rows = sorted(packing.pack_flat(docs, 2, 8).collect())
    assert [(r.batch, r.b) for r in rows] == [(k, b) for k in range(5) for b in range(2)]
    assert rows[3].inputs == stream[25:33] and rows[3].targets == stream[26:34]


def test_shift_and_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [0, 0, 1]), (1, [7], [0])], "idx int, ids array<int>, mask array<int>")
    inputs, targets = packing.shift_targets(F.col("ids"), F.col("mask"))
    rows = sorted(df.select("idx", inputs.alias("i"), targets.alias("t")).collect())
    assert rows[0].i == [1, 2] and rows[0].t == [-1, 3] and rows[1].i == [] and rows[1].t == []
    right = {r.idx: r.ids for r in packing.pad_batch(df, 2, 0).collect()}
    left = {r.idx: r.ids for r in packing.pad_batch(df, 2, 0, left=True).collect()}
    assert right == {0: [1, 2, 3], 1: [7, 0, 0]} and left == {0: [1, 2, 3], 1: [0, 0, 7]}


def test_slices_mixtures_and_sequences(spark):
    task = spark.range(20).select(F.col("id").alias("idx"), F.col("id").alias("v"))
    assert sorted(map(tuple, corpus.slice_task(task, 5, 10).collect())) == [(i, 5 + i) for i in range(5)]
    assert corpus.slice_task(task, 3, 100, 4).count() == 5
    with pytest.raises(ValueError):
        corpus.slice_task(task, -1)
    small = task.where("idx < 4")
    mixed = corpus.mixture([task, small, small]).collect()
    assert sorted(r.idx for r in mixed) == list(range(28))
    again = {(r.task_idx, r.local_idx): r.idx for r in corpus.mixture([task.repartition(7), small, small]).collect()}
    assert {(r.task_idx, r.local_idx): r.idx for r in mixed} == again
    chained = sorted((r.idx, r.v) for r in corpus.task_sequence([small, task]).collect())
    assert [v for _, v in chained] == [0, 1, 2, 3] + list(range(20))


def test_weights_and_caps(spark):
    rows = spark.range(6000).select("id", corpus.weighted_source({"a": 1, "b": 0.5, "c": 0}, F.col("id")).alias("s"))
    counts = {r.s: r["count"] for r in rows.groupBy("s").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] / 6000 - 2 / 3) < 0.03
    items = spark.range(100).select(F.when(F.col("id") < 90, "hot").otherwise("cold").alias("task"), F.col("id").alias("idx"))
    capped = {r.task: r["count"] for r in corpus.cap_per_task(items, 7).groupBy("task").count().collect()}
    assert capped == {"hot": 7, "cold": 7} and corpus.cap_per_task(items, 0).count() == 100


def test_dense_index_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("k"))
    got = dense_index(rows, [F.col("k")], integer_levels(F.col("k"), 32), ["g"]).where("g = 'hot'").collect()
    assert {r.k: r.idx for r in got} == {3 * i: i for i in range(1000)}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_offsets_of_null_sparse_and_mixed_keys(spark, partitions):
    rng = random.Random(9)
    keys = [None] + list(range(300)) + [rng.randrange(-2**63, 2**63) for _ in range(300)] + [2**63 - 1, -2**63]
    rows = [(k, rng.randrange(50)) for k in keys]
    df = spark.createDataFrame(rows, "k bigint, n int").repartition(partitions)
    got = {r.k: (r.start, r.end) for r in global_offsets(df, F.col("n"), [F.col("k")], integer_levels(F.col("k"), 64)).collect()}
    at, want = 0, {}
    for k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want[k] = (at, at + n)
        at += n
    assert got == want
    grouped = spark.createDataFrame([(g, k) for g in (None, "a") for k in (3, 1, None)], "g string, k bigint")
    assert sorted((str(r.g), str(r.k), r.idx) for r in dense_index(grouped, [F.col("k")], integer_levels(F.col("k")), ["g"]).collect()) == sorted(
        (str(g), str(k), i) for g in (None, "a") for i, k in enumerate((None, 1, 3)))


def test_strided_scan_reads_no_other_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "groups")
    rows = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    rows.write.option("parquet.block.row.count.limit", 10).parquet(path)
    file = next((tmp_path / "groups").glob("part-*.parquet"))
    wanted = [i for i in range(100) if i // 10 % 3 == 1]
    data, meta = bytearray(file.read_bytes()), pq.ParquetFile(file).metadata
    assert meta.num_row_groups == 10
    for g in range(10):
        if g % 3 != 1:   # the bytes of the groups that are left out are spoilt
            for c in range(2):
                column = meta.row_group(g).column(c)
                at = column.dictionary_page_offset or column.data_page_offset
                data[at:at + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    file.write_bytes(bytes(data))
    (tmp_path / "groups" / f".{file.name}.crc").unlink(missing_ok=True)
    got = shards.strided_scan(spark, path, 1, 3, 10, ("text", "id"))
    assert got.columns == ["text", "id"] and sorted(r.id for r in got.collect()) == wanted
    # Row groups that hold parts of several groups of rows.
    assert sorted(r.id for r in shards.strided_scan(spark, path, 1, 3, 10, ("id",)).collect()) == wanted
    whole = str(tmp_path / "whole")
    rows.write.parquet(whole)
    assert sorted(r.id for r in shards.strided_scan(spark, whole, 2, 4, 7, ("id",)).collect()) == [i for i in range(100) if i // 7 % 4 == 2]


@pytest.mark.parametrize("stretch", [1, 3, 7, 1 << 16])
def test_walk_by_stretches(spark, monkeypatch, stretch):
    from tokenloom.operators import corpus as C

    monkeypatch.setattr(C, "STRETCH", stretch)
    rng = random.Random(stretch)
    for n in (0, 1, 40):
        jump = {i: i + rng.randint(1, 6) for i in range(n) if rng.random() > 0.02}
        want, at = {0}, 0
        while at in jump:
            at = jump[at]
            want.add(at)
        table = spark.createDataFrame(list(jump.items()), "block long, next long")
        assert sorted(r.start for r in C._reached(table).collect()) == sorted(want)


def test_stream_rows_across_many_tasks(spark):
    """Rows that lie over several documents and tasks, null and empty texts, ties; every width once."""
    from tokenloom.operators.packing import cut_stream

    rng = random.Random(3)
    data = [(rng.randrange(60) if i % 17 else None, "".join(rng.choices("abcdefgĀ\U0001f600", k=rng.choice([0, 1, 5, 40])))) for i in range(200)]
    data = [(k, t, i) for i, (k, t) in enumerate(data)] + [(5, None, 900)]
    docs = spark.createDataFrame(data, "doc_id long, tokens string, tie long").repartition(9)
    whole = "".join(t or "" for _, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[2])))
    for width in (1, 7, 300):
        rows = cut_stream(docs, width, order=[F.col("doc_id"), F.col("tie")], levels=integer_levels(F.col("doc_id"), 6)).collect()
        assert {r.row_id: r.tokens for r in rows} == {i: whole[i * width:(i + 1) * width] for i in range(len(whole) // width)}
        assert len(rows) == len(whole) // width
    assert cut_stream(docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("how", ["sum", "min", "max"])
def test_running_values_of_groups_over_tasks(spark, how):
    rng = random.Random(how)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.randint(-9, 9)])) for k in range(300)]
    for kind in ("bigint", "double"):
        df = spark.createDataFrame([(g, k, None if v is None else (float(v) if kind == "double" else v)) for g, k, v in rows], f"g string, k long, v {kind}").repartition(5)
        got = {(r.g, r.k): (r.running, r.up) for r in running_value(df, F.col("v"), [F.col("k")], integer_levels(F.col("k"), 11), how, ["g"], before="up").collect()}
        for g in ("a", "b", None):
            seen = []
            for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                fold = lambda x: (sum(x) if how == "sum" else min(x) if how == "min" else max(x)) if x else (0 if how == "sum" else None)
                before = fold(seen)
                seen += [v] if v is not None else []
                assert got[g, k] == (fold(seen), before)


def test_running_minimum_of_times(spark):
    from datetime import datetime, timedelta

    times = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (50, 70, 20, 90)]
    df = spark.createDataFrame(list(enumerate(times)), "k long, t timestamp")
    got = [r.running for r in running_value(df, F.col("t"), [F.col("k")], how="min").orderBy("k").collect()]
    assert got == [times[0], times[0], times[2], times[2]]
