"""Metrics, spans, sampling, logs, generators and streams on small tables."""

import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tokenloom import registry
from tokenloom.functions import expressions, games, text as X
from tokenloom.functions import tokens as T
from tokenloom.operators import bpe, evaluation as E, metrics as M, synthesis
from tokenloom.plans.pretraining import packed_corpus, score_report, train_tokenizer
from tokenloom.session import scratch_path
from tokenloom.sources import records, shards
from tokenloom.streaming import corpus_stream as S

SCORE = "example_id int, option_idx int, pos int, token int, nll double, argmax int"


def test_ties_and_empty_byte_totals(spark):
    rows = [(1, 0, 0, 97, 2.0, 97), (1, 1, 0, 98, 2.0, 98), (2, 1, 0, 258, 1.0, 258), (2, 0, 0, -1, 3.0, -1)]
    scores = spark.createDataFrame(rows, SCORE)
    assert {r.example_id: r.pred for r in E.choose_option(scores).collect()} == {1: 0, 2: 1}
    got = {r.example_id: r.bpb for r in E.bits_per_byte(scores, bpe.vocab_table(spark, []), "example_id").collect()}
    assert got[2] == math.inf and abs(got[1] - 4 / (math.log(2) * 2)) < 1e-12


def test_pass_at_k(spark):
    wins = {0: 1, 1: 3, 2: None, 3: 8}
    rows = [(i, s, int(w is not None and s + 1 >= w)) for i, w in wins.items() for s in range(8)]
    out = E.pass_at_k(spark.createDataFrame(rows, "idx int, sample_idx int, is_correct int"), 8)
    assert {r.k: r.pass_at_k for r in out.collect()} == {1: .25, 2: .25, 3: .5, 4: .5, 5: .5, 6: .5, 7: .5, 8: .75}


def test_chatcore_needs_all_tasks(spark):
    rows = [(t, 1.0) for t in E.CHAT_BASELINES]
    acc = spark.createDataFrame(rows, "task string, accuracy double")
    assert E.chatcore(acc).first().chatcore == 1.0 and E.chatcore(acc.where("task <> 'MMLU'")).count() == 0


def test_few_shot_draws(spark):
    rows = [("big", i, f"q{i}") for i in range(30)] + [("tiny", i, f"t{i}") for i in range(3)] + [("lone", 0, "x")]
    items = spark.createDataFrame(rows, "task string, idx bigint, query string")
    shots = E.few_shot_examples(items, 5, fields=("idx", "query")).collect()
    for r in shots:
        picked = [s.idx for s in r.shots]
        assert r.idx not in picked and len(set(picked)) == len(picked) == min(5, {"big": 29, "tiny": 2, "lone": 0}[r.task])
    assert len(shots) == 34 and all(r.shots == [] for r in E.few_shot_examples(items, 0, fields=("idx",)).collect())


def test_spans(spark):
    rows = [("multiple_choice", [[1, 2, 3], [1, 2, 4, 5]]), ("schema", [[1, 7, 8], [2, 3, 7, 8]]), ("language_modeling", [[1, 2], [1, 2, 3]]),
            ("language_modeling", [[1, 9], [1, 2, 3]]), ("multiple_choice", [[1, 2], [1, 2]])]
    items = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, kind string, prompt_ids array<array<int>>")
    got = sorted((r.id, r.option_idx, r.span_start, r.span_end, r.reason) for r in E.continuation_spans(items, F.col("kind")).collect())
    assert got == [(0, 0, 2, 3, None), (0, 1, 2, 4, None), (1, 0, 1, 3, None), (1, 1, 2, 4, None), (2, 0, 2, 3, None),
                   (3, 0, 2, 3, "not_a_prefix"), (4, 0, 2, 2, None), (4, 1, 2, 2, None)]
    cropped = E.span_crop(E.continuation_spans(items.where("id = 1"), F.col("kind")), 2).orderBy("option_idx").collect()
    assert [(r.ids, r.span_start, r.span_end, r.reason) for r in cropped] == [([7, 8], 0, 2, None), ([7, 8], 0, 2, None)]
    tight = E.span_crop(E.continuation_spans(items.where("id = 0"), F.col("kind")), 1).where("option_idx = 1").first()
    assert tight.reason == "span_cut_off"


def test_common_lengths_over_chunks_and_options_made_once(spark):
    rng, rows = random.Random(5), [([], []), ([1], []), ([None, 1, 2], [5, 1, 3])]
    for n in (1, 63, 64, 65, 127, 128, 129, 200):
        rows += [([7] * n, [7] * n), ([7] * n, [7] * (n + 1)), ([7] * (n - 1) + [8], [7] * n), ([8] + [7] * n, [7] * n),
                 tuple([rng.choice([7, 7, 7, 7, 7, 7, 8])] * n + [rng.randint(0, 1) for _ in range(n)] for _ in range(2))]
    frame = spark.createDataFrame([(i, [list(a), list(b)]) for i, (a, b) in enumerate(rows)], "id int, prompt_ids array<array<int>>")

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if None not in (x, y) and x != y), min(len(a), len(b)))

    got = {r.id: (r.p, r.s) for r in frame.select("id", E.common_length_of(F.col("prompt_ids")).alias("p"),
                                                  E.common_length_of(F.col("prompt_ids"), suffix=True).alias("s")).collect()}
    assert got == {i: (common(a, b), common(a[::-1], b[::-1])) for i, (a, b) in enumerate(rows)}
    spans = E.continuation_spans(frame, F.lit("multiple_choice"))
    # No filter that makes the options once more to see whether there are any.
    assert "size(" not in " ".join(line for line in spans._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)
    assert sorted((r.id, r.option_idx, r.span_start, r.span_end) for r in spans.collect()) == [
        (i, o, common(*pair), len(pair[o])) for i, pair in enumerate(rows) for o in (0, 1)]
    none = spark.createDataFrame([(1, []), (2, None)], "id int, prompt_ids array<array<int>>")
    assert E.continuation_spans(none, F.lit("schema")).count() == 0


@pytest.mark.parametrize("beta", [0.5, 0.9, 0.999])
def test_ema_over_many_steps(spark, beta):
    values = [math.sin(i) + i / 500 for i in range(1500)]
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run bigint, step bigint, value double")
    got = {r.step: r.debiased for r in M.ema_debiased(log, beta).collect()}
    s = 0.0
    for i, v in enumerate(values):
        s = beta * s + (1 - beta) * v
        assert abs(got[i] - s / (1 - beta ** (i + 1))) < 1e-8


def test_report_and_csv(spark):
    rows = [("ChatCORE", "sft", "0.1", 1), ("CORE", "base", "0.2", 2), ("ARC-Easy", "mid", "0.3", 3), ("CORE", "base", "0.25", 4)]
    pivot = M.report_pivot(spark.createDataFrame(rows, "metric string, stage string, value string, pos int"), "pos")
    lines = [r.line for r in M.report_lines(pivot).orderBy("pos").collect()]
    assert lines[2].startswith("| CORE ") and "0.25" in lines[2] and lines[-1].startswith("| ChatCORE") and lines[3].count(" -  ") == 3
    res = spark.createDataFrame([("a", 0.5, 0.25), ("b", 0.75, 0.5)], "task string, accuracy double, centered double")
    out = [r.line for r in records.eval_csv_lines(res).orderBy("part", "k").collect()]
    assert out[1] == f"{'a':<35}, {0.5:<10.6f}, {0.25:<10.6f}" and out[3] == f"{'CORE':<35}, {'':<10}, {0.375:<10.6f}"
    section = spark.createDataFrame([("Base Loss", 1, "loss", "0.5", "float"), ("Base Loss", 2, "n", "12345", "int"), ("Base Loss", 3, "m", "999", "int")],
                                    "section string, pos int, key string, value string, kind string")
    assert M.section_text(section).first().text == "## Base Loss\n- loss: 0.5000\n- n: 12,345\n- m: 999\n"
    timed = M.section_text(section.withColumn("ts", F.expr("timestamp'2024-03-01 10:20:30'")), ts="ts")
    assert timed.first().text.startswith("## Base Loss\ntimestamp: 2024-03-01 10:20:30\n\n- loss")
    assert str(timed.select(X.report_timestamp(F.col("text"), "timestamp").alias("t")).first().t) == "2024-03-01 10:20:30"


def test_requests_shuffle_a_text_once_a_block(spark):
    """A block of seeds fetches a text once, however often it is drawn, and no text is shuffled after that."""
    seeds = spark.range(600).select(F.col("id").alias("seed"))
    texts = spark.range(9).select(F.col("id").alias("conv_id"), F.when(F.col("id") != 3, F.repeat(F.lit("t"), F.col("id").cast("int") + 1)).alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = synthesis.drawn_requests(seeds, texts, "<%USER_FIRST_PROMPTS%>")
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = {r.seed: r.request for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Above the join with the draws there is no exchange.
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]
    drawn = lambda s, i: int(hashlib.md5(f"starter|{s}|{i}".encode()).hexdigest()[:15], 16) % 9
    assert got == {s: "<" + "\n".join("t" * (d + 1) for d in (drawn(s, i) for i in range(5)) if d != 3) + ">" for s in range(600)}


def test_mix_plays_each_game_once(spark):
    seeds = spark.range(200).select(F.col("id").alias("seed"))
    made = registry.game_rows(seeds, "seed")
    assert sum("cell" in line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    ended = {r.seed for r in synthesis.game_dialogues(seeds).collect() if len(r.messages) % 2 == 0}
    got = {r.seed: (r.prompt, r.json) for r in made.collect()}
    made_up = {r.seed: (r.prompt, r.json) for r in registry.calculator_rows(seeds, "seed").collect()}
    assert len(got) == 200 and 0 < len(ended) < 200
    assert all(p.startswith("Tic-tac-toe") and "print(board)" in j if s in ended else (p, j) == made_up[s] for s, (p, j) in got.items())


def test_generators_are_repeatable_and_valid(spark):
    seeds = spark.range(300).select(F.col("id").alias("seed"))
    make = registry.default_generators()
    a = {r.seed: (r.prompt, r.json) for r in make.generate(seeds).collect()}
    b = {r.seed: (r.prompt, r.json) for r in make.generate(seeds.repartition(9)).collect()}
    assert a == b and len(a) == 300 and all(p and j for p, j in a.values())
    make.configure({"tic-tac-toe": 0.0})
    assert {r.source for r in make.generate(seeds).collect()} == {"calculator"} and make.list() == ["calculator", "tic-tac-toe"]
    with pytest.warns(UserWarning):
        make.configure({"chess": 1.0})
    assert all(abs(expressions.problem(s)[2]) < 1e100 for s in range(500))
    assert synthesis.expression_problems(seeds, until_valid=False).count() < 300
    for r in synthesis.game_dialogues(seeds).collect():
        moves, said, outcome = r.moves, r.messages, r.outcome
        assert 3 <= len(moves) <= 7 and len(said) == len(moves) and (len(moves) >= 5 or outcome == "")
        # No line is complete before the last move, and after it exactly when someone wins.
        for k in range(1, len(moves) + 1):
            won = [p for p, own in (("X wins", moves[0:k:2]), ("O wins", moves[1:k:2])) if any(set(line) <= set(own) for line in games.LINES)]
            assert won == ([outcome] if outcome and k == len(moves) else [])


def test_registries():
    with pytest.raises(KeyError, match="calculator"):
        registry.evaluators["chess"]
    with pytest.raises(ValueError):
        registry.register_task(registry.Task("x", "other", None, None))


def test_spelling_splits_do_not_share_seeds(spark):
    words = spark.createDataFrame([(w,) for w in ("banana", "kiwi", "straw", "berry", "fig")], "word string")
    seeds = spark.range(50).select(F.col("id").alias("idx"))
    train, test = (synthesis.spelling_bee(seeds, words, s) for s in ("train", "test"))
    row = train.where("word = 'banana' AND letter = 'a'").first() or train.first()
    parts = row.messages[1].parts
    assert parts[2].text == f"'{row.word}'.count('{row.letter}')" and parts[3].text == str(row.word.count(row.letter)) == str(row.n)
    assert train.count() == test.count() == 50
    asked = lambda df: {r.idx: r.messages[0].content for r in df.collect()}
    assert asked(train) != asked(test)


def test_tokenizer_job_and_reload(spark):
    docs = spark.createDataFrame([(i, f"sentence {i} of the (test) corpus, then more") for i in range(50)], "doc_id bigint, text string")
    out = scratch_path(spark, "tok")
    merges = train_tokenizer(docs, 267 + 20, out, max_chars=10 ** 6)
    loaded = shards.load_tokenizer(spark, out)
    assert loaded["merges"] == [m[:3] for m in merges] and loaded["n_vocab"] == 287 and loaded["markers"]
    rows = packed_corpus(docs, loaded["merges"], 32)
    whole = bpe.encode_corpus(docs, loaded["merges"], prepend=T.BOS_ID).orderBy("doc_id").collect()
    stream = [t for r in whole for t in r.ids]
    assert {r.row_id: (r.inputs, r.targets) for r in rows.collect()} == {
        k: (stream[33 * k:33 * k + 32], stream[33 * k + 1:33 * k + 33]) for k in range(len(stream) // 33)}


def test_score_report(spark):
    scores = spark.createDataFrame([(1, 0, 0, 1, 1.0, 1), (1, 1, 0, 1, 2.0, 1), (2, 0, 0, 1, 2.0, 1), (2, 1, 0, 1, 1.0, 1)], SCORE)
    gold = spark.createDataFrame([(1, "t", 0), (2, "t", 0)], "example_id int, task string, gold int")
    base = spark.createDataFrame([("t", 25.0)], "task string, baseline_pct double")
    centered, core = score_report(scores, gold, base)
    assert abs(core.first().core_metric - (0.5 - 0.25) / 0.75) < 1e-12 and centered.first().n == 2


def test_text_is_held_back_inside_a_character():
    raw, out, pending = "a🌍é".encode(), "", b""
    for i in range(len(raw)):
        text, pending = S.split_complete(pending + raw[i:i + 1])
        assert "�" not in text
        out += text
    assert out == "a🌍é" and pending == b""


def test_stream_restart_equals_one_run(spark):
    base = scratch_path(spark, "in")
    docs = spark.createDataFrame([(i, chr(65 + i % 26) * (i % 50)) for i in range(200)], "doc_id bigint, tokens string")
    out = scratch_path(spark, "packed")
    for part in range(2):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(base)
        stream = S.stream_packer(S.corpus_stream(spark, base, docs.schema), 9, lanes=3)
        S.run_to_table(stream, out, out + "-cp")
    rows = spark.read.parquet(out).collect()
    per_lane = {r.lane: r.n for r in docs.groupBy(S.lane_of("doc_id", 3).alias("lane")).agg(F.sum(F.length("tokens")).alias("n")).collect()}
    for lane, n in per_lane.items():
        mine = sorted(r.row for r in rows if r.lane == lane)
        assert mine == list(range(n // 10)) and all(len(r.ids) == 10 for r in rows)


def test_rate_stream_makes_problems(spark):
    stream = S.problem_stream(spark, 50, registry.calculator_rows)
    query = stream.writeStream.format("memory").queryName("made").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert stream.isStreaming and set(spark.table("made").columns) == {"seed", "prompt", "json", "answer"}


def test_lanes_are_sorted_across_frames(spark):
    """A lane's share of a batch comes in many Arrow frames; rows follow the order of the keys all the same."""
    rng = random.Random(2)
    base, out = scratch_path(spark, "in"), scratch_path(spark, "packed")
    data = [(i, chr(65 + i % 26) * rng.randrange(1, 9)) for i in range(700)]
    rng.shuffle(data)
    spark.createDataFrame(data, "doc_id bigint, tokens string").coalesce(1).write.parquet(base)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        stream = S.stream_packer(S.corpus_stream(spark, base, "doc_id bigint, tokens string"), 9, lanes=2, lane=F.col("doc_id") % 2)
        S.run_to_table(stream, out, out + "-cp")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = spark.read.parquet(out).collect()
    for lane in (0, 1):
        whole = "".join(t for k, t in sorted(data) if k % 2 == lane)
        got = [r.ids for r in sorted((r for r in rows if r.lane == lane), key=lambda r: r.row)]
        assert got == [[ord(c) for c in whole[i:i + 10]] for i in range(0, len(whole) // 10 * 10, 10)]


@pytest.mark.parametrize("name", ["T1_corpus_stream", "T2_stream_word_counts", "T3_stream_packer", "T5_problem_stream"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    """A table is a file or a folder of files; both give the same rows, in T3 also the same order of a lane."""
    (tmp_path / "one").mkdir()
    for table in ("documents", "events"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(60)
        rows.repartition(5).write.parquet(f"{tmp_path}/many/{table}.parquet")
        rows.toPandas().to_parquet(f"{tmp_path}/one/{table}.parquet", coerce_timestamps="us")
    one, many = (__spark_entry__.queries()[name](spark, f"{tmp_path}/{kind}") for kind in ("one", "many"))
    assert one.count() and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_puzzles_that_share_an_id(spark, tmp_path):
    """The writer keeps both contents; the list of ids names theirs once."""
    spark.createDataFrame([(0, 3314, "click"), (1, 14021, "click"), (2, 3314, "click"), (3, 1, "view")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.puzzle_id for r in __spark_entry__.queries()["S15_write_verified_puzzles"](spark, str(tmp_path)).collect()) == ["d7bb7903", "e1bf9465"]
    rows = spark.createDataFrame([("d7bb7903", "a", "[]"), ("d7bb7903", "b", "[]")], "puzzle_id string, puzzle string, solution string")
    records.write_verified_puzzles(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


class _State(dict):
    """Map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


@pytest.mark.parametrize("seed", range(6))
def test_positions_in_any_order_with_few_calls_to_the_state(seed):
    rng, n = random.Random(seed), 3000
    walk, due, blocks, got = S._Smoother(0.9), 0, set(), []
    walk.early = _State()
    order = sorted(range(n), key=lambda p: p + rng.choice([0, 0, 0, 900]) * rng.random())
    sent = order + rng.sample(order, 300)
    for at in range(0, len(sent), 500):
        frame = pd.DataFrame({"pos": sent[at:at + 500], "v": [p * 2 for p in sent[at:at + 500]]})
        for pos, values in walk.ready(frame, ["pos", "v"], due, blocks):
            got.append((pos, values))
            due = pos + 1
        assert {k for k, in walk.early} == blocks
    assert got == [(p, (p * 2,)) for p in range(n)]
    assert walk.early.calls < 120
    assert not [p for rows in walk.early.values() for p in rows[0] if p >= n]


def test_seeds_are_dealt_over_tasks_by_their_number(spark):
    rows = synthesis.dealt(spark.range(0, 10 * synthesis.SEEDS, 1, 1).withColumnRenamed("id", "seed"))
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * synthesis.SEEDS
    assert rows.distinct().count() == 10 * synthesis.SEEDS
