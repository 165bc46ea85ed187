"""Conversation rules, rendering and parsed texts on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import chat, fuzzy, text
from tokenloom.functions import tokens as T
from tokenloom.functions.arith import calculator_kind, calculator_result, evaluate, evaluate_math
from tokenloom.operators import conversations as C
from tokenloom.operators import puzzles
from tokenloom.session import scratch_path
from tokenloom.sources import records

U, A, S = "user", "assistant", "system"


def chats(spark, *convs):
    rows = [(i, [(r, c, None) if isinstance(c, (str, type(None))) else (r, None, c) for r, c in conv]) for i, conv in enumerate(convs)]
    return spark.createDataFrame(rows, f"id int, messages {chat.MESSAGES_TYPE}")


def reasons(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


def test_validation_reasons(spark):
    rows = chats(spark, [(U, "a"), (A, "b")], [(S, "s"), (U, "a"), (A, "b")], [(S, "s"), (U, "a")], [(U, "a"), (U, "b")],
                 [(U, "a"), (A, None)], [], [(A, "x"), (U, "y")])
    assert reasons(rows, chat.validation_reason(F.col("messages"))) == [
        None, None, "too_few_messages", "bad_role_order", "missing_content", "no_messages", "bad_role_order"]
    assert reasons(rows, chat.validation_reason(F.col("messages"), allow_system=False))[1] == "bad_role_order"


def test_chat_limits_first_rule_wins(spark):
    long, edge = "x" * 8001, "x" * 8000
    rows = chats(spark, [(U, "a")], [], [(U, "a")] * 501, [(U, "a")] * 500, [(U, ""), (A, long)], [(U, long), (A, "")], [(U, edge)] * 4,
                 [(U, edge)] * 4 + [(A, "y")], [(S, "a")], [(U, edge)] * 5 + [(S, "a")])
    assert reasons(rows, chat.chat_limit_reason(F.col("messages"))) == [
        None, "no_messages", "too_many_messages", None, "empty_content", "message_too_long", None, "conversation_too_long", "invalid_role",
        "conversation_too_long"]


def test_long_conversations_are_gathered(spark):
    turns = spark.createDataFrame([(1, 0, U, "x" * 500_000), (1, 1, A, "y" * 500_000), (2, 0, U, "z")], "conv_id bigint, turn bigint, role string, text string")
    assert {r.conv_id: len(r.messages) for r in C.conversations_from_turns(turns).collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("merges", [0, 9, 10, 60])
def test_rendering_decodes_back_with_any_vocabulary(spark, merges):
    from tokenloom.operators import bpe

    chats_ = C.conversations_from_turns(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    words = bpe.word_counts(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    learned = [m[:3] for m in bpe.bpe_train(words, 267 + merges)] if merges else []
    valid, _ = C.validate_conversations(C.merge_system_message(chats_)[0], 1)
    for markers in (True, False):
        out = C.render_conversations(valid, learned, markers, 10**6)
        back = {r.conv_id: r for r in bpe.decode_corpus(out, learned).collect()}
        for r in valid.collect():
            want = "<|bos|>" + "".join(f"<|{m.role}_start|>{m.content}<|{m.role}_end|>" for m in r.messages)
            got = back[r.conv_id]
            assert got.text == want and len(got.ids) == len(got.mask)
            # Supervised are the replies and their end marks.
            at = [i for i, t in enumerate(got.ids) if t == 261]
            assert all(got.mask[i] == 0 and got.mask[i + 1] == 1 for i in at) and got.mask[0] == 0


def test_a_null_part_does_not_shift_the_rest(spark):
    rows = chats(spark, [(U, "ab"), (A, [("text", None), ("text", "cd")])])
    assert C.render_conversations(rows, markers=False).first().ids == [258, 259, 97, 98, 260, 261, 99, 100, 262]


def test_rendering_with_tools_and_masks(spark):
    parts = [("text", "hi "), ("python", "1+1"), ("python_output", "2"), ("text", "")]
    rows = chats(spark, [(S, "be"), (U, "ab"), (A, parts)], [(U, "ab"), (A, "ab")])
    merged, bad = C.merge_system_message(rows)
    assert bad.count() == 0
    out = {r.id: r for r in C.render_conversations(merged, [(97, 98, 267)], markers=False).collect()}
    assert out[0].ids == [258, 259, *b"be\n\n", 267, 260, 261, *b"hi ", 263, *b"1+1", 264, 265, *b"2", 266, 262]
    assert list(out[0].mask) == [0] * 8 + [0] + [1] * 8 + [0] * 3 + [1]
    assert out[1].ids == [258, 259, 267, 260, 261, 267, 262] and list(out[1].mask) == [0, 0, 0, 0, 0, 1, 1]
    marked = {r.id: r.ids for r in C.render_conversations(merged.where("id = 1"), [(97, 98, 267)]).collect()}
    assert marked[1] == [258, 259, 256, 267, 260, 261, 256, 267, 262]
    prompt = C.render_for_completion(rows.where("id = 1"), markers=False).first()
    assert prompt.ids == [258, 259, 97, 98, 260, 261]
    short = C.render_conversations(merged, markers=False, max_tokens=5).first()
    assert len(short.ids) == 5 and len(short.mask) == 5


def test_system_without_user_is_rejected(spark):
    _, bad = C.merge_system_message(chats(spark, [(S, "a"), (A, "b")]))
    assert bad.first().reason == "system_without_user"


def test_jsonl_reader(spark):
    path = scratch_path(spark, "jsonl")
    lines = ['[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]', "  ", '[{"role":"user","content":"a"}]',
             '[{"role":"assistant","content":"a"},{"role":"user","content":"b"}]', '[{"role":"user","content":1},{"role":"assistant","content":"b"}]', "nonsense"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = records.read_conversations_jsonl(spark, path)
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["bad_role_order", "missing_content", "not_an_array", "too_few_messages"]


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("said, want", [("so #### -1,234.5 #### 2", "-1234.5"), ("####5", None), ("#### ,", ""), (None, None)])
def test_answers(spark, said, want):
    assert one(spark, text.extract_answer(F.col("s")), s=said) == want


def test_tool_parts_keep_empty_pieces(spark):
    got = one(spark, text.tool_parts(F.col("s")), s="a<<12/60=0.2>><<x>>b<<a=b=c>>")
    assert [(p.type, p.text) for p in got] == [
        ("text", "a"), ("python", "12/60"), ("python_output", "0.2"), ("text", ""), ("python", "x"), ("python_output", ""), ("text", "b"),
        ("python", "a=b"), ("python_output", "c"), ("text", "")]


@pytest.mark.parametrize("raw, want", [('[{"a":1}]', '[{"a":1}]'), ("x [1, 2] y", "[1,2]"), ('{"a":1}', None), ("no", None), ("[1", None), ('"s"', None)])
def test_salvage(spark, raw, want):
    assert one(spark, text.json_array_salvage(F.col("s")), s=raw) == want


def test_programs(spark):
    said = "x\n```python\nf()\n```\n```\ng()\n```"
    assert one(spark, text.extract_program(F.col("s")), s=said) == "f()"
    assert one(spark, text.leading_imports(F.col("s")), s="# c\nimport a\n\nfrom b import c\nx = 1\nimport d") == "import a\nfrom b import c"


def test_evaluators(spark):
    p = one(spark, text.calc_parse(F.col("s")), s='Calculate 5 + 3? # Answer: "8.0"')
    assert (p.prompt, p.expected) == ("Calculate 5 + 3?", "8.0")
    assert one(spark, text.calc_parse(F.col("s")), s="no quotes?").expected is None
    score = lambda e, s: one(spark, fuzzy.calc_score(F.col("e"), F.col("s")), e=e, s=s)
    assert score("8.0", 'blah "8.0" blah').corr == 1 and score("8.0", 'blah "8" x').corr == 1 and score("8.0", 'b "2*4" x').corr == 1
    assert score("8.0", 'blah "5.0" blah').corr == 0 and score("8.0", "none").score == 0.0
    g = one(spark, text.game_parse(F.col("s")), s="Tic-tac-toe. I play center.<|python_start|>board[1][1]=X<|python_end|>")
    assert g.prompt == "Tic-tac-toe. I play center." and g.expected.startswith("<|python_start|>")
    good = "<|python_start|>board[1][1]=X\nprint(board)<|python_end|><|output_start|>board<|output_end|>"
    assert one(spark, text.game_score(F.col("e"), F.col("s")), e=g.expected, s=good).corr == 1


def test_calculator(spark):
    cases = {"1,000*2": "2000", "2**3": None, "7//2": "3", "1/0": None, "'straw'.count('r')": "1", "\"aXa\".count('a')": "2", "('abc').count('c')": "1",
             "__import__('os').count('a')": None, "abs(1)": None, "'a'.upper()": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "e string").select("e", calculator_result(F.col("e")).alias("r"), calculator_kind(F.col("e")).alias("k"))
    assert {r.e: r.r for r in rows.collect()} == cases
    maths = spark.createDataFrame([("log(e)",), ("sqrt(4) + pi * 0",), ("nope(1)",), ("1/0",)], "e string")
    got = [r[0] for r in maths.select(evaluate_math(F.col("e"))).collect()]
    assert got[:2] == [1.0, 2.0] and got[2] != got[2] and got[3] != got[3]
    assert evaluate("__import__('os')", True) is None


def test_puzzles(spark):
    states = spark.createDataFrame([("a", {"f": "x"}, {"f": "x", "g": "y"}), ("b", {"f": "x"}, {}), ("c", {"f": "hello world " * 20}, {"f": "hello world " * 20 + "!"}),
                                    ("d", {}, {}), ("e", {"f": "abc"}, {"f": "xyz"})], "puzzle_id string, goal map<string,string>, actual map<string,string>")
    exact = {r.puzzle_id: r.score for r in puzzles.goal_scores(states).collect()}
    loose = {r.puzzle_id: r.score for r in puzzles.goal_scores(states, 98).collect()}
    assert exact == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 0} and loose == {**exact, "c": 1}
    calls = spark.createDataFrame([(1, "mv", {"src": "a", "dst": "b", "x": "y"}), (2, "mv", {"src": "a"}), (3, "zap", {}), (4, None, {})],
                                  "id int, tool string, args map<string,string>")
    catalogue = spark.createDataFrame([("mv", "mv {src} {dst}")], "name string, template string")
    assert {r.id: r.error for r in puzzles.check_tool_calls(calls, catalogue).collect()} == {
        1: None, 2: "missing_argument", 3: "unknown_tool", 4: "missing_type"}
    replies = spark.createDataFrame([('ok [{"type":"mv","source":"a","dest":"b"}]',), ("none",)], "raw string")
    got = [r.calls for r in puzzles.parse_solutions(replies).collect()]
    assert got == [[{"type": "mv", "src": "a", "dst": "b"}], None]
