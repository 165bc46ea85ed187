"""Queries on evaluation requests and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.common import SQL_WORD, query, sql_byte_list, sql_draw, table
from tokenloom.functions import text as X
from tokenloom.functions import tokens as T
from tokenloom.functions.draws import draw_bits
from tokenloom.operators import bpe
from tokenloom.operators import evaluation as E
from tokenloom.operators.offsets import dense_index, integer_levels

# The score table: every word of a document stands for one scored token; losses are hash
# draws in steps of 1/1024, so sums are exact in both engines.
SCORES = f"""w0 AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{SQL_WORD}') AS ws FROM documents),
 w AS (SELECT doc_id, lang, source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w0),
 sc0 AS (SELECT doc_id AS example_id, lang, source AS task, (p % 4)::INTEGER AS option_idx, (p // 4)::INTEGER AS pos,
   (CASE WHEN p % 13 = 5 THEN -1 WHEN p % 17 = 3 THEN 258 WHEN p % 5 = 0 THEN 267 + unicode(word) % 4 ELSE unicode(word) % 256 END)::INTEGER AS token,
   {sql_draw("'nll'", 'doc_id', 'p')} AS u FROM w),
 sc AS (SELECT *, (u % 8192) / 1024.0::DOUBLE AS nll, CASE WHEN u % 1000 < 996 THEN token ELSE token + 1 END AS argmax FROM sc0)"""


def scores(spark, sf):
    docs = bpe.spread(table(spark, sf, "documents"), "doc_id")
    words = docs.select("doc_id", "lang", "source", F.posexplode(
        F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("p", "word"))
    p, point = F.col("p"), F.ascii("word")
    token = (F.when(p % 13 == 5, -1).when(p % 17 == 3, 258).when(p % 5 == 0, 267 + point % 4).otherwise(point % 256))
    base = words.select(F.col("doc_id").alias("example_id"), "lang", F.col("source").alias("task"), (p % 4).alias("option_idx"),
                        F.floor(p / 4).cast("int").alias("pos"), token.cast("int").alias("token"), draw_bits("nll", F.col("doc_id"), p).alias("u"))
    return base.select("*", ((F.col("u") % 8192) / 1024.0).alias("nll"),
                       F.when(F.col("u") % 1000 < 996, F.col("token")).otherwise(F.col("token") + 1).alias("argmax"))


# th, er, the, on
GIVEN = [(116, 104, 267), (101, 114, 268), (267, 101, 269), (111, 110, 270)]
VOCAB = """v AS (SELECT i::INTEGER AS id, CASE WHEN i < 256 THEN 1 WHEN i < 267 THEN 0 WHEN i = 269 THEN 3 ELSE 2 END AS n_bytes,
  CASE WHEN i < 256 THEN 'byte' WHEN i < 258 THEN 'marker' WHEN i < 267 THEN 'special' ELSE 'merge' END AS kind FROM range(271) t(i))"""


@query("F4_vocab_table", f"""WITH {VOCAB} SELECT id, kind, n_bytes::INTEGER AS n_bytes, CASE WHEN id < 256 THEN printf('%02X', id) WHEN id = 256 THEN 'E28698' WHEN id = 257 THEN 'E28697'
   WHEN id < 267 THEN hex(encode((['<|bos|>','<|user_start|>','<|user_end|>','<|assistant_start|>','<|assistant_end|>','<|python_start|>','<|python_end|>','<|output_start|>','<|output_end|>'])[id - 257]))
   ELSE hex(encode((['th', 'er', 'the', 'on'])[id - 266])) END AS hexed FROM v""")
def f4(spark, sf):
    """The merges come from the corpus: the pairs of the given table, looked up among its pair counts."""
    known = bpe.pair_counts(bpe.word_counts(bpe.spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")))
    firsts = [m for m in GIVEN if m[0] < 256 and m[1] < 256]
    found = known.join(spark.createDataFrame(firsts, "a int, b int, id int"), ["a", "b"]).select("a", "b", "id")
    merges = bpe.merge_list(found) + [m for m in GIVEN if m not in firsts]
    return bpe.vocab_table(spark, merges).select("id", "kind", "n_bytes", F.hex("bytes").alias("hexed"))


_SEEN = "seen AS (SELECT DISTINCT token AS id FROM sc)"


@query("A4_token_bytes_stats", f"""WITH {SCORES}, {VOCAB}, {_SEEN}, u AS (SELECT v.* FROM v JOIN seen USING (id))
  SELECT count(*) FILTER (kind = 'special')::BIGINT AS num_special_tokens, min(n_bytes) FILTER (n_bytes > 0)::INTEGER AS token_bytes_min, max(n_bytes)::INTEGER AS token_bytes_max,
   round(avg(n_bytes) FILTER (n_bytes > 0), 6) AS token_bytes_mean, round(stddev_samp(n_bytes) FILTER (n_bytes > 0), 6) AS token_bytes_std FROM u""")
def a4(spark, sf):
    """Statistics of the tokens that occur in the score table."""
    seen = scores(spark, sf).select(F.col("token").alias("id")).distinct()
    stats = bpe.token_bytes_stats(bpe.vocab_table(spark, GIVEN).join(seen, "id"))
    return stats.withColumn("token_bytes_mean", F.round("token_bytes_mean", 6)).withColumn("token_bytes_std", F.round("token_bytes_std", 6))


@query("S12_token_bytes_table", f"WITH {SCORES}, {VOCAB}, {_SEEN} SELECT v.id, n_bytes::INTEGER AS n_bytes FROM v JOIN seen USING (id)")
def s12(spark, sf):
    from tokenloom.session import scratch_path
    from tokenloom.sources import shards

    seen = scores(spark, sf).select(F.col("token").alias("id")).distinct()
    path = scratch_path(spark, "token-bytes")
    shards.write_token_bytes(bpe.vocab_table(spark, GIVEN).join(seen, "id"), path)
    return spark.read.parquet(path)


@query("J1_token_byte_lengths", f"""WITH {SCORES}, {VOCAB} SELECT example_id, count(*)::BIGINT AS tokens, sum(coalesce(n_bytes, 0))::BIGINT AS bytes
  FROM sc LEFT JOIN v ON v.id = sc.token GROUP BY 1""")
def j1(spark, sf):
    joined = E.attach_token_bytes(scores(spark, sf), bpe.vocab_table(spark, GIVEN))
    return joined.groupBy("example_id").agg(F.count("*").alias("tokens"), F.sum("n_bytes").alias("bytes"))


@query("A6_bits_per_byte", f"""WITH {SCORES}, {VOCAB}, s AS (SELECT lang, sum(CASE WHEN n_bytes > 0 THEN nll ELSE 0 END) AS total_nats, sum(coalesce(n_bytes, 0))::BIGINT AS total_bytes
  FROM sc LEFT JOIN v ON v.id = sc.token GROUP BY 1) SELECT lang, total_nats, total_bytes, total_nats / (ln(2.0::DOUBLE) * total_bytes) AS bpb FROM s""")
def a6(spark, sf):
    return E.bits_per_byte(scores(spark, sf), bpe.vocab_table(spark, GIVEN), "lang")


_CHOSEN = """mean AS (SELECT example_id, option_idx, avg(nll) AS mean_nll FROM sc GROUP BY 1, 2),
  chosen AS (SELECT example_id, option_idx AS pred, mean_nll FROM mean QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY mean_nll, option_idx) = 1)"""


@query("A7_choose_option", f"WITH {SCORES}, {_CHOSEN} SELECT example_id, pred, mean_nll FROM chosen")
def a7(spark, sf):
    return E.choose_option(scores(spark, sf))


@query("A8_exact_continuation", f"WITH {SCORES} SELECT example_id, bool_and(argmax = token)::INTEGER AS correct FROM sc GROUP BY 1")
def a8(spark, sf):
    return E.exact_continuation(scores(spark, sf))


_GOLD = "graded AS (SELECT c.example_id, d.source AS task, d.lang AS subject, (c.pred = 2 * l.quality + l.toxic)::INTEGER AS correct FROM chosen c JOIN labels l ON l.doc_id = c.example_id JOIN documents d ON d.doc_id = c.example_id)"


def graded(spark, sf):
    chosen = E.choose_option(scores(spark, sf))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), (2 * F.col("quality") + F.col("toxic")).alias("gold"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.col("source").alias("task"), F.col("lang").alias("subject"))
    return chosen.join(labels, "example_id").join(docs, "example_id").withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))


@query("A9_task_accuracy", f"WITH {SCORES}, {_CHOSEN}, {_GOLD} SELECT task, avg(correct) AS accuracy, count(*)::BIGINT AS n FROM graded GROUP BY 1")
def a9(spark, sf):
    return E.task_accuracy(graded(spark, sf))


@query("A18_accuracy_by_subject", f"WITH {SCORES}, {_CHOSEN}, {_GOLD} SELECT task, subject, avg(correct) AS accuracy, count(*)::BIGINT AS n FROM graded GROUP BY ROLLUP (task, subject)")
def a18(spark, sf):
    return E.accuracy_by_subject(graded(spark, sf))


_BASE = f"base AS (SELECT DISTINCT source AS task, (25.0 * ({sql_draw(chr(39) + 'base' + chr(39), 'source')} % 3))::DOUBLE AS baseline_pct FROM documents)"
_CENTERED = f"""acc AS (SELECT task, avg(correct) AS accuracy, count(*)::BIGINT AS n FROM graded GROUP BY 1), {_BASE},
  cen AS (SELECT acc.*, baseline_pct, (accuracy - 0.01::DOUBLE * baseline_pct) / (1.0::DOUBLE - 0.01::DOUBLE * baseline_pct) AS centered FROM acc JOIN base USING (task))"""


def centered(spark, sf):
    base = table(spark, sf, "documents").select(F.col("source").alias("task")).distinct().withColumn(
        "baseline_pct", (draw_bits("base", F.col("task")) % 3) * 25.0)
    return E.centered_accuracy(E.task_accuracy(graded(spark, sf)), base)


@query("J4_centered_accuracy", f"WITH {SCORES}, {_CHOSEN}, {_GOLD}, {_CENTERED} SELECT task, accuracy, n, baseline_pct, round(centered, 9) AS centered FROM cen")
def j4(spark, sf):
    return centered(spark, sf).withColumn("centered", F.round("centered", 9))


@query("A10_core_metric", f"WITH {SCORES}, {_CHOSEN}, {_GOLD}, {_CENTERED} SELECT round(avg(centered), 6) AS core_metric FROM cen")
def a10(spark, sf):
    return E.core_metric(centered(spark, sf)).select(F.round("core_metric", 6).alias("core_metric"))


_CHAT = "(['ARC-Easy', 'ARC-Challenge', 'MMLU', 'GSM8K', 'HumanEval', 'SpellingBee'])[1 + doc_id % 6]"


@query("A11_chatcore", f"""WITH a AS (SELECT {_CHAT} AS task, avg(quality) AS accuracy FROM labels GROUP BY 1),
  c AS (SELECT task, CASE WHEN task IN ('GSM8K', 'HumanEval', 'SpellingBee') THEN accuracy ELSE (accuracy - 0.25) / 0.75 END AS centered FROM a)
  SELECT round(avg(centered), 6) AS chatcore FROM c HAVING count(*) = 6""")
def a11(spark, sf):
    names = F.array(*[F.lit(t) for t in E.CHAT_BASELINES])
    rows = table(spark, sf, "labels").select(F.get(names, F.col("doc_id") % 6).alias("task"), F.col("quality").alias("correct"))
    return E.chatcore(E.task_accuracy(rows)).select(F.round("chatcore", 6).alias("chatcore"))


_OUT = "o AS (SELECT doc_id // 8 AS idx, (doc_id % 8)::INTEGER AS sample_idx, quality AS is_correct FROM labels)"


def outcomes(spark, sf):
    return table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 8).alias("idx"), (F.col("doc_id") % 8).cast("int").alias("sample_idx"),
                                             F.col("quality").alias("is_correct"))


@query("A12_any_pass", f"WITH {_OUT} SELECT idx, max(is_correct)::INTEGER AS passed FROM o GROUP BY 1")
def a12(spark, sf):
    return E.any_pass(outcomes(spark, sf))


@query("A13_pass_at_k", f"""WITH {_OUT}, f AS (SELECT idx, min(sample_idx) FILTER (is_correct = 1) AS first FROM o GROUP BY 1)
  SELECT k::INTEGER AS k, avg(CASE WHEN first < k THEN 1 ELSE 0 END) AS pass_at_k FROM f, range(1, 9) t(k) GROUP BY 1""")
def a13(spark, sf):
    return E.pass_at_k(outcomes(spark, sf), 8)


@query("A14_advantages", f"WITH {_OUT} SELECT idx, sample_idx, round(is_correct - avg(is_correct) OVER (PARTITION BY idx), 9) AS advantage FROM o")
def a14(spark, sf):
    rows = outcomes(spark, sf).withColumn("reward", F.col("is_correct").cast("double"))
    return E.advantages(rows, "idx").select("idx", "sample_idx", F.round("advantage", 9).alias("advantage"))


@query("A15_rollout_summary", """WITH r AS (SELECT l.doc_id // 8 AS e, l.quality AS reward, d.n_chars AS length FROM labels l JOIN documents d USING (doc_id)),
  p AS (SELECT e, avg(reward) AS r, sum(length) AS l, count(*) AS n FROM r GROUP BY 1) SELECT round(avg(r), 6) AS mean_reward, round(sum(l) / sum(n), 6) AS mean_sequence_length FROM p""")
def a15(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"))
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.floor(F.col("doc_id") / 8).alias("example_id"), F.col("quality").cast("double").alias("reward"), "length")
    out = E.rollout_summary(rows)
    return out.select(F.round("mean_reward", 6).alias("mean_reward"), F.round("mean_sequence_length", 6).alias("mean_sequence_length"))


@query("A24_validation_loss", f"""WITH {SCORES}, b AS (SELECT example_id % 8 AS rank, example_id // 64 AS batch, avg(nll) AS loss FROM sc GROUP BY 1, 2),
  r AS (SELECT rank, avg(loss) AS loss FROM b GROUP BY 1) SELECT round(avg(loss), 6) AS val_loss FROM r""")
def a24(spark, sf):
    rows = scores(spark, sf).select((F.col("example_id") % 8).alias("rank"), F.floor(F.col("example_id") / 64).alias("batch"), F.col("nll").alias("loss"))
    return E.validation_loss(rows).select(F.round("val_loss", 6).alias("val_loss"))


# ---------------------------------------------------------------- letters and answers

@query("J8_restrict_to_options", f"""WITH {SCORES}, s AS (SELECT example_id, (['A', 'B', 'C', 'D'])[option_idx + 1] AS letter, max(nll) AS score FROM sc GROUP BY 1, 2)
  SELECT example_id, letter AS pred FROM s WHERE unicode(letter) - 65 < 2 + example_id % 3 QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY score DESC, letter) = 1""")
def j8(spark, sf):
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    s = scores(spark, sf).groupBy("example_id", F.get(letters, F.col("option_idx")).alias("letter")).agg(F.max("nll").alias("score"))
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"),
                                                 F.slice(letters, F.lit(1), (2 + F.col("doc_id") % 3).cast("int")).alias("letters"))
    return E.restrict_to_options(s, items)


@query("J7_letter_token_ids", f"""WITH l AS (SELECT DISTINCT unnest(string_split(text, '')) AS letter FROM documents WHERE text <> '') SELECT letter, ({sql_byte_list('letter')})[1]::INTEGER AS token FROM l""")
def j7(spark, sf):
    return E.letter_token_ids(table(spark, sf, "documents").where("text <> ''").select(F.explode(F.split("text", "")).alias("letter")).distinct(), GIVEN)


_ANS = "nullif(replace(regexp_extract({x}, '#### (-?[0-9.,]+)', 1), ',', ''), '')"


def _completions(spark, sf):
    docs = table(spark, sf, "documents")
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.format_string("\n#### -1,%d.5 #### 7", F.col("doc_id") % 5)))
    meant = F.concat("text", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.format_string("\n#### -1%d.5", F.col("n_chars") % 5)))
    return docs.select(F.col("doc_id").alias("example_id"), said.alias("completion"), meant.alias("reference"))


_SAID = "text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '#### -1,' || doc_id % 5 || '.5 #### 7' END"
_MEANT = "text || CASE WHEN doc_id % 9 = 0 THEN '' ELSE chr(10) || '#### -1' || n_chars % 5 || '.5' END"


@query("F11_extract_answer", f"SELECT doc_id AS example_id, {_ANS.format(x=_SAID)} AS answer FROM documents")
def f11(spark, sf):
    return _completions(spark, sf).select("example_id", X.extract_answer(F.col("completion")).alias("answer"))


@query("J9_score_completions", f"SELECT doc_id AS example_id, ({_ANS.format(x=_SAID)} IS NOT DISTINCT FROM {_ANS.format(x=_MEANT)})::INTEGER AS is_correct FROM documents")
def j9(spark, sf):
    rows = _completions(spark, sf)
    return E.score_completions(rows.drop("reference"), rows, X.extract_answer).select("example_id", "is_correct")


# ---------------------------------------------------------------- prompts and spans

# Items: the sentences of a document are its choices; sources are the tasks.
ITEMS = """items AS (SELECT source AS task, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, string_split(text, '.') AS ss FROM documents),
  it AS (SELECT task, idx, ss[1] AS query, [coalesce(ss[2], 'none'), coalesce(ss[3], 'none')] AS choices, (doc_id % 2)::INTEGER AS gold,
     count(*) OVER (PARTITION BY task) AS n FROM items)"""


def items(spark, sf):
    parts = F.split("text", r"\.", -1)
    said = lambda i: F.coalesce(F.get("ss", F.lit(i)), F.lit("none"))
    docs = table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id", parts.alias("ss"))
    rows = docs.select("task", "doc_id", said(0).alias("query"), F.array(said(1), said(2)).alias("choices"),
                       (F.col("doc_id") % 2).cast("int").alias("gold"))
    return dense_index(rows, [F.col("doc_id")], integer_levels(F.col("doc_id")), ["task"])


def _d(j: str) -> str:
    return f"({sql_draw('1234 + idx', j)} % ({j} + 1))"


# Floyd's sampling unrolled for three draws out of n - 1.
SHOTS = f"""f1 AS (SELECT *, {_d('(n - 4)')} AS t1 FROM it), f2 AS (SELECT *, {_d('(n - 3)')} AS r2 FROM f1), f3 AS (SELECT *, CASE WHEN r2 = t1 THEN n - 3 ELSE r2 END AS t2 FROM f2),
  f4 AS (SELECT *, {_d('(n - 2)')} AS r3 FROM f3), f5 AS (SELECT *, CASE WHEN r3 IN (t1, t2) THEN n - 2 ELSE r3 END AS t3 FROM f4),
  pick AS (SELECT task, idx, query, choices, gold, CASE WHEN t1 >= idx THEN t1 + 1 ELSE t1 END AS a, CASE WHEN t2 >= idx THEN t2 + 1 ELSE t2 END AS b, CASE WHEN t3 >= idx THEN t3 + 1 ELSE t3 END AS c FROM f5)"""


@query("J3_few_shot_sampling", f"WITH {ITEMS}, {SHOTS} SELECT task, idx, concat_ws(',', a, b, c) AS shots FROM pick")
def j3(spark, sf):
    out = E.few_shot_examples(items(spark, sf), 3, fields=("idx",))
    return out.select("task", "idx", F.array_join(F.transform("shots", lambda s: s["idx"].cast("string")), ",").alias("shots"))


_JOINED = "j AS (SELECT p.*, x.query AS q1, x.choices AS c1, x.gold AS g1, y.query AS q2, y.choices AS c2, y.gold AS g2, z.query AS q3, z.choices AS c3, z.gold AS g3 FROM pick p JOIN it x ON x.task = p.task AND x.idx = p.a JOIN it y ON y.task = p.task AND y.idx = p.b JOIN it z ON z.task = p.task AND z.idx = p.c)"


def _shots(spark, sf):
    return E.few_shot_examples(items(spark, sf), 3, fields=("query", "choices", "gold"))


def _sql_shots(form: str) -> str:
    return " || ".join(form.format(q=f"q{i}", c=f"c{i}", g=f"g{i}") + " || chr(10) || chr(10)" for i in (1, 2, 3))


_MC = _sql_shots("{q} || ' ' || {c}[{g} + 1]")
_SCHEMA = _sql_shots("{c}[{g} + 1] || ' ' || {q}")
_LM = _sql_shots("regexp_replace({q}, '^\\s+|\\s+$', '', 'g') || ' ' || {c}[1]")
_LM_ALL = f"{_LM} || regexp_replace(query, '^\\s+|\\s+$', '', 'g') || ' '"


@query("F9_render_icl_mc", f"WITH {ITEMS}, {SHOTS}, {_JOINED} SELECT task, idx, o::INTEGER AS option_idx, {_MC} || query || ' ' || choices[o + 1] AS prompt FROM (SELECT *, unnest([0, 1]) AS o FROM j)")
def f9a(spark, sf):
    prompts = X.render_icl_mc(F.col("shots"), F.col("query"), F.col("choices"), F.lit(" "))
    return _shots(spark, sf).select("task", "idx", F.posexplode(prompts).alias("option_idx", "prompt"))


@query("F9_render_icl_schema", f"WITH {ITEMS}, {SHOTS}, {_JOINED} SELECT task, idx, o::INTEGER AS option_idx, {_SCHEMA} || choices[o + 1] || ' ' || query AS prompt FROM (SELECT *, unnest([0, 1]) AS o FROM j)")
def f9b(spark, sf):
    shots = F.transform("shots", lambda s: F.struct(s["choices"].alias("context_options"), s["query"].alias("continuation"), s["gold"].alias("gold")))
    prompts = X.render_icl_schema(shots, F.col("choices"), F.col("query"), F.lit(" "))
    return _shots(spark, sf).select("task", "idx", F.posexplode(prompts).alias("option_idx", "prompt"))


@query("F9_render_icl_lm", f"""WITH {ITEMS}, {SHOTS}, {_JOINED} SELECT task, idx, 0::INTEGER AS option_idx, regexp_replace({_LM_ALL}, '^\\s+|\\s+$', '', 'g') AS prompt FROM j
   UNION ALL SELECT task, idx, 1, {_LM_ALL} || choices[1] FROM j""")
def f9c(spark, sf):
    return _lm(spark, sf).select("task", "idx", F.posexplode("prompts").alias("option_idx", "prompt"))


def _lm(spark, sf):
    shots = F.transform("shots", lambda s: F.struct(s["query"].alias("context"), F.get(s["choices"], 0).alias("continuation")))
    prompts = X.render_icl_lm(shots, F.col("query"), F.get("choices", 0), F.lit(" "))
    return _shots(spark, sf).withColumn("prompts", prompts)


@query("F10_continuation_spans", f"""WITH {ITEMS}, {SHOTS}, {_JOINED},
  h AS MATERIALIZED (SELECT task, idx, strlen({_MC} || query || ' ') + 1 AS head, choices, {sql_byte_list('choices[1]')} AS x, {sql_byte_list('choices[2]')} AS y FROM j),
  p AS (SELECT *, least(len(x), len(y)) AS short FROM h),
  d AS (SELECT task, idx, head, choices, head + coalesce(list_position(list_transform(list_zip(x[1:short], y[1:short]), lambda z: z[1] <> z[2]), true) - 1, short) AS s FROM p)
  SELECT task, idx, o::INTEGER AS option_idx, s::INTEGER AS span_start, (head + strlen(choices[o + 1]))::INTEGER AS span_end FROM (SELECT *, unnest([0, 1]) AS o FROM d)""")
def f10(spark, sf):
    prompts = X.render_icl_mc(F.col("shots"), F.col("query"), F.col("choices"), F.lit(" "))
    rows = _shots(spark, sf).select("task", "idx", prompts.alias("prompts"))
    coded = F.transform("prompts", lambda p: F.concat(F.array(F.lit(258)), T.text_byte_ids(p)))
    spans = E.continuation_spans(rows.withColumn("prompt_ids", coded), F.lit("multiple_choice"))
    return spans.select("task", "idx", "option_idx", "span_start", "span_end")


@query("W8_span_crop", f"""WITH {ITEMS}, {SHOTS}, {_JOINED},
  lm AS (SELECT task, idx, regexp_replace({_LM_ALL}, '^\\s+|\\s+$', '', 'g') AS a, {_LM_ALL} || choices[1] AS b FROM j),
  l AS (SELECT task, idx, strlen(a) + 1 AS s, strlen(b) + 1 AS e, a = b[1:length(a)] AND strlen(a) < strlen(b) AS ok FROM lm)
  SELECT task, idx, (s - greatest(e - 256, 0))::INTEGER AS span_start, (e - greatest(e - 256, 0))::INTEGER AS span_end, least(e, 256)::INTEGER AS n,
    CASE WHEN NOT ok THEN 'not_a_prefix' WHEN s - greatest(e - 256, 0) < 0 THEN 'span_cut_off' END AS reason FROM l""")
def w8(spark, sf):
    coded = F.transform("prompts", lambda p: F.concat(F.array(F.lit(258)), T.text_byte_ids(p)))
    rows = _lm(spark, sf).select("task", "idx", coded.alias("prompt_ids"))
    spans = E.continuation_spans(rows, F.lit("language_modeling"))
    return E.span_crop(spans, 256).select("task", "idx", "span_start", "span_end", F.size("ids").alias("n"), "reason")


def _common(side: str) -> str:
    rev = "list_reverse" if side == "suffix" else ""
    return f"""WITH r AS (SELECT doc_id // 4 AS example_id, {rev}({sql_byte_list('text')}) AS ids FROM documents),
  x AS (SELECT example_id, unnest(ids) AS t, generate_subscripts(ids, 1) - 1 AS pos FROM r),
  k AS (SELECT example_id, count(*) AS n, min(len(ids)) AS short FROM r GROUP BY 1),
  bad AS (SELECT example_id, min(pos) AS f FROM (SELECT example_id, pos, count(*) AS c, count(DISTINCT t) AS d FROM x GROUP BY 1, 2) JOIN k USING (example_id) WHERE c < n OR d > 1 GROUP BY 1)
  SELECT example_id, least(coalesce(f, short), short)::INTEGER AS common FROM k LEFT JOIN bad USING (example_id)"""


def _groups(spark, sf):
    docs = bpe.spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.floor(F.col("doc_id") / 4).alias("example_id"), T.text_byte_ids(F.col("text")).alias("ids"))


@query("W7_common_prefix", _common("prefix"))
def w7a(spark, sf):
    return E.common_length(_groups(spark, sf))


@query("W7_common_suffix", _common("suffix"))
def w7b(spark, sf):
    return E.common_length(_groups(spark, sf), suffix=True)


@query("F8_render_mc", f"""WITH {ITEMS} SELECT task, idx, 'Multiple Choice question: ' || query || chr(10) || '- ' || choices[1] || '=A' || chr(10) || '- ' || choices[2] || '=B' || chr(10) || chr(10)
   || 'Respond only with the letter of the correct answer.' AS prompt FROM it""")
def f8(spark, sf):
    letters = F.array(F.lit("A"), F.lit("B"))
    return items(spark, sf).select("task", "idx", X.render_mc(F.col("query"), letters, F.col("choices")).alias("prompt"))
