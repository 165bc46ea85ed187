"""Queries on metric logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.common import query, sql_draw, table
from tokenloom.catalog.scores import GIVEN, SCORES, _CENTERED, _CHOSEN, _GOLD, centered
from tokenloom.catalog.vocabulary import _GIVEN_SQL, sql_ids
from tokenloom.functions import text as X
from tokenloom.functions.draws import draw_bits
from tokenloom.operators import bpe
from tokenloom.operators import evaluation as E
from tokenloom.operators import metrics as M
from tokenloom.session import scratch_path
from tokenloom.sources import records

# One log row per event; values become steps of 1/128 so that sums are exact in both engines.
LOG = "lg AS (SELECT user_id AS run, event_id, event_type AS metric, round(value * 100)::BIGINT / 128.0::DOUBLE AS value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def log(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select(F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("metric"),
                         (F.round(F.col("value") * 100).cast("bigint") / 128.0).alias("value"), "ts")
    return M.number_steps(rows)


@query("W9_ema_debiased", f"""WITH {LOG}, l AS (SELECT run, list(value ORDER BY step) AS vs FROM lg GROUP BY 1), s AS (SELECT run, vs, unnest(range(len(vs))) AS step FROM l)
  SELECT run, step::BIGINT AS step, round(list_reduce(list_prepend(0.0::DOUBLE, vs[1:step + 1]), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x) / (1 - pow(0.9::DOUBLE, step + 1)), 6) AS debiased FROM s""")
def w9(spark, sf):
    return M.ema_debiased(log(spark, sf)).select("run", "step", F.round("debiased", 6).alias("debiased"))


@query("W10_running_best", f"WITH {LOG} SELECT run, step::BIGINT AS step, min(value) OVER (PARTITION BY run ORDER BY step) AS best FROM lg")
def w10(spark, sf):
    return M.running_best(log(spark, sf)).select("run", "step", "best")


@query("W11_throughput_eta", f"""WITH {LOG}, d AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY step) AS dt FROM lg),
  t AS (SELECT *, sum(CASE WHEN step > 1 THEN dt ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS total FROM d)
  SELECT run, step::BIGINT AS step, total::BIGINT AS total_us, floor(524288 / (nullif(dt, 0) / 1e6::DOUBLE))::BIGINT AS tok_per_sec,
    round(CASE WHEN step > 1 THEN total / (step - 1) / 1e6::DOUBLE END, 3) AS mean_step_s, round((1000 - step) * CASE WHEN step > 1 THEN total / (step - 1) / 1e6::DOUBLE END, 3) AS eta_s FROM t""")
def w11(spark, sf):
    out = M.throughput_eta(log(spark, sf), 524_288, 1000)
    return out.select("run", "step", "total_us", "tok_per_sec", F.round("mean_step_s", 3).alias("mean_step_s"), F.round("eta_s", 3).alias("eta_s"))


_STAGED = """st AS (SELECT event_id, (['base', 'mid', 'sft', 'rl'])[1 + user_id % 4] AS stage, CASE event_type WHEN 'click' THEN 'CORE' WHEN 'view' THEN 'ChatCORE' ELSE event_type END AS metric,
    printf('%.4f', round(value * 100)::BIGINT / 128.0) AS value FROM events)"""


def staged(spark, sf):
    e = table(spark, sf, "events")
    stage = F.get(F.array(*[F.lit(s) for s in M.STAGES]), F.col("user_id") % 4)
    metric = F.when(F.col("event_type") == "click", "CORE").when(F.col("event_type") == "view", "ChatCORE").otherwise(F.col("event_type"))
    value = F.round(F.col("value") * 100).cast("bigint") / 128.0
    return e.select("event_id", stage.alias("stage"), metric.alias("metric"), X.fixed(value, 4).alias("value"))


_PIVOT = f"""{_STAGED}, last AS (SELECT metric, stage, max_by(value, event_id) AS v FROM st GROUP BY 1, 2),
  pv AS (SELECT metric, CASE metric WHEN 'CORE' THEN 0 WHEN 'ChatCORE' THEN 2 ELSE 1 END::INTEGER AS sort_key, coalesce(max(v) FILTER (stage = 'base'), '-') AS base, coalesce(max(v) FILTER (stage = 'mid'), '-') AS mid,
   coalesce(max(v) FILTER (stage = 'sft'), '-') AS sft, coalesce(max(v) FILTER (stage = 'rl'), '-') AS rl FROM last GROUP BY 1)"""


@query("A21_report_pivot", f"WITH {_PIVOT} SELECT * FROM pv")
def a21(spark, sf):
    return M.report_pivot(staged(spark, sf), "event_id")


@query("S14_write_report", f"""WITH {_PIVOT} SELECT '| ' || rpad(metric, 15, ' ') || ' | ' || rpad(base, 8, ' ') || ' | ' || rpad(mid, 8, ' ') || ' | ' || rpad(sft, 8, ' ') || ' | ' || rpad(rl, 8, ' ') || ' |' AS line FROM pv
  UNION ALL SELECT '| Metric          | BASE     | MID      | SFT      | RL       |' UNION ALL SELECT '|-----------------|----------|----------|----------|----------|'""")
def s14(spark, sf):
    path = scratch_path(spark, "report")
    records.write_report(M.report_lines(M.report_pivot(staged(spark, sf), "event_id")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("A22_wall_clock", """WITH w AS (SELECT user_id AS run, min(date_trunc('second', ts)) AS s, max_by(date_trunc('second', ts), event_id) FILTER (event_type <> 'error') AS e FROM events GROUP BY 1)
  SELECT run, (epoch(e)::BIGINT - epoch(s)::BIGINT) // 3600 AS hours, ((epoch(e)::BIGINT - epoch(s)::BIGINT) % 3600) // 60 AS minutes FROM w""")
def a22(spark, sf):
    t = F.date_trunc("second", "ts")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), t.alias("started"), t.alias("ts"),
                                             (F.col("event_type") == "error").alias("is_rl"), F.col("event_id").alias("pos"))
    return M.wall_clock(rows)


@query("A23_sft_steps", "SELECT ((count(DISTINCT conv_id) // 32) * 3)::BIGINT AS num_iterations FROM conversations")
def a23(spark, sf):
    return M.sft_steps(table(spark, sf, "conversations").select("conv_id").distinct(), 32, 3)


@query("A20_corpus_budget", f"""SELECT lang, sum(length(text))::BIGINT AS chars, sum(len({sql_ids(_GIVEN_SQL.format(x='text'))}))::BIGINT AS tokens,
   ceil(11220000000.0::DOUBLE * (sum(length(text)) / sum(len({sql_ids(_GIVEN_SQL.format(x='text'))}))) / 250000000.0::DOUBLE)::BIGINT AS shards FROM documents GROUP BY 1""")
def a20(spark, sf):
    docs = bpe.spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    chars = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    ratios = bpe.compression_ratio(docs, "lang", GIVEN).select("lang", "tokens").join(chars, "lang")
    return M.corpus_budget(ratios, 561e6, 250e6).select("lang", "chars", "tokens", "shards")


_SCORED = f"sd AS (SELECT doc_id, quality AS corr, ({sql_draw(chr(39) + 'score' + chr(39), 'doc_id')} % 256) / 256.0::DOUBLE AS score FROM labels)"


def scored(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("corr"), ((draw_bits("score", F.col("doc_id")) % 256) / 256.0).alias("score"))


@query("A17_tool_metrics", f"WITH {_SCORED} SELECT round(sum(corr) / (count(*) + 1e-6::DOUBLE), 6) AS tool_correctness, round(sum(score) / (count(*) + 1e-6::DOUBLE), 6) AS tool_score FROM sd")
def a17(spark, sf):
    out = E.tool_metrics(scored(spark, sf))
    return out.select(F.round("tool_correctness", 6).alias("tool_correctness"), F.round("tool_score", 6).alias("tool_score"))


@query("O4_rank_predictions", f"WITH {_SCORED} SELECT * FROM sd ORDER BY corr DESC, score DESC, doc_id")
def o4(spark, sf):
    return E.rank_predictions(scored(spark, sf), "doc_id")


_SECTION = """se AS (SELECT event_id, '## Chat evaluation' || chr(10) || 'timestamp: ' || CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || chr(10) || chr(10)
   || '- ' || event_type || ': ' || user_id || ':9' || chr(10) || '- ChatCORE metric: ' || (event_id % 100) || chr(10) AS section FROM events)"""


def _sections(spark, sf):
    e = table(spark, sf, "events")
    when = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    body = F.concat(F.lit("## Chat evaluation\ntimestamp: "), when, F.lit("\n\n- "), F.col("event_type"), F.lit(": "), F.col("user_id"), F.lit(":9\n- ChatCORE metric: "),
                    F.col("event_id") % 100, F.lit("\n"))
    return e.select("event_id", body.alias("section"))


@query("F30_parse_metric_lines", """SELECT event_id, event_type AS metric, user_id::VARCHAR AS value FROM events WHERE event_type IN ('click', 'view', 'error')
  UNION ALL SELECT event_id, 'ChatCORE', (event_id % 100)::VARCHAR FROM events""")
def f30(spark, sf):
    hits = X.metric_lines(F.col("section"), ["click", "view", "error", "ChatCORE"])
    return _sections(spark, sf).select("event_id", F.inline(hits))


@query("F31_parse_report_timestamp", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events")
def f31(spark, sf):
    t = X.report_timestamp(F.col("section"), "timestamp:")
    return _sections(spark, sf).select("event_id", F.unix_seconds(t.cast("timestamp")).alias("seconds"))


@query("F32_format_metric", """SELECT event_id, lower(replace(event_type || ' Training ' || user_id, ' ', '-')) AS slug,
   CASE event_id % 3 WHEN 0 THEN printf('%.4f', round(value * 100)::BIGINT / 128.0) WHEN 1 THEN CASE WHEN event_id >= 10000 THEN printf('%,d', event_id) ELSE event_id::VARCHAR END ELSE props END AS shown FROM events""")
def f32(spark, sf):
    e = table(spark, sf, "events")
    third = F.col("event_id") % 3
    kind = F.when(third == 0, "float").when(third == 1, "int").otherwise("str")
    value = F.when(third == 0, (F.round(F.col("value") * 100).cast("bigint") / 128.0).cast("string")).when(third == 1, F.col("event_id").cast("string")).otherwise(F.col("props"))
    return e.select("event_id", X.slugify(F.concat(F.col("event_type"), F.lit(" Training "), F.col("user_id"))).alias("slug"),
                    F.when(third == 2, value).otherwise(X.format_metric(F.when(third != 2, value), kind)).alias("shown"))


@query("S13_write_eval_csv", f"""WITH {SCORES}, {_CHOSEN}, {_GOLD}, {_CENTERED}
  SELECT rpad(task, 35, ' ') || ', ' || rpad(printf('%.6f', accuracy), 10, ' ') || ', ' || rpad(printf('%.6f', centered), 10, ' ') AS line FROM cen
  UNION ALL SELECT rpad('CORE', 35, ' ') || ', ' || repeat(' ', 10) || ', ' || rpad(printf('%.6f', avg(centered)), 10, ' ') FROM cen
  UNION ALL SELECT rpad('Task', 35, ' ') || ', ' || rpad('Accuracy', 10, ' ') || ', ' || rpad('Centered', 10, ' ')""")
def s13(spark, sf):
    path = scratch_path(spark, "eval-csv")
    records.write_eval_csv(centered(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
