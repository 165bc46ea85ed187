"""Queries on shards, crops, orders, mixtures and packed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.common import query, sql_byte_list, sql_unit, table
from tokenloom.functions import tokens as T
from tokenloom.functions.draws import draw_index
from tokenloom.operators import bpe, corpus, packing
from tokenloom.operators.offsets import dense_index, global_offsets, integer_levels
from tokenloom.session import materialise, scratch_path
from tokenloom.sources import shards

SHARD_ROWS = 300


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", "text", *cols)


def _shard_dir(spark, sf):
    """The documents as one file per 300 ids."""
    path = scratch_path(spark, "corpus")
    cut = _docs(spark, sf).withColumn("shard", F.format_string("%05d", F.floor(F.col("doc_id") / SHARD_ROWS)))
    (cut.repartition("shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path))
    return path


@query("S1_shard_catalog", f"SELECT lpad((doc_id // {SHARD_ROWS})::VARCHAR, 5, '0') AS shard, 1::BIGINT AS files FROM documents GROUP BY 1")
def s1(spark, sf):
    files = shards.shard_catalog(spark, _shard_dir(spark, sf))
    return files.groupBy(F.regexp_extract("file_path", "shard=([0-9]+)/", 1).alias("shard")).agg(F.count("*").alias("files"))


@query("S2_read_corpus", f"""SELECT CASE WHEN doc_id // {SHARD_ROWS} = (SELECT max(doc_id // {SHARD_ROWS}) FROM documents) THEN 'val' ELSE 'train' END AS split,
  count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""")
def s2(spark, sf):
    path = _shard_dir(spark, sf)
    parts = [shards.read_corpus(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("S3_strided_scan", f"""SELECT doc_id, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // {SHARD_ROWS} ORDER BY doc_id) - 1 AS r FROM documents)
  WHERE (r // 32) % 3 = 1""")
def s3(spark, sf):
    rows = shards.strided_scan(spark, _shard_dir(spark, sf), 1, 3, 32, ("doc_id", "text"))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("S4_text_only_scan", "SELECT md5(text) AS text_md5 FROM documents")
def s4(spark, sf):
    return table(spark, sf, "documents").select(F.md5("text").alias("text_md5"))


CHARS, GROUP = 250_000, 32
# Greedy cut, one block after the other, as a recursive walk.
_SHUFFLED = "s AS (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS idx FROM documents)"
_CUT = f"""bl AS (SELECT idx // {GROUP} AS block, sum(chars) AS chars, count(*) AS docs FROM s GROUP BY 1),
  cut(block, shard, acc, closed) AS (
    SELECT 0::BIGINT, 0::BIGINT, chars, chars >= {CHARS} AND docs = {GROUP} FROM bl WHERE block = 0
    UNION ALL
    SELECT bl.block, CASE WHEN closed THEN shard + 1 ELSE shard END,
      CASE WHEN closed THEN bl.chars ELSE acc + bl.chars END,
      CASE WHEN closed THEN bl.chars ELSE acc + bl.chars END >= {CHARS} AND bl.docs = {GROUP}
    FROM cut JOIN bl ON bl.block = cut.block + 1)"""


@query("S5_repackage_corpus", f"""WITH RECURSIVE {_SHUFFLED}, {_CUT}
  SELECT cut.shard, count(*)::BIGINT AS docs, sum(s.chars)::BIGINT AS chars FROM s JOIN cut ON cut.block = s.idx // {GROUP} GROUP BY 1""")
def s5(spark, sf):
    out = scratch_path(spark, "repackaged")
    shards.repackage_corpus(_docs(spark, sf), out, CHARS, GROUP)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("W6_greedy_shard_cut", f"""WITH RECURSIVE {_SHUFFLED}, {_CUT}
  SELECT s.doc_id, s.idx, cut.shard FROM s JOIN cut ON cut.block = s.idx // {GROUP}""")
def w6(spark, sf):
    return shards.assign_shards(_docs(spark, sf), CHARS, GROUP, 42).select("doc_id", "idx", "shard")


@query("J10_block_shards", f"""WITH RECURSIVE {_SHUFFLED}, {_CUT} SELECT block, shard FROM cut""")
def j10(spark, sf):
    rows = shards.assign_shards(_docs(spark, sf), CHARS, GROUP, 42)
    return rows.groupBy(F.floor(F.col("idx") / GROUP).alias("block")).agg(F.max("shard").alias("shard"))


@query("P1_crop_documents", "SELECT doc_id, substr(text, 1, 10000) AS text FROM documents")
def p1(spark, sf):
    return corpus.crop_documents(_docs(spark, sf))


@query("P2_char_budget", """WITH c AS (SELECT doc_id, substr(text, 1, 10000) AS text FROM documents),
  r AS (SELECT *, sum(length(text)) OVER (ORDER BY doc_id) AS e FROM c)
  SELECT doc_id, md5(text) AS text_md5, e::BIGINT AS running FROM r WHERE e - length(text) <= 1000000""")
def p2(spark, sf):
    kept = corpus.char_budget(corpus.crop_documents(_docs(spark, sf)), 1_000_000)
    sized = kept.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))
    return global_offsets(sized, F.col("n"), [F.col("doc_id")], integer_levels(F.col("doc_id"))).select("doc_id", "text_md5", F.col("end").alias("running"))


@query("W4_global_offsets", """SELECT doc_id, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS start,
  (sum(length(text)) OVER (ORDER BY doc_id))::BIGINT AS "end" FROM documents""")
def w4(spark, sf):
    sized = _docs(spark, sf).select("doc_id", F.length("text").alias("n"))
    return global_offsets(sized, F.col("n"), [F.col("doc_id")], integer_levels(F.col("doc_id"))).select("doc_id", "start", "end")


_IDX = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels)"


def _indexed_labels(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id")
    return dense_index(rows, [F.col("doc_id")], integer_levels(F.col("doc_id")))


@query("P3_slice_task", f"SELECT doc_id, ((idx - 5) // 3)::BIGINT AS idx FROM {_IDX} WHERE idx >= 5 AND idx < 1000 AND (idx - 5) % 3 = 0")
def p3(spark, sf):
    return corpus.slice_task(_indexed_labels(spark, sf), 5, 1000, 3)


@query("O3_limit_problems", f"SELECT doc_id, r::BIGINT AS idx FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1337|' || doc_id)) - 1 AS r FROM labels) WHERE r < 100")
def o3(spark, sf):
    return corpus.limit_problems(corpus.shuffle_index(table(spark, sf, "labels").select("doc_id"), 1337, F.col("doc_id")), 100)


@query("O6_rank_stride", f"SELECT doc_id, idx FROM {_IDX} WHERE idx % 8 = 3")
def o6(spark, sf):
    return corpus.rank_stride(_indexed_labels(spark, sf), 3, 8)


@query("P4_cap_per_task", """SELECT source AS task, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '1337', source, doc_id))) AS r FROM documents) WHERE r <= 10""")
def p4(spark, sf):
    items = table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id")
    return corpus.cap_per_task(items, 10, item="doc_id")


@query("O1_seeded_shuffle", "SELECT doc_id, (row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1)::BIGINT AS idx FROM documents")
def o1(spark, sf):
    return corpus.shuffle_index(table(spark, sf, "documents").select("doc_id"), 42, F.col("doc_id"))


_TASKS = """t AS (SELECT 0 AS task_idx, row_number() OVER (ORDER BY conv_id) - 1 AS local_idx FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY item_id) - 1 FROM benchmark UNION ALL SELECT 2, row_number() OVER (ORDER BY item_id) - 1 FROM benchmark)"""


def _tasks(spark, sf):
    chats = table(spark, sf, "conversations").select("conv_id").distinct()
    chats = dense_index(chats, [F.col("conv_id")], integer_levels(F.col("conv_id"))).select("idx")
    items = table(spark, sf, "benchmark").select("item_id")
    items = dense_index(items, [F.col("item_id")], integer_levels(F.col("item_id"))).select("idx")
    return [chats, items, items]


@query("U1_mixture", f"WITH {_TASKS} SELECT task_idx::INTEGER AS task_idx, local_idx::BIGINT AS local_idx, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', task_idx, local_idx))) - 1)::BIGINT AS idx FROM t")
def u1(spark, sf):
    return corpus.mixture(_tasks(spark, sf))


@query("U2_sequence", f"WITH {_TASKS} SELECT task_idx::INTEGER AS task_idx, local_idx::BIGINT AS local_idx, (row_number() OVER (ORDER BY task_idx, local_idx) - 1)::BIGINT AS idx FROM t")
def u2(spark, sf):
    return corpus.task_sequence(_tasks(spark, sf))


_U = sql_unit("'7'", "event_id")


@query("U3_weighted_mix", f"SELECT event_id, CASE WHEN {_U} < 1.0/1.5 THEN 'calculator' ELSE 'tic-tac-toe' END AS source FROM events")
def u3(spark, sf):
    weights = {"calculator": 1.0, "tic-tac-toe": 0.5, "spelling": 0.0}
    return table(spark, sf, "events").select("event_id", corpus.weighted_source(weights, F.col("event_id"), seed=7).alias("source"))


@query("A19_mixture_composition", "SELECT source AS task, count(*)::BIGINT AS n_rows, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1")
def a19(spark, sf):
    return corpus.mixture_composition(table(spark, sf, "documents").select(F.col("source").alias("task")))


@query("T6_multi_epoch", """WITH e AS (SELECT doc_id, unnest([0, 1, 2]) AS epoch FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws('|', '42', epoch, doc_id))) - 1 AS pos FROM e)
  SELECT doc_id, epoch::INTEGER AS epoch, pos::BIGINT AS pos, (epoch * n + pos)::BIGINT AS step, (epoch * n + pos = 3 * n - 1) AS is_last
  FROM p, (SELECT count(*) AS n FROM documents)""")
def t6(spark, sf):
    return corpus.multi_epoch(table(spark, sf, "documents").select("doc_id"), 3, 42, "doc_id")


# Problems: a user turn and the assistant turn after it.
SQL_PROBLEMS = "SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS json FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def problems(spark, sf):
    chats = table(spark, sf, "conversations")
    users = chats.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = chats.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("json"))
    return users.join(answers, ["conv_id", "turn"])


@query("P12_problem_text", f"""SELECT conv_id, turn, prompt || json AS problem, array_to_string(list_concat([258], list_concat({sql_byte_list('prompt')}, {sql_byte_list('json')})), ',') AS ids FROM ({SQL_PROBLEMS})""")
def p12(spark, sf):
    rows = corpus.problem_tokens(problems(spark, sf), markers=False)
    return rows.select("conv_id", "turn", corpus.problem_text(F.col("prompt"), F.col("json")).alias("problem"), T.ids_text(F.col("ids")).alias("ids"))


@query("P10_drop_unparsed", """WITH p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS expected FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')
  SELECT * FROM p WHERE prompt IS NOT NULL AND expected IS NOT NULL""")
def p10(spark, sf):
    chats = table(spark, sf, "conversations")
    users = chats.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    after = chats.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return corpus.drop_unparsed(users.join(after, ["conv_id", "turn"], "left"))


@query("P11_split_decoded_stream", f"""WITH r AS (SELECT doc_id // 7 AS row_id, string_agg(text, '<|bos|>' ORDER BY doc_id) AS text FROM documents GROUP BY 1),
  p AS (SELECT row_id, string_split(text, '<|bos|>') AS ps FROM r)
  SELECT row_id, (i - 1)::INTEGER AS pos, md5(ps[i + 1]) AS problem_md5 FROM (SELECT row_id, ps, unnest(range(1, len(ps) - 1)) AS i FROM p)""")
def p11(spark, sf):
    docs = _docs(spark, sf)
    rows = docs.groupBy(F.floor(F.col("doc_id") / 7).alias("row_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]), "<|bos|>").alias("text"))
    return corpus.split_decoded_stream(rows).select("row_id", "pos", F.md5("problem").alias("problem_md5"))


# ---------------------------------------------------------------- packing

def _coded(spark, sf):
    docs = bpe.spread(_docs(spark, sf), "doc_id")
    coded = bpe.encode_tokens(docs, markers=False, prepend=T.BOS_ID)
    return materialise(coded.select("doc_id", "tokens", F.length("tokens").alias("n_tokens")), "coded")


_STREAM = f"""tok AS (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM (SELECT doc_id, list_prepend(258, {sql_byte_list('text')}) AS ids FROM documents)),
  st AS (SELECT t, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM tok)"""


@query("W1_pack_rows", f"""WITH {_STREAM}, r AS (SELECT g // 513 AS row_id, list(t ORDER BY g) AS ts FROM st GROUP BY 1)
  SELECT row_id::BIGINT AS row_id, md5(array_to_string(ts[1:512], ',')) AS inputs, md5(array_to_string(ts[2:513], ',')) AS targets FROM r WHERE len(ts) = 513""")
def w1(spark, sf):
    rows = packing.pack_rows(_coded(spark, sf), 512, size="n_tokens")
    return rows.select("row_id", F.md5(T.ids_text(F.col("inputs"))).alias("inputs"), F.md5(T.ids_text(F.col("targets"))).alias("targets"))


@query("W2_pack_flat", f"""WITH {_STREAM}, r AS (SELECT g // 1025 AS batch, list(t ORDER BY g) AS ts FROM st GROUP BY 1)
  SELECT batch::BIGINT AS batch, b::INTEGER AS b, md5(array_to_string(ts[b*256+1:b*256+256], ',')) AS inputs, md5(array_to_string(ts[b*256+2:b*256+257], ',')) AS targets
  FROM (SELECT *, unnest(range(4)) AS b FROM r WHERE len(ts) = 1025)""")
def w2(spark, sf):
    rows = packing.pack_flat(_coded(spark, sf), 4, 256, size="n_tokens")
    return rows.select("batch", "b", F.md5(T.ids_text(F.col("inputs"))).alias("inputs"), F.md5(T.ids_text(F.col("targets"))).alias("targets"))


@query("S16_write_packed_rows", f"""WITH {_STREAM}, r AS (SELECT g // 513 AS row_id, count(*) AS n, sum(t) AS s FROM st GROUP BY 1)
  SELECT CASE WHEN row_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n_rows, sum(n)::BIGINT AS tokens, sum(s)::BIGINT AS checksum FROM r WHERE n = 513 GROUP BY 1""")
def s16(spark, sf):
    rows = packing.cut_stream(_coded(spark, sf), 513, size="n_tokens").select("row_id", T.token_string_ids(F.col("tokens")).alias("ids"))
    out = scratch_path(spark, "packed")
    shards.write_packed_rows(rows.withColumn("split", F.when(F.col("row_id") % 10 == 9, "val").otherwise("train")), out)
    back = spark.read.parquet(out)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.size("ids")).alias("tokens"), F.sum(total).alias("checksum"))


@query("F29_pad_batch", f"""WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, {sql_byte_list('text')} AS ids FROM conversations),
  w AS (SELECT *, idx // 8 AS batch, max(len(ids)) OVER (PARTITION BY idx // 8) AS width FROM x)
  SELECT idx::BIGINT AS idx, batch::BIGINT AS batch, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda z: 258)), ',')) AS padded FROM w""")
def f29(spark, sf):
    chats = table(spark, sf, "conversations").withColumn("ids", T.text_byte_ids(F.col("text")))
    rows = dense_index(chats.select("conv_id", "turn", "ids"), [F.col("conv_id"), F.col("turn")], integer_levels(F.col("conv_id")))
    padded = packing.pad_batch(rows, 8, T.BOS_ID)
    return padded.select("idx", "batch", F.md5(T.ids_text(F.col("ids"))).alias("padded"))
