"""Queries on words, pairs, merges and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.common import query, sql_byte_list, sql_words, table
from tokenloom.functions import tokens as T
from tokenloom.operators import bpe

SPECIAL_SQL_NOTE = "no document starts with a special token"


def _docs(spark, sf):
    return bpe.spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


@query("A1_word_counts", sql_words("SELECT word, count(*)::BIGINT AS cnt FROM words GROUP BY word"))
def a1(spark, sf):
    return bpe.word_counts(_docs(spark, sf))


@query("F1_split_words", sql_words("""
  SELECT d.doc_id, coalesce(w.n, 0)::INTEGER AS n_words, coalesce(w.h, md5('')) AS words_md5 FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY o)) AS h FROM (
      SELECT doc_id, translate(unnest(ws), chr(983042)||chr(983043)||chr(983044), ')]}') AS word, generate_subscripts(ws, 1) AS o FROM (
        SELECT doc_id, regexp_extract_all(mtext, '[^()\\[\\]{}\\n\\t=:., \\x{F0001}]+') AS ws FROM marked)) GROUP BY doc_id) w USING (doc_id)
""".replace("\\\\", "\\")))
def f1(spark, sf):
    split = _docs(spark, sf).select("doc_id", T.split_words(F.col("text")).alias("w"))
    return split.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_BYTES = sql_byte_list("word")
_PAIRS = f"""
  counted AS (SELECT word, count(*) AS cnt FROM words GROUP BY word),
  b AS (SELECT {_BYTES} AS ids, cnt FROM counted),
  p AS (SELECT unnest(list_zip(ids[:-2], ids[2:])) AS ab, cnt FROM b WHERE len(ids) >= 2)
"""


@query("A2_pair_counts", sql_words(f", {_PAIRS} SELECT ab[1]::INTEGER AS a, ab[2]::INTEGER AS b, sum(cnt)::BIGINT AS c FROM p GROUP BY 1, 2"))
def a2(spark, sf):
    return bpe.pair_counts(bpe.word_counts(_docs(spark, sf)))


@query("O2_top_pair", sql_words(f", {_PAIRS} SELECT ab[1]::INTEGER AS a, ab[2]::INTEGER AS b, sum(cnt)::BIGINT AS c FROM p GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT 1"))
def o2(spark, sf):
    return bpe.top_pair(bpe.pair_counts(bpe.word_counts(_docs(spark, sf))))


@query("W5_adjacent_pairs", f"""
  WITH b AS (SELECT conv_id, turn, {sql_byte_list('text')} AS ids FROM conversations)
  SELECT conv_id, turn, greatest(len(ids) - 1, 0)::INTEGER AS n_pairs,
    coalesce(list_sum(list_transform(list_zip(ids[:-2], ids[2:]), lambda t: t[1]::BIGINT * 257 + t[2])), 0)::BIGINT AS checksum
  FROM b""")
def w5(spark, sf):
    chats = table(spark, sf, "conversations")
    pairs = chats.select("conv_id", "turn", T.adjacent_pairs(T.text_byte_ids(F.col("text"))).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["a"] * 257 + x["b"])
    return pairs.select("conv_id", "turn", F.size("p").alias("n_pairs"), total.alias("checksum"))


def sql_merges(k: int) -> str:
    """The first k merges, one recount per merge, as chained SQL."""
    parts = [f"counted AS (SELECT word, count(*) AS cnt FROM words GROUP BY word)",
             f"w0 AS MATERIALIZED (SELECT list_aggregate(list_transform({_BYTES}, lambda x: chr(x + 1024)), 'string_agg', '') AS s, cnt FROM counted WHERE strlen(word) >= 2)"]
    for i in range(k):
        parts.append(f"p{i} AS (SELECT substr(s, g, 2) AS ab, cnt FROM (SELECT s, cnt, unnest(range(1, length(s))) AS g FROM w{i}))")
        parts.append(f"t{i} AS MATERIALIZED (SELECT ab, sum(cnt)::BIGINT AS c FROM p{i} GROUP BY ab ORDER BY c DESC, unicode(ab[1]), unicode(ab[2]) LIMIT 1)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(s, (SELECT ab FROM t{i}), chr({267 + i + 1024})) AS s, cnt FROM w{i})")
    union = " UNION ALL ".join(
        f"SELECT (unicode(ab[1]) - 1024)::INTEGER AS a, (unicode(ab[2]) - 1024)::INTEGER AS b, {267 + i}::INTEGER AS id, c FROM t{i}" for i in range(k))
    return ", " + ", ".join(parts) + " " + union


TRAINED = 12


@query("A3_bpe_train", sql_words(sql_merges(TRAINED)))
def a3(spark, sf):
    return bpe.merges_frame(spark, bpe.bpe_train(bpe.word_counts(_docs(spark, sf)), T.FIRST_MERGE_ID + TRAINED))


# A short merge table for the encoding queries, in id order: th, er, the, on.
GIVEN = [(116, 104, 267), (101, 114, 268), (267, 101, 269), (111, 110, 270)]
# The same merges as text replacements for the SQL twins; the stand-ins are private characters.
_GIVEN_SQL = "replace(replace(replace(replace({x}, 'th', chr(984267)), 'er', chr(984268)), chr(984267)||'e', chr(984269)), 'on', chr(984270))"


def sql_ids(text: str) -> str:
    """Token ids of a text whose merges were written as private characters."""
    return f"""(CASE WHEN {text} = '' THEN []::INTEGER[] ELSE flatten(list_transform(string_split({text}, ''), lambda c: CASE
      WHEN unicode(c) >= 984256 THEN [unicode(c) - 984000]
      WHEN unicode(c) < 128 THEN [unicode(c)]
      WHEN unicode(c) < 2048 THEN [192 + unicode(c) // 64, 128 + unicode(c) % 64]
      WHEN unicode(c) < 65536 THEN [224 + unicode(c) // 4096, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64]
      ELSE [240 + unicode(c) // 262144, 128 + (unicode(c) // 4096) % 64, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64]
      END)) END)"""


# Words framed with stand-ins for the markers, loose closers restored, merges applied.
SQL_ENCODED = f"""
 framed AS (SELECT doc_id, translate(regexp_replace(mtext, '([^()\\[\\]{{}}\\n\\t=:., \\x{{F0001}}]+)', chr(984256) || '\\1' || chr(984257), 'g'),
     chr(983042)||chr(983043)||chr(983044)||chr(983041), ')]}}') AS f FROM marked),
 encoded AS (SELECT doc_id, {sql_ids("rtrim(" + _GIVEN_SQL.format(x='f') + ", chr(984257))")} AS ids FROM framed)
"""


@query("F2_encode_corpus", sql_words(f""", {SQL_ENCODED}
  SELECT doc_id, len(ids)::INTEGER AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM encoded"""))
def f2(spark, sf):
    enc = bpe.encode_corpus(_docs(spark, sf).select("doc_id", "text"), GIVEN)
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(T.ids_text(F.col("ids"))).alias("ids_md5"))


@query("F3_decode_corpus", "SELECT doc_id, text FROM documents")
def f3(spark, sf):
    enc = bpe.encode_corpus(_docs(spark, sf).select("doc_id", "text"), GIVEN).select("doc_id", "ids")
    return bpe.decode_corpus(enc, GIVEN).select("doc_id", "text")


@query("J2_word_encodings", sql_words(f""", counted AS (SELECT lang, word, count(*)::BIGINT AS cnt FROM words GROUP BY lang, word)
  SELECT lang, word, cnt, array_to_string({sql_ids(_GIVEN_SQL.format(x='word'))}, ',') AS ids FROM counted"""))
def j2(spark, sf):
    joined = bpe.attach_encodings(bpe.word_counts(_docs(spark, sf), group=("lang",)), GIVEN)
    return joined.select("lang", "word", "cnt", T.ids_text(F.col("ids")).alias("ids"))


def _ratio_sql(text: str) -> str:
    return f"SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(len({sql_ids(text)}))::BIGINT AS tokens FROM documents GROUP BY lang"


@query("A5_compression_ratio", f"SELECT lang, bytes, tokens, bytes / tokens AS ratio FROM ({_ratio_sql(_GIVEN_SQL.format(x='text'))})")
def a5(spark, sf):
    return bpe.compression_ratio(_docs(spark, sf), "lang", GIVEN)


@query("J5_compare_tokenizers", f"""
  WITH o AS ({_ratio_sql(_GIVEN_SQL.format(x='text'))}), b AS ({_ratio_sql("replace(replace(text, 'on', chr(984267)), 'en', chr(984268))")})
  SELECT lang, o.bytes, b.tokens AS base_tokens, b.bytes / b.tokens AS base_ratio, o.tokens, o.bytes / o.tokens AS ratio,
    (b.tokens - o.tokens) / b.tokens * 100 AS relative_diff_pct,
    CASE WHEN b.bytes / b.tokens > o.bytes / o.tokens THEN 'Baseline' WHEN o.bytes / o.tokens > b.bytes / b.tokens THEN 'Ours' ELSE 'Tie' END AS better
  FROM o JOIN b USING (lang)""")
def j5(spark, sf):
    docs = _docs(spark, sf)
    baseline = [(111, 110, 267), (101, 110, 268)]
    return bpe.compare_tokenizers(
        bpe.compression_ratio(docs, "lang", GIVEN), bpe.compression_ratio(docs, "lang", baseline), "lang")
