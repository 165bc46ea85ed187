"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import ship_package

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it has one, its SQL twin."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL building blocks -------------------------------------------------

def sql_draw(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,15))::BIGINT"


def sql_unit(*parts: str) -> str:
    return f"((({sql_draw(*parts)}) >> 8) / {float(1 << 52)!r}::DOUBLE)"


SQL_WORD = r"[^()\[\]{}\n\t=:., ]+"


def sql_byte_list(text: str) -> str:
    """UTF-8 bytes of a text as a list."""
    return f"""(CASE WHEN {text} = '' THEN []::INTEGER[] ELSE flatten(list_transform(string_split({text}, ''), lambda c: CASE
      WHEN unicode(c) < 128 THEN [unicode(c)]
      WHEN unicode(c) < 2048 THEN [192 + unicode(c) // 64, 128 + unicode(c) % 64]
      WHEN unicode(c) < 65536 THEN [224 + unicode(c) // 4096, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64]
      ELSE [240 + unicode(c) // 262144, 128 + (unicode(c) // 4096) % 64, 128 + (unicode(c) // 64) % 64, 128 + unicode(c) % 64]
      END)) END)"""


# Bracket matching as a recursive walk over the brackets of one document; unmatched
# closers become a break character plus a stand-in, as single characters outside byte range.
SQL_MARKED = r"""
walk AS (
  SELECT doc_id, 1 AS i, regexp_extract_all(text, '[()\[\]{}]') AS br, ''::VARCHAR AS st, []::INTEGER[] AS loose
  FROM documents WHERE regexp_matches(text, '[)\]}]')
  UNION ALL
  SELECT doc_id, i + 1, br,
    CASE WHEN br[i] IN ('(', '[', '{') THEN st || br[i]
         WHEN st <> '' AND right(st, 1) = translate(br[i], ')]}', '([{') THEN left(st, length(st) - 1) ELSE st END,
    CASE WHEN br[i] IN ('(', '[', '{') THEN loose
         WHEN st <> '' AND right(st, 1) = translate(br[i], ')]}', '([{') THEN loose ELSE list_append(loose, i) END
  FROM walk WHERE i <= len(br)
),
final AS (SELECT doc_id, br, loose FROM walk WHERE i = len(br) + 1),
marked AS (
  SELECT d.doc_id, d.lang, d.source, CASE WHEN f.doc_id IS NULL THEN d.text ELSE
    list_aggregate(list_transform(list_zip(regexp_split_to_array(d.text, '[()\[\]{}]'), list_append(f.br, ''), range(1, len(f.br) + 2)),
      lambda t: t[1] || CASE WHEN list_contains(f.loose, t[3]) THEN chr(983041) || translate(t[2], ')]}', chr(983042)||chr(983043)||chr(983044)) ELSE t[2] END),
      'string_agg', '') END AS mtext
  FROM documents d LEFT JOIN final f USING (doc_id)
),
words AS (
  SELECT doc_id, lang, source, translate(unnest(regexp_extract_all(mtext, '[^()\[\]{}\n\t=:., \x{F0001}]+')), chr(983042)||chr(983043)||chr(983044), ')]}') AS word
  FROM marked
)"""


def sql_words(tail: str) -> str:
    return f"WITH RECURSIVE {SQL_MARKED} {tail}"
