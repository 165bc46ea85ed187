"""The registered query of every operator here, with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.ngram_join import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "doc", "tag")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.sharding import shard_rows, shard_tree

    return shard_rows(_table(spark, sf_dir, "documents"), shard_tree(8), shard_tree(9))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.urls import filter_urls, rule_table

    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


ORACLE["op5_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT s.*, (SELECT max_by(h || p || '|' || v, length(h || p)) FROM rules
    WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)) AS b FROM split s)
SELECT page_id, host, path, split_part(b, '|', 1) AS rule, coalesce(split_part(b, '|', 2), 'allow') AS verdict FROM best
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents")).drop("doc", "tag", "places")


def _sql_kind(k: int) -> str:
    from tokenloom.llm.secret_scan import KINDS

    name, pattern, group, least = KINDS[k]
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repository, {k} AS kind, m_end - size AS start, m_end AS stop, value FROM (
      SELECT *, sum(gap + coalesce(size, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS m_end FROM (
        SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repository,
          unnest(list_transform(regexp_split_to_array(text, '{quoted}'), lambda x: length(x))) AS gap,
          unnest(list_transform(regexp_extract_all(text, '{quoted}'), lambda x: length(x))) AS size,
          unnest(regexp_extract_all(text, '{quoted}', {group})) AS value,
          unnest(range(1, len(regexp_split_to_array(text, '{quoted}')) + 1)) AS i
        FROM documents WHERE regexp_matches(text, '{quoted}'))) WHERE length(value) >= {least}"""


ORACLE["op2_secret_scan"] = f"""
WITH spans AS MATERIALIZED ({" UNION ALL ".join(_sql_kind(k) for k in range(4))}),
known AS (SELECT value, count(DISTINCT coalesce(owner, '')) AS owners, count(DISTINCT (coalesce(owner, ''), coalesce(repository, ''))) AS repositories
  FROM spans GROUP BY value),
chosen AS (
  SELECT s.*, owners <= 2 AND repositories <= 4 AS live FROM spans s JOIN known USING (value)
  WHERE kind < 3 OR (owners <= 2 AND repositories <= 4 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT regexp_matches(value, '{"|".join(f"{c}{{5}}" for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/_=-")}|[+]{{5}}')
    AND NOT regexp_matches(lower(value), 'example|placeholder|changeme|dummy|sample')
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind < 3 AND b.doc_id = s.doc_id AND b.start = s.start AND b.stop = s.stop))),
named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS t FROM chosen),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN per USING (doc_id)
"""


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.quality import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tokenloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.divergence import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM rows),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
  FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.s = a.source AND z.t = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.licenses import NOTICES, PHRASES, scan_licenses, template_table

    return scan_licenses(_table(spark, sf_dir, "documents"), template_table(spark, PHRASES, NOTICES))


def _license_sql() -> str:
    from tokenloom.llm.licenses import NOTICES, PERCENT, PHRASES, WORD

    given = [(t, k, 100, "true") for t, k in PHRASES] + [(t, k, PERCENT, "false") for t, k in NOTICES]
    values = ", ".join(f"({i}, '{t}', '{k}', {n}, {phrase})" for i, (t, k, n, phrase) in enumerate(given))
    step = max(len(t.split(" ")) for t, *_ in given)
    return f"""
WITH t(template, text, label, percent, phrase) AS (VALUES {values}),
parts AS (SELECT template, label, percent, phrase, string_split(text, ' ') AS w FROM t),
sets AS MATERIALIZED (SELECT DISTINCT template, label, percent, phrase, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS token FROM parts),
sizes AS (SELECT template, count(*) AS m FROM sets GROUP BY template),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT r, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS token FROM d),
held AS MATERIALIZED (SELECT r, pos, token, pos // {step} AS half FROM g WHERE token IN (SELECT token FROM sets)),
blocks AS (SELECT r, half AS block, token FROM held UNION SELECT r, half - 1, token FROM held WHERE half > 0),
found AS (SELECT r, label, count(*) / max(m) AS score FROM blocks JOIN sets USING (token) JOIN sizes USING (template)
  WHERE NOT phrase GROUP BY r, block, template, label HAVING 100 * count(*) >= max(percent * m)),
places AS (SELECT r, label, i FROM (SELECT r, d.w AS w, p.w AS p, label, unnest(range(0, len(d.w) - len(p.w) + 1)) AS i FROM d, parts p
  WHERE phrase AND contains(array_to_string(d.w, ' '), array_to_string(p.w, ' '))) WHERE list_slice(w, i + 1, i + len(p)) = p),
every AS (SELECT r, label, NULL AS i, score FROM found UNION ALL SELECT r, label, i, 1.0::DOUBLE FROM places),
per AS (SELECT r, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM every GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)
"""


ORACLE["op12_license_scan"] = _license_sql()


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tokenloom.llm.alignment import compare_tokenizers

    return compare_tokenizers(_table(spark, sf_dir, "documents"), *[public_tokenizers.path(f) for f in (
        "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")])
