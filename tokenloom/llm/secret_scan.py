"""Secret scan with corpus-wide ownership.

Texts are scanned for candidates of four kinds, once for each and again only where there are some; the values are hashed and the hashes counted over the
whole corpus by distinct repositories and distinct owners.  A value that many owners hold is a copied
example; one that stays with few and looks random is live.  Candidates of the three base kinds are always
reported; long mixed runs (``owned``) only if they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, row_key
from tokenloom.session import materialise

_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
#: Kind, pattern, group of the value, least length of the value; in the order of the report.
KINDS = [
    ("assign", rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a shorter run is no match, and no run holds a longer one
    ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
]
BASE = 3           # of the kinds
OWNERS = 2         # a live value has no more distinct owners
REPOSITORIES = 4   # and no more distinct repositories


def looks_random(value: Column) -> Column:
    """Letters and digits mixed, no character five times in a row, no placeholder."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(.)\1{4}")
            & ~F.lower(value).rlike("example|placeholder|changeme|dummy|sample"))


def _may_hold(name: str, text: Column) -> Column:
    if name == "assign":
        return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.contains(text, F.lit("AKIA")) if name == "access" else F.lit(True)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document, without its text: per kind the lengths between matches, and the matches."""
    rows = keyed_texts(docs, owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    text = F.col("text")
    found = []
    for name, pattern, group, _ in KINDS:
        parts = [F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"),
                 F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
                 F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")]
        # Three passes only over a text that one pass, or a cheaper look, does not rule out.
        found.append(F.when(_may_hold(name, text) & text.rlike(pattern), F.arrays_zip(*parts)).alias(name))
    return rows.select("doc", "tag", "doc_id", "owner", "repository", *found)


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Secrets of every document with what the corpus says about them.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example`` and, for joins,
    ``doc, tag`` and ``places`` (sorted ``start, end``), a row per row of ``docs``.  ``owner`` is ``source`` and
    ``repository`` source and language unless given; nulls are an owner of their own.  Positions are code
    points, the end is exclusive.  A null text has no secrets; rows that repeat an id are reported each.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    stored = materialise(candidates(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "candidates")
    spans = None
    for k, (name, _, _, least) in enumerate(KINDS):
        each = stored.where(F.size(name) > 1).select("row", "owner", "repository", F.posexplode(name).alias("i", "z"))
        order = Window.partitionBy("row").orderBy("i")
        end = F.sum(F.col("z.gap") + F.coalesce(F.col("z.size"), F.lit(0))).over(order)
        each = each.withColumn("end", end).where(F.length("z.value") >= least).select(
            "row", "owner", "repository", F.lit(k).alias("kind"), (F.col("end") - F.col("z.size")).alias("start"), "end",
            F.sha2(F.col("z.value").cast("binary"), 256).alias("hash"), looks_random(F.col("z.value")).alias("random"))
        spans = each if spans is None else spans.union(each)
    spans = materialise(spans, "spans")
    # Copies within one owner and repository fold before the distinct counts.
    nothing = F.lit("")
    held = spans.select("hash", F.coalesce("owner", nothing).alias("owner"), F.coalesce("repository", nothing).alias("repository")).distinct()
    known = materialise(held.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("r").alias("repositories")), "owners")
    # A value of the base kinds may be seen as a long run too; the place counts once.
    base = spans.where(F.col("kind") < BASE)
    more = spans.where((F.col("kind") >= BASE) & F.col("random")).join(
        base.select("row", "start", "end").distinct(), ["row", "start", "end"], "left_anti")
    judged = base.select("row", "kind", "start", "end", "hash").union(more.select("row", "kind", "start", "end", "hash")).join(known, "hash")
    live = (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)
    judged = judged.withColumn("live", live).where((F.col("kind") < BASE) | F.col("live"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text_of = lambda items: F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("items"),
        *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(BASE)],
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    items = F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT>>)"))
    zero = F.lit(0).cast("bigint")
    out = stored.select("row", "doc", "tag", "doc_id").join(per, "row", "left").withColumn("items", items)
    return out.select(
        "doc_id", *[F.coalesce(f"n{k}", zero).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(text_of(F.filter("items", lambda s: s["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("items")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
        "doc", "tag", F.transform("items", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("places"))


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported place of every text replaced by ``mark``; ``n_chars`` follows if it is there.

    All rows and columns stay.  Overlapping places are one.  What the base kinds find goes whether it is live or a copied
    example: an example has the form of a key and teaches to write keys into texts.  Ownership decides on the
    fourth kind, whose long mixed runs are masked only where they are live.
    """
    places = (scan_secrets(docs).where("size(places) > 0").groupBy("doc", "tag")
              .agg(F.first("places").alias("places")))
    joined = docs.withColumns(dict(zip(("__doc", "__tag"), row_key()))).join(
        places.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("places").alias("__places")), ["__doc", "__tag"], "left")
    cut = F.aggregate("__places", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.array_append(a["parts"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))))
        .otherwise(a["parts"]).alias("parts")))
    joined = joined.withColumn("__cut", F.when(F.col("__places").isNotNull(), cut))
    masked = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join("__cut.parts", mark), F.lit(mark), F.substring(F.col("text"), (F.col("__cut.at") + 1).cast("int"), F.length("text"))))
    out = joined.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
