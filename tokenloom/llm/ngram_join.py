"""Similarity join of documents on word shingles with adaptive multi-match prefixes.

Tokens (shingles) have one order, rare before frequent.  A document of n tokens that may link only
with an overlap of t or more shares, for every l, at least l tokens with each partner among the first
n - t + l of both.  Each document picks its own l: a longer prefix reads more postings, but bounds the
candidates by postings / l, and the cheapest sum of both wins.  Two documents are compared at the
smaller l of the two and become a candidate only with that many shared tokens.

Copies of one set are one node.  Candidates from posting lists up to ``LIST`` are held to a bound on their
difference from sketches, one or two bits a shingle, which drops accidental ones without their texts.  What is
left, and stars over longer lists, gives families.  A large family is first taken apart by the same bound, in pairs
of blocks of sketches.  A family is verified exactly on whole texts in one task, or if it still is large in
pairs of blocks cut by set size.  A task returns a spanning forest of the links it finds, so a family of near
copies never becomes a table of its pairs, and a text travels once or a few times, not once a pair; texts of
documents without a candidate don't travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import keyed_texts, ready, row_key
from tokenloom.llm.components import components
from tokenloom.llm.words import FOLDED, mix, words_of
from tokenloom.session import materialise

CELLS = 1 << 24      # cells, a byte each, in which the order finds how frequent tokens are; a fixed size
STRIPE = 1 << 16     # cells that one row brings to the driver
OCTAVE = 8           # steps of such a byte for twice the count
LEVELS = 8           # prefixes a document chooses from
VERIFY = 8.0         # cost of a candidate in postings
LIST = 64            # posting lists up to this length give pairs
BLOCK = 512          # documents of a block, and
SHINGLES = 1 << 23   # shingles of its texts together (64 MB of hashes), unless one alone has more
HELD = 1 << 22       # tokens a task counts before it passes them on; the more, the fewer frequent ones it misses
PART = 1 << 19       # tokens compared at once
ROWS = 64            # rows of a matrix judged at once
COLUMNS = 4096       # tokens of one matrix product
SKETCH = 64          # bits of a sketch, at least
SKETCHES, BITS = 1024, 1 << 24   # sketches of a block, and shingles of its documents together
WORDS = 1 << 20      # words of sketches compared at once
MARKED = 1 << 23     # bits of the map that keeps texts without a partner from a join; a fixed size


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each row; all words as one where there are fewer than ``n``."""
    for words in words_of(column, FOLDED):
        bounds = np.searchsorted(words.row, np.arange(words.rows + 1))
        grams = words.grams(n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in words.hash[a:b]:
                    short = mix(np.array([short * np.uint64(0x9E3779B97F4A7C15) ^ h]))[0]
                yield np.array([short], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(8)) % np.uint64(CELLS)).astype(np.int64)


def _counts(n: int):
    """Cells of the tokens that several documents of a task hold, with the number of these."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts):
            token, count = np.unique(np.concatenate(parts), return_counts=True)
            cell, at = np.unique(_cells(token[count > 1]), return_inverse=True)
            return pa.record_batch({"cell": pa.array(cell), "c": pa.array(np.bincount(at, count[count > 1], len(cell)).astype(np.int64))})

        with np.errstate(over="ignore"):
            parts, held = [], 0
            for batch in batches:
                for own in shingle_sets(batch.column("text"), n):
                    parts.append(own)
                    held += len(own)
                if held >= HELD:
                    yield summed(parts)
                    parts, held = [], 0
            if parts:
                yield summed(parts)
    return task


def _stripe(table: pa.Table) -> pa.Table:
    """One row for the cells of a stripe: a byte each, 0 or the logarithm of the count."""
    out = np.zeros(STRIPE, dtype=np.uint8)
    out[table.column("cell").to_numpy() % STRIPE] = np.minimum(255, np.rint(OCTAVE * np.log2(table.column("c").to_numpy())))
    return pa.table({"stripe": table.column("stripe").slice(0, 1), "level": pa.array([out.tobytes()], pa.binary())})


def _frequencies(keyed: DataFrame, n: int) -> np.ndarray:
    """How frequent the tokens of each cell are, as bytes (``_stripe``).

    A token of a cell with others counts as their sum; the order stays one for all documents, and that is all that
    the prefixes need.
    """
    counted = keyed.mapInArrow(_counts(n), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    striped = counted.withColumn("stripe", F.floor(F.col("cell") / STRIPE).cast("long")).groupBy("stripe").applyInArrow(_stripe, "stripe long, level binary")
    out = np.zeros(CELLS, dtype=np.uint8)
    for row in striped.toArrow().to_pylist():
        out[row["stripe"] * STRIPE:(row["stripe"] + 1) * STRIPE] = np.frombuffer(row["level"], dtype=np.uint8)[:CELLS]
    return out


def sketch(own: np.ndarray) -> bytes:
    """A bit for each of as many buckets as there are shingles, or up to twice as many: whether it has an odd number of them.

    A shingle that only one of two sets holds changes one bit, so sketches differ in no more bits than the sets in shingles.
    """
    bits = max(SKETCH, 1 << (max(1, len(own)) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, as those with so many words of 64 bits: two buckets become one."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with ``total`` shingles together can link if ``differ`` or more stand in one of them only."""
    both = (total - differ) // 2
    return 100 * both >= percent * (total - both)


def choose_level(frequency: np.ndarray, size: int, needed: int) -> int:
    """The l of a document whose tokens have these frequencies, in their order.

    Documents that share l tokens with it are at most (postings read) / l.
    """
    read = np.cumsum(frequency[:size - needed + min(LEVELS, needed)] - 1)[size - needed:]
    level = np.arange(1, len(read) + 1)
    return int(np.argmin(read + VERIFY * read / level)) + 1


def _prefixes(n: int, percent: int, frequent):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                size, f1, f2, level, prefix, marks = [], [], [], [], [], []
                for own in shingle_sets(batch.column("text"), n):
                    m = len(own)
                    needed = -(-percent * m // 100)
                    size.append(m)
                    f1.append(int(np.add.reduce(mix(own)).view(np.int64)) if m else 0)
                    f2.append(int(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if m else 0)
                    seen = known[_cells(own)]
                    order = np.lexsort((own, seen))
                    chosen = choose_level(np.exp2(seen[order] / OCTAVE), m, needed) if m else 0
                    level.append(chosen)
                    prefix.append(own[order[:m - needed + chosen]].view(np.int64))
                    marks.append(sketch(own))
                yield pa.record_batch([
                    batch.column("doc"), batch.column("tag"), batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()), pa.array(level, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc", "tag", "doc_id", "n", "f1", "f2", "level", "prefix", "sketch"])
    return task


def _bounded(percent: int):
    """Keeps pairs whose sketches differ in so few bits that they can link."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], dtype=np.int64).reshape(-1, 2)
            good = np.zeros(len(x), dtype=bool)
            for size in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == size).all(axis=1))
                pair = [np.frombuffer(b"".join(side[i] for i in at), dtype="<u8").reshape(len(at), -1) for side in (x, y)]
                one, two = (folded(p, int(size.min()) // 8) for p in pair)
                good[at] = _near(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64), total[at], percent)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))
    return task


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of incidence matrices.

    The sets are sorted, so a range of tokens is a slice of each; ranges of about ``PART`` tokens and
    products of ``COLUMNS`` tokens bound the memory.
    """
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    parts = 1 + sum(map(len, sets)) // PART
    bounds = [np.uint64(k * ((1 << 64) // parts)) for k in range(1, parts)]
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]).astype(np.int64) for s in sets]
    for k in range(parts):
        own = [s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)]
        row = np.repeat(np.arange(len(own)), [len(s) for s in own])
        token, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)[1:]
        shared = times[token] > 1
        row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
            a, b = np.searchsorted(token, (low, low + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            part[row[a:b], token[a:b] - low] = 1
            out += part @ part.T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """One edge to a root for each linked row but the roots."""
    left, edges = np.ones(len(linked), dtype=bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        found = edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(axis=0) & left)
            left[edge] = False
            found = np.concatenate([found, edge])
        edges += [(i, int(j)) for j in found[1:]]
    return edges


KEY = ["family", "s1", "i", "s2", "j"]


def _by_text(n: int, percent: int):
    """Spanning forest of the links of a group, from its texts."""
    def links(group: pa.Table) -> list[tuple[int, int]]:
        node = group.column("node").to_numpy()
        sets = [s for chunk in group.column("text").chunks for s in shingle_sets(chunk, n)]
        size, both = np.array([len(s) for s in sets], dtype=np.int64), overlaps(sets)
        linked = np.empty(both.shape, dtype=bool)
        for r in range(0, len(sets), ROWS):
            own = both[r:r + ROWS].astype(np.int64)
            linked[r:r + ROWS] = 100 * own >= percent * (size[r:r + ROWS, None] + size - own)
        return [(int(node[i]), int(node[j])) for i, j in forest(linked)]
    return links


def _by_sketch(percent: int):
    """Spanning forest of the pairs of a group that its sketches allow."""
    def links(group: pa.Table) -> list[tuple[int, int]]:
        node, size, marks = group.column("node").to_numpy(), group.column("n").to_numpy().astype(np.int64), group.column("sketch").to_pylist()
        words = min(map(len, marks)) // 8
        own = np.concatenate([folded(np.frombuffer(m, dtype="<u8")[None], words) for m in marks])
        rows = max(1, WORDS // own.size)
        linked = np.empty((len(own), len(own)), dtype=bool)
        for r in range(0, len(own), rows):
            differ = np.bitwise_count(own[r:r + rows, None] ^ own).sum(axis=2, dtype=np.int64)
            linked[r:r + rows] = _near(differ, size[r:r + rows, None] + size, percent)
        return [(int(node[i]), int(node[j])) for i, j in forest(linked)]
    return links


def _verify(links):
    """What ``links`` finds in each group of ``KEY``; groups come sorted, the last of a batch waits for its rest."""
    def solve(table: pa.Table, stop: bool) -> tuple[pa.RecordBatch, pa.Table]:
        key = np.stack([table.column(k).to_numpy() for k in KEY])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        cuts = [0, *cuts.tolist(), *([len(table)] if stop else [])]
        found = [e for a, b in zip(cuts[:-1], cuts[1:]) for e in links(table.slice(a, b - a))]
        edges = pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
        return edges, table.slice(cuts[-1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        with np.errstate(over="ignore"):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                edges, rest = solve(pa.concat_tables([rest, table]) if rest is not None else table, False)
                yield edges
            if rest is not None and len(rest):
                yield solve(rest, True)[0]
    return task


def _sized(members: DataFrame, percent: int) -> DataFrame:
    """Adds the step of size ``s`` to members ``(node, n, family)`` of families of more than ``BLOCK`` documents or ``SHINGLES`` shingles; null in others.

    Sets that link differ by one step at most.
    """
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    counts = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    large = (F.col("size") > BLOCK) | ((F.col("size") > 1) & (F.col("shingles") > SHINGLES))
    return materialise(members.join(counts, "family").select("node", "family", "n", F.when(large, F.floor(F.log("n") / step)).cast("bigint").alias("s")), "members")


def _tasks(sized: DataFrame, block: int, shingles: int) -> DataFrame:
    """Tasks ``(family, s1, i, s2, j, node)`` that bring all pairs together that can link.

    A family without steps is one task.  In a larger one each step is cut into blocks and each pair of blocks of a step
    or of neighbouring steps is a task.
    """
    whole = sized.where("s is null").select("family", *[F.lit(0).cast(t).alias(c) for c, t in zip(KEY[1:], ("bigint", "int") * 2)], "node")
    large = sized.where("s is not null")
    need = F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / shingles)))
    cuts = materialise(large.groupBy("family", "s").agg(need.cast("int").alias("blocks")), "blocks")
    own = large.join(cuts, ["family", "s"]).withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    above = cuts.select("family", (F.col("s") - 1).alias("s"), F.col("blocks").alias("up"))
    below = cuts.select("family", (F.col("s") + 1).alias("s"), F.col("blocks").alias("down"))
    own = own.join(above, ["family", "s"], "left").join(below, ["family", "s"], "left")
    each = lambda n: f"transform(sequence(0, {n} - 1), j -> "
    return whole.union(own.select("family", "node", F.explode(F.expr(f"""flatten(array(
        {each('blocks')} named_struct('s1', s, 'i', least(i, j), 's2', s, 'j', greatest(i, j))),
        if(up is null, array(), {each('up')} named_struct('s1', s, 'i', i, 's2', s + 1, 'j', j))),
        if(down is null, array(), {each('down')} named_struct('s1', s - 1, 'i', j, 's2', s, 'j', i)))))""")).alias("t")
    ).select("family", "t.*", "node"))


def _marked(keys: DataFrame) -> DataFrame:
    """The map of the keys' ``tag``, 64 bits a row, broadcast: its size is fixed, the more keys the more others pass."""
    bit = F.pmod("tag", F.lit(MARKED))
    return F.broadcast(keys.select(F.shiftright(bit, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(tag, {MARKED}) & 63 as int))").alias("bit"))
                       .groupBy("__word").agg(F.bit_or("bit").alias("__bits")))


def _held(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows with ``tag`` and what the map has for them in ``__held``: false is certain, true is not."""
    bit = F.expr(f"cast(pmod(tag, {MARKED}) & 63 as int)")
    found = rows.withColumn("__word", F.shiftright(F.pmod("tag", F.lit(MARKED)), 6)).join(marked, "__word", "left")
    return found.withColumn("__held", F.coalesce(F.getbit("__bits", bit) == 1, F.lit(False))).drop("__word", "__bits")


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents linked by ``100 * |A & B| >= percent * |A | B|`` on ``n``-word shingles.

    Returns ``doc_id, n_shingles, component_id``, the row key ``doc, tag`` and ``root``, a number of the
    component (null for empty texts), a row per row of ``docs``.  A-Z are lower-cased.  ``component_id`` is the least id of the component, null ids left out
    (null if it has no other).  Empty and null texts link with nothing and keep their own id.  Rows that
    repeat an id are documents of their own; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark = ready(docs)
    keyed = keyed_texts(docs)
    frequent = spark.sparkContext.broadcast(_frequencies(keyed.select("text"), n))
    sets = materialise(keyed.mapInArrow(_prefixes(n, percent, frequent),
                                        "doc long, tag long, doc_id long, n int, f1 long, f2 long, level int, prefix array<long>, sketch binary"), "sets")
    nodes = (sets.where("n > 0").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc", "tag", "n", "level", "prefix", "sketch")).alias("p")))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).select("node", "f1", "f2", "least", "p.*"), "nodes")
    postings = nodes.select("node", "n", "level", F.ceil((F.col("n") * percent) / F.lit(100)).cast("int").alias("needed"),
                            F.posexplode("prefix").alias("i", "token")).select(
        "token", "node", "n", "level", F.greatest(F.lit(1), F.col("i") - F.col("n") + F.col("needed") + 1).alias("at"))
    lists = materialise(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "lists")
    shared = materialise(postings.join(lists.hint("merge"), "token"), "postings")

    cold = shared.where(F.col("c") <= LIST)
    left, right = (cold.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "level", "at")]) for side in "ab")
    least_level = F.least("level_a", "level_b")
    pairs = (left.join(right, "token")
             .where((F.col("node_a") < F.col("node_b")) & (F.greatest("at_a", "at_b") <= least_level)
                    & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
             .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
             .agg(F.count("*").alias("matches"), F.min(least_level).alias("level")).where("matches >= level").select("a", "b"))
    marks = nodes.select("node", "n", "sketch")
    # Joined by sorting at every size: what is looked up grows with the corpus.
    left, right = (marks.toDF(*[f"{c}_{side}" for c in ("node", "n", "sketch")]).withColumnRenamed(f"node_{side}", side) for side in "ab")
    close = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b").mapInArrow(_bounded(percent), "a long, b long")
    hot = materialise(shared.where(F.col("c") > LIST).select("token", "node"), "hot")
    stars = hot.join(hot.groupBy("token").agg(F.min("node").alias("b")), "token").select(F.col("node").alias("a"), "b")
    family = components(close.union(stars))
    members = _sized(nodes.select("node", "n").join(family.withColumnRenamed("root", "family"), "node"), percent)
    large = members.where("s is not null")
    if not large.isEmpty():
        blocks = materialise(_tasks(large, SKETCHES, BITS), "blocks")
        parts = components(blocks.hint("merge").join(marks, "node").repartition(*KEY).sortWithinPartitions(*KEY, "node")
                           .mapInArrow(_verify(_by_sketch(percent)), "a long, b long"))
        apart = large.select("node", "n").join(parts.withColumnRenamed("root", "family"), "node")
        members = _sized(members.where("s is null").select("node", "n", "family").union(apart.select("node", "n", "family")), percent)
    tasks = materialise(_tasks(members, BLOCK, SHINGLES).join(nodes.select("node", "doc", "tag"), "node"), "tasks")
    wanted = _held(keyed.select("doc", "tag", "text"), _marked(tasks)).where("__held").drop("__held")
    found = (tasks.hint("merge").join(wanted, ["doc", "tag"]).select(*KEY, "node", "text")
             .repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(_verify(_by_text(n, percent)), "a long, b long"))
    root = components(found)

    placed = nodes.select("node", "f1", "f2", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "roots")
    least = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialise(placed.join(least, "root").select("f1", "f2", "root", "component_id"), "named")
    full = sets.where("n > 0").select("doc", "tag", "doc_id", "n", "f1", "f2").join(named, ["f1", "f2"])
    empty = sets.where("n = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("bigint")})
    columns = ["doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", "doc", "tag", "root"]
    return full.select(*columns).union(empty.select(*columns))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with all their columns, one for each component: that with the least id, null ids last.

    Empty and null texts are in no component and all stay.
    """
    groups = materialise(similar_groups(docs, n, percent).select("doc_id", "doc", "tag", "root"), "groups")
    first = groups.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc", "tag")).alias("p"))
    keep = first.select("p.doc", "p.tag", F.lit(False).alias("all")).union(
        groups.where("root is null").select("doc", "tag", F.lit(True)).distinct())
    keep = keep.toDF("__doc", "tag", "__all")
    # Rows alone in their component stay without a join; their texts don't travel.
    several = groups.where("root is not null").groupBy("root").agg(F.count("*").alias("rows")).where("rows > 1")
    marked = _marked(groups.join(several, "root").select("tag"))
    doc, tag = row_key()
    held = _held(docs.select(F.struct(*docs.columns).alias("__row"), doc.alias("__doc"), tag.alias("tag")), marked)
    kept = held.where("__held").join(keep, ["__doc", "tag"])
    # Rows that repeat the kept one share its key; one of them stays.
    again = F.row_number().over(Window.partitionBy("__doc", "tag").orderBy("__all"))
    kept = kept.withColumn("__again", again).where("__all or __again = 1")
    return kept.select("__row.*").union(held.where("not __held").select("__row.*"))
