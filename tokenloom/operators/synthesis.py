"""Problem generators: every row of a seed table becomes one problem.

All draws hash the seed of the row, so any partitioning and any retry give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenloom.functions import chat, expressions, games
from tokenloom.functions.draws import digest, draw_index, draw_unit, pick
from tokenloom.functions.tokens import let
from tokenloom.operators.corpus import valid_problems
from tokenloom.operators.offsets import dense_index, digest_levels
from tokenloom.session import materialise

# The alphabet and the question forms of the letter-counting task.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
QUESTION_FORMS = [
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
]
QUOTES = ["", "'", '"']


SEEDS = 1 << 16   # of a task, about
BLOCK, BLOCK_BYTES = 1 << 18, 1 << 28   # seeds that share the texts they draw, and bytes of text of their draws, at most


def dealt(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Seeds dealt over tasks whose work does not grow with the table; a file of seeds is small, what is made of it is not."""
    tasks = max(seeds.sparkSession.sparkContext.defaultParallelism, -(-seeds.count() // SEEDS))
    return seeds.repartition(tasks, seed)


def _split_seed(idx: Column, split: str) -> Column:
    """Train and test draws never share a seed."""
    if split not in ("train", "test"):
        raise ValueError("split must be train or test")
    return idx if split == "train" else -(idx + 1)


# The sentences of a letter-counting answer, in their order.
ASKED = "We are asked to find the number '"
IN_WORD = "' in the word '"
MANUAL = "'. Let me try a manual approach first.\n\nFirst spell the word out:\n"
COUNT = "\n\nThen count the occurrences of '"
HIT = " hit! count="
GIVES = "\nThis gives us "
CHECK = "\n\nLet me double check this using Python:\n\n"
PYTHON = "\n\nPython gives us "
FINAL = ".\n\nMy final answer is:\n\n#### "


def number_words(words: DataFrame, seed: int = 0) -> DataFrame:
    """``word, word_idx``: distinct words in a seeded order."""
    keyed = words.select("word").distinct().withColumn("__k", digest("words", seed, F.col("word")))
    return dense_index(keyed, [F.col("__k"), F.col("word")], digest_levels(F.col("__k")), out="word_idx").drop("__k")


def _with_word(seeds: DataFrame, words: DataFrame, split: str, idx: str, order: int) -> DataFrame:
    # Stored, because the draw needs the vocabulary size before the words.
    numbered = materialise(number_words(words, order), "vocabulary")
    n = numbered.count()
    seeded = seeds.withColumn("__s", _split_seed(F.col(idx), split))
    return seeded.withColumn("word_idx", draw_index(n, "word", order, F.col("__s"))).join(numbered, "word_idx")


def spelling_bee(seeds: DataFrame, words: DataFrame, split: str = "train", idx: str = "idx") -> DataFrame:
    """Letter-counting conversations: ``idx, word, letter, n, messages``."""
    rows, s, w = _with_word(seeds, words, split, idx, 0), F.col("__s"), F.col("word")
    own = F.substring(w, (draw_index(F.length(w), "char", s) + 1).cast("int"), F.lit(1))
    any_letter = F.substring(F.lit(LETTERS), (draw_index(26, "letter", s) + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("letter", F.when(draw_unit("own", s) < 0.9, own).otherwise(any_letter))
    letter = F.col("letter")
    form = pick(QUESTION_FORMS, "form", s)
    form = F.when(draw_unit("lower", s) < 0.3, F.lower(form)).otherwise(form)
    quoted = lambda q, x: F.concat(pick(QUOTES, q, s), x, pick(QUOTES, q, s))
    asked = F.replace(F.replace(form, F.lit("{letter}"), quoted("lq", letter)), F.lit("{word}"), quoted("wq", w))
    asked = F.concat(asked, F.when(draw_unit("mark", s) < 0.5, "?").otherwise(""))
    chars = F.split(w, "")
    is_hit = lambda c: (c == letter).cast("int")
    so_far = lambda cs, i: F.aggregate(F.slice(cs, F.lit(1), i + 1), F.lit(0), lambda a, c: a + is_hit(c))
    lines = let(chars, lambda cs: F.transform(cs, lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit(":"), c,
        F.when(c == letter, F.concat(F.lit(HIT), so_far(cs, i).cast("string"))).otherwise(""), F.lit("\n"))))
    n = F.col("n").cast("string")
    rows = rows.withColumn("n", F.aggregate(chars, F.lit(0), lambda a, c: a + is_hit(c)))
    manual = F.concat(
        F.lit(ASKED), letter, F.lit(IN_WORD), w, F.lit(MANUAL), w, F.lit(":"), F.array_join(chars, ","),
        F.lit(COUNT), letter, F.lit("':\n"), F.array_join(lines, ""), F.lit(GIVES), n, F.lit("."))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.array(
        part("text", manual), part("text", F.lit(CHECK)),
        part("python", F.concat(F.lit("'"), w, F.lit("'.count('"), letter, F.lit("')"))), part("python_output", n),
        part("text", F.concat(F.lit(PYTHON), n, F.lit(FINAL), n)))
    messages = F.array(chat.message("user", asked), chat.message("assistant", parts=parts))
    return rows.select(idx, "word", "letter", "n", messages.alias("messages"))


def simple_spelling(seeds: DataFrame, words: DataFrame, split: str = "train", idx: str = "idx") -> DataFrame:
    """Spelling conversations, over an order of the words of its own."""
    rows, w = _with_word(seeds, words, split, idx, 42), F.col("word")
    messages = F.array(chat.message("user", F.concat(F.lit("Spell the word: "), w)),
                       chat.message("assistant", F.concat(w, F.lit(":"), F.array_join(F.split(w, ""), ","))))
    return rows.select(idx, "word", messages.alias("messages"))


# ---------------------------------------------------------------- expressions

def expression_problems(seeds: DataFrame, seed: str = "seed", until_valid: bool = True, wanted: str | None = None) -> DataFrame:
    """Random arithmetic problems: ``prompt, json, answer``; one per seed row.

    The code text is fully bracketed and shows the guard of the division, so it evaluates
    to the answer; the natural text keeps brackets optional.  Without ``until_valid`` the
    first draw counts and rows without a usable answer are left out.  ``wanted`` names a
    BOOLEAN column; rows that are not wanted stay, with null texts and 0 as answer.
    """
    schema = StructType(list(seeds.schema.fields)).add("prompt", "string").add("json", "string").add("answer", "double")

    def make(batches):
        for batch in batches:
            need = batch[wanted] if wanted else [True] * len(batch)
            made = [expressions.problem(s, until_valid) if n else (None, None, 0.0) for s, n in zip(batch[seed], need)]
            yield batch.assign(**{name: [m[i] for m in made] for i, name in enumerate(("prompt", "json", "answer"))})

    return valid_problems(seeds.mapInPandas(make, schema))


# ---------------------------------------------------------------- games

def game_dialogues(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Dialogues of 3-7 random legal moves that stop at a win: ``moves, messages, outcome``."""
    played = seeds.withColumn("__game", games.game(F.col(seed)))
    messages = F.transform("__game.said", lambda t, i: chat.message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))
    return played.select(*seeds.columns, "__game.moves", messages.alias("messages"), "__game.outcome")


# ---------------------------------------------------------------- requests and mixes

def drawn_requests(seeds: DataFrame, prompts: DataFrame, template: str, k: int = 5, seed: str = "seed", key: str = "conv_id",
                   text: str = "text", mark: str = "%USER_FIRST_PROMPTS%") -> DataFrame:
    """``seed, request``: the template with ``k`` texts drawn with replacement from a table of any size.

    Seeds are distinct.  Texts are numbered once in the order of ``key`` and fetched by their number.  A block of seeds
    gets each text it draws once, and its requests are put together where the block is: what is shuffled are the
    texts a block draws, not the texts of every draw.  Without texts the mark is replaced by nothing.
    """
    numbered = materialise(dense_index(prompts.select(key, text), [F.col(key)]).select("idx", text), "prompts")
    n, held = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    block = max(1, min(BLOCK, BLOCK_BYTES * max(n, 1) // (k * max(held, 1))))
    blocks = max(seeds.sparkSession.sparkContext.defaultParallelism, -(-seeds.count() // block))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(blocks, F.col("__b"))

    own = in_blocks(seeds.select(seed, F.pmod(F.xxhash64(seed), F.lit(blocks)).cast("int").alias("__b")))
    draws = own.select("__b", seed, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__i"))
    # Never null, so that the draw is not made once more to filter.
    draws = draws.withColumn("idx", F.coalesce(draw_index(max(n, 1), "starter", F.col(seed), F.col("__i")), F.lit(0)))
    fetched = in_blocks(draws.select("__b", "idx").distinct().join(numbered, "idx"))
    lists = draws.join(fetched, ["__b", "idx"], "left").groupBy("__b", seed).agg(F.array_sort(F.collect_list(F.struct("__i", text))).alias("__t"))
    drawn = F.array_join(F.transform("__t", lambda x: x[text]), "\n")
    return lists.select(seed, F.replace(F.lit(template), F.lit(mark), drawn).alias("request"))


def tool_requests(seeds: DataFrame, tools: Sequence[str], k: int = 5, seed: str = "seed") -> DataFrame:
    """Adds ``tools``: ``k`` of a short tool list drawn without replacement."""
    keyed = F.transform(F.array(*[F.lit(t) for t in sorted(tools)]), lambda t: F.struct(digest("tool", F.col(seed), t).alias("k"), t.alias("t")))
    return seeds.withColumn("tools", F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["t"]))
