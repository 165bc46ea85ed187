"""Token ids as Catalyst expressions.

A token sequence has two column forms: ``ARRAY<INT>`` (the public one) and a *token
string*, a STRING with one character per token.  The second form turns a merge into
``replace`` and a concatenation into ``concat``, which run inside generated code.
Ids map to code points one to one; ids from the surrogate range on are shifted past it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary layout and names of the special tokens.
DOWN_ID = 256
UP_ID = 257
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]
SPECIAL_IDS = {name: 258 + i for i, name in enumerate(SPECIAL_TOKENS)}
BOS_ID = 258
USER_START_ID, USER_END_ID = 259, 260
ASSISTANT_START_ID, ASSISTANT_END_ID = 261, 262
PYTHON_START_ID, PYTHON_END_ID = 263, 264
OUTPUT_START_ID, OUTPUT_END_ID = 265, 266
FIRST_MERGE_ID = 267
IGNORED_TARGET = -1

# The separators of the word splitter.
WORD = r"[^()\[\]{}\n\t=:., ]+"
BRACKET = r"[()\[\]{}]"
CLOSER = r"[)\]}]"

_SURROGATES = 0x800
# Tokens a token string can hold; the last characters stay free for separators.
MAX_TOKENS = 0x10FFF0 - _SURROGATES
_DOWN, _UP = chr(DOWN_ID), chr(UP_ID)
# Characters above byte range stand for an unmatched closer and for the word break before it.
_LOOSE = {")": "Đ", "]": "đ", "}": "Ē"}
_BREAK = "ē"
_MARKED_WORD = r"[^()\[\]{}\n\t=:., " + _BREAK + "]+"
_LEADING_SPECIALS = "^(?:" + "|".join(s.replace("|", r"\|") for s in SPECIAL_TOKENS) + ")+"


def token_char(token_id: int) -> str:
    return chr(token_id if token_id < 0xD800 else token_id + _SURROGATES)


def char_token(char: str) -> int:
    point = ord(char)
    return point if point < 0xD800 else point - _SURROGATES


def let(value: Column, body) -> Column:
    """Bind ``value`` once for an expression that mentions it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_string(text: Column) -> Column:
    """UTF-8 bytes of a text as a token string (ids 0-255)."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def token_string_ids(tokens: Column, vocab_size: int = 0) -> Column:
    """Token string to ``ARRAY<INT>``.  Only vocabularies that reach past the surrogates shift ids back."""
    read = lambda c: F.ascii(c)
    if vocab_size > 0xD800:
        read = lambda c: F.when(F.ascii(c) >= 0xE000, F.ascii(c) - _SURROGATES).otherwise(F.ascii(c))
    # The last character guards against the one-element split of an empty string.
    chars = F.split(F.concat(tokens, F.lit(" ")), "")
    return let(chars, lambda cs: F.transform(F.slice(cs, F.lit(1), F.size(cs) - 1), read))


def text_byte_ids(text: Column) -> Column:
    """UTF-8 bytes of a text as ``ARRAY<INT>``."""
    return token_string_ids(byte_string(text))


def strip_leading_specials(text: Column) -> Column:
    return F.when(text.startswith("<|"), F.regexp_replace(text, _LEADING_SPECIALS, "")).otherwise(text)


def leading_special_ids(text: Column) -> Column:
    """Ids of the special tokens a text starts with, in order."""
    head = F.regexp_extract(text, "(" + _LEADING_SPECIALS + ")", 1)
    names = F.regexp_extract_all(head, F.lit(r"<\|[a-z_]+\|>"), F.lit(0))
    catalogue = F.array(*[F.lit(s) for s in SPECIAL_TOKENS])
    return F.transform(names, lambda n: (F.array_position(catalogue, n) + (BOS_ID - 1)).cast("int"))


def _loose_closers(brackets: Column) -> Column:
    """Positions of closers that do not match the innermost open bracket.

    Only the open brackets and the misfits are carried, so the fold stays small even
    for texts full of balanced brackets.
    """
    opener_of = {")": "(", "]": "[", "}": "{"}
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("loose"), F.lit(0).alias("i"))

    def step(state, bracket):
        wanted = F.lit(None).cast("string")
        for closer, opener in opener_of.items():
            wanted = F.when(bracket == closer, F.lit(opener)).otherwise(wanted)
        closes = state["open"].endswith(wanted)
        is_opener = wanted.isNull()
        return F.struct(
            F.when(is_opener, F.concat(state["open"], bracket))
            .when(closes, F.left(state["open"], F.length(state["open"]) - 1))
            .otherwise(state["open"])
            .alias("open"),
            F.when(~is_opener & ~closes, F.concat(state["loose"], F.array(state["i"])))
            .otherwise(state["loose"])
            .alias("loose"),
            (state["i"] + 1).alias("i"),
        )

    return F.aggregate(brackets, start, step, lambda s: s["loose"])


def _mark_loose_closers(text: Column) -> Column:
    """Rewrite unmatched closers to a word break plus a stand-in character."""
    brackets = F.regexp_extract_all(text, F.lit(BRACKET), F.lit(0))
    stand_in = lambda b: F.concat(F.lit(_BREAK), F.translate(b, "".join(_LOOSE), "".join(_LOOSE.values())))

    def rebuild(loose):
        marked = F.transform(
            brackets, lambda b, i: F.when(F.array_contains(loose, i), stand_in(b)).otherwise(b))
        pieces = F.split(text, BRACKET, -1)
        parts = F.zip_with(pieces, F.concat(marked, F.array(F.lit(""))), lambda p, b: F.concat(p, b))
        return F.when(F.size(loose) > 0, F.array_join(parts, "")).otherwise(text)

    return let(_loose_closers(brackets), rebuild)


def _restore_closers(text: Column) -> Column:
    return F.translate(text, "".join(_LOOSE.values()) + _BREAK, "".join(_LOOSE))


def split_words(text: Column) -> Column:
    """Words between separators, as ``ARRAY<STRING>``.

    Separators end a word.  A closer that matches the innermost open bracket is a
    separator too; any other closer begins the next word as plain text.  Leading
    special tokens are not words.
    """
    body = strip_leading_specials(text)
    plain = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    marked = F.regexp_extract_all(_mark_loose_closers(byte_string(body)), F.lit(_MARKED_WORD), F.lit(0))
    bracketed = F.transform(
        marked, lambda w: F.decode(F.encode(_restore_closers(w), "ISO-8859-1"), "UTF-8")
    )
    return F.when(body.rlike(CLOSER), bracketed).otherwise(plain)


def framed_token_string(text: Column) -> Column:
    """Bytes of a text as a token string with every word framed by the two markers."""
    raw = byte_string(strip_leading_specials(text))
    plain = F.regexp_replace(raw, WORD, _DOWN + "$0" + _UP)
    bracketed = _restore_closers(
        F.regexp_replace(_mark_loose_closers(raw), _MARKED_WORD, _DOWN + "$0" + _UP)
    )
    return F.when(raw.rlike(CLOSER), bracketed).otherwise(plain)


def word_merges(merges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The merges that can occur inside a word.

    A word holds no separator, and a closer only as its first byte.  Leaving other merges
    out lets the rest run over whole framed texts, separators included.
    """
    spelled = {i: bytes([i]) for i in range(256)}
    kept = []
    for a, b, new_id in sorted(merges, key=lambda m: m[2]):
        left, right = spelled.get(a), spelled.get(b)
        if left is None or right is None:
            continue
        joined = left + right
        if not any(c in b"([{\n\t=:., " for c in joined) and not any(c in b")]}" for c in joined[1:]):
            spelled[new_id] = joined
            kept.append((a, b, new_id))
    return kept


def apply_merges(tokens: Column, merges: list[tuple[int, int, int]]) -> Column:
    """Apply ``(a, b, id)`` merges in id order.

    Replacing all occurrences of one merge before the next equals the rule "lowest id
    first, leftmost first": a merge only ever creates pairs with higher ids.
    """
    return reduce(
        lambda acc, m: F.replace(acc, F.lit(token_char(m[0]) + token_char(m[1])), F.lit(token_char(m[2]))),
        sorted(merges, key=lambda m: m[2]),
        tokens,
    )


def finish_token_string(framed: Column, text: Column, markers: bool) -> Column:
    """Drop or trim the markers and put leading special tokens in front."""
    if markers:
        body = F.regexp_replace(framed, _UP + "+$", "")
    else:
        body = F.translate(framed, _DOWN + _UP, "")
    ids = leading_special_ids(text)
    specials = F.array_join(
        F.transform(ids, lambda i: F.element_at(
            F.array(*[F.lit(token_char(x)) for x in SPECIAL_IDS.values()]), i - (BOS_ID - 1))), ""
    )
    return F.concat(F.when(text.startswith("<|"), specials).otherwise(F.lit("")), body)


def encode_text(text: Column, merges=(), markers: bool = True, prepend: int | None = None,
                append: int | None = None) -> Column:
    """Text to ``ARRAY<INT>`` with a short merge list, all inside the JVM."""
    framed = apply_merges(framed_token_string(text), word_merges(list(merges)))
    tokens = finish_token_string(framed, text, markers)
    if prepend is not None:
        tokens = F.concat(F.lit(token_char(prepend)), tokens)
    if append is not None:
        tokens = F.concat(tokens, F.lit(token_char(append)))
    return token_string_ids(tokens, FIRST_MERGE_ID + len(list(merges)))


def adjacent_pairs(ids: Column) -> Column:
    """Consecutive ids as ``ARRAY<STRUCT<a, b>>``; overlapping windows, so ``aaaa`` has three."""
    n = F.size(ids)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    ).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def truncate_tokens(ids: Column, limit: int = 2048) -> Column:
    return F.slice(ids, 1, limit)


def ids_text(ids: Column) -> Column:
    """Ids as comma separated text (report and comparison form)."""
    return F.array_join(ids.cast("array<string>"), ",")
