"""Parsing and rendering of prompts, answers, reports and JSON, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.tokens import let

PARTS = "array<struct<type:string,text:string>>"


# ---------------------------------------------------------------- prompts

# The wording of a multiple choice prompt.
CHOICE_HEAD = "Multiple Choice question: "
CHOICE_TAIL = "\nRespond only with the letter of the correct answer."


def render_mc(question: Column, letters: Column, choices: Column) -> Column:
    options = F.array_join(F.zip_with(letters, choices, lambda l, c: F.concat(F.lit("- "), c, F.lit("="), l, F.lit("\n"))), "")
    return F.concat(F.lit(CHOICE_HEAD), question, F.lit("\n"), options, F.lit(CHOICE_TAIL))


def strip(text: Column) -> Column:
    """Both ends without white space (not only blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def render_icl_mc(shots: Column, query: Column, choices: Column, delimiter: Column) -> Column:
    """One prompt per choice; ``shots`` are structs with ``query, choices, gold``."""
    done = F.transform(shots, lambda e: F.concat(e["query"], delimiter, F.get(e["choices"], e["gold"]), F.lit("\n\n")))
    head = F.concat(F.array_join(done, ""), query, delimiter)
    return F.transform(choices, lambda c: F.concat(head, c))


def render_icl_schema(shots: Column, context_options: Column, continuation: Column, delimiter: Column) -> Column:
    """One prompt per context; ``shots`` have ``context_options, continuation, gold``."""
    done = F.transform(shots, lambda e: F.concat(
        F.get(e["context_options"], e["gold"]), delimiter, e["continuation"], F.lit("\n\n")))
    head = F.array_join(done, "")
    return F.transform(context_options, lambda c: F.concat(head, c, delimiter, continuation))


def render_icl_lm(shots: Column, context: Column, continuation: Column, delimiter: Column) -> Column:
    """Two prompts, without (stripped) and with the continuation."""
    done = F.transform(shots, lambda e: F.concat(strip(e["context"]), delimiter, e["continuation"], F.lit("\n\n")))
    head = F.concat(F.array_join(done, ""), strip(context), delimiter)
    return F.array(strip(head), F.concat(head, continuation))


# ---------------------------------------------------------------- answers

# Fixed value: where a worked answer states its result.
ANSWER = r"#### (-?[0-9.,]+)"


def extract_answer(completion: Column) -> Column:
    """Number after the first answer mark without commas; null when there is none."""
    return F.when(completion.rlike(ANSWER), F.replace(F.regexp_extract(completion, ANSWER, 1), F.lit(","), F.lit("")))


def tool_parts(answer: Column) -> Column:
    """``<<expr=result>>`` calls as python / python_output parts, the text around them as text parts."""
    texts = F.split(answer, "<<[^>]+>>", -1)
    calls = F.regexp_extract_all(answer, F.lit("<<([^>]+)>>"), F.lit(1))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    has = lambda c: F.contains(c, F.lit("="))

    def of_call(c):
        expr = F.when(has(c), F.regexp_extract(c, "(?s)^(.*)=", 1)).otherwise(c)
        result = F.when(has(c), F.regexp_extract(c, "(?s)=([^=]*)$", 1)).otherwise(F.lit(""))
        return F.array(part("python", expr), part("python_output", result))

    head = F.array(part("text", F.get(texts, 0)))
    rest = F.zip_with(calls, F.slice(texts, F.lit(2), F.size(calls)), lambda c, t: F.concat(of_call(c), F.array(part("text", t))))
    return F.concat(head, F.flatten(rest)).cast(PARTS)


# Fixed value: the fenced block a program stands in.
FENCE = r"(?s)```(?:python)?\s*\n(.*?)\n```"


def extract_program(completion: Column) -> Column:
    """First fenced block, or the whole text, stripped."""
    return strip(F.when(completion.rlike(FENCE), F.regexp_extract(completion, FENCE, 1)).otherwise(completion))


def leading_imports(code: Column) -> Column:
    """Import lines before the first line that is neither import, comment nor blank."""
    lines = F.transform(F.split(code, "\n"), strip)
    is_import = lambda l: l.startswith("import ") | l.startswith("from ")
    stops = lambda l: (l != "") & ~l.startswith("#") & ~is_import(l)

    def head(ls):
        first_stop = F.array_position(F.transform(ls, stops), F.lit(True))
        kept = F.when(first_stop > 0, F.slice(ls, F.lit(1), (first_stop - 1).cast("int"))).otherwise(ls)
        return F.array_join(F.filter(kept, is_import), "\n")

    return let(lines, head)


def test_program(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """Source text of a check: imports, code, tests, call.  Nothing is run."""
    return F.concat(leading_imports(prompt), F.lit("\n\n"), extract_program(completion), F.lit("\n\n"), test,
                    F.lit("\ncheck("), entry_point, F.lit(")"))


# ---------------------------------------------------------------- JSON from models

def json_array_salvage(raw: Column) -> Column:
    """The JSON array a reply holds, as text; null when there is none."""
    whole = F.try_parse_json(raw)
    inner = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    inside = F.try_parse_json(F.nullif(inner, F.lit("")))
    as_array = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v))
    return F.when(whole.isNotNull(), as_array(whole)).otherwise(as_array(inside))


# Spellings of the arguments of file tools.
KEY_SYNONYMS = {
    "src": ["src", "src_path", "source_path", "source"],
    "dst": ["dst", "dst_path", "dest", "dest_path", "target", "destination_path", "destination"],
    "path": ["path", "filename", "file", "folder_name", "folder"],
}


def canonical_keys(args: Column) -> Column:
    """A ``MAP<STRING,STRING>`` with synonym keys renamed; of equal keys the last one wins."""
    def rename(key):
        out = None
        for name, spellings in KEY_SYNONYMS.items():
            out = F.when(key.isin(*spellings), name) if out is None else out.when(key.isin(*spellings), name)
        return out.otherwise(key)

    renamed = F.transform(F.map_entries(args), lambda e: F.struct(rename(e["key"]).alias("key"), e["value"].alias("value")))

    def last_wins(es):
        keys = F.transform(es, lambda e: e["key"])
        # Each distinct key with the value of its last entry.
        pick = lambda k: F.struct(k.alias("key"), F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"].alias("value"))
        return F.map_from_entries(F.transform(F.array_distinct(keys), pick))

    return F.coalesce(let(renamed, last_wins), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def puzzle_id(content: Column) -> Column:
    """First 8 hex digits over a map with sorted keys."""
    return F.substring(F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(content))))), 1, 8)


# ---------------------------------------------------------------- problem scoring

def calc_parse(text: Column) -> Column:
    """``STRUCT<prompt, expected>`` of ``Question? # Answer: "value"``; nulls when there are no quotes."""
    parts = F.split(text, '"', -1)
    ok = F.size(parts) >= 2
    return F.struct(F.when(ok, F.concat(F.substring_index(text, "?", 1), F.lit("?"))).alias("prompt"),
                    F.when(ok, F.try_element_at(parts, F.lit(-2))).alias("expected"))


def game_parse(text: Column) -> Column:
    """``STRUCT<prompt, expected>`` around the first tool call; nulls when there is none."""
    mark = "<|python_start|>"
    ok = F.contains(text, F.lit(mark))
    prompt = strip(F.substring_index(text, mark, 1))
    rest = strip(F.substring(text, F.length(prompt) + 1, F.length(text)))
    return F.struct(F.when(ok, prompt).alias("prompt"), F.when(ok, rest).alias("expected"))


# The marks a game answer is searched for.
TOOL_MARKS = ["<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>"]
BOARD_MARKS = [["board["], ["print(board)", "print_board"]]


def game_score(expected: Column, predicted: Column) -> Column:
    """``STRUCT<score, corr>``: tool marks 0.4, board commands 0.4, length ratio 0.2; correct above 0.7."""
    has = lambda *words: F.greatest(*[F.contains(predicted, F.lit(w)).cast("int") for w in words]) if len(words) > 1 \
        else F.contains(predicted, F.lit(words[0])).cast("int")
    share = lambda marks: sum((has(*m) for m in marks[1:]), has(*marks[0])) / F.lit(float(len(marks)))
    structure, logic = share([[m] for m in TOOL_MARKS]), share(BOARD_MARKS)
    a, b = F.length(predicted), F.length(expected)
    ratio = F.least(a, b) / F.greatest(a, b, F.lit(1))
    score = structure * 0.4 + logic * 0.4 + ratio * 0.2
    return F.struct(score.alias("score"), (score > 0.7).cast("int").alias("corr"))


def calc_record(json: Column, answer: Column) -> Column:
    return F.concat(json, F.lit(' # Answer: "'), answer.cast("string"), F.lit('"'))


# ---------------------------------------------------------------- reports

def slugify(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals with ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def format_metric(value: Column, kind: Column) -> Column:
    """``float``: four decimals; ``int``: separators from 10000 on; else the text itself."""
    number = value.cast("double")
    return (F.when(kind == "float", fixed(number, 4))
            .when((kind == "int") & (number >= 10000), F.format_number(number, 0))
            .when(kind == "int", number.cast("bigint").cast("string")).otherwise(value.cast("string")))


def metric_lines(section: Column, keys: list[str]) -> Column:
    """``ARRAY<STRUCT<metric, value>>``: every line that contains a key gives the text between its first two colons."""
    lines = F.split(section, "\n")

    def hits(key):
        mine = F.filter(lines, lambda l: F.contains(l, F.lit(key)) & F.contains(l, F.lit(":")))
        found = F.transform(mine, lambda l: F.struct(
            F.lit(key).alias("metric"), strip(F.get(F.split(l, ":"), 1)).alias("value")))
        # Of several lines with one key the last counts.
        return F.try_element_at(found, F.lit(-1))

    lasts = [hits(k) for k in keys]
    return F.filter(F.array(*lasts), lambda s: s.isNotNull())


def report_timestamp(section: Column, prefix: str) -> Column:
    """First readable time after a line prefix; null when there is none."""
    lines = F.filter(F.split(section, "\n"), lambda l: l.startswith(prefix) & F.contains(l, F.lit(":")))
    times = F.transform(lines, lambda l: F.try_to_timestamp(strip(F.regexp_replace(l, "^[^:]*:", "")), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.get(F.filter(times, lambda t: t.isNotNull()), 0)
