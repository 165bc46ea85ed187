"""Random tic-tac-toe dialogues as columns: draws by hash, rules and texts by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.draws import digest, draw_index
from tokenloom.functions.tokens import let

# Cell names row by row, and the eight winning lines.
CELLS = ["top-left", "top-center", "top-right", "mid-left", "center", "mid-right", "bot-left", "bot-center", "bot-right"]
LINES = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6)]
LEAST, MOST = 3, 7   # moves of a game


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drawn_moves(seed: Column) -> Column:
    """3-7 different cells in a drawn order, not yet stopped at a win."""
    keyed = F.array_sort(F.transform(_ints(range(9)), lambda c: F.struct(digest("cell", seed, c).alias("k"), c.alias("c"))))
    n = (draw_index(MOST - LEAST + 1, "moves", seed) + LEAST).cast("int")
    return F.transform(F.slice(keyed, F.lit(1), n), lambda x: x["c"])


def first_win(drawn: Column) -> Column:
    """Number of the move that completes a line, null if none does."""
    lines = F.array(*[_ints(line) for line in LINES])

    def won(k):
        # Moves of the player who made move k: every other one up to it.
        own = F.filter(F.slice(drawn, F.lit(1), k), lambda _, i: F.pmod(k - i, F.lit(2)) == 1)
        return let(own, lambda cells: F.exists(lines, lambda line: F.size(F.array_intersect(line, cells)) == 3))

    return F.array_min(F.filter(F.sequence(F.lit(1), F.size(drawn)), won))


def player(k: Column) -> Column:
    """Who makes move k, from 1 on; X begins."""
    return F.when(F.pmod(k, F.lit(2)) == 1, "X").otherwise("O")


def outcome(win: Column) -> Column:
    return F.when(win.isNull(), "").otherwise(F.concat(player(win), F.lit(" wins")))


def messages_of(moves: Column, win: Column) -> Column:
    """One text per move: the user, who is X, names a cell; the reply shows code, board and, when there is one, the result."""
    def reply(k):
        played = F.slice(moves, F.lit(1), k)
        code = F.transform(played, lambda c, t: F.format_string("board[%d][%d]='%s'", F.floor(c / 3), c % 3, player(t + 1)))
        marks = F.transform(_ints(range(9)), lambda c: F.when(F.array_position(played, c) == 0, " ").otherwise(player(F.array_position(played, c))))
        shown = let(marks, lambda cells: F.array(*[F.array_join(F.slice(cells, r, 3), "|") for r in (1, 4, 7)]))
        some = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
        won = F.coalesce(win == k, F.lit(False))
        return F.array_join(F.concat(
            F.array(F.lit("<|python_start|>")), code, F.array(F.lit("print(board)")), some(won | (k == F.size(moves)), F.lit("check_winner(board)")),
            F.array(F.lit("<|python_end|>"), F.lit("<|output_start|>")), shown, some(won, outcome(win)), F.array(F.lit("<|output_end|>"))), "\n")

    def said(c, i):
        name = F.element_at(F.array(*[F.lit(n) for n in CELLS]), c + 1)
        return (F.when(F.pmod(i, F.lit(2)) == 1, reply(i + 1)).when(i == 0, F.concat(F.lit("Tic-tac-toe. I'm X at "), name, F.lit(".")))
                .otherwise(F.concat(F.lit("I play "), name, F.lit("."))))

    return F.transform(moves, said)


def game(seed: Column) -> Column:
    """``STRUCT<moves, said, outcome>`` of a seed; every part is bound once, however often it is mentioned."""
    whole = lambda moves, win: F.struct(moves.alias("moves"), messages_of(moves, win).alias("said"), outcome(win).alias("outcome"))
    return let(drawn_moves(seed), lambda drawn: let(first_win(drawn), lambda win: let(
        F.slice(drawn, F.lit(1), F.coalesce(win, F.size(drawn))), lambda moves: whole(moves, win))))
