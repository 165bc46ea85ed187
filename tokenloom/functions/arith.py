"""Arithmetic in text: a small evaluator over syntax trees (never ``eval``) and its Arrow functions."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
           ast.FloorDiv: operator.floordiv}
# Names an expression may use.
FUNCTIONS = {"abs": abs, "log": math.log, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "sqrt": math.sqrt}
NAMES = {"pi": math.pi, "e": math.e}


def _value(node, named: bool):
    if isinstance(node, ast.Expression):
        return _value(node.body, named)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        inner = _value(node.operand, named)
        return -inner if isinstance(node.op, ast.USub) else +inner
    if isinstance(node, ast.BinOp):
        left, right = _value(node.left, named), _value(node.right, named)
        if named and isinstance(node.op, ast.Pow):
            return float(left) ** float(right)
        return _BINARY[type(node.op)](left, right)
    if isinstance(node, ast.Name) and named:
        return NAMES[node.id]
    if isinstance(node, ast.Call) and not node.keywords:
        args = [_value(a, named) for a in node.args]
        if isinstance(node.func, ast.Name) and named:
            return FUNCTIONS[node.func.id](*args)
        if isinstance(node.func, ast.Attribute) and node.func.attr == "count" and not named:
            return _value(node.func.value, named).count(*args)
    raise ValueError("not arithmetic")


def evaluate(expr: str, named: bool):
    """Number, or None when the text is not an expression of the allowed kind."""
    try:
        return _value(ast.parse(expr.strip(), mode="eval"), named)
    except (SyntaxError, ValueError, KeyError, TypeError, ZeroDivisionError, OverflowError, AttributeError, RecursionError, MemoryError):
        return None


@F.pandas_udf(StringType())
def _calculate(exprs: pd.Series) -> pd.Series:
    def one(e):
        v = evaluate(e, named=False)
        return None if v is None else str(v)

    return exprs.map(one, na_action="ignore")


@F.pandas_udf(DoubleType())
def _evaluate_math(exprs: pd.Series) -> pd.Series:
    def one(e):
        v = evaluate(e, named=True)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else math.nan

    return exprs.map(one, na_action="ignore").astype("float64")


# What a calculator call may not mention.
DENIED = ["__", "import", "exec", "eval", "compile", "open", "file", "input", "raw_input", "globals", "locals",
          "vars", "dir", "getattr", "setattr", "delattr", "hasattr"]
_COUNT = r"""^ *(['"])([^'"]*)\1\.count\( *(['"])([^'"]+)\3 *\) *$"""


def calculator_kind(expr: Column) -> Column:
    """``arithmetic``, ``count`` or null for a call the calculator refuses; commas do not count."""
    bare = F.replace(expr, F.lit(","), F.lit(""))
    denied = F.lit(False)
    for word in DENIED:
        denied = denied | F.contains(F.lower(bare), F.lit(word))
    return (F.when(bare.rlike(r"^[0-9*+\-/.() ]*\z"), F.when(~F.contains(bare, F.lit("**")), "arithmetic"))
            .when(bare.rlike(r"""^[a-zA-Z0-9'"()._ ]*\z""") & ~denied & F.contains(bare, F.lit(".count(")), "count"))


def calculator_result(expr: Column) -> Column:
    """Result text of a calculator call; null when refused or not computable.

    Plain ``'word'.count('l')`` calls are counted in the JVM, only the rest goes to Arrow.
    """
    bare = F.replace(expr, F.lit(","), F.lit(""))
    kind = calculator_kind(expr)
    plain = bare.rlike(_COUNT)
    word, part = F.regexp_extract(bare, _COUNT, 2), F.regexp_extract(bare, _COUNT, 4)
    counted = (F.length(word) - F.length(F.replace(word, part, F.lit("")))) / F.length(part)
    is_plain = (kind == "count") & plain
    rest = _calculate(F.when(kind.isNotNull() & ~F.coalesce(is_plain, F.lit(False)), bare))
    return F.when(is_plain, counted.cast("bigint").cast("string")).otherwise(rest)


def evaluate_math(expr: Column) -> Column:
    """Double value of an expression with the named functions; NaN when it has none."""
    # Arrow hands NaN back as null.
    return F.when(expr.isNotNull(), F.coalesce(_evaluate_math(expr), F.lit(float("nan"))))
