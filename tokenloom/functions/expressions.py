"""One random arithmetic expression per seed, for the problem generator."""

from __future__ import annotations

import math
import random

# Operators with their code and plain names, their shares, and sentence starts.
BINARY = {"+": "plus", "-": "minus", "*": "multiplied by", "/": "divided by"}
BINARY_SHARES = [0.4, 0.2, 0.3, 0.1]
UNARY = {"log": "natural logarithm of", "sin": "sine of", "cos": "cosine of", "tan": "tangent of",
         "exp": "exponential of", "factorial": "factorial of"}
STARTERS = ["Calculate", "What is", "Find the result of", "Evaluate"]
MAX_DEPTH, UNARY_SHARE, RECURSE_SHARE = 3, 0.3, 0.6


def _number(rng: random.Random):
    """Sign, 1-4 whole digits, and in 70 % of cases 1-4 decimals."""
    digits = rng.randint(1, 4)
    whole = rng.randrange(10 ** (digits - 1) if digits > 1 else 0, 10 ** digits)
    places = 0 if rng.random() < 0.3 else rng.randint(1, 4)
    tail = f"{rng.randrange(10 ** places):0{places}d}".rstrip("0") if places else ""
    shown = f"{whole}.{tail}" if tail else str(whole)
    if rng.random() < 0.5 and float(shown):
        shown = "-" + shown
    return float(shown), shown, shown


def _domain(name: str, x: float) -> float:
    if name == "log":
        return math.log(abs(x)) if abs(x) > 1e-9 else math.nan
    if name == "exp":
        return math.exp(x) if x < 700 else math.nan
    if name == "factorial":
        n = abs(x)
        return float(math.factorial(int(n))) if n <= 170 and n - int(n) <= 1e-9 else math.nan
    return getattr(math, name)(x)


def _binary(sign: str, x: float, y: float) -> float:
    if sign == "/":
        return x / (0.1 if abs(y) < 1e-10 else abs(y) + 0.1)
    return x + y if sign == "+" else x - y if sign == "-" else x * y


def tree(rng: random.Random, depth: int = 0):
    """(value, code text, natural text) of a random subtree."""
    if depth >= MAX_DEPTH or (depth > 0 and rng.random() > RECURSE_SHARE):
        return _number(rng)
    optional = lambda t: t if rng.random() < 0.5 else f"({t})"
    if rng.random() < UNARY_SHARE:
        name = rng.choice(list(UNARY))
        x, code, said = tree(rng, depth + 1)
        value = _domain(name, x) if math.isfinite(x) else math.nan
        inner = f"abs({code})" if name in ("log", "factorial") else code
        return value, f"{name}({inner})", f"{UNARY[name] if rng.random() < 0.5 else name} {optional(said)}"
    sign = rng.choices(list(BINARY), BINARY_SHARES)[0]
    x, left, said_left = tree(rng, depth + 1)
    y, right, said_right = tree(rng, depth + 1)
    value = _binary(sign, x, y) if math.isfinite(x) and math.isfinite(y) else math.nan
    if sign == "/":
        right = "0.1" if abs(y) < 1e-10 else f"(abs({right}) + 0.1)"
    return value, f"({left} {sign} {right})", f"{said_left} {BINARY[sign]} {optional(said_right)}"


def problem(seed, until_valid: bool = True) -> tuple[str, str, float]:
    """Question, code text and answer; drawn again until the answer is finite and below 1e100."""
    rng = random.Random(f"expression|{seed}")
    while True:
        value, code, said = tree(rng)
        if not until_valid or abs(value) < 1e100:
            return f"{rng.choice(STARTERS)} {said}?", code, value
