"""Pseudo-random draws that depend only on their arguments.

A draw is a hash of a seed and a row id, so a re-run, a retry on another executor or
another partition count gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def digest(*parts) -> Column:
    """Hex md5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[_part(p).cast("string") for p in parts]))


def draw_bits(*parts) -> Column:
    """Uniform integer in [0, 2^60)."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def draw_index(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    size = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(draw_bits(*parts), size.cast("bigint"))


def draw_unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return F.shiftright(draw_bits(*parts), 8) / F.lit(float(1 << 52))


def pick(options: list[str], *parts) -> Column:
    """One of a fixed list of strings."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (draw_index(len(options), *parts) + 1).cast("int"))
