"""Pseudo-random numbers from keys, the same in every run and in any SQL engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # of hexadecimal: 52 bits, which a double holds exactly


def digest(*keys: Column | str) -> Column:
    """md5 of the keys as text, in order, with bars between."""
    return F.md5(F.concat_ws("|", *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)).cast("binary"))


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(digest(*keys), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))
