"""Expressions that bring dirty catalogue columns to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column | str) -> Column:
    """A SHA-256 in any spelling as 64 lower-case hexadecimal digits, NULL when it is not one.

    Case, surrounding or inner white space and a leading ``sha256:``/``sha-256=``/``0x`` do not matter.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"^(sha-?256[:=]|0x)", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def epoch_micros(c: Column | str) -> Column:
    """A count since 1970 in seconds, milliseconds or microseconds as whole microseconds.

    The unit follows from the magnitude: seconds stay under 1e11 (the year 5138), milliseconds under 1e14.
    NULL, NaN, infinite, zero and negative values are unusable and give NULL.
    """
    c = F.col(c) if isinstance(c, str) else c
    us = F.when(c < 1e11, F.rint(c * 1e6)).when(c < 1e14, F.rint(c * 1e3)).when(c < 1e17, F.rint(c))
    return F.when(c.isNotNull() & ~F.isnan(c) & (c > 0), us.cast("long"))


def label(c: Column | str) -> Column:
    """An enumeration value without stray case, blanks, hyphens: ``' Low-Quality'`` gives ``LOW_QUALITY``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(F.trim(c), r"[\s_-]+", "_"))


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")
