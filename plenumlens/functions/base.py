"""Helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters treated as whitespace: Unicode White_Space and the four ASCII separators.
#: (Measured: leaving single plain spaces unmatched, to save replacements, is slower.)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

#: The same characters one by one, for trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name so that ``body`` may use it often but computes it once."""
    return F.transform(F.array(value), body).getItem(0)


def collapse_spaces(text: Column) -> Column:
    """Every whitespace run becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def strip(text: Column) -> Column:
    """No whitespace at the ends."""
    return F.btrim(text, F.lit(SPACES))


def compute_once(df: DataFrame, keys: Sequence[str], name: str, value: Column) -> DataFrame:
    """``keys`` and ``value`` as a column that later steps may filter on or explode freely.

    The optimizer moves filters (also the one it infers from an explode) below a plain
    projection by repeating the projected expression. A one-element explode stops that,
    so a costly expression is evaluated once per row.
    """
    return df.select(*keys, F.explode(F.array(value)).alias(name))
