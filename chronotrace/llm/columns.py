"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_array(c: str | Column) -> Column:
    """Runs of characters other than ``\\x20`` and ``\\x09`` to ``\\x0D``."""
    return F.filter(F.split(text_or_empty(c), BLANKS), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    """Number of words without building them: word starts are where a blank meets a non-blank."""
    t = text_or_empty(c)
    parts = F.size(F.split(t, BLANKS))
    lead = F.when(F.substring(t, 1, 1).isin(*_SPACES), 1).otherwise(0)
    trail = F.when(F.substring(t, -1, 1).isin(*_SPACES), 1).otherwise(0)
    return F.when(F.length(F.translate(t, _SPACES, "")) == 0, F.lit(0)).otherwise(parts - lead - trail).cast("long")


def without(c: str | Column, characters: str) -> Column:
    """Text without the given characters."""
    return F.translate(text_or_empty(c), characters, "")


def ink(c: str | Column) -> Column:
    """Text without white space of the word pattern."""
    return without(c, _SPACES)


def let(value: Column, use) -> Column:
    """Bind an expression once and use it several times inside another."""
    return F.element_at(F.transform(F.array(value), use), 1)


def names_unlike(taken: list[str], *wanted: str) -> list[str]:
    """Working column names that clash with no column of the input."""
    out = []
    for w in wanted:
        while w in taken or w in out:
            w = f"_{w}"
        out.append(w)
    return out
