"""Column helpers for operators that stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of texts as the contracts define them: runs without blank and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined into other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def removed(text: Column, pattern: str) -> Column:
    """How many characters of a text the pattern's matches hold."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
