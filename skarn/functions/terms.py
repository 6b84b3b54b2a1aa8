"""Terms of a text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the token pattern.
TOKEN = r"[a-z0-9]+(?:['-][a-z0-9]+)*"


def tokens(text: Column) -> Column:
    """All tokens in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Tokens with at least one letter a-z, in order."""
    return F.filter(tokens(text), lambda t: t.rlike("[a-z]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside lambda functions an expression is computed again wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(ordered: Column, of: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(ordered, start, end)`` of each run of elements with equal ``of`` in an ordered array, in linear time."""

    def body(a: Column) -> Column:
        at = lambda i: of(F.get(a, i))
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
        return let(starts, lambda s: F.transform(s, lambda x, i: make(a, x, F.coalesce(F.get(s, i + 1), F.size(a)))))

    return let(ordered, lambda a: F.when(F.size(a) > 0, body(a)))


def term_counts(sorted_terms: Column) -> Column:
    """A sorted array as ``array<struct<term, n>>``: one entry per distinct element."""
    counted = runs(sorted_terms, lambda x: x, lambda a, x, end: F.struct(F.get(a, x).alias("term"), (end - x).alias("n")))
    return F.coalesce(counted, F.array().cast("array<struct<term:string,n:int>>"))
