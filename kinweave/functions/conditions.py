"""The condition language of control tables, compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IN = re.compile(r"^\s*(\w+)\s+IN\s*\((.*)\)\s*$", re.I | re.S)
_LENGTH = re.compile(r"^\s*LEN\(\s*(\w+)\s*\)\s*=+\s*(\d+)\s*$", re.I)
_EQUAL = re.compile(r"^\s*(\w+)\s*=\s*(.*?)\s*$", re.S)


def _plain(text: str) -> str:
    return text.strip().strip("'\"")


def compile_condition(text: str, columns: list[str] | None = None) -> Column:
    """``col='v'``, ``col IN ('a','b')`` or ``LEN(col)==8`` as a predicate.

    Values are compared as text.  A column that the table doesn't have makes
    the predicate false.  Other text raises ValueError.
    """
    known = lambda c: columns is None or c in columns
    if found := _IN.match(text):
        values = [_plain(v) for v in found[2].split(",")]
        return F.coalesce(F.col(found[1]).cast("string").isin(values), F.lit(False)) if known(found[1]) else F.lit(False)
    if found := _LENGTH.match(text):
        return F.coalesce(F.length(F.col(found[1]).cast("string")) == int(found[2]), F.lit(False)) if known(found[1]) else F.lit(False)
    if found := _EQUAL.match(text):
        return F.coalesce(F.col(found[1]).cast("string") == _plain(found[2]), F.lit(False)) if known(found[1]) else F.lit(False)
    raise ValueError(f"condition not understood: {text!r}")


def first_match(rules: list[tuple[str, str]], columns: list[str] | None = None, otherwise: Column | None = None) -> Column:
    """The party type of the first rule (condition, party type) that holds.

    A row that no rule fits raises at run time, or gets ``otherwise``.
    """
    chosen: Column | None = None
    for condition, party_type in rules:
        predicate = compile_condition(condition, columns)
        chosen = F.when(predicate, F.lit(party_type)) if chosen is None else chosen.when(predicate, F.lit(party_type))
    fallback = otherwise if otherwise is not None else F.raise_error(F.lit("no party type condition matches a row")).cast("string")
    return fallback if chosen is None else chosen.otherwise(fallback)


def any_present(columns: list[str]) -> Column:
    """Whether any of the columns holds a value."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull() if columns else F.lit(False)


def present(value: Column) -> Column:
    """A value that counts as given: neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))
