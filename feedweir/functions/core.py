"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apply(body: str, *values: Column | str) -> Column:
    """Evaluate a SQL lambda such as ``u -> upper(u)`` on a column.

    With several values the lambda receives one struct with the fields a, b, … . Large expressions are written as SQL
    text: they parse in one step, where building them call by call takes seconds of driver time.
    """
    cols = [col(v) for v in values]
    arg = cols[0] if len(cols) == 1 else F.struct(*[c.alias(chr(97 + i)) for i, c in enumerate(cols)])
    return F.element_at(F.call_function("transform", F.array(arg), F.expr(body)), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text: evaluate ``value`` once under ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def sha256_ci(value: Column | str) -> Column:
    """Identity hash: SHA-256 of the lower-cased value."""
    return F.sha2(F.lower(col(value)), 256)


def contains_any(value: Column, words: Sequence[str]) -> Column:
    """True when the value contains any of the given literal words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(value, F.lit(word))
    return hit


def starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(value, F.lit(prefix))
    return hit


def newest(value: Column, *order: Column) -> Column:
    """Aggregate: the value of the row with the largest order key (combined before the shuffle)."""
    return F.max_by(value, F.struct(*order) if len(order) > 1 else order[0])
