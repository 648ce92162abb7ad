"""Conditions with document-store semantics: missing values differ from every value, and a condition on a list asks for any of its elements."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(c: str, value) -> Column:
    """A null value asks for missing ones."""
    return F.col(c).isNull() if value is None else F.coalesce(F.col(c) == value, F.lit(False))


def ne(c: str, value) -> Column:
    """Missing ones differ from a value."""
    return F.col(c).isNotNull() if value is None else ~F.col(c).eqNullSafe(F.lit(value))


def _compare(op: str):
    def condition(c: str, value) -> Column:
        return F.coalesce(getattr(F.col(c), op)(value), F.lit(False))

    condition.__doc__ = "Missing values never match."
    return condition


lt, lte, gt, gte = map(_compare, ("__lt__", "__le__", "__gt__", "__ge__"))


def in_(c: str, values: Iterable) -> Column:
    """A null among the values asks for missing ones too."""
    values = list(values)
    known = [v for v in values if v is not None]
    found = F.coalesce(F.col(c).isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col(c).isNull() if None in values else found


def nin(c: str, values: Iterable) -> Column:
    return ~in_(c, values)


def contains(c: str, value) -> Column:
    """A list has the value."""
    return F.coalesce(F.array_contains(c, value), F.lit(False))


def any_in(c: str, values: Iterable, field: str | None = None) -> Column:
    """Any element of a list (or a field of any) is among the values."""
    values = list(values)
    return F.coalesce(F.exists(c, lambda x: (x[field] if field else x).isin(values)), F.lit(False))


def none_in(c: str, values: Iterable, field: str | None = None) -> Column:
    return ~any_in(c, values, field)


def empty(c: str) -> Column:
    """The list is there and has nothing in it."""
    return F.coalesce(F.size(F.col(c)) == 0, F.lit(False)) & F.col(c).isNotNull()


def present(c: str, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else F.col(c).isNotNull() if wanted else F.col(c).isNull()


def search(term: str, columns: Iterable[str]) -> Column:
    """A literal substring in any of the columns, whatever the case; an empty term matches all."""
    if not term:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False)) for c in columns))


_OPS = {"eq": eq, "ne": ne, "lt": lt, "lte": lte, "gt": gt, "gte": gte, "in": in_, "nin": nin, "contains": contains}


def all_of(conditions: Iterable[tuple[str, str, object]]) -> Column:
    """Conditions (operator, column, value) that hold together; an operator that isn't known is an error."""
    out = F.lit(True)
    for op, c, value in conditions:
        if op not in _OPS:
            raise ValueError(f"unknown operator: {op}")
        out = out & _OPS[op](c, value)
    return out
