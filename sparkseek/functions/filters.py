"""Attribute predicates that are never null, over a map column that may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(attributes: str | Column, name: str) -> Column:
    return (F.col(attributes) if isinstance(attributes, str) else attributes)[name]


def attr_eq(name: str, value: str, attributes: str | Column = "attributes") -> Column:
    return _value(attributes, name).eqNullSafe(F.lit(value))


def attr_ne(name: str, value: str, attributes: str | Column = "attributes") -> Column:
    """True as well for rows without the attribute."""
    return ~attr_eq(name, value, attributes)


def attr_in(name: str, values: list[str], attributes: str | Column = "attributes") -> Column:
    return F.coalesce(_value(attributes, name).isin(*values), F.lit(False))
