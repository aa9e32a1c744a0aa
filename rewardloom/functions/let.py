"""Binds a value inside one expression, so that it is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time per row.

    Catalyst inlines an expression at each use, which repeats regular-expression
    work; a lambda variable over a one-element array does not.
    """
    return F.get(F.transform(F.array(value), body), 0)
