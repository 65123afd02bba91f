"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` names it often or inside other lambdas."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
