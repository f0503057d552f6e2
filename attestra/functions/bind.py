"""Naming a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often ``use`` names it.

    Spark shares equal parts of an expression only outside of lambdas; a part named twice at each of a few
    levels is worked out 2, 4, 8 ... times.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
