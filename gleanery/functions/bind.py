"""Naming a sub-expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body reads it.

    Spark shares a repeated sub-expression only where it is always evaluated; inside the
    branches of a CASE it would run again for every branch.
    """
    # element_at settles once how to read the array; get would work out the type and nullability of all of body for every row.
    return F.element_at(F.transform(F.array(value), body), 1)
