"""Sums of doubles that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_sum(value: Column | str) -> Column:
    """Sum of scores, shares or confidences, the same in whatever order a shuffle brings the rows.

    Values are added as decimals of 15 places and the sum is rounded to 12, so thirds add up to whole numbers and means
    that lie on a threshold or between two roundings stay there. Where one of them is no number, infinite, of 1e13 and more
    or so small that 15 places would lose it, all are added as doubles. Nulls count as none; without any value the sum is null.
    """
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(column)  # greater than all for what is no number
    apart = (size >= 1e13) | ((size < 1e-9) & (size > 0))
    exact = F.round(F.sum(F.when(~apart, column).cast("decimal(38,15)")), 12).cast("double")
    return F.when(F.count_if(apart) > 0, F.sum(column)).otherwise(exact)
