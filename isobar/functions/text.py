"""Numbers as text and exact decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of the stored binary value, halves to even, without separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def exact_round(x: Column, digits: int) -> Column:
    """Rounding of the stored binary value, halves to even: 2.675 gives 2.67.

    Spark's own ``round`` works on the shortest decimal text of the number and gives 2.68.
    """
    return fixed(x, digits).cast("double") + F.lit(0.0)
