"""Rounding that two engines agree on bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(col: Column, places: int = 6) -> Column:
    """Half-up to ``places`` using only multiply, add, floor and divide.

    ``round`` goes through decimal text in the JVM and through binary scaling
    elsewhere; this form is the same sequence of IEEE operations everywhere.
    NULL, NaN and infinities pass through unchanged.
    """
    scale = float(10**places)
    finite = F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    odd = col.isNull() | F.isnan(col) | (F.abs(col) > F.lit(1e300))
    return F.when(odd, col).otherwise(finite)


def half_even(col: Column, places: int = 0) -> Column:
    """Ties to the even neighbour after scaling, as numpy rounds."""
    scale = float(10**places)
    return F.rint(col * F.lit(scale)) / F.lit(scale)
