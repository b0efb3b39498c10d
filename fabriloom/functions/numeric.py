"""Rounding that comes out alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding of a double through a decimal, so that the binary noise of sums doesn't decide ties."""
    return F.round(x.cast("decimal(38,12)"), places).cast("double")
