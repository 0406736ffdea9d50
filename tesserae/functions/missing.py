"""What counts as a usable number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` as double, null where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN sorts above infinity in Spark, so it fails here as well


def stand_in_form(x: Column) -> Column:
    """Whether ``x`` has the form feeds use for "no value": 0, -1, or nines (three or more) of either sign."""
    digits = F.abs(x).cast("decimal(30,4)").cast("string")
    return F.coalesce((x == 0) | (x == -1) | digits.rlike(r"^9{3,}\.(0+|9+)$") | digits.rlike(r"^8{3,}\.0+$"), F.lit(False))
