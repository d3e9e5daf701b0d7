"""Python's rounding and percent text, where parity needs it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(value: Column) -> Column:
    """Whole percents, halves to the even one: a tie at no digits is exact in binary, so the built-in rounding agrees with Python's."""
    return F.concat(F.bround(value * 100, 0).cast("long").cast("string"), F.lit("%"))


def py_round(value: Column, digits: int) -> Column:
    """Half to even on the exact binary value, which no built-in function does (2.675 gives 2.67): an Arrow batch at a time."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else round(v, digits) for v in x.tolist()], dtype="float64")

    return apply(value)
