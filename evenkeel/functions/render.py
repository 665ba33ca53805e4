"""Printable forms of result columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def format_mean_ci(mean: Column, low: Column, high: Column) -> Column:
    """``"m [lo, hi]"`` with three decimals and missing as ``nan``.

    An Arrow function on a one-row-per-model table: ``format_string`` rounds half-way values differently.
    """

    def batch(m: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        cells = zip(m.astype("float64"), lo.astype("float64"), hi.astype("float64"))
        return pd.Series([f"{a:.3f} [{b:.3f}, {c:.3f}]" for a, b, c in cells], dtype=object)

    batch.__annotations__ = {"m": pd.Series, "lo": pd.Series, "hi": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(mean, low, high)
