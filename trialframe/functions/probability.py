"""Column forms of the tail areas: Arrow-batched Pandas UDFs over result tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from trialframe.functions import tails


def _column_function(compute: Callable, arity: int) -> Callable[..., Column]:
    """Wrap a numpy tail function; a NULL in any argument gives NULL."""

    def run(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        known = ~np.any([np.isnan(v) for v in values], axis=0)
        out = np.full(len(columns[0]), np.nan)
        if known.any():
            out[known] = compute(*(v[known] for v in values))
        return pd.Series(out).where(~np.isnan(out), None)

    if arity == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        udf = F.pandas_udf(two, DoubleType())
    else:

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)

        udf = F.pandas_udf(three, DoubleType())

    def column(*args) -> Column:
        return udf(*(_as_double(a) for a in args))

    return column


def _as_double(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    column = column if isinstance(column, Column) else F.lit(column)
    return column.cast("double")


t_two_sided = _column_function(tails.t_two_sided, 2)
f_upper = _column_function(tails.f_upper, 3)
chi2_upper = _column_function(tails.chi2_upper, 2)
range_upper = _column_function(tails.range_upper, 3)
t_quantile = _column_function(tails.t_quantile, 2)
