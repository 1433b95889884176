"""Array functions that the built-in ones would do in quadratic time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cumulative(sizes: Column) -> Column:
    """0 and the running sums of an array of numbers; only the numbers go through Arrow. Null counts as empty."""

    @F.pandas_udf("array<long>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda a: np.concatenate([[0], np.cumsum(a)]).astype(np.int64) if a is not None and len(a) else np.zeros(1, np.int64))

    return run(sizes)


def first_within(ends: Column, reach: Column) -> Column:
    """For each position of running sums (from 0), the last index whose sum is at least ``reach`` below, or 0."""

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series, by: pd.Series) -> pd.Series:
        def one(a, n):
            a = np.asarray(a)
            return np.maximum(np.searchsorted(a, a - n, "right") - 1, 0).astype(np.int32)

        return pd.Series([one(a, n) for a, n in zip(batch, by)], dtype=object)

    return run(ends, reach)
