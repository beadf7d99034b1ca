"""Tail probabilities. They run on result tables with one row per model pair."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.binomial import binomial_cdf


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= z) of a standard normal."""
    return z.map(lambda v: math.nan if pd.isna(v) else math.erfc(v / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def exact_mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial probability of a split at least as uneven as (b, c)."""
    low, n = np.minimum(b, c).to_numpy(float), (b + c).to_numpy(float)
    tail = binomial_cdf(low, np.maximum(n, 1.0), 0.5)
    return pd.Series(np.where(n > 0, np.minimum(1.0, 2 * tail), 1.0))
