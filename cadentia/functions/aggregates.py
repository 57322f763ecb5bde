"""Aggregates that Spark has no function for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))  # a type, as its text would need a session
def mean_spectrum(spectra: pd.Series) -> np.ndarray:
    """The mean of arrays of one length, place by place; null without an array. A group is one batch of Arrow data."""
    held = spectra.dropna()
    return np.mean(np.stack(held.to_numpy()), axis=0) if len(held) else None
