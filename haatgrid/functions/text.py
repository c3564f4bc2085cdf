"""Similarity of short texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x and y) and SequenceMatcher(None, x.lower(), y.lower()).ratio() >= 0.8 for x, y in zip(a, b)], dtype=bool)


def ratio_at_least(a: str, b: str):
    """Whether the matching-blocks ratio of two texts is at least 0.8; meant for few candidates. Null and empty texts are like none."""
    return _alike(F.col(a), F.col(b))
