"""Similarity of two texts as a ratio of matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over the characters of both; null counts as empty. Pairs must be blocked first."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def similarity_from(threshold: float):
    """``similarity`` where it reaches the threshold, else null; what lengths and letters rule out is not compared."""

    @F.pandas_udf(DoubleType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        def ratio(x: str, y: str) -> float | None:
            match = SequenceMatcher(None, x, y, autojunk=False)
            if match.real_quick_ratio() < threshold or match.quick_ratio() < threshold:
                return None
            found = match.ratio()
            return found if found >= threshold else None

        return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return near


def register_functions(spark) -> None:
    """Make the library's functions known to SQL: text_similarity, and the table functions of pages."""
    from . import dom

    spark.udf.register("text_similarity", similarity)
    dom.register_functions(spark)
