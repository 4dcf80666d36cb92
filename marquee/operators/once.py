"""Work that is heavy for each text, done once for each that differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from ..sources.versions import kept


def once_per_text(rows: DataFrame, use: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with ``use`` of their ``text`` as a column: computed for each distinct text, which rows then join. Null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    own = spread(rows.select(text.alias("own")).distinct(), "own")
    told = kept(own.select("own", use(F.col("own")).alias(name)), f"{name}-texts")
    return rows.join(told, text == F.col("own"), "left").drop("own")
