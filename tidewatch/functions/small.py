"""Tables whose size is bounded by their design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame) -> DataFrame:
    """Broadcasts a table that parameters bound, whatever the data's size.

    For methods x budgets, scenarios x statistics, registries, period tables and calendars.
    Nothing is evaluated here; tables keyed by data are joined without a hint.
    """
    return F.broadcast(df)
