"""How often each value of a path occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, text: str, name: str = "value", ordered: bool = True) -> DataFrame:
    """(name, count): JSON text of each value, NULL for rows without one. ordered: count descending, then value with
    NULL first. One partial aggregation before the shuffle; the sort is of the groups only."""
    out = rows.groupBy(F.expr(text).alias(name)).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), F.asc_nulls_first(name)) if ordered else out
