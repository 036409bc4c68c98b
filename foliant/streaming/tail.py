"""Newline-delimited JSON that keeps arriving in a folder, into a table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table


def tail(table: Table, path: str, checkpoint: str, column: str | None = None, once: bool = False, **trigger) -> StreamingQuery:
    """Each micro-batch is one insert; lines that are blank are left out. once: what is there now, then stop."""
    from ..plans.ddl import copy_column

    name = copy_column(table, [column] if column else [])
    lines = table.spark.readStream.text(path).where("trim(value) <> ''").select(F.col("value").alias(name))
    how = {"availableNow": True} if once else trigger
    out = lines.writeStream.foreachBatch(lambda rows, _: table.insert(rows) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(**how) if how else out).start()
