"""Ledgers as streams: each micro-batch is folded to the latest entry of its keys, and the batches to the latest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest


def keep_latest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], value: str) -> StreamingQuery:
    """Writes the latest value of each key of a batch, and how many entries it had, under the batch's number: a batch that is
    replayed replaces itself, so nothing counts twice and equal entries of one batch still count each."""

    def fold(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(value, *order), F.struct(*order)).alias("last"), F.count("*").alias("entries"))
        last.select(*keys, "last.*", "entries").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The latest value of each key over all batches, and its entries."""
    counts = rows.groupBy(*keys).agg(F.sum("entries").alias("entries"))
    return latest(rows, keys, order, value).drop("entries").join(counts, keys)
