"""Live income and expense over event time, and recurring generation by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.functions.amounts import sums
from ledgerspark.operators.recurring import generate


def windowed_totals(tx: DataFrame, window: str = "15 minutes", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Income, expense and total by event-time window; rows later than `late` are dropped by the watermark."""
    timed = tx.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), *by).agg(*sums()).select(*by, F.col("window.start").alias("start"), "income", "expense", "total")


def generate_on_arrival(templates: DataFrame, as_of: Callable[[], str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of template states yields its due instances. The sink gets the batch number to write once."""
    return templates.writeStream.foreachBatch(lambda batch, n: sink(generate(batch, as_of()), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
