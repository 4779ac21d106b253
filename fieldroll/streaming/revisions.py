"""Late revisions and submissions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable


def latest_revisions(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The largest record of each key so far: state of one row per key, updated as late revisions come."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.`{c}`").alias(c) for c in rest))


def weekly_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Rows and keys of each Monday-based week, in event time."""
    weeks = F.window(ts, "7 days", startTime="4 days")
    return stream.withWatermark(ts, late).groupBy(weeks, *keys).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("week"), *keys, "n")


def upsert_stream(stream: DataFrame, table: KeyedTable, order: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch merged into the table, once: a batch that is run again after a failure finds its number there."""
    name = checkpoint.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, batch=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
