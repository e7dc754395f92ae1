"""Event streams as per-window edge tables, filtered against a fitted model (an addition to the batch verbs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filter as FO
from ..schema import Fit


def windowed_edges(events: DataFrame, time: str, source: str, target: str, window: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, source, target, weight): events of each pair by time window; events later than `lateness` are dropped."""
    own = events.withWatermark(time, lateness) if events.isStreaming else events
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = own.groupBy(span.alias("w"), F.col(source).cast("bigint").alias("source"), F.col(target).cast("bigint").alias("target")).agg(F.count("*").alias("weight"))
    return counted.select(F.col("w.start").alias("start"), "source", "target", "weight")


def filter_stream(edges: DataFrame, fit: Fit, path: str, checkpoint: str, alpha: float = 0.05, tail: str = "upper", then: Callable | None = None):
    """A started query that scores each batch of closed windows against `fit` and appends the significant edges to `path`."""

    def each(batch: DataFrame, number: int):
        scored = FO.classify(FO.observed(batch, fit, ("start",)), alpha, tail)
        found = scored.where("is_upper or is_lower").withColumn("batch", F.lit(number))
        (then or (lambda df: df.write.mode("append").parquet(path)))(found)

    return edges.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
