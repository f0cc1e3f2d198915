"""Group metrics kept up to date over a stream: counts add up, so a stream needs no more state than the counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairspark.operators.contingency import COUNTS, contingency, with_rest
from fairspark.operators.fairness import METRICS


def live_counts(stream: DataFrame, group: str, truth: str = "y", prediction: str = "p") -> DataFrame:
    """Counts by group over all of a stream (output modes update and complete)."""
    return contingency(stream, group, truth=truth, prediction=prediction)


def windowed_counts(stream: DataFrame, time: str, group: str, duration: str, late: str, slide: str | None = None, truth: str = "y", prediction: str = "p") -> DataFrame:
    """Counts by time window and group; rows later than the watermark are left out (output mode append too)."""
    rows = stream.withWatermark(time, late).withColumn("window", F.window(time, duration, slide) if slide else F.window(time, duration))
    return contingency(rows, "window", group, truth=truth, prediction=prediction)


def metrics_of(counts: DataFrame, group: str, within: Sequence[str] = ()) -> DataFrame:
    """Fairness of counts that a batch or a stream has made."""
    return with_rest(counts.select(*within, group, *COUNTS), *within).select(*within, F.col(group).alias("value"), *(f().alias(f"fairness_{m}") for m, f in METRICS.items()))


def run(stream: DataFrame, group: str, sink: Callable[[DataFrame, int], None], checkpoint: str, truth: str = "y", prediction: str = "p") -> StreamingQuery:
    """Starts a query that hands the metrics of all rows so far to the sink after each batch."""

    def each(counts: DataFrame, batch: int) -> None:
        sink(metrics_of(counts, group), batch)

    return live_counts(stream, group, truth, prediction).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()
