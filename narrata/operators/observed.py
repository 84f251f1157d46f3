"""Metrics that come with a run, not from a second pass over its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def written(df: DataFrame, path: str, metrics: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Writes the frame as Parquet and returns aggregates over the very rows written, from the same job."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in metrics.items())).write.mode(mode).parquet(path)
    return seen.get


class Progress(StreamingQueryListener):
    """Rows read and observed metrics of each micro-batch of the session's streams, while they run.

    batches has (run id, batch id, input rows, {name: {metric: value}}), in the order of their ends.
    """

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.runId), p.batchId, p.numInputRows, {name: row.asDict() for name, row in p.observedMetrics.items()}))

    def onQueryTerminated(self, event) -> None:
        pass
