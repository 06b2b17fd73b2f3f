"""Live totals of a stream: what every micro-batch counted, seen while it runs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapeline.operators.stats import value_projection

TOTALS = "totals"


def watch_totals(records: DataFrame, *, order: Sequence[str] = ("local_ts",)) -> DataFrame:
    """``records`` as they are; on their way each micro-batch counts its rows, its symbols'
    rows with a value, and the value and time of its last row."""
    value = value_projection(records.columns)
    place = F.struct(*order)
    return records.observe(
        TOTALS,
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("valued"),
        F.max_by(value, F.when(value.isNotNull(), place)).alias("last_value"),
        F.max("local_ts").alias("last_ts"),
    )


class LiveTotals(StreamingQueryListener):
    """Adds up the micro-batches of streams under ``watch_totals``.

    Register it with ``spark.streams.addListener`` before the streams start. ``batches`` has
    one dict per micro-batch with rows, ``rows`` and ``last_value`` are the totals so far;
    ``tell`` is called with each dict as it comes.
    """

    def __init__(self, tell: Callable[[dict], None] | None = None):
        self.batches: list[dict] = []
        self.rows = 0
        self.last_value: float | None = None
        self.last_ts: int | None = None
        self.ended = threading.Event()
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(TOTALS)
        if seen is None or not seen["rows"]:
            return
        batch = {"batch": event.progress.batchId, **seen.asDict()}
        self.batches.append(batch)
        self.rows += batch["rows"]
        if batch["last_value"] is not None and (self.last_ts is None or batch["last_ts"] >= self.last_ts):
            self.last_value, self.last_ts = batch["last_value"], batch["last_ts"]
        if self.tell:
            self.tell(batch)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
