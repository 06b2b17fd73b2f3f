"""Order of a live stream: rows that come after a later one of their key go aside."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeline.streaming.books import _ordered, _use_rocksdb

ARRIVED, LATE = "arrived", "late"


class OrderCheck(StatefulProcessor):
    """Per key the latest time so far; rows before it come out with it."""

    def __init__(self, keys: Sequence[str], refuse: bool):
        self.keys, self.refuse = list(keys), refuse

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        ts = batch["ts"].to_numpy(dtype=np.int64)
        start = self.state.get()[0] if self.state.exists() else ts[0]
        seen = np.maximum.accumulate(np.concatenate([[start], ts]))
        self.state.update((int(seen[-1]),))
        late = ts < seen[:-1]
        if self.refuse and late.any():
            first = int(np.argmax(late))
            raise ValueError(f"{key}: row {batch['ord'].iloc[first]} at {ts[first]} comes after {seen[first]}")
        out = pd.DataFrame({"ord": batch["ord"].to_numpy()[late], "ts": ts[late], "prev_ts": seen[:-1][late]})
        for name, value in zip(reversed(self.keys), reversed(key)):
            out.insert(0, name, value)
        yield out

    def close(self) -> None:
        pass


def late_rows(
    records: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    arrival: str = "ord",
    ts: str = "local_ts",
    refuse: bool = False,
) -> DataFrame:
    """The side table of a stream: keys, arrival, time and ``prev_ts``, the latest time that
    any earlier arrival of the key had, of every row that lies before it.

    The live form of ``operators.resample.order_violations``: the state of a key is one
    number, whatever has passed. Every micro-batch tells a listener its rows (``arrived``)
    and its late ones (``late``). With ``refuse`` the first late row ends the stream.
    ``arrival`` and ``ts`` are integers; rows without one of them are in no order and take
    no part. Equal times are in order.
    """
    _use_rocksdb(records)
    src = records.select(*keys, F.col(arrival).cast("long").alias("ord"), F.col(ts).cast("long").alias("ts"))
    src = src.where("ord IS NOT NULL AND ts IS NOT NULL").observe(ARRIVED, F.count(F.lit(1)).alias("rows"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keys)
    late = src.groupBy(*keys).transformWithStateInPandas(
        OrderCheck(keys, refuse), f"{kinds}, ord long, ts long, prev_ts long", "Append", "None"
    )
    late = late.observe(LATE, F.count(F.lit(1)).alias("rows"))
    return late.withColumnsRenamed({"ord": arrival, "ts": ts})
