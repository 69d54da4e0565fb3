"""Live vehicle feeds as streams: an extension, the audit itself is batch. Each function also takes a batch table, with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def positions(events: DataFrame) -> DataFrame:
    """(vehicle_id, route_id, ts, delay, event_id) of the events table; streams need a timestamp with a zone."""
    return events.select(F.col("user_id").alias("vehicle_id"), (F.col("user_id") % 7).alias("route_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("delay"), "event_id")


def latest(p: DataFrame) -> DataFrame:
    """The last position of each vehicle (update or complete mode)."""
    return p.groupBy("vehicle_id").agg(F.max(F.struct("ts", "event_id", "delay")).alias("p")).select("vehicle_id", "p.ts", "p.event_id", "p.delay")


def delays(p: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Count, mean and largest delay by route and window."""
    g = p.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "route_id").agg(F.count("*").alias("n"), F.sum("delay").alias("total"), F.max("delay").alias("most"))
    return g.select(F.col("w.start").alias("start"), "route_id", "n", "total", "most")


def distinct_positions(p: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Repeats of an event within the watermark are dropped."""
    return p.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if p.isStreaming else p.dropDuplicates(["event_id"])


def sessions(p: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Runs of a vehicle's positions without a pause of ``gap``."""
    g = p.withWatermark("ts", late).groupBy("vehicle_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("vehicle_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _TrailingLimit(StatefulProcessor):
    """Lets a call through if fewer than ``most`` that it let through lie in the trailing ``seconds``."""

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        calls = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for t, e in zip(calls.ts.map(pd.Timestamp.timestamp), calls.event_id, strict=True):
            recent = [x for x in recent if x > t - self.seconds]
            if len(recent) < self.most:
                recent.append(t)
                out.append(e)
        self.recent.put([(float(x),) for x in recent])
        yield pd.DataFrame({"vehicle_id": [key[0]] * len(out), "event_id": out})

    def close(self) -> None:
        pass


def limited(p: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """Calls that a limit of ``most`` in trailing ``seconds`` lets through, kept as state by vehicle."""
    return p.groupBy("vehicle_id").transformWithStateInPandas(_TrailingLimit(most, seconds), outputStructType="vehicle_id long, event_id long", outputMode="append", timeMode="none")
