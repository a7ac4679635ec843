"""Bars from streams of ticks, and alerts with state (an extension: the batch rules have no streaming form of their own)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, rule: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream of (symbol, ts, price, volume, seq); a bar is final once ``late`` has passed its end."""
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", rule)).agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def unique_ticks(ticks: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_alerts(alerts: DataFrame, days: float = 5, jump: float = 15, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream (symbol, side, at, score) that pass the de-duplication, with the last one sent as state.

    Alerts without a time or score are left out.  State goes once ``days``
    have passed since it last changed, as it then mutes nothing any more.
    """

    def pass_on(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["symbol", "side", "at", "score"])
            return
        last = state.get if state.exists else None
        out = []
        for b in batches:
            b = b.dropna(subset=["at", "score"])
            for at, score in sorted(zip(b["at"], b["score"], strict=True)):
                if last is None or (at - last[0]).total_seconds() >= days * 86_400 or abs(score - last[1]) >= jump:
                    last = (at.to_pydatetime(), float(score))
                    out.append((*key, *last))
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(int((last[0].timestamp() + days * 86_400) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "side", "at", "score"])

    schema = "symbol string, side string, at timestamp, score double"
    rows = alerts.withWatermark("at", late).groupBy("symbol", "side")
    return rows.applyInPandasWithState(pass_on, schema, "at timestamp, score double", "append", "EventTimeTimeout")


def each_batch(df: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands every batch to ``act``."""
    return df.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
