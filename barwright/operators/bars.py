"""Bars: from ticks, resampled, numbered; returns and calendars.

A bar is (symbol, ts, i, open, high, low, close, volume); i numbers a
symbol's bars from 0.  Most rules count bars, not days, so i is what they
use; symbols have different calendars and are only ever joined by ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("symbol", "ts", "open", "high", "low", "close")


def check_columns(bars: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def by_symbol():
    return Window.partitionBy("symbol").orderBy("i")


def bars_from_ticks(ticks: DataFrame, rule: str) -> DataFrame:
    """ticks: symbol, ts, price, volume and seq, a value that orders them fully."""
    unit = rule.split()[1] if rule.startswith("1 ") else None
    at = F.date_trunc(unit, "ts").cast("timestamp_ntz") if unit in ("day", "hour", "week") else F.window("ts", rule).start.cast("timestamp_ntz")
    return ticks.groupBy("symbol", at.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"),
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars (week, month ...), left-closed and labelled by their start; empty ones don't appear."""
    check_columns(bars)
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "ts")


def index_bars(bars: DataFrame) -> DataFrame:
    check_columns(bars)
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    return bars.select("symbol", "ts", i.cast("int").alias("i"), "open", "high", "low", "close", "volume")


def returns(bars: DataFrame) -> DataFrame:
    """symbol, ts, i, ret; the first bar of a symbol has none."""
    before = F.lag("close").over(by_symbol())
    return bars.select("symbol", "ts", "i", (F.col("close") / before - 1).alias("ret")).where("ret IS NOT NULL")


def horizon_returns(bars: DataFrame, horizon: int) -> DataFrame:
    return bars.withColumn("future_return", F.lead("close", horizon).over(by_symbol()) / F.col("close") - 1)


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct times of all symbols, numbered: one row a time, so its sort is small beside the bars."""
    return bars.select("ts").distinct().withColumn("bar", F.row_number().over(Window.orderBy("ts")) - 1)
