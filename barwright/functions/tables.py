"""Table functions for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

_EVENTS = (
    StructType().add("symbol", StringType()).add("i", IntegerType()).add("price", DoubleType()).add("type", StringType())
    .add("side", StringType()).add("broken_level", DoubleType()).add("broken_i", IntegerType())
)


def _extremes(x: np.ndarray, n: int) -> np.ndarray:
    """Places whose value is over all n values on either side."""
    if len(x) < 2 * n + 1:
        return np.zeros(0, np.int64)
    around = np.lib.stride_tricks.sliding_window_view(x, 2 * n + 1)
    return np.flatnonzero(around[:, n] > np.delete(around, n, axis=1).max(axis=1)) + n


class StructureEvents:
    """structure_events(TABLE(bars), lookback => 3): breaks of swing levels, a partition a symbol, whatever the table's other columns.

    bars needs symbol, i, high, low and close.  Bars without one of them are
    left out.  A symbol's bars are held until its last one, as which swing
    stands for a run of them is known only then.
    """

    def __init__(self):
        self.symbol, self.bars, self.lookback = None, [], 3

    @staticmethod
    def analyze(bars: AnalyzeArgument, lookback: AnalyzeArgument | None = None) -> AnalyzeResult:
        have = {f.name for f in bars.dataType} if isinstance(bars.dataType, StructType) else set()
        if missing := {"symbol", "i", "high", "low", "close"} - have:
            raise ValueError(f"structure_events needs a table with columns {', '.join(sorted(missing))}")
        if lookback is not None and (lookback.value is None or lookback.value < 1):
            raise ValueError("lookback is a whole number over 0")
        return AnalyzeResult(schema=_EVENTS, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("i")])

    def eval(self, row, lookback: int = 3):
        self.symbol, self.lookback = row["symbol"], lookback
        values = (row["i"], row["high"], row["low"], row["close"])
        if None not in values:
            self.bars.append(values)

    def terminate(self):
        if not self.bars:
            return
        i, high, low, close = (np.array(c) for c in zip(*self.bars, strict=True))
        n = self.lookback
        found = sorted([(int(k), 0, float(high[k])) for k in _extremes(high, n)] + [(int(k), 1, float(low[k])) for k in _extremes(-low, n)])
        kept: list[tuple[int, int, float]] = []
        for place, kind, price in found:
            if kept and kept[-1][1] == kind:
                if (price >= kept[-1][2]) if kind == 0 else (price <= kept[-1][2]):
                    kept[-1] = (place, kind, price)
            else:
                kept.append((place, kind, price))
        level: list[tuple[float, int] | None] = [None, None]
        trend, at = None, 0
        for t in range(len(close)):
            while at < len(kept) and kept[at][0] + n <= t:
                level[kept[at][1]] = (kept[at][2], kept[at][0])
                at += 1
            for kind, side in ((0, "bullish"), (1, "bearish")):
                if level[kind] is not None and (close[t] > level[kind][0] if kind == 0 else close[t] < level[kind][0]):
                    price, place = level[kind]
                    level[kind] = None
                    yield self.symbol, int(i[t]), float(close[t]), "BOS" if trend in (None, side) else "CHoCH", side, price, int(i[place])
                    trend = side
                    break


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("structure_events", udtf(StructureEvents))
