"""Open positions and open price levels as state of a stream, by symbol.

Bars must come in order of time within a symbol, up to what one micro-batch
brings in any order: a bar that isn't after the last one taken in is late and
left out.  Bars with a null high, low or close are left out too.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A stateful processor needs a store with several states a key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_POSITION = "entry_ts timestamp, entry_price double, initial double, stop double, peak double, n_bars long, last_ts timestamp"
TRACKED = "symbol string, entry_ts timestamp, ts timestamp, entry_price double, peak double, last double, initial_stop double, stop double, n_bars long, locked_in boolean, breached boolean, expired boolean"


class _Positions(StatefulProcessor):
    def __init__(self, mult: float, idle_days: float):
        self.mult, self.idle = mult, pd.Timedelta(days=idle_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _POSITION)
        self.bars = handle.getValueState("bars", "last_ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol, batch = key[0], pd.concat(list(rows)).sort_values(["ts", "entry_price"], na_position="last")
        held = [list(r) for r in self.open.get()]
        last_ts = self.bars.get()[0] if self.bars.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            if r.entry_price == r.entry_price:  # a new position
                if r.entry_price > 0 and r.ts == r.ts:
                    held.append([r.ts.to_pydatetime(), float(r.entry_price), None if r.stop != r.stop else float(r.stop), None, None, 0, r.ts.to_pydatetime()])
                continue
            if not (r.high == r.high and r.close == r.close) or (last_ts is not None and r.ts <= last_ts):
                continue
            last_ts = r.ts.to_pydatetime()
            left = []
            for p in held:
                if r.ts < p[0]:
                    left.append(p)
                    continue
                entry_ts, price, initial, stop, peak, n, _ = p
                atr = float(r.atr) if r.atr == r.atr else 0.0
                initial = price - self.mult * atr if initial is None else initial
                peak = r.high if peak is None else max(peak, r.high)
                now = max(initial, peak - self.mult * atr) if atr > 0 else initial
                stop = now if stop is None else max(stop, now)  # never back, also where the range widens
                breached = r.close <= stop
                out.append((symbol, entry_ts, last_ts, price, peak, r.close, initial, stop, n + 1, stop >= price, breached, False))
                if not breached:
                    left.append([entry_ts, price, initial, stop, peak, n + 1, last_ts])
            held = left
        self._keep(held, last_ts)
        yield _frame(out)

    def _keep(self, held: list[list], last_ts) -> None:
        """State and a timer for when no bar comes any more; symbols without positions have neither."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not held:
            self.open.clear()
            self.bars.clear()
            return
        self.open.put([tuple(p) for p in held])
        if last_ts is not None:
            self.bars.update((last_ts,))
        latest = max([p[6] for p in held] + ([last_ts] if last_ts is not None else []))
        self.handle.registerTimer(int((pd.Timestamp(latest).tz_localize(None) + self.idle).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(key[0], p[0], p[6], p[1], p[4], None, p[2], p[3], p[5], None, None, True) for p in self.open.get()]
        self.open.clear()
        self.bars.clear()
        yield _frame(rows)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in TRACKED.split(", ")]
    kinds = {"entry_ts": "datetime64[us]", "ts": "datetime64[us]", "n_bars": "int64", "locked_in": "boolean", "breached": "boolean", "expired": "boolean"}
    return pd.DataFrame(rows, columns=names).astype(kinds | {c: "float64" for c in ("entry_price", "peak", "last", "initial_stop", "stop")})


def stream_positions(moves: DataFrame, mult: float = 5.0, late: str = "1 day", idle_days: float = 30) -> DataFrame:
    """A row for each bar of each open position: peak, trailing stop and whether the close is through it.

    moves: symbol, ts, entry_price, stop (both only in rows that open a
    position at ts), high, close, atr (only in bars).  The stop ratchets: it
    never falls, also where the average range widens, which the batch form
    without memory can't promise.  A position ends with the bar that breaches
    its stop, or with a row ``expired`` once time has gone on by ``idle_days``
    past its symbol's last bar; its state goes with it.
    """
    spark = moves.sparkSession
    spark.conf.set(*STORE)
    rows = moves.withWatermark("ts", late).select("symbol", "ts", "entry_price", "stop", "high", "close", "atr")
    return rows.groupBy("symbol").transformWithStateInPandas(_Positions(mult, idle_days), TRACKED, "Append", "EventTime")


_LEVEL = "level string, known int, top double, bottom double, strict boolean"
FLIPPED = "symbol string, level string, flip_i int"


class _Book:
    """Open levels in order of the price that reaches them: from below those with a bottom, from above those with a top alone."""

    def __init__(self):
        self.over: list[tuple] = []  # bottom, ...: a high at it or over it may reach them
        self.under: list[tuple] = []  # -top, ...: a low at it or under it reaches them

    def add(self, level: str, known: int, top: float | None, bottom: float | None, strict: bool) -> None:
        row = (level, known, top, bottom, strict)
        if bottom is not None:
            insort(self.over, (bottom, *row[:2], row))
        elif top is not None:
            insort(self.under, (-top, *row[:2], row))

    def touch(self, i: int, high: float, low: float) -> list[str]:
        """Takes out and names the levels that a bar reaches."""
        names = []
        for book, price in ((self.over, high), (self.under, -low)):
            kept, k = [], 0
            while k < len(book) and book[k][0] <= price:
                level, known, top, bottom, strict = book[k][3]
                beyond = (bottom is None or high > bottom or (not strict and high == bottom)) and (top is None or low < top or (not strict and low == top))
                if i > known and beyond:
                    names.append(level)
                else:
                    kept.append(book[k])
                k += 1
            book[:k] = kept
        return names

    def rows(self) -> list[tuple]:
        return [x[3] for x in (*self.over, *self.under)]


class _Flips(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", _LEVEL)
        self.last = handle.getValueState("last", "i int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        none = lambda x: None if x != x else float(x)
        book = _Book()
        for r in self.open.get():
            book.add(*r)
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        batch = pd.concat(list(rows))
        batch = batch.assign(is_bar=batch["level"].isna()).sort_values(["i", "is_bar"], ascending=[True, False])  # a bar before the levels known at it
        for r in batch.itertuples(index=False):
            if not r.is_bar:
                book.add(r.level, int(r.i), none(r.top), none(r.bottom), bool(r.strict))
            elif r.i > last and r.high == r.high and r.low == r.low:
                last = int(r.i)
                out += [(key[0], name, last) for name in book.touch(last, r.high, r.low)]
        self.open.put(book.rows()) if book.rows() else self.open.clear()
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "level", "flip_i"]).astype({"flip_i": "int32", "symbol": object, "level": object})

    def close(self) -> None:
        pass


def stream_flips(moves: DataFrame) -> DataFrame:
    """symbol, level, flip_i: each level once, with the first bar after it that reaches it.

    moves: symbol, i, and either high, low (a bar) or level, top, bottom,
    strict (a level that is known from bar i on).  A level with both bounds
    is reached by a bar that overlaps them, with one bound by a bar that gets
    to it, and where ``strict`` beyond it.  Levels come no later than the
    bars after them; one that does is open from then on.  Levels that are
    reached leave the state.
    """
    moves.sparkSession.conf.set(*STORE)
    rows = moves.select("symbol", "i", "high", "low", "level", "top", "bottom", "strict")
    return rows.groupBy("symbol").transformWithStateInPandas(_Flips(), FLIPPED, "Append", "None")


def level_moves(objects: DataFrame, name: str, known: str, top: F.Column, bottom: F.Column, strict: bool = False) -> DataFrame:
    """Objects of a structure table as rows of ``moves``."""
    none = F.lit(None).cast("double")
    return objects.select(
        "symbol", F.col(known).cast("int").alias("i"), none.alias("high"), none.alias("low"), F.col(name).cast("string").alias("level"),
        top.cast("double").alias("top"), bottom.cast("double").alias("bottom"), F.lit(strict).alias("strict"),
    )


def bar_moves(bars: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return bars.select("symbol", "i", "high", "low", F.lit(None).cast("string").alias("level"), none.alias("top"), none.alias("bottom"), F.lit(False).alias("strict"))
