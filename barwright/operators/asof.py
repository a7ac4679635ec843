"""What was known at each bar: active objects, score components, scores.

An object is active from the bar it becomes known at to the bar before its
state flips.  Scores and plans ask only whether an active object meets a
price range and which edges are nearest to a price.  A sweep answers that: it
goes along a symbol's bars, keeps the edges of the active objects in order of
price, and looks each bar's prices up in them, so the cost follows bars and
objects and no pairs of them are made.  ``active_on`` lists the pairs, for
those who want them, by equality on (symbol, block of bars).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol

BLOCK = 128
#: Bars of a symbol that one task sweeps.
SEGMENT = 1 << 16


def active_on(bars: DataFrame, objects: DataFrame, known: str, flip: str) -> DataFrame:
    """bars joined with the objects known by then and not flipped yet.  bars needs symbol, i."""
    last = bars.groupBy("symbol").agg(F.max("i").alias("_max"))
    o = objects.join(last, "symbol")
    end = F.least(F.coalesce(F.col(flip) - 1, F.col("_max")), F.col("_max"))
    o = o.where(end >= F.col(known)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(known) / BLOCK), F.floor(end / BLOCK)))).drop("_max")
    b = bars.withColumn("_b", F.floor(F.col("i") / BLOCK))
    return b.join(o, ["symbol", "_b"]).where((F.col(known) <= F.col("i")) & (F.col(flip).isNull() | (F.col(flip) > F.col("i")))).drop("_b")


def active_counts(bars: DataFrame, objects: DataFrame, known: str, flip: str, sides: tuple[str, str] = ("bullish", "bearish")) -> DataFrame:
    """symbol, i, n_bull, n_bear: how many objects of each side are active, as a running sum of those that begin and end."""
    begin = objects.select("symbol", F.col(known).alias("i"), "side", F.lit(1).alias("_d"))
    moves = begin.unionByName(objects.where(F.col(flip).isNotNull()).select("symbol", F.col(flip).alias("i"), "side", F.lit(-1).alias("_d")))
    moves = moves.groupBy("symbol", "i").agg(*(F.sum(F.when(F.col("side") == s, F.col("_d"))).alias(n) for s, n in zip(sides, ("n_bull", "n_bear"), strict=True)))
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = bars.select("symbol", "i").join(moves, ["symbol", "i"], "left")
    return df.select("symbol", "i", *(F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(n) for n in ("n_bull", "n_bear")))


def _dealt(bars: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bars (symbol, i, ...) and objects (symbol, side, low, high, known, flip) by stretches of bars; an object is in all stretches it is active in."""
    last = bars.groupBy("symbol").agg(F.max("i").alias("_max"))
    end = F.least(F.coalesce(F.col("flip") - 1, F.col("_max")), F.col("_max"))
    o = objects.select("symbol", "side", "low", "high", "known", "flip").join(last, "symbol").where(end >= F.col("known"))
    o = o.withColumn("_seg", F.explode(F.sequence(F.floor(F.col("known") / SEGMENT), F.floor(end / SEGMENT)))).drop("_max")
    return bars.withColumn("_seg", F.floor(F.col("i") / SEGMENT)), o.withColumnsRenamed({"symbol": "_symbol", "_seg": "_oseg"})


class _Levels:
    """Edges of one side's active objects, in order."""

    def __init__(self):
        self.low: list[float] = []
        self.high: list[float] = []

    def change(self, low: float, high: float, add: bool) -> None:
        for row, x in ((self.low, low), (self.high, high)):
            if add:
                insort(row, x)
            else:
                del row[bisect_left(row, x)]

    def meets(self, low: float, high: float) -> bool:
        """Whether any has its low edge at or under ``high`` and its high edge at or over ``low``: those that begin in time less those that are over."""
        return bisect_right(self.low, high) > bisect_left(self.high, low)


def _sweep(b: pd.DataFrame, o: pd.DataFrame, sides: tuple[str, str], ask) -> list[tuple]:
    """ask(levels of both sides, bar) at each bar in order."""
    levels = {s: _Levels() for s in sides}
    moves: list[tuple] = []
    for side, low, high, known, flip in zip(o["side"], o["low"], o["high"], o["known"], o["flip"], strict=True):
        if side in levels:
            moves.append((known, 1, side, low, high))
            if flip == flip and flip is not None:
                moves.append((flip, 0, side, low, high))
    moves.sort(reverse=True)
    out = []
    for bar in b.sort_values("i").itertuples(index=False):
        while moves and moves[-1][0] <= bar.i:
            _, add, side, low, high = moves.pop()
            levels[side].change(low, high, bool(add))
        out.append((bar.symbol, bar.i, *ask(*levels.values(), bar)))
    return out


def meeting(bars: DataFrame, objects: DataFrame, sides: tuple[str, str] = ("bullish", "bearish")) -> DataFrame:
    """symbol, i, first, second: whether an active object of each side meets the bar's range.

    bars: symbol, i, rmin, rmax; objects: symbol, side, low, high, known, flip.
    """

    def run(b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        rows = _sweep(b, o, sides, lambda p, q, bar: (int(p.meets(bar.rmin, bar.rmax)), int(q.meets(bar.rmin, bar.rmax))))
        return pd.DataFrame(rows, columns=["symbol", "i", "first", "second"])

    b, o = _dealt(bars.select("symbol", "i", "rmin", "rmax"), objects)
    return b.groupBy("symbol", "_seg").cogroup(o.groupBy("_symbol", "_oseg")).applyInPandas(run, "symbol string, i int, first int, second int")


def nearest(bars: DataFrame, objects: DataFrame, sides: tuple[str, str] = ("bullish", "bearish")) -> DataFrame:
    """symbol, i, under, over: the highest low edge under x of the first side's active objects, and the lowest high edge over x of the second's.

    bars: symbol, i, x; objects: symbol, side, low, high, known, flip.
    """

    def look(p: _Levels, q: _Levels, bar) -> tuple[float | None, float | None]:
        k, m = bisect_left(p.low, bar.x), bisect_right(q.high, bar.x)
        return p.low[k - 1] if k else None, q.high[m] if m < len(q.high) else None

    def run(b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_sweep(b, o, sides, look), columns=["symbol", "i", "under", "over"])

    b, o = _dealt(bars.select("symbol", "i", "x"), objects)
    return b.groupBy("symbol", "_seg").cogroup(o.groupBy("_symbol", "_oseg")).applyInPandas(run, "symbol string, i int, under double, over double")


def recent_range(bars: DataFrame, n: int = 3) -> DataFrame:
    """Adds rmin, rmax and first bar of the last n bars."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    return bars.withColumns({"rmin": F.min("low").over(w), "rmax": F.max("high").over(w), "r_first": F.min("i").over(w)})


def _touched(bars: DataFrame, objects: DataFrame, known: str, flip: str, prefix: str) -> DataFrame:
    """Whether any active object of a side overlaps the recent range."""
    o = objects.select("symbol", "side", F.col("bottom").alias("low"), F.col("top").alias("high"), F.col(known).alias("known"), F.col(flip).alias("flip"))
    return meeting(bars, o).select("symbol", "i", F.col("first").alias(f"bull_{prefix}"), F.col("second").alias(f"bear_{prefix}"))


def _last_event(bars: DataFrame, events: DataFrame) -> DataFrame:
    e = events.select("symbol", "i", F.struct(F.col("i").alias("at"), "type", "side").alias("_e"))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = bars.select("symbol", "i", "r_first").join(e, ["symbol", "i"], "left").withColumn("_e", F.last("_e", True).over(w))
    fresh = F.coalesce(F.col("_e.at") >= F.col("r_first"), F.lit(False))
    is_ = lambda t, s: (fresh & (F.col("_e.type") == t) & (F.col("_e.side") == s)).cast("int")
    return df.select("symbol", "i", *(is_(t, s).alias(f"{p}_{t.lower()}") for t in ("CHoCH", "BOS") for p, s in (("bull", "bullish"), ("bear", "bearish"))))


def _swept(bars: DataFrame, pools: DataFrame, n: int) -> DataFrame:
    """Pools swept within the last n bars that the close has come back from."""
    at = pools.where("swept_i IS NOT NULL").select("symbol", "kind", "price", F.explode(F.sequence(F.col("swept_i"), F.col("swept_i") + n - 1)).alias("i"))
    back = bars.select("symbol", "i", "close").join(at, ["symbol", "i"])
    bull = (F.col("kind") == "EQL") & (F.col("close") > F.col("price"))
    bear = (F.col("kind") == "EQH") & (F.col("close") < F.col("price"))
    return back.groupBy("symbol", "i").agg(F.max(bull.cast("int")).alias("bull_sweep"), F.max(bear.cast("int")).alias("bear_sweep"))


def components(
    ind: DataFrame, zone: DataFrame, obs: DataFrame, gaps: DataFrame, events: DataFrame, pools: DataFrame,
    recent: int = 3, adx_threshold: float = 20.0, ml: DataFrame | None = None,
) -> DataFrame:
    """bull_ and bear_ columns of the eleven components at every bar.  ml: symbol, i, prob_up."""
    b = recent_range(ind, recent)
    df = b
    for part in (
        zone.select("symbol", "i", "zone"), _touched(b, obs, "event_i", "mitigated_i", "order_block"),
        _touched(b, gaps, "end_i", "filled_i", "fvg"), _last_event(b, events), _swept(b, pools, recent),
    ):
        df = df.join(part, ["symbol", "i"], "left")
    c = F.col
    trend = c("adx") >= adx_threshold
    made: dict[str, Column] = {
        "bull_zone": c("zone") == "discount", "bear_zone": c("zone") == "premium",
        "bull_rsi": c("rsi") > 50, "bear_rsi": c("rsi") < 50, "bull_macd": c("macd_hist") > 0, "bear_macd": c("macd_hist") < 0,
        "bull_ema_stack": (c("ema20") > c("ema50")) & (c("ema50") > c("ema200")),
        "bear_ema_stack": (c("ema20") < c("ema50")) & (c("ema50") < c("ema200")),
        "bull_adx_di": trend & (c("plus_di") > c("minus_di")), "bear_adx_di": trend & (c("plus_di") <= c("minus_di")),
    }
    df = df.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in made.items()})
    df = df.withColumns({f"{p}_{k}": F.coalesce(f"{p}_{k}", F.lit(0)) for p in ("bull", "bear") for k in ("order_block", "fvg", "choch", "bos", "sweep")})
    if ml is None:
        return df.withColumns({"bull_ml": F.lit(0.0), "bear_ml": F.lit(0.0)})
    df = df.join(ml.select("symbol", "i", "prob_up"), ["symbol", "i"], "left")
    strength = F.least(F.abs(c("prob_up") - 0.5) * 2, F.lit(1.0))
    return df.withColumns({
        "bull_ml": F.when(c("prob_up") > 0.5, strength).otherwise(0.0), "bear_ml": F.when(c("prob_up") < 0.5, strength).otherwise(0.0),
    })


def scores(comp: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """bull_score, bear_score: weighted sums, rounded half to even, 100 at most."""
    total = lambda p: sum((F.col(f"{p}_{k}") * float(w) for k, w in weights.items()), F.lit(0.0))
    return comp.withColumns({f"{p}_score": F.least(F.bround(total(p), 0), F.lit(100.0)).cast("int") for p in ("bull", "bear")})


def reasons(comp: DataFrame) -> DataFrame:
    """Names of the components that speak for each side, as arrays."""
    names = ("zone", "order_block", "fvg", "choch", "bos", "sweep", "rsi", "macd", "ema_stack", "adx_di", "ml")
    return comp.withColumns({f"{p}_reasons": F.array_compact(F.array(*(F.when(F.col(f"{p}_{n}") > 0, F.lit(n)) for n in names))) for p in ("bull", "bear")})
