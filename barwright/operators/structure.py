"""Market structure: swings, breaks, order blocks, price gaps, liquidity pools, zones.

Every object carries the bar it becomes known at and the bar its state flips
at (null: not yet), so that any earlier view is a filter on the two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol


def raw_swings(bars: DataFrame, n: int = 3) -> DataFrame:
    """Highs above, and lows below, all n bars on either side; known n bars later.  seq orders them."""
    before, after = by_symbol().rowsBetween(-n, -1), by_symbol().rowsBetween(1, n)
    full = (F.count("high").over(before) == n) & (F.count("high").over(after) == n)
    peak = full & (F.col("high") > F.greatest(F.max("high").over(before), F.max("high").over(after)))
    dip = full & (F.col("low") < F.least(F.min("low").over(before), F.min("low").over(after)))
    found = bars.withColumns({"_peak": peak, "_dip": dip}).where("_peak OR _dip")
    both = F.array_compact(F.array(
        F.when(F.col("_peak"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"), (2 * F.col("i")).alias("seq"))),
        F.when(F.col("_dip"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"), (2 * F.col("i") + 1).alias("seq"))),
    ))
    return found.select("symbol", "i", "ts", F.explode(both).alias("s")).select("symbol", "i", "ts", "s.*", (F.col("i") + n).alias("conf_i"))


def swings(bars: DataFrame, n: int = 3, causal: bool = False) -> DataFrame:
    """Of each run of swings of one kind the most extreme, the later of equals; labelled against the last of its kind.

    Over the whole history a later swing may replace an earlier one of its
    run, which an earlier view could not know.  With ``causal`` each swing
    that was the most extreme of its run so far is kept.
    """
    w = Window.partitionBy("symbol").orderBy("seq")
    raw = raw_swings(bars, n).withColumn("_turn", (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))).cast("int"))
    raw = raw.withColumns({"_run": F.sum("_turn").over(w), "_x": F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))})
    run = Window.partitionBy("symbol", "_run")
    if causal:
        best = F.max(F.struct("_x", "seq")).over(run.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    else:
        best = F.max(F.struct("_x", "seq")).over(run)
    kept = raw.withColumn("_best", best).where("seq = _best.seq").drop("_turn", "_run", "_x", "_best")
    last = F.lag("price").over(Window.partitionBy("symbol", "kind").orderBy("seq"))
    up = F.col("price") > last
    label = (
        F.when(last.isNull(), None).when(F.col("kind") == "high", F.when(up, "HH").otherwise("LH")).otherwise(F.when(up, "HL").otherwise("LL"))
    )
    return kept.withColumn("label", label)


def structure_events(bars: DataFrame, sw: DataFrame) -> DataFrame:
    """First close beyond each swing while it is the latest of its kind; BOS with the trend, CHoCH against it."""
    # A level reigns until the next of its kind is known, so at each bar the last one known is the one to break.
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    known = sw.groupBy("symbol", F.col("conf_i").alias("i")).agg(*(
        F.max(F.when(F.col("kind") == k, F.struct("seq", F.col("price").alias("broken_level"), F.col("i").alias("broken_i")))).alias(f"_{k}") for k in ("high", "low")
    ))
    df = bars.select("symbol", "i", "close").join(known, ["symbol", "i"], "left").withColumns({c: F.last(c, True).over(w) for c in ("_high", "_low")})
    broken = F.array_compact(F.array(
        F.when(F.col("close") > F.col("_high.broken_level"), F.struct(F.lit("high").alias("kind"), F.col("_high").alias("l"))),
        F.when(F.col("close") < F.col("_low.broken_level"), F.struct(F.lit("low").alias("kind"), F.col("_low").alias("l"))),
    ))
    hit = df.select("symbol", "i", "close", F.explode(broken).alias("x"))
    first = hit.groupBy("symbol", F.col("x.kind").alias("kind"), F.col("x.l.broken_i").alias("broken_i"), F.col("x.l.broken_level").alias("broken_level")).agg(
        F.min(F.struct("i", "close")).alias("e")
    )
    ev = first.select(
        "symbol", F.col("e.i").alias("i"), F.col("e.close").alias("price"),
        F.when(F.col("kind") == "high", "bullish").otherwise("bearish").alias("side"), "broken_level", "broken_i",
    )
    before = F.lag("side").over(by_symbol())
    return ev.withColumn("type", F.when(before.isNull() | (before == F.col("side")), "BOS").otherwise("CHoCH"))


def order_blocks(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Last bar of the opposite colour between the broken swing and the break; mitigated at the first later touch."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct(F.col("i").alias("k"), "high", "low")
    df = bars.select(
        "symbol", F.col("i").alias("event_i"),
        F.last(F.when(F.col("close") < F.col("open"), me), True).over(w).alias("_fell"), F.last(F.when(F.col("close") > F.col("open"), me), True).over(w).alias("_rose"),
    )
    e = events.select("symbol", F.col("i").alias("event_i"), "side", "broken_i").join(df, ["symbol", "event_i"])
    last = e.withColumn("o", F.when(F.col("side") == "bullish", F.col("_fell")).otherwise(F.col("_rose"))).where(F.col("o.k") >= F.col("broken_i"))
    zones = last.groupBy("symbol", F.col("o.k").alias("start_i"), "side").agg(F.min(F.struct("event_i", "o")).alias("f")).select(
        "symbol", "start_i", "side", F.col("f.event_i").alias("event_i"), F.col("f.o.high").alias("top"), F.col("f.o.low").alias("bottom")
    )
    return first_touch(zones, bars, "event_i", F.col("top"), F.col("bottom"), "mitigated_i")


def current_trend(bars: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, i, trend: the side of the last break so far, null before the first."""
    at = events.select("symbol", "i", F.col("side").alias("_side"))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("symbol", "i").join(at, ["symbol", "i"], "left").select("symbol", "i", F.last("_side", True).over(w).alias("trend"))


class _Firsts:
    """First place from a start on where values are at or under a bound, by minima over stretches of 1, 2, 4 ... values."""

    def __init__(self, x: np.ndarray):
        self.n, self.low = len(x), [x]
        while 2 ** len(self.low) <= self.n:
            half = 2 ** (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def at(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """n where there is none.  Whole stretches over the bound are stepped over, the longest first."""
        k = start.copy()
        for level in reversed(range(len(self.low))):
            low = self.low[level]
            inside = k < len(low)
            over = inside & (low[np.where(inside, k, 0)] > bound)
            k = np.where(over, k + 2**level, k)
        return k


def first_touch(objects: DataFrame, bars: DataFrame, known: str, top: Column, bottom: Column, out: str, strict: bool = False) -> DataFrame:
    """Adds the first bar after ``known`` whose low is at or under ``top`` and whose high is at or over ``bottom``; null if none is.

    A bound of null doesn't count; with ``strict`` bars must go beyond them.  A symbol's objects look their bars up in
    trees of minima, so the cost follows the bars and the objects, not their
    product.
    """
    fields = objects.schema.fields
    names = [f.name for f in fields]
    asked = objects.select("*", top.alias("_top"), bottom.alias("_bottom"))

    def run(o: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("b_i")
        i, n = b["b_i"].to_numpy(np.int64), len(b)
        found = np.full(len(o), -1, np.int64)
        if n and len(o):
            low, high = _Firsts(b["b_low"].to_numpy(float)), _Firsts(-b["b_high"].to_numpy(float))
            t = o["_top"].to_numpy(float)
            t, m = np.where(np.isnan(t), np.inf, t), o["_bottom"].to_numpy(float)
            m = np.where(np.isnan(m), np.inf, -m)
            if strict:
                t, m = np.nextafter(t, -np.inf), np.nextafter(m, -np.inf)
            k = np.searchsorted(i, o[known].to_numpy(np.int64), side="right")
            while True:  # to the next bar that is low enough, then to the next that is high enough, until they agree
                a = low.at(k, t)
                z = high.at(a, m)
                if (a == z).all():
                    break
                k = z
            found = np.where(a < n, i[np.minimum(a, n - 1)], -1)
        o = o[names].assign(**{out: pd.array(found, "Int32")})
        return o.assign(**{out: o[out].where(o[out] >= 0)})

    types = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{out} int"])
    b = bars.select(*(F.col(c).alias(f"b_{c}") for c in ("symbol", "i", "high", "low")))  # names of their own, as objects derive from the same bars
    return asked.groupBy("symbol").cogroup(b.groupBy("b_symbol")).applyInPandas(run, types)


def price_gaps(ind: DataFrame, min_share: float = 0.0, min_atr: float = 0.5) -> DataFrame:
    """Three bars whose outer two leave a gap; filled at the first later bar that reaches back into it.  Needs column atr."""
    w = by_symbol()
    h1, l1 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    side = F.when(h1 < F.col("low"), "bullish").when(l1 > F.col("high"), "bearish")
    df = ind.withColumns({"side": side, "_h1": h1, "_l1": l1}).where("side IS NOT NULL")
    bull = F.col("side") == "bullish"
    df = df.select(
        "symbol", (F.col("i") - 2).alias("start_i"), F.col("i").alias("end_i"), "side",
        F.when(bull, F.col("low")).otherwise(F.col("_l1")).alias("top"), F.when(bull, F.col("_h1")).otherwise(F.col("high")).alias("bottom"),
        F.when(bull, F.col("_h1")).otherwise(F.col("_l1")).alias("_ref"), "atr",
    )
    size = F.col("top") - F.col("bottom")
    if min_share > 0:
        df = df.where(size / F.col("_ref") >= min_share)
    if min_atr > 0:
        df = df.where((F.col("atr") <= 0) | (size / F.col("atr") >= min_atr))
    bull = F.col("side") == "bullish"
    return first_touch(df.drop("_ref", "atr"), ind, "end_i", F.when(bull, F.col("top")), F.when(~bull, F.col("bottom")), "filled_i")


def liquidity_pools(bars: DataFrame, sw: DataFrame, tolerance: float = 0.0015) -> DataFrame:
    """Pairs of nearly equal swings, the second among the next three of its kind; swept at the first later bar beyond."""
    w = Window.partitionBy("symbol", "kind").orderBy("seq")
    nxt = F.array_compact(F.array(*(F.when(F.lead("i", k).over(w).isNotNull(), F.struct(F.lead("i", k).over(w).alias("b_i"), F.lead("price", k).over(w).alias("pb"), F.lead("conf_i", k).over(w).alias("cb"))) for k in (1, 2, 3))))
    pairs = sw.withColumn("_n", nxt).select("symbol", "kind", F.col("i").alias("a_i"), "price", "conf_i", F.explode("_n").alias("n"))
    mean = (F.col("price") + F.col("n.pb")) / 2
    pools = pairs.where(F.abs(F.col("price") - F.col("n.pb")) / mean <= tolerance).select(
        "symbol", "a_i", F.col("n.b_i").alias("b_i"), mean.alias("price"), F.when(F.col("kind") == "high", "EQH").otherwise("EQL").alias("kind"),
        F.greatest("conf_i", "n.cb").alias("conf_i"),
    )
    return first_touch(pools, bars, "conf_i", F.when(F.col("kind") == "EQL", F.col("price")), F.when(F.col("kind") == "EQH", F.col("price")), "swept_i", strict=True)


def zones(bars: DataFrame, sw: DataFrame) -> DataFrame:
    """Range between the latest high and low known at each bar, and where the close stands in it."""
    known = sw.groupBy("symbol", F.col("conf_i").alias("i")).agg(
        F.max(F.when(F.col("kind") == "high", F.col("price"))).alias("_h"), F.max(F.when(F.col("kind") == "low", F.col("price"))).alias("_l")
    )
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = bars.select("symbol", "i", "close").join(known, ["symbol", "i"], "left").withColumns({"_h": F.last("_h", True).over(w), "_l": F.last("_l", True).over(w)})
    df = df.where("_h IS NOT NULL AND _l IS NOT NULL").select(
        "symbol", "i", "close", F.greatest("_h", "_l").alias("top"), F.least("_h", "_l").alias("bottom")
    ).withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
    zone = F.when(F.col("close") > F.col("mid"), "premium").when(F.col("close") < F.col("mid"), "discount").otherwise("equilibrium")
    return df.withColumn("zone", zone).drop("close")
