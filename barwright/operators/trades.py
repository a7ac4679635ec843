"""Entry plans, stops and targets, and what became of each signal.

Exits are searched a stretch of a symbol's bars at a time, in trees of highs,
lows and falls, so a signal costs the logarithm of the bars it may be held
for, and no pairs of signals and bars are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from .asof import nearest
from .bars import by_symbol
from .extremes import Extremes


def entry_plan(ind: DataFrame, offset_atr: float = 0.5) -> DataFrame:
    """Limit below the close by a share of the average true range; null without one."""
    return ind.withColumn("limit_price", F.when(F.col("atr") > 0, F.col("close") - offset_atr * F.col("atr")))


def entry_fill(ind: DataFrame, cfg: Config) -> DataFrame:
    """entry_px and entry_off (bars after the next): the open if at or under the limit, else the limit if touched.

    Unfilled orders go to market at the first open after the valid bars, or
    are left out.  No fill at all is entry at the signal's close, offset -1.
    """
    w = by_symbol()
    df = entry_plan(ind, cfg.entry_offset_atr)
    limit, px, off = F.col("limit_price"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for k in reversed(range(cfg.entry_valid_bars)):
        o, low = F.lead("open", k + 1).over(w), F.lead("low", k + 1).over(w)
        px = F.when(o <= limit, o).when(low <= limit, limit).otherwise(px)
        off = F.when((o <= limit) | (low <= limit), F.lit(k)).otherwise(off)
    if cfg.entry_fallback == "market":
        late = F.lead("open", cfg.entry_valid_bars + 1).over(w)
        off = F.coalesce(off, F.when(limit.isNotNull() & late.isNotNull(), F.lit(cfg.entry_valid_bars)))
        px = F.coalesce(px, F.when(limit.isNotNull(), late))
    return df.withColumns({"entry_px": F.coalesce(px, F.col("close")), "entry_off": F.coalesce(off, F.lit(-1))})


def plans(filled: DataFrame, obs: DataFrame, pools: DataFrame, cfg: Config) -> DataFrame:
    """Stop and target of both sides at each bar, from the objects active then.  Null stop: no plan."""
    e = filled.select("symbol", "i", F.col("entry_px").alias("x"))
    o = obs.select("symbol", "side", F.col("bottom").alias("low"), F.col("top").alias("high"), F.col("event_i").alias("known"), F.col("mitigated_i").alias("flip"))
    o = nearest(e, o, ("bullish", "bearish")).select("symbol", "i", F.col("under").alias("_under"), F.col("over").alias("_over"))
    p = pools.select("symbol", F.col("kind").alias("side"), F.col("price").alias("low"), F.col("price").alias("high"), F.col("conf_i").alias("known"), F.col("swept_i").alias("flip"))
    p = nearest(e, p, ("EQL", "EQH")).select("symbol", "i", F.col("under").alias("_down"), F.col("over").alias("_up"))
    df = filled.join(o, ["symbol", "i"], "left").join(p, ["symbol", "i"], "left")
    entry, atr = F.col("entry_px"), F.col("atr")
    able = (atr > 0) & (entry > 0)
    for side, sign, base, pool in (("long", 1, "_under", "_up"), ("short", -1, "_over", "_down")):
        near = F.col(base) - sign * cfg.stop_buffer_atr * atr
        stop = F.when((near - entry) * sign < 0, near).otherwise(entry - sign * cfg.atr_stop_mult * atr)
        stop = F.coalesce(stop, entry - sign * cfg.atr_stop_mult * atr)
        if cfg.stop_risk_scale != 1.0:
            stop = entry - cfg.stop_risk_scale * (entry - stop)
        risk = (entry - stop) * sign
        rr = (F.col(pool) - entry) * sign / risk
        far = entry + sign * cfg.fallback_target_r * risk
        target = F.when(rr.between(cfg.min_rr, cfg.max_rr), F.col(pool)).otherwise(far)
        ok = able & (risk > 0)
        df = df.withColumns({f"{side}_stop": F.when(ok, stop), f"{side}_target": F.when(ok, target)})
    return df.drop("_under", "_over", "_up", "_down")


#: Bars of a symbol that one task takes; the next bars that its last signals look at come along.
SEGMENT = 1 << 16


def _exits(b: dict[str, np.ndarray], at: np.ndarray, sign: int, stop: np.ndarray, target: np.ndarray | None, mult: float, holding: int, breakeven_r: float | None = None):
    """Outcome code (0 timeout, 1 stop, 2 target), exit price and bars of each signal; ``at`` is the first future bar.

    Without targets the stop trails.  Shorts are longs in negative prices.
    """
    n, entry, stop = len(b["close"]), sign * b["entry_px"], sign * stop
    x = Extremes(*((b["high"], b["low"]) if sign > 0 else (-b["low"], -b["high"])), holding)
    at, end = np.minimum(at, n), np.minimum(at + holding, n)
    if target is not None:
        stopped, won = x.first_low(at, end, stop), x.first_high(at, end, sign * target)
        line = stop
    else:
        won, gap = end, mult * b["atr"]
        there = np.flatnonzero(at < end)
        best = entry.copy()
        best[there] = np.maximum(entry[there], x.high[0][at[there]])
        at_once = np.zeros(len(at), bool)
        at_once[there] = x.low[0][at[there]] <= stop[there]  # the first bar meets the plan's stop
        follow = np.where(at_once, end, np.minimum(at + 1, end))
        found, peak = x.first_under_trail(follow, end, stop, best, gap)
        stopped = np.where(at_once, at, found)
        line = np.where(at_once, stop, np.maximum(stop, peak - gap))
        if breakeven_r is not None:
            armed = x.first_high(at, end, entry + breakeven_r * (entry - stop))
            back = x.first_low(np.minimum(armed + 1, end), end, entry)
            line = np.where((back <= stopped) & (back < end), np.where(back < stopped, entry, np.maximum(line, entry)), line)
            stopped = np.minimum(stopped, back)
    code = np.where((stopped < end) & (stopped <= won), 1, np.where(won < end, 2, 0))
    last = sign * np.where(end > at, b["close"][np.maximum(end - 1, 0)], b["entry_px"])
    px = np.where(code == 1, line, np.where(code == 2, sign * target if target is not None else last, last))
    held = np.where(code == 1, stopped + 1, np.where(code == 2, won + 1, end)) - at
    return code, sign * px, held


def _by_segment(planned: DataFrame, ahead: int) -> DataFrame:
    """planned with the stretch of bars each row belongs to; rows that the stretch before looks at are there too, not as its own."""
    seg, place = F.floor(F.col("i") / SEGMENT), F.pmod(F.col("i"), F.lit(SEGMENT))
    to = F.when((seg > 0) & (place < ahead), F.array(seg, seg - 1)).otherwise(F.array(seg))
    return planned.withColumn("_seg", F.explode(to)).withColumn("_own", F.col("_seg") == seg)


def _one_side(planned: DataFrame, side: str, holding: int, trailing: bool, mult: float = 5.0, breakeven_r: float | None = None) -> DataFrame:
    cols = ["symbol", "i", "high", "low", "close", "atr", "entry_px", "entry_off", f"{side}_stop", f"{side}_target"]
    sign = 1 if side == "long" else -1

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)
        a = {c: b[c].to_numpy(float) for c in ("high", "low", "close", "entry_px", "atr")}
        at, stop = np.arange(len(b)) + b["entry_off"].to_numpy(np.int64) + 2, b[f"{side}_stop"].to_numpy(float)
        s = np.flatnonzero(b["_own"].to_numpy(bool) & ~np.isnan(stop) & (at < len(b)))
        own = a | {c: a[c][s] for c in ("entry_px", "atr")}
        target = None if trailing else b[f"{side}_target"].to_numpy(float)[s]
        code, px, held = _exits(own, at[s], sign, stop[s], target, mult, holding, breakeven_r)
        entry = own["entry_px"]
        return pd.DataFrame({
            "symbol": b["symbol"].to_numpy()[s], "i": b["i"].to_numpy()[s], "entry_px": entry, "outcome": np.array(["timeout", "stop", "target"], object)[code],
            "exit_px": px, "bars_held": held, "ret": (px - entry) * sign / entry, "r": (px - entry) * sign / ((entry - stop[s]) * sign),
        })

    rows = _by_segment(planned.select(*cols), holding + 8)
    return rows.groupBy("symbol", "_seg").applyInPandas(run, "symbol string, i int, entry_px double, outcome string, exit_px double, bars_held int, ret double, r double")


def exit_fixed(planned: DataFrame, side: str = "long", holding: int = 20) -> DataFrame:
    """Stop or target, the stop first where one bar reaches both, else the last close."""
    return _one_side(planned, side, holding, trailing=False)


def exit_trailing(planned: DataFrame, side: str = "long", mult: float = 5.0, holding: int = 250, breakeven_r: float | None = None) -> DataFrame:
    """The stop follows the best price at a distance of ``mult`` average ranges, from the second bar on, and never turns back."""
    return _one_side(planned, side, holding, True, mult, breakeven_r)


PLAN_COLUMNS = ("symbol", "i", "ts", "high", "low", "close", "atr", "entry_px", "entry_off", "long_stop", "long_target", "short_stop", "short_target")


def outcomes(planned: DataFrame, cfg: Config) -> DataFrame:
    """A row for each of planned, for long and short: ret, bars, r, outcome, rr, exit_px.  Bars without a plan: outcome none, held for the horizon.

    Of planned's columns only those that this needs are kept, as all go to Python and back.
    """
    planned = planned.select(*(c for c in PLAN_COLUMNS if c in planned.columns))
    keep = [f for f in planned.schema.fields]
    names = [f.name for f in keep]
    trailing = cfg.exit_mode == "trailing"
    holding = cfg.trailing_max_holding if trailing else cfg.max_holding
    new = [f"{s}_{c} {t}" for s in ("long", "short") for c, t in (("ret", "double"), ("bars", "int"), ("r", "double"), ("outcome", "string"), ("rr", "double"), ("exit_px", "double"))]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)
        a = {c: b[c].to_numpy(float) for c in ("high", "low", "close", "entry_px", "atr")}
        off = b["entry_off"].to_numpy(np.int64)
        at = np.arange(len(b)) + off + 2
        out = b[[*names, "_own"]].copy()
        for side, sign in (("long", 1), ("short", -1)):
            stop, target = b[f"{side}_stop"].to_numpy(float), b[f"{side}_target"].to_numpy(float)
            ok = ~np.isnan(stop)
            code, px, held = _exits(a, at, sign, np.where(ok, stop, a["entry_px"]), None if trailing else np.where(ok, target, a["entry_px"]), cfg.trail_atr_mult, holding)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain, risk = (px - a["entry_px"]) * sign, (a["entry_px"] - stop) * sign
                out[f"{side}_ret"] = np.where(ok, gain / a["entry_px"], 0.0)
                out[f"{side}_bars"] = np.where(ok, np.maximum(held + off + 1, 1), cfg.horizon).astype("int32")
                out[f"{side}_r"] = np.where(ok, gain / risk, 0.0)
                out[f"{side}_outcome"] = np.where(ok, np.array(["timeout", "stop", "target"], object)[code], "none")
                out[f"{side}_rr"] = np.where(ok, (target - a["entry_px"]) * sign / risk, 0.0)
                out[f"{side}_exit_px"] = np.where(ok, px, a["entry_px"])
        return out[out["_own"]].drop(columns="_own")

    types = [f"{f.name} {f.dataType.simpleString()}" for f in keep] + new
    rows = _by_segment(planned, holding + cfg.entry_valid_bars + 8)
    return rows.groupBy("symbol", "_seg").applyInPandas(run, ", ".join(types))


def first_stop(limit: Column, stop: Column, atr: Column, mult: float) -> Column:
    """Stop to show with an order: the plan's, or the trailing distance under the limit if that is nearer."""
    return F.when(atr > 0, F.greatest(stop, limit - mult * atr)).otherwise(stop)


def entry_ticket(planned: DataFrame, mult: float) -> DataFrame:
    """What to show with a long order: symbol, i, limit_price, stop, its source (order block or average range) and the risk as a share of the limit."""
    stop = first_stop(F.col("limit_price"), F.col("long_stop"), F.col("atr"), mult)
    df = planned.where("limit_price IS NOT NULL AND long_stop IS NOT NULL").withColumn("stop", stop)
    source = F.when(F.abs(F.col("stop") - F.col("long_stop")) < 1e-9, "plan").otherwise(f"{mult:g} x ATR")
    return df.select("symbol", "i", "limit_price", "stop", source.alias("stop_source"), ((F.col("limit_price") - F.col("stop")) / F.col("limit_price")).alias("risk_share"))


def described(planned: DataFrame, side: str = "long") -> DataFrame:
    """symbol, i, text: the plan in one line, null without one."""
    e, s, t = F.col("entry_px"), F.col(f"{side}_stop"), F.col(f"{side}_target")
    text = F.format_string(f"{side} at %.2f, stop %.2f, target %.2f, reward to risk %.2f", e, s, t, F.abs(F.try_divide(t - e, e - s)))
    return planned.select("symbol", "i", F.when(s.isNotNull(), text).alias("text"))


def excursions(trades: DataFrame, bars: DataFrame, early: int = 3) -> DataFrame:
    """Worst and best course of each long trade between entry and exit: mae, mfe, bars to them, entry_heat.

    trades: symbol, trade, entry_i, exit_i, entry_px.
    """
    path = trades.withColumn("i", F.explode(F.sequence(F.col("entry_i") + 1, F.col("exit_i")))).join(bars.select("symbol", "i", "high", "low"), ["symbol", "i"])
    path = path.withColumns({
        "j": F.col("i") - F.col("entry_i"), "_a": F.greatest((F.col("entry_px") - F.col("low")) / F.col("entry_px"), F.lit(0.0)),
        "_f": F.greatest((F.col("high") - F.col("entry_px")) / F.col("entry_px"), F.lit(0.0)),
    })
    return path.groupBy("symbol", "trade", "entry_i", "exit_i", "entry_px").agg(
        F.max("_a").alias("mae"), F.max("_f").alias("mfe"),
        F.max(F.struct("_a", (-F.col("j")).alias("n"))).alias("_ma"), F.max(F.struct("_f", (-F.col("j")).alias("n"))).alias("_mf"),
        F.max(F.when(F.col("j") <= early, F.col("_a"))).alias("entry_heat"),
    ).withColumns({"bars_to_mae": -F.col("_ma.n"), "bars_to_mfe": -F.col("_mf.n")}).drop("_ma", "_mf")


def early_heat(trades: DataFrame, bars: DataFrame, early: int = 3) -> DataFrame:
    """symbol, trade, entry_heat: how far below the entry the first bars of a long trade went, as a share of it."""
    first = F.sequence(F.lit(1), F.lit(early))
    path = trades.withColumn("i", F.explode(F.transform(first, lambda j: F.col("entry_i") + j))).where("i <= exit_i").join(bars.select("symbol", "i", "low"), ["symbol", "i"])
    return path.groupBy("symbol", "trade").agg(F.max(F.greatest((F.col("entry_px") - F.col("low")) / F.col("entry_px"), F.lit(0.0))).alias("entry_heat"))
