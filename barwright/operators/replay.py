"""Replay of the score over history, threshold statistics and the choice of a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resample import mean_bounds
from ..functions.stats import sidak, wilson_lower, z_of
from ..plans.config import Config
from ..sources.scratch import written
from . import asof, indicators, structure, trades
from .bars import horizon_returns


class Market:
    """Everything derived from one table of bars, each made once when asked for."""

    def __init__(self, bars: DataFrame, cfg: Config | None = None):
        self.bars, self.cfg, self._made = bars, cfg or Config(), {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def ind(self) -> DataFrame:
        return self._once("ind", lambda: indicators.compute(self.bars))

    @property
    def swings(self) -> DataFrame:
        return self._once("swings", lambda: structure.swings(self.bars, self.cfg.swing_lookback))

    @property
    def events(self) -> DataFrame:
        return self._once("events", lambda: structure.structure_events(self.bars, self.swings))

    @property
    def order_blocks(self) -> DataFrame:
        return self._once("obs", lambda: structure.order_blocks(self.bars, self.events))

    @property
    def gaps(self) -> DataFrame:
        return self._once("gaps", lambda: structure.price_gaps(self.ind, self.cfg.gap_min_share, self.cfg.gap_min_atr))

    @property
    def pools(self) -> DataFrame:
        return self._once("pools", lambda: structure.liquidity_pools(self.bars, self.swings, self.cfg.equal_tolerance))

    @property
    def zones(self) -> DataFrame:
        return self._once("zones", lambda: structure.zones(self.bars, self.swings))

    @property
    def ml(self) -> DataFrame | None:
        """What a model retrained along the way says at each evaluated bar, if the parameters ask for one."""
        from ..plans import models

        cfg = self.cfg
        make = lambda: written(models.replayed_probability(self.ind, cfg.horizon, max(cfg.warmup, 30), cfg.ml_retrain_every, least_rows=cfg.ml_min_train_rows), "ml")
        return self._once("ml", make) if cfg.ml_enabled else None

    @property
    def scores(self) -> DataFrame:
        def make():
            c = asof.components(self.ind, self.zones, self.order_blocks, self.gaps, self.events, self.pools, self.cfg.recent_bars, self.cfg.adx_threshold, self.ml)
            return asof.scores(c, self.cfg.weights)

        return self._once("scores", make)

    @property
    def planned(self) -> DataFrame:
        return self._once("planned", lambda: trades.plans(trades.entry_fill(self.ind, self.cfg), self.order_blocks, self.pools, self.cfg))

    def keep(self) -> "Market":
        """Writes the shared tables, which a score reads several times each."""
        for name, key in (("ind", "ind"), ("swings", "swings"), ("events", "events"), ("order_blocks", "obs"), ("gaps", "gaps"), ("pools", "pools")):
            self._made[key] = written(getattr(self, name), name)
        return self

    def replay(self) -> DataFrame:
        """A row for each evaluated bar: scores, what the next bars brought, and both sides' simulated trades."""
        cfg = self.cfg
        out = trades.outcomes(self.planned, cfg)
        ahead = horizon_returns(self.bars, cfg.horizon).select("symbol", "i", "future_return").where("future_return IS NOT NULL")
        cols = [f"{s}_{c}" for s in ("long", "short") for c in ("ret", "bars", "r", "outcome", "rr", "exit_px")]
        return (
            out.select("symbol", "i", "ts", "entry_px", "entry_off", *cols)
            .join(self.scores.select("symbol", "i", "bull_score", "bear_score"), ["symbol", "i"])
            .join(ahead, ["symbol", "i"])
            .where(F.col("i") >= max(cfg.warmup, 30))
        )


def _free_signals(at: np.ndarray, hold: np.ndarray) -> np.ndarray:
    """Of signals in order, those met by going on from each to the first after its last bar."""
    after, out, k = np.searchsorted(at, at + np.maximum(hold, 1)).tolist(), [], 0
    while k < len(after):
        out.append(k)
        k = after[k]
    return np.array(out, np.int64)


def one_at_a_time(signals: DataFrame, keys: list[str], thresholds: tuple[int, ...] | None = None) -> DataFrame:
    """Signals taken one after the other, the next not before the last one's final bar; needs i and bars.

    The chain of a group (a symbol's signals of one side) goes from trade to
    trade in one task.  With ``thresholds`` each of them has a chain of its
    own over the signals that score as much, and the result a column
    threshold.
    """
    fields = signals.schema.fields
    names = [f.name for f in fields]
    types = [f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["threshold int"] * bool(thresholds)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)[names]
        parts = []
        for t in thresholds or (None,):
            own = b if t is None else b[b["score"] >= t]
            took = own.iloc[_free_signals(own["i"].to_numpy(np.int64), own["bars"].to_numpy(np.int64))]
            parts.append(took if t is None else took.assign(threshold=np.int32(t)))
        return pd.concat(parts)

    return signals.groupBy(*keys).applyInPandas(run, ", ".join(types))


def sides(wf: DataFrame, hold: int = 5) -> DataFrame:
    """wf in long form: symbol, side, i, ts, entry_off, score, ret, bars, r, outcome.

    A table without simulated trades is read as entries at the close that are
    held for ``hold`` bars.
    """
    if "long_ret" not in wf.columns:
        none = {"entry_off": F.lit(-1), "outcome": F.lit("none"), "r": F.lit(None).cast("double"), "bars": F.lit(hold)}
        wf = wf.withColumns({f"{s}_{c}" if c != "entry_off" else c: v for s in ("long", "short") for c, v in none.items()})
        wf = wf.withColumns({"long_ret": F.col("future_return"), "short_ret": -F.col("future_return")})
    long = wf.select("symbol", F.lit("bull").alias("side"), "i", "ts", "entry_off", F.col("bull_score").alias("score"), F.col("long_ret").alias("ret"), F.col("long_bars").alias("bars"), F.col("long_r").alias("r"), F.col("long_outcome").alias("outcome"))
    short = wf.select("symbol", F.lit("bear").alias("side"), "i", "ts", "entry_off", F.col("bear_score").alias("score"), F.col("short_ret").alias("ret"), F.col("short_bars").alias("bars"), F.col("short_r").alias("r"), F.col("short_outcome").alias("outcome"))
    return long.unionByName(short)


def taken_trades(wf: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Non-overlapping trades of every symbol, side and threshold; threshold -1 takes every bar."""
    signals = sides(wf).select("symbol", "side", "i", "ts", "entry_off", "score", "ret", "bars", "r", "outcome")
    return one_at_a_time(signals, ["symbol", "side"], (-1, *thresholds))


def summary_columns(ret: Column, cost: Column, z: float) -> list[Column]:
    """Aggregates of returns after cost."""
    net = ret - cost
    win = net > 0
    n, wins = F.count("*"), F.count_if(win)
    aw, al = F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)), F.coalesce(F.avg(F.when(~win, net)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(~win, net)), F.lit(0.0)))
    return [
        n.alias("n"), wins.alias("wins"), (wins / n).alias("win_rate"), wilson_lower(wins, n, z).alias("win_rate_lb"), F.avg(net).alias("expectancy"),
        aw.alias("avg_win"), al.alias("avg_loss"), F.abs(F.try_divide(aw, al)).alias("payoff"),
        F.try_divide(F.coalesce(F.sum(F.when(win, net)), F.lit(0.0)), loss).alias("profit_factor"),
    ]


def threshold_sweep(taken: DataFrame, costs: DataFrame, cfg: Config) -> DataFrame:
    """Statistics by symbol, side and threshold, the excess over taking every bar, and the bootstrap lower bound of the mean.

    costs: symbol, cost.  Both bounds are for all thresholds together.
    """
    level = sidak(cfg.alpha, len(cfg.thresholds))
    t = taken.join(costs, "symbol")
    stats = t.groupBy("symbol", "side", "threshold").agg(
        *summary_columns(F.col("ret"), F.col("cost"), z_of(level)), F.avg("bars").alias("avg_bars_held"), F.avg("r").alias("avg_r")
    )
    bounds = bootstrap_bounds(taken.where("threshold >= 0"), costs, level).select("symbol", "side", "threshold", F.col("mean_lb").alias("expectancy_lb"))
    stats = stats.join(bounds, ["symbol", "side", "threshold"], "left")
    base = stats.where("threshold = -1").select("symbol", "side", F.col("expectancy").alias("_base"))
    return stats.where("threshold >= 0").join(base, ["symbol", "side"], "left").withColumn("excess_expectancy", F.col("expectancy") - F.col("_base")).drop("_base")


def sweep_totals(taken: DataFrame, costs: DataFrame) -> DataFrame:
    """The sweep's figures for each symbol, side and threshold, for all symbols of a side and threshold, for a threshold, for a symbol and side, and for all.

    level says over what a row is summed (bits: symbol 4, side 2, threshold
    1), so that totals and keys that are null can be told apart.  All come
    from the same sums of counts, returns and squares.
    """
    t = taken.where("threshold >= 0").join(costs, "symbol").withColumn("_net", F.col("ret") - F.col("cost"))
    keys = ("symbol", "side", "threshold")
    s = t.groupingSets([keys, ("side", "threshold"), ("threshold",), ("symbol", "side"), ()], *keys).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("_net") > 0).alias("wins"),
        F.sum("_net").alias("_s"), F.sum(F.col("_net") * F.col("_net")).alias("_q"),
    )
    n = F.col("n")
    spread = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    return s.where("n > 0").select(
        *keys, "level", "n", "wins", (F.col("wins") / n).alias("win_rate"), (F.col("_s") / n).alias("expectancy"), F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("deviation")
    )


def base_rate(taken: DataFrame, costs: DataFrame, cfg: Config) -> DataFrame:
    """Statistics of taking every bar, without the correction for many thresholds."""
    every = taken.where("threshold = -1")
    stats = every.join(costs, "symbol").groupBy("symbol", "side").agg(*summary_columns(F.col("ret"), F.col("cost"), z_of(cfg.alpha)))
    bounds = bootstrap_bounds(every, costs, cfg.alpha).select("symbol", "side", F.col("mean_lb").alias("expectancy_lb"))
    return stats.join(bounds, ["symbol", "side"])


def recommend(stats: DataFrame, cfg: Config) -> DataFrame:
    """By symbol and side: lowest threshold whose bound is over 0, else that of the best bound, else the default with n = 0."""
    able = (F.col("n") >= cfg.min_trades) & F.col("expectancy_lb").isNotNull()
    row = F.struct("threshold", "n", "expectancy", "expectancy_lb", "excess_expectancy")
    r = stats.groupBy("symbol", "side").agg(
        F.min_by(row, F.when(able & (F.col("expectancy_lb") > 0), F.col("threshold"))).alias("_ok"),
        F.max_by(row, F.when(able, F.struct("expectancy_lb", (-F.col("threshold")).alias("t")))).alias("_best"),
    )
    pick = F.coalesce("_ok", "_best")
    return r.select(
        "symbol", "side", F.coalesce(pick.getField("threshold"), F.lit(cfg.default_threshold)).alias("threshold"),
        F.when(F.col("_ok").isNotNull(), "ok").when(F.col("_best").isNotNull(), "no_edge").otherwise("insufficient_data").alias("confidence"),
        F.coalesce(pick.getField("n"), F.lit(0)).alias("n"), *(pick.getField(c).alias(c) for c in ("expectancy", "expectancy_lb", "excess_expectancy")),
    )


def bootstrap_bounds(taken: DataFrame, costs: DataFrame, alpha: float, resamples: int = 2000, least: int = 2) -> DataFrame:
    """symbol, side, threshold, n, mean_lb: lower bound of the mean return after cost by resampling; null under ``least`` trades."""
    t = taken.join(costs, "symbol")
    return mean_bounds(t, ["symbol", "side", "threshold"], "i", F.col("ret") - F.col("cost"), alpha, resamples, least)


def selected_trades(wf: DataFrame, taken: DataFrame, picks: DataFrame, costs: DataFrame, side: str = "bull") -> DataFrame:
    """Trades of the recommended thresholds with their entry and exit bars, both within the evaluated bars."""
    last = wf.groupBy("symbol").agg(F.max("i").alias("_last"))
    t = taken.where(F.col("side") == side).join(picks.where(F.col("side") == side).select("symbol", "threshold"), ["symbol", "threshold"])
    t = t.join(costs, "symbol").join(last, "symbol")
    return t.select(
        "symbol", "side", "i", "threshold", "score", F.least(F.col("i") + F.col("entry_off") + 1, F.col("_last")).alias("entry_i"),
        F.least(F.col("i") + F.col("bars"), F.col("_last")).alias("exit_i"), (F.col("ret") - F.col("cost")).alias("ret"), "bars", "outcome",
    )
