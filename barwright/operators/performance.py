"""Compounding, drawdown, yearly growth, portfolios and concentration."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .bars import by_symbol, calendar, returns


def equity_curve(trades: DataFrame) -> DataFrame:
    """Running product of 1 + ret over a symbol's trades in order; step 0 is 1.  trades: symbol, side, i, ret (after cost)."""
    w = Window.partitionBy("symbol", "side").orderBy("i")
    steps = trades.select(
        "symbol", "side", F.row_number().over(w).alias("step"),
        F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("equity"),
    )
    return steps.unionByName(trades.select("symbol", "side").distinct().select("symbol", "side", F.lit(0).alias("step"), F.lit(1.0).alias("equity")))


def max_drawdown(curve: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("_d", 1 - F.col(value) / peak).groupBy(*keys).agg(F.max("_d").alias("max_drawdown"))


def cagr(total: Column, years: Column) -> Column:
    return F.when((years > 0) & (total > -1), F.pow(1 + total, 1 / years) - 1)


def buy_and_hold(bars: DataFrame, start: int, bars_per_year: int = 252) -> DataFrame:
    """Total return, drawdown and growth of holding each symbol from bar ``start`` on; fewer than two bars give 0."""
    b = bars.where(F.col("i") >= start)
    total = b.groupBy("symbol").agg(F.count("*").alias("n"), (F.max_by("close", "i") / F.min_by("close", "i") - 1).alias("_t"))
    down = max_drawdown(b, ["symbol"], "i", "close")
    t = F.when(F.col("n") < 2, 0.0).otherwise(F.col("_t"))
    return total.join(down, "symbol").select("symbol", "n", t.alias("total_return"), "max_drawdown", cagr(t, F.col("n") / bars_per_year).alias("cagr"))


def summarize(trades: DataFrame, evaluated: DataFrame, bench: DataFrame, bars_per_year: int = 252) -> DataFrame:
    """By symbol and side: trades, years, return, growth, drawdown, time in market and Calmar ratios, for longs beside holding.

    trades: returns after cost; evaluated: symbol, n_bars; bench: as from
    buy_and_hold.  Shorts have nothing to be held against.
    """
    curve = equity_curve(trades)
    down = max_drawdown(curve, ["symbol", "side"], "step", "equity")
    total = curve.groupBy("symbol", "side").agg((F.max_by("equity", "step") - 1).alias("total_return"), (F.count("*") - 1).alias("n_trades"))
    hold = trades.groupBy("symbol", "side").agg(F.sum("bars").alias("_hold"))
    years = F.col("n_bars") / bars_per_year
    df = total.join(down, ["symbol", "side"]).join(hold, ["symbol", "side"]).join(evaluated, "symbol")
    b = bench.select("symbol", F.lit("bull").alias("side"), F.col("total_return").alias("bh_return"), F.col("max_drawdown").alias("bh_drawdown"))
    df = df.join(b, ["symbol", "side"], "left").withColumn("bh_cagr", cagr(F.col("bh_return"), years))
    df = df.select(
        "symbol", "side", "n_trades", F.round(years, 2).alias("years"), (F.col("n_trades") / years).alias("trades_per_year"), "total_return",
        cagr(F.col("total_return"), years).alias("cagr"), "max_drawdown", (F.col("_hold") / F.col("n_bars")).alias("time_in_market"),
        "bh_return", "bh_cagr", "bh_drawdown", (F.col("total_return") > F.col("bh_return")).alias("beats_bh"), (F.col("total_return") - F.col("bh_return")).alias("excess_vs_bh"),
    )
    calmar = lambda c, d: F.when(F.col("bh_return").isNotNull() & (F.col(d) > 0), F.col(c) / F.col(d))
    df = df.withColumns({"calmar": calmar("cagr", "max_drawdown"), "bh_calmar": calmar("bh_cagr", "bh_drawdown")})
    return df.withColumn("beats_bh_by_calmar", F.col("calmar") > F.col("bh_calmar"))


def equal_weight(bars: DataFrame) -> DataFrame:
    """bar, ts, curve: mean of all symbols' closes over their first, carried forward over missing days."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("_c0"))
    grid = calendar(bars).crossJoin(F.broadcast(first))  # days x symbols, both dimensions
    df = grid.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    x = F.last("close", True).over(Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)) / F.col("_c0")
    return df.withColumn("_x", x).groupBy("bar", "ts").agg(F.avg("_x").alias("curve"))


def standardised(bars: DataFrame, lookback: int = 252, least: int = 30) -> DataFrame:
    """symbol, ts, z over the days that all symbols share, of each symbol's last ``lookback`` returns: less their mean, squares summing to 1.

    Symbols with fewer than ``least`` returns are left out; z is null where
    returns don't vary.
    """
    r = returns(bars)
    w = Window.partitionBy("symbol")
    r = r.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(F.desc("i")))}).where((F.col("_n") >= least) & (F.col("_k") <= lookback))
    symbols = r.agg(F.count_distinct("symbol").alias("_all"))  # one row
    shared = r.groupBy("ts").agg(F.count("*").alias("_m")).join(F.broadcast(symbols), F.col("_m") == F.col("_all")).select("ts")
    d = F.col("ret") - F.avg("ret").over(w)
    r = r.join(shared, "ts").select("symbol", "ts", d.alias("_d")).withColumn("_s", F.sum(F.col("_d") * F.col("_d")).over(w))
    return r.select("symbol", "ts", F.when(F.col("_s") > 0, F.col("_d") / F.sqrt("_s")).alias("z"))


#: Symbols whose returns meet those of as many others in one task.
BLOCK = 256


def correlations(z: DataFrame, at_least: float | None = None) -> DataFrame:
    """a, b, rho of all pairs of symbols of ``standardised``, or of those that correlate by ``at_least``; null where returns don't vary.

    Symbols are dealt into blocks, and a pair of blocks is one product of two
    small matrices, so a symbol's returns are sent once for each block and no
    rows of days are paired.
    """
    spark = z.sparkSession
    rows = written(z.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", F.coalesce("z", F.lit(float("nan"))).alias("z")))), lambda x: x["z"]).alias("z")), "returns")
    blocks = max(-(-rows.count() // BLOCK), 1)
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("symbol", "z", own.alias("own"), other.alias("other")).select("symbol", "z", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def product(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("symbol", ignore_index=True)
        x, y = int(b["x"].iloc[0]), int(b["y"].iloc[0])
        first, second = b[b["own"] == x], b[b["own"] == y]
        if not len(first) or not len(second):
            return pd.DataFrame({"a": np.array([], object), "b": np.array([], object), "rho": np.zeros(0)})
        rho = np.stack(first["z"]) @ np.stack(second["z"]).T
        wanted = np.triu(np.ones(rho.shape, bool), 1) if x == y else np.ones(rho.shape, bool)
        if at_least is not None:
            wanted &= rho >= at_least
        i, j = np.nonzero(wanted)
        p, q = first["symbol"].to_numpy()[i], second["symbol"].to_numpy()[j]
        return pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p), "rho": rho[i, j]}).astype({"a": object, "b": object})

    return dealt.groupBy("x", "y").applyInPandas(product, "a string, b string, rho double")


def effective_number_by_sums(measured: DataFrame, z: DataFrame) -> DataFrame:
    """effective_number without pairs: the sum of the whole correlation matrix is the sum over days of the squared sum of z."""
    own = measured.select("symbol").distinct()
    n = own.agg(F.count("*").alias("n_symbols"))
    z = z.where("z IS NOT NULL").join(own, "symbol", "left_semi")
    days = z.groupBy("ts").agg(F.sum("z").alias("_z"), F.count("*").alias("_m"))
    total = days.agg(F.coalesce(F.sum(F.col("_z") * F.col("_z")), F.lit(0.0)).alias("_q"), F.coalesce(F.max("_m"), F.lit(0)).alias("_m"))
    out = n.join(F.broadcast(total)).withColumns({
        "_s": (F.col("_q") - F.col("_m")) / 2, "mean_rho": F.when(F.col("_m") >= 2, (F.col("_q") - F.col("_m")) / (F.col("_m") * (F.col("_m") - 1))),
    })
    return _effective(out)


def _among(pairs: DataFrame, symbols: DataFrame | None) -> DataFrame:
    if symbols is None:
        return pairs
    s = symbols.select("symbol").distinct()
    return pairs.join(s.withColumnRenamed("symbol", "a"), "a", "left_semi").join(s.withColumnRenamed("symbol", "b"), "b", "left_semi").select("a", "b", "rho")


def effective_number(measured: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_symbols, mean_rho, n_eff and ratio of the measured symbols (column symbol).

    n_eff is n^2 over the sum of the whole correlation matrix, null if that
    isn't positive; of fewer than two symbols it is their number.
    """
    n = measured.select("symbol").distinct().agg(F.count("*").alias("n_symbols"))
    total = _among(pairs, measured).agg(F.coalesce(F.sum("rho"), F.lit(0.0)).alias("_s"), F.avg("rho").alias("mean_rho"))
    return _effective(n.join(F.broadcast(total)))  # a row on either side


def _effective(df: DataFrame) -> DataFrame:
    """From n_symbols, mean_rho and _s, the sum over pairs."""
    whole = F.col("n_symbols") + 2 * F.col("_s")
    eff = F.when(F.col("n_symbols") < 2, F.col("n_symbols").cast("double")).when(whole > 0, F.col("n_symbols") * F.col("n_symbols") / whole)
    out = df.select("n_symbols", "mean_rho", eff.alias("n_eff"))
    return out.withColumn("ratio", F.when(F.col("n_symbols") >= 2, F.col("n_symbols") / F.col("n_eff")))


def concentration_band(ratio: Column) -> Column:
    return F.when(ratio >= 2.5, "high").when(ratio >= 1.6, "medium").otherwise("low")


def signal_concentration(signals: DataFrame, measured: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row on today's signals (column symbol): how many, how many with a correlation, and how many independent ones they amount to.

    measured: the symbols that ``pairs`` was computed over.  ``pairs`` has
    a, b and rho, or is a table of ``standardised``.  The band is null for
    fewer than two measured signals.
    """
    own = signals.select("symbol").distinct()
    seen = own.join(measured.select("symbol").distinct(), "symbol", "left_semi")
    out = (effective_number_by_sums if "z" in pairs.columns else effective_number)(seen, pairs).withColumnRenamed("n_symbols", "n_measured")
    out = out.join(F.broadcast(own.agg(F.count("*").alias("n_signals"))))
    return out.withColumn("band", F.when((F.col("n_measured") >= 2) & F.col("n_eff").isNotNull(), concentration_band(F.col("ratio"))))


def high_pairs(pairs: DataFrame, threshold: float = 0.6, symbols: DataFrame | None = None) -> DataFrame:
    """Of a table of pairs, those that correlate by ``threshold`` or more: two ways to hold much the same."""
    return _among(pairs, symbols).where(F.col("rho") >= threshold)


def slot_fills(signals: DataFrame, days: DataFrame, max_positions: tuple[int, ...], equal_slots: bool = False) -> DataFrame:
    """Which signals get a slot: slots, symbol, bar, exit_bar, ret, capital.

    signals: symbol, ts, score, ret (after cost), bars.  Of a day's signals
    the best as many as there are slots can matter: those held already take a
    slot each.  A scenario's fills follow from one another, so one task goes
    through those signals; only five numbers of each reach it, and no prices.
    """
    scenarios = signals.sparkSession.createDataFrame([(int(n),) for n in max_positions], "slots int")
    best = F.row_number().over(Window.partitionBy("bar").orderBy(F.desc("score"), "symbol"))
    ranked = signals.join(days, "ts").withColumn("rank", best).where(F.col("rank") <= max(max_positions))
    s = ranked.join(F.broadcast(scenarios), F.col("rank") <= F.col("slots"))
    s = s.select("slots", "symbol", "bar", "rank", "ret", F.greatest(F.col("bars"), F.lit(1)).cast("int").alias("hold"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        slots, b = key[0], b.sort_values(["bar", "rank"], ignore_index=True)
        due: list[tuple[int, float]] = []  # heap of exit bars with what comes back
        until: dict[str, int] = {}
        money, out = 1.0, []
        for symbol, bar, ret, hold in zip(b["symbol"], b["bar"].tolist(), b["ret"].tolist(), b["hold"].tolist(), strict=True):
            while due and due[0][0] <= bar:
                money += heapq.heappop(due)[1]
            if len(due) < slots and until.get(symbol, -1) <= bar:
                stake = money / (slots - len(due)) if equal_slots else money / slots
                if stake <= 0:
                    continue
                money -= stake
                until[symbol] = bar + hold
                heapq.heappush(due, (bar + hold, stake * (1 + ret)))
                out.append((slots, symbol, bar, bar + hold, ret, stake))
        return pd.DataFrame(out, columns=["slots", "symbol", "bar", "exit_bar", "ret", "capital"])

    return s.groupBy("slots").applyInPandas(run, "slots int, symbol string, bar int, exit_bar int, ret double, capital double")


def simulate_portfolio(signals: DataFrame, prices: DataFrame, max_positions: tuple[int, ...] = (10, 20), equal_slots: bool = False, side: str = "bull") -> DataFrame:
    """Equity by calendar bar for each number of slots: exits, then entries by score, then valuation at the close.

    A free slot gets capital / max_positions of what is left, or with
    ``equal_slots`` of what all slots hold.  Positions are valued by their
    closes where there are any, else at what they cost; on the last bar all
    are settled.  Only the fills are sequential; cash and values are sums by
    bar over them.
    """
    days = written(calendar(signals.select("ts").unionByName(prices.select("ts")).distinct()), "days")
    fills = written(slot_fills(signals, days, max_positions, equal_slots), "fills")
    end = days.agg(F.max("bar").alias("_last"))
    px = prices.join(days, "ts").select("symbol", "bar", "close")
    own = fills.join(px.select("symbol", "bar", F.col("close").alias("_entry")), ["symbol", "bar"], "left").join(F.broadcast(end))
    back = F.col("capital") * (1 + F.col("ret"))
    moves = fills.select("slots", "bar", (-F.col("capital")).alias("m")).unionByName(
        own.select("slots", F.least("exit_bar", "_last").alias("bar"), back.alias("m"))
    ).groupBy("slots", "bar").agg(F.sum("m").alias("_m"))
    held = own.select("slots", "symbol", "capital", "_entry", F.explode(F.sequence(F.col("bar"), F.least(F.col("exit_bar") - 1, F.col("_last")))).alias("bar"), "_last")
    sign = 1 if side == "bull" else -1
    moved = F.when(F.col("_entry") > 0, sign * (F.col("close") / F.col("_entry") - 1))
    worth = F.when(F.col("bar") < F.col("_last"), F.col("capital") * (1 + F.coalesce(moved, F.lit(0.0)))).otherwise(0.0)
    values = held.join(px, ["symbol", "bar"], "left").groupBy("slots", "bar").agg(F.sum(worth).alias("_v"), F.count("*").alias("n_open"))
    scenarios = signals.sparkSession.createDataFrame([(int(n),) for n in max_positions], "slots int")
    entered = fills.groupBy("slots", "bar").agg(F.count("*").alias("_e"))
    path = days.join(F.broadcast(scenarios))
    for part in (moves, values, entered):
        path = path.join(part, ["slots", "bar"], "left")
    cash = 1 + F.sum(F.coalesce("_m", F.lit(0.0))).over(Window.partitionBy("slots").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    return path.select("slots", "bar", "ts", (cash + F.coalesce("_v", F.lit(0.0))).alias("equity"), *(F.coalesce(c, F.lit(0)).cast("int").alias(n) for c, n in (("n_open", "n_open"), ("_e", "n_entered"))))


def portfolio_stats(equity: DataFrame, bars_per_year: int = 252) -> DataFrame:
    down = max_drawdown(equity, ["slots"], "bar", "equity")
    years = F.count("*") / bars_per_year
    trades = F.sum("n_entered")
    s = equity.groupBy("slots").agg((F.max_by("equity", "bar") - 1).alias("total_return"), years.alias("years"), trades.alias("n_trades"), (trades / years).alias("trades_per_year"), F.avg((F.col("n_open") > 0).cast("double")).alias("time_in_market"))
    s = s.join(down, "slots").withColumn("cagr", cagr(F.col("total_return"), F.col("years")))
    return s.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")))
