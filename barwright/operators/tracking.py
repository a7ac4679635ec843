"""Open positions, alert de-duplication, position sizing and trade review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import kelly, wilson_lower
from .bars import by_symbol
from .structure import first_touch


def track_positions(positions: DataFrame, ind: DataFrame, mult: float = 5.0) -> DataFrame:
    """Trailing stop of each position from its entry day on, by the latest average range."""
    at = F.to_timestamp_ntz(F.col("entry_date").cast("string"))
    p = positions.select("symbol", at.alias("entry_ts"), "entry_price", *([F.col("stop").alias("_given")] if "stop" in positions.columns else [F.lit(None).cast("double").alias("_given")]))
    since = p.join(ind.select("symbol", "ts", "high", "close", "atr"), "symbol").where(F.col("ts") >= F.col("entry_ts"))
    t = since.groupBy("symbol", "entry_ts", "entry_price", "_given").agg(
        F.max("high").alias("peak"), F.max_by("close", "ts").alias("last"), F.max_by("atr", "ts").alias("atr"), F.count("*").alias("n_bars")
    )
    first = F.coalesce("_given", F.col("entry_price") - mult * F.col("atr"))
    stop = F.when(F.col("atr") > 0, F.greatest(first, F.col("peak") - mult * F.col("atr"))).otherwise(first)
    risk = F.col("entry_price") - first
    return t.select(
        "symbol", "entry_ts", "entry_price", "n_bars", "peak", "last", first.alias("initial_stop"), stop.alias("stop"),
        (stop >= F.col("entry_price")).alias("locked_in"), (F.col("last") <= stop).alias("breached"),
        (F.col("last") / F.col("entry_price") - 1).alias("unrealized"), F.when(risk > 0, (F.col("last") - F.col("entry_price")) / risk).alias("unrealized_r"),
        F.when(F.col("last") > 0, (F.col("last") - stop) / F.col("last")).alias("stop_distance"),
    )


def position_kpis(tracked: DataFrame) -> DataFrame:
    """One row: how many positions, how many can no longer lose, how many are through their stop, mean result and nearest stop."""
    return tracked.agg(
        F.count("*").alias("n_positions"), F.count_if("locked_in").alias("n_locked_in"), F.count_if("breached").alias("n_breached"),
        F.avg("unrealized").alias("mean_unrealized"), F.avg("unrealized_r").alias("mean_unrealized_r"), F.min("stop_distance").alias("nearest_stop"),
    )


def untracked(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions whose symbol has no bars."""
    return positions.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def dedup_alerts(alerts: DataFrame, state: DataFrame, now: str, days: float = 5, jump: float = 15) -> DataFrame:
    """Alerts that weren't sent lately, or whose score has moved; an unreadable time counts as long ago."""
    old = state.select("symbol", "side", F.try_to_timestamp("at").alias("_at"), F.col("score").alias("_score"))
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("_at")) / 86_400
    muted = F.col("_at").isNotNull() & (age < days) & (F.abs(F.col("score") - F.col("_score")) < jump)
    return alerts.join(old, ["symbol", "side"], "left").where(~F.coalesce(muted, F.lit(False))).drop("_at", "_score")


def merge_state(state: DataFrame, sent: DataFrame, now: str) -> DataFrame:
    """State after sending: sent alerts replace their (symbol, side)."""
    new = sent.select("symbol", "side", F.lit(now).alias("at"), F.col("score").cast("double").alias("score"), F.col("threshold").cast("int").alias("threshold"))
    return state.join(new.select("symbol", "side"), ["symbol", "side"], "left_anti").select(*new.columns).unionByName(new)


def described(tracked: DataFrame) -> DataFrame:
    """symbol, text: a tracked position in one line."""
    text = F.concat(
        F.format_string("%s: stop %.2f", "symbol", "stop"), F.when(F.col("locked_in"), " (can't lose)").otherwise(""),
        F.format_string(", last %.2f (%+.1f%%)", "last", 100 * F.col("unrealized")),
        F.when(F.col("stop_distance").isNotNull(), F.format_string(", %.1f%% above the stop", 100 * F.col("stop_distance"))).otherwise(""),
        F.when(F.col("breached"), ", through its stop").otherwise(""),
    )
    return tracked.select("symbol", text.alias("text"))


def described_sizes(sizes: DataFrame) -> DataFrame:
    """symbol, text: a suggested size in one line."""
    why = F.create_map(*(F.lit(x) for kv in {"few_samples": "too few samples", "below_break_even": "no better than chance at this reward", "capped": "at the limit", "kelly": "a part of the Kelly fraction"}.items() for x in kv))
    return sizes.select("symbol", F.format_string("%s: %.1f%% of capital, %s (%d of %d)", "symbol", 100 * F.col("fraction"), why[F.col("reason")], "wins", "n").alias("text"))


def barrier_outcomes(ind: DataFrame, rr: float = 2.0, risk_atr: float = 1.5, holding: int = 20, warmup: int = 250) -> DataFrame:
    """Every eligible bar as a long entry: which of stop and target comes first, the stop first on one bar."""
    n = F.max("i").over(by_symbol().rowsBetween(-(2**31 - 1), 2**31 - 1))
    e = ind.withColumn("_n", n).where((F.col("i") >= warmup) & (F.col("i") < F.col("_n") - 1 - holding) & (F.col("atr") > 0))
    risk = risk_atr * F.col("atr")
    return _barriers(e.select("symbol", "i", (F.col("close") - risk).alias("stop"), (F.col("close") + rr * risk).alias("target")), ind, holding)


def _barriers(entries: DataFrame, bars: DataFrame, holding: int) -> DataFrame:
    """symbol, i, outcome of entries with stop and target, which are looked up, not walked to."""
    none = F.lit(None).cast("double")
    met = first_touch(first_touch(entries, bars, "i", F.col("stop"), none, "stop_i"), bars, "i", none, F.col("target"), "target_i")
    end = F.col("i") + holding
    stopped, won = F.col("stop_i") <= end, F.col("target_i") <= end
    out = F.when(stopped & (~F.coalesce(won, F.lit(False)) | (F.col("stop_i") <= F.col("target_i"))), "stop").when(won, "target").otherwise("timeout")
    return met.select("symbol", "i", out.alias("outcome"))


def random_barriers(bars: DataFrame, risks: DataFrame, draws: int = 400, seed: int = 42, rr: float = 2.0, holding: int = 250, warmup: int = 250) -> DataFrame:
    """symbol, i, outcome of entries at random bars, with risk shares drawn from those of real trades (risks: symbol, risk).

    A draw's bar and its place among the symbol's risks, in order, are two
    numbers of the MD5 of symbol, seed and draw, so any engine can draw the
    same.  Draws are with replacement; a symbol without room or risks has
    none.
    """
    room = bars.groupBy("symbol").agg((F.max("i") + 1 - holding - 2 - warmup).alias("_room")).where("_room > 0")
    place = Window.partitionBy("symbol").orderBy("risk")
    held = risks.where("risk > 0").select("symbol", "risk", (F.row_number().over(place) - 1).cast("long").alias("_place"))
    sizes = held.groupBy("symbol").agg(F.count("*").alias("_many"))
    drawn = room.join(sizes, "symbol").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    mark = F.md5(F.concat_ws(":", "symbol", F.lit(seed), "draw"))
    number = lambda at: F.conv(F.substring(mark, at, 8), 16, 10).cast("long")
    drawn = drawn.select("symbol", "draw", (warmup + F.pmod(number(1), F.col("_room"))).cast("int").alias("i"), F.pmod(number(9), F.col("_many")).alias("_place"))
    drawn = drawn.join(held, ["symbol", "_place"])
    e = drawn.join(bars.select("symbol", "i", "close"), ["symbol", "i"]).where("close > 0")
    e = e.select("symbol", "draw", "i", (F.col("close") * (1 - F.col("risk"))).alias("stop"), (F.col("close") * (1 + rr * F.col("risk"))).alias("target"))
    return _barriers(e, bars, holding)


def barrier_stats(outcomes: DataFrame) -> DataFrame:
    wins, n = F.count_if(F.col("outcome") == "target"), F.count_if(F.col("outcome") != "timeout")
    return outcomes.groupBy("symbol").agg(wins.alias("wins"), n.alias("n"), (F.count_if(F.col("outcome") == "timeout") / F.count("*")).alias("timeout_rate"))


def suggest_size(stats: DataFrame, rr: float = 2.0, divisor: float = 4.0, cap: float = 0.2, least: int = 100) -> DataFrame:
    """Fraction of capital: a part of the Kelly fraction at the lower bound of the winning chance, if that beats break-even."""
    p = wilson_lower(F.col("wins"), F.col("n"))
    full = kelly(p, F.lit(rr))
    few, poor = F.col("n") < least, p <= 1 / (1 + rr)
    return stats.withColumns({
        "p_lower": p, "kelly_full": F.when(~few, full),
        "fraction": F.when(few | poor | p.isNull(), 0.0).otherwise(F.least(full / divisor, F.lit(cap))),
        "reason": F.when(few, "few_samples").when(poor, "below_break_even").when(full / divisor > cap, "capped").otherwise("kelly"),
    })


def review(trades: DataFrame) -> DataFrame:
    """One row: medians of the excursions, outcome mix, how much of the best course was kept.

    trades: ret, outcome, mae, mfe, mae_r, entry_heat.
    """
    win, lose = F.col("ret") > 0, F.col("ret") <= 0
    med = lambda c, cond=None, q=0.5: F.percentile(F.when(cond, F.col(c)) if cond is not None else F.col(c), q)
    mix = {o: F.avg((F.col("outcome") == o).cast("double")).alias(f"share_{o}") for o in ("stop", "target", "timeout")}
    return trades.agg(
        F.count("*").alias("n_trades"), F.avg(win.cast("double")).alias("win_rate"), F.avg("ret").alias("avg_ret"), *mix.values(),
        med("mae", win).alias("winner_mae_median"), med("mae", win, 0.9).alias("winner_mae_p90"), med("mae_r", win).alias("winner_mae_r_median"),
        med("mfe", lose).alias("loser_mfe_median"), F.avg(F.when(lose, (F.col("mfe") > 0.01).cast("double"))).alias("loser_ever_profitable"),
        F.when(F.sum("mfe") > 0, F.sum("ret") / F.sum("mfe")).alias("mfe_capture"),
        F.percentile(F.try_divide(F.col("ret"), F.nullif("mfe", F.lit(0.0))), 0.5).alias("mfe_capture_median_ratio"),
        med("mfe").alias("median_mfe"), med("ret").alias("median_realized"), med("entry_heat").alias("entry_heat_median"),
        F.avg((F.col("entry_heat") > 0.01).cast("double")).alias("immediately_underwater"),
    )


#: The medians and shares that findings begin at, and how far from chance an entry is told from it.
TIGHT, WIDE, GIVES_BACK, KEEPS, TURNED, ALL_STOPS, TOO_FAR, STOPPED, FROM_CHANCE = 0.35, 0.7, 0.35, 0.6, 0.5, 0.9, 0.6, 0.45, 0.08


def diagnose(summary: DataFrame, exit_mode: str = "fixed", baseline: Column | None = None) -> DataFrame:
    """Findings as an array of names, from the row that ``review`` gives; baseline: share underwater of random entries."""
    c = F.col
    found = [
        F.when(c("winner_mae_r_median") < TIGHT, "stop_can_tighten").when(c("winner_mae_r_median") > WIDE, "stop_too_tight"),
        F.when(c("mfe_capture") < GIVES_BACK, "exit_gives_back").when(c("mfe_capture") > KEEPS, "exit_efficient"),
        F.when(c("loser_ever_profitable") > TURNED, "exit_too_late"),
    ]
    under = c("immediately_underwater")
    if baseline is None:
        found.append(F.when(under.isNotNull(), "entry_without_baseline"))
    else:
        found.append(F.when(under.isNotNull() & baseline.isNull(), "entry_without_baseline"))
        found.append(F.when(under - baseline > FROM_CHANCE, "entry_chases").when(under - baseline < -FROM_CHANCE, "entry_better_than_random").when(under.isNotNull() & baseline.isNotNull(), "entry_like_random"))
    if exit_mode == "trailing":
        found.append(F.when(c("share_stop") > ALL_STOPS, "trailing_stops_normal"))
    else:
        found += [F.when(c("share_timeout") > TOO_FAR, "target_too_far"), F.when(c("share_stop") > STOPPED, "stopped_often")]
    return summary.withColumn("findings", F.array_compact(F.array(*found)))
