"""One report page: banner, key figures, orders, positions, concentration, choices and charts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import performance, tracking, trades
from . import report

#: Width and height of a chart, and the bars it shows.
WIDTH, HEIGHT, SHOWN = 720, 240, 180


def _svg(symbol: str, bars: pd.DataFrame, shapes: pd.DataFrame) -> str:
    """Closes as a line over the ranges of highs and lows; zones as boxes, breaks as lines, longs' side in one class, shorts' in another."""
    first, last = int(bars["i"].min()), int(bars["i"].max())
    low, high = float(bars["low"].min()), float(bars["high"].max())
    x = lambda i: (i - first) / max(last - first, 1) * WIDTH
    y = lambda p: HEIGHT - (min(max(p, low), high) - low) / ((high - low) or 1) * HEIGHT
    parts = []
    for s in shapes.itertuples(index=False):
        a, b, top, bottom = x(max(s.from_i, first)), x(min(s.to_i, last)), y(s.top), y(s.bottom)
        kind = html.escape(f"{s.layer} {s.side}")
        if s.top == s.bottom:
            parts.append(f'<line class="{kind}" x1="{a:.1f}" x2="{b:.1f}" y1="{top:.1f}" y2="{top:.1f}"/>')
        else:
            parts.append(f'<rect class="{kind}" x="{a:.1f}" y="{top:.1f}" width="{max(b - a, 1):.1f}" height="{max(bottom - top, 1):.1f}"/>')
    parts += [f'<line class="range" x1="{x(r.i):.1f}" x2="{x(r.i):.1f}" y1="{y(r.high):.1f}" y2="{y(r.low):.1f}"/>' for r in bars.itertuples(index=False)]
    line = " ".join(f"{x(r.i):.1f},{y(r.close):.1f}" for r in bars.itertuples(index=False))
    return f'<figure><figcaption>{html.escape(symbol)}</figcaption><svg viewBox="0 0 {WIDTH} {HEIGHT}">{"".join(parts)}<polyline class="close" points="{line}"/></svg></figure>'


def charts(m, n: int = SHOWN) -> DataFrame:
    """symbol, svg: each symbol's last n bars with what stands open in them, drawn where the bars are."""
    bars = report.visible(m.bars, n).select("symbol", "i", "high", "low", "close")
    shapes = report.chart_shapes(m, n).withColumnRenamed("symbol", "of")

    def draw(b: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame({"symbol": pd.Series([], dtype=object), "svg": pd.Series([], dtype=object)})
        symbol = b["symbol"].iloc[0]
        order = ["layer", "from_i", "to_i", "bottom"]
        return pd.DataFrame([(symbol, _svg(symbol, b.sort_values("i"), s.sort_values(order)))], columns=["symbol", "svg"])

    return bars.groupBy("symbol").cogroup(shapes.groupBy("of")).applyInPandas(draw, "symbol string, svg string")


def orders(m, picks: DataFrame, mult: float = 5.0) -> DataFrame:
    """symbol, score, threshold, confidence, limit, stop, source and risk of what scores over its own threshold at a symbol's last bar, best first."""
    last = m.bars.groupBy("symbol").agg(F.max("i").alias("i"))
    score = m.scores.select("symbol", "i", F.col("bull_score").alias("score")).join(last, ["symbol", "i"])
    own = picks.where("side = 'bull'").select("symbol", "threshold", "confidence")
    due = score.join(own, "symbol").where("score >= threshold")
    ticket = trades.entry_ticket(m.planned, mult)
    return due.join(ticket, ["symbol", "i"], "left").select("symbol", "score", "threshold", "confidence", "limit_price", "stop", "stop_source", "risk_share").orderBy(F.desc("score"), "symbol")


def banner(n_orders: int, kpis: dict | None) -> str:
    """What to do today, the gravest first."""
    broken = int((kpis or {}).get("n_breached") or 0)
    if broken:
        return f'<p class="banner poor">{broken} positions are through their stop</p>'
    return f'<p class="banner good">{n_orders} orders to place</p>' if n_orders else '<p class="banner plain">nothing to do</p>'


KPIS = {"n_positions": "positions", "n_locked_in": "can't lose", "n_breached": "through the stop", "mean_unrealized": "mean result %", "mean_unrealized_r": "mean result in R", "nearest_stop": "nearest stop %"}
SPREAD = {"n_signals": "signals", "n_measured": "measured", "mean_rho": "mean correlation", "n_eff": "worth so many", "ratio": "ratio", "band": "concentration"}


def compose(title: str, m, picks: DataFrame, positions: DataFrame, z: DataFrame, most: int = 50) -> str:
    """The page as text.  m: a market; picks: recommended thresholds; positions: symbol, entry_date, entry_price, stop; z: standardised returns.

    Tables and charts show at most ``most`` symbols, orders' first; what is
    collected is what is shown.
    """
    tracked = tracking.track_positions(positions, m.ind)
    kpis = tracking.position_kpis(tracked).first().asDict()
    due = orders(m, picks).limit(most).toPandas()
    signals = m.bars.sparkSession.createDataFrame([(s,) for s in due["symbol"]], "symbol string")
    spread = performance.signal_concentration(signals, z, z).first().asDict() if len(due) > 1 else None
    pairs = performance.high_pairs(performance.correlations(z, 0.6), 0.6, signals).orderBy(F.desc("rho"), "a", "b").limit(5)
    without = tracking.untracked(positions, m.bars).select("symbol")
    first = F.when(F.col("symbol").isin([*due["symbol"]]), 0).otherwise(1)
    drawn = charts(m).orderBy(first, "symbol").limit(most).collect()
    sections = [
        banner(len(due), kpis),
        report.fragment("Positions", kpis, KPIS),
        report.html_table("Orders", m.bars.sparkSession.createDataFrame(due, "symbol string, score int, threshold int, confidence string, limit_price double, stop double, stop_source string, risk_share double"), most),
        report.html_table("Open positions", tracked.select("symbol", "entry_price", "last", "stop", "unrealized", "locked_in", "breached").orderBy(F.desc("breached"), "symbol"), most),
        report.html_table("Positions without bars", without.orderBy("symbol"), most),
        report.fragment("Concentration", spread, SPREAD),
        report.html_table("Much the same", pairs, 5),
        report.html_table("Thresholds", picks.select("symbol", "side", "threshold", F.coalesce(report.labelled(F.col("confidence"))["label"], "confidence").alias("edge"), "n", "expectancy", "expectancy_lb").orderBy("symbol", "side"), 2 * most),
        "<section><h2>Charts</h2>" + "".join(r.svg for r in drawn) + "</section>",
    ]
    return report.html_page(title, sections)
