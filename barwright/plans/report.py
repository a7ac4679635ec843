"""Data behind reports: chart layers, cross-section, marks, and a plain HTML page."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bars import by_symbol


def visible(bars: DataFrame, n: int = 180) -> DataFrame:
    """A symbol's last n bars."""
    last = bars.groupBy("symbol").agg(F.max("i").alias("_last"))
    return bars.join(last, "symbol").where(F.col("i") > F.col("_last") - n).drop("_last")


def chart_shapes(m, n: int = 180) -> DataFrame:
    """Rectangles and lines to draw over the last n bars: layer, from and to bar, bottom, top, side."""
    window = visible(m.bars, n).groupBy("symbol").agg(F.min("i").alias("_from"), F.max("i").alias("_to"))
    obs = m.order_blocks.where("mitigated_i IS NULL").select("symbol", F.lit("order_block").alias("layer"), F.col("start_i").alias("a"), F.lit(None).cast("int").alias("b"), "bottom", "top", "side")
    gaps = m.gaps.where("filled_i IS NULL").select("symbol", F.lit("gap"), "start_i", F.lit(None).cast("int"), "bottom", "top", "side")
    ev = m.events.select("symbol", F.lower("type"), "broken_i", "i", "broken_level", "broken_level", "side")
    shapes = obs.union(gaps).union(ev).join(window, "symbol").where(F.col("a") >= F.col("_from"))
    return shapes.select("symbol", "layer", F.col("a").alias("from_i"), F.coalesce("b", "_to").alias("to_i"), "bottom", "top", "side")


def chart_panels(m, n: int = 180) -> DataFrame:
    """Values to draw bar by bar over the last n bars, in long form: symbol, i, panel (price, zone, rsi, macd), series, value."""
    shown = visible(m.ind, n)
    price = {("price", c): F.col(c) for c in ("open", "high", "low", "close", "ema20", "ema50", "ema200")}
    more = {("rsi", "rsi"): F.col("rsi")} | {("macd", c): F.col(f"macd_{c}") for c in ("line", "signal", "hist")}
    long = lambda df, cols: df.select("symbol", "i", F.explode(F.array(*(F.struct(F.lit(p).alias("panel"), F.lit(s).alias("series"), c.cast("double").alias("value")) for (p, s), c in cols.items()))).alias("x")).select("symbol", "i", "x.*")
    zone = m.zones.join(shown.select("symbol", "i"), ["symbol", "i"], "left_semi")
    return long(shown, price | more).unionByName(long(zone, {("zone", c): F.col(c) for c in ("top", "mid", "bottom")}))


def trade_markers(trades: DataFrame, bars: DataFrame, n: int = 180) -> DataFrame:
    """Entry and exit points of trades whose entry is visible; exits are kept within the chart."""
    shown = visible(bars, n)
    last = shown.groupBy("symbol").agg(F.max("i").alias("_last"))
    t = trades.join(shown.select("symbol", F.col("i").alias("entry_i"), F.col("close").alias("_ec")), ["symbol", "entry_i"]).join(last, "symbol")
    t = t.withColumn("exit_i", F.least("exit_i", "_last")).join(shown.select("symbol", F.col("i").alias("exit_i"), F.col("close").alias("_xc")), ["symbol", "exit_i"])
    return t.select("symbol", "entry_i", "exit_i", F.coalesce("entry_px", "_ec").alias("entry_px"), F.coalesce("exit_px", "_xc").alias("exit_px"), "ret")


def cross_section(picks: DataFrame) -> DataFrame:
    """By side, over the symbols with a result: how many have a proven edge, the middle of their expectancies and of their excess over every bar."""
    ok = F.col("confidence") == "ok"
    return picks.where("expectancy IS NOT NULL").groupBy("side").agg(
        F.count("*").alias("n_evaluated"), F.count_if(ok).alias("n_proven"), F.avg(ok.cast("double")).alias("share_proven"),
        F.percentile("expectancy", 0.5).alias("median_expectancy"), F.avg("expectancy").alias("mean_expectancy"),
        F.avg((F.col("expectancy") > 0).cast("double")).alias("share_positive"), F.percentile("excess_expectancy", 0.5).alias("median_excess"),
        F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("symbol")))), ",").alias("proven"),
    )


def mark_to_market(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Last close of each position's symbol, its book value without one."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "i").alias("_c"))
    return positions.join(last, "symbol", "left").select("symbol", F.round("entry_price", 6).alias("entry_price"), F.round(F.coalesce("_c", "entry_price"), 6).alias("mark"), F.col("_c").isNotNull().alias("priced"))


def daily_change(bars: DataFrame) -> DataFrame:
    """Last close and its change in per cent, null without an earlier bar."""
    before = bars.withColumn("_p", F.lag("close").over(by_symbol()))
    return before.groupBy("symbol").agg(F.max_by("close", "i").alias("last"), F.max_by("_p", "i").alias("_p")).select("symbol", "last", ((F.col("last") - F.col("_p")) / F.col("_p") * 100).alias("change_pct"))


#: What is shown for a status, a zone and a confidence, and the class it is drawn in.
LABELS = {
    "ok": ("proven", "good"), "no_edge": ("no edge", "poor"), "insufficient_data": ("too few trades", "plain"),
    "premium": ("premium", "dear"), "discount": ("discount", "cheap"), "equilibrium": ("middle", "plain"),
    "high": ("high", "poor"), "medium": ("medium", "plain"), "low": ("low", "good"),
}


def label(status: str) -> str:
    return LABELS.get(status, (status, ""))[0]


def labelled(c: Column) -> Column:
    """Struct of label and class of a status column; what isn't listed is shown as it is."""
    out = F.struct(c.alias("label"), F.lit("").alias("class"))
    for k, (name, kind) in LABELS.items():
        out = F.when(c == k, F.struct(F.lit(name).alias("label"), F.lit(kind).alias("class"))).otherwise(out)
    return out


def badge(status: str) -> str:
    name, kind = LABELS.get(status, (status, ""))
    return f'<span class="{html.escape(kind)}">{html.escape(name)}</span>'


def score_bar(score: float, threshold: float) -> str:
    """A bar as long as the score, of 100 at most; over the threshold it stands out."""
    width = min(max(float(score), 0.0), 100.0)
    return f'<div class="bar{" on" if score >= threshold else ""}" style="width:{width:g}%">{score:g}</div>'


def fragment(title: str, row: dict | None, shown: dict[str, str]) -> str:
    """A list of what ``shown`` names of a row: performance, an order, a policy, concentration; empty without a row.  Shares are shown in per cent."""
    if not row:
        return ""
    cell = lambda k: "-" if row.get(k) is None else f"{100 * row[k]:.1f} %" if shown[k].endswith("%") else f"{row[k]:.4g}" if isinstance(row[k], float) else str(row[k])
    items = "".join(f"<dt>{html.escape(name.rstrip(' %'))}</dt><dd>{html.escape(cell(k))}</dd>" for k, name in shown.items())
    return f"<section><h3>{html.escape(title)}</h3><dl>{items}</dl></section>"


def console(title: str, df: DataFrame, limit: int = 60) -> str:
    """A table as text, in the table's order; reports show at most ``limit`` rows."""
    rows = [[("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(limit).collect()]
    wide = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([title, line(df.columns), *map(line, rows)])


def html_table(title: str, df: DataFrame, limit: int = 200) -> str:
    """A section of the page; reports show at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table></section>"


def html_page(title: str, sections: list[str]) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(sections)


def alert_message(alerts: list[dict], breaches: list[dict]) -> tuple[str, str] | None:
    """Subject and body of the mail to send; None if there is nothing to say.  A broken stop leads."""
    if not alerts and not breaches:
        return None
    subject = f"Stop broken: {', '.join(b['symbol'] for b in breaches)}" if breaches else f"{len(alerts)} signals"
    lines = [f"{b['symbol']}: last {b['last']} at or under stop {b['stop']}" for b in breaches]
    lines += [f"{a['symbol']} {a['side']}: score {a['score']}" for a in alerts]
    return subject, "\n".join(lines)


#: Environment variables with the address and password to send from and the address to send to.
MAIL_SETTINGS = ("BARWRIGHT_MAIL_FROM", "BARWRIGHT_MAIL_PASSWORD", "BARWRIGHT_MAIL_TO")


def mail_settings(env: Mapping[str, str]) -> tuple[str, str, str] | None:
    """The three settings; None if one is missing, when no mail is sent."""
    found = tuple(env.get(k, "").strip() for k in MAIL_SETTINGS)
    return found if all(found) else None  # type: ignore[return-value]


def send_alerts(alerts: list[dict], breaches: list[dict], send) -> bool:
    """Hands the message to ``send(subject, body)``; True if it was sent, after which state may be saved."""
    message = alert_message(alerts, breaches)
    if message is None:
        return False
    send(*message)
    return True
