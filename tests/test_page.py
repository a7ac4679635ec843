"""The composed page has all its parts, and says nothing that the tables don't."""

import re

from pyspark.sql import functions as F

from barwright.operators import performance, replay
from barwright.plans import catalogue, page
from barwright.plans.config import Config
from barwright.sources.scratch import written


def test_page(spark, sf):
    cfg = Config(thresholds=(5, 20), warmup=60, min_trades=5)
    m = catalogue.market(spark, sf, cfg).keep()
    w = written(m.replay(), "replay")
    picks = written(replay.recommend(replay.threshold_sweep(replay.taken_trades(w, cfg.thresholds), catalogue.cost_table(m.bars), cfg), cfg), "picks")
    positions = catalogue._positions(m.bars)
    z = performance.standardised(catalogue.B.index_bars(catalogue.B.resample(m.bars, "week")), 252, 10)
    due = page.orders(m, picks).collect()
    assert due and all(r.score >= r.threshold for r in due) and [r.score for r in due] == sorted((r.score for r in due), reverse=True)
    text = page.compose("Today <1>", m, picks, positions, z, most=4)
    assert "<title>Today &lt;1&gt;</title>" in text and text.count("<svg") == 4 and "-gone" in text
    titles = re.findall(r"<h[23]>([^<]*)</h[23]>", text)
    assert [t for t in titles if t in ("Positions", "Orders", "Open positions", "Positions without bars", "Concentration", "Much the same", "Thresholds", "Charts")] == titles
    assert f">{due[0].symbol}<" in text and "through their stop" in text or "orders to place" in text
    svg = page.charts(m).collect()
    assert len(svg) == m.bars.select("symbol").distinct().count()
    for r in svg:
        assert "nan" not in r.svg and len(re.search(r'points="([^"]*)"', r.svg)[1].split()) == min(m.bars.where(F.col("symbol") == r.symbol).count(), 180)


def test_banner():
    assert "2 positions" in page.banner(3, {"n_breached": 2}) and "3 orders" in page.banner(3, {"n_breached": 0}) and "nothing" in page.banner(0, None)
