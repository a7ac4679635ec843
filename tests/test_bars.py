import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import recur, stats
from barwright.operators import asof, bars as B, indicators, performance, replay, structure, tracking, trades
from barwright.plans import catalogue, models, report
from barwright.plans.config import Config
from barwright.sources import sinks, tables

from . import walk


@pytest.fixture(scope="module")
def b(spark):
    return walk.bars(spark).persist()


@pytest.fixture(scope="module")
def market(b):
    return replay.Market(b, Config(warmup=60, thresholds=(20, 30))).keep()


def by_symbol(df):
    return {s: g.sort_values("i", ignore_index=True) for s, g in df.toPandas().groupby("symbol")}


def test_missing_columns(spark, b):
    with pytest.raises(ValueError):
        B.index_bars(b.drop("high"))


@pytest.mark.parametrize("alpha", [2 / 13, 1 / 14, 2 / 201])
def test_ewm_equals_pandas(b, alpha):
    for g in by_symbol(recur.ewm(b, F.col("close"), alpha, "y")).values():
        np.testing.assert_allclose(g.y, g.close.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-12)


def test_ewm_over_nulls(spark):
    x = [None, 1.0, None, None, 3.0, 4.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, i int, x double")
    y = [r.y for r in recur.ewm(df, F.col("x"), 0.5, "y").orderBy("i").collect()]
    assert y[0] is None and y[1:4] == [1.0, 1.0, 1.0]
    np.testing.assert_allclose(y[4:], pd.Series(x).ewm(alpha=0.5, adjust=False).mean()[4:])


def test_windows_equal_grouped_indicators(b):
    whole = by_symbol(indicators.compute(b))
    for df, cols in ((indicators.rsi(b), ["rsi"]), (indicators.macd(b), ["macd_hist"]), (indicators.adx(b), ["adx", "plus_di", "minus_di", "atr"]), (indicators.obv(b), ["obv"])):
        for s, g in by_symbol(df).items():
            for c in cols:
                np.testing.assert_allclose(g[c], whole[s][c], rtol=1e-9, atol=1e-9)


def test_rsi_without_losses_is_50(spark):
    rows = [("A", i, float(i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double")
    assert {r.rsi for r in indicators.rsi(df).collect()} == {50.0}


def test_structure_equals_walk(b, market):
    pdf, sw, ev = by_symbol(b), by_symbol(market.swings), by_symbol(market.events)
    for s, g in pdf.items():
        kept = walk.alternating(walk.extremes(g, 3))
        found = sw[s].sort_values("seq")
        assert list(zip(found.i, found.kind, found.price, strict=True)) == kept
        want = walk.breaks(g, kept, 3)
        assert list(zip(ev[s].i, ev[s].side, ev[s].type, ev[s].broken_i, strict=True)) == want and want


def test_causal_swings_are_prefix_stable(b):
    full = structure.swings(b, 3, causal=True).where("conf_i < 150").select("symbol", "i", "kind")
    part = structure.swings(b.where("i < 150"), 3, causal=True).select("symbol", "i", "kind")
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_order_blocks_lie_in_their_leg_and_touch_later(market):
    o = market.order_blocks.join(market.events.select("symbol", F.col("i").alias("event_i"), "side", "broken_i"), ["symbol", "event_i", "side"])
    assert o.where("start_i < broken_i OR start_i >= event_i OR mitigated_i <= event_i OR bottom > top").count() == 0 < o.count()


def test_first_touches_equal_walk(b, market):
    pdf = by_symbol(b)
    none = lambda v: None if pd.isna(v) else int(v)
    o, g, p = (df.toPandas() for df in (market.order_blocks, market.gaps, market.pools))
    assert len(o) > 20 and len(g) > 3
    for r in o.itertuples():
        assert none(r.mitigated_i) == walk.first_touch(pdf[r.symbol], r.event_i, r.top, r.bottom)
    for r in g.itertuples():
        up = r.side == "bullish"
        assert none(r.filled_i) == walk.first_touch(pdf[r.symbol], r.end_i, r.top if up else None, None if up else r.bottom)
    for r in p.itertuples():
        high = r.kind == "EQH"
        assert none(r.swept_i) == walk.first_touch(pdf[r.symbol], r.conf_i, None if high else r.price, r.price if high else None, strict=True)


def test_gap_component_is_a_fresh_gap(market):
    c = market.scores
    fresh = market.gaps.select("symbol", "end_i", F.coalesce("filled_i", F.lit(10**9)).alias("f"), "side")
    want = asof.recent_range(market.bars, 3).join(fresh, "symbol").where("end_i >= r_first AND end_i <= i AND f > i AND side = 'bullish'").select("symbol", "i").distinct()
    assert c.where("bull_fvg = 1").select("symbol", "i").exceptAll(want).count() == 0


def test_active_objects_are_those_known_and_not_flipped(b, market):
    got = asof.active_on(b.select("symbol", "i"), market.order_blocks, "event_i", "mitigated_i").groupBy("symbol", "i").count()
    o, n = market.order_blocks.toPandas(), {(r.symbol, r.i): r["count"] for r in got.collect()}
    for (s, i), k in n.items():
        x = o[o.symbol == s]
        assert k == ((x.event_i <= i) & (x.mitigated_i.isna() | (x.mitigated_i > i))).sum()


def test_trailing_exit_equals_walk(b, market):
    pdf = by_symbol(b)
    plan = {(r.symbol, r.i): r for r in market.planned.collect()}
    rows = trades.exit_trailing(market.planned, "long", 2.0, 40).collect()
    assert len(rows) > 400
    for r in rows:
        p = plan[r.symbol, r.i]
        want = walk.trailing(pdf[r.symbol], r.i + p.entry_off + 2, p.entry_px, p.long_stop, p.atr, 2.0, 40)
        assert (r.outcome, r.bars_held) == (want[0], want[2]) and abs(r.exit_px - want[1]) < 1e-9


@pytest.mark.parametrize("mode", ["fixed", "trailing"])
def test_numpy_outcomes_equal_window_forms(market, mode):
    cfg = Config(exit_mode=mode, trailing_max_holding=40, trail_atr_mult=2.0)
    out = trades.outcomes(market.planned, cfg)
    for side in ("long", "short"):
        form = trades.exit_fixed(market.planned, side, 20) if mode == "fixed" else trades.exit_trailing(market.planned, side, 2.0, 40)
        j = form.join(out, ["symbol", "i"]).select("outcome", F.col(f"{side}_outcome").alias("o2"), "ret", F.col(f"{side}_ret").alias("r2")).toPandas()
        assert len(j) > 400 and (j.outcome == j.o2).all()
        np.testing.assert_allclose(j.ret, j.r2, atol=1e-12)


def test_entry_fill_cases(spark):
    rows = [("A", 0, 100.0, 101.0, 99.0, 100.0, 4.0), ("A", 1, 97.0, 99.0, 96.0, 98.0, 4.0), ("A", 2, 99.0, 100.0, 95.5, 99.0, 4.0), ("A", 3, 103.0, 104.0, 102.0, 103.0, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, atr double")
    got = {r.i: (r.entry_px, r.entry_off) for r in trades.entry_fill(df, Config()).collect()}
    assert got == {0: (97.0, 0), 1: (96.0, 0), 2: (99.0, -1), 3: (103.0, -1)}


def test_one_trade_at_a_time(spark):
    rng = np.random.default_rng(4)
    rows = [("A", int(i), int(rng.integers(1, 9)), int(rng.integers(0, 60))) for i in np.flatnonzero(rng.random(300) < 0.4)]
    df = spark.createDataFrame(rows, "symbol string, i int, bars int, score int")
    got = replay.one_at_a_time(df, ["symbol"], (-1, 30)).toPandas()
    for t in (-1, 30):
        took = sorted(got[got.threshold == t].i)
        able = [(i, h) for _, i, h, score in rows if score >= t]
        # Whatever wasn't taken lies under a trade, and trades don't overlap.
        hold = dict(able)
        assert all(took[k] + hold[took[k]] <= took[k + 1] for k in range(len(took) - 1)) and took[0] == able[0][0]
        assert all(i in took or any(x < i < x + hold[x] for x in took) for i, _ in able)
    assert sorted(r.i for r in replay.one_at_a_time(df, ["symbol"]).collect()) == sorted(got[got.threshold == -1].i)


def test_replay_rows_and_summary(market):
    w = market.replay().persist()
    assert w.count() == 2 * (300 - 60 - 5) == w.select("symbol", "i").distinct().count()
    taken = replay.taken_trades(w, (20, 30)).persist()
    costs = w.select("symbol").distinct().withColumn("cost", F.lit(0.001))
    s = replay.threshold_sweep(taken, costs, market.cfg)
    assert s.where("wins > n OR win_rate_lb > win_rate OR expectancy_lb > expectancy").count() == 0 < s.count()
    assert {r.confidence for r in replay.recommend(s, market.cfg).collect()} <= {"ok", "no_edge", "insufficient_data"}


@pytest.mark.parametrize("wins,n,want", [(5, 8, 0.3058), (19, 30, 0.4551), (125, 200, 0.5561)])
def test_wilson_known_values(spark, wins, n, want):
    assert abs(spark.range(1).select(stats.wilson_lower(F.lit(wins), F.lit(n))).first()[0] - want) < 1e-4


def test_budget_terms(spark):
    got = {r.b: r.t for r in spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "b double").select("b", stats.budget_terms(F.col("b")).alias("t")).collect()}
    assert got[0.1].floor_reached and got[0.1].matched_budget == 0.2 and got[0.3].oos_breach == "15/22" and got[0.9].trail_atr_mult == 5.0 and not got[0.9].floor_reached


@pytest.mark.parametrize("p,rr,want", [(0.5, 2.0, 0.25), (0.6, 2.0, 0.4), (1 / 3, 2.0, 0.0), (0.9, 0.0, 0.0)])
def test_kelly(spark, p, rr, want):
    assert abs(spark.range(1).select(stats.kelly(F.lit(p), F.lit(rr))).first()[0] - want) < 1e-12


def test_drawdown_growth_and_empty_curve(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 1.5, 0.9, 1.2])], "symbol string, i int, v double")
    assert abs(performance.max_drawdown(df, ["symbol"], "i", "v").first().max_drawdown - 0.4) < 1e-12
    r = spark.range(1).select(performance.cagr(F.lit(-1.0), F.lit(2.0)), performance.cagr(F.lit(0.21), F.lit(2.0))).first()
    assert r[0] is None and abs(r[1] - 0.1) < 1e-12


def test_concentration(spark):
    pairs = spark.createDataFrame([("A", "B", 0.5), ("A", "C", 0.7), ("B", "C", 0.0)], "a string, b string, rho double")
    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "symbol string")
    assert abs(performance.effective_number(of("A", "B"), pairs).first().n_eff - 4 / 3) < 1e-12
    assert [performance.effective_number(df, pairs).first().n_eff for df in (of("A"), of("A").limit(0))] == [1.0, 0.0]
    r = performance.signal_concentration(of("A", "C", "Z"), of("A", "B", "C"), pairs).first()
    assert (r.n_signals, r.n_measured, r.band) == (3, 2, "medium") and abs(r.n_eff - 4 / 3.4) < 1e-12 and abs(r.mean_rho - 0.7) < 1e-12
    assert performance.signal_concentration(of("Z"), of("A"), pairs).first().band is None
    assert [(r.a, r.b) for r in performance.high_pairs(pairs).collect()] == [("A", "C")]


@pytest.mark.parametrize("side", ["bull", "bear"])
def test_portfolio_equals_walk(spark, side):
    rng = np.random.default_rng(9)
    day = [pd.Timestamp("2021-01-01") + pd.Timedelta(days=int(d)) for d in range(60)]
    closes = {(s, d): float(50 + 10 * rng.random()) for s in "ABCDEF" for d in range(60) if rng.random() < 0.9}
    signals = [(d, int(rng.integers(0, 5)), s, float(rng.normal(0, 0.05)), int(rng.integers(0, 12))) for d in range(60) for s in "ABCDEF" if rng.random() < 0.3]
    s = spark.createDataFrame([(x, day[d].to_pydatetime(), score, r, h) for d, score, x, r, h in signals], "symbol string, ts timestamp_ntz, score int, ret double, bars int")
    px = spark.createDataFrame([(x, day[d].to_pydatetime(), c) for (x, d), c in closes.items()], "symbol string, ts timestamp_ntz, close double")
    got = performance.simulate_portfolio(s, px, (1, 3), side=side).toPandas()
    for slots in (1, 3):
        g = got[got.slots == slots].sort_values("bar")
        np.testing.assert_allclose(g.equity, walk.portfolio(signals, closes, 60, slots, 1 if side == "bull" else -1), rtol=1e-9)
        assert g.n_open.max() == slots and g.n_entered.sum() > 10
    stats_ = performance.portfolio_stats(performance.simulate_portfolio(s, px, (3,), side=side)).first()
    assert stats_.n_trades == got[got.slots == 3].n_entered.sum() and abs(stats_.trades_per_year - stats_.n_trades * 252 / 60) < 1e-9
    capital = performance.simulate_portfolio(s.withColumn("ret", F.lit(0.0)), px.withColumn("close", F.lit(1.0)), (2,), equal_slots=True).toPandas()
    assert (abs(capital.equity - 1) < 1e-9).all()


def test_summary_sets_longs_beside_holding(spark):
    t = spark.createDataFrame([("A", "bull", 0, 0.1, 2), ("A", "bull", 5, -0.05, 3), ("A", "bear", 1, 0.02, 1)], "symbol string, side string, i int, ret double, bars int")
    n, bench = spark.createDataFrame([("A", 252)], "symbol string, n_bars int"), spark.createDataFrame([("A", 0.02, 0.3)], "symbol string, total_return double, max_drawdown double")
    r = {x.side: x for x in performance.summarize(t, n, bench).collect()}
    assert abs(r["bull"].total_return - 0.045) < 1e-12 and r["bull"].beats_bh and abs(r["bull"].excess_vs_bh - 0.025) < 1e-12 and r["bull"].beats_bh_by_calmar
    assert abs(r["bull"].max_drawdown - 0.05) < 1e-12 and r["bear"].bh_return is None and r["bear"].calmar is None and r["bear"].beats_bh is None


def test_alert_dedup_and_state(spark):
    alerts = spark.createDataFrame([("A", "bull", 60.0, 50), ("B", "bull", 60.0, 50), ("C", "bull", 60.0, 50), ("D", "bear", 60.0, 50)], "symbol string, side string, score double, threshold int")
    state = spark.createDataFrame([("A", "bull", "2024-01-09 00:00:00", 58.0, 50), ("B", "bull", "2024-01-09 00:00:00", 40.0, 50), ("C", "bull", "rubbish", 60.0, 50)], tables.ALERTS)
    sent = tracking.dedup_alerts(alerts, state, "2024-01-10 00:00:00")
    assert {r.symbol for r in sent.collect()} == {"B", "C", "D"}
    after = tracking.merge_state(state, sent, "2024-01-10 00:00:00")
    assert after.count() == 4 and {r.at for r in after.where("symbol = 'B'").collect()} == {"2024-01-10 00:00:00"}


def test_positions_trail_and_missing(spark, b):
    ind = indicators.compute(b)
    p = spark.createDataFrame([("A", "2021-03-01", 100.0, 90.0), ("Z", "2021-03-01", 1.0, None)], tables.POSITIONS)
    r = tracking.track_positions(p, ind).collect()
    assert len(r) == 1 and r[0].stop >= r[0].initial_stop == 90.0 and r[0].breached == (r[0].last <= r[0].stop)
    at_entry = tracking.track_positions(spark.createDataFrame([("A", "2021-03-01", 100.0, 100.0)], tables.POSITIONS), ind.withColumn("atr", F.lit(0.0))).first()
    assert at_entry.locked_in and abs(at_entry.stop_distance - (at_entry.last - 100) / at_entry.last) < 1e-12
    k = tracking.position_kpis(tracking.track_positions(p, ind)).first()
    assert k.n_positions == 1 and k.n_breached == int(r[0].breached)
    assert [x.symbol for x in tracking.untracked(p, b).collect()] == ["Z"]


def test_state_files(spark, tmp_path):
    assert tables.read_state(spark, str(tmp_path / "none.json"), tables.POSITIONS).count() == 0
    (tmp_path / "p.json").write_text('[{"symbol": "A", "entry_price": 1.5}, {"entry_price": 2}, 7]')
    assert [(r.symbol, r.entry_price) for r in tables.read_state(spark, str(tmp_path / "p.json"), tables.POSITIONS).collect()] == [("A", 1.5)]
    (tmp_path / "q.json").write_text('[{"symbol": "A"')
    assert tables.read_state(spark, str(tmp_path / "q.json"), tables.POSITIONS).count() == 0


def test_cache_round_trip(spark, tmp_path):
    cfg, path = Config(), str(tmp_path / "cache")
    assert cfg.fingerprint() != Config(fallback_target_r=3.0).fingerprint() and sinks.read_cache(spark, path) is None
    sinks.write_cached(spark.createDataFrame([("A", 1)], "symbol string, n int"), path, cfg.fingerprint(), "2024-01-01 00:00:00")
    cached = sinks.read_cache(spark, path)
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    left = lambda now, days: {r.symbol for r in sinks.to_recompute(symbols, cached, cfg.fingerprint(), now, days).collect()}
    assert left("2024-01-03 00:00:00", 7) == {"B"} and left("2024-01-09 00:00:00", 7) == {"A", "B"} == left("2024-01-03 00:00:00", 0)


def test_messages():
    assert report.alert_message([], []) is None
    sent = []
    assert report.send_alerts([{"symbol": "A", "side": "bull", "score": 60}], [{"symbol": "B", "last": 1, "stop": 2}], lambda s, t: sent.append((s, t)))
    assert sent[0][0].startswith("Stop broken: B") and "A bull" in sent[0][1]
    assert not report.send_alerts([], [], None)


def test_markers_stay_in_chart(b):
    t = b.where("i IN (10, 250)").select("symbol", F.col("i").alias("entry_i"), (F.col("i") + 500).alias("exit_i"), F.lit(None).cast("double").alias("entry_px"), F.lit(None).cast("double").alias("exit_px"), F.lit(0.1).alias("ret"))
    m = report.trade_markers(t, b).collect()
    assert {r.entry_i for r in m} == {250} and {r.exit_i for r in m} == {299} and all(r.entry_px is not None for r in m)


def test_files_by_symbol_and_patience(spark, tmp_path):
    for name in ("2330_TW", "AAA"):
        (tmp_path / f"{name}.csv").write_text("ts,Open,High,Low,Close\n2024-01-02,1,2,0.5,1.5\n")
    got = tables.read_symbol_files(spark, str(tmp_path), "csv")
    assert {r.symbol for r in got.collect()} == {"2330.TW", "AAA"} and "open" in got.columns
    assert {r.symbol for r in tables.read_symbol_files(spark, str(tmp_path), "csv", limit=1).collect()} == {"2330.TW"}
    assert tables.flat_names(spark.createDataFrame([(1, 2)], ["('Open', 'AAA')", "Close.AAA"])).columns == ["open", "close"]
    waits, tries = [], iter([ValueError("down"), spark.range(0), spark.range(3)])

    def read():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert tables.patiently(read, wait=waits.append).count() == 3 and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        tables.patiently(lambda: spark.range(0), 2, wait=waits.append)


def test_universe_and_columns(spark):
    u = tables.universe(spark, [{"symbol": "B"}, {"symbol": "A.TW", "name": "a", "etf": True}])
    assert [(r.symbol, r.name, r.etf) for r in u.collect()] == [("A.TW", "a", True), ("B", "B", False)]
    assert abs(u.first().cost - (0.001425 * 0.6 * 2 + 0.001)) < 1e-12 and tables.universe(spark, [{"symbol": "B"}, {"symbol": "A"}], 1).first().symbol == "A"
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(tables.column_or_null(df, "x")).collect()] == [1.0, None] and df.select(tables.column_or_null(df, "y")).first()[0] is None


def test_texts_and_fragments(spark, b, market):
    ind = indicators.compute(b)
    p = spark.createDataFrame([("A", "2021-03-01", 100.0, 1.0)], tables.POSITIONS)
    assert tracking.described(tracking.track_positions(p, ind)).first().text.startswith("A: stop ")
    sizes = tracking.suggest_size(spark.createDataFrame([("A", 10, 20, 0.1)], "symbol string, wins long, n long, timeout_rate double"))
    assert tracking.described_sizes(sizes).first().text == "A: 0.0% of capital, too few samples (10 of 20)"
    assert trades.described(market.planned).where("text IS NOT NULL").first().text.startswith("long at ")
    t = trades.entry_ticket(market.planned, 5.0)
    assert t.where("stop_source = 'plan'").count() > 0 == t.where("stop > limit_price AND stop_source <> 'plan'").count()
    assert report.badge("ok") == '<span class="good">proven</span>' and "on" in report.score_bar(60, 50) and "width:100%" in report.score_bar(120, 200)
    assert spark.createDataFrame([("premium",), ("x",)], "z string").select(report.labelled(F.col("z")).alias("l")).collect()[1].l.label == "x"
    assert report.fragment("t", {"a": 0.25, "b": None}, {"a": "gain %", "b": "loss"}) == "<section><h3>t</h3><dl><dt>gain</dt><dd>25.0 %</dd><dt>loss</dt><dd>-</dd></dl></section>" and report.fragment("t", None, {}) == ""
    assert report.console("t", spark.createDataFrame([("a", None)], "x string, y double")) == "t\nx  y\na  -"
    assert report.mail_settings({}) is None and report.mail_settings({k: "x" for k in report.MAIL_SETTINGS}) == ("x", "x", "x")
    from barwright.__main__ import arguments

    assert arguments(["ema20", "--data", "d", "--dry-run"]).dry_run


def test_documents_and_saving(spark, tmp_path):
    import json

    picks = spark.createDataFrame([("A", "bull", 40), ("A", "bear", 50)], "symbol string, side string, threshold int")
    summary = spark.createDataFrame([("A", "bull", 0.1)], "symbol string, side string, cagr double")
    assert json.loads(sinks.backtest_documents(picks, summary).first().document) == {"bear": {"threshold": 50, "cagr": None}, "bull": {"threshold": 40, "cagr": 0.1}}
    assert sinks.save_state(picks, str(tmp_path / "s")) and spark.read.json(str(tmp_path / "s")).count() == 2
    with pytest.warns(UserWarning):
        assert not sinks.save_state(picks, "nowhere://x/y")


def test_sides_without_trades(spark):
    wf = spark.createDataFrame([("A", 3, None, 10, 20, 0.1)], "symbol string, i int, ts timestamp_ntz, bull_score int, bear_score int, future_return double")
    got = {r.side: r for r in replay.sides(wf, 7).collect()}
    assert (got["bull"].ret, got["bear"].ret, got["bull"].bars, got["bear"].score) == (0.1, -0.1, 7, 20)


def test_random_barriers_run_the_given_risks(spark):
    bars = spark.createDataFrame([("A", i, 100.0 + i, 99.0 + i, 100.0 + i) for i in range(400)] + [("B", i, 1.0, 1.0, 1.0) for i in range(400)], "symbol string, i int, high double, low double, close double")
    risks = spark.createDataFrame([("A", 0.02), ("A", 0.01), ("B", 0.5), ("B", None)], "symbol string, risk double")
    out = tracking.random_barriers(bars, risks, 50, 1, 2.0, 100, 100)
    assert {(r.symbol, r.outcome, r.n) for r in out.groupBy("symbol", "outcome").agg(F.count("*").alias("n")).collect()} == {("A", "target", 50), ("B", "timeout", 50)}
    assert tracking.random_barriers(bars, risks, 50, 1, 2.0, 400, 100).count() == 0


def test_weight_trial_equals_walk(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("A", "B", "short"):
        for i in range(700 if s != "short" else 100):
            c = [float(x) for x in rng.integers(0, 2, len(models.COMPONENTS))]
            rows.append((s, i * 2, *c, float(0.02 * c[0] - 0.01 * c[3] + rng.normal(0, 0.02)), int(rng.integers(1, 6))))
    cfg = Config(thresholds=(20, 40, 60))
    m = spark.createDataFrame(rows, "symbol string, i int, " + ", ".join(f"c_{c} double" for c in models.COMPONENTS) + ", ret double, bars int")
    got = {(r.symbol, r.kind): r for r in models.weight_trial(m, cfg).collect()}
    assert {k for _, k in got} == {"manual", "fitted", "random"} and {s for s, _ in got} == {"A", "B"}
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        parts = {"train": own[:420], "test": own[440:]}
        x, y = np.array([r[2:12] for r in parts["train"]]), np.array([r[12] for r in parts["train"]])
        one = np.column_stack([np.ones(len(x)), x])
        w = np.linalg.solve(one.T @ one + np.diag([0.0] + [1.0] * 10), one.T @ y)[1:].clip(0)
        for kind, weights in (("fitted", w / w.sum() * 100), ("manual", np.array([cfg.weights[c] for c in models.COMPONENTS]))):
            mean = {}
            for part, held in parts.items():
                for t in cfg.thresholds:
                    free, took = 0, []
                    for k, r in enumerate(held):
                        if k >= free and np.dot(r[2:12], weights) >= t:
                            took.append(r[12])
                            free = k + r[13]
                    if len(took) >= (15 if part == "train" else 8):
                        mean[part, t] = np.mean(took)
            best = max((v, -t) for (part, t), v in mean.items() if part == "train")
            r = got[s, kind]
            assert r.threshold == -best[1] and abs(r.expectancy - mean["test", r.threshold]) < 1e-9
            assert abs(r.excess - (r.expectancy - np.mean([x[12] for x in parts["test"]]))) < 1e-9
    v = {r.kind: r for r in models.weight_verdict(models.weight_trial(m, cfg)).collect()}
    assert sum(r.wins for r in v.values()) == 2 and all(r.n_symbols == 2 for r in v.values()) and v["fitted"].median_excess > v["random"].median_excess


def test_gate_takes_every_symbol(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "gated_probability", lambda ind, **_: seen.append(ind.select("symbol").distinct().count()))
    catalogue.QUERIES["ml_gate"](spark, sf)
    assert seen == [tables.brand_bars(spark, sf).select("symbol").distinct().count()]
