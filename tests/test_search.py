"""Searches, sweeps and resampling against plain forms of the same."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import resample
from barwright.operators import asof, replay, trades
from barwright.operators.extremes import Extremes
from barwright.plans import catalogue, oracle
from barwright.plans.config import Config


def plain_exit(high, low, close, at, entry, stop, target, gap, holding, breakeven):
    """(outcome, price, bars) of a long, bar by bar."""
    best = entry
    for j in range(at, min(at + holding, len(high))):
        line = stop if target is not None or j == at else max(stop, best - gap)
        if breakeven is not None and j > at and best - entry >= breakeven * (entry - stop):
            line = max(line, entry)
        if low[j] <= line:
            return 1, line, j - at + 1
        if target is not None and high[j] >= target:
            return 2, target, j - at + 1
        best = max(best, high[j])
    end = min(at + holding, len(high))
    return 0, close[end - 1] if end > at else entry, max(end - at, 0)


@pytest.mark.parametrize("mode", ["fixed", "trail", "breakeven"])
@pytest.mark.parametrize("sign", [1, -1])
def test_exits_equal_a_walk(mode, sign):
    rng = random.Random(f"{mode}{sign}")
    for _ in range(30):
        n, grid = rng.randrange(1, 90), rng.choice([1, 0.01])
        close = np.round(100 + np.cumsum([rng.gauss(0, 2) for _ in range(n)]) / grid) * grid
        high, low = close + np.array([rng.choice([0, 1, 3]) for _ in range(n)]), close - np.array([rng.choice([0, 1, 3]) for _ in range(n)])
        s = np.arange(n)
        entry, atr = close.copy(), np.full(n, rng.choice([1.0, 2.0, 5.0]))
        stop, target = entry - sign * np.array([rng.choice([1.0, 4.0, 9.0]) for _ in s]), entry + sign * np.array([rng.choice([2.0, 8.0]) for _ in s])
        holding, b = rng.choice([1, 5, 20, 250]), 1.0 if mode == "breakeven" else None
        bars = {"high": high, "low": low, "close": close, "entry_px": entry, "atr": atr}
        code, px, held = trades._exits(bars, s + 1, sign, stop, target if mode == "fixed" else None, 2.0, holding, b)
        hi, lo = (high, low) if sign > 0 else (-low, -high)
        for k in s:
            want = plain_exit(hi, lo, sign * close, k + 1, sign * entry[k], sign * stop[k], sign * target[k] if mode == "fixed" else None, 2 * atr[k], holding, b)
            assert (code[k], sign * px[k], held[k]) == pytest.approx(want)


def test_searches_without_bars_and_with_spurious_falls():
    none = Extremes(np.zeros(0), np.zeros(0), 20)
    assert none.first_low(np.zeros(0, int), np.zeros(0, int), np.zeros(0)).tolist() == []
    x = Extremes(np.full(64, 1.0), np.full(64, 0.1), 64)
    at, best = x.first_under_trail(np.array([0, 0]), np.array([64, 64]), np.array([0.0, 0.0]), np.array([1.0, 1.0]), np.array([0.9 + 1e-12, 0.9 - 1e-12]))
    assert at.tolist() == [64, 0] and best.tolist() == [1.0, 1.0]


@pytest.mark.parametrize("segment", [1 << 16, 40])
def test_sweeps_equal_pairs(spark, sf, segment, monkeypatch):
    monkeypatch.setattr(asof, "SEGMENT", segment)
    m = catalogue.market(spark, sf, Config(gap_min_atr=0.0)).keep()
    e = m.ind.select("symbol", "i", F.col("close").alias("x"), "low", "high").withColumns({"rmin": F.col("low"), "rmax": F.col("high")})
    o = m.order_blocks.select("symbol", "side", F.col("bottom").alias("low"), F.col("top").alias("high"), F.col("event_i").alias("known"), F.col("mitigated_i").alias("flip"))
    o = o.unionByName(m.gaps.select("symbol", "side", F.col("bottom").alias("low"), F.col("top").alias("high"), F.col("end_i").alias("known"), F.col("filled_i").alias("flip")))
    pairs = asof.active_on(e.drop("low", "high"), o, "known", "flip")
    met = (F.col("low") <= F.col("rmax")) & (F.col("high") >= F.col("rmin"))
    want = pairs.groupBy("symbol", "i").agg(
        *(F.max((met & (F.col("side") == s)).cast("int")) for s in ("bullish", "bearish")),
        F.max(F.when((F.col("side") == "bullish") & (F.col("low") < F.col("x")), F.col("low"))), F.min(F.when((F.col("side") == "bearish") & (F.col("high") > F.col("x")), F.col("high"))),
        F.count_if(F.col("side") == "bullish"), F.count_if(F.col("side") == "bearish"),
    )
    want = {(r[0], r[1]): tuple(r[2:]) for r in want.collect()}
    got = asof.meeting(e, o).join(asof.nearest(e, o), ["symbol", "i"]).join(asof.active_counts(e, o, "known", "flip"), ["symbol", "i"])
    got = {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}
    assert len(got) == e.count() and len(want) > 100
    assert {k: v for k, v in got.items() if v != (0, 0, None, None, 0, 0)} == want


def test_segments_change_no_outcome(spark, sf, monkeypatch):
    m = catalogue.market(spark, sf).keep()
    for cfg in (Config(), Config(exit_mode="trailing", trailing_max_holding=30)):
        whole = sorted(map(str, trades.outcomes(m.planned, cfg).collect()))
        monkeypatch.setattr(trades, "SEGMENT", 50)
        assert sorted(map(str, trades.outcomes(m.planned, cfg).collect())) == whole
        monkeypatch.undo()


def test_bounds_merge_from_any_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(i), float(rng.lognormal() - 1.4)) for g, n in (("a", 200), ("b", 31), ("c", 2), ("d", 1), (None, 9)) for i in rng.choice(3000, n, False)]
    df = spark.createDataFrame([*rows, ("a", 4000, None), ("e", 1, None)], "g string, i int, x double")
    want = {}
    for g in ("a", "b", "c", "d", None):
        i, x = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        w = resample.counts(i, 500)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = (x @ w) / w.sum(axis=0)
        want[g] = (len(x), np.percentile(m[~np.isnan(m)], 5) if len(x) > 1 else None)
    for parts in (1, 7):
        got = {r.g: (r.n, r.mean_lb) for r in resample.mean_bounds(df.repartition(parts), ["g"], "i", F.col("x"), 0.05, 500).collect()}
        assert got.keys() == want.keys()
        for g, (n, low) in want.items():
            assert got[g][0] == n and (got[g][1] is None) == (low is None) and (low is None or math.isclose(got[g][1], low, rel_tol=1e-9))


def test_bounds_of_lone_trades_are_those_of_the_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    cur = con.execute(oracle.SQL["bootstrap_bounds"])
    names = [c[0] for c in cur.description]
    want = {(r["symbol"], r["side"], r["threshold"]): (r["n"], r["mean_lb"]) for r in (dict(zip(names, row, strict=True)) for row in cur.fetchall())}
    got = {(r.symbol, r.side, r.threshold): (r.n, r.mean_lb) for r in catalogue.QUERIES["bootstrap_bounds"](spark, sf).collect()}
    assert got.keys() == want.keys() and any(n == 1 for n, _ in want.values())
    for k, (n, low) in want.items():
        assert got[k][0] == n and got[k][1] is not None and math.isclose(got[k][1], low, rel_tol=1e-9, abs_tol=1e-6)


def test_bounds_are_near_those_of_drawing_rows():
    rng = np.random.default_rng(5)
    for n in (30, 200):
        x, i = rng.lognormal(0, 1, n) - 1.5, np.sort(rng.choice(5000, n, False))
        w = resample.counts(i, 2000)
        ours = np.percentile((x @ w) / w.sum(axis=0), 5)
        drawn = np.percentile([x[rng.integers(0, n, n)].mean() for _ in range(5000)], 5)
        assert abs(ours - drawn) < 0.15 * x.std() / math.sqrt(n) * 1.6


def test_choice_needs_a_positive_bound(spark):
    taken = [("s", side, t, i, 3, (0.02 if i % 3 else -0.01) * sign, 1.0) for side, sign in (("bull", 1), ("bear", -1)) for t in (-1, 35, 40) for i in range(0, 400, 4 if t < 40 else 8)]
    taken += [("few", "bull", 35, i, 3, 0.05, 1.0) for i in range(20)]
    df = spark.createDataFrame(taken, "symbol string, side string, threshold int, i int, bars int, ret double, r double")
    costs = spark.createDataFrame([("s", 0.001), ("few", 0.001)], "symbol string, cost double")
    cfg = Config(thresholds=(35, 40))
    picks = {(r.symbol, r.side): r for r in replay.recommend(replay.threshold_sweep(df, costs, cfg), cfg).collect()}
    assert (picks["s", "bull"].confidence, picks["s", "bull"].threshold) == ("ok", 35) and 0 < picks["s", "bull"].expectancy_lb < picks["s", "bull"].expectancy
    assert picks["s", "bear"].confidence == "no_edge" and picks["s", "bear"].expectancy_lb < 0
    assert (picks["few", "bull"].confidence, picks["few", "bull"].n, picks["few", "bull"].threshold) == ("insufficient_data", 0, 50)


@pytest.mark.parametrize("block", [256, 2])
def test_correlations_by_blocks_and_by_sums(spark, block, monkeypatch):
    from barwright.operators import performance

    monkeypatch.setattr(performance, "BLOCK", block)
    rng = np.random.default_rng(block)
    common = rng.normal(size=60)
    rows = [(s, d, 100 * math.exp(x)) for s in "ABCDEFG" for d, x in enumerate(np.cumsum(0.02 * (common * (ord(s) % 3) + rng.normal(size=60))))]
    rows += [("FLAT", d, 7.0) for d in range(60)] + [("few", d, 1.0 + d) for d in range(20)]
    bars = spark.createDataFrame([(s, d, c, c, c, c, 1.0) for s, d, c in rows], "symbol string, i int, open double, high double, low double, close double, volume double").withColumn("ts", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, i)"))
    z = performance.standardised(bars, 40, 30)
    pairs = performance.correlations(z)
    got = {(r.a, r.b): r.rho for r in pairs.collect()}
    closes = {s: np.array([c for k, _, c in rows if k == s]) for s in "ABCDEFG"}
    rets = {s: (c[1:] / c[:-1] - 1)[-40:] for s, c in closes.items()}
    want = {(a, b): np.corrcoef(rets[a], rets[b])[0, 1] for a in rets for b in rets if a < b}
    assert set(got) == set(want) | {(min(s, "FLAT"), max(s, "FLAT")) for s in rets}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and got["A", "FLAT"] is None
    high = {(r.a, r.b) for r in performance.correlations(z, 0.3).collect()}
    assert high == {k for k, v in want.items() if v >= 0.3}
    for some in (list("ABCDEFG") + ["FLAT"], list("AB"), ["A"], []):
        measured = bars.where(F.col("symbol").isin(some))
        a, b = performance.effective_number_by_sums(measured, z).first(), performance.effective_number(measured, pairs).first()
        assert (a.n_symbols, a.n_eff is None) == (b.n_symbols, b.n_eff is None) and a.n_eff == pytest.approx(b.n_eff) and a.mean_rho == pytest.approx(b.mean_rho)
