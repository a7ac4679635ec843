"""Models by symbol: gates, ranks, and what a replay may know."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import indicators
from barwright.plans import boosting, catalogue, models
from barwright.plans.config import Config


def walk_bars(spark, symbols, n=240, seed=1):
    rng, rows = random.Random(seed), []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o = c
            # Prices that come back to 100, so that features tell something.
            c = max(5.0, c + 0.35 * (100 - c) + rng.gauss(0, 6))
            rows.append((s, i, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 1000 + rng.random() * 500))
    df = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.expr("timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, i)"))


def test_boosting_finds_what_is_there():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 10))
    noise, leak = rng.integers(0, 2, 1200).astype(float), (x[:, 3] > 0).astype(float)
    both = ((x[:, 1] > 0) & (x[:, 2] > 0.2)).astype(float)
    found = [boosting.auc(boosting.Boosted(x[:600], y[:600]).probability(x[600:]), y[600:]) for y in (noise, leak, both)]
    assert 0.42 < found[0] < 0.58 and found[1] > 0.99 and found[2] > 0.95


def test_boosting_of_constant_features_is_the_share():
    y = np.array([0.0] * 60 + [1.0] * 40)
    assert boosting.Boosted(np.ones((100, 2)), y).probability(np.ones((1, 2)))[0] == pytest.approx(0.4)


def test_rank_auc_counts_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(6) / 2, rng.randrange(2)) for g in "ab" for _ in range(40)] + [("one class", 1.0, 1)] * 3
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r.g: r.auc for r in models.rank_auc(df, ["g"], "score").collect()}
    for g in "ab":
        pairs = [(x > y) + (x == y) / 2 for k, x, a in rows for m, y, b in rows if k == m == g and a == 1 and b == 0]
        assert got[g] == pytest.approx(sum(pairs) / len(pairs))
        s, t = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        assert boosting.auc(s, t) == pytest.approx(got[g])
    assert got["one class"] is None


def test_folds_are_equal_blocks_at_the_end(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 20), ("b", 4)) for i in range(n)], "symbol string, i int")
    got = {(r.symbol, r.i): r.fold for r in models.time_folds(df, 5).collect()}
    want = {("a", i): next((k + 1 for k, (a, z) in enumerate(boosting.blocks(20, 5)) if a <= i < z), 0) for i in range(20)}
    assert got == want | {("b", i): 0 for i in range(4)}


@pytest.fixture(scope="module")
def ind(spark):
    return indicators.compute(walk_bars(spark, ["A", "B"])).unionByName(indicators.compute(walk_bars(spark, ["short"], 70))).persist()


def test_each_symbol_has_its_own_model(spark, ind):
    got = {r.symbol: r for r in models.gated_probability(ind, least_auc=0.0).collect()}
    assert set(got) == {"A", "B", "short"} and got["short"].prob_up is None and got["short"].trained_rows < 80
    alone = models.gated_probability(ind.where("symbol = 'A'"), least_auc=0.0).first()
    assert alone == got["A"] and got["A"].prob_up != got["B"].prob_up
    assert all(r.prob_up is None for r in models.gated_probability(ind, least_auc=1.0).collect())
    # The same by hand, out of the rows of one symbol.
    rows = models._usable(ind.where("symbol = 'A'"), 5).orderBy("i").toPandas()
    x, y = rows[list(models.FEATURES)].to_numpy(float), rows["label"].to_numpy(float)
    assert got["A"].prob_up == pytest.approx(models._gated(x, y, x[-1:], 5, 80, 0.08, 0.0))


def test_a_later_bar_changes_no_earlier_probability(spark, ind):
    how = {"start": 150, "every": 7, "least_auc": 0.5}
    whole = {(r.symbol, r.i): (r.trained_i, r.prob_up) for r in models.replayed_probability(ind, **how).collect()}
    assert len(whole) == 180 and any(p is not None for _, p in whole.values()) and all(t <= i < t + 7 for (_, i), (t, _) in whole.items())
    cut = ind.where("i < 201")
    got = {(r.symbol, r.i): (r.trained_i, r.prob_up) for r in models.replayed_probability(cut, **how).collect()}
    assert got == {k: v for k, v in whole.items() if k[1] < 201}
    # The last training knows what a model of all bars so far knows.
    last = ind.where("i <= 199 AND symbol = 'A'")
    assert whole["A", 199][1] == pytest.approx(models.gated_probability(last, least_auc=0.5).first().prob_up)


def test_scores_take_the_model_in(spark, sf):
    cfg = Config(ml_enabled=True, ml_retrain_every=60, ml_min_train_rows=60, warmup=120)
    m = catalogue.market(spark, sf, cfg).keep()
    rows = m.scores.drop("prob_up").join(m.ml, ["symbol", "i"]).select("bull_ml", "bear_ml", "prob_up").collect()
    assert rows
    for r in rows:
        strength = 0 if r.prob_up is None else min(abs(r.prob_up - 0.5) * 2, 1)
        assert max(r.bull_ml, r.bear_ml) == pytest.approx(strength) and min(r.bull_ml, r.bear_ml) == 0
