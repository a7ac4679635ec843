"""Learned parts: feature rows, gated probabilities, and fitted score weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators, replay, trades
from ..operators.bars import by_symbol
from ..sources.scratch import written
from . import boosting

FEATURES = ("rsi", "macd_hist", "adx", "di_diff", "ema20_gap", "ema50_gap", "trend_align", "atr_pct", "volume_z", "dist_to_discount")
COMPONENTS = ("zone", "order_block", "fvg", "choch", "bos", "sweep", "rsi", "macd", "ema_stack", "adx_di")


def features(ind: DataFrame) -> DataFrame:
    """Ten features of each bar of an indicator table; null until their windows are full."""
    df = indicators.range_position(indicators.rolling(ind, "volume").withColumnRenamed("z", "volume_z").drop("mean", "std"))
    c = F.col
    above = lambda a, b: F.when(c(a) > c(b), 1.0).otherwise(-1.0)  # noqa: E731  equal averages count as falling
    return df.withColumns({
        "di_diff": c("plus_di") - c("minus_di"), "ema20_gap": (c("close") - c("ema20")) / c("close"), "ema50_gap": (c("close") - c("ema50")) / c("close"),
        "trend_align": above("ema20", "ema50") + above("ema50", "ema200"), "atr_pct": c("atr") / c("close"),
    })


def labels(bars: DataFrame, horizon: int = 5, over: float = 0.0) -> DataFrame:
    """1 if the close ``horizon`` bars on is up by more than ``over``, else 0; also 0 where that bar isn't there yet."""
    ahead = F.lead("close", horizon).over(by_symbol()) / F.col("close") - 1
    return bars.withColumn("label", F.coalesce((ahead > over).cast("int"), F.lit(0)))


def time_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Adds fold: 0 for what comes before the last ``folds`` equal blocks of a symbol's rows, then 1, 2 ... for these; all 0 if rows are fewer."""
    w = Window.partitionBy("symbol")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("i")) - 1
    size = F.floor(n / (folds + 1))
    fold = F.when((size > 0) & (k >= n - folds * size), F.floor((k - (n - folds * size)) / size) + 1).otherwise(0)
    return rows.withColumn("fold", fold.cast("int"))


def rank_auc(rows: DataFrame, keys: list[str], score: str, label: str = "label") -> DataFrame:
    """keys, n, auc: how often a row of label 1 scores over one of label 0, ties half, from the sum of ranks; null for one class."""
    w = Window.partitionBy(*keys)
    tied = F.count("*").over(Window.partitionBy(*keys, score))
    ranked = rows.withColumn("_rank", F.rank().over(w.orderBy(score)) + (tied - 1) / 2)
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    above = F.sum(F.when(F.col(label) == 1, F.col("_rank"))) - ones * (ones + 1) / 2
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(above, (ones * zeros).cast("double")).alias("auc"))


def _usable(ind: DataFrame, horizon: int) -> DataFrame:
    return labels(features(ind), horizon).dropna(subset=list(FEATURES)).select("symbol", "i", *FEATURES, "label")


def gated_probability(ind: DataFrame, horizon: int = 5, folds: int = 5, least_rows: int = 80, least_share: float = 0.08, least_auc: float = 0.55) -> DataFrame:
    """A model for each symbol: symbol, i, prob_up (of a rise after its last bar), trained_rows, auc, horizon.

    Each of the last ``folds`` blocks of a symbol's rows is judged by a model
    of all rows before it; auc is the mean over the blocks that hold both
    classes after both classes.  prob_up is null with too few rows, too few
    of either class, a mean AUC under ``least_auc``, or a last bar without
    all features.  Symbols and blocks are fitted side by side: a task holds
    one symbol's rows up to one block.
    """
    rows = time_folds(_usable(ind, horizon), folds)
    # Block k is judged by what is before it; number folds + 1 is the model of all rows, for the last bar.
    first = F.greatest(F.col("fold"), F.lit(1))
    own = rows.withColumn("_model", F.explode(F.sequence(first, F.lit(folds + 1))))
    last = features(ind).select("symbol", "i", *FEATURES).join(ind.groupBy("symbol").agg(F.max("i").alias("i")), ["symbol", "i"])
    ask = last.withColumns({"label": F.lit(None).cast("int"), "fold": F.lit(folds + 1), "_model": F.lit(folds + 1)})

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)
        k, x, y = int(b["_model"].iloc[0]), b[list(FEATURES)].to_numpy(float), b["label"].to_numpy(float)
        train, test = b["fold"].to_numpy() < k, b["fold"].to_numpy() == k
        out = b.loc[test, ["symbol", "i", "label"]].assign(model=k, trained=int(train.sum()), p=np.nan)
        t, whole = y[train], ~np.isnan(x[test]).any(axis=1)
        if len(t) and 0 < t.mean() < 1 and whole.any():
            p = np.full(len(out), np.nan)
            p[whole] = boosting.Boosted(x[train], t).probability(x[test][whole])
            out["p"] = p
        return out

    judged = written(own.unionByName(ask).groupBy("symbol", "_model").applyInPandas(run, "symbol string, i int, label int, model int, trained int, p double"), "judged")
    tested = judged.where((F.col("model") <= folds) & F.col("p").isNotNull())
    mean = rank_auc(tested, ["symbol", "model"], "p").groupBy("symbol").agg(F.avg("auc").alias("auc"))
    size = rows.groupBy("symbol").agg(F.count("*").alias("trained_rows"), F.avg("label").alias("_share"))
    df = judged.where(F.col("model") == folds + 1).select("symbol", "i", "p").join(size, "symbol", "left").join(mean, "symbol", "left")
    able = (F.col("trained_rows") >= least_rows) & (F.least("_share", 1 - F.col("_share")) >= least_share) & (F.col("auc") >= least_auc)
    return df.select("symbol", "i", F.when(able, F.col("p")).alias("prob_up"), F.coalesce("trained_rows", F.lit(0)).alias("trained_rows"), "auc", F.lit(horizon).alias("horizon"))


#: Retrainings that one task does, one after the other.
RETRAININGS = 16


def replayed_probability(ind: DataFrame, horizon: int = 5, start: int = 250, every: int = 10, folds: int = 5, least_rows: int = 80, least_share: float = 0.08, least_auc: float = 0.55) -> DataFrame:
    """symbol, i, trained_i, prob_up at every bar from ``start`` on, as known at it.

    Every ``every`` bars a model is trained and judged on the bars so far,
    labels included: the last ``horizon`` ones, whose outcome isn't known yet,
    count as no rise.  What it says of that bar holds until the next training;
    null where the gate isn't passed.  A task does ``RETRAININGS`` of a symbol
    and holds its bars up to the last of them, so no later bar can be seen.
    """
    w = by_symbol()
    rows = features(ind).select("symbol", "i", *FEATURES, "close", F.max("i").over(Window.partitionBy("symbol")).alias("_last"))
    rows = rows.withColumn("_rise", F.coalesce((F.lead("close", horizon).over(w) > F.col("close")).cast("int"), F.lit(0)))
    span = every * RETRAININGS
    groups = F.floor((F.col("_last") - start) / span)
    from_ = F.greatest(F.floor((F.col("i") - start) / span), F.lit(0))
    dealt = rows.where(F.col("_last") >= start).withColumn("_group", F.explode(F.sequence(from_, groups)))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)
        at, x, rise = b["i"].to_numpy(), b[list(FEATURES)].to_numpy(float), b["_rise"].to_numpy(float)
        whole, first = ~np.isnan(x).any(axis=1), start + int(b["_group"].iloc[0]) * span
        out = []
        for t in range(first, min(first + span, int(at[-1]) + 1), every):
            known = whole & (at <= t)
            y = np.where(at[known] + horizon <= t, rise[known], 0.0)
            out.append((b["symbol"].iloc[0], t, _gated(x[known], y, x[at == t], folds, least_rows, least_share, least_auc)))
        return pd.DataFrame(out, columns=["symbol", "trained_i", "prob_up"]).astype({"trained_i": "int32", "prob_up": float})

    made = dealt.groupBy("symbol", "_group").applyInPandas(run, "symbol string, trained_i int, prob_up double")
    bars = ind.where(F.col("i") >= start).select("symbol", "i", (F.col("i") - F.pmod(F.col("i") - start, F.lit(every))).alias("trained_i"))
    return bars.join(made, ["symbol", "trained_i"]).select("symbol", "i", "trained_i", "prob_up")


def _gated(x: np.ndarray, y: np.ndarray, now: np.ndarray, folds: int, least_rows: int, least_share: float, least_auc: float) -> float | None:
    if len(y) < least_rows or min(y.mean(), 1 - y.mean()) < least_share or not len(now) or np.isnan(now).any():
        return None
    found = []
    for a, z in boosting.blocks(len(y), folds):
        if 0 < y[:a].mean() < 1 and 0 < y[a:z].mean() < 1:
            found.append(boosting.auc(boosting.Boosted(x[:a], y[:a]).probability(x[a:z]), y[a:z]))
    if not found or np.mean(found) < least_auc:
        return None
    return float(boosting.Boosted(x, y).probability(now)[0])


def component_matrix(m) -> DataFrame:
    """Bull components and the outcome of a long trade entered at the close, at each bar that has a plan and a horizon ahead of it."""
    cfg = m.cfg
    at_close = m.ind.withColumns({"entry_px": F.col("close"), "entry_off": F.lit(-1)})
    out = trades.outcomes(trades.plans(at_close, m.order_blocks, m.pools, cfg), cfg).where("long_stop IS NOT NULL")
    last = m.bars.groupBy("symbol").agg(F.max("i").alias("_last"))
    out = out.join(F.broadcast(last), "symbol").where((F.col("i") >= max(cfg.warmup, 30)) & (F.col("i") <= F.col("_last") - cfg.horizon))
    c = m.scores.select("symbol", "i", *(F.col(f"bull_{n}").cast("double").alias(f"c_{n}") for n in COMPONENTS))
    return c.join(out.select("symbol", "i", F.col("long_ret").alias("ret"), F.col("long_bars").alias("bars")), ["symbol", "i"])


def embargo_split(rows: DataFrame, train_share: float = 0.6, embargo: int = 20) -> DataFrame:
    """part: train, skipped (as long as a trade may last) or test, by position in the symbol's rows."""
    w = Window.partitionBy("symbol")
    k, cut = F.row_number().over(w.orderBy("i")) - 1, F.floor(F.count("*").over(w) * train_share)
    return rows.withColumn("part", F.when(k < cut, "train").when(k < cut + embargo, "skipped").otherwise("test"))


def _sums() -> tuple[list[str], list[tuple[str, str]], dict]:
    cols = [f"c_{n}" for n in COMPONENTS]
    named = {"one": F.lit(1.0), **{c: F.col(c) for c in cols}, "ret": F.col("ret")}
    names = list(named)
    return names, [(a, b) for k, a in enumerate(names) for b in names[k:]], named


def gram(matrix: DataFrame) -> DataFrame:
    """a, b, value: sums of products of components, the constant and the return, over all rows; one small table at any size."""
    _, pairs, named = _sums()
    sums = matrix.agg(*(F.sum(named[a] * named[b]).alias(f"{a}|{b}") for a, b in pairs))
    out = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs)))
    return sums.select(out.alias("s")).select("s.*")


def _solved(g: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge coefficients of the components, the constant left free, from the sums of products."""
    penalty = np.diag([0.0] + [ridge] * len(COMPONENTS))
    return np.linalg.lstsq(g[:-1, :-1] + penalty, g[:-1, -1], rcond=None)[0][1:]


def _scaled(w: np.ndarray) -> np.ndarray:
    """Without negative ones, to a sum of 100; all 0 if none is positive."""
    kept = np.maximum(w, 0)
    return kept / kept.sum() * 100 if kept.sum() > 0 else np.zeros_like(kept)


def ridge_weights(matrix: DataFrame, ridge: float = 10.0) -> DataFrame:
    """Component weights by ridge regression of the return, negative ones cut off, scaled to 100; all 0 if none is positive."""
    names, _, _ = _sums()
    g = np.zeros((len(names), len(names)))
    for r in gram(matrix).collect():  # 78 sums
        i, j = names.index(r["a"]), names.index(r["b"])
        g[i, j] = g[j, i] = r["value"] or 0.0
    w = _solved(g, ridge)
    return matrix.sparkSession.createDataFrame(pd.DataFrame({"component": COMPONENTS, "coefficient": w, "weight": _scaled(w)}))


def fitted_by_symbol(train: DataFrame, ridge: float = 1.0) -> DataFrame:
    """symbol, weights: an array in the order of COMPONENTS, from each symbol's own sums of products."""
    names, pairs, named = _sums()
    sums = train.groupBy("symbol").agg(F.array(*(F.sum(named[a] * named[b]) for a, b in pairs)).alias("sums"))

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        at = np.array([(names.index(a), names.index(b)) for a, b in pairs]).T
        out = []
        for x in sums:
            g = np.zeros((len(names), len(names)))
            g[at[0], at[1]] = g[at[1], at[0]] = x
            out.append(_scaled(_solved(g, ridge)))
        return pd.Series(out, dtype=object)

    return sums.select("symbol", solve("sums").alias("weights"))


def random_by_symbol(symbols: DataFrame, seed: int = 42) -> DataFrame:
    """Control: weights by hashes of symbol, component and seed, to a sum of 100."""
    u = F.array(*(F.pmod(F.xxhash64("symbol", F.lit(c), F.lit(seed)), F.lit(1_000_003)) / 1_000_003 for c in COMPONENTS))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return symbols.select("symbol", u.alias("u")).select("symbol", F.transform("u", lambda x: x / total(F.col("u")) * 100).alias("weights"))


def weight_trial(matrix: DataFrame, cfg, ridge: float = 1.0, least_rows: int = 400, least_part: int = 200) -> DataFrame:
    """symbol, kind (manual, fitted, random), threshold, n, expectancy, excess.

    Weights are fitted and thresholds chosen on the first part of a symbol's
    rows and tried on the last, which begins as many rows on as a trade may
    last.  matrix: components, ret after cost and bars, by symbol and i.
    Symbols with too few rows, and kinds of weights without enough trades,
    have no row.
    """
    rows = embargo_split(matrix, 0.6, cfg.trailing_max_holding if cfg.exit_mode == "trailing" else cfg.max_holding)
    size = rows.groupBy("symbol").agg(F.count("*").alias("_n"), *(F.count_if(F.col("part") == p).alias(f"_{p}") for p in ("train", "test")))
    able = size.where((F.col("_n") >= least_rows) & (F.col("_train") >= least_part) & (F.col("_test") >= least_part)).select("symbol")
    rows = rows.join(F.broadcast(able), "symbol").where("part <> 'skipped'")
    manual = F.array(*(F.lit(float(cfg.weights[c])) for c in COMPONENTS))
    weights = fitted_by_symbol(rows.where("part = 'train'"), ridge).withColumn("kind", F.lit("fitted")).unionByName(
        random_by_symbol(able).withColumn("kind", F.lit("random"))
    ).unionByName(able.select("symbol", manual.alias("weights"), F.lit("manual").alias("kind")))
    score = F.aggregate(F.zip_with(F.array(*(F.col(f"c_{n}") for n in COMPONENTS)), "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    # Trades are counted in rows of the matrix, as a bar without a plan has none.
    at = (F.row_number().over(Window.partitionBy("symbol", "part").orderBy("i")) - 1).cast("int")
    numbered = rows.withColumn("at", at).join(weights, "symbol").select("symbol", "kind", "part", F.col("at").alias("i"), F.col("bars").cast("int").alias("bars"), "ret", score.alias("score"))
    taken = replay.one_at_a_time(numbered, ["symbol", "kind", "part"], cfg.thresholds)
    stats = taken.groupBy("symbol", "kind", "part", "threshold").agg(F.count("*").alias("n"), F.avg("ret").alias("expectancy"))
    least = max(cfg.min_trades // 2, 15)
    best = stats.where((F.col("part") == "train") & (F.col("n") >= least)).groupBy("symbol", "kind").agg(
        F.max_by("threshold", F.struct("expectancy", (-F.col("threshold")).alias("low"))).alias("threshold")
    )
    base = rows.where("part = 'test'").groupBy("symbol").agg(F.avg("ret").alias("_base"))
    tried = stats.where((F.col("part") == "test") & (F.col("n") >= max(least // 2, 8)))
    out = best.join(tried, ["symbol", "kind", "threshold"]).join(base, "symbol")
    return out.select("symbol", "kind", "threshold", "n", "expectancy", (F.col("expectancy") - F.col("_base")).alias("excess"))


def weight_verdict(trial: DataFrame) -> DataFrame:
    """By kind of weights, over the symbols where all three were tried: how often it was best, and the middle of its excess."""
    w = Window.partitionBy("symbol")
    full = trial.withColumns({"_k": F.count("*").over(w), "_best": F.max(F.struct("excess", "kind")).over(w)}).where("_k = 3")
    return full.groupBy("kind").agg(
        F.count("*").alias("n_symbols"), F.count_if(F.col("kind") == F.col("_best.kind")).alias("wins"),
        F.percentile("excess", 0.5).alias("median_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("share_positive"),
    )
