"""Classic indicators, one row a bar.

``compute`` brings all exponential means up in one pass a symbol with
grouped pandas, which needs one sort and no self-joins; each is also there
on its own as window functions (functions/recur.py), and the tests hold the
two against each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recur import ewm
from .bars import by_symbol

COLUMNS = (
    "rsi", "macd_line", "macd_signal", "macd_hist", "ema20", "ema50", "ema200", "adx", "plus_di", "minus_di", "atr", "obv",
)


def ema(bars: DataFrame, span: int, out: str, x: str = "close") -> DataFrame:
    return ewm(bars, F.col(x), 2 / (span + 1), out)


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_symbol())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return ewm(true_range(bars), F.col("tr"), 1 / n, "atr")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """50 where there is no history yet, or no loss to divide by."""
    d = F.col("close") - F.lag("close").over(by_symbol())
    df = bars.withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
    df = df.withColumns({c: F.when(F.col("i") > 0, F.col(c)) for c in ("_g", "_l")})
    df = ewm(ewm(df, F.col("_g"), 1 / n, "_eg"), F.col("_l"), 1 / n, "_el")
    value = 100 - 100 / (1 + F.col("_eg") / F.nullif("_el", F.lit(0.0)))
    return df.withColumn("rsi", F.coalesce(F.when(F.col("i") >= n, value), F.lit(50.0))).drop("_g", "_l", "_eg", "_el")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(bars, fast, "_f"), slow, "_s").withColumn("macd_line", F.col("_f") - F.col("_s"))
    df = ema(df, signal, "macd_signal", "macd_line")
    return df.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("_f", "_s")


def obv(bars: DataFrame) -> DataFrame:
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_symbol())), F.lit(0.0))
    df = bars.withColumn("_v", sign * F.col("volume"))
    return df.withColumn("obv", F.sum("_v").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_v")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    w = by_symbol()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = atr(bars, n).withColumns({
        "_pm": F.when((up > down) & (up > 0), up).otherwise(0.0), "_mm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    df = ewm(ewm(df, F.col("_pm"), 1 / n, "_p"), F.col("_mm"), 1 / n, "_m")
    a = F.nullif("atr", F.lit(0.0))
    df = df.withColumns({"plus_di": 100 * F.col("_p") / a, "minus_di": 100 * F.col("_m") / a})
    both = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    df = ewm(df, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both, 1 / n, "adx")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("adx", "plus_di", "minus_di")}
    return df.withColumns(zero).drop("_pm", "_mm", "_p", "_m", "tr")


def rolling(bars: DataFrame, x: str, n: int = 20) -> DataFrame:
    """Mean, deviation and z-score of the last n values, null before there are n."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    full = F.count(x).over(w) == n
    df = bars.withColumns({"mean": F.when(full, F.avg(x).over(w)), "std": F.when(full, F.stddev_samp(x).over(w))})
    return df.withColumn("z", (F.col(x) - F.col("mean")) / F.nullif("std", F.lit(0.0)))


def range_position(bars: DataFrame, n: int = 50) -> DataFrame:
    """Distance of the close from the middle of the last n bars' range, in ranges."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    full = F.count("close").over(w) == n
    df = bars.withColumns({"_hi": F.when(full, F.max("high").over(w)), "_lo": F.when(full, F.min("low").over(w))})
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.withColumn("dist_to_discount", (F.col("close") - (F.col("_hi") + F.col("_lo")) / 2) / span).drop("_hi", "_lo")


def _mean(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _all(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    n, a = len(close), 1 / 14
    d = np.diff(close, prepend=np.nan)
    gain, loss = (_mean(np.where(np.isnan(d), np.nan, np.maximum(s * d, 0)), a) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi_ = np.where((np.arange(n) >= 14) & (loss != 0), 100 - 100 / (1 + gain / loss), 50.0)
        before = np.roll(close, 1)
        before[:1] = np.nan
        tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        atr_ = _mean(tr, a)
        up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
        plus, minus = (_mean(np.where((x > y) & (x > 0), x, 0.0), a) for x, y in ((up, down), (down, up)))
        base = np.where(atr_ == 0, np.nan, atr_)
        pdi, mdi = 100 * plus / base, 100 * minus / base
        both = np.where(pdi + mdi == 0, np.nan, pdi + mdi)
        adx_ = _mean(100 * np.abs(pdi - mdi) / both, a)
    line = _mean(close, 2 / 13) - _mean(close, 2 / 27)
    signal = _mean(line, 2 / 10)
    values = (
        rsi_, line, signal, line - signal, *(_mean(close, 2 / (s + 1)) for s in (20, 50, 200)),
        *(np.nan_to_num(x) for x in (adx_, pdi, mdi)), atr_, np.cumsum(np.sign(np.nan_to_num(d)) * volume),
    )
    return dict(zip(COLUMNS, values, strict=True))


def compute(bars: DataFrame) -> DataFrame:
    """Bars with the twelve columns of COLUMNS."""
    fields = bars.drop(*COLUMNS).schema.fields
    names = [f.name for f in fields]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", ignore_index=True)
        return b[names].assign(**_all(*(b[c].to_numpy(float) for c in ("high", "low", "close", "volume"))))

    types = [f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{c} double" for c in COLUMNS]
    return bars.groupBy("symbol").applyInPandas(run, ", ".join(types))


def confluence(ind: DataFrame, adx_threshold: float = 20.0) -> DataFrame:
    """n_bull, n_bear: how many of RSI, MACD, averages and directional index point each way."""
    c = F.col
    trending = c("adx") >= adx_threshold
    bull = [c("rsi") > 50, c("macd_hist") > 0, (c("ema20") > c("ema50")) & (c("ema50") > c("ema200")), trending & (c("plus_di") > c("minus_di"))]
    bear = [c("rsi") < 50, c("macd_hist") < 0, (c("ema20") < c("ema50")) & (c("ema50") < c("ema200")), trending & (c("plus_di") <= c("minus_di"))]
    count = lambda xs: sum((x.cast("int") for x in xs[1:]), xs[0].cast("int"))
    return ind.withColumns({"n_bull": count(bull), "n_bear": count(bear)})
