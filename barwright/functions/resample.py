"""Bootstrap bounds of means as sums that Spark can merge.

Resample b counts row i a number of times that is Poisson with mean 1, drawn
from a hash of i and b.  A resample's mean is the sum of what it counts over
how often it counts anything, so a group needs two sums for each resample,
from any number of tasks, in any order; its rows never meet.  The hash is
integer arithmetic below 2^62, which other engines can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the hash: a prime under 2^31, factors of row and resample, an offset; and how many different draws there are.
PRIME, ROW, RESAMPLE, OFFSET, DRAWS = (1 << 31) - 1, 1_000_003, 7_368_787, 12_345, 1 << 20
_GROUPS = 256


def poisson_steps() -> list[int]:
    """The draws from which on a row counts once, twice, and so on."""
    p, total, out = np.exp(-1.0), 0.0, []
    for k in range(1, 12):
        total += p
        out.append(int(np.ceil(total * DRAWS)))
        p /= k
    return [x for x in out if x < DRAWS]


def counts(rows: np.ndarray, resamples: int) -> np.ndarray:
    """How often each resample (column) counts each row number."""
    i, b = rows.astype(np.int64)[:, None], np.arange(resamples, dtype=np.int64)[None, :]
    x = (i * ROW + b * RESAMPLE + OFFSET) % PRIME
    x = (x * x + i) % PRIME
    x = (x * x + b) % PRIME
    return np.searchsorted(np.array(poisson_steps()), x % DRAWS, side="right")


def mean_bounds(df: DataFrame, keys: list[str], row: str, value: Column, alpha: float | Column, resamples: int = 2000, least: int = 2) -> DataFrame:
    """keys, n and mean_lb: the alpha quantile (interpolated) of the resampled means; null under ``least`` values.

    row: a column of whole numbers from 0 to 10^12 that tells a group's rows
    apart.  Nulls in ``value`` don't count.  A resample that counts nothing
    has no mean; of thirty rows that is one in 10^13.
    """
    if any(k in ("n", "mean_lb", "_b") for k in keys):
        raise ValueError("keys may not be called n, mean_lb or _b")
    given = df.select(*keys, F.col(row).cast("long").alias("_row"), value.cast("double").alias("_x")).where("_x IS NOT NULL")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, n, s.tolist(), t.tolist()) for k, (n, s, t) in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=[*keys, "n", "_s", "_t"])

        for batch in batches:
            for key, g in batch.groupby(keys, dropna=False, sort=False):
                own = sums.setdefault(key, [0, np.zeros(resamples, np.int64), np.zeros(resamples)])
                for a in range(0, len(g), 512):
                    x = g["_x"].to_numpy()[a : a + 512]
                    w = counts(g["_row"].to_numpy()[a : a + 512], resamples)
                    own[0] += len(x)
                    own[1] += w.sum(axis=0)
                    own[2] += x @ w
                if len(sums) >= _GROUPS:
                    yield out()
        yield out()

    parts = given.mapInPandas(run, f"{types}, n long, _s array<long>, _t array<double>")
    size = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    each = parts.select(*keys, F.posexplode(F.arrays_zip("_s", "_t")).alias("_b", "_p")).groupBy(*keys, "_b").agg(F.sum("_p._s").alias("_s"), F.sum("_p._t").alias("_t"))
    low = each.groupBy(*keys).agg(F.percentile(F.col("_t") / F.nullif("_s", F.lit(0)), F.lit(alpha)).alias("mean_lb"))
    on = [size[k].eqNullSafe(low[k]) for k in keys]
    return size.join(low, on).select(*(size[k] for k in keys), "n", F.when(F.col("n") >= least, F.col("mean_lb")).alias("mean_lb"))

