"""Result files: JSON documents, cached tables by fingerprint, state."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def backtest_documents(picks: DataFrame, summary: DataFrame) -> DataFrame:
    """symbol, document: one JSON object a symbol with its choice and performance by side; sweeps and single trades are left out."""
    rows = picks.join(summary, ["symbol", "side"], "left")
    doc = F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", F.struct(*(c for c in rows.columns if c not in ("symbol", "side")))))))
    return rows.groupBy("symbol").agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def save_state(df: DataFrame, path: str) -> bool:
    """Writes state as JSON lines; a failure only warns, as alerts that are out can't be taken back."""
    try:
        df.write.mode("overwrite").json(path)
    except Exception as e:  # whatever the store raises
        warnings.warn(f"state was not saved: {e}", stacklevel=2)
        return False
    return True


def write_cached(df: DataFrame, path: str, fingerprint: str, at: str) -> None:
    """Replaces the partitions of the symbols in ``df`` under this fingerprint and leaves the others."""
    out = df.withColumns({"fp": F.lit(fingerprint), "computed_at": F.lit(at).cast("timestamp_ntz")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fp", "symbol").parquet(path)


def fresh(cached: DataFrame, fingerprint: str, now: str, max_days: int) -> DataFrame:
    """Cached rows of this fingerprint that are younger than ``max_days``; 0 days turn the cache off."""
    age = F.timestamp_diff("SECOND", F.col("computed_at"), F.lit(now).cast("timestamp_ntz"))
    return cached.where((F.col("fp") == fingerprint) & (age < max_days * 86_400) & F.lit(max_days > 0))


def to_recompute(symbols: DataFrame, cached: DataFrame, fingerprint: str, now: str, max_days: int) -> DataFrame:
    """Symbols without a fresh cached result."""
    return symbols.join(fresh(cached, fingerprint, now, max_days).select("symbol").distinct(), "symbol", "left_anti")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
