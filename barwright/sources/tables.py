"""Bars from the driver tables, and readers of the small state files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import round_trip_cost
from ..operators.bars import bars_from_ticks, index_bars, resample

POSITIONS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("entry_date", T.StringType()),
    T.StructField("entry_price", T.DoubleType()), T.StructField("stop", T.DoubleType()),
])
ALERTS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("side", T.StringType()), T.StructField("at", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("threshold", T.IntegerType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick for each line item: its brand, ship date and unit price, with a full tie-break."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return items.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.struct(*cols).alias("seq"),
    )


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand, numbered from 0."""
    return index_bars(bars_from_ticks(brand_ticks(spark, sf_dir), "1 day"))


def event_bars(spark: SparkSession, sf_dir: str, rule: str = "1 hour") -> DataFrame:
    """Hourly bars by event type; volume counts events."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"),
        F.struct("ts", "event_id").alias("seq"),
    )
    return index_bars(bars_from_ticks(ticks, rule))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from files with the named columns; a symbol may come from a partition folder."""
    df = spark.read.format(fmt).options(header="true").load(path)
    names = {c.lower(): c for c in df.columns}
    missing = [c for c in ("symbol", "ts", "open", "high", "low", "close") if c not in names]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    volume = F.col(names["volume"]) if "volume" in names else F.lit(None)
    return df.select(
        F.col(names["symbol"]).cast("string").alias("symbol"), F.col(names["ts"]).cast("timestamp_ntz").alias("ts"),
        *(F.col(names[c]).cast("double").alias(c) for c in ("open", "high", "low", "close")), volume.cast("double").alias("volume"),
    )


def flat_names(df: DataFrame) -> DataFrame:
    """Columns called like ``Open.AAA`` or ``('Open', 'AAA')`` get the first part, in lower case."""
    first = lambda c: c.strip("()").split(",")[0].split(".")[0].strip("' \"").lower()
    names = [first(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns would be equal: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def read_symbol_files(spark: SparkSession, folder: str, fmt: str = "parquet", limit: int | None = None) -> DataFrame:
    """Bars of a folder with a file for each symbol, named by it: ``2330_TW.parquet`` holds 2330.TW.  limit: so many symbols, in order."""
    df = spark.read.format(fmt).options(header="true", inferSchema="true" if fmt == "csv" else "false").load(f"{folder}/*")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    named = df.withColumn("barwright_symbol", F.replace(stem, F.lit("_"), F.lit("."))).drop("symbol").withColumnRenamed("barwright_symbol", "symbol")
    bars = flat_names(named)
    if limit is not None:
        bars = bars.join(F.broadcast(bars.select("symbol").distinct().orderBy("symbol").limit(limit)), "symbol")
    return bars


def patiently(read: Callable[[], DataFrame], retries: int = 3, backoff: float = 2.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """What ``read`` gives, tried again after 1, ``backoff``, ``backoff`` ** 2 ... seconds while it fails or is empty."""
    last: Exception | None = None
    for k in range(retries):
        try:
            df = read()
            if not df.isEmpty():
                return df
            last = None
        except Exception as e:  # whatever the source raises
            last = e
        if k + 1 < retries:
            wait(backoff**k)
    raise RuntimeError(f"no rows after {retries} tries") from last


def universe(spark: SparkSession, entries: list[dict], limit: int | None = None) -> DataFrame:
    """symbol, name, etf and round-trip cost of the listed symbols, by symbol; a name is the symbol's own if none is given."""
    rows = sorted((str(e["symbol"]), str(e.get("name") or e["symbol"]), bool(e.get("etf", False))) for e in entries)
    df = spark.createDataFrame(rows[:limit], "symbol string, name string, etf boolean")
    return df.withColumn("cost", round_trip_cost(F.col("symbol"), F.col("etf")))


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, null where it is NaN or the table lacks it."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    c = F.col(name).cast(kind)
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects with a symbol in a JSON list; a missing or broken file gives none, a broken element only loses itself."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    # Elements are taken as text first, so that one of another kind doesn't spoil the list.
    each = text.select(F.explode(F.from_json("value", "array<string>")).alias("e"))
    rows = each.select(F.from_json("e", schema).alias("r")).select("r.*")
    return rows.where(F.length("symbol") > 0)


__all__ = ["ALERTS", "POSITIONS", "brand_bars", "brand_ticks", "event_bars", "read_bars", "read_state", "resample", "table"]
