"""Exact token-length histogram (operator 4).

Every whole text is encoded once; documents are counted by length, and
sums from the longest length downwards answer totals, quantiles and
truncated totals for every context limit without going back to the texts.

Null and empty texts have length 0.  Repeated rows count each time, documents
of equal length in one row.  Very long texts are encoded whole, one at a time.
An empty table gives an empty histogram.  Only the text column is read, so
other columns can't clash.  The histogram has at most as many rows as there
are different lengths; its sums run over blocks of lengths, then over the
blocks' totals, so that no task holds all of it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches


@cache
def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("listed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: Column | str, vocabulary: str, pattern: str) -> Column:
    """Tokens of each text under a byte-level BPE vocabulary of ranks; null: 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs."""
    small_batches(docs.sparkSession)
    lengths = docs.select(encoded_length(F.col(text), vocabulary, pattern).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_sums(hist: DataFrame, block: int = 4096) -> DataFrame:
    """Adds to each length, taken as a context limit L, what follows from sums over longer ones.

    docs_at_least, tokens_at_least: documents of L tokens or more and their
    tokens; docs_over: those longer than L; truncated_tokens: total if each
    document is cut to L tokens; n_docs_total, n_tokens_total: of the corpus;
    quantile: share of documents no longer than L.
    """
    per = hist.withColumns({"_block": F.floor(F.col("n_tokens") / block), "_t": F.col("n_tokens") * F.col("n_docs")})
    down = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each block of lengths: max length / block rows at most.
    totals = per.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_bt"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_bt").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(every).alias("n_docs_total"),
        F.sum("_bt").over(every).alias("n_tokens_total"),
    )
    out = per.withColumns({"_dd": F.sum("n_docs").over(down), "_td": F.sum("_t").over(down)}).join(totals, "_block")
    out = out.withColumns(
        {"docs_at_least": F.col("_dd") + F.col("_docs_above"), "tokens_at_least": F.col("_td") + F.col("_tokens_above")}
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        longer.alias("docs_over"),
        (F.col("n_tokens_total") - F.col("tokens_at_least") + F.col("_t") + longer * F.col("n_tokens")).alias("truncated_tokens"),
        "n_docs_total", "n_tokens_total",
        ((F.col("n_docs_total") - longer) / F.col("n_docs_total")).alias("quantile"),
    )


def context_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any limits, occurring as lengths or not: docs_over, tokens kept and cut off."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # The shortest length over the limit carries all that is needed.
    total = sums.agg(F.max("n_docs_total").alias("n_docs_total"), F.max("n_tokens_total").alias("n_tokens_total"))
    next_up = (
        F.broadcast(asked).join(sums.select("n_tokens", "docs_at_least", "tokens_at_least"), F.col("n_tokens") > F.col("context_limit"), "left")
        .groupBy("context_limit")
        .agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s"))
    )
    over, tokens = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    return next_up.crossJoin(F.broadcast(total)).select(
        "context_limit", over.alias("docs_over"),
        (F.col("n_tokens_total") - tokens + over * F.col("context_limit")).alias("truncated_tokens"),
        (tokens - over * F.col("context_limit")).alias("cut_tokens"), "n_docs_total", "n_tokens_total",
    )


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length with at least that share of documents no longer than it."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    return (
        F.broadcast(asked).join(sums.select("n_tokens", "quantile"), F.col("quantile") >= F.col("share"), "left")
        .groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    )
