"""Cross-site boilerplate lines by distinct-site spread (operator 7).

Each line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation.  Estimates clearly under or over the threshold decide
at once; lines near it get an exact distinct count.  A line on ``min_sites``
sites or more is boilerplate: it is removed everywhere but at its first
occurrence (lowest doc_id, then position), so that no text is lost.

Lines are cut at newlines and compared as they are.  Lines without a word
are never boilerplate and stay.  A null text has no lines and stays null; a
null site counts as one site of its own.  Repeated rows share their keys and
are treated alike; documents with equal ids but different texts are kept
apart by keys over id and text.  Of a line's occurrences with equal ids the
one of the lower key is first.  A very long text is cut as one row.  Empty
tables give empty tables.  Other columns pass unchanged, but for n_lines and
n_removed, which are replaced if ``docs`` has them (``without_boilerplate``
adds neither); names that begin with _barwright_ are reserved.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

#: A word is a run of anything but the six ASCII blanks.
_WORD = r"[^\x20\x09-\x0D]"
#: Rows of at most some 60 bytes that may be broadcast; longer lists are joined with salted keys.
MAX_BROADCAST_LINES = 200_000
SALTS = 32


def doc_keys(text: Column, doc_id: Column) -> list[Column]:
    """Two hashes of id and text, never null."""
    key = row_key(doc_id, text)
    return [key["a"].alias("_barwright_a"), key["b"].alias("_barwright_b")]


def _lines(docs: DataFrame, site: str) -> DataFrame:
    site_key = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("-"))
    lines = docs.select("doc_id", site_key.alias("_site"), *doc_keys(F.col("text"), F.col("doc_id")), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    return lines.where(F.col("_line").rlike(_WORD)).select(
        F.unhex(F.md5("_line")).alias("line_key"), "_site", F.struct("doc_id", "_barwright_a", "_barwright_b", F.col("_pos")).alias("_at")
    )


def line_spread(docs: DataFrame, site: str = "source", lg_k: int = 10) -> DataFrame:
    """line_key, n_lines, first occurrence and estimated number of sites."""
    return (
        _lines(docs, site).groupBy("line_key")
        .agg(F.hll_sketch_agg("_site", F.lit(lg_k)).alias("_sketch"), F.count("*").alias("n_occurrences"), F.min("_at").alias("first"))
        .select("line_key", "n_occurrences", "first", F.hll_sketch_estimate("_sketch").alias("sites_estimate"))
    )


def boilerplate_lines(docs: DataFrame, min_sites: int, site: str = "source", lg_k: int = 10, margin: float = 0.2) -> DataFrame:
    """line_key and first occurrence of the lines on ``min_sites`` sites or more.

    With ``lg_k`` of 10 the standard error is under 3 %, so that a margin of
    20 % is some seven standard errors.
    """
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    # A line can't be on more sites than it has occurrences.
    near_or_over = cut(
        line_spread(docs, site, lg_k).where((F.col("sites_estimate") >= low) & (F.col("n_occurrences") >= min_sites)), "spread"
    )
    near = near_or_over.where(F.col("sites_estimate") <= high)
    sites = _lines(docs, site).select("line_key", "_site").distinct()  # before the join, so that no line is hot in it
    exact = (
        sites.join(near.select("line_key"), "line_key", "left_semi").groupBy("line_key").count().where(F.col("count") >= min_sites)
    )
    over = near_or_over.where(F.col("sites_estimate") > high).select("line_key", "first")
    return over.unionByName(near.join(exact, "line_key", "left_semi").select("line_key", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int, site: str = "source", lg_k: int = 10, margin: float = 0.2) -> DataFrame:
    """docs with those lines cut out of ``text``; n_lines and n_removed are added."""
    listed = cut(boilerplate_lines(docs, min_sites, site, lg_k, margin), "boilerplate")
    lines = _lines(docs, site)
    if listed.count() <= MAX_BROADCAST_LINES:
        found = lines.join(F.broadcast(listed), "line_key")
    else:
        salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int")).join(salted, ["line_key", "_salt"])
    at = found.where(~F.col("_at").eqNullSafe(F.col("first"))).select(
        F.col("_at._barwright_a"), F.col("_at._barwright_b"), F.col("_at._pos")
    )
    cuts = at.groupBy("_barwright_a", "_barwright_b").agg(F.collect_set("_pos").alias("_barwright_cut"))
    df = docs.select("*", *doc_keys(F.col("text"), F.col("doc_id"))).join(cuts, ["_barwright_a", "_barwright_b"], "left")
    parts, gone = F.split("text", "\n"), F.col("_barwright_cut")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    # transform() gets the lines as an argument, so they are cut once for each text.
    kept = F.expr("array_join(transform(_barwright_left, i -> _barwright_parts[i]), '\n')")
    df = df.withColumns({
        "_barwright_parts": F.when(gone.isNotNull(), parts),
        "_barwright_left": F.when(gone.isNotNull(), left),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long"),
    })
    df = df.withColumns({
        "text": F.when(gone.isNotNull(), kept).otherwise(F.col("text")),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    })
    return df.drop(*(f"_barwright_{c}" for c in ("a", "b", "cut", "parts", "left")))


def without_boilerplate(docs: DataFrame, min_sites: int, **how) -> DataFrame:
    """docs with its own columns, less those lines and less the documents of which no word is left."""
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_barwright_row")
    left = remove_boilerplate(docs.select("doc_id", "text", "source", held), min_sites, **how)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    return left.select(*(F.col("text") if c == "text" else F.col("_barwright_row")[c].alias(c) for c in docs.columns))
