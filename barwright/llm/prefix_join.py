"""Candidates for links between full sets, by a prefix filter: exact, whatever the sizes of groups.

All sets order their shingles alike, rare ones first.  Two sets of at least
``percent`` similarity share a shingle among the first n - ceil(percent * n /
100) + 1 of each, and at the first one they share, what is left of both must
still reach the overlap that the similarity needs.  Rarity is read from a
table of counts by hash, whose size doesn't depend on the input; any order is
right, as long as it is the same for all sets.

A shingle whose holders all belong to one component gives no pairs.  Holders
of a frequent shingle are dealt into blocks, those of its largest component
apart from the others, and each two blocks that may hold different components
meet under a key of their own.  So no pair is left out, no task gets all
holders, and the members of one large component aren't copied for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, cut

#: Counts are kept for 2 ** BITS classes of hashes (4 bytes each, broadcast).
BITS = 20
#: Holders of one shingle that meet under one key.
BLOCK = 256
_FLUSH = 200_000


def _class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles of each class occur in the sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = np.zeros(1 << BITS, np.int64)
        for b in batches:
            found = [_class_of(np.frombuffer(s, np.uint64)) for s in b["set"]]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                many[at] += n
        at = np.flatnonzero(many)
        yield pd.DataFrame({"at": at, "n": many[at]})

    at, n = arrays(sets.select("set").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")))
    out = np.zeros(1 << BITS, np.int64)
    out[at] = n
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets: node, component, set.  shingle, node, n, place, component of each set's prefix."""
    given = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = given.value
        for b in batches:
            held, size = [], 0
            for node, component, s in zip(b["node"], b["component"], b["set"], strict=True):
                h = np.frombuffer(s, np.uint64)
                n = len(h)
                k = n - -(-percent * n // 100) + 1
                first = h[np.lexsort((h, many[_class_of(h)]))[:k]].view(np.int64)
                held.append(pd.DataFrame({"shingle": first, "node": node, "n": n, "place": np.arange(len(first)), "component": component}))
                size += len(first)
                if size > _FLUSH:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

    return sets.select("node", "component", "set").mapInPandas(run, "shingle long, node long, n long, place long, component long")


def pairs_apart(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v of different components that may be similar enough; none that is is missing."""
    rows = cut(prefixes(sets, percent), "prefixes")
    by = rows.groupBy("shingle", "component").agg(F.count("*").alias("_n"))
    shared = by.groupBy("shingle").agg(F.sum("_n").alias("_m"), F.count("*").alias("_c"), F.max(F.struct("_n", "component")).alias("_top")).where("_c > 1")
    one = F.col("_m") <= BLOCK
    blocks = lambda n: F.when(one, 0).otherwise(F.ceil(n / BLOCK)).cast("long")
    shared = shared.select("shingle", F.col("_top.component").alias("_of"), blocks(F.col("_m") - F.col("_top._n")).alias("_rest"), blocks(F.col("_top._n")).alias("_big"))
    shared = cut(shared, "shared")  # both sides are then written tables, whose hot keys Spark can split
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    top = (F.col("component") == F.col("_of")) & (F.col("_big") > 0)
    rows = rows.join(shared, "shingle").withColumns({
        "_s": F.when(top, F.col("_rest") + deal(F.col("_big"))).otherwise(deal(F.col("_rest"))),  # the largest component's blocks come last
        "_to": F.greatest(F.when(top, F.col("_rest")).otherwise(F.col("_rest") + F.col("_big")), F.lit(1)),
    })
    rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to") - 1)))
    rows = cut(rows.withColumns({"_x": F.least("_s", "_t"), "_y": F.greatest("_s", "_t")}).drop("_t", "_to", "_rest", "_big", "_of"), "blocks")
    a = rows.where("_s = _x").select("shingle", "_x", "_y", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "place", "component")))
    b = rows.where("_s = _y").select("shingle", "_x", "_y", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "component")))
    most = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))  # overlap from the shared shingle on
    fits = (100 + percent) * most >= percent * (F.col("n1") + F.col("n2"))
    met = a.join(b, ["shingle", "_x", "_y"]).where((F.col("component1") != F.col("component2")) & fits & ((F.col("_x") < F.col("_y")) | (F.col("node1") < F.col("node2"))))
    return met.select(
        F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v"),
        F.when(F.col("node1") < F.col("node2"), F.col("n1")).otherwise(F.col("n2")).alias("n1"),
        F.when(F.col("node1") < F.col("node2"), F.col("n2")).otherwise(F.col("n1")).alias("n2"),
    ).distinct()
