"""Near-duplicate documents by a MinHash LSH forest (operator 1).

A document's set is its distinct 2-word (or longer) shingles after A-Z are
lowered; with fewer words, the whole sequence is one shingle.  Documents with
equal sets meet by fingerprint.  Of the different sets, each has a signature
of minima, and each tree of the forest sorts the signatures from another
place on, as a cyclic order.  Neighbours in a sorted order with the longest
common prefixes are candidates.  For near neighbours, a region (the signatures with
a common prefix of ``min_depth`` minima) with more than ``region`` members is
divided by one more minimum, as often as needed up to the label's depth, and
what is still larger into chunks that are linked by their first members.

Candidates are compared by their full sets: linked if
100 * intersection >= 100 * similarity * union.  Where a region still holds
members of different components after that, and in all regions that had to be
divided, the members are joined on the rare shingles of their full sets (see
prefix_join), which finds all their links.  So no pair of a region of
``min_depth`` minima is lost, however many members it has, only pairs that
share such a region in none of the trees (about 1 in 5000 at a similarity of
exactly 0.8).  Shingles are compared as 64-bit hashes of their words' hashes.

Null and empty texts have empty sets and are linked with nothing.  Rows with
a null doc_id are returned with a null component, kept.  Rows that share a
doc_id are told apart by their texts: each gets its own text's component, and
``row_key`` names it, so a text that copies nothing stays even if another of
its id goes.  Repeated rows are equal in all of this.  Ties between
neighbours go to the lower number of a set.  Very long texts have long sets, which are
held one at a time.  Empty tables give empty tables.  Only doc_id and text
are read; other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import prefix_join
from .common import bounded, cut, row_key, small_batches, without
from .components import components, join_components

MINIMA = 64
#: Candidates' ids (8 bytes each) up to which they are broadcast.
MAX_BROADCAST = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M3
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    known: dict[bytes, int] = {}
    for text in texts:
        words = text.lower().split() if text else []  # bytes: A-Z only, and the six ASCII blanks
        n = len(words)
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, n)
        if n < width:
            whole = np.uint64(n)
            for x in h:
                whole = _mix(np.array([whole * _M2 + x]))[0]
            yield np.array([whole] if n else [], np.uint64)
            continue
        at = h[: n - width + 1].copy()
        for k in range(1, width):
            at = _mix(at * _M1 + h[k : n - width + 1 + k] * _M2 + np.uint64(k))
        yield np.unique(at)
        if len(known) > 100_000:
            known.clear()


def signature(hashes: np.ndarray, factors: np.ndarray, block: int = 8192) -> bytes:
    """Minima of the products with odd factors, their upper halves in big-endian order."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), block):
        np.minimum(low, (factors[:, None] * hashes[None, k : k + block]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def _factors() -> np.ndarray:
    return _mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * _M1) | np.uint64(1)


def sketches(text: Column, width: int) -> Column:
    """Struct of set size, set fingerprint and signature."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        factors = _factors()
        with np.errstate(over="ignore"):
            for texts in batches:
                rows = [
                    (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s, factors))
                    if len(s) else (0, None, None)
                    for s in shingle_sets(texts, width)
                ]
                yield pd.DataFrame(rows, columns=["n", "fingerprint", "signature"])

    return F.pandas_udf(make, "n long, fingerprint binary, signature binary")(text.cast("binary"))


def full_sets(text: Column, width: int) -> Column:
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with np.errstate(over="ignore"):
            for texts in batches:
                yield pd.Series([s.tobytes() for s in shingle_sets(texts, width)], dtype=object)

    return F.pandas_udf(make, "binary")(text.cast("binary"))


def set_links(a: Column, b: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union, on full sets."""

    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pd.Series(out, dtype=bool)

    return F.pandas_udf(compare, "boolean")(a, b)


class Forest:
    """Regions of the sorted signature orders: tree, region, label, node, n; crowded ones are divided."""

    def __init__(self, nodes: DataFrame, trees: int = 16, min_depth: int = 4, max_depth: int = 8, region: int = 512):
        self.region = region
        double = F.concat("signature", F.substring("signature", 1, 4 * max_depth))
        step = 4 * MINIMA // trees
        rows = nodes.select("node", "n", double.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
            "node", "n", "tree", F.expr(f"substring(_s, {step} * tree + 1, {4 * max_depth})").alias("label")
        )
        settled, depth = [], min_depth
        rows = rows.withColumn("region", F.substring("label", 1, 4 * depth))
        while True:
            size = rows.groupBy("tree", "region").count().where("count > 1")
            dense = cut(rows.join(size, ["tree", "region"]), "forest")
            dense = dense.withColumn("crowded", F.lit(depth > min_depth) | (F.col("count") > region))
            settled.append(dense.where(F.col("count") <= region))
            if depth == min_depth:
                self.crowded = cut(dense.where("crowded").select("node").distinct(), "crowded")
            rows = dense.where(F.col("count") > region)
            if rows.isEmpty():
                break
            if depth == max_depth:
                settled.append(rows)
                break
            depth += 1
            rows = rows.drop("count", "crowded").withColumn("region", F.substring("label", 1, 4 * depth))
        chunk = F.when(F.col("count") > region, F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / region))).otherwise(0)
        out = settled[0]
        for x in settled[1:]:
            out = out.unionByName(x)
        self.rows = out.withColumn("chunk", chunk.cast("long"))

    def neighbours(self, near: int, of: DataFrame | None = None) -> DataFrame:
        """Pairs u < v of at most ``near`` places apart in a chunk of a region, and of chunks' first members."""
        rows = self.rows if of is None else of
        w = W.partitionBy("tree", "region", "chunk").orderBy("label", "node")
        me = F.struct("node", "n")
        after = F.collect_list(me).over(w.rowsBetween(1, near))
        pairs = rows.select("node", "n", after.alias("after")).select("node", "n", F.explode("after").alias("o"))
        heads = rows.where(F.col("count") > self.region).groupBy("tree", "region", "chunk").agg(F.min(me).alias("me"))
        follow = heads.select("me.node", "me.n", F.lead("me").over(W.partitionBy("tree", "region").orderBy("chunk")).alias("o"))
        return (
            pairs.unionByName(follow.where("o IS NOT NULL"))
            .select(F.least("node", "o.node").alias("u"), F.greatest("node", "o.node").alias("v"), F.col("n").alias("n1"), F.col("o.n").alias("n2"))
            .where("u < v")
        )


def link_documents(
    docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 16, region: int = 512, near: tuple[int, ...] = (1, 4)
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_key: a row for each row of docs."""
    small_batches(docs.sparkSession, 1000)
    made = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), sketches(F.col("text"), width).alias("s")).select("doc_id", "row_key", "s.*")
    meta = cut(made, "sketches")
    usable = meta.where("n > 0 AND doc_id IS NOT NULL")
    # A node is a different set of shingles, numbered; ids only name its component in the end, as an id may have several texts.
    sets = usable.groupBy("fingerprint").agg(
        F.min(F.struct("doc_id", "row_key")).alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    nodes = cut(sets.sortWithinPartitions("fingerprint").withColumn("node", F.monotonically_increasing_id()), "nodes")
    forest = Forest(nodes, trees, region=region)

    dense = forest.rows.select("node").distinct()
    wanted = cut(nodes.join(dense, "node", "left_semi").select("node", F.col("first.row_key").alias("row_key")), "dense")
    many = wanted.count()
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    texts = texts.join(F.broadcast(wanted) if many <= MAX_BROADCAST else wanted, "row_key")
    full = cut(texts.select("node", full_sets(F.col("text"), width).alias("set")), "sets")
    if full.count() > many:  # repeated rows
        full = cut(full.dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        fit = pairs.where(F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2")).select("u", "v").distinct()
        both = fit.join(full.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(
            full.select(F.col("node").alias("v"), F.col("set").alias("b")), "v"
        )
        return both.select("u", "v", set_links(F.col("a"), F.col("b"), percent).alias("ok")).where("ok").select("u", "v")

    found = components(confirmed(forest.neighbours(near[0])))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of chunks that hold more than one component so far."""
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = rows.groupBy("tree", "region", "chunk").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return cut(rows.join(of.select("tree", "region", "chunk"), ["tree", "region", "chunk"], "left_semi"), "mixed")

    for k, n in enumerate(near[1:]):
        rest = mixed(forest.rows.where(F.col("count") > near[k] + 1))
        if rest.isEmpty():
            break
        more = cut(confirmed(_apart(forest, rest, n)), "confirmed")
        if not more.isEmpty():
            found = join_components(found, more)
    # Regions larger than the neighbourhood so far: all links between their members, also across what crowded ones were divided into.
    rest = mixed(forest.rows.where((F.col("count") > near[-1] + 1) & ~F.col("crowded"))).select("node")
    left = cut(rest.unionByName(forest.crowded).distinct(), "left")
    if not left.isEmpty():
        members = full.join(left, "node", "left_semi").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = join_components(found, confirmed(prefix_join.pairs_apart(cut(members, "members"), percent)))
    linked = cut(nodes.select("fingerprint", "node", F.col("first.doc_id").alias("low")).join(found, "node", "left"), "linked")
    lowest = cut(linked.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("lowest")), "lowest")
    labels = cut(linked.join(bounded(lowest, MAX_BROADCAST), "component", "left").select("fingerprint", F.coalesce("lowest", "low").alias("component")), "by-text")
    # A join of two written tables, so that Spark can split a fingerprint that very many documents share.
    out = meta.select("doc_id", F.col("n").alias("n_shingles"), "fingerprint", "row_key").join(labels, "fingerprint", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row_key")


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80, **how) -> DataFrame:
    """docs without those of which a near copy of lower doc_id stays."""
    return without(docs, link_documents(docs, width, percent, **how).where("NOT kept"))


def _apart(forest: Forest, rest: DataFrame, n: int) -> DataFrame:
    """Neighbours up to ``n`` places apart that are in different components so far."""
    w = W.partitionBy("tree", "region", "chunk").orderBy("label", "node").rowsBetween(1, n)
    me = F.struct("node", "n", "component")
    pairs = rest.select("node", "n", "component", F.collect_list(me).over(w).alias("after")).select(
        "node", "n", F.explode(F.expr("filter(after, x -> x.component <> component)")).alias("o")
    )
    return pairs.select(F.least("node", "o.node").alias("u"), F.greatest("node", "o.node").alias("v"), F.col("n").alias("n1"), F.col("o.n").alias("n2")).where("u < v")
