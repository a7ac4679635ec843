"""Benchmark decontamination by a positional inverted index (operator 2).

Training texts are tokenised into postings (term, document, position).  For
each window of a benchmark item the rarest terms, by their count over all
training texts, are looked up; their postings, less the term's offset in the
item, are intersected, and only the places where all of them meet are
compared word by word.  Postings are stored for the terms so chosen; no other
list would be read.  ``phrase_places`` gives exact matches, ``proximity_places``
those where the rarest terms stand within some words of their places.

Words are runs of 0-9, a-z and anything beyond ASCII, after A-Z are lowered.
Null and empty texts have no words.  Items of fewer words than a window, but
not none, are one window; items without words or with a null id match
nothing.  Repeated items count once.  Documents are told apart by hashes of
id and text (row_key), so null and repeated ids do no harm (a clash of hashes
only brings a place to compare, where the words then differ).  Ties between
equally rare terms go to the earlier in the alphabet, then the earlier in the
item.  A very long text is one row with its words and its own places.  Empty
tables on either side give no matches.  Only doc_id, item_id and text are
read; other columns can't clash.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut, row_key, without

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms or offsets of the benchmark (some 50 bytes each) up to which a side is broadcast.
MAX_BROADCAST = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, item_key, item_words, size of the window, starts."""
    df = (
        items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("item_words")).distinct()
        .where(F.size("item_words") > 0)
        .withColumn("item_key", F.xxhash64("item_id", "item_words"))
    )
    size = F.least(F.size("item_words"), F.lit(width))
    return df.withColumns({"size": size, "starts": F.sequence(F.lit(0), F.size("item_words") - size)})


class PositionalIndex:
    """Postings of the rarest terms of the items' windows, over all training texts."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2):
        self.docs = docs.select("doc_id", "text").withColumn("_k", F.xxhash64("doc_id", "text"))
        self.items = cut(item_windows(items, width), "items")
        self.anchors, self.windows = self._choose(rarest)
        terms = self.anchors.select("term").distinct()
        posted = self.docs.select("_k", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(bounded(terms, MAX_BROADCAST), "term")
        self.postings = cut(posted, "postings")

    def term_counts(self) -> DataFrame:
        """Count over all training texts of each term of the items."""
        asked = self.items.select(F.explode("item_words").alias("term")).distinct()
        tokens = self.docs.select(F.explode(words(F.col("text"))).alias("term"))
        if asked.count() <= MAX_BROADCAST:
            return tokens.join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("n"))
        # A frequent term is one row for each task before it is joined.
        return tokens.groupBy("term").agg(F.count("*").alias("n")).join(asked, "term")

    def _choose(self, rarest: int) -> tuple[DataFrame, DataFrame]:
        """The rarest terms' offsets by window; windows with a term that no text has are left out."""
        counts = cut(self.term_counts(), "terms")
        inside = (
            self.items.select("item_key", "item_words", "size", F.explode("starts").alias("start"))
            .select("item_key", "start", "size", F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("size"))).alias("o", "term"))
            .join(counts, "term", "left")
        )
        window = W.partitionBy("item_key", "start")
        ranked = inside.withColumns({
            "_known": F.min(F.coalesce("n", F.lit(0))).over(window),
            "_rank": F.row_number().over(window.orderBy("n", "term", "o")),
        }).where((F.col("_known") > 0) & (F.col("_rank") <= rarest))
        ranked = cut(ranked.select("item_key", "start", (F.col("start") + F.col("o")).alias("offset"), "term", "_rank"), "ranked")
        return (
            ranked.select("term", "item_key", "offset").distinct(),
            ranked.groupBy("item_key", "start").agg(F.sort_array(F.collect_list(F.struct("_rank", "offset"))).getField("offset").alias("needs")),
        )

    def candidate_places(self) -> DataFrame:
        """_k, item_key, place (of the item's word 0, in the document), starts whose rarest terms all meet there."""
        moved = self.postings.join(bounded(self.anchors, MAX_BROADCAST), "term").select("_k", "item_key", (F.col("pos") - F.col("offset")).alias("place"), "offset")
        met = moved.groupBy("_k", "item_key", "place").agg(F.collect_set("offset").alias("have"))
        needs = self.windows.groupBy("item_key").agg(F.collect_list(F.struct("start", "needs")).alias("needs"))
        starts = F.expr("transform(filter(needs, w -> size(array_except(w.needs, have)) = 0), w -> w.start)")
        # The least that any window of the item needs keeps most single hits from the join's result.
        return met.join(bounded(needs, MAX_BROADCAST), "item_key").select("_k", "item_key", "place", starts.alias("starts")).where(F.size("starts") > 0)

    def phrase_places(self) -> DataFrame:
        """A row for each document: doc_id, row_key, n_words, places (item_id, first word, size of each exact occurrence)."""
        items = self.items.select("item_key", "item_id", "item_words", "size")
        found = (
            self.candidate_places().join(bounded(items, MAX_BROADCAST), "item_key")
            .groupBy("_k").agg(F.collect_list(F.struct("item_id", "item_words", "size", "place", "starts")).alias("_found"))
        )
        df = self.docs.join(found, "_k", "left").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "_found", words(F.col("text")).alias("_w"))
        exact = F.expr("""
            flatten(transform(_found, f -> transform(
                filter(f.starts, s -> f.place + s >= 0 AND slice(_w, f.place + s + 1, f.size) = slice(f.item_words, s + 1, f.size)),
                s -> named_struct('item_id', f.item_id, 'first', f.place + s, 'size', f.size))))""")
        return df.select("doc_id", "row_key", F.size("_w").cast("long").alias("n_words"), F.when(F.col("_found").isNotNull(), exact).alias("places"))

    def proximity_places(self, slop: int) -> DataFrame:
        """_k, doc_id, item_id, start: windows whose rarest terms all stand within ``slop`` words of their places.

        Places are cut into blocks of slop + 1 words and each term's place
        also goes to both neighbours, so that near places meet by equality.
        """
        size = slop + 1
        ranks = self.windows.select("item_key", "start", F.size("needs").alias("n_needs"), F.posexplode("needs").alias("rank", "offset"))
        terms = ranks.join(self.anchors, ["item_key", "offset"])
        near = self.postings.join(bounded(terms, MAX_BROADCAST), "term").withColumn("place", F.col("pos") - F.col("offset"))
        block = F.floor(F.col("place") / size)
        first = near.where("rank = 0").select("_k", "item_key", "start", "n_needs", F.col("place").alias("p0"), block.alias("b"))
        other = near.where("rank > 0").select("_k", "item_key", "start", "rank", F.col("place").alias("p1"), F.explode(F.array(block - 1, block, block + 1)).alias("b"))
        met = (
            first.join(other, ["_k", "item_key", "start", "b"], "left")
            .where(F.col("p1").isNull() | (F.abs(F.col("p0") - F.col("p1")) <= slop))
            .groupBy("_k", "item_key", "start", "p0").agg(F.max("n_needs").alias("n_needs"), F.count_distinct("rank").alias("n_met"))
            .where(F.col("n_met") == F.col("n_needs") - 1)
        )
        return (
            met.select("_k", "item_key", "start").distinct()
            .join(self.items.select("item_key", "item_id"), "item_key")
            .join(self.docs.select("_k", "doc_id").distinct(), "_k").select("_k", "doc_id", "item_id", "start")
        )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated, row_key: a row for each row of docs."""
    df = PositionalIndex(docs, items, width, rarest).phrase_places()
    inside = "flatten(transform(places, p -> sequence(p.first, p.first + p.size - 1)))"
    none = F.array().cast("array<string>")
    df = df.select(
        "doc_id", "row_key", "n_words",
        F.coalesce(F.expr(f"size(array_distinct({inside}))"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.expr("array_sort(array_distinct(transform(places, p -> string(p.item_id))))"), none).alias("item_ids"),
    )
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"), "row_key"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, **how) -> DataFrame:
    """docs without those that hold a window of an item."""
    return without(docs, contamination(docs, items, width, **how).where("contaminated"))
