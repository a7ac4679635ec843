"""What filters remove one after another, in every order, by retraction on a stream (operator 12).

Files arrive as available-now micro-batches.  A document's own failures (four
filters on its text) are a mask of bits as soon as it is read; whether it
repeats a document of smaller id depends on what else arrives, also later:

* every row counts at first as a repeat, in the counter of its part and mask;
* the state keeps, for each text, the rows of the smallest id so far, and
  these are moved to the mask without the repeat bit;
* when a smaller id arrives, the rows of the one before are moved back
  (retracted) and the new ones are moved in their place.

A batch writes the moves as sums by (part, mask, label), never rows, and adds
to the state only rows whose id is the smallest of its text so far, so the
state has about a row of some 60 bytes for each different text.  All that a
batch writes lies in folders of its own number, written over if the batch runs
again, and reads state of lower numbers only: a stream that is started again
with the same folder goes on exactly where it stopped.  A text that very many
documents share costs no task more than others: batches take least ids by
partial aggregation before rows of a text meet.  Texts are compared by
SHA-256.

The sums give all orders at once: of each part only how many documents have
each mask (32 numbers) is needed for the 120 orders.

Null texts are empty, and repeats of empty ones.  Rows with a null id repeat
nothing and nothing repeats them.  Rows of the same id repeat each other not.
A null part is the empty string.  Several labels of one id count as any of
them.  Very long texts are one row.  Empty tables give empty tables.  Only
the columns that are named are read; others can't clash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, bounded, cut, scratch

LETTERS = "ABCDE"
REPEAT = 1 << LETTERS.index("E")
#: Micro-batches at most, and labelled ids (some 20 bytes each) up to which they are broadcast.
BATCHES, MAX_LABELS = 8, 1_000_000
_ROW = "key binary, doc_id {}, part string, mask int, good boolean, toxic boolean, n long"
_BLANKS = r"[\x20\x09-\x0D]+"


def own_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A few words, B many repeated words, C many capitals, D a sign."""
    given = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(given, _BLANKS, -1), "")
    made = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.length(given) - F.length(F.translate(given, UPPER, ""))
    fails = [
        made["n"] < 200,
        100 * made["d"] < 50 * made["n"],
        100 * capitals > 2 * F.length(given),
        given.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """A row for each document: key of its text, doc_id, part, mask, good, toxic."""
    rows = docs.select(
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("key"), "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_mask(F.col("text")).cast("int").alias("mask"),
    )
    known = rows.join(labels, rows["doc_id"] == labels["_id"], "left")
    return known.select("key", "doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _moves(rows: DataFrame, back: bool) -> DataFrame:
    """Out of the counter with the repeat bit and into the one without, or back."""
    n = -F.col("n") if back else F.col("n")
    return rows.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").bitwiseOR(REPEAT).alias("mask"), (-n).alias("n")), F.struct(F.col("mask").alias("mask"), n.alias("n"))
    )).alias("m")).select("part", "m.mask", "good", "toxic", "m.n")


class Audit:
    """A stream's counters in a folder; give the same folder again to go on with files that are new."""

    def __init__(self, spark: SparkSession, labels: DataFrame, part: str = "source", folder: str | None = None, id_type: str = "long"):
        self.spark, self.part, self.folder = spark, part, folder or scratch(spark, "filter-audit")
        by = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
        flags = by.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        self.labels = bounded(cut(flags, "labels"), MAX_LABELS)
        self.row = _ROW.format(id_type)

    def _at(self, what: str, batch: int) -> str:
        return f"{self.folder}/{what}/batch={batch}"

    def _written(self, df: DataFrame, what: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._at(what, batch))
        return self.spark.read.schema(df.schema).parquet(self._at(what, batch))

    def batch(self, docs: DataFrame, number: int) -> None:
        """Takes a micro-batch in: moves between counters, and the new smallest ids."""
        state = self.spark.read.schema(self.row).parquet(*[self._at("state", k) for k in range(number)]) if number else self.spark.createDataFrame([], self.row)
        new = self._written(judged(docs, self.labels, self.part), "rows", number)
        with_id = new.where("doc_id IS NOT NULL")
        low = with_id.groupBy("key").agg(F.min("doc_id").alias("new_low"))
        old_low = state.groupBy(F.col("key").alias("_key")).agg(F.min("doc_id").alias("old_low"))
        low = low.join(old_low, low["key"] == old_low["_key"], "left").drop("_key")
        low = self._written(low.where("old_low IS NULL OR new_low <= old_low"), "low", number)
        moved = with_id.join(low, "key").where("doc_id = new_low").groupBy("key", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
        moved = self._written(moved, "state", number)
        before = state.join(low.where("new_low < old_low"), "key").where("doc_id = old_low")
        free = new.where("doc_id IS NULL").select("part", "mask", "good", "toxic", F.lit(1).cast("long").alias("n"))
        deltas = with_id.select("part", F.col("mask").bitwiseOR(REPEAT).alias("mask"), "good", "toxic", F.lit(1).cast("long").alias("n"))
        for x in (free, _moves(moved, False), _moves(before, True)):
            deltas = deltas.unionByName(x)
        self._written(deltas.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "deltas", number)

    def run(self, stream: DataFrame) -> None:
        """All that is available now, then stops."""
        query = (
            stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def counters(self) -> DataFrame:
        """part, mask, good, toxic, n: how many documents fail exactly the filters of a mask."""
        shape = "part string, mask int, good boolean, toxic boolean, n long"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], shape)
        deltas = self.spark.read.schema(shape).parquet(f"{self.folder}/deltas")
        return deltas.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def _places() -> Column:
    """For each filter and each set of filters before it: the orders (and steps) in which just those come before."""
    orders: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in itertools.permutations(range(len(LETTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            orders.setdefault((before, f), []).append(("".join(LETTERS[k] for k in order), step))
            before |= 1 << f
    return F.array(*[
        F.struct(
            F.lit(before).alias("before"), F.lit(1 << f).alias("bit"),
            F.lit(";".join(f"{o} {s}" for o, s in found)).alias("orders"),
        )
        for (before, f), found in orders.items()
    ])


def interactions(counters: DataFrame) -> DataFrame:
    """part, filter_order, step and what the filter of that step keeps, removes and removes alone, for all orders."""
    good, toxic = (F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))
    masks = counters.groupBy("part", "mask").agg(F.sum("n").alias("n"), good, toxic)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = parts.select("part", "masks", F.explode(_places()).alias("p")).select("part", "masks", "p.*")
    total = lambda what, which: F.expr(f"aggregate(masks, 0L, (a, x) -> a + IF({which}, {what}, 0L))")
    here = "x.mask & before = 0 AND x.mask & bit <> 0"
    rows = rows.select(
        "part", "orders",
        total("x.n", "x.mask & (before | bit) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "x.mask & before <> 0 AND x.mask & bit <> 0").alias("redundant"),
        total("x.n", "x.mask = bit").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        # A filter removes a document in those orders in which it comes first of the filters that the document fails.
        total("x.n * (120 div bit_count(x.mask))", "x.mask & bit <> 0").alias("shapley"),
    )
    one = F.split("o", " ")
    return rows.withColumn("o", F.explode(F.split("orders", ";"))).select(
        "part", one[0].alias("filter_order"), one[1].cast("int").alias("step"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def _any_kind(path: str) -> str:
    """A pattern that only this path fits: as such a stream also reads a single file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "*?[{") else f"{folder}/{{{name}}}"


def audit(spark: SparkSession, path: str, labels: DataFrame, part: str = "source", batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """The interactions of the filters over a folder of Parquet files, taken in as micro-batches."""
    docs = spark.read.parquet(path)
    files = len(docs.inputFiles())
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(-(-files // batches), 1)).parquet(_any_kind(path))
    made = Audit(spark, labels, part, folder, docs.schema["doc_id"].dataType.simpleString())
    made.run(stream)
    return interactions(cut(made.counters(), "counters"))
