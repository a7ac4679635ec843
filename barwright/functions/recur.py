"""Linear recurrences y(i) = a(i) y(i-1) + c(i) with window functions alone.

A row's value is its own block's share plus what the blocks before carry
over.  Inside a block the share is a running sum of c over the running
product of a, which stays in range because blocks are short.  Between blocks
the carry is folded over the last blocks that still weigh anything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recurrence(df: DataFrame, a: Column, c: Column, out: str, block: int = 128, carried: int = 64) -> DataFrame:
    """Adds column ``out``; rows are ordered by i within symbol and 0 < a <= 1 (at i's first row a has no effect).

    ``carried`` blocks reach back: what is older must weigh nothing, that is
    the product of a over so many blocks is below double precision.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("i")) - 1
    df = df.withColumns({"_rec_b": F.floor(rank / block), "_rec_first": rank == 0, "_rec_c": c, "_rec_la": F.log(a)})
    df = df.withColumn("_rec_la", F.when(F.col("_rec_first"), 0.0).otherwise(F.col("_rec_la")))
    run = Window.partitionBy("symbol", "_rec_b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_rec_p", F.sum("_rec_la").over(run))
    df = df.withColumn("_rec_s", F.exp("_rec_p") * F.sum(F.col("_rec_c") * F.exp(-F.col("_rec_p"))).over(run))
    ends = df.groupBy("symbol", "_rec_b").agg(F.max_by(F.struct("_rec_p", "_rec_s"), "i").alias("_rec_e"))
    back = Window.partitionBy("symbol").orderBy("_rec_b").rowsBetween(-carried, -1)
    ends = ends.select("symbol", "_rec_b", F.collect_list("_rec_e").over(back).alias("_rec_h")).select(
        "symbol", "_rec_b", F.aggregate("_rec_h", F.lit(0.0), lambda y, e: F.exp(e["_rec_p"]) * y + e["_rec_s"]).alias("_rec_y")
    )
    df = df.join(ends, ["symbol", "_rec_b"])
    return df.withColumn(out, F.exp("_rec_p") * F.col("_rec_y") + F.col("_rec_s")).drop("_rec_b", "_rec_first", "_rec_c", "_rec_la", "_rec_p", "_rec_s", "_rec_y")


def ewm(df: DataFrame, x: Column, alpha: float, out: str) -> DataFrame:
    """y(0) = x(0), y(i) = (1 - alpha) y(i-1) + alpha x(i); a leading null delays the start.

    After k nulls the old value keeps losing weight, and the row after them
    gets ((1-alpha)^(k+1) y + alpha x) / ((1-alpha)^(k+1) + alpha); null rows
    repeat the last value.
    """
    w = Window.partitionBy("symbol").orderBy("i")
    known = df.select("symbol", "i", x.alias("_rec_x")).where("_rec_x IS NOT NULL")
    kept = F.pow(F.lit(1 - alpha), F.col("i") - F.coalesce(F.lag("i").over(w), F.col("i") - 1))
    known = known.withColumns({"_rec_a": kept / (kept + alpha), "_rec_f": F.row_number().over(w) == 1})
    c = F.when(F.col("_rec_f"), F.col("_rec_x")).otherwise(F.col("_rec_x") * (1 - F.col("_rec_a")))
    carried = max(2, math.ceil(60 / (128 * -math.log(1 - alpha))))
    known = recurrence(known, F.col("_rec_a"), c, out, carried=carried).select("symbol", "i", out)
    df = df.join(known, ["symbol", "i"], "left")
    return df.withColumn(out, F.last(out, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
