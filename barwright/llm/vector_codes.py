"""Product-quantised vector codes (operator 11).

Components become integers, floor(scale * x).  Vectors are cut into equal
consecutive parts, each with a codebook of ``entries``.  A codebook starts as
that part of the vectors of the smallest ids, ascending.  Each round assigns
every part to its nearest entry (squared distance, ties to the lower index)
and replaces entries by the floored means of their parts; unused ones stay.
Nearest entries are found through a geometric near-neighbour access tree over
the codebook (neighbour_tree), which drops whole subtrees of entries by the
ranges of their distances to split points, strictly, so codes equal those of
comparing all.

A round is a pass over the written vectors: a task assigns a batch at a time
and adds it to its own sums of entries x dims, so a row per entry and task is
shuffled, whatever the vectors are like; the new codebooks (parts x entries x
dims of integers) come to the driver and go out with the next pass.

Rows go whose vector is null or empty, or holds a null or non-finite
component; so do those whose length differs from that of the kept vector of
the smallest id, or isn't a multiple of the parts, as they can't be coded.
Vectors of null ids are coded, but no codebook starts from them.  Repeated ids
are rows of their own, in the order of their vectors at the start.  With fewer
vectors than entries codebooks are smaller.  Components beyond the integers
whose squared distances fit into 64 bits (some 3 * 10^5 before scaling, at 16
dims a part) raise an error.  Empty tables give empty tables.  Only the
columns that are named are read; others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, small_batches
from .neighbour_tree import NeighbourTree, largest_component

#: Labels (with their sums) up to which they are broadcast.
MAX_LABELS = 100_000


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _trees(books: np.ndarray) -> list[NeighbourTree]:
    return [NeighbourTree(b) for b in books]


def _assign(trees: list[NeighbourTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances: a row a vector, a column a part."""
    width = x.shape[1] // len(trees)
    found = [t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
    return np.stack([a for a, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _whole(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, v (integers) of the rows that can be coded."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").where((F.size("embedding") > 0) & ~odd)
    limit = largest_component(1)
    exact = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * F.when(F.abs(x) <= limit / scale, x.cast("double"))))
    return rows.select("vec_id", "label", exact.cast("array<long>").alias("v"))


def _start(rows: DataFrame, entries: int) -> list[list[int]]:
    got = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    return [r.v for r in got]


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks (parts x entries x dims)."""
    parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, many, sums = _trees(books), np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), parts * width)
                code, _ = _assign(trees, x)
                for p in range(parts):
                    at = p * n + code[:, p]
                    many += np.bincount(at, minlength=parts * n)
                    np.add.at(sums, at, x[:, p * width : (p + 1) * width])
        used = np.flatnonzero(many)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(many[used]), sums], ["entry", "many", "sums"])

    made = rows.select("v").mapInArrow(run, "entry long, many long, sums array<long>")
    total = made.groupBy("entry").agg(F.sum("many").alias("many"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
    out = books.reshape(parts * n, width).copy()
    for r in total.collect():  # a row an entry at most
        out[r.entry] = [r[f"s{k}"] // r.many for k in range(width)]
    return out.reshape(books.shape)


def codebooks_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (index of each part's entry), error of each vector that can be coded, and the codebooks (parts x entries x dims)."""
    if not isinstance(vectors.schema["embedding"].dataType, T.ArrayType):
        raise TypeError("embedding must be an array column")
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = cut(_whole(vectors, parts, scale), "vectors")
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").select(F.size("v")).first()
    dims = first[0] if first else 0
    shape = "vec_id " + rows.schema["vec_id"].dataType.simpleString() + ", label " + rows.schema["label"].dataType.simpleString() + ", code array<int>, error long"
    if not dims or dims % parts:
        return spark.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("v") == dims)
    limit = largest_component(dims // parts)
    large = rows.where(F.exists("v", lambda x: x.isNull() | (F.abs(x) > limit)))
    if not large.isEmpty():
        raise ValueError(f"a component is beyond {limit} after scaling")
    start = np.array(_start(rows, entries), np.int64)
    books = start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for b in batches:
            code, error = _assign(trees, _matrix(b.column(2), dims))
            code = pa.FixedSizeListArray.from_arrays(pa.array(code.astype(np.int32).ravel()), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, shape), books


def decode(code: np.ndarray, books: np.ndarray, scale: int = 1024) -> np.ndarray:
    """The vectors that codes (a row each) stand for."""
    return np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1) / scale


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the error summed over equal labels, nulls together."""
    coded = cut(coded, "coded")
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    total = bounded(cut(by.select(F.col("label").alias("_barwright_label"), "label_error"), "label-errors"), MAX_LABELS)
    return coded.join(total, F.col("label").eqNullSafe(F.col("_barwright_label"))).drop("_barwright_label")


def hex_code(code) -> F.Column:
    """Two hex digits for each index, in the order of parts."""
    return F.array_join(F.transform(code, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
