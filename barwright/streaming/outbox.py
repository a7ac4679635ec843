"""Sending what a stream brings once, also if a batch runs again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """A folder with an entry for each batch that is done; entries are made in one step and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, store = self._at(name)
        return store.exists(path)

    def enter(self, name: str) -> None:
        path, store = self._at(name)
        store.create(path, False).close()


def send_once(stream: DataFrame, send: Callable[[DataFrame, str], None], folder: str, keep: Callable[[DataFrame], None] | None = None):
    """Starts a stream whose batches are sent, entered in a ledger, and then kept (as state).

    A batch is first written to the outbox, so that what is sent doesn't
    change if it runs again.  One that is in the ledger is not sent again,
    only kept, if a failure came between the two.  A failure between sending
    and the ledger can't be told from one before sending: the batch goes out
    again under the same name, by which a receiver can tell.  Rows are kept
    only after they were sent.
    """
    spark = stream.sparkSession
    sent, kept = Ledger(spark, f"{folder}/sent"), Ledger(spark, f"{folder}/kept")

    def act(batch: DataFrame, number: int) -> None:
        name = f"batch-{number}"
        if kept.has(name):
            return
        if not sent.has(name):
            batch.write.mode("overwrite").parquet(f"{folder}/outbox/{name}")
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/outbox/{name}")
        if not sent.has(name):
            if not rows.isEmpty():
                send(rows, name)
            sent.enter(name)
        if keep is not None:
            keep(rows)
        kept.enter(name)

    return stream.writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
