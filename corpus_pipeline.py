"""From raw documents to encoded training text, in five stages.

Each stage takes the documents that the one before it kept, written as
Parquet and read again, and its decisions take effect: documents that the
learned quality rules reject go; boilerplate lines go, and documents of
which nothing is left; of near copies the one with the lowest id stays;
documents with benchmark passages go; the rest is encoded.

A document with a null text fails the quality rules, so later stages don't
see it.  Rows with a null doc_id are no one's copy and pass the near-duplicate
stage.  Rows that share a doc_id are told apart by their texts, and repeated
rows are treated alike: all go or all stay.  Very long texts pass whole.
Extra columns pass unchanged up to the last stage, whatever they are called;
only names that begin with _barwright_ are reserved.  Empty tables give empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import decision_list, decontaminate, line_spread, near_dup, sentpiece
from barwright.llm.common import cut_to, drop_since, mark, scratch, small_batches, table
from barwright.llm.queries import MIN_SITES, TOKENIZERS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decision_list.keep_good(docs, decision_list.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_spread.without_boilerplate(docs, MIN_SITES)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_copies(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000, 8)
    made = docs.select("doc_id", "lang", "source", sentpiece.encode_checked(F.col("text"), f"{TOKENIZERS}/piece_bpe_32k.model").alias("e"))
    return made.select("doc_id", "lang", "source", "e.ids", F.size("e.ids").cast("long").alias("n_pieces"), "e.round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Learned rules and piece encoding are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote on its way goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = scratch(spark, name.replace(" ", "-"))
        docs = cut_to(made, path)
        drop_since(spark, before, path)
    return STAGES[-1][1](spark, docs, sf_dir)
