"""The training-corpus pipeline: toxicity, quality, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept.  All but the last return the columns of ``docs``, in their order, whatever
their names.  Rows that a stage cannot judge stay: a null text is not toxic and
not contaminated (the quality rules reject it, as it has no words); a null
``doc_id`` is never a copy's keeper and is dropped only if its group keeps
another row; rows that repeat a ``doc_id`` leave one row in the near-dedup stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubsift.llm import decontam, neardup, packing, quality, toxicity
from pubsift.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judger(spark, quality.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(judged("text")["kept"])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the group's smallest id."""
    keep = neardup.near_duplicates(spark, docs).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")), "left_semi")
    # An id that occurs once needs no ranking; few ids repeat.
    names = docs.columns
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    return kept.withColumn("_nth", F.row_number().over(again)).where(
        (F.col("_nth") == 1) | F.col("doc_id").isNull()).select(*[F.col(f"`{c}`") for c in names])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scan = decontam.scanner(spark, table(spark, sf_dir, "benchmark"), spans=False)
    return docs.where(~decontam.is_contaminated(scan("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, *packing.default_paths()))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("neardup", drop_copies),
          ("decontamination", drop_contaminated), ("packing", pack)]

# Classifiers, a chain model, connected components and a tokenizer: not SQL.
# tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i > 0:
            ws.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
