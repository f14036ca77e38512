"""Helpers shared by the training-data operators: tables, text bytes, scratch."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(col: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null becomes empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


# Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; every
# other byte becomes a space, so byte offsets stay those of the original.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def letter_words(data: bytes) -> list[bytes]:
    return data.translate(LETTERS).split()


class Workspace:
    """Written intermediate tables of one job, in the cluster's shared folder.

    ``put`` cuts lineage: a lost executor rereads files.  ``drop`` removes a
    table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        for tag in tags:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows of a struct-returning pandas UDF, also when there are none."""
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, cols)})
