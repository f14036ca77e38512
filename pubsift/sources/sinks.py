"""Sinks: appending and deleting articles, dictionaries, results, id sets.

Writes go to the given paths (shared storage on a cluster).  Appends are
idempotent per batch when the caller drops already present ids first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.streaming.incremental import committed_snapshots

from pubsift.operators.corpus import assign_ids


def append_articles(new: DataFrame, existing: DataFrame, excluded: DataFrame | None,
                    path: str, order, id_col: str = "pmid") -> DataFrame:
    """Drop excluded ids, give the rest consecutive ids after the current
    maximum, append them to the Parquet table at ``path``.  Returns the rows
    written."""
    rows = new
    if excluded is not None:
        rows = rows.join(excluded.select(id_col), id_col, "left_anti")
    rows = assign_ids(rows.drop(id_col) if id_col in rows.columns else rows, existing, order, id_col)
    rows.write.mode("append").parquet(path)
    return rows


def delete_articles(table: DataFrame, ids: DataFrame, path: str, id_col: str = "pmid") -> DataFrame:
    """Write ``table`` minus the listed ids to a new path (no in-place delete)."""
    kept = table.join(ids.select(id_col), id_col, "left_anti")
    kept.write.mode("overwrite").parquet(path)
    return kept


def write_dictionary(df: DataFrame, path: str, release: str | None = None) -> str:
    """Dictionary to CSV; the release date goes into the folder name."""
    target = f"{path}_{release}" if release else path
    df.write.mode("overwrite").option("header", "true").csv(target)
    return target


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables as CSV (flat) or JSON (nested associations/documents)."""
    w = df.write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    else:
        flat = df.select(*[F.to_json(c).alias(c) if dict(df.dtypes)[c].startswith(("struct", "array", "map"))
                           else F.col(c) for c in df.columns])
        flat.write.mode("overwrite").option("header", "true").csv(path)


def id_registry_update(spark: SparkSession, path: str, downloaded: DataFrame,
                       id_col: str = "pmid") -> DataFrame:
    """processed := existing UNION downloaded (distinct), written as the next
    numbered snapshot folder under ``path``; returns the new set.  Only a
    missing or empty registry is a first run; any read error is raised."""
    done = committed_snapshots(spark, path)
    new = downloaded.select(id_col)
    if done:
        new = spark.read.parquet(f"{path}/{done[-1]}").select(id_col).union(new)
    target = f"{path}/v{int(done[-1][1:]) + 1 if done else 0:08d}"
    new.distinct().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
