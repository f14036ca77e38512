"""Incremental processing with Structured Streaming.

* ``incremental_scan`` — only files not seen before are processed: the file
  source keeps the list in its checkpoint; ``trigger(availableNow=True)``
  processes what is there and stops.
* ``incremental_upsert`` — revised articles replace earlier ones across
  runs: each micro-batch is reduced by the same "latest wins" aggregate as the
  batch operator and kept as a run of a :class:`~pubsift.streaming.state.KeyedState`
  (what is written follows the batch; a retried batch replaces its own run).
* ``annotation_state_stream`` — the annotation event log folded into a
  last-write-wins state table the same way.
* ``batched_ingest`` — id batches of 100: a batch with an unparsable record
  is skipped and counted, the others are appended.
* ``update_watermark`` — ids since the last update date, next date =
  yesterday.

Checkpoints and snapshots live under the folders the caller passes (shared
storage on a cluster).
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pubsift.sources import xml_articles as XA
from pubsift.streaming.state import KeyedState

END = f"</{XA.RECORD}>"


def _chunks_to_records(chunks: DataFrame) -> DataFrame:
    """Record rows from raw lineSep chunks of one micro-batch.  ``rec_pos`` grows with
    the place in the file (split, then row) without gathering a file's records in one
    task; it has gaps."""
    at = XA.open_tag_position(F.col("value"))
    c = chunks.withColumn("_mid", F.monotonically_increasing_id())
    recs = c.where(at > 0)
    return recs.select("file", "file_name", F.col("_mid").alias("rec_pos"),
                       F.concat(F.substr(F.col("value"), at), F.lit(END)).alias("xml"),
                       F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))


def _latest(rows: DataFrame) -> DataFrame:
    """Latest copy per pmid by (batch, file arrival time, file name, position
    in the file); copies counted.  Files of one micro-batch are ordered by
    their modification time, the order in which the stream discovers them."""
    order = ["batch", "file_time", "file_name", "article_pos"]
    payload = ["version", "title", "content", "date"]
    agg = rows.groupBy("pmid").agg(
        F.max(F.struct(*order, *payload)).alias("_w"),
        F.sum("n_copies").alias("n_copies"))
    return agg.select("pmid", *[F.col(f"_w.{c}").alias(c) for c in order + payload],
                      "n_copies")


def committed_snapshots(spark: SparkSession, state_dir: str) -> list[str]:
    """Names of snapshot folders with a _SUCCESS marker, via the Hadoop
    file system of the path (local, HDFS, object stores alike)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            names.append(name)
    return sorted(names)


def incremental_upsert(spark: SparkSession, source_dir: str, state_dir: str, checkpoint: str,
                       max_files_per_trigger: int = 1) -> DataFrame:
    """Stream article dump files into a latest-version state; returns the
    final state (pmid, version, title, content, date, n_copies) where
    version is NULL for articles never updated."""
    stream = (spark.readStream.option("lineSep", END)
              .option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir)
              .select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_name").alias("file_name"),
                      F.col("_metadata.file_modification_time").alias("file_time")))

    state = KeyedState(spark, state_dir, _latest)

    def merge(batch: DataFrame, epoch: int) -> None:
        times = batch.select("file", "file_time").distinct()  # one row per file
        recs = XA.parse_articles(_chunks_to_records(batch)).join(F.broadcast(times), "file")
        rows = (recs.where("has_title and has_abstract")
                .select("pmid", "version", "title", F.col("abstract").alias("content"), "date",
                        F.lit(epoch).alias("batch"), "file_time", F.col("file").alias("file_name"),
                        F.col("rec_pos").alias("article_pos"),
                        F.lit(1).cast("long").alias("n_copies")))
        state.apply(rows, epoch)

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return state.read().select("pmid", F.when(F.col("n_copies") > 1, F.col("version")).alias("version"),
                       "title", "content", "date", "n_copies")


def incremental_scan(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                     max_files_per_trigger: int = 1) -> DataFrame:
    """Parse only new dump files into an append-only article table; returns
    the table (pmid, version, title, abstract, date, file)."""
    stream = (spark.readStream.option("lineSep", END)
              .option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir)
              .select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_name").alias("file_name")))

    def append(batch: DataFrame, epoch: int) -> None:
        recs = XA.parse_articles(_chunks_to_records(batch))
        out = recs.select("pmid", "version", "title", "abstract", "date", "file",
                          F.lit(epoch).alias("epoch"))
        # Overwrite this epoch's folder only: a retried batch is idempotent.
        out.write.mode("overwrite").parquet(os.path.join(sink_dir, f"epoch={epoch}"))

    q = (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def annotation_state_stream(spark: SparkSession, source_dir: str, schema, state_dir: str,
                            checkpoint: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Fold an annotation event stream into the last-write-wins state.

    The stored state keeps the last event per key including deletes
    (tombstones), so a later event can revive a deleted key; the returned
    view drops the tombstones."""
    key = ["gid", "docid", "annot_id"]
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def last_event(rows: DataFrame) -> DataFrame:
        payload = [c for c in rows.columns if c not in key and c not in ("ts", "event_id")]
        last = rows.groupBy(*key).agg(F.max(F.struct("ts", "event_id", *payload)).alias("_l"))
        return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in ["ts", "event_id"] + payload])

    state = KeyedState(spark, state_dir, last_event)
    q = (stream.writeStream.foreachBatch(lambda batch, epoch: state.apply(batch, epoch) and None).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return state.read().where(F.col("type") != "delete")


def update_watermark(df: DataFrame, last_date: str, date: str = "date",
                     id_col: str = "pmid") -> DataFrame:
    """Ids dated on or after ``last_date``; the next watermark is yesterday."""
    return (df.where(F.col(date) >= F.lit(last_date).cast("date"))
            .select(id_col, F.date_sub(F.current_date(), 1).alias("next_watermark")))


@F.pandas_udf(BooleanType())
def well_formed_xml(xml: pd.Series) -> pd.Series:
    """True when the text parses as XML (a small per-row helper)."""
    import xml.etree.ElementTree as ET

    def ok(s):
        try:
            ET.fromstring(s)
            return True
        except Exception:  # noqa: BLE001
            return False

    return xml.map(ok)


def batched_ingest(records: DataFrame, id_col: str = "pmid", batch: int = 100):
    """Parse records in id batches of ``batch``; a batch containing any
    malformed record is skipped.  Returns (parsed rows of good batches,
    one-row table with the number of failed batches)."""
    from pubsift.operators.ordinals import global_ordinal

    o = global_ordinal(records, [id_col], "_o", start=0).withColumn(
        "batch", F.floor(F.col("_o") / batch))
    o = o.withColumn("_ok", well_formed_xml("xml"))
    bad = o.groupBy("batch").agg(F.min(F.col("_ok").cast("int")).alias("_all_ok"))
    good = o.join(bad.where("_all_ok = 1").select("batch"), "batch", "left_semi")
    parsed = XA.parse_articles(good.select("xml", F.lit("batch").alias("file"),
                                           F.col("batch").alias("rec_pos"),
                                           F.lit(0).alias("start"), F.lit(0).alias("length")))
    failed = bad.agg(F.count_if(F.col("_all_ok") == 0).alias("failed_batches"))
    return parsed, failed
