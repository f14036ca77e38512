"""Registered queries: incremental and streaming operators over files that
Spark derives from the driver tables (written under the checkpoint folder)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.session import scratch_path
from pubsift.sources import tables as T
from pubsift.sources import xml_articles as XA
from pubsift.streaming import incremental as INC


def _run_dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _versioned_dumps(spark, sf_dir, base):
    """First-file copies in 4 dump files, then the revisions in 2 later files."""
    v = T.articles_versions(spark, sf_dir)
    src = os.path.join(base, "dumps")
    first = XA.render_article_xml(v.where("file_pos = 0"))
    first.repartition(4, "pmid").sortWithinPartitions("pmid").select("xml").write.text(src)
    later = XA.render_article_xml(v.where("file_pos = 1"))
    later.repartition(2, "pmid").sortWithinPartitions("pmid").select("xml") \
        .write.mode("append").text(src)
    return src


@query("incremental_upsert", oracle="""
select pmid, cast(case when n_copies > 1 then version end as bigint) as version, title,
       trim(content) as content, date, n_copies
from (select *, row_number() over (partition by pmid order by file_pos desc, article_pos desc) as rn,
             count(*) over (partition by pmid) as n_copies
      from articles_versions) v where rn = 1""")
def q_incremental_upsert(spark, sf_dir):
    base = _run_dir(spark, "upsert")
    src = _versioned_dumps(spark, sf_dir, base)
    out = INC.incremental_upsert(spark, src, os.path.join(base, "state"),
                                 os.path.join(base, "checkpoint"), max_files_per_trigger=1)
    return normalize(out)


@query("incremental_scan", oracle="""
select pmid, cast(version as bigint) as version, title, trim(content) as abstract, date from articles_versions""")
def q_incremental_scan(spark, sf_dir):
    base = _run_dir(spark, "scan")
    src = _versioned_dumps(spark, sf_dir, base)
    out = INC.incremental_scan(spark, src, os.path.join(base, "sink"),
                               os.path.join(base, "checkpoint"), max_files_per_trigger=2)
    return normalize(out.select("pmid", "version", "title", "abstract", "date"))


@query("annotation_state_stream", oracle="""
select cast(gid as bigint) as gid, cast(docid as bigint) as docid, cast(annot_id as bigint) as annot_id,
       ts, event_id, type, tag, round(value, 6) as value from (
  select *, row_number() over (partition by gid, docid, annot_id order by ts desc, event_id desc) as rn
  from annotation_events) e
where rn = 1 and type <> 'delete'""")
def q_annotation_state_stream(spark, sf_dir):
    base = _run_dir(spark, "annotations")
    ev = T.annotation_events(spark, sf_dir)
    src = os.path.join(base, "events")
    # Four event files in time order, written one after the other.
    bounds = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (bounds["hi"] - bounds["lo"]) / 4
    for i in range(4):
        lo = bounds["lo"] + span * i
        part = ev.where(F.col("ts") >= F.lit(lo)) if i == 0 else ev.where(F.col("ts") > F.lit(lo))
        if i < 3:
            part = part.where(F.col("ts") <= F.lit(bounds["lo"] + span * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(src)
    out = INC.annotation_state_stream(spark, src, ev.schema, os.path.join(base, "state"),
                                      os.path.join(base, "checkpoint"))
    return normalize(out.select("gid", "docid", "annot_id", "ts", "event_id", "type", "tag", "value"))


@query("update_watermark", oracle="""
select pmid, current_date - 1 as next_watermark from articles where date >= date '2015-01-01'""")
def q_update_watermark(spark, sf_dir):
    return INC.update_watermark(T.articles(spark, sf_dir), "2015-01-01")


@query("batched_ingest", oracle="""
with b as (
  select pmid, title, date, pmid % 250 = 0 as cut, (row_number() over (order by pmid) - 1) // 100 as batch from articles
),
bad as (select distinct batch from b where cut)
select pmid, title, date, null::bigint as failed_batches from b where batch not in (select batch from bad)
union all select null, null, null, count(*) from bad""")
def q_batched_ingest(spark, sf_dir):
    """Every 250th record is cut short: its batch is skipped and counted."""
    recs = XA.render_article_xml(T.articles(spark, sf_dir)).withColumn(
        "xml", F.when(F.col("pmid") % 250 == 0, F.expr("substr(xml, 1, length(xml) - 5)")).otherwise(F.col("xml")))
    parsed, failed = INC.batched_ingest(recs)
    return parsed.select("pmid", "title", "date").withColumn("failed_batches", F.lit(None).cast("long")) \
        .unionByName(failed.select(F.lit(None).cast("long").alias("pmid"),
                                   F.lit(None).cast("string").alias("title"),
                                   F.lit(None).cast("date").alias("date"), "failed_batches"))
