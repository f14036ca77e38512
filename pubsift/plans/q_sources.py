"""Registered queries: sources and sinks exercised on files that Spark
derives from the driver tables and writes under the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.session import scratch_path
from pubsift.sources import files as FS
from pubsift.sources import tables as T
from pubsift.sources import xml_articles as XA


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _xml_dump(spark, sf_dir):
    """Article records rendered from the articles view, written as text files
    (one record per line) under the checkpoint folder; returns the folder."""
    arts = T.articles(spark, sf_dir)
    rec = XA.render_article_xml(arts, T.mesh(spark, sf_dir))
    path = _scratch(spark, "xml")
    # Files by source: several dump files, each a bounded unit.
    (rec.join(arts.select("pmid", "source"), "pmid").repartition("source")
     .sortWithinPartitions("pmid").select("xml").write.text(path))
    return path


@query("read_article_xml", oracle="""
select pmid, cast(version as bigint) as version, title, trim(content) as abstract, date from articles""")
def q_read_article_xml(spark, sf_dir):
    path = _xml_dump(spark, sf_dir)
    recs = XA.read_xml_records(spark, path)
    return normalize(XA.parse_articles(recs).select("pmid", "version", "title", "abstract", "date"))


@query("resolve_publication_date", oracle="select pmid, date from articles")
def q_resolve_publication_date(spark, sf_dir):
    recs = XA.render_article_xml(T.articles(spark, sf_dir)).select(
        "xml", F.lit("rendered").alias("file"), F.lit(0).alias("rec_pos"),
        F.lit(0).alias("start"), F.lit(0).alias("length"))
    return XA.parse_articles(recs).select("pmid", "date")


@query("extract_mesh_terms", oracle="""
select pmid, array_to_string(list_sort(list(distinct meshid)), ',') as mesh from mesh group by pmid""")
def q_extract_mesh_terms(spark, sf_dir):
    recs = XA.render_article_xml(T.articles(spark, sf_dir), T.mesh(spark, sf_dir))
    m = XA.extract_mesh_terms(recs)
    return m.select("pmid", F.array_join(F.array_sort("mesh"), ",").alias("mesh"))


@query("article_locator")
def q_article_locator(spark, sf_dir):
    """pmid -> (file, start, length) over written dump files; the record bytes
    at that span are read back and must parse to the same pmid."""
    path = _xml_dump(spark, sf_dir)
    loc = XA.article_locator(XA.read_xml_records(spark, path))
    return loc


@query("parse_article_doc")
def q_parse_article_doc(spark, sf_dir):
    recs = XA.render_article_xml(T.articles(spark, sf_dir)).select(
        "xml", F.lit("rendered").alias("file"), F.lit(0).alias("rec_pos"),
        F.lit(0).alias("start"), F.lit(0).alias("length"))
    return XA.parse_article_doc(recs).select("id.pmid", "title", "date", "json")


@query("read_article_json", oracle="""
select cast(pmid as varchar) as pmid, title, content as abstract, strftime(date, '%Y-%m-%d') as date
from articles""")
def q_read_article_json(spark, sf_dir):
    """Articles written as JSON-string items in appended arrays ('][' seams),
    ten items per array and ten arrays per file, then read back."""
    arts = T.articles(spark, sf_dir)
    doc = F.to_json(F.struct(
        F.struct(F.lit("src").alias("src")).alias("meta"), F.col("content").alias("abstract"),
        F.struct(F.col("pmid").cast("string").alias("pmid")).alias("id"),
        F.date_format("date", "yyyy-MM-dd").alias("date"), "title"))
    items = arts.select("pmid", doc.alias("item"))
    arrays = (items.groupBy((F.col("pmid") / 10).cast("long").alias("_a"))
              .agg(F.to_json(F.collect_list("item")).alias("arr")))
    files = (arrays.groupBy((F.col("_a") / 10).cast("long").alias("_f"))
             .agg(F.array_join(F.array_sort(F.collect_list(F.struct("_a", "arr")))
                               .getField("arr"), "").alias("text")))
    path = _scratch(spark, "json")
    files.select("text").write.text(path)
    docs = FS.read_article_json(spark, path + "/*.txt")
    return docs.select(F.col("id.pmid").alias("pmid"), "title", "abstract", "date")


@query("read_word_vectors", oracle="""
select word, unnest(range(len(vector))) as dim, round(unnest(vector)::double, 6) as value from word_vectors""")
def q_read_word_vectors(spark, sf_dir):
    a = T.word_vectors(spark, sf_dir)
    lines = a.select(F.concat_ws(" ", "word", F.array_join(
        F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
    header = a.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit("64")).alias("value"))
    path = _scratch(spark, "vectors")
    header.unionByName(lines).coalesce(1).write.text(path)
    v = FS.read_word_vectors(spark, path)
    return normalize(v.select("word", F.posexplode("vector").alias("dim", "value")))


@query("read_ranked_table", oracle="select symbol, rank, pos from ranked")
def q_read_ranked_table(spark, sf_dir):
    r = T.ranked(spark, sf_dir).select(F.col("symbol").alias("gene"), F.col("rank").alias("score"),
                                       "pos")
    path = _scratch(spark, "ranked")
    r.orderBy("pos").coalesce(1).write.option("header", "true").csv(path)
    return FS.read_ranked_table(spark, path, "gene", "score")


@query("read_gene_names", oracle="select hgnc_id, symbol, name, alias_symbol from gene_names")
def q_read_gene_names(spark, sf_dir):
    g = T.gene_names(spark, sf_dir)
    path = _scratch(spark, "genes")
    g.write.options(header="true", sep="\t").csv(path)
    out = FS.read_gene_names(spark, path)
    return out.select(F.col("hgnc_id").cast("long").alias("hgnc_id"), "symbol", "name", "alias_symbol")
