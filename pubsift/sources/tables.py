"""Driver tables and the domain views built on them.

The test tables are generic (documents, labels, embeddings, events ...); the
library works on articles, headings, dictionaries, ranked lists, embeddings and
annotation events.  These adapters derive the domain tables from the driver
tables with plain projections, so every query's work grows with the input.
Each adapter has a DuckDB twin in :mod:`pubsift.plans.oracle`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.functions.text import TOKEN_RUN

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the adapters (shared with the oracle SQL).
TITLE_PATTERN = "^[^.!?\n]*"
DATE_ORIGIN = "1990-01-01"
DATE_STEP, DATE_SPAN = 37, 12000
REVISION_EVERY = 10
MIN_TERM_LENGTH = 7


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a text table by ``key`` when the scan gives fewer
    partitions than there are cores (one unsplittable file or row group).

    On a cluster with many input files the scan already has enough
    partitions and no shuffle is added.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        # Same partition count as shuffles, so later aggregations and joins on
        # the id reuse this partitioning instead of moving the text again.
        n = int(spark.conf.get("spark.sql.shuffle.partitions", str(cores)))
        return df.repartition(max(n, cores), key)
    return df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, version, title, content, date, file_pos, article_pos, lang, source).

    Title = first sentence of the document text, content = the rest.
    """
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    title = F.regexp_extract("text", TITLE_PATTERN, 0)
    return d.select(
        F.col("doc_id").alias("pmid"),
        F.lit(1).alias("version"),
        title.alias("title"),
        F.substr(F.col("text"), F.length(title) + 2).alias("content"),
        F.date_add(F.lit(DATE_ORIGIN).cast("date"),
                   ((F.col("doc_id") * DATE_STEP) % DATE_SPAN).cast("int")).alias("date"),
        F.lit(0).alias("file_pos"),
        F.col("doc_id").cast("int").alias("article_pos"),
        "lang", "source",
    )


def articles_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article once, plus a revised copy (version 2, second file) of every
    tenth article: the input of ``latest_version``."""
    a = articles(spark, sf_dir).select("pmid", "version", "title", "content", "date",
                                       "file_pos", "article_pos")
    revised = (a.where(F.col("pmid") % REVISION_EVERY == 0)
               .select("pmid", F.lit(2).alias("version"), "title",
                       F.concat("content", F.lit(" Revised.")).alias("content"),
                       "date", F.lit(1).alias("file_pos"), "article_pos"))
    return a.unionByName(revised)


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form headings (pmid, meshid): language, source, quality, toxicity."""
    a = articles(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels")
    return (a.select("pmid", F.concat(F.lit("L_"), "lang").alias("meshid"))
            .unionByName(a.select("pmid", F.concat(F.lit("S_"), "source").alias("meshid")))
            .unionByName(lab.where("quality = 1")
                         .select(F.col("doc_id").alias("pmid"), F.lit("Q_high").alias("meshid")))
            .unionByName(lab.where("toxic = 1")
                         .select(F.col("doc_id").alias("pmid"), F.lit("Q_toxic").alias("meshid"))))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term dictionary (symbol, alias): long words of the benchmark passages."""
    b = read_table(spark, sf_dir, "benchmark")
    w = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_RUN), 0)).alias("w"))
    return (w.where(F.length("w") >= MIN_TERM_LENGTH)
            .select(F.upper("w").alias("symbol"), F.col("w").alias("alias"))
            .distinct())


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked list (symbol, rank, pos): a deterministic experiment over the dictionary.

    Its positions are a distributed ordinal, written under the checkpoint
    folder by each query that asks for it."""
    from pubsift.operators.ordinals import global_ordinal

    syms = dictionary(spark, sf_dir).select("symbol").distinct().withColumn("_k", F.md5("symbol"))
    out = global_ordinal(syms, ["_k", "symbol"], "pos")
    return out.select("symbol", F.col("pos").cast("double").alias("rank"), "pos")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a word: the input of queries on one model."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        F.col("embedding").alias("vector"), "label")


def embedding_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 3 != 0).select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        F.col("embedding").alias("vector"), "label")


def embedding_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 3 != 1).select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        F.reverse("embedding").alias("vector"), "label")


def annotation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts",
        (F.col("user_id") % 10).cast("int").alias("gid"),
        F.col("user_id").cast("int").alias("docid"),
        (F.col("event_id") % 20).cast("int").alias("annot_id"),
        F.when(F.col("event_type") == "purchase", "delete")
         .when(F.col("event_type") == "view", "doc_annotation")
         .otherwise("segment_annotation").alias("type"),
        F.col("event_type").alias("tag"), "value")


def gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene-name table (hgnc_id, symbol, name, alias_symbol) from the benchmark
    passages: the distinct long words of a passage in order of appearance give
    the symbol (first, upper-cased), the name (second) and '|'-joined aliases
    (the rest).  Words recur across passages, so aliases are shared."""
    b = read_table(spark, sf_dir, "benchmark")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_RUN), 0),
                                      lambda w: F.length(w) >= MIN_TERM_LENGTH))
    w = b.select(F.col("item_id").alias("hgnc_id"), words.alias("_w")).where(F.size("_w") >= 1)
    return w.select(
        "hgnc_id", F.upper(F.element_at("_w", 1)).alias("symbol"),
        F.try_element_at("_w", F.lit(2)).alias("name"),
        F.when(F.size("_w") > 2, F.array_join(F.slice("_w", F.lit(3), F.size("_w") - 2), "|"))
        .alias("alias_symbol"))
