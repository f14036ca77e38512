"""File sources: JSON article dumps, ranked tables, word vectors, name
tables, ontology pages, grid-search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubsift.functions.text import alias_set, join_definition
from pubsift.operators.ordinals import global_ordinal

ARTICLE_DOC = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("src", T.StringType()),
                                        T.StructField("license", T.StringType()),
                                        T.StructField("url", T.StringType())])),
    T.StructField("abstract", T.StringType()),
    T.StructField("id", T.StructType([T.StructField(k, T.StringType())
                                      for k in ("doi", "pmid", "ui", "pmcid")])),
    T.StructField("author", T.ArrayType(T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("publication", T.StringType()),
    T.StructField("title", T.StringType()),
])


def parse_article_json_text(texts: DataFrame, col: str = "value") -> DataFrame:
    """Article documents from dump texts made of appended JSON arrays
    ('[..][..]' seams repaired) whose items are JSON strings themselves."""
    # A seam stands between the closing and opening quotes of two items; quotes
    # inside an item are escaped, so brackets of article text never match.
    fixed = F.regexp_replace(F.trim(col), r'"\s*\]\s*\[\s*"', '","')
    items = texts.select(F.explode(F.from_json(fixed, T.ArrayType(T.StringType()))).alias("_item"))
    return items.select(F.from_json("_item", ARTICLE_DOC).alias("doc")).select("doc.*")


def read_article_json(spark: SparkSession, paths) -> DataFrame:
    """One row per article document in JSON dump files (one file = one text)."""
    texts = spark.read.option("wholetext", "true").text(paths)
    return parse_article_json_text(texts)


def read_ranked_table(spark: SparkSession, path: str, gene_column: str, rank_column: str,
                      **options) -> DataFrame:
    """(symbol, rank, pos) from a CSV; pos keeps the file order (1-based)."""
    df = spark.read.options(header="true", **options).csv(path)
    df = df.withColumn("_mid", F.monotonically_increasing_id())
    out = global_ordinal(df, ["_mid"], "pos")
    return out.select(F.col(gene_column).alias("symbol"),
                      F.col(rank_column).cast("double").alias("rank"), "pos")


def parse_word_vectors(lines: DataFrame, col: str = "value") -> DataFrame:
    """(word, vector array<float>) from 'word f1 .. fn' lines; a two-field
    header line ('count dim') is dropped."""
    parts = F.split(F.trim(col), r"\s+")
    return (lines.select(parts.alias("_p")).where(F.size("_p") > 2)
            .select(F.element_at("_p", 1).alias("word"),
                    F.transform(F.slice("_p", 2, F.size("_p") - 1), lambda x: x.cast("float"))
                    .alias("vector")))


def read_word_vectors(spark: SparkSession, paths) -> DataFrame:
    return parse_word_vectors(spark.read.text(paths))


def read_gene_names(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gene name table (hgnc_id, symbol, name, alias_symbol, ...)."""
    return spark.read.options(header="true", sep="\t").csv(path)


ONTOLOGY_PAGE = T.StructType([
    T.StructField("collection", T.ArrayType(T.StructType([
        T.StructField("prefLabel", T.StringType()),
        T.StructField("@id", T.StringType()),
        T.StructField("synonym", T.ArrayType(T.StringType())),
        T.StructField("definition", T.ArrayType(T.StringType()))]))),
    T.StructField("links", T.StructType([T.StructField("nextPage", T.StringType())])),
])


def ontology_classes(pages: DataFrame) -> DataFrame:
    """(name, alias, definition, source) from stored class pages."""
    c = pages.select(F.explode("collection").alias("c"))
    return c.select(F.col("c.prefLabel").alias("name"),
                    alias_set(F.col("c.prefLabel"), F.col("c.synonym")).alias("alias"),
                    join_definition(F.coalesce(F.col("c.definition"),
                                               F.array().cast("array<string>"))).alias("definition"),
                    F.col("c.`@id`").alias("source"))


def read_ontology_classes(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """Classes from stored pages: one JSON page per file (``multi_line``) or
    one page per line."""
    pages = spark.read.schema(ONTOLOGY_PAGE).option("multiLine", str(multi_line).lower()).json(paths)
    return ontology_classes(pages)


def read_grid_results(spark: SparkSession, root: str, sizes: DataFrame | None = None) -> DataFrame:
    """Rank-1 rows of '<corpus>/<corpus>[_<size>]_grid_results.csv' files with
    corpus (directory name) and size (from the file name, else from
    ``sizes(corpus, size)``)."""
    df = (spark.read.options(header="true", inferSchema="true", recursiveFileLookup="true")
          .csv(root).withColumn("_path", F.col("_metadata.file_path")))
    # '<root>/<corpus>/<corpus>[_<size>]_grid_results.csv' (a file, or the
    # folder Spark writes under that name).
    m = r"/([^/]+)/([^/]*_grid_results\.csv)"
    df = (df.withColumn("corpus", F.regexp_extract("_path", m, 1))
          .withColumn("_fname", F.regexp_extract("_path", m, 2))
          .withColumn("_size", F.regexp_extract(F.substr("_fname", F.length("corpus") + 2),
                                                r"^(\d+)_grid_results", 1)))
    df = df.withColumn("size", F.when(F.col("_size") != "", F.col("_size").cast("long")))
    if sizes is not None:
        df = (df.join(sizes.select("corpus", F.col("size").alias("_full")), "corpus", "left")
              .withColumn("size", F.coalesce("size", "_full")).drop("_full"))
    return df.where(F.col("rank_test_score") == 1).drop("_path", "_size", "_fname")
