"""Article XML dumps as DataFrames.

A dump file is a ``<PubmedArticleSet>`` of ``<PubmedArticle>`` records.  The
text source with ``lineSep = '</PubmedArticle>'`` yields one row per record
(record-at-a-time, no DOM of the whole file); fields come from the built-in
``xpath_*`` functions.  The built-in XML data source is not used for titles
and abstracts: it reorders mixed content (``On <i>MYCN</i> gain``).

Gzip files are not splittable, so a dump file is one task; the records are
spread by a hash shuffle on pmid right after parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubsift.functions.text import MONTHS, MONTH_NAMES, col_of

RECORD = "PubmedArticle"

# Element paths of the article record.
P_PMID = "//MedlineCitation/PMID"
P_VERSION = "//MedlineCitation/PMID/@Version"
P_TITLE = "//Article/ArticleTitle"
P_ABSTRACT = "//Article/Abstract"
P_ABSTRACT_TEXT = "//Article/Abstract/AbstractText//text()"
P_PUB = "//Article/Journal/JournalIssue/PubDate"
P_COMPLETED = "//MedlineCitation/DateCompleted"
P_REVISED = "//MedlineCitation/DateRevised"
P_MESH = "//MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName/@UI"
P_ACCESSION = "//AccessionNumberList/AccessionNumber/text()"
P_JOURNAL = "//Article/Journal/Title"


def read_xml_records(spark: SparkSession, paths, tag: str = RECORD) -> DataFrame:
    """(file, file_name, rec_pos, xml, start, length): one row per record.

    ``rec_pos`` is the 0-based position of the record in its file and
    ``start``/``length`` its byte span in the (decompressed) file: running
    sums of the chunk lengths between separators.  The order of chunks inside
    a file follows ``monotonically_increasing_id`` (partition, then row).
    """
    end = f"</{tag}>"
    raw = (spark.read.option("lineSep", end).option("wholetext", "false").text(paths)
           .select(F.col("value"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_name").alias("file_name"),
                   F.monotonically_increasing_id().alias("_mid")))
    # One window per file (a dump file is a bounded unit of work).
    w = Window.partitionBy("file").orderBy("_mid")
    chunk_bytes = F.octet_length("value") + F.lit(len(end.encode()))
    raw = raw.withColumn("_end", F.sum(chunk_bytes).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = open_tag_position(F.col("value"), tag)  # 1-based, 0 = not found (file trailer)
    recs = raw.where(at > 0)
    body = F.substr(F.col("value"), at)
    prefix_bytes = F.octet_length(F.substr(F.col("value"), F.lit(1), at - 1))
    return recs.select(
        "file", "file_name",
        (F.row_number().over(w) - 1).alias("rec_pos"),
        F.concat(body, F.lit(end)).alias("xml"),
        (F.col("_end") - chunk_bytes + prefix_bytes).alias("start"),
        (F.octet_length(body) + F.lit(len(end.encode()))).alias("length"))


def open_tag_position(text: Column, tag: str = RECORD) -> Column:
    """1-based position of the record's opening tag (``<tag>`` or ``<tag
    attr..>``, not ``<tagSet>``), 0 when absent."""
    return F.regexp_instr(text, F.lit(f"<{tag}[\\s>]"))


def _x(xml: Column, path: str) -> Column:
    return F.xpath_string(xml, F.lit(path))


def _present(xml: Column, path: str) -> Column:
    return F.xpath_boolean(xml, F.lit(path))


def _part(xml: Column, base: str, field: str) -> Column:
    v = F.trim(_x(xml, f"{base}/{field}"))
    return F.when(v != "", v)


def month_number(m: Column) -> Column:
    names = F.create_map(*[x for i, n in enumerate(MONTHS) for x in (F.lit(n), F.lit(i + 1))])
    full = F.create_map(*[x for i, n in enumerate(MONTH_NAMES) for x in (F.lit(n), F.lit(i + 1))])
    low = F.lower(F.trim(m))
    return F.coalesce(F.when(low.rlike("^[0-9]+$"), low.try_cast("int")),
                      F.element_at(names, low), F.element_at(full, low))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m.cast("string"), d.cast("string")), "y-M-d")


def resolve_publication_date(pub_year, pub_month, pub_day, comp_year, comp_month, comp_day,
                             rev_year, rev_month, rev_day, dummy: bool = False) -> Column:
    """PubDate (month numeric or named, default 1; day default 1) if it has a
    year — an invalid PubDate does NOT fall through; else DateCompleted; else
    DateRevised; else NULL (or 0001-01-01 with ``dummy``)."""
    py, pm, pd_ = col_of(pub_year), col_of(pub_month), col_of(pub_day)
    month = F.when(pm.isNull(), F.lit(1)).otherwise(month_number(pm))
    # A day that is no number makes the date invalid; it never ends the job.
    day = F.when(pd_.isNull(), F.lit(1)).otherwise(pd_.try_cast("int"))
    pub = F.when(month.isNotNull() & day.isNotNull(), _ymd(py, month, day))
    comp = _ymd(col_of(comp_year), col_of(comp_month), col_of(comp_day))
    rev = _ymd(col_of(rev_year), col_of(rev_month), col_of(rev_day))
    out = (F.when(py.isNotNull(), pub).when(col_of(comp_year).isNotNull(), comp)
           .when(col_of(rev_year).isNotNull(), rev))
    return F.coalesce(out, F.lit("0001-01-01").cast("date")) if dummy else out


def parse_articles(records: DataFrame, keep_xml: bool = False) -> DataFrame:
    """(pmid, version, title, abstract, has_title, has_abstract, date, mesh,
    journal, file, rec_pos, start, length).

    The abstract is every AbstractText part in order, nested markup text
    included, parts separated by one space.
    """
    xml = F.col("xml")
    spaced = F.regexp_replace(xml, "</AbstractText>", " </AbstractText>")
    parts = {}
    for base, tag in ((P_PUB, "pub"), (P_COMPLETED, "comp"), (P_REVISED, "rev")):
        for field, short in (("Year", "year"), ("Month", "month"), ("Day", "day")):
            parts[f"{tag}_{short}"] = _part(xml, base, field)
    out = records.select(
        F.xpath_long(xml, F.lit(P_PMID)).alias("pmid"),
        F.when(_present(xml, P_VERSION), F.xpath_int(xml, F.lit(P_VERSION))).alias("version"),
        _x(xml, P_TITLE).alias("title"),
        F.trim(F.array_join(F.xpath(spaced, F.lit(P_ABSTRACT_TEXT)), "")).alias("abstract"),
        _present(xml, P_TITLE).alias("has_title"),
        _present(xml, P_ABSTRACT).alias("has_abstract"),
        *[c.alias(k) for k, c in parts.items()],
        F.xpath(xml, F.lit(P_MESH)).alias("mesh"),
        F.when(_present(xml, P_JOURNAL), _x(xml, P_JOURNAL)).alias("journal"),
        "file", "rec_pos", "start", "length", *(["xml"] if keep_xml else []))
    out = out.withColumn("date", resolve_publication_date(*[F.col(k) for k in parts]))
    return out.drop(*parts)


def articles_from_xml(spark: SparkSession, paths, tag: str = RECORD) -> DataFrame:
    """Article rows as ``latest_version`` expects them: records lacking a
    title or abstract element are dropped (they still used a position);
    file_pos = rank of the file name among the input files."""
    recs = parse_articles(read_xml_records(spark, paths, tag))
    files = recs.select("file").distinct()
    # The file list is one row per input file: bounded by the dump listing.
    file_pos = files.select("file", (F.dense_rank().over(Window.orderBy("file")) - 1)
                            .cast("int").alias("file_pos"))
    return (recs.where("has_title and has_abstract").join(F.broadcast(file_pos), "file")
            .select("pmid", "version", "title", F.col("abstract").alias("content"), "date",
                    "file_pos", F.col("rec_pos").cast("int").alias("article_pos"), "mesh"))


def extract_mesh_terms(records: DataFrame) -> DataFrame:
    """(pmid, mesh array): descriptor ids, empty when absent."""
    xml = F.col("xml")
    return records.select(F.xpath_long(xml, F.lit(P_PMID)).alias("pmid"),
                          F.xpath(xml, F.lit(P_MESH)).alias("mesh"))


def accession_numbers(records: DataFrame, prefix: str = "G") -> DataFrame:
    """(pmid, accession) for accession numbers starting with ``prefix``."""
    xml = F.col("xml")
    a = records.select(F.xpath_long(xml, F.lit(P_PMID)).alias("pmid"),
                       F.explode(F.xpath(xml, F.lit(P_ACCESSION))).alias("accession"))
    return a.where(F.col("accession").startswith(prefix))


def article_locator(records: DataFrame) -> DataFrame:
    """pmid -> (file, start, length); the last occurrence (file order, then
    position) wins."""
    r = records.select(F.xpath_long("xml", F.lit(P_PMID)).alias("pmid"),
                       "file_name", "rec_pos", "start", "length")
    best = r.groupBy("pmid").agg(F.max(F.struct("file_name", "rec_pos", "start", "length"))
                                 .alias("_b"))
    return best.select("pmid", F.col("_b.file_name").alias("file"),
                       F.col("_b.start").alias("start"), F.col("_b.length").alias("length"))


def author_list(xml: Column) -> Column:
    """'LastName Initials' of personal authors and the names of collective ones
    (trimmed), author by author in their order, as array<string>."""
    one = F.regexp_extract_all(xml, F.lit(r"(?s)<Author(?:\s[^>]*)?>.*?</Author>"), F.lit(0))

    def name(a: Column) -> Column:
        at = lambda tag: F.xpath_string(a, F.lit(f"/Author/{tag}"))
        person = F.trim(F.concat_ws(" ", F.trim(at("LastName")), F.trim(at("Initials"))))
        return F.when(F.trim(at("LastName")) != "", person).otherwise(F.trim(at("CollectiveName")))

    return F.filter(F.transform(one, name), lambda n: n != "")


def parse_article_doc(records: DataFrame) -> DataFrame:
    """Nested article document: meta{src, license, url}, abstract, id{pmid},
    author list ('LastName Initials' or CollectiveName), date (y-m-d),
    publication (journal title), title; plus its JSON text."""
    authors = author_list(F.col("xml"))
    p = parse_articles(records, keep_xml=True).withColumn("author", authors)
    doc = p.select(
        F.struct(F.lit("pubmed").alias("src"), F.lit(None).cast("string").alias("license"),
                 F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid").cast("string"))
                 .alias("url")).alias("meta"),
        "abstract",
        F.struct(F.lit(None).cast("string").alias("doi"), F.col("pmid").cast("string").alias("pmid"),
                 F.lit(None).cast("string").alias("ui"), F.lit(None).cast("string").alias("pmcid"))
        .alias("id"),
        "author", F.lit(None).cast("string").alias("body"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("journal").alias("publication"), "title")
    return doc.withColumn("json", F.to_json(F.struct(*[F.col(c) for c in doc.columns])))


def read_mesh_descriptors(spark: SparkSession, paths) -> DataFrame:
    """(id, name) from a descriptor XML dump."""
    recs = read_xml_records(spark, paths, "DescriptorRecord")
    xml = F.col("xml")
    return recs.select(_x(xml, "//DescriptorRecord/DescriptorUI").alias("id"),
                       _x(xml, "//DescriptorRecord/DescriptorName/String").alias("name"))


# ------------------------------------------------------------------ writing
def _esc(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def render_article_xml(articles: DataFrame, mesh: DataFrame | None = None,
                       accessions: DataFrame | None = None,
                       authors: DataFrame | None = None) -> DataFrame:
    """(pmid, xml): article records in dump layout, from (pmid, version,
    title, content, date[, file_pos, article_pos]).  Month is written as a
    number, abbreviation or full name depending on the pmid, to exercise the
    date parser."""
    a = articles
    if mesh is not None:
        m = mesh.groupBy("pmid").agg(F.array_sort(F.collect_set("meshid")).alias("_mesh"))
        a = a.join(m, "pmid", "left")
    else:
        a = a.withColumn("_mesh", F.array().cast("array<string>"))
    acc = F.lit("")
    if accessions is not None:
        g = accessions.groupBy("pmid").agg(F.array_sort(F.collect_set("accession")).alias("_acc"))
        a = a.join(g, "pmid", "left")
        acc = F.when(F.size("_acc") > 0, F.concat(
            F.lit("<DataBankList><DataBank><AccessionNumberList>"),
            F.array_join(F.transform("_acc", lambda x: F.concat(
                F.lit("<AccessionNumber>"), _esc(x), F.lit("</AccessionNumber>"))), ""),
            F.lit("</AccessionNumberList></DataBank></DataBankList>"))).otherwise(F.lit(""))
    auth = F.lit("")
    if authors is not None:
        g = authors.groupBy("pmid").agg(F.array_sort(F.collect_list(
            F.struct("pos", "last_name", "initials", "collective"))).alias("_au"))
        a = a.join(g, "pmid", "left")
        one = lambda x: F.concat(
            F.lit("<Author>"),
            F.when(x["collective"].isNotNull(), F.concat(
                F.lit("<CollectiveName>"), _esc(x["collective"]), F.lit("</CollectiveName>")))
            .otherwise(F.concat(F.lit("<LastName>"), _esc(x["last_name"]), F.lit("</LastName><Initials>"),
                                _esc(x["initials"]), F.lit("</Initials>"))),
            F.lit("</Author>"))
        auth = F.when(F.size("_au") > 0, F.concat(F.lit("<AuthorList>"),
                                                  F.array_join(F.transform("_au", one), ""),
                                                  F.lit("</AuthorList>"))).otherwise(F.lit(""))
    journal = _esc(F.coalesce(F.col("source"), F.lit(""))) if "source" in a.columns else F.lit("")
    mon = F.month("date")
    abbr = F.element_at(F.array(*[F.lit(x.capitalize()) for x in MONTHS]), mon)
    full = F.element_at(F.array(*[F.lit(x.capitalize()) for x in MONTH_NAMES]), mon)
    month = (F.when(F.col("pmid") % 3 == 0, F.lpad(mon.cast("string"), 2, "0"))
             .when(F.col("pmid") % 3 == 1, abbr).otherwise(full))
    heads = F.array_join(F.transform(F.coalesce("_mesh", F.array().cast("array<string>")),
                                     lambda x: F.concat(F.lit('<MeshHeading><DescriptorName UI="'),
                                                        x, F.lit('">'), x,
                                                        F.lit("</DescriptorName></MeshHeading>"))), "")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation Status=\"MEDLINE\"><PMID Version=\""),
        F.col("version").cast("string"), F.lit("\">"), F.col("pmid").cast("string"),
        F.lit("</PMID><Article><Journal><Title>"), journal,
        F.lit("</Title><JournalIssue><PubDate><Year>"), F.year("date").cast("string"),
        F.lit("</Year><Month>"), month, F.lit("</Month><Day>"), F.dayofmonth("date").cast("string"),
        F.lit("</Day></PubDate></JournalIssue></Journal><ArticleTitle>"), _esc(F.col("title")),
        F.lit("</ArticleTitle><Abstract><AbstractText>"), _esc(F.col("content")),
        F.lit("</AbstractText></Abstract>"), auth, acc, F.lit("</Article>"),
        F.when(F.size("_mesh") > 0, F.concat(F.lit("<MeshHeadingList>"), heads,
                                             F.lit("</MeshHeadingList>"))).otherwise(F.lit("")),
        F.lit("</MedlineCitation></PubmedArticle>"))
    return a.select("pmid", xml.alias("xml"))


def verify_checksums(spark: SparkSession, data_glob: str, md5_glob: str,
                     manifest_key: str = "side_file") -> DataFrame:
    """(file, md5, expected, status): md5 of each file's bytes against its
    side file (hash = second whitespace token); status is 'ok', 'mismatch' or
    'unverified' (no side file).

    ``manifest_key`` says how a side file names its data file: 'side_file' =
    '<data file>.md5' next to it; 'partition' = a folder ``f=<data file
    name>`` (side files written by Spark with ``partitionBy``)."""
    data = (spark.read.format("binaryFile").load(data_glob)
            .select(F.col("path").alias("file"), F.md5("content").alias("md5")))
    if manifest_key == "partition":
        data = data.withColumn("_key", F.element_at(F.split("file", "/"), -1))
        side_key = F.regexp_extract(F.col("_metadata.file_path"), r"/f=([^/]+)/[^/]+$", 1)
    else:
        data = data.withColumn("_key", F.regexp_replace("file", "^file:", ""))
        side_key = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"\.md5$", ""),
                                    "^file:", "")
    side = (spark.read.text(md5_glob).select(
        side_key.alias("_key"),
        F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("expected"))
        .where(F.col("expected").isNotNull()))
    j = data.join(side, "_key", "left").drop("_key")
    return j.withColumn("status", F.when(F.col("expected").isNull(), "unverified")
                        .when(F.lower("expected") == F.col("md5"), "ok").otherwise("mismatch"))
