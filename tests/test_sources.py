"""Hand-made fixtures: XML dumps, checksums, JSON dumps, tables, vectors."""

import gzip
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from places import FIXTURES
from pubsift.operators import corpus as C
from pubsift.operators import dictionary as D
from pubsift.operators import ranking as R
from pubsift.sources import files as FS
from pubsift.sources import xml_articles as XA


@pytest.fixture(scope="module")
def dumps(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    for name in ("articles_1", "articles_2"):
        raw = open(os.path.join(FIXTURES, f"{name}.xml"), "rb").read()
        gz = d / f"{name}.xml.gz"
        with gzip.open(gz, "wb") as f:
            f.write(raw)
        digest = hashlib.md5(gz.read_bytes()).hexdigest()
        (d / f"{name}.xml.gz.md5").write_text(f"MD5({name}.xml.gz)= {digest}\n")
    bad = d / "articles_bad.xml.gz"
    shutil.copy(d / "articles_2.xml.gz", bad)
    (d / "articles_bad.xml.gz.md5").write_text("MD5(articles_bad.xml.gz)= 0123456789abcdef\n")
    return d


def test_records_and_positions(spark, dumps):
    recs = XA.read_xml_records(spark, str(dumps / "articles_1.xml.gz")).orderBy("rec_pos").collect()
    assert [r.rec_pos for r in recs] == list(range(7))
    raw = gzip.open(dumps / "articles_1.xml.gz").read()
    for r in recs:
        chunk = raw[r.start:r.start + r.length]
        assert chunk.startswith(b"<PubmedArticle>") and chunk.endswith(b"</PubmedArticle>")


def test_parse_fields(spark, dumps):
    p = {(r.pmid, r.rec_pos): r for r in XA.parse_articles(
        XA.read_xml_records(spark, str(dumps / "articles_1.xml.gz"))).collect()}
    a = p[(101, 0)]
    assert a.title == "On MYCN gain in tumours"
    assert a.abstract == "First part with bold text. Second part."
    assert str(a.date) == "2000-02-05"
    assert a.mesh == ["D000001", "D000002"]
    assert p[(102, 1)].has_abstract is False
    assert p[(103, 2)].date is None            # Feb 30: invalid PubDate, no fall-through
    assert str(p[(104, 3)].date) == "2010-07-09"  # DateCompleted only
    assert p[(105, 4)].date is None            # unknown month name
    assert p[(106, 5)].date is None            # no date
    assert str(p[(101, 6)].date) == "2000-01-01"  # year only
    assert p[(106, 5)].mesh == []


def test_latest_version_across_files(spark, dumps):
    arts = XA.articles_from_xml(spark, str(dumps / "articles_[12].xml.gz"))
    latest = {r.pmid: r for r in C.latest_version(arts.drop("mesh")).collect()}
    assert 102 not in latest                     # no abstract: dropped
    assert latest[101].title == "Repeated in the same file"  # later position wins
    assert latest[103].title == "Revised in a later file" and latest[103].version == 2
    assert latest[104].version is None           # never updated
    assert str(latest[107].date) == "2012-11-30"  # DateRevised only


def test_locator_last_occurrence_wins(spark, dumps):
    loc = {r.pmid: r for r in XA.article_locator(
        XA.read_xml_records(spark, str(dumps / "articles_[12].xml.gz"))).collect()}
    assert loc[103].file == "articles_2.xml.gz"
    raw = gzip.open(dumps / "articles_1.xml.gz").read()
    r = loc[101]
    assert b"Repeated in the same file" in raw[r.start:r.start + r.length]


def test_accessions_and_authors(spark, dumps):
    recs = XA.read_xml_records(spark, str(dumps / "articles_1.xml.gz"))
    acc = [r.accession for r in XA.accession_numbers(recs).collect()]
    assert acc == ["GSE1234"]
    doc = XA.parse_article_doc(recs).where("title like 'On %'").first()
    assert doc.author == ["Smith AB", "Study Group"]
    assert doc.publication == "Journal A"


def test_verify_checksums(spark, dumps):
    st = {os.path.basename(r.file): r.status for r in XA.verify_checksums(
        spark, str(dumps / "*.xml.gz"), str(dumps / "*.md5")).collect()}
    assert st == {"articles_1.xml.gz": "ok", "articles_2.xml.gz": "ok",
                  "articles_bad.xml.gz": "mismatch"}


def test_mesh_descriptors(spark):
    out = {r.id: r.name for r in XA.read_mesh_descriptors(
        spark, os.path.join(FIXTURES, "descriptors.xml")).collect()}
    assert out == {"D000001": "Alpha term", "D000002": "Beta & gamma"}


def test_json_dump_with_seams(spark):
    docs = FS.read_article_json(spark, os.path.join(FIXTURES, "docs.json")).collect()
    assert sorted(d.id.pmid for d in docs) == ["1", "2", "3"]
    assert [d.author for d in docs if d.id.pmid == "1"] == [["A B"]]


def test_ranked_tables(spark):
    r = FS.read_ranked_table(spark, os.path.join(FIXTURES, "ranked.csv"), "gene", "score")
    clean = {x.symbol: (x.rank, x.pos) for x in R.clean_ranked(r).collect()}
    assert clean == {"TP53": (1.0, 1), "MYCN": (2.0, 2), "ALK": (2.5, 4), "PHOX2B": (4.0, 6)}
    assert R.is_ascending(r.where("symbol is not null")).first()[0] is True
    d = FS.read_ranked_table(spark, os.path.join(FIXTURES, "ranked_desc.csv"), "gene", "score")
    assert R.is_ascending(d).first()[0] is False


def test_word_vectors_with_and_without_header(spark):
    for name in ("vectors.txt", "vectors_header.txt"):
        v = {r.word: r.vector for r in FS.read_word_vectors(spark, os.path.join(FIXTURES, name)).collect()}
        assert sorted(v) == ["w1", "w2"] and len(v["w1"]) == 3


def test_gene_names_alias_lists_and_concepts(spark):
    g = FS.read_gene_names(spark, os.path.join(FIXTURES, "gene_names.tsv"))
    lists = D.gene_alias_lists(g.withColumn("hgnc_id", F.col("hgnc_id").cast("long")))
    rows = {r.symbol: r.aliases for r in lists.collect()}
    assert rows["MYCN"] == ["MYCN", "MYCN proto-oncogene"]        # null alias field
    assert rows["TP53"] == ["TP53", "tumor protein p53", "P53", "LFS1"]
    ids = D.concept_ids(lists).collect()
    assert sorted(r.tid for r in ids) == list(range(len(ids)))
    first = {}
    for r in sorted(ids, key=lambda r: r.tid):
        first.setdefault(r.symbol, r.tid)
    assert all(r.cid == first[r.symbol] for r in ids)
    shared = [r.symbol for r in ids if r.alias == "P53"]
    assert sorted(shared) == ["ALK", "TP53"]                       # one alias, two symbols
