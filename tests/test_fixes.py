"""Cases off the registered queries' data: seams, authors, dates, ties, gaps, repeated epochs."""

import os
import uuid

from pyspark.sql import functions as F

from pubsift.functions.text import raw_tokens
from pubsift.operators import annotations, corpus, embeddings, labels, models, ranking, search
from pubsift.session import scratch_path
from pubsift.sources import files, sinks, xml_articles
from pubsift.streaming import incremental


def test_json_seams_leave_article_text_alone(spark):
    body = 'see [1][2] and [3] [4] \\\\\\"][\\\\\\" end'
    text = '["{\\"title\\": \\"a\\", \\"body\\": \\"' + body + '\\"}"]["{\\"title\\": \\"b\\"}"] [ "{\\"title\\": \\"c\\"}" ]'
    got = files.parse_article_json_text(spark.createDataFrame([(text,)], "value string")).collect()
    assert [g["title"] for g in got] == ["a", "b", "c"]
    assert got[0]["body"] == 'see [1][2] and [3] [4] "][" end'


def test_authors_stay_in_order_with_their_initials(spark):
    xml = ("<A><AuthorList><Author><LastName>Ng</LastName></Author><Author><CollectiveName>Grp </CollectiveName></Author>"
           "<Author ValidYN='Y'><LastName>Smith</LastName><Initials>AB</Initials></Author></AuthorList></A>")
    got = spark.createDataFrame([(xml,), ("<A/>",)], "xml string").select(
        xml_articles.author_list(F.col("xml")).alias("a")).collect()
    assert [g["a"] for g in got] == [["Ng", "Grp", "Smith AB"], []]


def test_a_day_that_is_no_number_gives_no_date(spark):
    cols = ["py", "pm", "pd", "cy", "cm", "cd", "ry", "rm", "rd"]
    rows = [("2020", "2", "1-15"), ("2020", "99999999999", "1"), ("2020", "Feb", None), (None, None, None)]
    df = spark.createDataFrame([(*r, "2019", "1", "2", None, None, None) for r in rows], ",".join(f"{c} string" for c in cols))
    got = [str(r[0]) for r in df.select(xml_articles.resolve_publication_date(*[F.col(c) for c in cols])).collect()]
    assert got == ["None", "None", "2020-02-01", "2019-01-02"]


def test_queries_with_exclusions_only(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "")], "pmid long, content string")
    got = search.tag_documents_by_query(docs, {"no": {"none_of": ["alpha"]}, "yes": {"any_of": ["alpha"]}}).collect()
    assert sorted((g["query"], g["pmid"]) for g in got) == [("no", 2), ("no", 3), ("yes", 1)]


def test_first_rank_of_a_repeated_gene(spark):
    ranked = spark.createDataFrame([("G", 1.0, 1), ("G", 9.0, 5), (None, 0.0, 2)], "symbol string, rank double, pos long")
    got = ranking.attach_rank(spark.createDataFrame([("G",), ("H",)], "symbol string"), ranked).collect()
    assert {g["symbol"]: g["rank"] for g in got} == {"G": 1.0, "H": None}


def test_direction_of_a_list_with_gaps(spark):
    make = lambda rows: spark.createDataFrame(rows, "pos long, rank double")
    assert not ranking.is_ascending(make([(1, 9.0), (3, 5.0), (7, 1.0)])).first()[0]
    assert ranking.is_ascending(make([(1, 1.0), (3, 5.0), (7, 5.0)])).first()[0]


def test_registry_keeps_every_update(spark):
    path = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    for i in (1, 2, 3):
        got = sinks.id_registry_update(spark, path, spark.createDataFrame([(i,)], "pmid long"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]


def test_tokens_of_other_scripts(spark):
    row = spark.createDataFrame([("Über die Größe -- señor 1990-2000 – éte - x-ray", ""), (None, "")], "t string, u string")
    got = [r[0] for r in row.select(raw_tokens("t")).collect()]
    assert got == [["über", "die", "größe", "señor", "1990-2000", "éte", "x-ray"], None]


def test_nested_markup(spark):
    schema = "t string, s array<struct<start: int, end: int, tag: string>>"
    rows = [("alpha mark", [(0, 10, "o"), (9, 10, "i")]), ("ab", [(0, 1, "x"), (1, 2, "y"), (1, 1, "e")]),
            ("ab", [(0, 2, "x"), (0, 2, "y")]), ("ab", None), (None, [(0, 1, "x")]), ("", [])]
    got = [r["marked"] for r in annotations.render_annotations(spark.createDataFrame(rows, schema), "t", "s").collect()]
    assert got == ['<mark class="o">alpha mar<mark class="i">k</mark></mark>',
                   '<mark class="x">a</mark><mark class="y"><mark class="e"></mark>b</mark>',
                   '<mark class="x"><mark class="y">ab</mark></mark>', "ab", None, ""]


def test_oversampled_points_lie_between_neighbours(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, 0, Vectors.dense([float(i), 5.0])) for i in range(60)] + \
           [(100 + i, 1, Vectors.dense([float(i), 2.0 * i])) for i in range(4)] + [(200, 2, Vectors.dense([7.0, 7.0]))]
    data = spark.createDataFrame(rows, ["pmid", "label", "features"])
    out = models.rebalance_oversample(data, "label", "pmid", k=2).collect()
    by = {c: [tuple(r["features"]) for r in out if r["label"] == c] for c in (0, 1, 2)}
    assert [len(v) for v in by.values()] == [60, 60, 60]
    assert all(abs(y - 2 * x) < 1e-9 and 0 <= x <= 3 for x, y in by[1])  # the class lies on a line
    assert len(set(by[1])) > 40 and set(by[2]) == {(7.0, 7.0)}


def test_a_gene_without_a_sample(spark):
    rows = [("a", s, float(v)) for s, v in enumerate([1, 2, 3, 4])] + [("b", s, float(v)) for s, v in enumerate([2, 4, 6, 8])] \
        + [("c", s, float(v)) for s, v in enumerate([4, 1, 5])]
    got = embeddings.correlation_edges(spark.createDataFrame(rows, "gene string, sample int, value double"), 0.9).collect()
    assert [(g["gene_a"], g["gene_b"]) for g in got] == [("a", "b")]


def test_models_with_documents_and_features_of_their_own(spark):
    bow = spark.createDataFrame([(1, "x", 3), (1, "z", 9), (2, "y", 2), (3, "x", 1), (3, "y", 7), (9, "x", 50)], "pmid long, token string, n long")
    ys = spark.createDataFrame([(1, "A", 1), (2, "A", 0), (3, "B", 1), (1, "B", 0)], "pmid long, meshid string, y int")
    feats = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("B", "z")], "meshid string, token string")
    test = spark.createDataFrame([(7, "x", 1), (8, "y", 1), (8, "z", 1)], "pmid long, token string, n long")
    docs = spark.createDataFrame([(7,), (8,), (6,)], "pmid long")
    got = {(r["pmid"], r["meshid"]): r["y_pred"]
           for r in labels.naive_bayes_per_label(bow, ys, feats, test, docs).collect()}
    # A: x 4/5 against 1/4, y 1/5 against 3/4.  B: y 8/9 against 1/11 and z 1/9 against 10/11, together 1.2 to 1.
    assert got == {(7, "A"): 1, (8, "A"): 0, (6, "A"): 0, (7, "B"): 0, (8, "B"): 1, (6, "B"): 0}


def test_f_scores_ignore_documents_outside_the_sample(spark):
    ys = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "A", 0), (4, "A", 0)], "pmid long, meshid string, y int")
    rows = [(1, "x", 3), (2, "x", 2), (3, "x", 1)]
    make = lambda r: spark.createDataFrame(r, "pmid long, token string, n long")
    one = labels.anova_f(make(rows), ys, sampled=True).collect()
    two = labels.anova_f(make(rows + [(9, "x", 100), (8, "w", 1)]), ys, sampled=True).collect()
    assert one == two and abs(one[0]["f"] - 8.0) < 1e-9


def test_warning_needs_one_version_twice_in_one_file(spark):
    rows = [(1, 1, 0, 0), (1, 1, 1, 0), (2, 1, 0, 0), (2, 1, 0, 1)]
    got = corpus.latest_version(spark.createDataFrame(rows, "pmid long, version int, file_pos int, article_pos int")).collect()
    assert {g["pmid"]: g["warn"] for g in got} == {1: False, 2: True}


def test_word2vec_trains_in_several_tasks(spark):
    sents = spark.createDataFrame([(["a", "b", "c"],)] * 40 + [(["x", "y", "z"],)] * 40, "tokens array<string>")
    model, vecs = embeddings.word2vec(sents, size=8, min_count=1, max_iter=2)
    assert model.getNumPartitions() > 1 and {r["word"] for r in vecs.collect()} == set("abcxyz")


def test_fit_per_label_separates_and_keeps_one_class_labels(spark):
    from pyspark.ml.functions import array_to_vector

    feats = spark.range(40).select(F.col("id").alias("pmid"), array_to_vector(
        F.array((F.col("id") % 2).cast("double"), F.lit(1.0))).alias("features"))
    odd = feats.select("pmid", F.lit("odd").alias("meshid"), (F.col("pmid") % 2).cast("int").alias("y"))
    always = feats.select("pmid", F.lit("always").alias("meshid"), F.lit(1).alias("y"))
    part = odd.where("pmid < 35").withColumn("meshid", F.lit("part"))
    split = feats.select("pmid", F.when(F.col("pmid") < 30, "train").otherwise("test").alias("split"))
    labels = ["odd", "always", "part", "absent"]
    for factory in (models.logistic_factory(max_iter=10), models.linear_svm_factory(max_iter=10),
                    models.mlp_factory(2, hidden=4, max_iter=30), models.naive_bayes_factory()):
        out = models.fit_per_label(feats, odd.union(always).union(part), split, labels, factory).collect()
        assert {(r.pmid, r.meshid) for r in out} == (
            {(i, m) for i in range(30, 40) for m in ("odd", "always")} | {(i, "part") for i in range(30, 35)})
        assert all(r.y_pred == 1 for r in out if r.meshid == "always")
    for factory in (models.logistic_factory(max_iter=10), models.linear_svm_factory(max_iter=10)):
        out = models.fit_per_label(feats, odd, split, ["odd"], factory).collect()
        assert all(r.y_pred == r.y for r in out)


def test_enrichment_by_date_modes(spark):
    """Duplicate and NULL genes, a descending list, a date without a prefix."""
    genes = ["a", "b", None, "c", "a", "d", "e", "f", "g", "h"]
    for sign in (1.0, -1.0):
        ranked = spark.createDataFrame([(g, sign * (i + 1), i + 1) for i, g in enumerate(genes)],
                                       "symbol string, rank double, pos long")
        clean = ranking.clean_ranked(ranked)
        firsts = spark.createDataFrame([("h", "2000-01-01"), ("a", "2001-01-01"), ("c", "2002-01-01")],
                                       "symbol string, date string").join(clean.select("symbol", "rank"), "symbol")
        nulls = ranking.null_rank_sums(clean, 200)
        edge = {r.stratum_date: (r.known_gene, r.frontier_gene)
                for r in ranking.enrichment_by_date(firsts, ranked, nulls, 0.2).collect()}
        assert edge["2000-01-01"] == (None, None)
        assert edge["2001-01-01"] == ("a", "a")
        # a, then c after b: scores 1/3, 1/3 - 1/5, 2/3 - 1/5 (highest), ...
        assert edge["2002-01-01"][1] == "c"
        classic = ranking.enrichment_by_date(firsts, ranked, nulls, 0.2, use_leading_edge=False)
        assert {r.stratum_date for r in classic.collect()} == set(edge)
