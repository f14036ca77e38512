"""One list of tokens a document: vocabulary, sequences, lemmas and features as from the token table."""

from pyspark.sql import functions as F

from pubsift.operators import models as M
from pubsift.operators import text as X
from pubsift.streaming import incremental as INC

DOCS = [(1, "Red fox. Blue 12 fox", "ran. Fast fox"), (2, "", None), (3, "blue!", "red red"), (1, "Green. Owl", "x-1"),
        (None, "lost fox", "y"), (None, "gone", "fox. z")]


def docs(spark):
    return spark.createDataFrame(DOCS, "pmid long, title string, content string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_hold_the_token_table(spark):
    lists = {r.pmid: r.tokens for r in X.document_token_lists(docs(spark)).collect()}
    rows = X.sentence_token_table(docs(spark)).collect()
    assert lists == {i: [r.token for r in sorted((r for r in rows if r.pmid == i), key=lambda r: (r.sent_pos, r.tok_pos, r.token))]
                     for i in {r.pmid for r in rows}}


def test_vocabulary_and_sequences_of_lists(spark):
    lists, table = X.document_token_lists(docs(spark)), X.sentence_token_table(docs(spark))
    a, b = X.vocabulary(lists), X.vocabulary(table)
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    known = b.where("token <> 'ran'")
    for width in (2, 4, 50):
        for with_docs in (None, docs(spark)):
            one, two = (sorted((str(r.pmid), r.seq) for r in X.pad_sequences(t, known, width, docs=with_docs).collect())
                        for t in (lists, table))
            assert one == two


def test_texts_are_cut_once_for_sequences(spark):
    """The vocabulary and the sequences each cut every text into tokens, and all tokens met the vocabulary."""
    lists = X.document_token_lists(docs(spark))
    assert "regexp_extract_all" not in plan(lists)
    assert "regexp_extract_all" not in plan(X.pad_sequences(lists, X.vocabulary(lists), 3))


def test_small_lemma_tables_are_broadcast(spark):
    """The size of the lemmas was not known, so all tokens were shuffled to meet them."""
    table = X.sentence_token_table(docs(spark))
    words = X.vocabulary(X.document_token_lists(docs(spark))).select("token")
    lemmas = words.join(words.select(F.concat("token", F.lit("s")).alias("form")), F.col("token") == F.col("form"), "left").select(
        F.col("token").alias("form"), F.upper("token").alias("lemma"))
    out = X.normalise_tokens(table, lemmas)
    assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)
    assert sorted(r.token for r in out.collect()) == sorted(r.token for r in table.collect())


def test_features_of_lists(spark):
    lists, table = X.document_token_lists(docs(spark)), X.sentence_token_table(docs(spark))
    for with_docs in (None, docs(spark)):
        one, two = (sorted((str(r.pmid), str(r.features)) for r in M.hashed_features(t, 64, docs=with_docs).collect())
                    for t in (lists, table))
        assert one == two


def test_topics_read_written_features(spark):
    """Every pass of the fit cut all texts into tokens and grouped them again."""
    spark.sparkContext.setJobGroup("topics", "topics")
    _, dist = M.topics(X.document_token_lists(docs(spark)), k=2, max_iter=2, num_features=32, docs=docs(spark))
    assert "Exchange" not in plan(dist) and "regexp_extract_all" not in plan(dist)
    shares = dist.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("s")).collect()
    assert all(abs(r.s / r.n - 0.5) < 1e-6 for r in shares) and len(shares) == 4


def test_sentence_words_are_cut_once(spark):
    """The stages of the fit and the test each cut all sentences again."""
    rows = [(f"good word {i} {'fine' if i % 2 else 'bad'}", str(i % 2)) for i in range(80)]
    model, acc = M.sentence_classifier(spark.createDataFrame(rows, "sentence string, weight string"))
    assert len(model.stages) == 4 and acc.first()[0] == 1.0
    assert "RegexTokenizer" not in plan(acc) and "md5" not in plan(acc)
    assert model.transform(spark.createDataFrame(rows[:2], "sentence string, weight string")).count() == 2


def test_records_of_a_file_stay_in_their_tasks(spark, tmp_path):
    """A window over the file gathered all its records in one task, which then parsed them."""
    body = "".join(f"<PubmedArticle><x>{i}</x></PubmedArticle>" for i in range(50))
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{body}</PubmedArticleSet>")
    chunks = spark.read.option("lineSep", INC.END).text(str(tmp_path)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    recs = INC._chunks_to_records(chunks)
    assert "Window" not in plan(recs) and "Exchange" not in plan(recs)
    got = [r.xml for r in recs.orderBy("rec_pos").collect()]
    assert got == [f"<PubmedArticle><x>{i}</x></PubmedArticle>" for i in range(50)]


def test_topics_run_all_their_passes(spark, monkeypatch):
    """F8: the query ran 20 of the 100 mini-batches, a twentieth of the documents each, over a quarter of the slots."""
    from pyspark.ml import clustering

    from pubsift.plans import q_models
    from pubsift.sources import tables

    fitted, fit = [], clustering.LDA.fit

    def told(lda, rows):
        fitted.append((lda.getMaxIter() * lda.getSubsamplingRate(), rows.first()["features"].size,
                       rows.rdd.getNumPartitions()))
        return fit(lda.setMaxIter(1), rows)

    monkeypatch.setattr(clustering.LDA, "fit", told)
    few = spark.createDataFrame([(i, f"word{i}", "gene text") for i in range(40)],
                                "pmid long, title string, content string").repartition(16)
    monkeypatch.setattr(tables, "articles", lambda *_: few)
    shares = q_models.q_topics(spark, "nowhere").groupBy("pmid").agg(F.sum("share").alias("s")).collect()
    assert len(shares) == 40 and all(abs(r.s - 1) < 1e-4 for r in shares)
    (passes, slots, tasks), = fitted
    assert passes >= 5 and slots == 1 << 18 and tasks <= spark.sparkContext.defaultParallelism
