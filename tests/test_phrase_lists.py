"""Phrase merging over sentence lists equals merging over token rows, also where ids repeat."""

from pyspark.sql import functions as F

from pubsift.operators import text as X

DOCS = [(1, 0, ["a", "b", "c", "x"]), (1, 1, ["a", "b", "a", "b"]), (2, 0, ["b", "c", "b", "c", "a"]),
        (3, 0, ["a"]), (None, 0, ["a", "b", "c"]), (None, 0, ["a", "b", "c"]), (4, 0, ["a", "b", "c"]),
        (4, 0, ["a", "b", "c"]), (5, 2, ["a", "b", "c", "a", "b", "c"])]


def _rows(df):
    return sorted(df.select("pmid", "sent_pos", "tok_pos", "token").collect(), key=str)


def test_lists_and_rows_merge_alike(spark):
    lists = spark.createDataFrame(DOCS, "pmid long, sent_pos int, tokens array<string>")
    rows = lists.select("pmid", "sent_pos", F.posexplode("tokens").alias("tok_pos", "token"))
    for passes in (1, 2):
        a, models = X.preprocess(lists, passes, 2, 0.1)
        b, expected = X.preprocess(rows, passes, 2, 0.1)
        assert _rows(a) == _rows(b)
        assert [sorted(m.collect()) for m in models] == [sorted(m.collect()) for m in expected]
        assert any("·" in r.token for r in _rows(a))
        assert _rows(X.apply_preprocessing(lists, models)) == _rows(X.apply_preprocessing(rows, expected))


def test_pairs_of_lists_are_not_shuffled(spark):
    """The next token was found by a window, which moved every token."""
    lists = spark.createDataFrame(DOCS, "pmid long, sent_pos int, tokens array<string>")
    plan = X._pairs(lists, "pmid")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
