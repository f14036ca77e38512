"""Sentences as lists of tokens: those of the long table, without a shuffle; tasks of word2vec."""

from collections import defaultdict

from pubsift.operators import embeddings as EM
from pubsift.operators import text as X

DOCS = [(1, "Some title", "The gene BRCA1 binds. Twice it binds! 12 33. Nothing"), (2, None, None), (3, "x", "the. of. a")]


def test_lists_are_the_sentences_of_the_table(spark, capsys):
    docs = spark.createDataFrame(DOCS, "pmid long, title string, content string")
    want = defaultdict(list)
    for r in sorted(X.sentence_token_table(docs).collect()):
        want[r.pmid, r.sent_pos].append(r.token)
    lists = X.sentence_token_lists(docs, keep=("title",))
    assert {(r.pmid, r.sent_pos): r.tokens for r in lists.collect()} == want
    lists.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_word2vec_tasks_do_not_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4000")
        assert EM.word2vec_tasks(spark) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
