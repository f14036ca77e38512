"""Profiles from counted tokens equal those from tokens."""

from pubsift.operators import embeddings as EM
from pubsift.operators import text as X


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counted_tokens_give_the_same_profiles(spark):
    docs = spark.createDataFrame([(1, "cat dog", "cat. Dog cat"), (2, "fish", "cat"), (2, "dog", "dog"),
                                  (None, "fish", "fish"), (3, "", None)], "pmid long, title string, content string")
    clusters = spark.createDataFrame([("cat", 0), ("dog", 0), ("fish", 1)], "word string, label long")
    labels = clusters.select("label").distinct()
    toks, bag = X.sentence_token_table(docs), X.document_bag(docs)
    assert _rows(EM.cluster_counts(bag, clusters)) == [(1, 0, 5), (2, 0, 3), (2, 1, 1), (None, 1, 2)]
    counts = EM.cluster_counts(bag, clusters)
    assert _rows(EM.idcf(bag, clusters, counts=counts)) == _rows(EM.idcf(toks, clusters)) == [(0, 0.5), (1, 1.0)]
    for normalise in (False, True):
        a = EM.cluster_profile(bag, clusters, EM.idcf(bag, clusters), labels, normalise=normalise, docs=docs, counts=counts)
        b = EM.cluster_profile(toks, clusters, EM.idcf(toks, clusters), labels, normalise=normalise, docs=docs)
        assert _rows(a) == _rows(b)
