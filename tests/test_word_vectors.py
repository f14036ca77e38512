"""Weighted word vectors: frequent and rare words, vectors of several lengths, words without one."""

import pytest

from pubsift.operators import labels as L


@pytest.mark.parametrize("room", [0, 1 << 20, 4 * 3 * 2 + 2 * 64])
def test_frequent_and_rare_words(spark, room):
    weights = [(1, "a", 0.5), (1, "b", 2.0), (1, "rare", 1.0), (2, "a", 1.0), (2, "none", 9.0), (3, "b", 3.0),
               (3, "a", 1.0), (4, "none", 1.0), (5, "rare", 2.0), (5, "twice", 1.0)]
    vectors = [("a", [1.0, 2.0, 3.0]), ("b", [4.0, 0.5]), ("rare", [1.0]), ("twice", [1.0]), ("twice", [2.0]), ("c", [9.0] * 3)]
    got = {(r.pmid, r.dim): r.value for r in L.tfidf_word_vectors(
        spark.createDataFrame(weights, "pmid long, token string, tfidf double"),
        spark.createDataFrame(vectors, "word string, vector array<float>"), frequent_bytes=room).collect()}
    want = {}
    for p in {p for p, _, _ in weights}:
        hits = [(w, v) for q, t, w in weights if q == p for word, v in vectors if word == t]
        for d in range(max((len(v) for _, v in hits), default=0)):
            want[p, d] = sum(w * v[d] for w, v in hits if len(v) > d) / sum(w for w, _ in hits)
    assert got == pytest.approx(want)
