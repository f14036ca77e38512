"""Corpora side by side give what each gives alone."""

import random

import pytest

from pubsift.operators import linear as LN
from pubsift.operators import workflow as W

GRID = [LN.Setting("logistic", 0.01), LN.Setting("logistic", 1.0)]


def corpora(names):
    rng = random.Random(3)
    docs, labels, bow, split = [], [], [], []
    for c, name in enumerate(["a", "b", "c"]):
        for i in range(60):
            pmid = c * 100 + i
            topic = rng.randrange(2)
            words = {f"t{topic}" if rng.random() < 0.8 else "t0": rng.randint(1, 3)} | {f"w{rng.randrange(30)}": 1 for _ in range(6)}
            if name in names:
                docs.append((name, pmid))
                labels += [(pmid, "all")] + ([(pmid, "one")] if topic else []) + ([(pmid, f"rare {name}")] if i == 7 else [])
                bow += [(pmid, t, n) for t, n in words.items()]
                split.append((pmid, "test" if i % 4 == 0 else "train"))
    return docs, labels, bow, split


def run(spark, names):
    docs, labels, bow, split = corpora(names)
    ys = W.corpus_labels(spark.createDataFrame(docs, "corpus string, pmid long"),
                         spark.createDataFrame(labels, "pmid long, meshid string"), k=3)
    out = W.corpus_models(spark.createDataFrame(bow, "pmid long, token string, n long"), ys,
                          spark.createDataFrame(split, "pmid long, split string"), GRID, k=10)
    return {(r.corpus, r.meshid): (r.setting, r.score, r.accuracy, r.f1) for r in out.collect()}


def test_models_of_a_corpus_do_not_depend_on_others(spark):
    every = run(spark, "abc")
    assert set(every) == {(c, m) for c in "abc" for m in ("all", "one", f"rare {c}")}
    alone = run(spark, "b")
    for key, value in alone.items():
        assert every[key] == pytest.approx(value)
    assert all(every[c, "all"][2] == 1.0 and every[c, "one"][2] > 0.6 for c in "abc")


def test_vectors_of_corpora(spark):
    rng = random.Random(1)
    rows = []
    for c in "ab":
        for s in range(150):
            group = ["x1", "x2", "x3"] if s % 2 else ["y1", "y2", "y3"]
            rows += [(c, s, i, rng.choice(group)) for i in range(8)]
    got = W.corpus_vectors(spark.createDataFrame(rows, "corpus string, s long, tok_pos int, token string"), ["s"], size=8,
                           num_partitions=1, max_iter=3).collect()
    assert sorted((r.corpus, r.word) for r in got) == [(c, f"{g}{i}") for c in "ab" for g in "xy" for i in (1, 2, 3)]
    assert all(len(r.vector) == 8 for r in got)


def test_tokens_meet_the_features_of_their_own_corpus(spark, monkeypatch):
    """every token met the features of the labels of all corpora, which grew with their number."""
    met = []

    def counted(bow, ys, best, split, folds=4, **kw):
        on = [c for c in ("corpus", "token") if c in bow.columns and c in best.columns]
        met.append((bow.join(best, on).count(), bow.join(best.join(ys, "key"), ["token", "pmid"]).count()))
        return rows(bow, ys, best, split, folds, **kw)

    rows = LN.label_rows
    monkeypatch.setattr(LN, "label_rows", counted)
    run(spark, "abc")
    assert met[0][0] == met[0][1] > 0


def test_grouped_scores_are_those_of_the_labels(spark):
    """Ids that repeat, in one group and in two, and a label without positives."""
    from pubsift.operators import labels as L

    ys = spark.createDataFrame(
        [(g, p, f"{g}{k}", int((p * 7 + k) % 3 == 0 and k < 2)) for g, p in
         [("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", 6), ("b", 3), ("b", 4), ("b", 9), ("b", 5)] for k in range(3)],
        "corpus string, pmid long, key string, y int")
    bow = spark.createDataFrame([(p, t, n) for p, t, n in
                                 [(1, "x", 2), (1, "y", 1), (2, "x", 1), (3, "x", 4), (3, "z", 1), (4, "z", 3), (5, "y", 2),
                                  (5, "x", 1), (6, "q", 2), (7, "x", 9)]], "pmid long, token string, n long")
    want = L.anova_f(bow, ys.drop("corpus"), label="key", sampled=True)
    here = bow.join(ys.select("corpus", "pmid").distinct(), "pmid")
    got = L.anova_f(here, ys, label="key", sampled=True, group="corpus")
    show = lambda df: {(r.key, r.token): r.f and round(r.f, 9) for r in df.collect()}
    assert show(got) == show(want) and len(show(want)) > 15
